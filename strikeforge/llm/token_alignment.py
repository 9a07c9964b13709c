"""Tokens of two vocabularies aligned by the bytes they cover, fragment by fragment.

A text is cut into ranges. The tokens of a range make a fragment: an open prefix up to the first
byte at which both sides end a token, closed groups between such bytes, and an open suffix.
Fragments compose associatively: the suffix of one and the prefix of the next are aligned anew.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeforge.llm.shared import column, id_key, id_of, pieces
from strikeforge.sources.tables import Stage

#: Characters of a range; texts of one range are aligned where they are read.
RANGE_CHARS = 1 << 16
#: Fragments that one step of the tree reduction composes.
FAN_IN = 8
#: Links that a task gathers before it counts them.
GATHERED_LINKS = 1 << 22
#: Id pairs whose counts are broadcast, 16 bytes each; all others are joined.
COMMON_PAIRS = 1 << 18

# How the byte-level vocabulary splits a text before it merges bytes, and the bytes
# that stand for themselves in its entries (the others follow from code point 256 on).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = (*range(33, 127), *range(161, 173), *range(174, 256))
SPACE_MARK = "▁"

#: Words whose alignment a task remembers, twice, and their longest in characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 17, 64
#: White space too long for the fast encoder.
_LONG_GAP = re.compile(r"\s{1000}")
#: A space beside white space, and the places where a text can be cut into words.
_WIDE_GAP, _SINGLE_SPACE = re.compile(r" \s|\s "), re.compile(r"(?<=\S) (?=\S)")
#: Never part of a piece, so what follows it is encoded as if it stood there alone.
_APART = "\n"


class Tokens(NamedTuple):
    """Ids, and the byte at which each token ends."""

    ids: np.ndarray
    ends: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(np.concatenate((self.ids, other.ids)), np.concatenate((self.ends, other.ends)))

    def part(self, begin: int, end: int) -> Tokens:
        return Tokens(self.ids[begin:end], self.ends[begin:end])


NO_TOKENS = Tokens(np.zeros(0, "i8"), np.zeros(0, "i8"))


# -- the two vocabularies


@dataclass
class ByteVocabulary:
    """A byte-level vocabulary with merges, from its file."""

    path: str

    @cached_property
    def entries(self) -> dict[bytes, int]:
        with open(self.path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        others = (b for b in range(256) if b not in PRINTED)
        octet = {chr(b): b for b in PRINTED} | {chr(256 + n): b for n, b in enumerate(others)}
        return {bytes(octet[c] for c in entry): n for entry, n in vocabulary.items()}

    @cached_property
    def sizes(self) -> np.ndarray:
        sizes = np.zeros(max(self.entries.values()) + 1, "i8")
        sizes[list(self.entries.values())] = [len(e) for e in self.entries]
        return sizes

    @cached_property
    def _fast(self) -> tiktoken.Encoding:
        """Entries are numbered in the order of their merges, so ids are ranks."""
        return tiktoken.Encoding(
            "bytes", pat_str=SPLIT, mergeable_ranks=self.entries, special_tokens={}
        )

    @cached_property
    def _plain(self) -> tokenizers.Tokenizer:
        made = tokenizers.Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    @cached_property
    def _neighbours(self) -> set[bytes]:
        return {e[i : i + 2] for e in self.entries for i in range(len(e) - 1)}

    def encode(self, text: str) -> list[int]:
        if _LONG_GAP.search(text):
            return self._plain.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)

    def is_cut(self, text: str, at: int) -> bool:
        """Whether both sides of ``at`` may be encoded by themselves: before a single space
        between words, or between letters whose bytes no entry has side by side."""
        before, here = text[at - 1], text[at]
        if here == " ":
            return not before.isspace() and at + 1 < len(text) and not text[at + 1].isspace()
        pair = before.encode()[-1:] + here.encode()[:1]
        return before.isalpha() and here.isalpha() and pair not in self._neighbours


@dataclass
class PieceVocabulary:
    """A vocabulary of pieces with byte fallback and a space put in front, from its file."""

    path: str

    @cached_property
    def model(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @cached_property
    def octets(self) -> list[bytes]:
        """What each piece stands for."""
        names = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        return [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(n)
            else name.replace(SPACE_MARK, " ").encode()
            for n, name in enumerate(names)
        ]

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(o) for o in self.octets], "i8")

    @cached_property
    def _neighbours(self) -> set[str]:
        texts = [o.decode() for n, o in enumerate(self.octets) if not self.model.is_byte(n)]
        if any(_APART in t for t in texts) or len(self.model.encode(_APART)) != 2:
            raise ValueError("a vocabulary with line feeds in its pieces cannot be cut")
        return {t[i : i + 2] for t in texts for i in range(len(t) - 1)}

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def encode_inside(self, text: str) -> list[int]:
        """A text that does not start a document, so that no space is put in front."""
        return self.encode(_APART + text)[2:]

    def is_cut(self, text: str, at: int) -> bool:
        """Whether no piece has the characters before and at ``at`` side by side."""
        return text[at - 1 : at + 1] not in self._neighbours

    def spells(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.octets.__getitem__, ids)) == text.encode()


@lru_cache(maxsize=4)
def vocabularies(a_path: str, b_path: str) -> tuple[ByteVocabulary, PieceVocabulary]:
    """Loaded once per worker; the files are part of the installed libraries of every executor."""
    return ByteVocabulary(a_path), PieceVocabulary(b_path)


# -- fragments


@lru_cache(maxsize=1)
def _spellings(bits: int) -> list[bytes]:
    return [b"%d%s" % (n, s) for n in range(1 << bits) for s in (b",", b"|", b";")]


def _spelled_ids(most: int) -> list[bytes]:
    """Every id up to ``most`` at least, followed by each of the three separators."""
    return _spellings(max(16, most.bit_length()))


def laid_out(
    a: Tokens, b: Tokens, a_ends: np.ndarray, b_ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed groups as three times the id plus the separator that follows, all in order; the
    pairs of linked ids; and the byte at which each link ends.

    Between two bytes at which any token ends exactly one token of A overlaps one of B.
    """
    a_last, b_last = np.flatnonzero(a_ends) + 1, np.flatnonzero(b_ends) + 1
    a_group, b_group = (np.cumsum(e) - e for e in (a_ends, b_ends))
    codes = np.empty(len(a.ids) + len(b.ids), "i8")
    codes[np.arange(len(a.ids)) + np.append(0, b_last)[a_group]] = 3 * a.ids + a_ends
    codes[np.arange(len(b.ids)) + a_last[b_group]] = 3 * b.ids + 2 * b_ends
    edges = np.unique(np.concatenate((a.ends, b.ends)))
    links = pair_of(a.ids[np.searchsorted(a.ends, edges)], b.ids[np.searchsorted(b.ends, edges)])
    return codes, links, edges


@dataclass
class Groups:
    """Closed groups in a row: how many, their spelling, and their links as pairs with counts."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    spelling: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))

    @classmethod
    def of(cls, a: Tokens, b: Tokens, a_ends: np.ndarray, b_ends: np.ndarray) -> Groups:
        """Tokens that end together at last; ``a_ends`` and ``b_ends`` say which close a group."""
        if not len(a.ids):
            return cls()
        codes, links, _ = laid_out(a, b, a_ends, b_ends)
        spelling = b"".join(map(_spelled_ids(int(codes.max()) // 3).__getitem__, codes.tolist()))
        pairs, times = np.unique(links, return_counts=True)
        return cls(len(a.ids), len(b.ids), int(a_ends.sum()), spelling, pairs, times)

    def __add__(self, other: Groups) -> Groups:
        pairs, place = np.unique(np.concatenate((self.pairs, other.pairs)), return_inverse=True)
        times = np.zeros(len(pairs), "i8")
        np.add.at(times, place, np.concatenate((self.times, other.times)))
        return Groups(
            self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups,
            self.spelling + other.spelling, pairs, times,
        )


def pair_of(a, b):
    return (a << 32) | b


def common_ends(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side end where one of the other does."""
    return tuple(np.isin(x.ends, y.ends, assume_unique=True) for x, y in ((a, b), (b, a)))


@dataclass
class Fragment:
    """Open prefix, closed groups, open suffix. Without a common end all is prefix."""

    prefix: tuple[Tokens, Tokens]
    closed: Groups = field(default_factory=Groups)
    suffix: tuple[Tokens, Tokens] = (NO_TOKENS, NO_TOKENS)
    is_cut: bool = False

    @classmethod
    def of(cls, a: Tokens, b: Tokens) -> Fragment:
        a_ends, b_ends = common_ends(a, b)
        at_a, at_b = np.flatnonzero(a_ends) + 1, np.flatnonzero(b_ends) + 1
        if not len(at_a):
            return cls((a, b))
        (a1, a2), (b1, b2) = ((int(x[0]), int(x[-1])) for x in (at_a, at_b))
        closed = Groups.of(a.part(a1, a2), b.part(b1, b2), a_ends[a1:a2], b_ends[b1:b2])
        rest = a.part(a2, None), b.part(b2, None)
        return cls((a.part(0, a1), b.part(0, b1)), closed, rest, True)

    def __add__(self, other: Fragment) -> Fragment:
        """The fragment of both ranges in a row."""
        left = self.suffix if self.is_cut else self.prefix
        middle = Fragment.of(*(x + y for x, y in zip(left, other.prefix)))
        if not self.is_cut:
            closed, suffix = middle.closed, middle.suffix
            if other.is_cut:
                closed, suffix = closed + other.closed, other.suffix
            return Fragment(middle.prefix, closed, suffix, middle.is_cut)
        if not middle.is_cut:
            return Fragment(self.prefix, self.closed, middle.prefix, True)
        closed = self.closed + group(*middle.prefix) + middle.closed
        if other.is_cut:
            return Fragment(self.prefix, closed + other.closed, other.suffix, True)
        return Fragment(self.prefix, closed, middle.suffix, True)

    def whole(self) -> Groups:
        """The groups of a fragment that is a whole text."""
        return group(*self.prefix) + self.closed


def group(a: Tokens, b: Tokens) -> Groups:
    """One group of all the tokens."""
    if not len(a.ids):
        return Groups()
    return Groups.of(a, b, *(np.arange(len(x.ids)) == len(x.ids) - 1 for x in (a, b)))


# -- what tasks hand on

_TOKENS = "struct<ids: binary, ends: binary>"
_SUMS = "n_a long, n_b long, n_groups long, pairs binary"
GROUPS = f"doc long, key long, {_SUMS}, spelling binary"
FRAGMENTS = (
    f"doc long, key long, place long, broken boolean, is_cut boolean, {_SUMS}, spelling binary, "
    f"open array<{_TOKENS}>"
)


def pack_pairs(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Steps between sorted pairs and counts, byte by byte of equal weight, compressed."""
    table = np.stack((np.diff(pairs, prepend=0), times))
    return zstandard.compress(table.view("u1").reshape(-1, 8).T.tobytes(), 1)


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(8, -1)
    steps, times = np.ascontiguousarray(planes.T).view("i8").reshape(2, -1)
    return np.cumsum(steps), times


def _packed(groups: Groups) -> dict:
    return {
        "n_a": groups.n_a, "n_b": groups.n_b, "n_groups": groups.n_groups,
        "pairs": pack_pairs(groups.pairs, groups.times), "spelling": groups.spelling,
    }


def _schema(ddl: str) -> pa.Schema:
    """The Arrow schema of the plain types used here."""
    kinds = {
        "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
        f"array<{_TOKENS}>": pa.list_(pa.struct([("ids", pa.binary()), ("ends", pa.binary())])),
    }
    return pa.schema([
        (name, kinds[kind]) for name, kind in re.findall(r"(\w+) (array<struct<.*?>>|\w+)(?:, |$)", ddl)
    ])


def _dump(fragment: Fragment) -> dict:
    opened = [
        {"ids": t.ids.astype("i4").tobytes(), "ends": t.ends.tobytes()}
        for t in (*fragment.prefix, *fragment.suffix)
    ]
    return _packed(fragment.closed) | {"is_cut": fragment.is_cut, "open": opened}


def _load(row: dict) -> Fragment:
    a, b, c, d = (
        Tokens(np.frombuffer(t["ids"], "i4").astype("i8"), np.frombuffer(t["ends"], "i8"))
        for t in row["open"]
    )
    pairs, times = unpack_pairs(row["pairs"])
    closed = Groups(row["n_a"], row["n_b"], row["n_groups"], row["spelling"], pairs, times)
    return Fragment((a, b), closed, (c, d), row["is_cut"])


class WordAligner:
    """Aligns texts word by word, and remembers the alignments of words, a bounded number.

    Both vocabularies end a token before a single space between words, and merge nothing
    across it. So every such word is a fragment without open ends, and a text the sum of its words.
    """

    def __init__(self, a_side: ByteVocabulary, b_side: PieceVocabulary):
        self.a_side, self.b_side = a_side, b_side
        #: By word: tokens of A and B, groups, spelling, links; None if B does not spell it.
        self.known: dict[str, tuple | None] = {}
        #: What was known before the last clearing; words that come again are taken over.
        self.earlier: dict[str, tuple | None] = {}

    def align(self, texts: Iterable[str | None]) -> list[Groups]:
        split = [words_of(text) if text else [] for text in texts]
        distinct = set().union(*split)
        if len(self.known) > REMEMBERED:
            self.known, self.earlier = {}, self.known
        known = self.known
        new = [w for w in distinct if w not in known]
        again = [w for w in new if w in self.earlier]
        known.update(zip(again, map(self.earlier.get, again)))
        missing = [w for w in new if w not in known]
        known.update(zip(missing, self._aligned(missing)))
        out = [self._sum(list(map(known.__getitem__, words))) for words in split]
        for word in missing:
            if len(word) > REMEMBERED_CHARS:
                del known[word]
        return out

    @staticmethod
    def _sum(words: list[tuple | None]) -> Groups:
        if not words or None in words:
            return Groups()
        n_a, n_b, n_groups, spelling, links = zip(*words)
        pairs, times = np.unique(np.frombuffer(b"".join(links), "i8"), return_counts=True)
        return Groups(sum(n_a), sum(n_b), sum(n_groups), b"".join(spelling), pairs, times)

    def _aligned(self, words: list[str]) -> list[tuple | None]:
        """All words at once, one after the other as if they were one text."""
        b_ids = self.b_side.model.encode(words, num_threads=1)
        good = [self.b_side.spells(b, " " + w) for w, b in zip(words, b_ids)]
        a_ids = [self.a_side.encode(" " + w) for w, g in zip(words, good) if g]
        b_ids = [b for b, g in zip(b_ids, good) if g]
        if not a_ids:
            return [None] * len(words)
        a_sizes, b_sizes = (np.array([len(x) for x in ids]) for ids in (a_ids, b_ids))
        sides = []
        for ids, side in ((a_ids, self.a_side), (b_ids, self.b_side)):
            flat = np.fromiter((n for own in ids for n in own), "i8")
            sides.append(Tokens(flat, np.cumsum(side.sizes[flat])))
        a, b = sides
        a_ends, b_ends = common_ends(a, b)
        codes, links, edges = laid_out(a, b, a_ends, b_ends)
        spelled = list(map(_spelled_ids(int(codes.max()) // 3).__getitem__, codes.tolist()))
        a_last = np.cumsum(a_sizes) - 1
        code_stops = np.cumsum(a_sizes + b_sizes).tolist()
        n_groups = np.diff(np.cumsum(a_ends)[a_last], prepend=0).tolist()
        link_stops = (8 * (np.searchsorted(edges, a.ends[a_last]) + 1)).tolist()
        octets, code, link, made = links.tobytes(), 0, 0, []
        for n_a, n_b, n, stop, end in zip(
            a_sizes.tolist(), b_sizes.tolist(), n_groups, code_stops, link_stops
        ):
            made.append((n_a, n_b, n, b"".join(spelled[code:stop]), octets[link:end]))
            code, link = stop, end
        whole = iter(made)
        return [next(whole) if g else None for g in good]


def words_of(text: str) -> list[str]:
    """A text cut before each single space between words; that space is not part of either."""
    if text[0] == " " or text[-1] == " " or _WIDE_GAP.search(text):
        return _SINGLE_SPACE.split(text)
    return text.split(" ")


def _align_short(a_path: str, b_path: str):
    """Texts of one range: tokens, groups and links at once."""
    schema = _schema("key long, " + _SUMS + ", spelling binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = WordAligner(*vocabularies(a_path, b_path))
        for batch in pieces(batches):
            found = aligner.align(column(batch, "text"))
            out = [{"key": k, **_packed(g)} for k, g in zip(column(batch, "key"), found)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def range_cuts(text: str, size: int, is_cut: Callable[[str, int], bool]) -> list[int]:
    """Where ranges of about ``size`` characters may be encoded apart, 0 and the end included."""
    cuts = [0]
    for edge in range(size, len(text), size):
        at = max(edge, cuts[-1])
        while at < len(text) and at > cuts[-1] and not is_cut(text, at):
            at += 1
        cuts.append(at)
    return [*cuts, len(text)]


def _split_long(a_path: str, b_path: str, size: int):
    """Ranges of long texts; each side is cut at a place of its own."""
    schema = _schema("doc long, key long, place long, a_at long, b_at long") \
        .append(pa.field("a_text", pa.string())).append(pa.field("b_text", pa.string()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = vocabularies(a_path, b_path)
        for batch in pieces(batches, 1):
            for doc, key, text in zip(*(column(batch, c) for c in ("doc", "key", "text"))):
                spaced = " " + text
                a_cuts, b_cuts = (range_cuts(spaced, size, s.is_cut) for s in sides)
                a_at = b_at = 0
                for place in range(len(a_cuts) - 1):
                    a_text, b_text = (spaced[c[place] : c[place + 1]] for c in (a_cuts, b_cuts))
                    row = {"doc": doc, "key": key, "place": place, "a_at": a_at, "b_at": b_at,
                           "a_text": a_text, "b_text": b_text}
                    a_at, b_at = a_at + len(a_text.encode()), b_at + len(b_text.encode())
                    yield pa.RecordBatch.from_pylist([row], schema)

    return run


def _align_ranges(a_path: str, b_path: str):
    schema = _schema(FRAGMENTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = vocabularies(a_path, b_path)
        for batch in pieces(batches, 16):
            out = []
            for row in batch.to_pylist():
                place, a_text, b_text = row["place"], row["a_text"], row["b_text"]
                b = b_side.encode_inside(b_text) if place else b_side.encode(b_text[1:])
                broken = not b_side.spells(b, b_text)
                fragment = Fragment((NO_TOKENS, NO_TOKENS))
                if not broken:
                    a, b = (np.array(x, "i8") for x in (a_side.encode(a_text), b))
                    fragment = Fragment.of(
                        Tokens(a, row["a_at"] + np.cumsum(a_side.sizes[a])),
                        Tokens(b, row["b_at"] + np.cumsum(b_side.sizes[b])),
                    )
                head = {"doc": row["doc"], "key": row["key"], "place": place, "broken": broken}
                out.append(head | _dump(fragment))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _compose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams fragments sorted by document and place; neighbours of one parent become one."""
    schema = _schema(FRAGMENTS)
    head: dict | None = None
    total: Fragment | None = None

    def settled() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([head | _dump(total)], schema)

    for batch in pieces(batches, 1):
        for row in batch.to_pylist():
            own = {"doc": row["doc"], "key": row["key"], "place": row["place"] // FAN_IN,
                   "broken": row["broken"]}
            if head is not None and (head["doc"], head["place"]) == (own["doc"], own["place"]):
                head["broken"] |= own["broken"]
                total = Fragment((NO_TOKENS, NO_TOKENS)) if head["broken"] else total + _load(row)
                continue
            if head is not None:
                yield settled()
            head, total = own, _load(row)
    if head is not None:
        yield settled()


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema("key long, " + _SUMS + ", spelling binary")
    for batch in pieces(batches, 1):
        out = []
        for row in batch.to_pylist():
            groups = Groups() if row["broken"] else _load(row).whole()
            out.append({"key": row["key"], **_packed(groups)})
        yield pa.RecordBatch.from_pylist(out, schema)


def _align_long(rows: DataFrame, stage: Stage, paths: tuple[str, str], size: int) -> DataFrame:
    """Texts of many ranges: ranges are dealt to tasks, their fragments composed as a tree."""
    stage.write("long", rows.withColumn("doc", F.monotonically_increasing_id()))
    long = stage.read("long")
    most = long.agg(F.max(F.length("text"))).first()[0] or 0
    ranges = long.select("doc", "key", "text").mapInArrow(
        _split_long(*paths, size),
        "doc long, key long, place long, a_at long, b_at long, a_text string, b_text string",
    )
    fragments = ranges.repartition("doc", "place").mapInArrow(_align_ranges(*paths), FRAGMENTS)
    n_ranges = most // size + 1
    while n_ranges > 1:
        parent = F.expr(f"place div {FAN_IN}")
        dealt = fragments.repartition("doc", parent).sortWithinPartitions("doc", "place")
        fragments, n_ranges = dealt.mapInArrow(_compose, FRAGMENTS), -(-n_ranges // FAN_IN)
    return fragments.mapInArrow(_finish, "key long, " + _SUMS + ", spelling binary")


def aligned_groups(
    docs: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text",
    range_chars: int = RANGE_CHARS,
) -> DataFrame:
    """``key, n_a, n_b, n_groups, pairs, spelling`` of every row: its alignment, not yet counted
    over the corpus. ``spelling`` has ``a1,a2|b1;`` for every group; ``pairs`` is packed."""
    rows = docs.select(id_key(doc_id).alias("key"), F.col(text).cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") >= range_chars, F.lit(False))
    short = rows.filter(~is_long).mapInArrow(
        _align_short(a_path, b_path), "key long, " + _SUMS + ", spelling binary"
    )
    long = _align_long(rows.filter(is_long), Stage(docs.sparkSession), (a_path, b_path), range_chars)
    return short.union(long)


# -- counts over the corpus


def _count_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of the task hold each pair, in parts of bounded size."""

    def settle(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n_docs"])

    held, size = [], 0
    for batch in pieces(batches):
        for data in column(batch, "pairs"):
            held.append(unpack_pairs(data)[0])
            size += len(held[-1])
        if size >= GATHERED_LINKS:
            yield settle(held)
            held, size = [], 0
    if size:
        yield settle(held)


def _look_up(common: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``common`` of the pairs it has, and which pairs these are."""
    if not len(common):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    at = np.minimum(np.searchsorted(common, pairs), len(common) - 1)
    own = np.flatnonzero(common[at] == pairs)
    return at[own], own


def _sum_common(shared):
    """Sums over the links whose pair is broadcast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts, best = shared.value
        for batch in pieces(batches, 512):
            sums = []
            for data in column(batch, "pairs"):
                pairs, times = unpack_pairs(data)
                at, own = _look_up(common, pairs)
                sums.append((int(times.sum()), int((best[at] * times[own]).sum()),
                             int((counts[at] * times[own]).sum())))
            made = zip(*sums) if sums else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("row")), *(pa.array(x, pa.int64()) for x in made)],
                ["row", "n_links", "n_best", "count_sum"],
            )

    return run


def _other_pairs(shared):
    """The pairs that are not broadcast, row by row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value[0]
        for batch in pieces(batches, 512):
            rows, found, counted = [], [], []
            for row, data in zip(column(batch, "row"), column(batch, "pairs")):
                pairs, times = unpack_pairs(data)
                other = np.ones(len(pairs), bool)
                other[_look_up(common, pairs)[1]] = False
                found.append(pairs[other])
                counted.append(times[other])
                rows.append(np.full(len(found[-1]), row, "i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (rows, found, counted)], ["row", "pair", "times"]
            )

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n_docs, best``: rows that hold each linked pair, and whether no pair with its A id
    is held by more."""
    partial = aligned.select("pairs").mapInArrow(_count_pairs, "pair long, n_docs long")
    counts = partial.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
    stage = Stage(aligned.sparkSession)
    stage.write("counts", counts.withColumn("a", F.shiftright("pair", 32)))
    counts = stage.read("counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    best = (F.col("n_docs") == F.col("most")).cast("long").alias("best")
    stage.write("judged", counts.join(most, "a").select("pair", "n_docs", best))
    return stage.read("judged")


def _common(counts: DataFrame, limit: int) -> DataFrame:
    """The pairs of the highest counts, ``limit`` at most."""
    power = F.floor(F.log2("n_docs")).alias("power")
    sizes = {r.power: r.n for r in counts.groupBy(power).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = total = 0
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > limit:
            least = 2 ** (power + 1)
            break
    return counts.filter(F.col("n_docs") >= least)


def with_counts(aligned: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """``n_links, n_best, count_sum`` in place of the packed ``pairs`` of every row.

    The rows are stored first. Counts of the most frequent pairs, ``common_pairs`` at most, are
    broadcast; all others are joined.
    """
    spark, stage = aligned.sparkSession, Stage(aligned.sparkSession)
    stage.write("aligned", aligned.withColumn("row", F.monotonically_increasing_id()))
    aligned = stage.read("aligned")
    counts = pair_counts(aligned)
    held = _common(counts, common_pairs).orderBy("pair").toArrow()
    table = tuple(held.column(c).to_numpy() for c in ("pair", "n_docs", "best"))
    shared = spark.sparkContext.broadcast(table)
    own = aligned.select("row", "pairs")
    sums = own.mapInArrow(_sum_common(shared), "row long, n_links long, n_best long, count_sum long")
    other = own.mapInArrow(_other_pairs(shared), "row long, pair long, times long")
    others = other.join(counts, "pair").groupBy("row").agg(
        F.lit(0).cast("long").alias("n_links"), F.sum(F.col("best") * F.col("times")).alias("n_best"),
        F.sum(F.col("n_docs") * F.col("times")).alias("count_sum"),
    )
    total = sums.union(others).groupBy("row").agg(
        *(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum"))
    )
    return aligned.drop("pairs").join(total, "row").drop("row")


COUNTED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text",
    range_chars: int = RANGE_CHARS, common_pairs: int = COMMON_PAIRS,
) -> DataFrame:
    """One row per input row: how tokens of vocabularies A and B lie over each other.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, spelling``. A is a byte-level
    vocabulary (its JSON file) over a space and the text, B one of pieces with byte fallback
    whose model (a file) puts that space in front itself. Bytes at which both end a token cut the
    tokens into groups; tokens whose bytes overlap are linked. A pair of ids counts as many
    times as rows hold it linked; ``n_best`` are the links whose count is the highest of their
    A id, ``count_sum`` adds up the counts of all links. ``spelling`` is ``a1,a2|b1;a3|b2,b3``.

    A text of ``range_chars`` characters or more is cut into ranges, each side where its
    vocabulary cannot merge across the cut; the ranges go to different tasks and their
    fragments are composed as a tree. A stretch without such a place stays in one range.

    Texts that are NULL, empty, or that B does not spell with exactly their bytes have no
    tokens: zeros and an empty ``spelling``. Repeated rows and ids count and return row by row. Other
    columns are not read; an empty table gives an empty result.
    """
    aligned = aligned_groups(docs, a_path, b_path, doc_id=doc_id, text=text, range_chars=range_chars)
    spelled = aligned.withColumn("spelling", F.col("spelling").cast("string"))
    return with_counts(spelled, common_pairs).select(
        id_of("key").alias("doc_id"), *COUNTED, F.rtrim("spelling", F.lit(";")).alias("spelling")
    )


def digest_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``align_tokens`` with the SHA-256 of the groups' spelling, '' without tokens; the spelling
    itself is not stored."""
    aligned = aligned_groups(docs, a_path, b_path)
    inner = F.substring("spelling", F.lit(1), F.length("spelling") - 1)
    digest = F.when(F.col("n_a") > 0, F.sha2(inner, 256)).otherwise("").alias("groups_sha256")
    hashed = aligned.select("key", "n_a", "n_b", "n_groups", "pairs", digest)
    return with_counts(hashed).select(id_of("key").alias("doc_id"), *COUNTED, "groups_sha256")
