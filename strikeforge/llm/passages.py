"""Passages that stand in an earlier document too, found with suffix automata and removed.

Texts are words. Reference shards of bounded size become suffix automata whose states know the
first document that holds them; streamed through, a text shows at every word how long a match
ends there and in which document it stood first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeforge.llm.shared import NO_ID, column, id_key, id_of, pieces, text_bytes
from strikeforge.sources.tables import Stage

#: Words of the window that decides.
WINDOW = 50
#: Words of a gram, the part of a window that its anchor is chosen by.
GRAM = 8
#: Words of reference text in one automaton.
SHARD_WORDS = 1 << 16
#: A gram with more different passages than this is split: its windows become passages. So many
#: are about half a shard.
CROWDED = 1 << 9
#: Words of a text searched for anchors at once.
CHUNK = 1 << 16

ANCHORS = "gram long, high long, low long, key long, mark long, start int, n int"
PASSAGE = ("gram", "high", "low")


# -- suffix automata


class SuffixAutomaton:
    """All strings of words of some texts. Every state knows the first text that has it.

    Texts are added in the order of their keys, so the key a state is made with is its least.
    """

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [NO_ID]

    def _state(self, follows: dict[int, int], length: int, first: int) -> int:
        self.next.append(follows)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, before: int, word: int, state: int) -> int:
        """The part of ``state`` that is one word longer than ``before``, as a state of its own."""
        part = self._state(dict(self.next[state]), self.length[before] + 1, self.first[state])
        self.link[part], self.link[state] = self.link[state], part
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = part
            before = self.link[before]
        return part

    def add(self, words: Sequence[bytes], key: int) -> None:
        numbers, follow, link, length = self.numbers, self.next, self.link, self.length
        last = 0
        for text in words:
            word = numbers.setdefault(text, len(numbers))
            known = follow[last].get(word)
            if known is not None:
                whole = length[known] == length[last] + 1
                last = known if whole else self._split(last, word, known)
                continue
            made, before = self._state({}, length[last] + 1, key), last
            while before >= 0 and word not in follow[before]:
                follow[before][word] = made
                before = link[before]
            if before >= 0:
                known = follow[before][word]
                whole = length[known] == length[before] + 1
                link[made] = known if whole else self._split(before, word, known)
            last = made

    def stream(self, words: Sequence[bytes], most: int) -> Iterator[tuple[int, int]]:
        """At each word the length of the longest match that ends there, ``most`` at most, and the
        first text that holds this match."""
        numbers, follow, link, length = self.numbers, self.next, self.link, self.length
        state = size = 0
        for text in words:
            word = numbers.get(text, -1)
            while state and word not in follow[state]:
                state = link[state]
                size = length[state]
            state = follow[state].get(word, 0)
            size = size + 1 if state else 0
            while state and length[link[state]] >= most:
                state = link[state]
            size = min(size, most)
            yield size, self.first[state]


def first_holders(automaton: SuffixAutomaton, words: Sequence[bytes], window: int) -> list[int | None]:
    """For each window of a text the first text with the same window, None without one."""
    found = [first if size >= window else None for size, first in automaton.stream(words, window)]
    return found[window - 1 :]


# -- candidates: windows with a gram that several documents hold


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), "u8", len(words))


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    value = np.zeros(len(hashes) - width + 1, "u8")
    for k in range(width):
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        value += hashes[k : k + len(value)]
    return value ^ (value >> np.uint64(32))


def anchors(hashes: np.ndarray, window: int, gram: int) -> list[tuple[int, int, int, int]]:
    """``gram hash, its place, first window, windows`` per anchor: the leftmost of the grams of a
    window with the least hash. Every window has exactly one."""
    out, width = [], window - gram + 1
    for begin in range(0, len(hashes) - window + 1, CHUNK):
        grams = gram_hashes(hashes[begin : begin + CHUNK + window - 1], gram)
        views = np.lib.stride_tricks.sliding_window_view(grams, width)
        at = views.argmin(axis=1) + np.arange(len(views))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        n = np.diff(np.append(first, len(at)))
        out.extend(zip(grams[at[first]].tolist(), (at[first] + begin).tolist(),
                       (first + begin).tolist(), n.tolist()))
    return out


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    table = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(table[:, 0]), pa.array(table[:, 1])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, "u8").view("i8"))


def _find(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            grams, digests, keys, marks, starts, counts = ([] for _ in range(6))
            for key, mark, data in zip(*(column(batch, c) for c in ("key", "mark", "data"))):
                words = data.split()
                if len(words) < window:
                    continue
                hashes = word_hashes(words)
                octets = memoryview(hashes).cast("B")
                found = anchors(hashes, window, gram)
                for value, place, start, n in found:
                    grams.append(value)
                    around = octets[8 * start : 8 * (start + n + window - 1)]
                    digests.append(xxhash.xxh3_128_digest(around, place - start))
                    starts.append(start)
                    counts.append(n)
                keys.append(np.full(len(found), key, "i8"))
                marks.append(np.full(len(found), mark, "i8"))
            if not grams:
                continue
            high, low = _halves(digests)
            yield pa.RecordBatch.from_arrays(
                [_signed(grams), high, low, pa.array(np.concatenate(keys)),
                 pa.array(np.concatenate(marks)), pa.array(starts, pa.int32()),
                 pa.array(counts, pa.int32())], ["gram", *ANCHORS.replace(",", "").split()[2::2]],
            )

    return run


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the passages a text is asked for."""
    for batch in pieces(batches):
        out = []
        for data, asked in zip(column(batch, "data"), column(batch, "asked")):
            words = data.split()
            for one in asked:
                size = one.pop("size")
                passage = b" ".join(words[one["start"] : one["start"] + size])
                out.append(one | {"words": passage})
        names = [*PASSAGE, "first", "start", "n", "crowded", "words"]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_pylist(out, pa.schema(zip(names, kinds)))


def _each_window(window: int):
    """The windows of passages of crowded grams, each by a hash of its words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            digests, own = [], []
            for number, data in enumerate(column(batch, "words")):
                words = data.split()
                octets = memoryview(word_hashes(words)).cast("B")
                n = len(words) - window + 1
                digests += [xxhash.xxh3_128_digest(octets[8 * i : 8 * (i + window)]) for i in range(n)]
                own.append((number, n))
            rows = np.repeat([o[0] for o in own], [o[1] for o in own])
            taken = batch.select([*PASSAGE, "first"]).take(pa.array(rows, pa.int64()))
            at = np.concatenate([np.arange(n, dtype="i4") for _, n in own])
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(at), *_halves(digests)],
                [*PASSAGE, "first", "at", "w_high", "w_low"],
            )

    return run


def _judge(window: int, shard_words: int):
    """Streams passages sorted by gram into shards of whole grams, and each through its shard."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        for row in sorted(rows, key=lambda r: r[3]):
            automaton.add(row[4], row[3])
        firsts = [first_holders(automaton, row[4], window) for row in rows]
        arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(firsts, pa.list_(pa.int64()))], [*PASSAGE, "firsts"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in pieces(batches, 1024):
            for *own, data in zip(*(column(batch, c) for c in (*PASSAGE, "first", "words"))):
                if size >= shard_words and own[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                words = data.split()
                rows.append((*own, words))
                size += len(words)
        if rows:
            yield settle(rows)

    return run


JUDGED = "gram long, high long, low long, firsts array<long>"


def _judged(passages: DataFrame, window: int, shard_words: int) -> DataFrame:
    dealt = passages.select(*PASSAGE, "first", "words").repartition("gram")
    return dealt.sortWithinPartitions(*PASSAGE).mapInArrow(_judge(window, shard_words), JUDGED)


def _judged_apart(cut: DataFrame, stage: Stage, window: int, shard_words: int) -> DataFrame:
    """Passages of crowded grams: their windows are the passages, dealt by their own hash.

    A window that one passage alone holds stood first where that passage did.
    """
    stage.write("crowded", cut)
    cut = stage.read("crowded")
    stage.write("windows", cut.mapInArrow(
        _each_window(window),
        "gram long, high long, low long, first long, at int, w_high long, w_low long",
    ))
    windows = stage.read("windows")
    one = F.min(F.struct("first", *PASSAGE, "at")).alias("one")
    held = windows.groupBy("w_high", "w_low").agg(F.count(F.lit(1)).alias("held"), one)
    stage.write("repeated", held.filter("held > 1").select("w_high", "w_low", "one.*"))
    repeated = stage.read("repeated")
    words = cut.select(*PASSAGE, F.split(F.col("words").cast("string"), " ").alias("all"))
    cut_out = F.array_join(F.slice("all", F.col("at") + 1, F.lit(window)), " ").cast("binary")
    passages = repeated.join(words, list(PASSAGE)).select(
        F.col("w_high").alias("gram"), F.col("w_high").alias("high"), F.col("w_low").alias("low"),
        "first", cut_out.alias("words"),
    )
    stage.write("firsts", _judged(passages, window, shard_words).select(
        F.col("high").alias("w_high"), F.col("low").alias("w_low"), F.col("firsts")[0].alias("found")
    ))
    shared = windows.join(stage.read("firsts"), ["w_high", "w_low"]).groupBy(*PASSAGE).agg(
        F.map_from_entries(F.collect_list(F.struct("at", "found"))).alias("shared")
    )
    firsts = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda at: F.coalesce(F.element_at("shared", at), F.col("first")),
    )
    whole = cut.select(*PASSAGE, "first", "n").join(shared, list(PASSAGE), "left")
    return whole.select(*PASSAGE, firsts.alias("firsts"))


def text_mark(data: Column) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(data)


def removed_windows(
    rows: DataFrame, stage: Stage, *, window: int, gram: int, shard_words: int, crowded: int
) -> DataFrame:
    """``key, mark, starts``: windows of ``rows(key, mark, data)`` that an earlier key holds too."""
    stage.write("anchors", rows.mapInArrow(_find(window, gram), ANCHORS))
    anchored = stage.read("anchors")
    held = anchored.groupBy("gram").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    stage.write("held", held.filter("least < most").select("gram"))
    # Of equal passages only the first is looked at; the others take over what it finds.
    one = F.min(F.struct("key", "mark", "start", "n")).alias("one")
    grouped = anchored.join(stage.read("held"), "gram").groupBy(*PASSAGE).agg(one)
    stage.write("passages", grouped.select(*PASSAGE, "one.*"))
    passages = stage.read("passages")
    crowds = passages.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded)
    stage.write("crowds", crowds.select("gram", F.lit(True).alias("crowded")))
    sized = passages.join(stage.read("crowds"), "gram", "left").withColumns({
        "crowded": F.coalesce("crowded", F.lit(False)), "size": F.col("n") + F.lit(window - 1),
        "first": F.col("key"),
    })
    wanted = F.struct(*PASSAGE, "first", "start", "n", "crowded", "size")
    asked = sized.groupBy("key", "mark").agg(F.collect_list(wanted).alias("asked"))
    texts = rows.join(asked, ["key", "mark"])
    stage.write("cut", texts.select("data", "asked").mapInArrow(
        _cut, "gram long, high long, low long, first long, start int, n int, crowded boolean, words binary"
    ))
    cut = stage.read("cut")
    judged = _judged(cut.filter("NOT crowded"), window, shard_words).union(
        _judged_apart(cut.filter("crowded").dropDuplicates(list(PASSAGE)), stage, window, shard_words)
    )
    stage.write("judged", judged)
    # Equal passages meet the one judgement of them; only windows held earlier go on.
    found = anchored.join(stage.read("judged"), list(PASSAGE)).select(
        "key", "mark",
        F.expr("filter(transform(firsts, (f, i) -> if(f < key, start + i, NULL)), s -> s IS NOT NULL)")
        .alias("starts"),
    ).filter(F.size("starts") > 0)
    return found.groupBy("key", "mark").agg(F.flatten(F.collect_set("starts")).alias("starts"))


# -- texts


def spans_of(starts: Sequence[int], window: int) -> list[list[int]]:
    """Maximal runs of words that the windows cover."""
    spans: list[list[int]] = []
    for start in sorted(starts):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = start + window
        else:
            spans.append([start, start + window])
    return spans


def _kept(words: list[bytes], spans: list[list[int]]) -> bytes:
    if not spans:
        return b" ".join(words)
    edges = [0, *(e for s in spans for e in s), len(words)]
    return b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b])


CLEANED = "key long, n_words long, removed array<array<long>>, kept binary"


def _cleaned(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
    columns = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "n_words", "removed", "kept"]
    )


def _remove(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for key, data, starts in zip(*(column(batch, c) for c in ("key", "data", "starts"))):
                words, spans = data.split(), spans_of(starts or (), window)
                out.append((key, len(words), spans, _kept(words, spans)))
            yield _cleaned(out)

    return run


def _as_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    data = text_bytes(text)
    return docs.select(id_key(doc_id).alias("key"), text_mark(data).alias("mark"), data.alias("data"))


def _result(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        id_of("key").alias("doc_id"), "n_words", "removed", F.col("kept").cast("string").alias("kept")
    )


def remove_shared_passages(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    gram: int = GRAM, shard_words: int = SHARD_WORDS, crowded: int = CROWDED,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, removed`` (spans of words), ``kept`` (the other words,
    joined by single spaces).

    A word goes if ``window`` words in a row that cover it also stand in a document with a
    smaller ``doc_id``. Windows never cross documents and are judged on the input.

    The corpus is its own reference, so a broadcast of it has no bound. What it is searched for
    is therefore dealt out: a window belongs to its gram with the least hash, grams that one document
    alone holds fall away, and the different passages around the others are the reference
    shards, ``shard_words`` words and whole grams at a time. Each shard's suffix automaton knows the first
    document of every string in it; the shard's passages are streamed through, and documents take over
    the judgement of the passages they hold. A gram with more than ``crowded`` different passages is never
    gathered: its windows are dealt by their own hash and go the same way.

    A NULL or empty text has no words. Rows without ``doc_id`` come before all others and are one
    document, as are rows of one ``doc_id``: what these share among themselves stays. Other columns are
    not read; an empty table gives an empty result.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram must be part of a window")
    stage, rows = Stage(docs.sparkSession), _as_rows(docs, doc_id, text)
    stage.write("removed", removed_windows(
        rows, stage, window=window, gram=gram, shard_words=shard_words, crowded=crowded
    ))
    hit = rows.join(stage.read("removed"), ["key", "mark"], "left").select("key", "data", "starts")
    return _result(hit.mapInArrow(_remove(window), CLEANED))


def _stream_reference(shared, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for words in shared.value:
            automaton.add(words, 0)
        for batch in pieces(batches):
            out = []
            for key, mark, data in zip(*(column(batch, c) for c in ("key", "mark", "data"))):
                sizes = enumerate(automaton.stream(data.split(), window))
                starts = [i - window + 1 for i, (size, _) in sizes if size >= window]
                if starts:
                    out.append({"key": key, "mark": mark, "starts": starts})
            schema = [("key", pa.int64()), ("mark", pa.int64()), ("starts", pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(schema))

    return run


def remove_reference_passages(
    docs: DataFrame, reference: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    reference_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """As ``remove_shared_passages``, but a word goes if a window that covers it stands in
    ``reference``, a table of texts that is small against the documents.

    The reference goes in shards of about ``shard_words`` words; the suffix automaton of each is
    broadcast as its texts, and all documents stream through it, once per shard. An empty
    reference removes nothing.
    """
    spark, rows = docs.sparkSession, _as_rows(docs, doc_id, text)
    texts = reference.select(text_bytes(reference_text).alias("data")).distinct()
    n_words = F.regexp_count(F.col("data").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    n_shards = -(-(texts.agg(F.sum(n_words)).first()[0] or 0) // shard_words)
    found = spark.createDataFrame([], "key long, mark long, starts array<int>")
    for number in range(n_shards):
        shard = texts.filter(F.pmod(F.xxhash64("data"), F.lit(n_shards)) == number)
        shared = spark.sparkContext.broadcast([bytes(r.data).split() for r in shard.collect()])
        found = found.union(rows.mapInArrow(
            _stream_reference(shared, window), "key long, mark long, starts array<int>"
        ))
    starts = found.groupBy("key", "mark").agg(F.flatten(F.collect_set("starts")).alias("starts"))
    hit = rows.join(starts, ["key", "mark"], "left").select("key", "data", "starts")
    return _result(hit.mapInArrow(_remove(window), CLEANED))


def digest_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    lengths = F.transform("removed", lambda s: s[1] - s[0])
    n_removed = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b)
    return remove_shared_passages(docs).select(
        "doc_id", "n_words", n_removed.alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )
