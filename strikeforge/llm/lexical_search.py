"""Items ranked against documents: an automaton of their terms counts straight in the texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeforge.llm.shared import column, id_key, id_of, pieces, text_bytes

#: Characters of item text whose terms make one automaton; each block reads the documents twice.
BLOCK_CHARS = 1_000_000
TOP = 10
#: Scored rows that a task holds before it keeps only the best of each item.
HELD_ROWS = 1 << 20
#: Groups of documents that are ranked by themselves before an item's best are.
SALTS = 64

_GAP = b" "
#: A-Z lower-cased; ASCII characters that no term has become gaps; other bytes stay.
_SPELLING = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else _GAP[0] for b in range(128)
) + bytes(range(128, 256))

# Rows of the first scan that are no document frequencies.
DOCUMENTS, TERMS = -1, -2


def spell(data: bytes) -> bytes:
    """A text as its terms between single bytes of gap, with a gap at both ends."""
    return _GAP + data.translate(_SPELLING) + _GAP


def count_terms(spelled: bytes) -> int:
    gap = np.frombuffer(spelled, "u1") == _GAP[0]
    return int(np.count_nonzero(gap[:-1] & ~gap[1:]))


@dataclass
class Block:
    """Items of bounded size: their distinct terms, and which items each term belongs to."""

    ids: list[int]
    terms: list[bytes]
    starts: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[tuple[int, bytes]]) -> Block:
        found: dict[int, set[bytes]] = {}
        for item, data in rows:
            found.setdefault(item, set()).update(spell(data).split())
        ids = sorted(i for i, terms in found.items() if terms)
        holders: dict[bytes, list[int]] = {}
        for number, item in enumerate(ids):
            for term in found[item]:
                holders.setdefault(term, []).append(number)
        terms = sorted(holders)
        sizes = [len(holders[t]) for t in terms]
        owners = [n for t in terms for n in holders[t]]
        return cls(ids, terms, np.cumsum([0, *sizes]), np.array(owners, "i8"))

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Every term with a gap on both sides, so that no part of a longer term matches."""
        made = ahocorasick.Automaton()
        for number, term in enumerate(self.terms):
            made.add_word((_GAP + term + _GAP).decode("latin-1"), number)
        made.make_automaton()
        return made

    def count(self, spelled: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the block in a text, and how often each occurs."""
        hits = Counter([n for _, n in self.automaton.iter(spelled.decode("latin-1"))])
        return np.fromiter(hits.keys(), "i8", len(hits)), np.fromiter(hits.values(), "i8", len(hits))


def _frequencies(shared):
    """First scan: per task the documents and terms there are, and the documents of each term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        holders = np.zeros(len(block.terms), "i8")
        documents = terms = 0
        for batch in pieces(batches):
            for data in column(batch, "data"):
                spelled = spell(data)
                n = count_terms(spelled)
                documents, terms = documents + (n > 0), terms + n
                holders[block.count(spelled)[0]] += 1
        held = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, [DOCUMENTS, TERMS])),
             pa.array(np.append(holders[held], [documents, terms]))], ["term", "n"],
        )

    return run


def term_weights(documents: int, holders: np.ndarray) -> np.ndarray:
    return np.array([
        math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in holders.tolist()
    ], "i8")


def score_items(
    block: Block, weights: np.ndarray, terms: np.ndarray, times: np.ndarray, length_norm: int
) -> tuple[np.ndarray, np.ndarray]:
    """Items with a score above 0 for one document, and their scores."""
    gained = weights[terms] * ((10**9 * times) // (1000 * times + 8 * length_norm))
    sizes = block.starts[terms + 1] - block.starts[terms]
    at = np.repeat(block.starts[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    scores = np.zeros(len(block.ids), "i8")
    np.add.at(scores, block.owners[at], np.repeat(gained, sizes))
    items = np.flatnonzero(scores)
    return items, scores[items]


def _best(table: np.ndarray, top: int) -> np.ndarray:
    """Of ``item, score, key`` columns the ``top`` best of each item."""
    table = table[:, np.lexsort((table[2], -table[1], table[0]))]
    fresh = np.flatnonzero(np.diff(table[0], prepend=-1))
    place = np.arange(table.shape[1]) - np.repeat(fresh, np.diff(np.append(fresh, table.shape[1])))
    return table[:, place < top]


def _ranked(shared, figures, top: int):
    """Second scan: per task the best documents of each item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        documents, terms, weights = figures.value
        least = np.ones(len(block.ids), "i8")  # the score an item's list can still be entered with
        held, n_held = [np.zeros((3, 0), "i8")], 0

        def settle() -> None:
            nonlocal held, n_held
            kept = _best(np.concatenate(held, axis=1), top)
            held, n_held = [kept], 0
            items, n = np.unique(kept[0], return_counts=True)
            last = np.cumsum(n) - 1
            least[items[n == top]] = kept[1][last[n == top]]

        for batch in pieces(batches):
            for key, data in zip(column(batch, "key"), column(batch, "data")):
                spelled = spell(data)
                found, times = block.count(spelled)
                if not len(found):
                    continue
                norm = 100 - 90 + (90 * count_terms(spelled) * documents) // terms
                items, scores = score_items(block, weights, found, times, norm)
                enters = scores >= least[items]
                if enters.any():
                    own = np.stack([items[enters], scores[enters], np.full(enters.sum(), key)])
                    held.append(own)
                    n_held += own.shape[1]
                    if n_held >= HELD_ROWS:
                        settle()
        settle()
        item, score, key = held[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(block.ids, "i8")[item]), pa.array(key), pa.array(score)],
            ["item", "key", "score"],
        )

    return run


def _blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list]:
    """Items in blocks of about ``block_chars`` characters, one after the other."""
    rows = items.select(id_key(item_id).alias("item"), text_bytes(text).alias("data")).distinct()
    total = rows.agg(F.sum(F.octet_length("data").cast("long"))).first()[0]
    n_blocks = -(-(total or 0) // block_chars)
    block = F.pmod(F.xxhash64("item"), F.lit(max(n_blocks, 1)))
    for number in range(n_blocks):
        yield [(r.item, bytes(r.data)) for r in rows.filter(block == number).collect()]


def rank_documents(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", top: int = TOP,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. An
    automaton of all item terms, each between gaps, is broadcast and counts them in the whole
    texts; there is no index of documents and no document is shuffled. A first scan sums up the
    documents that hold each term, a second scores and keeps the best of each item in its task.
    Items are the query set: they go in blocks of about ``block_chars`` bytes, which bound the
    automaton, and each block makes these two scans.

    A term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))``; a document adds the weight times its
    damped count, its length against the mean taken into account. Equal scores go by ascending
    ``doc_id``, a missing one first. NULL and empty texts have no terms and are not counted
    as documents. Every row is a document of its own, also where a ``doc_id`` repeats; rows of one
    ``item_id`` are one item with the terms of all, rows without one another. Other columns are not
    read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key(doc_id).alias("key"), text_bytes(text).alias("data"))
    share = spark.sparkContext.broadcast
    parts = []
    for own in _blocks(items, item_id, item_text, block_chars):
        block = Block.of(own)
        if not block.ids:
            continue
        shared = share(block)
        counted = rows.select("data").mapInArrow(_frequencies(shared), "term long, n long")
        sums = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        holders = np.array([sums.get(t, 0) for t in range(len(block.terms))], "i8")
        documents, terms = sums.get(DOCUMENTS, 0), sums.get(TERMS, 0)
        if documents:
            figures = share((documents, terms, term_weights(documents, holders)))
            parts.append(rows.mapInArrow(_ranked(shared, figures, top), "item long, key long, score long"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = parts[0]
    for part in parts[1:]:
        best = best.union(part)
    order = (F.desc("score"), F.asc("key"))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    for by in ([F.col("item"), salt], [F.col("item")]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        best = best.withColumn("rank", place).filter(F.col("rank") <= top)
    return best.select(
        id_of("item").alias("item_id"), "rank", id_of("key").alias("doc_id"), "score"
    )
