"""Benchmark items that documents hold, passage by passage, in whatever order."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeforge.llm.shared import column, fresh, id_key, id_of, pieces
from strikeforge.sources.tables import Stage

#: Tokens of the shortest passage that counts, and of a seed.
MIN_MATCH = 5
#: Share of an item's tokens that a document's passages must cover.
MIN_COVERAGE = 0.6
#: Characters of benchmark text that are compared with all documents at once.
BLOCK_CHARS = 8_000_000
#: Share of all documents that may hold a short item before it says nothing.
SHORT_SHARE = 0.001
FOUND = "key long, item_id long, coverage double, n_tokens int, n_matched int, tiles array<array<int>>"

#: Scripts written without spaces: Thai to Tibetan, Myanmar, Khmer, kana, Han and its extensions.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff" \
    "\uf900-\ufaff\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
_BASE = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; single characters of unspaced scripts."""
    return _TOKEN.findall(text.lower()) if text else []


# -- rolling Karp-Rabin hashes


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _BASE)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def prefix_hashes(ids: np.ndarray) -> np.ndarray:
    """``h[i] * base ** -i`` style sums from which any window's hash follows in one step."""
    terms = (ids.astype("u8") + np.uint64(1)) * _powers(max(len(ids), 1))[: len(ids)]
    return np.concatenate((np.zeros(1, "u8"), np.cumsum(terms, dtype="u8")))


def window_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows, moved to a common power so that equal windows agree."""
    n = len(prefix) - 1
    if n < width:
        return np.zeros(0, "u8")
    return (prefix[width:] - prefix[: n - width + 1]) * _powers(n)[::-1][: n - width + 1]


# -- greedy string tiling


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows without a marked token."""
    taken = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(taken[width:] == taken[: len(marked) - width + 1])


def _meet(item: np.ndarray, doc: np.ndarray, used: tuple[np.ndarray, np.ndarray], width: int):
    """Free windows of the item and the document with equal hashes, and the hashes."""
    if width > min(len(item), len(doc)):
        return (np.zeros(0, "i8"),) * 2 + (np.zeros(0, "u8"),) * 2
    size = max(len(item), len(doc))
    pad = lambda ids: np.concatenate((ids, np.zeros(size - len(ids), ids.dtype)))
    hashes = [
        window_hashes(prefix_hashes(pad(ids)), width)[: len(ids) - width + 1] for ids in (item, doc)
    ]
    at = [_free(u, width) for u in used]
    own = [h[a] for h, a in zip(hashes, at)]
    both = np.intersect1d(*own)
    keep = [np.isin(o, both) for o in own]
    return at[0][keep[0]], at[1][keep[1]], own[0][keep[0]], own[1][keep[1]]


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item start, doc start, length)`` of passages, the longest first.

    Repeatedly finds the longest length at which free windows of both meet, by running
    Karp-Rabin hashes of every window of a length, and marks all passages of that length, from
    the item's start on. A token is marked once on either side. Negative ids match nothing.
    """
    used = (item < 0, doc < 0)
    used = (used[0].copy(), used[1].copy())
    tiles, longest = [], min(len(item), len(doc))
    while longest >= min_match:
        low, high = min_match - 1, longest
        while low < high:  # a free match of one length holds free matches of all shorter ones
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(_meet(item, doc, used, middle)[0]) else (low, middle - 1)
        longest = low
        if longest < min_match:
            break
        starts, places, hashes, doc_hashes = _meet(item, doc, used, longest)
        waiting = defaultdict(list)
        for place, value in zip(places[::-1].tolist(), doc_hashes[::-1].tolist()):
            waiting[value].append(place)
        done = len(tiles)
        for start, value in zip(starts.tolist(), hashes.tolist()):
            if used[0][start : start + longest].any():
                continue
            line = waiting[value]
            while line:
                place = line.pop()
                window = slice(place, place + longest)
                if not used[1][window].any() and (
                    item[start : start + longest] == doc[window]
                ).all():
                    used[0][start : start + longest] = used[1][window] = True
                    tiles.append((start, place, longest))
                    break
        if len(tiles) == done:  # equal hashes of unequal windows
            longest -= 1
    return tiles


# -- a block of the benchmark against documents


@dataclass
class Block:
    """Items of bounded size, with their seeds: windows of ``min_match`` tokens.

    ``short`` has, by number of tokens, the items that are shorter: sorted hashes and items.
    """

    ids: list[int]
    items: list[np.ndarray]
    words: dict[str, int]
    seeds: np.ndarray
    owners: np.ndarray
    starts: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], min_match: int) -> Block:
        words: dict[str, int] = {}
        ids, items = [], []
        for item_id, text in rows:
            item = np.array([words.setdefault(t, len(words)) for t in tokens(text)], "i8")
            if len(item):
                ids.append(item_id)
                items.append(item)
        seeds = [seed_hashes(x, min_match) for x in items]
        flat = np.concatenate(seeds) if seeds else np.zeros(0, "u8")
        owners = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        starts = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else flat.astype("i8")
        order = np.argsort(flat, kind="stable")
        short = {}
        for width in range(1, min_match):
            own = np.array([n for n, x in enumerate(items) if len(x) == width], "i8")
            if len(own):
                hashes = np.concatenate([seed_hashes(items[n], width) for n in own])
                by_hash = np.argsort(hashes, kind="stable")
                short[width] = hashes[by_hash], own[by_hash]
        return cls(ids, items, words, flat[order], owners[order], starts[order], short)


def seed_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    if len(ids) < width:
        return np.zeros(0, "u8")
    value = np.zeros(len(ids) - width + 1, "u8")
    for k in range(width):
        value = value * _BASE + ids[k : len(ids) - width + 1 + k].astype("u8") + np.uint64(1)
    return value


def find_items(text: str | None, block: Block, min_match: int, min_coverage: float) -> list[tuple]:
    """Items a text holds: ``(item number, matched tokens, tiles)``.

    Tokens no item has, and windows with one, are left out before seeds are looked up. An
    item goes on to the tiling only if the tokens its seeds cover could reach the threshold.
    Items of fewer than ``min_match`` tokens are found where all their tokens stand in a row.
    """
    get = block.words.get
    ids = np.array([get(t, -1) for t in tokens(text)], "i8")
    return _find_short(ids, block) + _find_long(ids, block, min_match, min_coverage)


def _find_short(ids: np.ndarray, block: Block) -> list[tuple]:
    found = []
    for width, (hashes, numbers) in block.short.items():
        values, places = np.unique(seed_hashes(ids, width), return_index=True)
        low, high = (np.searchsorted(hashes, values, side) for side in ("left", "right"))
        for k in np.flatnonzero(high > low).tolist():
            window = ids[places[k] : places[k] + width]
            for number in numbers[low[k] : high[k]].tolist():
                if (block.items[number] == window).all():
                    found.append((number, width, [[0, int(places[k]), width]]))
    return found


def _find_long(ids: np.ndarray, block: Block, min_match: int, min_coverage: float) -> list[tuple]:
    if len(ids) < min_match or not len(block.seeds):
        return []
    values = seed_hashes(ids, min_match)
    first = np.searchsorted(block.seeds, values)
    first[first == len(block.seeds)] = 0
    gap = np.concatenate(([0], np.cumsum(ids < 0)))
    hit = np.flatnonzero(
        (block.seeds[first] == values) & (gap[min_match:] == gap[: len(ids) - min_match + 1])
    )
    if not len(hit):
        return []
    # Which tokens of which items the distinct seeds cover.
    seen = np.unique(values[hit])
    low, high = (np.searchsorted(block.seeds, seen, side) for side in ("left", "right"))
    rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
    near = np.zeros(len(ids) + 1, "i8")
    np.add.at(near, hit, 1)
    np.add.at(near, hit + min_match, -1)
    near = np.cumsum(near[:-1]) > 0
    # The document without tokens that no seed covers; one gap is left in their place.
    edge = np.flatnonzero(near | np.concatenate(([False], near[:-1])))
    doc = np.where(near, ids, -1)[edge]
    found = []
    by_item = np.argsort(block.owners[rows], kind="stable")
    rows = rows[by_item]
    owners = block.owners[rows]
    for part in np.split(rows, np.flatnonzero(np.diff(owners)) + 1):
        number = int(block.owners[part[0]])
        item = block.items[number]
        covered = np.zeros(len(item), bool)
        for k in range(min_match):
            covered[block.starts[part] + k] = True
        if covered.sum() < min_coverage * len(item):
            continue
        tiles = tile(item, doc, min_match)
        matched = sum(t[2] for t in tiles)
        if matched >= min_coverage * len(item):
            found.append((number, matched, [[a, int(edge[b]), n] for a, b, n in tiles]))
    return found


def _search(shared, min_match: int, min_coverage: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in pieces(batches):
            out: list[tuple] = []
            for key, text in zip(column(batch, "key"), column(batch, "text")):
                for number, matched, tiles in find_items(text, block, min_match, min_coverage):
                    size = len(block.items[number])
                    out.append((key, block.ids[number], matched / size, size, matched, tiles))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(),
                     pa.list_(pa.list_(pa.int32()))]
            names = ["key", "item_id", "coverage", "n_tokens", "n_matched", "tiles"]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names
            )

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list]:
    """Items in blocks of about ``block_chars`` characters, read one block at a time."""
    items = benchmark.select(
        id_key(item_id).alias("item"), F.col(text).alias("text"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("size"),
    ).filter("size > 0").distinct()
    total = items.agg(F.sum("size")).first()[0]
    n_blocks = -(-(total or 0) // block_chars)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(n_blocks, 1)))
    for number in range(n_blocks):
        yield [tuple(r) for r in items.filter(block == number).select("item", "text").collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
    min_coverage: float = MIN_COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and benchmark item it holds.

    ``doc_id, item_id, coverage`` (share of the item's tokens in passages), ``n_tokens,
    n_matched, tiles`` (item start, document start, length, in tokens; the longest first).

    Tokens are lower-cased words, or characters (see below). Windows of ``min_match`` tokens that both share are the seeds;
    greedy string tiling then marks non-overlapping passages, so a passage may be cut and its
    parts reordered, but no part counts twice. The benchmark is the query set: it is held
    against all documents in blocks of ``block_chars`` characters, each a broadcast of that
    size, and no document is shuffled.

    Every character of a script without spaces is a token. Items with fewer than ``min_match``
    tokens match where they stand as a whole. NULL texts and texts without tokens match nothing. Repeated
    benchmark rows count once; of rows with one ``item_id`` the best covered is returned, also for
    repeated ``doc_id``. Rows without ``doc_id`` are returned as one document without id.
    Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key(doc_id).alias("key"), F.col(text).alias("text"))
    share = spark.sparkContext.broadcast
    parts = [
        rows.mapInArrow(_search(share(Block.of(b, min_match)), min_match, min_coverage), FOUND)
        for b in _blocks(benchmark, item_id, item_text, block_chars)
    ]
    if not parts:
        parts = [spark.createDataFrame([], FOUND)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    best = Window.partitionBy("key", "item_id").orderBy(F.desc("coverage"), "tiles")
    found = found.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    made = ["coverage", "n_tokens", "n_matched", "tiles"]
    return found.select(id_of("key").alias("doc_id"), id_of("item_id").alias("item_id"), *made)


def without_contamination(
    docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH,
    max_share: float = SHORT_SHARE, **options,
) -> DataFrame:
    """The documents that hold no benchmark item; rows of one ``doc_id`` go together.

    An item of fewer than ``min_match`` tokens is a short answer that any text may hold. It counts
    only where it is rare: in one document, or in ``max_share`` of all at most.
    ``find_contamination`` reports every hit.
    """
    stage = Stage(docs.sparkSession)
    found = find_contamination(docs, benchmark, min_match=min_match, **options)
    stage.write("found", found.select(id_key().alias("key"), "item_id", "n_tokens"))
    found = stage.read("found")
    short = found.filter(F.col("n_tokens") < min_match)
    held = short.groupBy("item_id").agg(F.count_distinct("key").alias("held"))
    allowed = max(1.0, docs.count() * max_share)
    common = held.filter(F.col("held") > allowed).select(F.col("item_id").alias("common"))
    told = short.join(common, F.col("item_id").eqNullSafe(F.col("common")), "left_anti")
    told = told.union(found.filter(F.col("n_tokens") >= min_match))
    own = fresh("key", docs)
    gone = told.select(F.col("key").alias(own)).distinct()
    return docs.join(gone, id_key(options.get("doc_id", "doc_id")) == F.col(own), "left_anti")
