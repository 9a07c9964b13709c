"""Near-duplicate documents by SimHash fingerprints a few bits apart."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeforge.llm.components import connected_components
from strikeforge.llm.shared import column, fresh, id_key, id_of, pieces, text_bytes
from strikeforge.sources.tables import Stage

BITS = 64
#: The seed of the shingle hash, XXH64.
SEED = 42
#: Distinct fingerprints that bit groups and candidate counts are estimated from.
SAMPLE = 1024
#: Members of one probed value that a task compares at once; larger ones are cut into cells.
CELL = 8192
#: Work of shuffling one probe, in comparisons.
PROBE_WORK = 8.0


# -- fingerprints


def fingerprint(data: bytes, shingle: int) -> int:
    """Each bit is 1 if it is set in over half of the hashes of the word shingles.

    Words are runs of non-space, A-Z lower-cased; shingles are joined by one space and
    count as often as they occur. Fewer words make one shingle, none make zero.
    """
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], ">u8")
    # Bits of many shingles are counted a part at a time.
    counts = np.zeros(BITS, "i8")
    for part in range(0, len(hashes), 65536):
        octets = hashes[part : part + 65536].view("u1").reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(0, dtype="i8")
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            marks = np.array([fingerprint(d, shingle) for d in column(batch, "data")], "u8")
            key = batch.column(batch.schema.get_field_index("key"))
            yield pa.RecordBatch.from_arrays([key, pa.array(marks.view("i8"))], ["key", "mark"])

    return run


# -- where to probe: bit groups and thresholds


@dataclass(frozen=True)
class Layout:
    """Bits in groups, and a sample of fingerprints to estimate candidates from."""

    groups: tuple[tuple[int, ...], ...]
    sample: np.ndarray
    scale: float
    distance: int

    def values(self, marks: np.ndarray) -> list[np.ndarray]:
        """What the bits of each group spell, one array per group."""
        return [
            sum(((marks >> np.uint64(b)) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(g))
            for g in self.groups
        ]

    def probes(self, group: int, threshold: int) -> int:
        return sum(comb(len(self.groups[group]), k) for k in range(threshold + 1))

    def work(self, marks: np.ndarray) -> np.ndarray:
        """Estimated work by group, threshold + 1 and fingerprint; no probe is no work."""
        steps = self.distance + 2
        work = np.zeros((len(self.groups), steps, len(marks)))
        known = self.values(self.sample)
        for g, own in enumerate(self.values(marks)):
            apart = np.bitwise_count(own[:, None] ^ known[g][None, :])
            for t in range(self.distance + 1):
                near = np.maximum((apart <= t).sum(1), 0.5) * self.scale
                work[g, t + 1] = near + PROBE_WORK * self.probes(g, t)
        return work

    def thresholds(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The threshold of each group for each fingerprint (-1: no probe), and the work.

        General pigeonhole: if the thresholds plus one sum to the distance plus one, every
        fingerprint within the distance is within its threshold in some group. Dynamic
        programming over the groups finds the cheapest such split.
        """
        work, total = self.work(marks), self.distance + 1
        best = np.full((total + 1, len(marks)), np.inf)
        best[0] = 0
        picked = np.zeros((len(self.groups), total + 1, len(marks)), "i1")
        for g in range(len(self.groups)):
            costs = np.full((total + 1, total + 1, len(marks)), np.inf)
            for used in range(total + 1):
                costs[used, used:] = best[: total + 1 - used] + work[g, used]
            picked[g], best = costs.argmin(0), costs.min(0)
        out, left, each = [], np.full(len(marks), total), np.arange(len(marks))
        for g in reversed(range(len(self.groups))):
            used = picked[g, left, each]
            out.append(used.astype("i8") - 1)
            left = left - used
        return np.array(out[::-1]), best[total]


def bit_groups(sample: np.ndarray, n_groups: int) -> tuple[tuple[int, ...], ...]:
    """Bits that vary together share a group, so that the groups' values are selective."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype="u8")) & np.uint64(1)).astype("f8")
    bits -= bits.mean(0)
    spread = np.sqrt((bits**2).sum(0))
    spread[spread == 0] = 1
    alike = np.abs(bits.T @ bits) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for width in (len(part) for part in np.array_split(np.arange(BITS), n_groups)):
        group = [min(free)]
        free.discard(group[0])
        while len(group) < width:
            bit = max(sorted(free), key=lambda b: alike[b, group].sum())
            group.append(bit)
            free.discard(bit)
        groups.append(tuple(sorted(group)))
    return tuple(groups)


def choose_layout(sample: np.ndarray, n_marks: int, distance: int) -> Layout:
    """The number of groups whose best thresholds cost the sample the least work."""
    layouts = [
        Layout(bit_groups(sample, n), sample, n_marks / len(sample), distance)
        for n in range(2, distance + 2)
    ] or [Layout(bit_groups(sample, 1), sample, n_marks / len(sample), distance)]
    return min(layouts, key=lambda x: x.thresholds(sample)[1].sum())


def _masks(width: int, threshold: int) -> np.ndarray:
    flips = [
        sum(1 << b for b in bits)
        for k in range(threshold + 1) for bits in combinations(range(width), k)
    ]
    return np.array(flips, "u8")


def _probe(layout: Layout):
    """``slot`` (group and value) of each fingerprint: its own in every group, and its probes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            marks = batch.column(0).to_numpy(zero_copy_only=False).view("u8")
            chosen, _ = layout.thresholds(marks)
            slots, owners = [], []
            for g, own in enumerate(layout.values(marks)):
                for t in np.unique(np.maximum(chosen[g], 0)):
                    rows = np.flatnonzero(np.maximum(chosen[g], 0) == t)
                    masks = _masks(len(layout.groups[g]), int(t))
                    for part in np.array_split(rows, 1 + len(rows) * len(masks) // 500_000):
                        values = own[part][:, None] ^ masks[None, :]
                        slots.append((values * np.uint64(len(layout.groups)) + np.uint64(g)).ravel())
                        owners.append(np.repeat(marks[part], len(masks)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(slots).view("i8")),
                 pa.array(np.concatenate(owners).view("i8"))],
                ["slot", "mark"],
            )

    return run


# -- comparing what meets


def _links_between(marks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Enough links within ``distance`` to connect whatever such links connect.

    Searches outwards from one member after another, so each is compared once with those
    that are still unconnected, and one link is made per member reached.
    """
    left, made = np.arange(len(marks)), ([], [])
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        here = queue.pop()
        near = np.bitwise_count(marks[left] ^ marks[here]) <= distance
        found = left[near]
        left = left[~near]
        queue.extend(found.tolist())
        made[0].append(np.full(len(found), here))
        made[1].append(found)
    return tuple(np.concatenate(m).astype("i8") if m else np.zeros(0, "i8") for m in made)


def _links_of(slots: np.ndarray, marks: np.ndarray, distance: int) -> np.ndarray:
    """Links among rows of equal slot; rows are sorted by slot."""
    heads = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
    sizes = np.diff(np.append(heads, len(slots)))
    pairs = []
    small = np.repeat(sizes <= 16, sizes)
    for step in range(1, 16):
        here = np.flatnonzero(small[:-step] & small[step:] & (slots[:-step] == slots[step:]))
        if not len(here):
            break
        near = here[np.bitwise_count(marks[here] ^ marks[here + step]) <= distance]
        pairs.append(np.stack([marks[near], marks[near + step]], 1))
    for head, size in zip(heads[sizes > 16], sizes[sizes > 16]):
        own = np.unique(marks[head : head + size])
        a, b = _links_between(own, distance)
        pairs.append(np.stack([own[a], own[b]], 1))
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), "u8")


def _verify(distance: int):
    """Streams rows sorted by slot; a slot that goes on in the next batch waits for it."""

    def links(slots: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        pairs = _links_of(slots, marks, distance).view("i8")
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, marks = np.zeros(0, "i8"), np.zeros(0, "u8")
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.get_field_index
            slots = np.concatenate((slots, batch.column(names("slot")).to_numpy()))
            marks = np.concatenate((marks, batch.column(names("mark")).to_numpy().view("u8")))
            whole = int(np.searchsorted(slots, slots[-1]))
            if whole:
                yield links(slots[:whole], marks[:whole])
                slots, marks = slots[whole:], marks[whole:]
        if len(slots):
            yield links(slots, marks)

    return run


def _cells(rows: DataFrame, cell: int) -> DataFrame:
    """Rows with a slot of ``cell`` members at most: a larger one becomes a grid of cells.

    Members of a large slot are dealt into blocks, and each pair of blocks meets in a cell of
    its own, so every two members still meet. Slots are counted first, combined before
    the shuffle; there are few large ones.
    """
    counts = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    blocks = counts.select("slot", F.ceil(F.col("n") * 2 / cell).cast("long").alias("blocks"))
    dealt = rows.join(blocks, "slot", "left")
    block = F.pmod(F.xxhash64(F.lit("block"), "mark"), F.col("blocks"))
    met = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.xxhash64("slot", F.least(block, other), F.greatest(block, other)),
    )
    plain = dealt.filter("blocks IS NULL").select("slot", "mark")
    cut = dealt.filter("blocks IS NOT NULL").select(F.explode(met).alias("slot"), "mark")
    return plain.union(cut)


def link_fingerprints(marks: DataFrame, stage: Stage, distance: int, cell: int = CELL) -> DataFrame:
    """``a, b``: links that connect every two of the distinct ``mark`` within ``distance``.

    Fingerprints meet where one probes a value of the other's bits; the meeting is checked
    bit by bit. Links inside a slot are a spanning forest, never all pairs.
    """
    spark = marks.sparkSession
    order = F.xxhash64(F.lit("sample"), "mark")
    sample = [r[0] for r in marks.select("mark").orderBy(order, "mark").limit(SAMPLE).collect()]
    if len(sample) < 2:
        return spark.createDataFrame([], "a long, b long")
    layout = choose_layout(np.array(sample, "i8").view("u8"), marks.count(), distance)
    rows = marks.select("mark").mapInArrow(_probe(layout), "slot long, mark long")
    stage.write("probes", rows)
    met = _cells(stage.read("probes"), cell).repartition("slot").sortWithinPartitions("slot", "mark")
    return met.mapInArrow(_verify(distance), "a long, b long")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
    distance: int = 3, cell: int = CELL,
) -> DataFrame:
    """``key, mark, component`` per input row: its id key, its fingerprint, its group's least key.

    Fingerprints at most ``distance`` bits apart are linked, and ``component`` is the
    smallest id reachable over links. Exact copies, and all documents with one fingerprint,
    are one node before anything is compared; the nodes are then probed and checked.

    A NULL text is empty; texts without words have fingerprint zero and are linked like any
    other. Rows without ``doc_id`` take part with a key below all ids, but a component is named
    after the least real id it has (NULL if none). Repeated rows are all returned.
    An empty table gives an empty result. Other columns are not read.
    """
    stage = Stage(docs.sparkSession)
    rows = docs.select(id_key(doc_id).alias("key"), text_bytes(text).alias("data"))
    stage.write("marks", rows.mapInArrow(_fingerprints(shingle), "key long, mark long"))
    marked = stage.read("marks")
    named = marked.groupBy("mark").agg(F.min(id_of("key")).alias("least"))
    stage.write("nodes", named)
    nodes = stage.read("nodes")
    stage.write("links", link_fingerprints(nodes, stage, distance, cell))
    groups = connected_components(stage.read("links"), stage)
    grouped = nodes.join(groups, F.col("mark") == F.col("node"), "left").select(
        "mark", "least", F.coalesce("component", "mark").alias("root")
    )
    names = grouped.groupBy("root").agg(F.min("least").alias("component"))
    named = grouped.join(names, "root").select("mark", "component")
    return marked.join(named, "mark").select("key", "mark", "component")


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    return near_duplicates(docs).select(
        id_of("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each group the one with the smallest id stays.

    Rows that share a ``doc_id``, or have none, stay or go together: they stay if one of them
    is the least of its group (for rows without: if one of them has no near duplicate with an id).
    """
    stays = near_duplicates(docs).filter(F.col("component").eqNullSafe(id_of("key")))
    own = fresh("key", docs)
    stays = stays.select(F.col("key").alias(own)).distinct()
    return docs.join(stays, id_key() == F.col(own), "left_semi")
