"""The whole decontamination against brute force, short items, odd and empty tables."""

from __future__ import annotations

import random
import re

import pytest

from strikeforge.llm import decontaminate

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def longest_tiles(item, doc, least):
    """Greedy string tiling by trying every pair of starts."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = (0,)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while (
                    a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n]
                    and a + n not in used_a and b + n not in used_b
                ):
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < least:
            return sum(tiles)
        n, a, b = best
        used_a |= set(range(a, a + n))
        used_b |= set(range(b, b + n))
        tiles.append(n)


def words(text):
    return re.findall(r"\w+", (text or "").lower())


@pytest.mark.parametrize("seed,block_chars", [(1, 8_000_000), (2, 120)])
def test_query_equals_brute_force(spark, seed, block_chars):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, rng.choices(vocabulary, k=rng.randrange(5, 20))) for i in range(8)]
    docs = []
    for d in range(40):
        text = rng.choices(vocabulary, k=rng.randrange(0, 30))
        if d % 2:
            own = list(rng.choice(items)[1])
            cut = rng.randrange(1, len(own))
            own = own[cut:] + own[:cut] if d % 4 == 1 else own[:cut]
            text[len(text) // 2 : len(text) // 2] = own
        docs.append((d, " ".join(text)))
    found = decontaminate.find_contamination(
        spark.createDataFrame(docs, DOCS),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEMS),
        block_chars=block_chars,
    )
    expected = {}
    for d, text in docs:
        for i, item in items:
            matched = longest_tiles(item, words(text), 5)
            if matched >= 0.6 * len(item):
                expected[d, i] = (len(item), matched)
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_matched) for r in found.collect()}
    assert got == expected and expected


def test_common_short_items_remove_nothing(spark):
    passage = "seven words that stand in one document"
    rows = [(i, f"filler{i} two more") for i in range(20)] + [(50, passage), (51, "just gleam here")]
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(1, "two"), (2, passage), (3, "gleam"), (None, "more")], ITEMS)
    assert decontaminate.find_contamination(docs, items).filter("item_id = 1").count() == 20
    kept = {r.doc_id for r in decontaminate.without_contamination(docs, items).collect()}
    assert kept == set(range(20))
    kept = decontaminate.without_contamination(docs, items, max_share=1.0)
    assert kept.count() == 0


def test_odd_and_empty_tables(spark):
    long = "many words of no item " * 30_000 + "here is the whole benchmark item text"
    rows = [(1, None), (2, ""), (3, long), (3, "a copy of the id"), (None, "no id"), (None, "no id"), (7, " \n ")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS key", "1 AS item_id", "2 AS held")
    items = spark.createDataFrame(
        [(1, "here is the whole benchmark item text"), (1, "here is the whole benchmark item text"),
         (2, None), (None, ""), (3, "...")], ITEMS,
    )
    kept = decontaminate.without_contamination(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 7]
    assert decontaminate.without_contamination(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.without_contamination(docs.limit(0), items).count() == 0
