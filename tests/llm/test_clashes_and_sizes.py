"""Input columns named like inner ones, and texts with very many matches."""

from __future__ import annotations

import random
import re
import time

import pytest

from strikeforge.llm import decontaminate, line_dedup, mixing, secret_scan, simhash, toxicity, url_filter
from strikeforge.llm.queries import SCHEDULES, URL_RULES

#: Names that operators use inside, and the ones they start from.
INNER = ("key", "_key", "_", "__", "_s", "_source", "_size", "_of", "_n", "_order", "_bucket", "_b", "_before",
         "_first", "_segments", "_url", "_hash", "own", "row", "data", "no", "found", "held", "kept", "words", "bucket")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"word{k}" for k in range(200)], k=30)) + "\nthis very line is in all of them",
             "en", f"s{i % 3}", 9) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0", 9), (None, None, None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in INNER))


def same_rows(before, after, but=()):
    """Every row that is left still has what it had."""
    names = [c for c in before.columns if c not in but]
    had = {r.doc_id: tuple(r[c] for c in names) for r in before.collect()}
    rows = after.collect()
    assert rows and all(tuple(r[c] for c in names) == had[r.doc_id] for r in rows)


def test_stages_pass_clashing_columns_on(spark, docs):
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "never to be found in there")], "item_id long, text string") \
        .selectExpr("*", "'x' AS key", "'x' AS _")
    stages = [
        lambda d: toxicity.without_toxic(d, labels), line_dedup.without_shared_lines,
        simhash.one_of_each_group, lambda d: decontaminate.without_contamination(d, items),
    ]
    kept = docs
    for stage in stages:
        before, kept = kept, stage(kept)
        assert kept.columns == docs.columns
        same_rows(before, kept, ("text", "n_chars"))
    mixed = mixing.mix_sources(mixing.with_size(docs), SCHEDULES)
    assert mixed.columns[: len(docs.columns)] == docs.columns and mixed.count() == 42
    same_rows(docs, mixed)
    takes = mixing.training_order(mixed)
    assert len(set(takes.columns)) == len(takes.columns)
    assert takes.agg({"words": "sum"}).first()[0] == mixed.agg({"taken": "sum"}).first()[0]
    scanned = secret_scan.scan_secrets(docs)
    assert scanned.count() == 42
    same_rows(docs, scanned, ("text",))


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/ads/{i}") for i in range(9)] + [(9, None)],
                                  "page_id long, url string")
    pages = pages.selectExpr("*", *(f"concat('{c}', page_id) AS `{c}`" for c in INNER))
    judged = url_filter.filter_urls(pages, URL_RULES)
    assert judged.count() == 10
    assert {r.verdict for r in judged.filter("page_id < 9").collect()} == {"block"}
    assert all(r[c] == f"{c}{r.page_id}" for r in judged.collect() for c in INNER)


def test_very_many_secrets_in_one_text(spark):
    n = 50_000
    text = " ".join(f"password=abc{i:07} ghp_{i:07}{'A1b2' * 7}" for i in range(n))
    docs = spark.createDataFrame([(1, text, "a"), (2, "token: abcdefg", "b")], "doc_id long, text string, source string")
    began = time.time()
    row = {r.doc_id: r for r in secret_scan.digest_secrets(docs).collect()}[1]
    assert time.time() - began < 60
    assign, provider = (re.compile(p) for p in (r"password=abc\d+", r"ghp_[A-Za-z0-9_-]{16,}"))
    assert row.n_assign == n
    spans = [("assign", m) for m in assign.finditer(text)] + [("provider", m) for m in provider.finditer(text)] \
        + [("opaque", m) for m in provider.finditer(text)]
    order = {"assign": 0, "provider": 3, "opaque": 5}
    spans.sort(key=lambda s: (s[1].start(), order[s[0]]))
    # An opaque value has no underscore: it begins behind that of the prefix, or is not one at all.
    found = [s for s in row.spans.split(",") if not s.startswith("opaque")]
    assert found == [f"{k}:{m.start()}:{m.end()}" for k, m in spans if k != "opaque"]


def test_added_spans_give_way_to_base_spans_only(spark):
    rng = random.Random(4)
    bits = ["password=", "token: ", "ghp_", "A1b2" * 6, "a1" * 14, " ", "bearer ", "x" * 20, "AKIA", "Z9" * 10, "é"]
    rows = [(i, "".join(rng.choices(bits, k=14)), f"s{i % 5}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in secret_scan.scan_secrets(docs).collect():
        base = [(s.start, s.stop) for s in r.spans if s.base]
        for s in r.spans:
            if not s.base:
                assert not any(a < s.stop and s.start < b for a, b in base)
    # One text alone: nothing is an example, so every added match that is free stays.
    for i, text, source in rows[:12]:
        one = spark.createDataFrame([(i, text, source)], docs.schema)
        spans = secret_scan.scan_secrets(one).first().spans
        got = {(s.kind, s.start, s.stop) for s in spans}
        base = [(s.start, s.stop) for s in spans if s.base]
        for kind in (k for k in secret_scan.KINDS if not k.base):
            for m in re.finditer(kind.pattern, text):
                free = not any(a < m.end() and m.start() < b for a, b in base)
                assert ((kind.name, m.start(), m.end()) in got) == free
