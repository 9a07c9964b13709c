"""Operators against brute force, and the cases every operator must bear."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strikeforge.llm import (
    decontaminate, line_dedup, lm_score, mixing, repeats, secret_scan, simhash, topk, toxicity,
    url_filter,
)
from strikeforge.llm.queries import QUERIES, SCHEDULES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) with a column that clashes with what operators make."""
    return spark.createDataFrame(
        [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


ODD = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"),
       (None, "no id but words"), (4, "long " * 30_000), (5, "one two three four five six")]


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, texts):
    marks = {d: brute_fingerprint(t) for d, t in texts.items()}
    ids = sorted(marks)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if (marks[a] ^ marks[b]).bit_count() <= 3]
    expected = components(links, ids)
    found = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, SF).collect()}
    assert {d: r.component_id for d, r in found.items()} == expected
    assert {d: int(r.fingerprint, 16) for d, r in found.items()} == marks


@pytest.mark.parametrize("cell", [8, simhash.CELL])
def test_links_of_random_fingerprints(spark, cell):
    """A crowded neighbourhood, cut into cells or not, connects like all pairs do."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype="u8")
    marks = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            flips = rng.integers(0, 64, rng.integers(1, 6))
            marks.add(int(b ^ np.bitwise_xor.reduce(np.uint64(1) << flips.astype("u8"))))
    signed = [int(np.uint64(m).view("i8")) for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "mark long")
    from strikeforge.sources.tables import Stage
    edges = [(r.a, r.b) for r in simhash.link_fingerprints(df, Stage(spark), 3, cell).collect()]
    near = lambda a, b: (a & (2**64 - 1) ^ b & (2**64 - 1)).bit_count() <= 3
    assert all(near(a, b) for a, b in edges)
    every = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if near(a, b)]
    assert components(edges, signed) == components(every, signed)


def test_secrets_equal_brute_force(spark, texts):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                              r"([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]
    texts = dict(texts) | {10**6: "secret: token: abcdef é token = 'abc/def' " * 300, 10**6 + 1: None}
    docs = documents(spark, [(d, t, f"s{d % 7}") for d, t in texts.items()])
    for row in secret_scan.digest_secrets(docs).collect():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds)
                       for m in p.finditer(texts[row.doc_id] or "") if len(m[g]) >= least)
        listed = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        counts = Counter(k for _, k, _ in spans)
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(counts[k] for k in range(3))
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))


def test_widely_copied_candidates_are_examples(spark):
    own, copied = "ghp_" + "A1b2" * 8, "ghp_" + "Zz9y" * 8
    rows = [(1, f"x {own} y", "a"), (2, f"{copied}", "a"), (3, f"{copied}", "b")]
    found = {r.doc_id: r.spans for r in secret_scan.digest_secrets(documents(spark, rows)).collect()}
    end = 2 + len(own)
    assert found == {1: f"provider:2:{end},opaque:2:{end}", 2: "", 3: ""}


def test_examples_are_told_by_owners_and_texts(spark):
    token = lambda i: f"ghp_{i:04d}" + "A1b2" * 7
    own = [(i, f"own {i} {token(i)}", f"s{i % 9}") for i in range(40)]
    exact = [(100 + i, f"copied {token(100)}", f"s{i}") for i in range(2)]
    near = [(110 + i, f"copied {i} nearly {token(110)}", f"s{i}") for i in range(2)]
    spread = [(200 + i, f"text {i} says {token(200)}", f"s{i % 8}") for i in range(12)]
    inside = [(1000 + i, f"text {i} has {token(300)}", "s3") for i in range(1000)]
    one_text = [(3000 + i, f"one text {token(400)}", "s4") for i in range(1000)]
    rows = own + exact + near + spread + inside + one_text
    found = {r.doc_id: [(s.kind, s.live) for s in r.spans]
             for r in secret_scan.scan_secrets(documents(spark, rows)).collect()}
    for i, _, _ in own + exact + near + one_text:
        assert found[i] == [("provider", True), ("opaque", True)], i
    for i, _, _ in spread + inside:
        assert found[i] == [], i


def test_language_model_base_equals_brute_force(spark, texts):
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + ["\n"]
              for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for common in (50, 10**6):
        logs, n_bytes = 0.0, 0
        for r in lm_score.score_texts(docs, common_tokens=common).collect():
            own = tokens[r.doc_id]
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
            assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), n)
            assert r.n_known == sum(counts[w] > 0 for w in own)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert r.score < 0
            if r.held_out:
                logs, n_bytes = logs + r.score, n_bytes + len(" ".join(own).encode()) + 1
        # Far below what single bytes cost, on texts that taught nothing.
        octets = Counter(b for d, ws in tokens.items() if not held[d] for b in " ".join(ws).encode())
        total = sum(octets.values())
        single = -sum(c / total * math.log2(c / total) for c in octets.values())
        assert -logs / math.log10(2) / n_bytes < 0.75 * single


def test_bit_probabilities_sum_to_one(spark):
    model = lm_score.Model.untrained()
    import pyarrow as pa
    assert model.log10(pa.array(["ab"]))[0] == pytest.approx(-24 * math.log10(2), rel=1e-6)


def test_no_two_contexts_share_counts(spark):
    rng = random.Random(3)
    words = list({"head" * (i % 2) + "".join(rng.choices("abcdefgh", k=rng.randrange(3, 12)))
                  for i in range(20_000)})
    weights = np.array([rng.randrange(1, 4) for _ in words], float)
    tokens = spark.createDataFrame(list(zip(words, weights.astype(int).tolist())),
                                   "token string, n_train long")
    model = lm_score.train(tokens)
    import pyarrow as pa
    expected, events = [defaultdict(lambda: [0, 0]) for _ in range(lm_score.N_INPUTS)], []
    for word, n in zip(words, weights):
        spelled = f"{word} ".encode()
        for i, octet in enumerate(spelled):
            contexts = [spelled[max(0, i - k):i] + b"|" * (i < k) for k in lm_score.ORDERS]
            for place in range(8):
                node, bit = (octet | 256) >> (8 - place), octet >> (7 - place) & 1
                events.append([(c, node) for c in [*contexts, spelled[:i]]])
                for into, at in zip(expected, events[-1]):
                    into[at][0] += n * bit
                    into[at][1] += n
    chunks = list(model.chunks(pa.array(words), weights))
    for k in range(lm_score.N_INPUTS):
        ones, seen = (np.concatenate([c[3][k][i].ravel() for c in chunks]) for i in (0, 1))
        assert np.array_equal(np.stack([ones, seen], 1), np.array([expected[k][e[k]] for e in events]))
    # Dealt out over many tasks, every token costs what it costs when all are in one.
    price = dict(zip(words, model.log10(pa.array(words), weights)))
    lm_score_tasks = lm_score.TASK_TOKENS
    try:
        lm_score.TASK_TOKENS = 500
        parts = lm_score.dealt(tokens)
        assert parts.rdd.getNumPartitions() > 30
        shared = spark.sparkContext.broadcast(model)
        rows = parts.mapInArrow(lm_score._price(shared), "token string, n_train long, price double")
        assert {r.token: r.price for r in rows.collect()} == pytest.approx(price, rel=1e-12)
    finally:
        lm_score.TASK_TOKENS = lm_score_tasks


def test_scores_depend_on_the_words_before(spark):
    import pyarrow as pa
    texts = ["", "ab", "Ab \u00e9\u00e9 x \U0001f600 y", " zz  ab abc\u00e9e"]
    rows, heads, rests, sizes = lm_score.placed_tokens(pa.array(texts))
    assert list(zip(rows.tolist(), heads.to_pylist())) == [
        (0, "\t\n"), (1, "\tab"), (1, "ab \n"), (2, "\tab"), (2, "ab \u00e9\u00e9"), (2, "\u00e9 x"),
        (2, "x \U0001f600"), (2, " y"), (2, "y \n"), (3, "\tzz"), (3, "zz ab"), (3, "ab abc\u00e9"),
        (3, "\u00e9e \n")]
    assert [r.removeprefix("\r") for r in rests.to_pylist()] == [
        "\n", "ab", "\n", "ab", "\u00e9\u00e9", "x", "\U0001f600", "y", "\n", "zz", "ab", "abc\u00e9e", "\n"]
    assert sizes.tolist() == [1, 2, 1, 2, 4, 1, 4, 1, 1, 2, 2, 6, 1]
    # The model sees the bytes before a head; a head and a rest spell the token together, once.
    units = [b"\tab", b"zab ab", b" ab", b"x abcd"]
    spelling = lm_score.Spelling.of(pa.array([u.decode() for u in units] + ["\rabcdef", "\rab"]))
    assert spelling.octets.tobytes() == b"ab ab ab abcdef "[:13] + b"ef "
    assert spelling.place.tolist() == [0, 1, 2] * 3 + [0, 1, 2, 3, 4, 5, 6]
    for k, back in zip(spelling.keys, lm_score.ORDERS):
        for place in range(2):
            seen = [(u[:u.rindex(b"a") + place].replace(b"\t", b"")[-back:], place) for u in units]
            own = [k[np.flatnonzero((spelling.token == i) & (spelling.place == place))[0]] for i in range(4)]
            assert len({*own}) == len({*seen})
    # Words that follow each other in training cost less in this order than in any other.
    pairs = [("red", "kite"), ("old", "boat"), ("tin", "drum"), ("wet", "leaf")]
    rng = random.Random(5)
    docs = [(i, " ".join(w for _ in range(30) for w in rng.choice(pairs))) for i in range(400)]
    docs += [(1000 + i, t) for i, t in enumerate(["red kite old boat tin drum", "kite red boat old drum tin"])]
    scored = {r.doc_id: r for r in lm_score.score_texts(documents(spark, [(i, t, "s") for i, t in docs])).collect()}
    ordered, shuffled = scored[1000], scored[1001]
    assert ordered.base_score == pytest.approx(shuffled.base_score) and ordered.n_known == shuffled.n_known
    assert ordered.score > shuffled.score + 3
    for common in (0, 3):
        again = lm_score.score_texts(documents(spark, [(i, t, "s") for i, t in docs]), common_tokens=common)
        assert {r.doc_id: r.score for r in again.collect()} == pytest.approx({i: r.score for i, r in scored.items()})


def test_equal_contexts_are_predicted_once(monkeypatch):
    import pyarrow as pa
    heads = [f"{t} {h}" for t in ("zab", "yab", "ab", "xb") for h in ("kite", "kit", "drum", "dr")]
    rests = ["\r" + head + end for head in ("kite", "drum") for end in ("", "s", "sman", "smen", "like")]
    tokens, spelled = heads + rests, set()
    for token in tokens:
        tail, _, own = token.rpartition(" ") if token[0] != "\r" else ("", "", token[1:])
        for i, octet in list(enumerate(own + " "))[slice(0, 4) if tail else slice(4, None)]:
            spelled.add(((tail + " " + own[:i])[-4:] if tail else "", own[:i], octet))
    predicted, mix = [], lm_score.Model.mix
    monkeypatch.setattr(lm_score.Model, "mix", lambda self, inputs, gate: predicted.append(gate.shape) or mix(self, inputs, gate))
    model = lm_score.Model.untrained()
    together = model.log10(pa.array(tokens))
    assert sum(n for n, _ in predicted) == len(spelled) < sum(len(t) for t in tokens) / 2
    assert together == pytest.approx([model.log10(pa.array([t]))[0] for t in tokens])
    # One step per chunk of bytes, in which equal ones count by their tokens.
    predicted.clear()
    n_train = np.arange(1, len(tokens) + 1)
    shared = type("Shared", (), {"value": model})
    run, = lm_score._train(shared)([pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n_train)], ["token", "n_train"])])
    assert predicted == [(len(spelled), 8)]
    per_token = np.bincount(lm_score.Spelling.of(pa.array(tokens)).token, minlength=len(tokens))
    assert run["bits"][0].as_py() == 8 * (per_token * n_train).sum()


def test_tokens_of_a_batch_are_counted_in_one_row_each():
    import pyarrow as pa
    rng = random.Random(7)
    words = ["kite", "Kites", "d\u00e9j\u00e0", "\U0001f600\U0001f601", "x", "abcdef"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(9))) for _ in range(300)] + ["", " \t "]
    held = [rng.random() < 0.3 for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(held), pa.array(texts)], ["held", "text"])
    rows = [r for b in lm_score._count([batch]) for r in b.to_pylist()]
    expected = defaultdict(lambda: [0, 0])
    row, heads, rests, _ = lm_score.placed_tokens(pa.array(texts))
    for names in (heads, rests):
        for i, name in zip(row, names.to_pylist()):
            expected[name][0] += not held[i]
            expected[name][1] += 1
    assert sorted((r["token"], r["n_train"], r["n_all"]) for r in rows) == sorted((t, *n) for t, n in expected.items())


def test_reordered_passages_are_found(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    moved = " ".join(["x"] + words[20:] + ["y z"] + words[:20])
    docs = documents(spark, [(1, moved), (2, item.upper()), (3, " ".join(words[:15])), (4, None),
                             (9, " ".join(words[::-1])), (2, item.upper())])
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)],
                                  "item_id long, text string")
    for block in (10, 10**6):
        found = decontaminate.find_contamination(docs, bench, block_chars=block).collect()
        assert sorted((r.doc_id, r.item_id, r.coverage) for r in found) == [(1, 7, 1.0), (2, 7, 1.0)]
        assert {len(r.tiles) for r in found} == {1, 2}
    kept = decontaminate.without_contamination(docs.filter("text IS NOT NULL"), bench)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [3, 9]


def test_short_and_unspaced_items_are_found(spark):
    bench = spark.createDataFrame(
        [(1, "Treaty of Utrecht"), (2, "東京は日本の首都であり最大の都市です"), (3, "utrecht"), (4, "..."),
         (5, "日本 の"), (6, "treaty utrecht")], "item_id long, text string")
    docs = documents(spark, [
        (1, "signed as the treaty, of Utrecht!"), (2, "treaty of many, utrecht"),
        (3, "実は東京は日本の首都であり最大の都市ですと言う"), (4, "日本と中国の"), (5, ""), (6, None)])
    found = {(r.doc_id, r.item_id): (r.coverage, r.n_tokens, r.n_matched, r.tiles)
             for r in decontaminate.find_contamination(docs, bench).collect()}
    assert found == {
        (1, 1): (1.0, 3, 3, [[0, 3, 3]]), (1, 3): (1.0, 1, 1, [[0, 5, 1]]),
        (2, 3): (1.0, 1, 1, [[0, 3, 1]]), (3, 2): (1.0, 18, 18, [[0, 2, 18]]),
        (3, 5): (1.0, 3, 3, [[0, 5, 3]])}


def test_tiling_equals_plain_greedy_tiling():
    rng = random.Random(5)
    for _ in range(40):
        item = [rng.randrange(4) for _ in range(rng.randrange(5, 30))]
        doc = [rng.randrange(4) for _ in range(rng.randrange(5, 60))]
        tiles = decontaminate.tile(np.array(item), np.array(doc), 4)
        free = ([True] * len(item), [True] * len(doc))
        lengths = []
        for n in range(len(item), 3, -1):
            for a in range(len(item) - n + 1):
                for b in range(len(doc) - n + 1):
                    if (all(free[0][a:a + n]) and all(free[1][b:b + n])
                            and item[a:a + n] == doc[b:b + n]):
                        free[0][a:a + n] = free[1][b:b + n] = [False] * n
                        lengths.append(n)
        assert sorted(t[2] for t in tiles) == sorted(lengths)
        assert all(item[a:a + n] == doc[b:b + n] for a, b, n in tiles)


def brute_repeats(texts, length):
    seen, out = set(), {}
    for d in sorted(texts):
        data = texts[d].encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            if s in seen:
                gone[i:i + length] = [True] * length
            seen.add(s)
        out[d] = bytes(b for b, g in zip(data, gone) if not g)
    return out


@pytest.mark.parametrize("limits", [
    {}, {"index_bytes": 300, "gram_bytes": 900}, {"hot_rows": 1},
    {"hot_rows": 3, "index_bytes": 300, "gram_bytes": 900},
])
def test_repeats_equal_brute_force(spark, limits):
    rng = random.Random(11)
    shared = ["".join(rng.choices("abé \n", k=n)) for n in (40, 70, 150, 400)]
    texts = {d: "".join(rng.choice([*shared, "".join(rng.choices("abcdé", k=25)), "z" * 90])
                        for _ in range(rng.randrange(0, 9))) for d in range(60)}
    docs = documents(spark, list(texts.items()))
    expected = brute_repeats(texts, 60)
    for r in repeats.remove_repeats(docs, length=60, **limits).collect():
        assert bytes(r.kept) == expected[r.doc_id]
        assert r.n_bytes - len(r.kept) == sum(b - a for a, b in r.removed)


def test_threshold_search_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-9, 9, (500, 6))
    ids = rng.permutation(500)
    lists = topk.sorted_lists(vectors)
    for row in range(0, 500, 25):
        rows, scores = topk.threshold_search(vectors[row], ids[row], ids, vectors, lists, 5)
        every = vectors @ vectors[row]
        best = [i for i in np.lexsort((ids, -every)) if i != row][:5]
        assert ids[rows].tolist() == ids[best].tolist() and scores.tolist() == every[best].tolist()


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.5]), (50, None), (100, [float("nan"), 1.0]), (1, [0.5, None]), (2, [1.0, 1.0]),
            (2, [1.0, 1.0]), (3, [float("inf"), 0.0]), (4, [0.25]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.nearest(df).collect()] == [(0, 1, 2, 256 * 256 + 128 * 256)]
    assert topk.nearest(df.limit(0)).count() == 0


def test_mixture_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 80), rng.choices(["a", "b", "c", None], [60, 20, 15, 5])[0])
            for i in range(3000)]
    rows += rows[:5]
    sized = mixing.with_size(documents(spark, rows))
    found = mixing.mix_sources(sized, SCHEDULES).collect()
    assert len(found) == len(rows)
    taken, target, size = defaultdict(int), {}, {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= 3 * r.size
    for s in target:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * size[s]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    positions = [r.position for r in found if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    again = mixing.mix_sources(sized, SCHEDULES).select("doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in
                                             [type(again[0])(doc_id=r.doc_id, taken=r.taken) for r in found])
    takes = mixing.training_order(mixing.mix_sources(sized, SCHEDULES))
    assert takes.agg(F.sum("words")).first()[0] == sum(taken.values())


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x", "http://example.net/fr", "http://x.org/fr/1", "http://x.org",
            "http://EXAMPLE.com/de/", "http://notexample.com/de/", None, "", "no scheme", "http://b.net",
            "http://q.io/ads/1", "http://q.io/a?page=2&ref=x", "http://q.io/ads/1"]
    from strikeforge.llm.queries import URL_RULES
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)],
                                  "page_id long, url string, verdict string")
    found = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    assert found == {
        0: ("a.example.net", "example.net/en/", "allow"), 1: ("example.net", "net/", "block"),
        2: ("x.org", "org/fr/", "allow"), 3: ("x.org", None, "allow"),
        4: ("example.com", "example.com/de/", "block"), 5: ("notexample.com", None, "allow"),
        6: ("", None, "allow"), 7: ("", None, "allow"), 8: ("", None, "allow"),
        9: ("b.net", None, "allow"), 10: ("q.io", None, "block"), 11: ("q.io", None, "block"),
        12: ("q.io", None, "block")}
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def labelled(spark):
    rng = random.Random(9)
    calm, rude = [f"word{i}" for i in range(300)], ["vork", "zunge", "blarg"]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(calm, k=rng.randrange(5, 60))
        if i % 8 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "en", "isch"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 8 == 0)))
    return documents(spark, rows + [(9001, None), (9002, ""), (None, "word1"), (9001, None)]), \
        spark.createDataFrame([*labels, (5000, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    found = toxicity.digest_toxicity(docs, labels).collect()
    assert len(found) == 904
    right = [r.predicted == (r.doc_id % 8 == 0) for r in found
             if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id = 9001").count() == 2


def test_all_word_parts_that_labels_speak_for_are_mined(spark):
    rude = " ".join(np.base_repr(i, 36).lower() for i in range(36**3, 36**3 + 5000))
    rows = [(rude, 1)] * 8 + [("calm words only", 0)] * 92
    mined = toxicity.mined_parts(spark.createDataFrame(rows, "text string, toxic int"))
    assert sorted(mined) == sorted(rude.split())


def test_tone_and_phrases_vote_in_full():
    voters = toxicity.Voters.of([])
    calm = "the report was read by all members of the council in the morning " * 40

    def said(text):
        votes = voters.votes(text, toxicity.words_of(text))
        names = [*toxicity.PHRASES, "exclaiming", "masked", "shouted"]
        return {n for k, n in enumerate(names, voters.count - len(names)) if votes >> k & 1}

    for text in ("f*$k that", "oh sh$#t", "a #@ b f@$k"):
        assert said(text) == {"masked"}, text
    for text in ("You are an idiot", "you're an idiot", "You are a big loser", "you idiot"):
        assert said(text) == {"you_are"}, text
    assert said("we will hurt them") == {"threat"} and said("now SHUT up") == {"command"}
    assert said(calm + "THIS MUST STOP RIGHT HERE " + calm) == {"shouted"}
    assert said(calm + "ÀÉÈÊ ÇÉÀÈ ÙÛÀÂ ÉÈÀÇ " + calm) == {"shouted"}
    for text in ("you are a doctor", "we skill you here", "a b@c d", calm, "GO AHEAD", ""):
        assert said(text) == set(), text


def test_toxicity_without_labels_or_texts(spark):
    docs, labels = labelled(spark)
    assert toxicity.digest_toxicity(docs, labels.limit(0)).count() == 904
    assert toxicity.digest_toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_odd_rows(spark, rows):
    docs, n = documents(spark, rows), len(rows)
    assert line_dedup.digest_lines(docs).count() == n
    cleaned = line_dedup.without_shared_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == n
    assert cleaned.filter("text IS NULL").count() == min(n, 1)
    groups = {r.doc_id: r.component_id for r in simhash.fingerprint_groups(docs).collect()}
    assert not n or (groups[5], groups[3], groups[2], groups[1], groups[None]) == (3, 3, 1, 1, None)
    assert simhash.one_of_each_group(docs).count() == (5 if n else 0)
    assert repeats.digest_repeats(docs).count() == n
    assert secret_scan.digest_secrets(docs).count() == n
    assert lm_score.score_texts(docs).count() == n
    mixed = mixing.mix_sources(mixing.with_size(docs), SCHEDULES)
    assert mixed.count() == n and "score" in mixed.columns


def test_pipeline_stages_do_what_they_say(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, names = docs, docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, step(spark, kept, SF)
        assert kept.columns == names
        assert kept.join(before, "doc_id", "left_anti").count() == 0, name
    final = corpus_pipeline.run(spark, SF)
    assert final.count() == kept.count() and {"position", "taken"} <= set(final.columns)
    assert final.select("doc_id").distinct().count() == final.count()
