"""Lexical search, passage removal and token alignment against brute force and on odd rows."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers

from strikeforge.llm import lexical_search, passages, token_alignment
from strikeforge.llm.queries import QUERIES, TOKENIZERS

SF = "/root/testdata/sf0.001"
A_FILE, B_FILE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: Names that operators give to columns of their own.
CLASHES = ("key", "data", "mark", "row", "item", "rank", "score", "starts", "removed", "kept", "pairs")


def documents(spark, rows, **more):
    """Rows of (doc_id, text) with extra columns named like what operators make."""
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(d, t, *("x" for _ in CLASHES)) for d, t in rows], schema)


def items(spark, rows):
    schema = "item_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, *("x" for _ in CLASHES)) for i, t in rows], schema)


ODD = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"),
       (None, "no id but words"), (None, "one two three four five six"), (4, "long " * 60_000),
       (5, "one two three four five six"), (6, " \t\n"), (7, "One, TWO; three"), (8, "naïve Ünïcode 東京"),
       (3, "another text of three")]


# -- ranked lexical search


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_ranks(docs, asked, top=10):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for i, t in asked:
        wanted[i].update(terms_of(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, -math.inf if d is None else d, d))
        ranked = sorted(scored, key=lambda s: s[:2])[:top]
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(ranked)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [60, 10**6])
def test_ranks_equal_brute_force(spark, block_chars):
    rng = random.Random(4)
    words = ["a", "ab", "abc", "É", "é", "x1", "1", "東京", "The", "the", "of"] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x00", "  "])
                             for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(80)] + ODD
    docs += [(1000 + i, docs[3][1]) for i in range(15)]  # ties
    asked = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [
        (20, None), (21, ""), (22, "..."), (23, "one two one"), (23, "one two one"), (23, "three"),
        (None, "of the words"), (24, "nowhere")]
    found = lexical_search.rank_documents(
        documents(spark, docs), items(spark, asked), block_chars=block_chars)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_ranks(docs, asked)


def test_only_best_rows_leave_a_task(monkeypatch):
    """Whatever a task holds before it settles, the best documents come out."""
    rng = np.random.default_rng(2)
    table = np.stack([rng.integers(0, 4, 500), rng.integers(1, 9, 500), rng.permutation(500)])
    best = lexical_search._best(table, 7)
    for item in range(4):
        own = sorted((-s, k) for i, s, k in table.T.tolist() if i == item)[:7]
        assert [(-s, k) for i, s, k in best.T.tolist() if i == item] == own


def test_search_bounds_what_tasks_hold(spark, monkeypatch):
    docs = [(i, f"common w{i % 7} " * (1 + i % 5)) for i in range(300)]
    asked = [(0, "common w1"), (1, "w2 w3"), (2, "common")]
    monkeypatch.setattr(lexical_search, "HELD_ROWS", 4)
    found = lexical_search.rank_documents(documents(spark, docs), items(spark, asked)).collect()
    assert sorted(map(tuple, found), key=str) == brute_ranks(docs, asked)


def test_search_of_empty_tables(spark):
    docs, asked = documents(spark, ODD), items(spark, [(1, "one")])
    assert lexical_search.rank_documents(docs.limit(0), asked).count() == 0
    assert lexical_search.rank_documents(docs, asked.limit(0)).count() == 0
    assert lexical_search.rank_documents(docs, items(spark, [(1, None), (2, "?")])).count() == 0


# -- passages


def brute_passages(docs, window):
    """Kept words of every row, and how many went."""
    least = {}
    key = lambda d: -math.inf if d is None else d
    rows = [(key(d), (t or "").split()) for d, t in docs]
    for d, words in rows:
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            least[w] = min(least.get(w, math.inf), d)
    out = []
    for (d, words), (doc_id, _) in zip(rows, docs):
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def passage_rows(found):
    return sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.removed), r.kept) for r in found.collect()),
                  key=str)


def test_automaton_gives_matching_statistics():
    rng = random.Random(8)
    for _ in range(30):
        texts = [(k, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 14))]) for k in range(6)]
        automaton = passages.SuffixAutomaton()
        for key, words in texts:
            automaton.add(words, key)
        query = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(25)]
        for most in (3, 100):
            for end, (size, first) in enumerate(automaton.stream(query, most), 1):
                holders = lambda n: [k for k, w in texts
                                     if any(w[i:i + n] == query[end - n:end] for i in range(len(w) - n + 1))]
                longest = max(n for n in range(min(end, most) + 1) if n == 0 or holders(n))
                assert size == longest
                assert not size or first == min(holders(size))


@pytest.mark.parametrize("limits", [
    {}, {"shard_words": 1}, {"crowded": 0}, {"crowded": 2, "shard_words": 40}, {"gram": 1}, {"gram": 6},
])
def test_passages_equal_brute_force(spark, limits):
    rng = random.Random(6)
    shared = [[rng.choice("abcdé") for _ in range(n)] for n in (7, 12, 30, 60)]
    text = lambda: rng.choice([" ", "\n ", "\t"]).join(
        " ".join(rng.choice([*shared, [rng.choice("abcdefghé") for _ in range(9)]])) for _ in range(rng.randrange(0, 6)))
    docs = [(d, text()) for d in range(70)]
    docs += [(d, docs[5][1]) for d in (200, 200, 201, None)] + [(7, docs[9][1]), (None, None), (300, "")]
    found = passages.remove_shared_passages(documents(spark, docs), window=6, **{"gram": 3} | limits)
    assert passage_rows(found) == brute_passages(docs, 6)


def test_passages_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 16)
    words = [f"w{i % 37}x{i % 11}" for i in range(300)]
    docs = [(1, " ".join(words)), (2, "lead " + " ".join(words[20:250]) + " tail"), (3, " ".join(words[:49]))]
    found = passages.remove_shared_passages(documents(spark, docs), window=50)
    assert passage_rows(found) == brute_passages(docs, 50)


@pytest.mark.parametrize("shard_words", [10, 10**6])
def test_reference_passages_equal_brute_force(spark, shard_words):
    rng = random.Random(3)
    some = lambda n: [rng.choice("abcd") for _ in range(n)]
    reference = [some(30) for _ in range(5)]
    docs = [(i, " ".join(some(5) + reference[i % 5][i % 9:20] + some(4))) for i in range(30)] + [(99, None)]
    windows = {tuple(r[i:i + 8]) for r in reference for i in range(len(r) - 7)}
    expected = []
    for d, t in docs:
        words, gone = (t or "").split(), set()
        for i in range(len(words) - 7):
            if tuple(words[i:i + 8]) in windows:
                gone.update(range(i, i + 8))
        expected.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    texts = documents(spark, [(i, " ".join(r)) for i, r in enumerate(reference)] + [(9, None)])
    found = passages.remove_reference_passages(
        documents(spark, docs), texts, window=8, shard_words=shard_words)
    assert passage_rows(found) == sorted(expected, key=str)
    none = passages.remove_reference_passages(documents(spark, docs), texts.limit(0), window=8)
    assert {r.removed == [] for r in none.collect()} == {True}


def test_passages_of_odd_rows(spark):
    docs = documents(spark, ODD)
    assert passage_rows(passages.remove_shared_passages(docs, window=4, gram=2)) == brute_passages(ODD, 4)
    assert passages.digest_passages(docs.limit(0)).count() == 0
    assert passages.digest_passages(docs).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


# -- token alignment


@pytest.fixture(scope="module")
def encoders():
    a = tokenizers.Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    octet = {chr(b): b for b in same}
    octet |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in same)}
    entries = {n: bytes(octet.get(c, 0) for c in t) for t, n in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)

    def b_bytes(n):
        name = b.id_to_piece(n)
        return bytes([int(name[3:5], 16)]) if b.is_byte(n) else name.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        left = [(n, entries[n]) for n in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(n, b_bytes(n)) for n in b.encode(text)]
        whole = (" " + text).encode()
        spelled = (b"".join(t for _, t in x) for x in (left, right))
        return (left, right) if all(s == whole for s in spelled) else ([], [])

    return encode


def ended(tokens):
    out, at = [], 0
    for n, octets in tokens:
        out.append((n, at, at + len(octets)))
        at += len(octets)
    return out


def brute_alignment(texts, encode):
    rows = []
    for text in texts:
        a, b = map(ended, encode(text))
        links = [(x, y) for x, s, e in a for y, f, g in b if s < g and f < e]
        edges = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in edges:
            groups.append("|".join(",".join(str(n) for n, _, e in side if low < e <= high) for side in (a, b)))
            low = high
        rows.append((len(a), len(b), groups, links))
    counts = Counter(p for *_, links in rows for p in set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(na, nb, len(g), len(k), sum(counts[p] == most[p[0]] for p in k), sum(counts[p] for p in k),
             ";".join(g)) for na, nb, g, k in rows]


HARD = ["", None, "▁ mark", "a ▁b", "<|endoftext|> a<|endoftext|>", "</s> <unk> <s>", "a\x00b", " lead", "trail ",
        "two  spaces   three\n\n\nlines\t\ttabs", "naïve café", "café", "東京は日本の首都であり" * 9,
        "😀😃 emoji👨‍👩‍👧", "don't we'll THEY'RE", "x" * 300, " " * 70 + "gap" + " " * 1200 + "end", "\n" * 5, "1234567 89",
        "ไทยไม่มีช่องว่าง" * 5, "a b c\u0085d", "ab" * 400 + " " + "中" * 200, "﻿bom", "word " * 200]


@pytest.mark.parametrize("range_chars, common", [(1 << 16, 1 << 18), (40, 1 << 18), (7, 3), (64, 0)])
def test_alignment_equals_brute_force(spark, encoders, range_chars, common):
    own = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).select("text").collect()
    texts = HARD + [r.text[:700] for r in own] + [HARD[10], HARD[10]]
    expected = brute_alignment(texts, encoders)
    found = token_alignment.align_tokens(
        documents(spark, list(enumerate(texts))), A_FILE, B_FILE, range_chars=range_chars, common_pairs=common)
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == dict(enumerate(expected))


def test_fragments_compose_associatively():
    rng = random.Random(12)
    for _ in range(60):
        size = rng.randrange(10, 80)
        sides = []
        for _ in range(2):
            ends = sorted({*rng.sample(range(1, size), size // 3), size})
            sides.append(token_alignment.Tokens(np.array([rng.randrange(99) for _ in ends]), np.array(ends)))
        cuts = sorted(rng.sample(range(1, size), 4))
        # Either side is cut at a place of its own, up to a few bytes from the other's.
        parts, at = [], (0, 0)
        for cut in [*cuts, size]:
            stop = [min(s.ends[s.ends >= cut]) if cut < size else size for s in sides]
            own = [token_alignment.Tokens(s.ids[(s.ends > a) & (s.ends <= z)], s.ends[(s.ends > a) & (s.ends <= z)])
                   for s, a, z in zip(sides, at, stop)]
            parts.append(token_alignment.Fragment.of(*own))
            at = tuple(stop)
        whole = token_alignment.Fragment.of(*sides).whole()
        left = functools.reduce(lambda x, y: x + y, parts)
        right = functools.reduce(lambda x, y: y + x, reversed(parts))
        mixed = (parts[0] + parts[1]) + (parts[2] + (parts[3] + parts[4]))
        for total in (left, right, mixed):
            got = total.whole()
            assert (got.spelling, got.n_a, got.n_b, got.n_groups) == (
                whole.spelling, whole.n_a, whole.n_b, whole.n_groups)
            assert got.pairs.tolist() == whole.pairs.tolist() and got.times.tolist() == whole.times.tolist()


def test_packed_pairs_come_back():
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 1 << 47, 1000))
    times = rng.integers(1, 1 << 40, len(pairs))
    back = token_alignment.unpack_pairs(token_alignment.pack_pairs(pairs, times))
    assert all(np.array_equal(x, y) for x, y in zip(back, (pairs, times)))
    assert [len(x) for x in token_alignment.unpack_pairs(token_alignment.pack_pairs(pairs[:0], times[:0]))] == [0, 0]


def test_query_of_alignment_equals_brute_force(spark, encoders):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = sorted((r for r in docs), key=lambda r: r.doc_id)
    expected = brute_counts([r.text for r in short], encoders)
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_align_tokens"](spark, SF).collect()}
    assert found == dict(zip([r.doc_id for r in short], expected))


def brute_counts(texts, encode):
    """As ``brute_alignment``, with links found by walking both sides; for many long texts."""
    rows = []
    for text in texts:
        a, b = map(ended, encode(text))
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            x, y = a[i][2], b[j][2]
            i, j = i + (x <= y), j + (y <= x)
        shared = {e for *_, e in a} & {e for *_, e in b}
        groups, left, right, j = [], [], [], 0
        for n, _, e in a:
            left.append(n)
            if e in shared:
                while j < len(b) and b[j][2] <= e:
                    right.append(b[j][0])
                    j += 1
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        rows.append((len(a), len(b), groups, links))
    counts = Counter(p for *_, links in rows for p in set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(na, nb, len(g), len(k), sum(counts[p] == most[p[0]] for p in k), sum(counts[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, k in rows]


def test_alignment_of_odd_rows(spark, encoders):
    docs = documents(spark, ODD)
    found = token_alignment.digest_alignment(docs, A_FILE, B_FILE)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = brute_counts([t for _, t in ODD], encoders)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(
        ((d, *e) for (d, _), e in zip(ODD, expected)), key=str)
    assert token_alignment.digest_alignment(docs.limit(0), A_FILE, B_FILE).count() == 0
