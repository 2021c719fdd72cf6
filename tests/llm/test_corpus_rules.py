"""Runs, collocations and distribution rules against brute force and their SQL."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from ladingspark.llm import collocations, common, divergence, queries, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, start string, rank string, ref_lang string"
ODD = [None, "", " ", "\n\t", "a", "a a a a a a a", "ab " * 40, "x y " * 9 + "z", "α β\x1cγ ß ẞ Ǆ", "İ I ı i", "no.end,of;it:at!all?\x0b\x0c\r", "é　é　é", "the same", "the same", "#*$%&|<> a b c d e f g h i j"]


def documents(spark, texts, lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), "s", "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def made_up(n, seed, vocabulary=30):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice([f"w{k}" for k in range(vocabulary)], rng.integers(0, 60), p=None)) + rng.choice(["", ".", "\n", "!"]) for _ in range(n)]


def brute_runs(x, least=6, repeats=4):
    x, n, out = list(x), len(x), []
    for p in range(1, n):
        start = 0
        while start + p < n:
            end = start
            while end + p < n and x[end] == x[end + p]:
                end += 1
            size = end - start + p
            if end > start and size >= max(least, repeats * p):
                word = x[start : start + p]
                if not any(p % d == 0 and word == word[:d] * (p // d) for d in range(1, p)):
                    out.append((start, size, p))
            start = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_runs_equal_brute_force(letters):
    rng = np.random.default_rng(letters)
    for _ in range(200):
        n = int(rng.integers(0, 80))
        x = rng.integers(0, letters, n).astype(np.int32)
        if n and rng.random() < 0.6:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, 12))
            at = np.arange(n)
            x = x[np.where(at < a, at, a + (at - a) % p)]
        for least, repeats in ((6, 4), (2, 2)):
            assert runs.runs_of(x, least, repeats) == brute_runs(x, least, repeats)


def test_runs_without_trust_in_hashes(monkeypatch):
    """Hashes that are all equal lead astray at most: what is found is verified word by word."""
    rng = np.random.default_rng(5)
    x = np.tile(rng.integers(0, 9, 20), 30).astype(np.int32)
    x[450] = 77
    want = runs.runs_of(x)
    monkeypatch.setattr(runs, "BASE", 0)
    got = runs.runs_of(x)
    assert all(run in brute_runs(x) for run in got) and want == brute_runs(x)


def test_long_periodic_texts_take_no_square_of_time():
    n = 300_000
    for x in (np.zeros(n, np.int32), np.arange(n, dtype=np.int32) % 1000, np.arange(n, dtype=np.int32) // 2 % 7):
        assert [r[:2] for r in runs.runs_of(x)] == [(0, n)]


def expected_runs(doc_id, text):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {i for s, size, p in found for i in range(s + p, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{size},{p}\n" for s, size, p in found)), sha(kept))


def test_run_query_equals_brute_force(spark):
    texts = ODD + made_up(150, 1, 4) + made_up(50, 2, 500)
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in runs.periodic_runs(documents(spark, texts), rewrite=runs.planted).collect()}
    assert got == {i: expected_runs(i, t) for i, t in enumerate(texts)}
    assert sum(r[0] > 0 for r in got.values()) > 10
    assert runs.periodic_runs(documents(spark, [])).count() == 0
    nameless = spark.createDataFrame([(None, "a b " * 9)] * 2, "doc_id long, text string")
    assert [(r["n_runs"], r["length"], r["period"]) for r in runs.periodic_runs(nameless, rewrite=runs.planted).collect()] == [(1, 18, 2)] * 2


def expected_phrases(docs, longest, least, share, top):
    counts, out = {}, []
    for text, lang in docs:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        good = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        longer = Counter()
        for g, c in good.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i : i + k]] = max(longer[g[i : i + k]], c)
        rows = []
        for g, a in good.items():
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            if 100 * longer[g] < share * a:
                rows.append((" ".join(g), a, f[g[:k]], f[g[k:]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least"), [(3, 10), (4, 3), (2, 2)])
def test_collocations_equal_brute_force(spark, monkeypatch, longest, least):
    # Small slices, chunks and rows; nearly all pivots go to several tasks.
    for name, value in (("SLICE_BYTES", 500), ("MINED_BYTES", 300), ("PIVOT_ROWS", 40), ("ROW_FRAGMENTS", 3)):
        monkeypatch.setattr(collocations, name, value)
    texts = ODD * 3 + made_up(120, 3) + ["w1 w2 w3 w1 w2 w3, A a A\tb"] * 40 + ["W1 w2! w3 " * 30, "no " * 50]
    lang = lambda i: (None, "en", "en", "de", "")[i % 5]
    docs = documents(spark, texts, lang)
    got = collocations.collocations(docs, longest=longest, least=least, top=50)
    assert sorted(map(tuple, got.collect())) == expected_phrases([(t, lang(i)) for i, t in enumerate(texts)], longest, least, 50, 50)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_exact_scores(spark):
    big = 10**15 - 1
    rows = spark.createDataFrame([(big, big, big), (10, 20, 30), (999_999_999_999, 10**15 - 3, 10**15 - 7)], "a long, l long, r long")
    got = [r[0] for r in rows.select(collocations.score_of(rows["a"], rows["l"], rows["r"])).collect()]
    assert got == [1_000_000 * a * a // (x * r) for a, x, r in map(tuple, rows.collect())]


def base_of(text):
    text = text or ""
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_rules_equal_brute_force(spark):
    texts = ODD + made_up(60, 4, 8) + made_up(60, 5, 500) + ["same line\nsame line\n \n\nother " * 20, "w" * 3000, "a\x1cb\x1fc d " * 8]
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: r for r in divergence.judge(documents(spark, texts, lambda i: (None, "en")[i % 2])).collect()}
    assert {i: tuple(r[c] for c in columns) for i, r in got.items()} == {i: base_of(t) for i, t in enumerate(texts)}
    assert all(r["kept"] == (not r["base_failed"]) for r in got.values())  # the references are too small to judge by
    assert divergence.judge(documents(spark, [])).count() == 0


def test_words_of_a_text_in_pieces(monkeypatch):
    texts = [t or "" for t in ODD] + made_up(40, 8, 20) + ["a\x1cb\x1fc d " * 8, "w" * 300]
    for size in (1, 9, 1 << 20):
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        monkeypatch.setattr(divergence, "PIECE_CHARS", size)
        for t in texts:
            words, numbers = runs.numbered(t.encode())
            index, same = divergence.numbered_words(t)
            assert [words[k].decode() for k in numbers] == [list(index)[k] for k in same] == WORDS.findall(t)
            assert divergence.repeated_lines(t) == base_of(t)[3] and divergence.character_counts(t)[: divergence.CLASSES].sum() == len(t)


def test_distance_and_verdicts(spark):
    assert divergence.distance(np.array([3.0, 0]), np.array([0, 5.0])) == 1 and divergence.distance(np.array([2.0, 6]), np.array([1.0, 3])) == 0
    rng = np.random.default_rng(6)
    vocabulary = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    chance = 1 / np.arange(1, 301)
    good = [" ".join(rng.choice(vocabulary, 120, p=chance / chance.sum())) for _ in range(150)]
    bad = ["".join(rng.choice(list("QWERTZ@{}~ "), 900)) for _ in range(5)] + [" ".join(x[::-1].upper() for x in g.split()) for g in good[:5]]
    short = ["Q@ Z~ R{ T} Q@Z W~ E{ R} T~ Z@ QQ"]
    got = {r["doc_id"]: r["kept"] for r in divergence.judge(documents(spark, good + bad + short)).collect()}
    assert [got[i] for i in range(150)] == [True] * 150
    assert [got[150 + i] for i in range(10)] == [False] * 10 and got[160]  # too short to be judged


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op12_collocations", "op13_quality_rules"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=repr)
