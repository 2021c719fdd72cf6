"""What the operators' queries do not show by themselves: inner results by brute force, hot keys, odd tables."""

from __future__ import annotations

import itertools
import json
import math
import struct
import tracemalloc
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ladingspark.llm import ann, bpe, common, gru, lm, media, quality, queries, sharding, simhash, token_counts, urls

from .test_operators import ODD_TEXTS, brute_components, documents, random_texts


def test_gradient_by_finite_differences(monkeypatch):
    """Every weight's gradient of one window, words of several classes and unknown ones included."""
    monkeypatch.setattr(gru, "CLASS_WORDS", 4)
    monkeypatch.setattr(gru, "CLASS_GROWTH", 2)
    rng = np.random.default_rng(4)
    model = gru.Gru.initial(rng.dirichlet(np.ones(20))[:14] * 0.9)
    assert model.edges.tolist() == [0, 4, 8, 12, 14] and model.class_of.tolist() == [0] * 4 + [1] * 4 + [2] * 4 + [3] * 2
    model = model.with_flat(model.flat() + rng.normal(0, 0.3, model.flat().size))
    targets = rng.integers(0, 15, (6, 3)).astype(np.int32)
    starts = np.zeros((6, 3), bool)
    starts[0] = True
    starts[3, 1] = True
    inputs = np.where(starts, model.start, np.concatenate([targets[:1], targets[:-1]])).astype(np.int32)

    def loss(w):
        total, sig = 0.0, lambda x: 1 / (1 + np.exp(-x))
        for lane in range(3):
            state = np.zeros(gru.HIDDEN)
            for t in range(6):
                state = np.zeros(gru.HIDDEN) if starts[t, lane] else state
                x = w["embed"][inputs[t, lane]] @ w["inward"] + w["gate_bias"]
                over = state @ w["across"]
                r, z = sig((x + over)[: gru.HIDDEN]), sig((x + over)[gru.HIDDEN : 2 * gru.HIDDEN])
                fresh = np.tanh(x[2 * gru.HIDDEN :] + r * over[2 * gru.HIDDEN :])
                state = (1 - z) * fresh + z * state
                word = targets[t, lane]
                c = 4 if word == 14 else int(model.class_of[word])
                of = state @ w["class_out"] + w["class_bias"]
                total -= of[c] - np.log(np.exp(of).sum())
                if c < 4:
                    block = slice(model.edges[c], model.edges[c + 1])
                    inside = w["word_out"][block] @ state + w["word_bias"][block]
                    total -= inside[word - block.start] - np.log(np.exp(inside).sum())
        return total / (gru.WINDOW * 3)

    trainer = gru.Trainer(model)
    trainer.width = 3
    got = {k: np.zeros(v.shape) for k, v in model.weights.items()}

    def note(name, gradient, rows=slice(None)):
        got[name][rows] += gradient

    monkeypatch.setattr(trainer, "descend", note)
    trainer.step(targets, inputs, starts, np.zeros((3, gru.HIDDEN), np.float32))
    exact = {k: v.astype(np.float64) for k, v in model.weights.items()}
    for name, w in exact.items():
        for at in rng.permutation(w.size)[:25]:
            place = np.unravel_index(at, w.shape)
            was, sides = w[place], []
            for step in (1e-5, -1e-5):
                w[place] = was + step
                sides.append(loss(exact))
            w[place] = was
            assert got[name][place] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=2e-6, rel=2e-3), (name, place)


def test_long_text_is_scored_in_pieces(spark, monkeypatch):
    long = " ".join(f"w{i % 900}" for i in range(30_000))
    docs = documents(spark, random_texts(40) + [long])
    whole = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(common, "PIECE_BYTES", 1000)
    pieces = list(common.pieces_of(long.encode()))
    assert len(pieces) > 100 and b"".join(pieces) == long.encode()
    cut = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    assert cut[40]["n_tokens"] == 30_001 and cut.keys() == whole.keys()
    for i, r in cut.items():
        assert r["score"] == pytest.approx(whole[i]["score"], abs=1e-3) and r["base_score"] == pytest.approx(whole[i]["base_score"])


def test_every_training_token_takes_part_in_one_step(spark, monkeypatch, tmp_path):
    """A corpus of over two million tokens: what the copies are trained on adds up to all training tokens, each text once."""
    texts = [f"own{i} " + "some words again " * 3000 for i in range(300)]
    folder = str(tmp_path)

    class Counting:
        def __init__(self, model, *_):
            self.model, self.tokens = model, 0

        def run(self, texts, *_):
            self.tokens += sum(map(len, texts))
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(" ".join(str(len(t)) for t in texts))

    class Done(Exception):
        pass

    def done(docs, model, head):
        raise Done

    monkeypatch.setattr(lm, "Trainer", Counting)
    monkeypatch.setattr(lm, "scored", done)
    with pytest.raises(Done):
        lm.score_documents(documents(spark, texts))
    sizes = [int(n) for p in tmp_path.iterdir() for n in p.read_text().split()]
    training = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sorted(sizes) == [9002] * len(training)
    assert lm.copies_and_lanes(3_400_000) == (4, 48) and lm.copies_and_lanes(90_000_000) == (30, 192)  # lanes change the steps' size, not what is read


def test_scoring_takes_memory_by_tokens():
    """One long text among many short ones: lanes are not filled up to the longest."""
    model = gru.Gru.initial(np.full(200, 0.004))
    texts = [np.zeros(20_000, np.uint16), *(np.full(10, k % 200, np.uint16) for k in range(2000))]
    tracemalloc.start()
    try:
        together = gru.score(model, texts)
        assert tracemalloc.get_traced_memory()[1] < 32e6  # 1024 lanes of 20,000 tokens were 370 MB
    finally:
        tracemalloc.stop()
    assert together[:3] == pytest.approx([gru.score(model, [t])[0] for t in texts[:3]], abs=1e-3)


def test_words_by_arrow_are_those_of_python(monkeypatch):
    """Words, ids and tails of odd texts, whole and in pieces, few texts at a time, against bytes.split."""
    texts = [*ODD_TEXTS, "", " \x0b ", "\x1ca\x85B\u00a0c \x0cDd", "w " * 700 + "rare rare", "\U0001f600 " * 400]
    texts = [t or "" for t in texts if t is None or len(t) < 100_000]
    expected = [t.encode().lower().split() for t in texts]
    counts = Counter(w for t in expected for w in [*t, b""]).most_common()[:12]
    head = lm.Head(b" ".join(w for w, _ in counts), np.array([n for _, n in counts]), 5000, 100)
    place = {w: i for i, (w, _) in enumerate(counts)}
    for piece, group in ((1 << 20, 4 << 20), (500, 2000)):
        monkeypatch.setattr(common, "PIECE_BYTES", piece)
        monkeypatch.setattr(lm, "GROUP_BYTES", group)
        row = 0
        for rows, parts in lm.groups(pa.array(texts)):
            assert rows.start == row
            found = lm.coded(parts, rows.stop - row, head, 8)
            for k in range(rows.stop - row):
                words = [*expected[row + k], b""]
                got = {name: column[k].as_py() for name, column in found.items()}
                assert np.frombuffer(got["ids"], np.uint16).tolist() == [min(place.get(w, 8), 8) for w in words] and got["n_tokens"] == len(words)
                assert dict(zip(got["tail_words"], got["tail_counts"], strict=True)) == Counter(w for w in words if w not in place)
                assert got["head_known"] == sum(w in place for w in words)
                assert got["head_base"] == pytest.approx(sum(head.log_base[place[w]] for w in words if w in place))
                assert got["head_rest"] == pytest.approx(sum(head.log_base[place[w]] for w in words if place.get(w, 0) >= 8))
            row = rows.stop
        assert row == len(texts)


def test_encoder_leaves_nothing_remembered_in_the_workers(spark):
    """Workers are used again by later stages: after a job none holds pieces or pairs of its texts."""
    content = queries.tokenizer_json()
    rows = bpe.encode(documents(spark, random_texts(200)).repartition(4), content).collect()
    assert len(rows) == 200 and all(r["n_tokens"] for r in rows if r["decoded"])

    def left(batches):
        for _ in batches:
            encoder = bpe.loaded(content)
            yield pa.RecordBatch.from_pydict({"n": [len(encoder.known) + len(encoder.fits)]})

    assert [r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(left, "n bigint").collect()] == [0] * 8


def test_png_by_an_independent_reader(spark):
    """The file is read by the standard's words alone, and the feature is summed by its definition."""
    texts = [*ODD_TEXTS, "row of text " * 9000]
    for r in media.media_columns(documents(spark, texts)).collect():
        data = bytes(r["media"])
        assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
        at, parts = 8, {}
        while at < len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
            assert int.from_bytes(data[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + body)
            parts[kind] = parts.get(kind, b"") + body
            at += 12 + size
        width, height, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
        assert (width, depth, colour) == (576, 8, 0)
        raw, rows, before = zlib.decompress(parts[b"IDAT"]), [], [0] * width
        for y in range(height):
            line = list(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
            kind = raw[y * (width + 1)]
            for x in range(width):
                a, b = line[x - 1] if x else 0, before[x]
                line[x] = (line[x] + (0, a, b)[kind]) & 255
            rows.append(line)
            before = line
        text = (texts[r["doc_id"]] or "").encode()
        assert bytes(itertools.chain(*rows)) == text + b"\xff" * (-len(text) % 576 if text else 576)
        band = lambda n, k: range(n * k // 32, n * (k + 1) // 32) if n >= 32 else [k * n // 32]
        image = np.array(rows, float)
        small = [[image[np.ix_(band(height, i), band(width, j))].mean() for j in range(32)] for i in range(32)]
        low = [round(sum(small[i][j] * math.cos(math.pi * (2 * i + 1) * u / 64) * math.cos(math.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)), 4) for u in range(8) for v in range(8)]
        middle = sorted(low)
        middle = (middle[31] + middle[32]) / 2
        bits = format(int(r["feature"], 16), "064b")
        assert all(bit == str(int(c > middle)) for bit, c in zip(bits, low, strict=True) if abs(c - middle) > 1e-3)
    assert media.media_columns(documents(spark, [])).count() == 0


def test_posteriors_by_hand(spark):
    rng = np.random.default_rng(6)
    rows = [(f"h{i % 7}" if i % 11 else None, f"p{i % 3}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(-1, 2, (500, 2)))]
    rows += [("h1", "p1", 3.0, 3.0)] * 300  # a section that holds a third of all
    found = {(r["_host"], r["_path"]): r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, low_logit double, toxic_logit double")).collect()}
    for k, head in enumerate(("low", "toxic")):
        chance = lambda r, k=k: 1 / (1 + math.exp(-r[2 + k]))
        sites, sections = defaultdict(list), defaultdict(list)
        for r in rows:
            sites[r[0]].append(chance(r))
            sections[r[0], r[1]].append(chance(r))
        mean = sum(map(chance, rows)) / len(rows)
        rates = [np.mean(v) for v in sites.values()]
        weight = quality.strength(mean, float(np.var(rates)), float(np.mean([len(v) for v in sites.values()])))
        of_host = {h: (sum(v) + weight * mean) / (len(v) + weight) for h, v in sites.items()}
        spread = np.mean([(np.mean(v) - of_host[h]) ** 2 for (h, _), v in sections.items()])
        inner = quality.strength(float(np.mean([of_host[h] for h, _ in sections])), float(spread), float(np.mean([len(v) for v in sections.values()])))
        assert found.keys() == sections.keys()
        for (h, p), v in sections.items():
            assert found[h, p][f"{head}_host_rate"] == pytest.approx(of_host[h])
            assert found[h, p][f"{head}_path_rate"] == pytest.approx((sum(v) + inner * of_host[h]) / (len(v) + inner))


def test_lengths_equal_the_tokenizers_library(spark):
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    real.encode_special_tokens = True
    texts = ODD_TEXTS + random_texts(20)
    ranks = open(public_tokenizers.path("byte_bpe_50k.tiktoken")).read()
    got = sorted(r["length"] for r in token_counts.lengths(documents(spark, texts), ranks, public_tokenizers.PATTERN).collect())
    assert got == sorted(len(real.encode(t or "", add_special_tokens=False).ids) for t in texts)


def test_bpe_refuses_a_vocabulary_without_a_byte():
    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    del spec["model"]["vocab"]["z"]
    spec["model"]["merges"] = []
    with pytest.raises(ValueError, match="255 of 256"):
        bpe.PrefixBpe(json.dumps(spec))


def test_bpe_with_a_small_memory(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    small, real = bpe.PrefixBpe(open(path).read()), Tokenizer.from_file(path)
    for t in random_texts(5) + [" ".join(f"word{i % 7} other" for i in range(200))]:
        ids = list(small.encode(t))
        assert ids == real.encode(t, add_special_tokens=False).ids
        assert small.listed(ids) == ",".join(map(str, ids)) and small.decode(ids) == t
        assert len(small.known) <= 5 and len(small.fits) <= 5


def test_url_of_a_megabyte(spark):
    deep = ".".join(["a"] * 400_000)
    cases = [f"http://{deep}.example.com/de/{'x' * 1000}", f"http://{deep}.net", "http://" + "b" * 1_000_000 + ".org/fr/"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    want = {0: ("example.com/de/", "block"), 1: (None, "allow"), 2: ("org/fr/", "allow")}
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, queries.URL_RULES).collect()} == want
    table = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_by_join(pages, table).collect()} == want
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_shards_by_the_shuffled_directory(spark, monkeypatch):
    docs = documents(spark, random_texts(300) + ["copy"] * 150)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    key = lambda rows: sorted((r["row"]["doc_id"], r["shard"], r["page"], r["shard_bytes"], r["oversize"]) for r in rows)
    want = key(sharding.shard(docs, size, 1500).collect())
    monkeypatch.setattr(sharding, "BROADCAST_SHARDS", 3)
    assert key(sharding.shard(docs, size, 1500).collect()) == want
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    assert key(sharding.shard(docs, size, 1500).collect()) == want
    # Only what is over the limit splits: the parent of every shard holds more than the limit.
    by_parent = defaultdict(int)
    for _, name, _, _, _ in want:
        assert name != "*"
    for i, name, *_ in want:
        for other in {n for _, n, *_ in want}:
            if name.startswith(other[:-1]):
                by_parent[other] += len(docs_text(i))
    assert all(total > 1500 for total in by_parent.values())


def docs_text(i: int) -> bytes:
    texts = random_texts(300) + ["copy"] * 150
    return texts[i].encode()


@pytest.mark.parametrize("hot_keys", [10_000, 30, 1])
def test_components_whatever_is_hot(spark, monkeypatch, hot_keys):
    """Copies and hubs by broadcast and by shuffle give the same."""
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    base = random_texts(25)
    texts = base + [base[0]] * 40 + [base[1] + f" w{i}" for i in range(25)] + [None, "", " "] * 4
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [int(bytes(rows[i]["fp"]).hex(), 16) for i in range(len(texts))]
    assert [rows[i]["component_id"] for i in range(len(texts))] == brute_components(prints, 2)
    edges = [(b"a%03d" % (i // 7), b"a%03d" % i) for i in range(1, 60)] + [(b"b%d" % i, b"b%d" % (i + 1)) for i in range(9)]
    got = {bytes(r["node"]): bytes(r["root"]) for r in simhash.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {**{b"a%03d" % i: b"a000" for i in range(1, 60)}, **{b"b%d" % i: b"b0" for i in range(1, 10)}}


def test_ann_ties_repeated_ids_and_other_columns(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(0, one, "x"), (7, two, "x"), (3, one, "x"), (5, [2.0, 0.0, 0.0], "x"), (3, one, "x"), (9, two, "x"), (9, [1.0, 1.0, 0.0], "x"), (50, two, None), (None, one, "x"), (60, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(df, lambda c: c % 50 == 0).collect()]
    half = round(math.sqrt(0.5), 6)
    assert sorted(got) == [(0, 1, 3, 1.0), (0, 2, 5, 1.0), (0, 3, 9, half), (0, 4, 7, 0.0), (0, 5, 50, 0.0), (50, 1, 7, 1.0), (50, 2, 9, 1.0), (50, 3, 0, 0.0), (50, 4, 3, 0.0), (50, 5, 5, 0.0)]


def test_ann_codes_decide_on_the_given_vectors(spark, monkeypatch):
    """Recall and the share of rows that get an exact cosine, on the tables given; several shelves and parts give the same."""
    folder = "/root/testdata/sf0.01"
    found = queries.op8_ann(spark, folder).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toArrow()
    ids, x = table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits, asked = 0, np.flatnonzero(ids % 50 == 0)
    for i in asked:
        score = x @ x[i]
        score[i] = -2
        hits += len(set(ids[np.lexsort((ids, -score))[:5]].tolist()) & {r["vec_id"] for r in found if r["query_id"] == ids[i]})
    assert hits >= 0.9 * 5 * len(asked)
    share = {r["query_id"]: r["n_exact"] / len(ids) for r in found}
    assert np.mean(list(share.values())) < 0.2
    monkeypatch.setattr(ann, "SHELF", 60)
    monkeypatch.setattr(ann, "QUERIES", 3)
    again = queries.op8_ann(spark, folder).collect()
    plain = lambda rows: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in rows)
    assert plain(again) == plain(found)
    exact = ann.search(spark.read.parquet(f"{folder}/embeddings.parquet"), lambda c: c % 50 == 0, probe=1.0).collect()
    for i in asked:
        score = x @ x[i]
        score[i] = -2
        assert ids[np.lexsort((ids, -score))[:5]].tolist() == [r["vec_id"] for r in sorted(exact, key=lambda r: r["rank"]) if r["query_id"] == ids[i]]
