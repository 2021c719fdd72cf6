"""The training-data operators against brute force, round trips and the libraries whose results they must equal."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from ladingspark.llm import ann, bpe, gru, lm, media, mixing, quality, queries, sharding, simhash, token_counts, urls

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " ", "\n\t", "Hello World", "naïve café  ça", "a  b c　d", "x" * 5000, "it's we'll 123 4567", "🙂🙃 emoji 한국어 텍스트", "<|endoftext|> inside", "tab\tand\r\nlines\n\n\n", "ab" * 700, "the same", "the same", "İı I i"]


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def documents(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), 7, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, key string")


def random_texts(n: int, seed: int = 1) -> list[str]:
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choice(vocabulary, rng.integers(5, 120))) for _ in range(n)]


def test_bpe_equals_the_tokenizers_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    real = Tokenizer.from_file(path)
    texts = ODD_TEXTS + random_texts(30) + ["  leading", "trailing  ", "a b", "'S 'LL", "ﬁne Ǆ ß", "1st 2nd", "\x00\x01\x7f", "é" * 40]
    rows = {r["doc_id"]: r for r in bpe.encode(documents(spark, texts), open(path).read()).collect()}
    for i, t in enumerate(texts):
        ids = real.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == ids, t
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded"] == real.decode(ids, skip_special_tokens=False)
    assert bpe.encode(documents(spark, []), open(path).read()).count() == 0


def test_media_round_trip_and_filters(spark):
    rows = {r["doc_id"]: r for r in media.media_columns(documents(spark, ODD_TEXTS)).collect()}
    for i, t in enumerate(ODD_TEXTS):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert rows[i]["n_bytes"] == len(data) and rows[i]["payload_bytes"] == len(payload)
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert rows[i]["tail_crc32"] == zlib.crc32(payload[-32:])
        assert rows[i]["media_sha256"] == hashlib.sha256(bytes(rows[i]["media"])).hexdigest()
    assert rows[13]["feature"] == rows[14]["feature"]
    image = np.random.default_rng(1).integers(0, 256, (7, 9), dtype=np.uint8)
    for kind in range(5):  # each filter undone
        filtered = image.astype(int).copy()
        for y in range(7):
            for x in range(9):
                a = int(image[y, x - 1]) if x else 0
                b = int(image[y - 1, x]) if y else 0
                c = int(image[y - 1, x - 1]) if x and y else 0
                paeth = min((a, b, c), key=lambda v: (abs(v - (a + b - c)), (a, b, c).index(v)))
                filtered[y, x] -= (0, a, b, (a + b) >> 1, paeth)[kind]
        assert (media.unfiltered(np.full(7, kind), filtered.astype(np.uint8)) == image).all()
    good = media.to_png(b"x" * 576)
    with pytest.raises(ValueError, match="checksum"):
        media.from_png(good[:45] + bytes([good[45] ^ 1]) + good[46:])


def brute_components(prints: list[int], radius: int) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    base = random_texts(60)
    texts = ODD_TEXTS + base + [t + " w1" for t in base[:20]] + base[:10]
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = []
    for t in texts:
        w = words(t)
        cuts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(c.encode(), 42) for c in cuts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    assert [bytes(rows[i]["fp"]).hex() for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in range(len(texts))] == brute_components(prints, 2)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_keeps_one_of_near_copies(spark):
    base = random_texts(40)
    near = [" ".join([*t.split()[:50], "changed", *t.split()[50:]]) for t in base if len(t.split()) > 80]
    docs = documents(spark, base + near + base[:5])
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))
    twice = docs.filter("doc_id < 3").unionByName(docs.filter("doc_id < 3"))
    assert simhash.deduplicated(twice).count() == 3
    assert simhash.deduplicated(documents(spark, [])).count() == 0
    nulls = simhash.deduplicated(spark.createDataFrame([(None, None, None, None, None)] * 3, docs.drop("key").schema))
    assert nulls.count() == 1


def kept_by_brute_force(texts, similarity):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    holders, root = {}, list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        for j in {j for s in own for j in holders.get(s, ())}:
            if len(own & sets[j]) / len(own | sets[j]) >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in own:
            holders.setdefault(s, []).append(i)
    return [i for i in range(len(texts)) if find(i) == i]


def test_simhash_confirms_by_exact_similarity(spark, monkeypatch):
    rng = random.Random(5)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(150):
        ten, eight, long = new(10), new(8), new(120)
        texts += [ten, [*ten[:9], *new(1)]]  # 5 of 7: under .8
        texts += [eight, eight + new(1)]  # 4 of 5: .8
        texts += [long, [*long[:30], *new(1), *long[31:60], *new(1), *long[61:]], [*long[:30], *new(1), *long[31:60], *new(1), *long[61:90], *new(1), *long[91:]]]  # .84, and .77 to the first
        texts += [[*long[:20], *new(1), *long[21:50], *new(1), *long[51:80], *new(1), *long[81:]]]
    family = new(60)
    texts += [[*family[:k], *new(1), *family[k + 1 :]] for k in range(60) for _ in range(2)]  # one component in blocks
    texts = [" ".join(t) for t in texts]
    want = kept_by_brute_force(texts, 0.8)
    docs = documents(spark, texts)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == want
    monkeypatch.setattr(simhash, "SET_BLOCK", 16)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == want


def test_simhash_counts_repeated_shingles_once(spark):
    base = [" ".join(f"{w}x{i}" for w in t.split()) for i, t in enumerate(random_texts(30)) if len(t.split()) > 40]
    docs = documents(spark, base + [f"{t} {t}" for t in base] + [f"{t} {t} {t}" for t in base])
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == list(range(len(base)))


def test_mixing_targets_and_copies(spark):
    docs = documents(spark, random_texts(300) + [None, ""], source=lambda i: None if i % 7 == 0 else f"s{i % 5}" if i % 3 else "big")
    rows = mixing.copies(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:  # water filling, by hand
        free = [s for s in order if s not in capped]
        left, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in free)
        more = {s for s in free if weight[s] * left / w >= 3 * sizes[s]}
        if not more:
            break
        capped |= more
    want = {s: 3 * sizes[s] if s in capped else weight[s] * left / w for s in order}
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    for s in order:
        assert taken[s] == pytest.approx(want[s], rel=0.35)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert sorted(mixing.copies(docs).collect()) == sorted(rows)
    assert mixing.copies(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0
    assert [r["copies"] for r in mixing.copies(documents(spark, [None, " "])).collect()] == [0, 0]


def test_sharding_limits(spark):
    docs = documents(spark, random_texts(200) + ["copy " * 40] * 3 + ["y" * 9000, None])
    equal = documents(spark, ["z" * 700]).select("text")
    for _ in range(4):
        equal = equal.unionByName(equal)
    from pyspark.sql import functions as F

    rows = sharding.shard(docs, F.octet_length(F.coalesce("text", F.lit(""))), 3000).collect()
    assert len(rows) == 205
    by_shard: dict[tuple, int] = {}
    for r in rows:
        by_shard[r["shard"], r["page"]] = by_shard.get((r["shard"], r["page"]), 0) + len((r["row"]["text"] or "").encode())
    for r in rows:
        assert by_shard[r["shard"], r["page"]] <= 3000 or r["oversize"]
    names = sorted({s for s, _ in by_shard})
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    paged = sharding.shard(equal, F.octet_length("text"), 3000).collect()
    assert len(paged) == 16 and max(Counter(r["page"] for r in paged).values()) * 700 <= 3000
    assert sharding.shard(docs.limit(0), F.octet_length("text"), 3000).count() == 0


def test_token_counts_answer_every_limit(spark):
    texts = ODD_TEXTS + random_texts(50)
    ranks = open(public_tokenizers.path("byte_bpe_50k.tiktoken")).read()
    lengths = token_counts.lengths(documents(spark, texts), ranks, public_tokenizers.PATTERN)
    real = sorted(r["length"] for r in lengths.collect())
    hist = token_counts.histogram(lengths).cache()
    assert sum(r["n_docs"] for r in hist.collect()) == len(texts)
    for r in hist.collect():
        assert r["truncated_tokens"] == sum(min(x, r["length"]) for x in real) and r["docs_longer"] == sum(x > r["length"] for x in real)
    for limit in (0, 1, 17, 10**6):
        assert token_counts.truncated(hist, limit).first()[0] == sum(min(x, limit) for x in real)
    assert token_counts.quantile(hist, 0.5).first()[0] == real[(len(real) + 1) // 2 - 1]
    assert token_counts.histogram(token_counts.lengths(documents(spark, []), ranks, public_tokenizers.PATTERN)).count() == 0


def test_url_rules(spark):
    cases = [None, "no scheme", "http://net", "http://a.NET/x", "https://example.net/en/a?b", "http://m.example.net/en", "http://xexample.com/de/", "http://w.example.com/de/x#y", "http://b.org/fr/", "://", "http://net/", "ftp://x.net?/q"]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
        fits = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        return host, path, *best

    want = {i: brute(u) for i, u in enumerate(cases)}
    assert {r[0]: tuple(r)[1:] for r in urls.judge(pages, queries.URL_RULES).collect()} == want
    table = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert {r[0]: tuple(r)[1:] for r in urls.judge_by_join(pages, table).collect()} == want
    assert urls.judge(pages, ()).filter("verdict <> 'allow'").count() == 0


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] * 24)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda c: c % 50 == 0).collect()
    unit = x.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    by_query: dict[int, list] = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append(r)
    assert sorted(by_query) == list(range(0, 3000, 50))
    hits = 0
    for q, got in by_query.items():
        scores = unit @ unit[q]
        scores[q] = -2
        best = sorted(range(3000), key=lambda i: (-scores[i], i))[:5]
        hits += len(set(best) & {r["vec_id"] for r in got})
        for r in got:
            assert r["score"] == pytest.approx(scores[r["vec_id"]], abs=1e-9)
        assert [r["rank"] for r in sorted(got, key=lambda r: (-r["score"], r["vec_id"]))] == [1, 2, 3, 4, 5]
    assert hits / (5 * len(by_query)) >= 0.9
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda c: c % 50 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>"), lambda c: c % 50 == 0).count() == 1


def test_ann_finds_neighbours_among_near_copies(spark, monkeypatch):
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda rows, n: fit(rows.filter("id >= 2500"), n))  # as if the sample had missed them
    rng = np.random.default_rng(8)
    one = rng.normal(size=64)
    x = np.concatenate([one + 0.02 * rng.normal(size=(2500, 64)), rng.normal(size=(7500, 64))])
    found = ann.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), lambda c: (c < 2500) & (c % 50 == 0)).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 2500, 50):
        near = x @ x[i]
        near[i] = -2
        hits += len({r["vec_id"] for r in found if r["query_id"] == i} & set(np.argsort(-near)[:5].tolist()))
    assert hits / 250 >= 0.95


def test_gru_is_a_distribution_and_its_gradient_is_right():
    rng = np.random.default_rng(3)
    base = np.sort(rng.dirichlet(np.ones(300)))[::-1][:200] * 0.9
    model = gru.Gru.initial(base)
    model = model.with_flat(model.flat() + rng.normal(0, 0.1, model.flat().size))
    history = rng.integers(0, 201, 30).astype(np.int32)
    alone = gru.score(model, [history])[0]
    total = sum(10 ** (gru.score(model, [np.append(history, np.int32(w))])[0] - alone) for w in range(200))
    unknown = 10 ** (gru.score(model, [np.append(history, np.int32(200))])[0] - alone) * (1 - base.sum())
    assert total + unknown == pytest.approx(1, abs=1e-4)
    texts = [rng.integers(0, 201, n).astype(np.int32) for n in (1, 5, 90, 300)]
    together, apart = gru.score(model, texts, 2), np.array([gru.score(model, [t])[0] for t in texts])
    assert together == pytest.approx(apart, abs=1e-3)  # lanes and windows change nothing: the state is carried
    pattern = [np.tile(np.array([3, 7, 1], np.int32), 200) for _ in range(30)]
    fresh = gru.Gru.initial(base)
    before = gru.score(fresh, pattern).sum()
    trainer = gru.Trainer(fresh)
    trainer.run(pattern)
    assert gru.score(trainer.model, pattern).sum() > 0.5 * before


def test_lm_base_score_and_gain(spark):
    texts = random_texts(150) + ["alpha beta " * 60] * 40 + [None, ""]
    rows = {r["doc_id"]: r for r in lm.score_documents(documents(spark, texts)).collect()}
    tokens = [[*words(t), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(w in counts for w in t), n)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
    out = [i for i in rows if held[i]]
    assert sum(rows[i]["score"] for i in out) > sum(rows[i]["base_score"] for i in out)
    assert lm.score_documents(documents(spark, [])).count() == 0


def test_quality_learns_and_shrinks(spark):
    rng = np.random.default_rng(2)
    good, bad = [f"g{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(900):
        low, toxic = i % 6 == 0, i % 7 == 0
        text = list(rng.choice(good, 40))
        if low:
            text = ["BUY", "NOW!!!"] * 15 + text[:6]
        if toxic:
            text[3:9] = rng.choice(bad[:6], 6)
        texts.append(" ".join(text))
        labels.append((i, int(not low), int(toxic)))
    docs = documents(spark, texts, source=lambda i: f"host{i % 9}")
    marks = spark.createDataFrame(labels[:600] + [(5, None, None)], "doc_id long, quality int, toxic int")
    judged = {r["row"]["doc_id"]: r for r in quality.classify(docs, marks).collect()}
    right = sum(judged[i]["rejected"] == (not q or bool(t)) for i, q, t in labels[600:])
    assert right / 300 >= 0.97
    kept = quality.kept(docs, marks)
    assert kept.columns == docs.columns and 0 < kept.count() < 900
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.kept(docs, none).count() == 900
    assert quality.kept(documents(spark, []), marks).count() == 0
    assert quality.kept(documents(spark, ODD_TEXTS, source=lambda i: None), marks).count() <= len(ODD_TEXTS)
