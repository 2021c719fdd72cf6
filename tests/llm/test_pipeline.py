"""The pipeline against a brute-force version of its stages, and what is registered."""

from __future__ import annotations

import hashlib
import itertools

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ladingspark.llm import mixing, quality, queries

from .test_operators import random_texts, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    base = random_texts(150, seed=9)
    low = ["BUY NOW!!! " * 12 + t[:30] for t in base[:30]]
    near = [" ".join([*t.split()[:40], "other", *t.split()[40:]]) for t in base if len(t.split()) > 90]
    texts = base + low + near + base[:8] + [None, "", ""]
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "a text without a number", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 150 <= i < 180), int(i % 40 == 1)) for i in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(i, u, "") for i, u in enumerate(["http://a.net/x", "http://example.net/en/", None, "http://b.example.com/de/q?x", "https://w.org/fr/1#z", "HTTP://c.NET", "x"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def similar(a: str, b: str) -> float:
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    x, y = cut(words(a)), cut(words(b))
    return len(x & y) / len(x | y)


def test_stages_against_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        if k < 3:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    judged, alone, mixed, encoded = kept
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    first = spark.read.parquet(f"{tables}/documents.parquet")
    assert len(judged) == quality.classify(first, labels).filter("not rejected").count()
    assert not {r["doc_id"] for r in judged} & set(range(150, 180))  # low quality goes
    assert len([r for r in judged if r["doc_id"] is not None and r["doc_id"] < 150 and r["doc_id"] % 40 != 1]) >= 140  # clean stays
    ids = [r["doc_id"] for r in alone]
    assert len(ids) == len(set(ids))
    full = {r["doc_id"]: r["text"] or "" for r in judged}
    for a, b in itertools.combinations(ids, 2):
        assert similar(full[a], full[b]) < 0.8 or not full[a].strip()
    for r in judged:  # nothing goes but what has a smaller near-copy
        if r["doc_id"] not in ids:
            assert any((i or 0) < r["doc_id"] and similar(full[i], full[r["doc_id"]]) >= 0.6 for i in ids if i is not None)
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(spark.read.parquet(f"{tmp_path}/1")).collect()}
    assert sorted(r["doc_id"] or -1 for r in mixed) == sorted(k or -1 for k, n in copies.items() for _ in range(n))
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in mixed}
    assert len(encoded) == len(mixed)
    for r in encoded:
        want = real.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want and r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert corpus_pipeline.run(spark, tables).count() == len(encoded)


def test_empty_tables(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_mixing", "op9_sharding"])
def test_sql_twins(spark, tables, name, monkeypatch):
    if name == "op9_sharding":  # a small limit: shards split, and equal rows fill pages
        monkeypatch.setattr(queries, "SHARD_BYTES", 300)
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{tables}/{table}.parquet/*.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    columns = found.columns
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [(v is not None, v) for v in r])
    got = queries.queries()[name](spark, tables)
    assert sorted(got.columns) == sorted(columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(found.fetchall())


def test_registration():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "source_mixing", "bpe_encoding"]
