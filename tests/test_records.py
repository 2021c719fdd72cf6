"""Records with their faults, observed stages, and results kept batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ladingspark.functions.stages import Stages, attempted
from ladingspark.plans import record
from ladingspark.sources import ledger

FILES = "doc_id long, content binary, status string"
INPUT = "doc_id long, sha256 string, text string"


def reading(*pages):
    return json.dumps({"engine": "odl", "pages": [dict(zip(("page_number", "raw_text", "n_blocks", "avg_confidence"), p, strict=True)) for p in pages]}).encode()


def test_every_document_has_a_row(spark):
    rows = [
        (1, reading((2, "b", 1, 0.5), (1, "COMMERCIAL INVOICE", 3, 0.9))), (2, None), (3, b""), (4, b"\xff\xff"), (5, b"[1"), (6, reading()), (7, reading((None, "x", 1, 1.0))),
        (8, reading((1, "x", 1, 1.0), (1, "y", 1, 1.0))), (9, "가나".encode("cp949")), (10, reading((1, None, None, None))), (1, b"{}"), (11, b'{"pages": 3}'), (12, reading((1, "x" * 3_000_000, 1, 1.0))),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], FILES)
    seen = Stages()
    got = record.records(files, stages=seen).collect()
    errors = sorted((r["doc_id"], r["error"]) for r in got if r["status"] == "error")
    not_json, none = "not a reading in JSON", "no pages"
    assert errors == [(1, none), (2, "no content"), (3, "no content"), (4, "not decoded: UnicodeDecodeError"), (5, not_json), (6, none), (7, "a page without a number"), (8, "a page number given twice"), (9, not_json), (11, not_json)]
    good = {r["doc_id"]: json.loads(r["record"]) for r in got if r["status"] == "ok"}
    assert set(good) == {1, 10, 12} and good[1]["full_text_raw"] == "COMMERCIAL INVOICE\n\nb" and good[1]["document_type"] == "CommercialInvoice"
    assert good[1]["ocr_quality"] == {"engine": "odl", "n_pages": 2, "total_blocks": 4, "total_chars": 19, "avg_confidence": 0.8}
    assert good[10]["ocr_quality"]["avg_confidence"] == 0.0 and good[12]["ocr_quality"]["total_chars"] == 3_000_000
    assert [(s[1], s[2], s[3]) for s in seen.seen] == [("read", 13, 10), ("parse", 3, 0), ("record", 13, 10)]


def test_done_documents_and_empty_tables(spark):
    files = spark.createDataFrame([(1, b"{", ""), (2, reading((1, "x", 1, 1.0)), "")], FILES)
    got = {r["doc_id"]: r["status"] for r in record.records(files, done=files.filter("doc_id = 1")).collect()}
    assert got == {1: "skipped", 2: "ok"}
    seen = Stages()
    assert record.records(files.limit(0), stages=seen).count() == 0
    assert [(s[1], s[2], s[3]) for s in seen.seen] == [("read", 0, 0), ("parse", 0, 0), ("record", 0, 0)]


def test_attempts_fail_by_row(spark):
    rows = spark.createDataFrame([("1",), ("x",), (None,), ("3",)], "s string")
    got = [r["a"] for r in rows.select(attempted(int, "bigint")("s").alias("a")).collect()]
    assert [r["value"] for r in got] == [1, None, None, 3] and [bool(r["error"]) for r in got] == [False, True, False, False]


def inputs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha256", F.sha2("text", 256))


def lengths(rows):
    return rows.select("doc_id", "sha256", F.length("text").cast("long").alias("n"))


def now(spark, folder):
    return sorted((r["doc_id"], r["n"], r["batch"]) for r in ledger.current(spark, folder, "doc_id long, sha256 string, n long").collect())


def test_reruns_and_replays_give_the_same_table(spark, tmp_path):
    at = str(tmp_path / "ledger")
    assert ledger.current(spark, at, INPUT).count() == 0
    ledger.run(inputs(spark, [(1, "a"), (2, "b"), (2, "b"), (3, None)]), at, 0, lengths)
    first = now(spark, at)
    assert first == [(1, 1, 0), (2, 1, 0), (3, None, 0)]
    ledger.run(inputs(spark, [(1, "a"), (2, "b"), (3, None)]), at, 1, lengths)
    assert now(spark, at) == first
    changed = inputs(spark, [(1, "a"), (2, "bb"), (4, "dddd")])
    for _ in range(2):  # the second time is a replay
        ledger.run(changed, at, 2, lengths)
        assert now(spark, at) == [(1, 1, 0), (2, 2, 2), (3, None, 0), (4, 4, 2)]
        assert ledger.batches(spark, at, INPUT).count() == 5
    ledger.run(inputs(spark, [(2, "b")]), at, 3, lengths)  # back to what it was: done again
    assert now(spark, at)[1] == (2, 1, 3)


def test_a_stream_into_the_ledger(spark, tmp_path):
    source, at, checkpoint = (str(tmp_path / x) for x in ("in", "ledger", "checkpoint"))
    inputs(spark, [(1, "a"), (2, "b")]).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("doc_id long, text string, sha256 string").parquet(source)
    ledger.streamed(stream(), at, checkpoint, lengths).awaitTermination(120)
    inputs(spark, [(2, "b"), (1, "aa")]).coalesce(1).write.mode("append").parquet(source)
    ledger.streamed(stream(), at, checkpoint, lengths).awaitTermination(120)
    want = [(1, 2, 1), (2, 1, 0)]
    assert now(spark, at) == want
