"""Readers, stores and options: nulls, empty and repeated rows, empty tables."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from ladingspark.operators import clean, extract, pages, papers, validate
from ladingspark.plans import document
from ladingspark.sources import readers, store
from ladingspark.streaming import folder


def one(spark, column, rows, kind="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], kind).select(column).collect()]


def test_page_texts(spark):
    rows = spark.createDataFrame([(1, ["a", None, ""]), (2, []), (3, None), (1, ["a"])], "doc_id long, t array<string>")
    got = sorted(tuple(r) for r in readers.page_texts(rows, F.col("t")).collect())
    assert got == [(1, 1, "a", 1), (1, 1, "a", 1), (1, 2, "", 0), (1, 3, "", 0), (2, 1, "", 0), (3, 1, "", 0)]


def test_files_of_texts_results_and_truth(spark, tmp_path):
    for name, text in (("d1/b.txt", "second\nline"), ("d1/a.txt", "first"), ("d2/x.txt", "x"), ("d3/empty.txt", ""), ("d2/y.md", "not read")):
        (tmp_path / "texts" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "texts" / name).write_text(text)
    assert {r["doc_id"]: r["full_text"] for r in readers.layout_texts(spark, str(tmp_path / "texts")).collect()} == {"d1": "first\n\nsecond\nline", "d2": "x"}
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "r.json").write_text(json.dumps({"doc_id": 1, "full_text": "N0. 1", "blocks": None}, indent=1))
    assert readers.results(spark, str(tmp_path / "results")).select("doc_id", "full_text").collect() == [(1, "N0. 1")]
    (tmp_path / "truth").mkdir()
    article = {"article": 1, "is_article_title": True, "type": "TEXT", "contents": [{"text": "Purpose"}]}
    (tmp_path / "truth" / "case.v1.json").write_text(json.dumps({"document": {"title": "t", "sub_documents": [article]}}, indent=1))
    truth = readers.truth_documents(spark, str(tmp_path / "truth")).first()
    assert truth["doc_id"] == "case.v1" and truth["document"]["sub_documents"][0]["contents"][0]["text"] == "Purpose"


def test_law_tables_and_error_log(spark, tmp_path):
    for name in ("articles", "laws", "metadata", "edges", "vectors"):
        spark.range(2).withColumnRenamed("id", name).write.parquet(str(tmp_path / name))
    assert {n: df.columns for n, df in readers.law_tables(spark, str(tmp_path)).items()} == {n: [n] for n in ("articles", "laws", "metadata", "edges", "vectors")}
    (tmp_path / "log.jsonl").write_text('{"query": "q", "contract_year": 2024, "logs": ["a", "b"], "other": 1}\n{"query": null}\n')
    assert [(r["query"], r["contract_year"], r["logs"]) for r in readers.error_log(spark, str(tmp_path / "log.jsonl")).collect()] == [("q", 2024, ["a", "b"]), (None, None, None)]


def test_saved_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "doc_id long, kind string, v string")
    store.save(rows, str(tmp_path / "out"), by=("kind",))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select("doc_id", "kind").collect()) == [(1, "a"), (2, "b")]
    store.save(rows.limit(0), str(tmp_path / "out"), mode="overwrite")
    store.save(rows, str(tmp_path / "json"), form="json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert [json.loads(r["value"]) for r in store.final_json(rows).collect()] == [{"doc_id": 1, "kind": "a"}, {"doc_id": 2, "kind": "b", "v": "x"}]
    line = store.log_lines(rows, F.concat(F.lit("done "), "kind"), "WARN").first()
    assert line["level"] == "WARN" and line["message"] == "done a" and line["at"]


def test_cleared_and_listed(spark):
    table = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    cleared = spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")
    assert [r[0] for r in store.without(table, cleared).collect()] == [1, None] or sorted(store.without(table, cleared).collect(), key=str) == [(1,), (None,)]
    kept = spark.createDataFrame([("a", "docs"), ("a", "reports"), ("b", "docs"), (None, "docs")], "name string, category string")
    assert [r[0] for r in store.listed(kept).collect()] == ["a", "b", None] and store.listed(kept.limit(0)).count() == 0


def test_normalised_results_and_codes(spark):
    block = "array<struct<text:string,confidence:double,bbox_aabb:array<int>>>"
    rows = spark.createDataFrame([("Invoice N0: 7", [("B/L NO. 1", 0.5, [1, 2, 3, 4])]), (None, None), ("", [])], f"full_text string, blocks {block}")
    got = clean.normalize_result(rows).collect()
    assert [(r["full_text"], r["full_text_raw"]) for r in got] == [("Invoice No: 7", "Invoice N0: 7"), (None, None), ("", "")]
    assert got[0]["blocks"][0]["text_raw"] == "B/L NO. 1" and got[0]["blocks"][0]["text"].startswith("B/L No") and got[1]["blocks"] is None and got[2]["blocks"] == []
    assert one(spark, clean.fix_hs_code("s"), ["85O4.4O", " 8504.40.90 ", "none", "", None])[0] == "8504.40"
    assert one(spark, clean.fix_hs_code("s"), ["none", "", None]) == ["none", "", None]
    assert one(spark, clean.clean_value("s"), ["  ACME CO., LTD.,, ", "x (open", "x (shut)", "", None]) == ["ACME CO., LTD", "x", "x (shut)", "", None]
    assert one(spark, clean.clean_value("s", until_cell=True), ["a | b", "a\tb"]) == ["a", "a"]


def test_texts_of_stored_readings(spark):
    paper = "COMMERCIAL INVOICE\nInvoice No: INV-1\nTotal Amount: USD 5,000.00"
    rows = spark.createDataFrame([(1, paper, "other"), (2, "", paper), (3, None, paper), (4, None, None)], "doc_id long, full_text string, raw_text string")
    got = {r["doc_id"]: r for r in document.read_results(rows).collect()}
    assert [got[k]["doc_type"] for k in (1, 2, 3, 4)] == ["CommercialInvoice", "Unknown", "CommercialInvoice", "Unknown"]
    assert got[1]["fixed_fields"]["invoice_no"] == got[3]["fixed_fields"]["invoice_no"] == "INV-1" and got[2]["text"] == got[1]["text"] and got[4]["text"] == ""
    assert len(got[2]["common"]["amounts"]) == 1 and got[2]["key_fields"] == {}


def test_confidences(spark):
    texts = ["", "Seller: ACME TRADING CO\nBuyer: OTHER IMPORT LTD\n2026-01-02 FOB BUSAN USD 5,000.00", "2026-01-02", None]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("c", extract.common_fields("s"))
    some, none = (rows.select(extract.base_confidence("c", F.lit(x)).alias("x")).collect() for x in (True, False))
    assert [round(r["x"], 2) for r in none] == [0.0, 0.45, 0.15, 0.0] and [round(r["x"], 2) for r in some] == [0.3, 0.75, 0.45, 0.3]
    credits = spark.createDataFrame([("",), (None,), ("nothing in it",)], "text string")
    assert [r["confidence"] for r in papers.parse_credit(credits).collect()] == [0.0, 0.0, 0.0]


def test_options(spark):
    files = spark.createDataFrame([("/a.PDF", True), ("/b.pdf", False), ("/c.png", None), ("/d", None)], "path string, is_text boolean")
    engines = lambda **o: [r["engine"] for r in pages.routed(files, **o).collect()]
    assert engines() == ["odl", "paddle", "odl", "paddle"] and engines(force=F.lit("paddle"), has_out_dir=F.lit(False)) == ["paddle"] * 4
    assert engines(force=F.lit("odl")) == ["odl"] * 4 and engines(has_out_dir=F.lit(False)) == ["paddle"] * 4
    odd = "§¶†‡" * 40
    texts = spark.createDataFrame([(1, 1, odd, "merged " * 30), (2, 1, odd, "merged " * 30), (2, 2, "x", "m")], "doc_id long, page_number int, raw_text string, merged_text string")
    modes = lambda **o: sorted((r["doc_id"], r["page_number"], r["mode"]) for r in pages.hybrid_pages(texts, **o).collect())
    assert modes() == [(1, 1, "triangular_merge"), (2, 1, "triangular_merge"), (2, 2, "triangular_merge")]
    assert modes(always_test=False) == [(1, 1, "odl"), (2, 1, "triangular_merge"), (2, 2, "triangular_merge")]
    days = spark.createDataFrame([("2026-01-02", "2026-01-10"), ("2026-1-9", "2026-01-10"), (None, "2026-01-10")], "a string, b string")
    status = lambda **o: [r[0] for r in days.select(validate.check_dates(F.col("a"), F.col("b"), **o)["status"]).collect()]
    assert status() == ["PASS", "FAIL", "UNKNOWN"] and status(as_dates=True) == ["PASS", "PASS", "UNKNOWN"]


def test_failures_by_window(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [(at + datetime.timedelta(minutes=m), s) for m, s in ((1, "FAIL"), (2, "FAIL"), (2, None), (12, "PASS"), (200, "PASS"))]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame(rows, "at timestamp, status string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("at timestamp, status string").parquet(source)
    folder.process(stream, lambda s: folder.failures_by_window(s).select(F.col("window.start").alias("start"), "status", "n"), out, checkpoint).awaitTermination(120)
    got = sorted(((r["start"] - at).seconds // 60, r["status"] or "", r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, "", 1), (0, "FAIL", 2), (10, "PASS", 1)]  # the last window is still open
