"""One record a document: from stored readings of its pages to the final JSON, where what can't be read becomes a row that says why.

No document is lost: each has one row with status `ok`, `error` or `skipped`. A document that fails a
step takes no part in the later ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import Stages, attempted
from . import document

#: A stored reading: the engine that made it and its pages.
READING = "engine string, pages array<struct<page_number:int,raw_text:string,n_blocks:bigint,avg_confidence:double>>"


def text_of_bytes(content: bytes) -> str:
    """Bytes as UTF-8, else as the Korean code page; raises if they are neither."""
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("cp949")


def readings(files: DataFrame, decode: Callable[[bytes], str] = text_of_bytes, done: DataFrame | None = None) -> DataFrame:
    """files (doc_id, content) with sha256, status, error and reading; done (doc_id) are skipped."""
    out = files.withColumn("sha256", F.sha2("content", 256))
    if done is not None:
        out = out.join(done.select("doc_id").distinct().withColumn("_done", F.lit(True)), "doc_id", "left")
    else:
        out = out.withColumn("_done", F.lit(None).cast("boolean"))
    out = out.withColumn("_text", attempted(decode)(F.when(F.col("_done").isNull(), F.col("content"))))
    given = F.from_json("_text.value", READING + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = out.withColumn("_read", given)
    numbers = F.transform("_read.pages", lambda p: p["page_number"])
    blank = F.trim(F.coalesce("_text.value", F.lit(""))) == ""
    cause = (
        F.when(F.col("_done"), F.lit(None)).when(F.col("content").isNull(), "no content").when(F.col("_text.error").isNotNull(), F.concat(F.lit("not decoded: "), F.split("_text.error", ":")[0]))
        .when(blank, "no content").when(F.col("_read").isNull() | F.col("_read._corrupt").isNotNull(), "not a reading in JSON").when(F.coalesce(F.size("_read.pages"), F.lit(0)) < 1, "no pages")
        .when(F.exists(numbers, lambda n: n.isNull()), "a page without a number").when(F.size(F.array_distinct(numbers)) < F.size(numbers), "a page number given twice")
    )
    out = out.withColumn("error", cause)
    status = F.when(F.col("_done"), "skipped").when(F.col("error").isNotNull(), "error").otherwise("ok")
    return out.withColumn("status", status).withColumn("reading", F.when(F.col("status") == "ok", F.struct("_read.engine", "_read.pages"))).drop("_done", "_text", "_read", "content")


def measured(read: DataFrame) -> DataFrame:
    """Good readings with engine, n_pages, total_blocks, total_chars, avg_confidence (by blocks) and text: the pages in the order of their numbers."""
    pages = F.array_sort("reading.pages")
    sum_ = lambda each: F.aggregate("_pages", F.lit(0.0), lambda s, p: s + F.coalesce(each(p).cast("double"), F.lit(0.0)))
    out = read.withColumn("_pages", pages)
    blocks = sum_(lambda p: p["n_blocks"])
    weighted = sum_(lambda p: p["n_blocks"] * p["avg_confidence"])
    return out.withColumns({
        "engine": F.col("reading.engine"), "n_pages": F.size("_pages").cast("bigint"), "total_blocks": blocks.cast("bigint"),
        "total_chars": sum_(lambda p: F.length(p["raw_text"])).cast("bigint"),
        "avg_confidence": F.coalesce(F.try_divide(weighted, blocks), F.lit(0.0)),
        "text": F.array_join(F.transform("_pages", lambda p: F.coalesce(p["raw_text"], F.lit(""))), "\n\n"),
    }).drop("_pages", "reading")


def records(files: DataFrame, decode: Callable[[bytes], str] = text_of_bytes, done: DataFrame | None = None, stages: Stages | None = None) -> DataFrame:
    """doc_id, status, error, document_type, n_pages, parse_confidence, warnings and record, the whole as JSON (null unless ok).

    files: doc_id, content (the stored reading's bytes); repeated rows each give a row. stages takes what each stage did.
    """
    stages = stages or Stages()
    failed = F.col("status") == "error"
    read = stages.store("read", readings(files, decode, done), failed)
    good = stages.store("parse", document.read_papers(measured(read.filter("status = 'ok'")).withColumn("_raw", F.col("text"))), F.lit(False))
    changed = F.map_filter("key_fields", lambda k, v: ~v.eqNullSafe(F.try_element_at("fixed_fields", k)))
    diff = F.map_zip_with(changed, F.map_filter("fixed_fields", lambda k, v: F.map_contains_key(changed, k)), lambda k, a, b: F.struct(a.alias("before"), b.alias("after")))
    whole = F.struct(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("ok").alias("status"), F.col("doc_type").alias("document_type"),
        F.struct(F.col("type_confidence").alias("confidence"), "needs_recheck").alias("classification"),
        F.struct("confidence", "common", F.col("fixed_fields").alias("key_fields"), F.map_filter(diff, lambda k, v: v.isNotNull()).alias("changes"), "warnings").alias("parse"),
        F.struct("engine", "n_pages", "total_blocks", "total_chars", "avg_confidence").alias("ocr_quality"),
        F.struct(F.col("sha256").alias("input_sha256")).alias("traceability"), F.col("text").alias("full_text"), F.col("_raw").alias("full_text_raw"),
    )
    ok = good.select("doc_id", "status", "error", F.col("doc_type").alias("document_type"), "n_pages", F.col("confidence").alias("parse_confidence"), "warnings", F.to_json(whole).alias("record"))
    out = ok.unionByName(read.filter("status <> 'ok'").select("doc_id", "status", "error"), allowMissingColumns=True)
    return stages.store("record", out, failed)
