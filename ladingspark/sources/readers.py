"""Where papers, rules and articles are read from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogs import policy as P
from ..operators.pages import suffix


def files(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """path, length, content, kind ('image', 'pdf') of the papers in a folder, once each; most: the first so many by path."""
    pattern = "*.{" + ",".join(f"{s[1:]},{s[1:].upper()}" for s in (".pdf", *P.IMAGES)) + "}"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    rows = gated(rows).filter("kind is not null")
    return rows if most is None else rows.orderBy("path").limit(most)


def gated(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows with kind: image, pdf, or null for what can't be read."""
    return rows.withColumn("kind", F.when(suffix(path).isin(*P.IMAGES), "image").when(suffix(path) == ".pdf", "pdf"))


def upload_type(path: str) -> Column:
    """Media type of an upload that is taken, else null."""
    pairs = [F.lit(x) for item in P.UPLOADS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def decoded(content: str) -> Column:
    """Bytes as text: UTF-8 if they are that, else the Korean code page, what doesn't fit left out."""

    @F.pandas_udf("string")
    def korean(column: pd.Series) -> pd.Series:
        return column.map(lambda b: b if b is None else bytes(b).decode("cp949", errors="ignore"))

    good = F.is_valid_utf8(F.col(content).cast("string"))
    return F.when(good, F.col(content).cast("string")).otherwise(korean(F.when(~good, F.col(content))))


def payloads(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with text and data: the text if it is JSON, else null."""
    return rows.withColumn("text", decoded(content)).withColumn("data", F.when(F.try_parse_json("text").isNotNull(), F.col("text")))


def page_texts(rows: DataFrame, pages: Column) -> DataFrame:
    """doc_id, page_number, raw_text, n_chars from an array of texts; a paper without pages has one empty page."""
    one = F.when(F.size(pages) > 0, pages).otherwise(F.array(F.lit("")))
    out = rows.select("doc_id", F.posexplode(one).alias("page_number", "raw_text"))
    return out.select("doc_id", (F.col("page_number") + 1).alias("page_number"), F.coalesce("raw_text", F.lit("")).alias("raw_text")).withColumn("n_chars", F.length("raw_text"))


def layout_texts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's folder), full_text: a converter's text files by path, an empty line between. Files without a byte give nothing, nor a row if a folder has no others."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), "value")
    doc = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    parts = F.array_sort(F.collect_list(F.struct("path", "value")))
    return rows.groupBy(doc.alias("doc_id")).agg(parts.alias("_p")).select("doc_id", F.array_join(F.transform("_p", lambda p: p["value"]), "\n\n").alias("full_text"))


def preferences(spark: SparkSession, path: str, default: str = "") -> str:
    """A file of preferences whole, or the default if there is none. One small file, read by Spark."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return default
        raise
    return row["value"] if row else default


def results(spark: SparkSession, path: str) -> DataFrame:
    """Saved results, one JSON object a file or a line."""
    return spark.read.option("multiLine", "true").json(path)


RULE_COLUMNS = ("jurisdiction", "law", "articles", "summary", "case", "example")


def rule_map(spark: SparkSession, path: str) -> DataFrame:
    """Mandatory rules from CSV with a header; a byte-order mark and quoted lists of articles are taken care of."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", quote='"', escape='"')
    bare = [F.trim(F.regexp_replace(F.col(f"`{c}`"), "﻿", "")).alias(n) for c, n in zip(rows.columns, RULE_COLUMNS, strict=True)]
    return rows.select(*bare)


ERROR_LOG = "timestamp string, query string, contract_year int, first_draft string, critic_feedback string, final_judgment string, logs array<string>"


def error_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ERROR_LOG).json(path)


TRUTH = "document struct<title:string,sub_documents:array<struct<article:int,is_article_title:boolean,type:string,contents:array<struct<text:string>>>>>"


def truth_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name), document."""
    rows = spark.read.schema(TRUTH).option("multiLine", "true").json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("doc_id"), "document")


def law_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """articles, laws, metadata, edges and vectors, each a Parquet table in the folder (or any table that spark.read reads)."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("articles", "laws", "metadata", "edges", "vectors")}
