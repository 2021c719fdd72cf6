"""What is kept: inputs with their digests, results, logs, encrypted texts, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogs import policy as P


def input_records(files: DataFrame, content: str = "content") -> DataFrame:
    """files with sha256, n_bytes and the file's name, without the content."""
    return files.withColumns({"sha256": F.sha2(content, 256), "n_bytes": F.octet_length(content), "name": F.regexp_extract("path", r"([^/]+)$", 1)}).drop(content)


def save(results: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = (), mode: str = "append") -> None:
    """Results as parquet or json, in folders by the columns given."""
    results.write.mode(mode).partitionBy(*by).format(form).save(path)


def final_json(results: DataFrame) -> DataFrame:
    """One column, value: each row as a JSON object."""
    return results.select(F.to_json(F.struct("*")).alias("value"))


def not_done(inputs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inputs without a result yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def stage_summary(inputs: DataFrame, stages: Mapping[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """key and, for each stage, whether the input is in its table."""
    out = inputs.select(key).distinct()
    for name, table in stages.items():
        out = out.join(table.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out


def without(table: DataFrame, cleared: DataFrame, key: str = "doc_id") -> DataFrame:
    """A stage's table without the documents that are cleared."""
    return table.join(cleared.select(key).distinct(), key, "left_anti")


def log_lines(events: DataFrame, message: Column, level: str = "INFO") -> DataFrame:
    return events.select(F.current_timestamp().alias("at"), F.lit(level).alias("level"), message.alias("message"))


def encrypted(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """name, category, ciphertext: AES-GCM with a random vector; key: 16, 24 or 32 bytes, from configuration."""
    return texts.select("name", "category", F.aes_encrypt(F.col(text).cast("binary"), F.lit(key).cast("binary")).alias("ciphertext"))


def decrypted(store: DataFrame, key: str) -> DataFrame:
    """name, category, text; null where the key or the bytes are wrong."""
    return store.select("name", "category", F.try_aes_decrypt("ciphertext", F.lit(key).cast("binary")).cast("string").alias("text"))


def wiped(store: DataFrame, names: DataFrame, category: str = "docs") -> DataFrame:
    """The store without the names in a category; with a paper goes the report of the same name."""
    gone = ("docs", "reports") if category == "docs" else (category,)
    doomed = names.select("name", F.explode(F.array(*map(F.lit, gone))).alias("category")).distinct()
    return store.join(doomed, ["name", "category"], "left_anti")


def listed(store: DataFrame, category: str = "docs") -> DataFrame:
    return store.filter(F.col("category") == category).select("name")


def risk_counts(findings: DataFrame, by: Sequence[str] = (), level: str = "risk_level") -> DataFrame:
    """Findings a level; null is the lowest, levels that are none of the three are not counted."""
    given = F.coalesce(F.col(level), F.lit(P.NO_RISK))
    names = ("high", "middle", "low")
    return findings.groupBy(*by).agg(*[F.count(F.when(given == risk, 1)).alias(name) for risk, name in zip(P.RISKS, names, strict=True)])
