"""URL filters by a sorted array of digests.

Rules (host, path) become 64-bit xxhash keys, sorted in a file that every task maps into memory.
A url asks for its host's last labels, as many as some rule's host has, with each path prefix that
is as long as some rule's; a vectorised binary search finds the keys, and the stored rule itself
must then equal what was asked, so that a collision can't decide. Defined results: a null url, or
one without "://", has empty host and path and fits no rule; a url of any length is judged whole,
and asks no more than there are pairs of such numbers; repeated rows give repeated results; an
empty table gives no row; other columns are not looked at; without rules every url gets the default
verdict.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A digest file over this size is not sent to the executors; the join below takes its place.
MOST_BYTES = 256 << 20


def parsed(urls: DataFrame, id_column: str) -> DataFrame:
    """id, host, path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    has = F.instr(url, "://") > 0
    rest = F.when(has, F.expr("substring(coalesce(cast(url as string), ''), instr(coalesce(cast(url as string), ''), '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.select(id_column, lowered.alias("host"), path.alias("path"))


def digest_file(rules: Sequence[tuple[str, str, str]]) -> bytes:
    """Sorted keys, then for each the place of its rule, then the rules' text.

    Layout: count; keys (uint64); starts (uint64, one more than keys); UTF-8 of "host<NUL>path<NUL>verdict".
    """
    keyed = sorted((xxhash.xxh64_intdigest(f"{h}\0{p}".encode()), f"{h}\0{p}\0{v}".encode()) for h, p, v in dict.fromkeys(rules))
    keys = np.array([k for k, _ in keyed], np.uint64)
    starts = np.cumsum([0, *(len(t) for _, t in keyed)]).astype(np.uint64)
    return np.uint64(len(keys)).tobytes() + keys.tobytes() + starts.tobytes() + b"".join(t for _, t in keyed)


class DigestArray:
    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view(np.uint64)[0])
        self.keys = whole[8 : 8 + 8 * n].view(np.uint64)
        self.starts = whole[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.text = whole[16 + 16 * n :]

    def look_up(self, asked: list[str]) -> list[str | None]:
        """The verdict of each "host<NUL>path" that is a rule, else None."""
        keys = np.fromiter((xxhash.xxh64_intdigest(a.encode()) for a in asked), np.uint64, len(asked))
        at = np.searchsorted(self.keys, keys, "left")
        out: list[str | None] = [None] * len(asked)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == keys) if len(self.keys) else np.zeros(len(asked), bool))
        for i in hit.tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # equal keys of other strings stand beside it
                host, path, verdict = bytes(self.text[int(self.starts[j]) : int(self.starts[j + 1])]).decode().split("\0")
                if f"{host}\0{path}" == asked[i]:
                    out[i] = verdict
                    break
                j += 1
        return out


def send_file(spark: SparkSession, content: bytes) -> str:
    """Spark's own file distribution; the name holds the content's digest, so that it is sent once."""
    name = f"rules-{hashlib.sha256(content).hexdigest()[:24]}.digests"
    if any(sent.rsplit("/", 1)[-1] == name for sent in spark.sparkContext.listFiles):
        return name
    path = os.path.join(tempfile.mkdtemp(), name)
    with open(path, "wb") as f:
        f.write(content)
    spark.sparkContext.addFile(path)
    return name


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]], id_column: str = "page_id", default: str = "allow") -> DataFrame:
    """id, host, path, rule ("host" + "path", else null), verdict.

    rules: (host, path, "block" or "allow"); a path may be empty or "/". A rule fits its host and all subdomains if the
    url's path starts with the rule's; the longest host wins, then the longest path, where the
    two together are equally long; else the longest together. If two rules have the same host
    and path, "block" wins.
    """
    firm: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if firm.get((host, path)) != "block":
            firm[host, path] = verdict
    content = digest_file([(h, p, v) for (h, p), v in firm.items()])
    if len(content) > MOST_BYTES:
        raise ValueError(f"the rules take {len(content)} bytes; judge_by_join takes any number")
    lengths, depths = sorted({len(p) for _, p in firm}), sorted({h.count(".") + 1 for h, _ in firm})
    deepest = max(depths, default=0)
    name = send_file(urls.sparkSession, content)
    rows = parsed(urls, id_column)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                hosts, paths = part.column("host").to_pylist(), part.column("path").to_pylist()
                asked, owner = [], []
                for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                    labels = host.rsplit(".", deepest) if host else []
                    for k in depths:
                        if k > len(labels):
                            break
                        parent = ".".join(labels[-k:])
                        for n in lengths:
                            if n <= len(path):
                                asked.append(f"{parent}\0{path[:n]}")
                                owner.append(i)
                best: dict[int, tuple[int, int, str, str]] = {}
                for i, question, verdict in zip(owner, asked, array.look_up(asked), strict=True):
                    if verdict is not None:
                        host, path = question.split("\0")
                        found = (len(host) + len(path), len(host), host + path, verdict)
                        best[i] = max(best.get(i, found), found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), part.column("host"), part.column("path"), pa.array([best[i][2] if i in best else None for i in range(len(hosts))], pa.string()), pa.array([best[i][3] if i in best else default for i in range(len(hosts))], pa.string())],
                    names=[id_column, "host", "path", "rule", "verdict"],
                )

    return rows.mapInArrow(run, f"{id_column} {kind}, host string, path string, rule string, verdict string")


def judge_by_join(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", default: str = "allow") -> DataFrame:
    """As `judge`, for rules (host, path, verdict) of any number, by a shuffled join on the asked strings.

    Distinct (host, path) pairs are judged once, so that a host with many urls is not one task;
    at most 64 distinct path lengths and 64 numbers of labels are taken (ValueError beyond).
    """
    dots = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    distinct = lambda n: [r[0] for r in rules.select(n.alias("n")).distinct().limit(65).collect()]
    lengths, depths = distinct(F.length("path")), distinct(dots(F.col("host")) + 1)
    if max(len(lengths), len(depths)) > 64:
        raise ValueError("rules with more than 64 distinct path lengths or numbers of labels")
    rows = parsed(urls, id_column)
    pairs = rows.select("host", "path").distinct()
    parents = F.array_compact(F.array(*[F.when(dots(F.col("host")) >= k - 1, F.substring_index("host", ".", -k)) for k in depths]))
    asked = pairs.filter("host <> ''").withColumn("_h", F.explode(parents)).withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths])))
    asked = asked.filter(F.col("_n") <= F.length("path")).withColumn("_p", F.expr("substring(path, 1, _n)"))
    firm = rules.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max("verdict").alias("_v"))
    hits = asked.join(firm, ["_h", "_p"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct((F.length("_h") + F.length("_p")).alias("a"), F.length("_h").alias("b"), F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict"))).alias("_best"))
    return rows.join(best, ["host", "path"], "left").select(id_column, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
