"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is indexed. A query
looks into the lists of its nearest centroids, where asymmetric distance tables rank the codes. The
FIRST best codes are ranked again by the exact cosine of the original vectors; the k-th best of them
then says which of the other codes could still be nearer, given each code's own error, and only
those get an exact cosine too. So the codes decide what is looked at and no neighbour in a list that
is probed is lost, however alike the vectors are. Lists lie on shelves of bounded size, a long list
on several, and the queries of a shelf go in parts: every piece of work is bounded.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those with null id or of another dimension than most; rows that share an id count as one
(the best score is kept), and never as their own neighbour; equal scores go to the smaller id; an
empty table gives no row. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Rows the model is fitted on, and bytes they may take on the driver.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
#: Lists at most (the centroids are broadcast: MOST_LISTS x dimension x 4 bytes).
MOST_LISTS = 32_768
#: Candidates on a shelf and queries in a part, about; queries whose distances to a shelf are worked out at a time.
SHELF, QUERIES, STRIP = 4096, 4096, 256
#: Codes of a query on a shelf that are ranked again before the others are judged by their errors.
FIRST = 32
#: Rounding that distances in single precision are allowed.
SLACK = 1e-4


@dataclass
class Model:
    centroids: np.ndarray  # lists x d
    books: np.ndarray  # parts x 256 x d/parts (zero-padded)
    parts: int

    def split(self, x: np.ndarray) -> np.ndarray:
        width = self.books.shape[2]
        out = np.zeros((len(x), self.parts * width), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), self.parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code (a byte a part) and error (distance of the vector from what its code stands for)."""
        at = nearest(x, self.centroids)
        residual = self.split(x - self.centroids[at])
        codes = np.stack([nearest(residual[:, p], self.books[p]) for p in range(self.parts)], axis=1).astype(np.uint8)
        return at, codes, np.sqrt(((residual - self.decoded(codes)) ** 2).sum(axis=(1, 2)))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """Residuals that the codes stand for, in parts."""
        return self.books[np.arange(self.parts)[None, :], codes]

    def distances(self, queries: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances (queries x codes) from tables of each part's products with its codebook.

        |q - c - r|^2 = |q - c|^2 - 2 q.r + (2 c.r + |r|^2): the first by list, the last by code, and
        q.r is summed from the query's tables, which serve the codes of all lists.
        """
        parted, r = self.split(queries), self.decoded(codes)
        own = 2 * (self.split(self.centroids[lists]) * r).sum(axis=(1, 2)) + (r**2).sum(axis=(1, 2))
        used, place = np.unique(lists, return_inverse=True)
        centres = self.centroids[used]
        far = (queries**2).sum(axis=1)[:, None] - 2 * queries @ centres.T + (centres**2).sum(axis=1)
        out = far.take(place, axis=1) + own
        for p in range(self.parts):
            out -= (2 * parted[:, p] @ self.books[p].T).take(codes[:, p], axis=1)
        return out


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres.astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def exact(x: np.ndarray) -> np.ndarray:
    """Scaled to length 1 by way of the largest component, so that no square under- or overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unit(x: np.ndarray) -> np.ndarray:
    return exact(x).astype(np.float32)


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine in double precision; equal rows get equal scores."""
    q, r = query.astype(np.float64), rows.astype(np.float64)
    q, r = q / np.abs(q).max(), r / np.abs(r).max(axis=1, keepdims=True)
    return (r * q).sum(axis=1) / (np.sqrt((r * r).sum(axis=1)) * np.sqrt((q * q).sum()))


def valid(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v: the vectors that take part, as arrays of float if that is what they are, else of double."""
    given = embeddings.schema[vector_column].dataType.simpleString() == "array<float>"
    v = F.col(vector_column) if given else F.col(vector_column).cast("array<double>")
    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (sizes[0] if sizes else 0))


def fit(rows: DataFrame, n: int, parts: int = 32, seed: int = 1) -> Model | None:
    """From the SAMPLE_ROWS rows with the least hash of their id; None without rows."""
    first = rows.first()
    if first is None:
        return None
    d = len(first["v"])
    take = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(take).select(F.col("v").cast("array<float>").alias("v")).toArrow()
    x = unit(sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
    lists = int(min(MOST_LISTS, max(1, round(np.sqrt(n))), len(x)))
    centroids = kmeans(x, lists, 10, seed)
    parts = min(parts, d)
    width = -(-d // parts)
    model = Model(centroids, np.zeros((parts, min(256, len(x)), width), np.float32), parts)
    residual = model.split(x - centroids[nearest(x, centroids)])
    for p in range(parts):
        model.books[p] = kmeans(residual[:, p], model.books.shape[1], 8, seed + p)
    return model


def vectors(column: pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def index(rows: DataFrame, model: Model) -> DataFrame:
    """id, list, code (a byte a part), error, v: every row of rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if batch.num_rows:
                at, codes, error = m.encode(unit(vectors(batch.column("v"), m.centroids.shape[1])))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float32()), batch.column("v")], names=["id", "list", "code", "error", "v"])

    return rows.mapInArrow(run, f"id bigint, list int, code binary, error float, v {kind}")


def shelved(sizes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shelf of each list and how many it has: short lists that lie together share one, long ones have several."""
    many = max(1, int(sizes.sum()) // SHELF)
    near = nearest(centroids, kmeans(centroids, min(many, len(centroids)), 5, 1))
    first, pieces, at, held = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // SHELF)), 0, 0
    for i in np.argsort(near, kind="stable"):
        if held and held + sizes[i] > SHELF:
            at, held = at + 1, 0
        first[i], held = at, held + sizes[i]
        if pieces[i] > 1:
            at, held = at + pieces[i], 0
    return first, pieces


def best_of(model: Model, k: int, asked: np.ndarray, q: np.ndarray, ids: np.ndarray, lists: np.ndarray, codes: np.ndarray, errors: np.ndarray, stored: np.ndarray, probed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Of each query: its id, the ids and exact cosines of the k nearest on the shelf, and how many got a cosine.

    ids rise, so that ties go to the smaller one; probed: queries x rows of the shelf.
    """
    guess = np.maximum(model.distances(unit(q), lists, codes), 0)
    guess[~probed | (asked[:, None] == ids[None, :])] = np.inf
    # Rows that share an id count as one: then as many more are needed.
    need = k * int(np.unique(ids, return_counts=True)[1].max())
    first = min(max(FIRST, need), len(ids))
    places = np.argpartition(guess, first - 1, axis=1)[:, :first]
    unit_q, unit_rows = exact(q), exact(stored)
    for j in range(len(q)):
        here = places[j][np.isfinite(guess[j, places[j]])]
        close = unit_rows[here] @ unit_q[j]
        done = len(here)
        if len(here) == first < len(ids):
            # A vector is at most its code's error nearer than the code: what can't beat the k-th stays out.
            edge = np.partition(close, -need)[-need]
            reach = np.sqrt(max(0.0, 2 - 2 * edge)) + SLACK + errors
            more = np.setdiff1d(np.flatnonzero(guess[j] <= reach * reach + SLACK), here)
            here, close, done = np.concatenate([here, more]), np.concatenate([close, unit_rows[more] @ unit_q[j]]), done + len(more)
        if not done:
            continue
        # Only those that rounding can't part from the k-th are worked out alone.
        best = here[close >= np.partition(close, -min(need, done))[-min(need, done)] - 1e-9]
        score = cosine(q[j], stored[best])
        line = np.lexsort((ids[best], -score))
        _, firsts = np.unique(ids[best][line], return_index=True)
        line = line[np.sort(firsts)[:k]]
        yield int(asked[j]), ids[best][line], score[line], done


def search(embeddings: DataFrame, is_query, k: int = 5, probe: float = 0.8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, n_exact: the k nearest found of each row for which is_query(id column) holds.

    probe: share of the lists a query looks into (at least 8 lists, and as many more as it takes
    to see k other rows). Vectors without clusters need a large share for a recall of 0.9; with
    clusters a small one does; with 1 the result is exact. n_exact: rows that got an exact cosine
    for the query. Lists number about the square root of the rows.
    """
    rows = checkpointed(valid(embeddings, id_column, vector_column))
    n = rows.count()
    model = fit(rows, n)
    if model is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, n_exact bigint")
    d = model.centroids.shape[1]
    kind = rows.schema["v"].dataType.simpleString()
    indexed = checkpointed(index(rows, model))
    sizes = np.zeros(len(model.centroids), np.int64)
    for r in indexed.groupBy("list").count().collect():  # a row a list, MOST_LISTS at most
        sizes[r["list"]] = r["count"]
    first, pieces = shelved(sizes, model.centroids)
    spark = rows.sparkSession
    sent, sent_shelves = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast((sizes, first, pieces))
    probes = max(8, int(np.ceil(probe * len(sizes))))

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (many, start, span) = sent.value, sent_shelves.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = unit(vectors(part.column("v"), d))
                far = 0.5 * (m.centroids**2).sum(axis=1) - x @ m.centroids.T
                order = np.argsort(far, axis=1, kind="stable")
                seen = np.cumsum(many[order], axis=1) - many[order]  # rows in the lists before
                take = ((np.arange(order.shape[1])[None, :] < probes) | (seen < 4 * k + 1)) & (many[order] > 0)
                owner, shelf, wanted = [], [], []
                for i in range(len(x)):
                    lists = np.sort(order[i, take[i]])
                    on = np.repeat(start[lists], span[lists]) + np.concatenate([np.arange(p) for p in span[lists]])
                    by = np.repeat(lists, span[lists])
                    line = np.argsort(on, kind="stable")
                    shelves, cuts = np.unique(on[line], return_index=True)
                    owner += [i] * len(shelves)
                    shelf += shelves.tolist()
                    wanted += np.split(by[line].astype(np.int32), cuts[1:])
                where = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(where), pa.array(shelf, pa.int64()), pa.array(wanted, pa.list_(pa.int32())), part.column("v").take(where)], names=["query_id", "shelf", "lists", "q"])

    asked = checkpointed(rows.filter(is_query(F.col("id"))).dropDuplicates(["id", "v"]).mapInArrow(routes, f"query_id bigint, shelf bigint, lists array<int>, q {kind}"))
    parts = checkpointed(asked.groupBy("shelf").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("_parts")))
    shelves = spark.createDataFrame([(i, int(a), int(p)) for i, (a, p) in enumerate(zip(first, pieces, strict=True))], "list int, _first long, _pieces int")  # MOST_LISTS rows
    placed = indexed.join(F.broadcast(shelves), "list").withColumn("shelf", F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_pieces")))
    held = placed.join(parts, "shelf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("shelf", "part", "id", "list", "code", "error", "v")
    queries = asked.join(parts, "shelf").select("shelf", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int").alias("part"), "query_id", "lists", "q")

    def rank(have: pa.Table, want: pa.Table) -> pa.Table:
        m, names = sent.value, ["query_id", "vec_id", "score", "n_exact"]
        have = have.sort_by("id")
        ids, lists, errors = (have.column(c).to_numpy() for c in ("id", "list", "error"))
        stored = vectors(have.column("v"), d)
        codes = np.frombuffer(b"".join(have.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        used, place = np.unique(lists, return_inverse=True)
        out = []
        for at in range(0, want.num_rows if len(ids) else 0, STRIP):
            strip = want.slice(at, STRIP)
            looked = np.array([np.isin(used, x, assume_unique=True) for x in strip.column("lists").to_pylist()])
            found = best_of(m, k, strip.column("query_id").to_numpy(), vectors(strip.column("q"), d), ids, lists, codes, errors, stored, looked[:, place])
            out += [(np.full(len(near), query), near, score, np.append(done, np.zeros(len(near) - 1, np.int64))) for query, near, score, done in found]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=names)

    found = held.groupBy("shelf", "part").cogroup(queries.groupBy("shelf", "part")).applyInArrow(rank, "query_id bigint, vec_id bigint, score double, n_exact bigint")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("n_exact").alias("n_exact"))
    own = Window.partitionBy("query_id")  # k rows a shelf at most
    place = F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).withColumn("n_exact", F.sum("n_exact").over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_exact")
