"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of 64 bits or a multiple. Equal fingerprints are one row before anything is
compared. The distinct ones are put into tiles by their population counts (of the whole, or of
parts of it) and, if a similarity is asked for, by the number of their shingles; two tiles are
compared only if their counts differ by no more than the radius, in sum over the parts, which no
linked pair can exceed. A task compares two tiles of bounded size with numpy's exclusive-or and
bit counts and returns a forest of the links, never all pairs of a group. Components then come
from alternating stars.

If a similarity is asked for, these links are only proposals. The sets of shingles (as 64-bit
hashes) of the texts that have one are brought together by component of proposals, in blocks of
bounded size, and a proposed pair is a link only if the Jaccard similarity of the two sets says so.

Defined results: null and blank texts have fingerprint zero, linked like any other; texts with
fewer words than a shingle take the whole sequence; a very long text is hashed whole, a piece of
its words at a time; repeated rows share a component; doc_id null
takes no part in the smallest id of its component (null if all are); an empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_hot, checkpointed, digest_of, pieces_of, stored, text_of, words_in

#: Fingerprints in a tile, at most.
TILE = 8192
#: Rows of the left tile that a task compares with the right one in one go.
STRIP = 64
#: Texts in a block of a component of proposals, and bytes of their sets of shingles, both about.
SET_BLOCK, SET_BYTES = 2048, 8 << 20
#: Standard deviations beyond the expected distance within which a pair is proposed.
DEVIATIONS = 4


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of each hash (splitmix64's finaliser; k = 0: the hash itself)."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hashes_of(text: str, shingle: int, seed: int) -> np.ndarray:
    """Hashes of the shingles, in the order of the text and with repeats; words of a long text a piece at a time."""
    carried: list[bytes] = []
    found, first = [], True
    for piece in pieces_of(text.encode()):
        words = carried + words_in(piece)
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            cuts = (joined[a : b - 1] for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False))
            found.append(np.fromiter((xxhash.xxh64_intdigest(c, seed) for c in cuts), np.uint64, len(words) - shingle + 1))
            first = False
        carried = words[-(shingle - 1) :] if shingle > 1 else []
        if len(words) < shingle:
            carried = words
    if first and carried:
        return np.array([xxhash.xxh64_intdigest(b" ".join(carried), seed)], np.uint64)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def fingerprint(hashes: np.ndarray, width: int = 1) -> bytes:
    """Big-endian bytes, where a bit is 1 if it is set in over half the shingles' hashes."""
    out = []
    for k in range(width):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            more = mixed(hashes[at : at + (1 << 16)], k)
            ones += np.unpackbits(more.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, key: Column | str = "doc_id", shingle: int = 3, seed: int = 42, width: int = 1, sets: bool = False) -> DataFrame:
    """key, fp (binary, 8 * width bytes), shingles, same (with sets: each shingle counts once in all, and this is a digest of their set)."""
    given = docs.select(F.col(key).alias("key") if isinstance(key, str) else key.alias("key"), text_of().alias("text"))
    kind = given.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                fp, n, same = [], [], []
                for text in part.column("text"):
                    hashes = hashes_of(text.as_py(), shingle, seed)
                    if sets:
                        hashes = np.unique(hashes)
                    fp.append(fingerprint(hashes, width))
                    n.append(len(hashes))
                    same.append(xxhash.xxh3_128_digest(hashes.tobytes()) if sets else b"")
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(same, pa.binary())], names=["key", "fp", "shingles", "same"])

    return given.mapInArrow(run, f"key {kind}, fp binary, shingles bigint, same binary")


def limits(bits: int, similarity: float, most: int = 64) -> np.ndarray:
    """By size of the smaller set (the last for all larger ones): bits in which a pair of the similarity is let differ.

    Up to `most` the expected distance is that of the worst pair of sizes, from the binomials; beyond,
    that of two sums that are as good as normal. Fewer than four shingles aren't normal at all.
    """
    p = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    set_ = lambda n, c: np.array([p(n - c)[max(0, n // 2 + 1 - k) :].sum() for k in range(c + 1)])  # noqa: E731  chance of a 1, by ones among the common
    normal = math.acos(2 * similarity / (1 + similarity)) / math.pi
    shares = [normal]
    for a in range(1, most + 1):
        worst = normal
        for b in range(a, int(a / similarity + 1e-9) + 1):
            c = next(c for c in range(a + 1) if c == a or c / (a + b - c) >= similarity)
            one, other = set_(a, c), set_(b, c)
            worst = max(worst, float((p(c) * (one * (1 - other) + other * (1 - one))).sum()))
        shares.append(worst)
    shares = np.array([*shares, normal])
    return np.ceil(bits * shares + DEVIATIONS * np.sqrt(bits * shares * (1 - shares))).astype(np.int64)


class Grid:
    """Cells of nodes: band of the number of shingles, and population counts of the parts in steps.

    A node is the fingerprint's bytes and, where a similarity is asked for, 8 more with the number
    of distinct shingles and the digest of their set. Without a similarity all are in band 0. limits: radius
    by the smaller number of shingles, none over `radius`.
    """

    def __init__(self, n_bytes: int, radius: int, parts: int, step: int, similarity: float | None, limits: np.ndarray | None = None):
        self.limits = np.array([radius]) if limits is None else limits
        self.n_bytes, self.radius, self.parts, self.step, self.similarity = n_bytes, radius, parts, step, similarity
        self.base = n_bytes * 8 // parts // step + 1
        self.digits = self.base ** np.arange(parts, -1, -1, dtype=np.int64)
        # A vector of differences can hold a linked pair only if its least distance is in the radius.
        found: dict[tuple[int, ...], int] = {(b,): 0 for b in ((-1, 0, 1) if similarity else (0,))}
        reach = (radius - 1) // step + 1 if radius else 0
        for _ in range(parts):
            found = {(*v, d): far for v, s in found.items() for d in range(-reach, reach + 1) if (far := s + max(0, (abs(d) - 1) * step + 1) * (d != 0)) <= radius}
        near = np.array(sorted(found), np.int64)
        self.near = near[(near @ self.digits) >= 0]  # the other half is seen from the other cell

    def split(self, nodes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints as bytes, one row each, and numbers of shingles."""
        rows = np.frombuffer(b"".join(nodes), np.uint8).reshape(len(nodes), -1)
        if not self.similarity:
            return rows, np.zeros(len(rows), np.int64)
        return np.ascontiguousarray(rows[:, : self.n_bytes]), np.ascontiguousarray(rows[:, self.n_bytes : self.n_bytes + 8]).view(">i8").ravel().astype(np.int64)

    def cells(self, nodes: list[bytes]) -> np.ndarray:
        prints, n = self.split(nodes)
        counts = np.bitwise_count(prints).reshape(len(prints), self.parts, -1).sum(axis=2, dtype=np.int64) // self.step
        band = np.floor(np.log(np.maximum(n, 1)) / -math.log(self.similarity)).astype(np.int64) if self.similarity else n
        return np.concatenate([band[:, None], counts], axis=1) @ self.digits

    def asked(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell, the cells to compare it with: owner and the other."""
        counts = cells[:, None] // self.digits[None, :]
        counts[:, 1:] %= self.base
        wanted = counts[:, None, :] + self.near[None, :, :]
        ok = (wanted >= 0).all(axis=2) & (wanted[:, :, 1:] < self.base).all(axis=2)
        return np.repeat(cells, ok.sum(axis=1)), (wanted @ self.digits)[ok]


def tiles(distinct: DataFrame, grid: Grid) -> DataFrame:
    """cell, block, nodes (the tile's, an array)."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grid.cells(batch.column(0).to_pylist()))], names=["node", "cell"])

    placed = checkpointed(distinct.select("node").mapInArrow(cells, "node binary, cell bigint"))
    # Blocks by hash: about half a tile each, so that none exceeds it but by extreme chance; the
    # comparison itself goes in strips and takes any size. The number of cells is bounded by the grid
    # (17**4 for four parts of 64 bits; some 300 with bands of size), so that their sizes are broadcast.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("_n"))
    joined = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / F.lit(TILE // 2))))
    return joined.groupBy("cell", "block").agg(F.collect_list("node").alias("nodes"))


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give each component of the links a-b its least label; labels[i] is a label, root of itself."""
    while len(a):
        ra, rb = labels[a], labels[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def proposed(grid: Grid, left: list[bytes], right: list[bytes] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, then right) of the pairs that the fingerprints link, of two tiles or of one with itself; in strips, by rising left place."""
    words = lambda prints: prints.view(np.uint64).reshape(len(prints), -1)
    prints, n = grid.split(left)
    a, size_a = words(prints), n
    if right is None:
        b, size_b, shift = a, size_a, 0
    else:
        prints, size_b = grid.split(right)
        b, shift = words(prints), len(left)
    for at in range(0, len(a), STRIP):
        strip, first = a[at : at + STRIP], at + 1 if right is None else 0  # with itself: later places alone
        others = b[first:]
        far = np.zeros((len(strip), len(others)), np.uint16)
        for w in range(a.shape[1]):
            far += np.bitwise_count(strip[:, w, None] ^ others[None, :, w])
        i, j = np.nonzero(far <= grid.radius)
        far = far[i, j]
        i, j = i + at, j + first
        keep = np.ones(len(i), bool) if right is not None else i < j
        if grid.similarity:
            small, large = np.minimum(size_a[i], size_b[j]), np.maximum(size_a[i], size_b[j])
            keep &= small / np.maximum(large, 1) >= grid.similarity
            keep &= far <= grid.limits[np.minimum(small, len(grid.limits) - 1)]
        if keep.any():
            yield i[keep], j[keep] + shift


def forest(grid: Grid, left: list[bytes], right: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (places in left, then right) of the links of two tiles, or of one with itself."""
    labels = np.arange(len(left) + (0 if right is None else len(right)))
    for i, j in proposed(grid, left, right):
        merged(labels, i, j)
    child = np.flatnonzero(labels != np.arange(len(labels)))
    return child, labels[child]


def confirmed(grid: Grid, left: list[bytes], right: list[bytes] | None, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As forest, of the proposed pairs whose sets (sorted, left's then right's) are as similar as asked.

    A pair whose ends are joined already is not looked at again.
    """
    labels, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    for i, j in proposed(grid, left, right):
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for place, others in zip(i[starts], np.split(j, starts[1:]), strict=True):
            others = others[labels[others] != labels[place]]
            own = sets[place]
            # In runs, so that what is put side by side is bounded.
            runs = np.cumsum(sizes[others]) // (SET_BYTES // 8)
            for run in np.split(others, np.flatnonzero(np.diff(runs)) + 1):
                run = run[labels[run] != labels[place]]
                if not len(run):
                    continue
                side = np.concatenate([sets[k] for k in run])
                found = own[np.minimum(np.searchsorted(own, side), len(own) - 1)] == side if len(own) else np.zeros(len(side), bool)
                common = np.bincount(np.repeat(np.arange(len(run)), sizes[run]), found, len(run))
                good = run[common / np.maximum(len(own) + sizes[run] - common, 1) >= grid.similarity]
                merged(labels, np.full(len(good), place), good)
    child = np.flatnonzero(labels != np.arange(len(labels)))
    return child, labels[child]


def links(distinct: DataFrame, grid: Grid) -> DataFrame:
    """a, b: links between distinct nodes, enough of them to give every component."""
    tiled = checkpointed(tiles(distinct, grid))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).to_numpy()
            for at in range(0, len(cells), 512):
                own, other = grid.asked(cells[at : at + 512])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other)], names=["cell", "cell2"])

    index = tiled.select("cell", "block")
    cells = index.select("cell").distinct()
    pairs = cells.mapInArrow(ask, "cell bigint, cell2 bigint").join(cells.withColumnRenamed("cell", "cell2"), "cell2")
    pairs = pairs.join(index, "cell").join(index.select(F.col("cell").alias("cell2"), F.col("block").alias("block2")), "cell2")
    pairs = pairs.filter((F.col("cell") < F.col("cell2")) | (F.col("block") <= F.col("block2")))
    right = tiled.select(F.col("cell").alias("cell2"), F.col("block").alias("block2"), F.col("nodes").alias("nodes2"))
    work = pairs.join(tiled, ["cell", "block"]).join(right, ["cell2", "block2"])
    # Dealt anew by pair: a cell with many blocks has many pairs, and they go to many tasks.
    work = work.repartition(*["cell", "block", "cell2", "block2"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [c1 == c2 and b1 == b2 for c1, b1, c2, b2 in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
            out_a, out_b = [], []
            for k in range(batch.num_rows):
                left = batch.column("nodes")[k].as_py()
                right_ = None if same[k] else batch.column("nodes2")[k].as_py()
                child, root = forest(grid, left, right_)
                both = left if same[k] else left + right_
                out_a += [both[c] for c in child]
                out_b += [both[r] for r in root]
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return work.select("cell", "block", "cell2", "block2", "nodes", "nodes2").mapInArrow(compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b) but the roots: root is the least node it is connected to.

    Large star, then small star, until nothing changes. The least neighbour of a node is an
    aggregate that is combined before the shuffle; it is broadcast back to the edges of nodes with
    very many, and meets the others by a shuffle, so that no task holds all neighbours of a hub.
    Every round is checkpointed.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n")).select("u", F.least("u", "_m").alias("_m"), "_n"))
        large = checkpointed(beside_hot(both.filter(F.col("v") > F.col("u")), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n")))
        small = beside_hot(large, least, "u", n).select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("_m").alias("v"))).distinct()
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = state[0]
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def confirmed_links(texts: DataFrame, grid: Grid, shingle: int, seed: int) -> DataFrame:
    """a, b: links between nodes, enough of them to give every component.

    texts: node, root (of the component of proposals), shingles, text; a row a node. A component is
    cut into blocks by hash and its pairs of blocks are worked on apart, so that none is too large for a task.
    """
    sizes = texts.groupBy("root").agg(F.count("*").alias("_n"), F.sum("shingles").alias("_s"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / SET_BLOCK), F.ceil(F.col("_s") * 8 / SET_BYTES)).cast("int")
    sizes = checkpointed(sizes.filter("_n > 1").select("root", "_n", blocks.alias("_blocks")))
    placed = beside_hot(texts, sizes, "root", texts.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = [np.unique(hashes_of(t.as_py(), shingle, seed)).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("root", "node", "block", "_blocks")), pa.array(found, pa.binary())], names=["root", "node", "block", "_blocks", "set"])

    held = placed.select("root", "node", "block", "_blocks", "text").mapInArrow(cut, "root binary, node binary, block int, _blocks int, set binary")
    held = held.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    held = held.select("root", F.least("block", "_with").alias("p"), F.greatest("block", "_with").alias("q"), "block", "node", "set")

    def compare(table: pa.Table) -> pa.Table:
        nodes, sets, block = table.column("node").to_pylist(), table.column("set").to_pylist(), table.column("block").to_numpy()
        first = np.flatnonzero(block == block.min())
        second = np.flatnonzero(block != block.min())
        order = [*first, *second]
        if not len(second) and table.column("p")[0] != table.column("q")[0]:
            return table.slice(0, 0).select(["node", "node"]).rename_columns(["a", "b"])
        left, right = [nodes[k] for k in first], [nodes[k] for k in second] if len(second) else None
        child, root = confirmed(grid, left, right, [np.frombuffer(sets[k], np.uint64) for k in order])
        return pa.table({"a": pa.array([nodes[order[c]] for c in child], pa.binary()), "b": pa.array([nodes[order[r]] for r in root], pa.binary())})

    return held.groupBy("root", "p", "q").applyInArrow(compare, "a binary, b binary")


def noded(prints: DataFrame, grid: Grid) -> DataFrame:
    """prints with node: what is one in all comparisons."""
    size = F.unhex(F.lpad(F.hex("shingles"), 16, "0"))
    return prints.withColumn("node", F.concat("fp", size, "same") if grid.similarity else F.col("fp"))


def rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (a row a node) with root: equal roots, one component."""
    # Only nodes with a link have a row in roots; a root itself has none.
    roots = roots.select(F.col("node").alias("_node"), "root")
    return nodes.join(roots, nodes["node"] == roots["_node"], "left").drop("_node").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42, parts: int = 4) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links, its own included).

    parts: into how many equal parts the fingerprint goes for the tiles' population counts; more
    parts skip more pairs of tiles but send each tile to more partners (4 suits a radius of 2, 1 a wide one).
    """
    grid = Grid(8, radius, parts, 1, None)
    prints = checkpointed(noded(fingerprints(docs, "doc_id", shingle, seed), grid).select("key", "node"))
    nodes = checkpointed(prints.groupBy("node").agg(F.min("key").alias("key"), F.count("*").alias("copies")))
    named = checkpointed(rooted(nodes, components(links(nodes, grid))))
    ids = checkpointed(named.groupBy("root").agg(F.min("key").alias("component_id"), F.count("*").alias("_n")))
    named = beside_hot(named.select("node", "root", "copies"), ids, "root", nodes.count())
    named = checkpointed(named.select("node", "component_id", F.col("copies").alias("_n")))
    return beside_hot(prints, named, "node", prints.count()).select(F.col("key").alias("doc_id"), F.col("node").alias("fp"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = 4, radius: int | None = None, seed: int = 42) -> DataFrame:
    """docs with one row of each group of near-duplicates: the least doc_id (null last), then the least digest.

    Two texts are linked if the Jaccard similarity of their sets of shingles is `similarity` or more.
    Only pairs are looked at whose fingerprints of 64 * width bits differ in at most `radius` bits
    and of which the smaller has at least `similarity` times the distinct shingles of the larger. The default
    radius is the distance that is expected of two sets with that similarity, and DEVIATIONS standard
    deviations more; it is wider for sets of few shingles. Of rows that are equal in all columns one is kept.
    """
    bits = 64 * width
    by_size = limits(bits, similarity) if radius is None else np.array([radius])
    radius = int(by_size.max())
    grid = Grid(8 * width, radius, 1, radius, similarity, by_size)
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), digest_of(docs).alias("digest"))
    prints = checkpointed(noded(fingerprints(docs, key, shingle, seed, width, sets=True), grid).select("key", "node", "shingles"))
    nodes = checkpointed(prints.groupBy("node").agg(F.min("key").alias("key"), F.first("shingles").alias("shingles")))
    # One text of each node that has a proposal, and how many rows are equal to the one it is taken from.
    near = components(links(nodes, grid))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    rows = prints.groupBy("key").agg(F.count("*").alias("_n"))
    counted = checkpointed(rows.select("key.digest", F.col("key.id").alias("_id"), "_n"))
    total = prints.count()
    asked = near.join(nodes, "node").select("node", "root", "shingles", "key.digest").join(counted.select("digest", "_n"), "digest")
    texts = beside_hot(docs.select(digest_of(docs).alias("digest"), text_of().alias("text")), checkpointed(asked), "digest", total)
    texts = stored(texts.groupBy("node").agg(F.first("root").alias("root"), F.first("shingles").alias("shingles"), F.first("text").alias("text")))
    named = rooted(nodes, components(confirmed_links(texts, grid, shingle, seed)))
    best = named.groupBy("root").agg(F.min("key").alias("key")).select("key.*")
    # Keys number rows; a key that stands for several equal rows is found by counting, so that
    # only such rows have to be brought together.
    chosen = best.join(counted, (best["digest"] == counted["digest"]) & best["id"].eqNullSafe(counted["_id"]))
    chosen = checkpointed(chosen.select(best["digest"].alias("_key"), "_n", F.col("_n").alias("_copies")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest_of(docs).alias("_key"))
    joined = beside_hot(rows, chosen, "_key", total)
    if chosen.filter("_copies > 1").isEmpty():
        return joined.select("_row.*")
    single = joined.filter("_copies = 1").select("_row")
    # Equal rows take any one of them; the row is counted before the shuffle.
    several = joined.filter("_copies > 1").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row")
    return single.unionByName(several).select("_row.*")
