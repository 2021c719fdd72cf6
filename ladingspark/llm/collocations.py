"""Phrases whose words come together more often than apart, by pivot partitioning.

1. Words are counted by language; only words that are frequent enough can be part of a phrase.
2. Every occurrence of such a word, the pivot, sends a rewritten fragment of its piece to the task
   that owns the pivot: the words around it as far as a phrase that contains it can reach, cut where
   a word is rarer than the pivot or too rare for any phrase. Equal fragments of a slice go once, with their number.
3. The owner mines the fragments of a pivot by themselves and emits the phrases that the pivot owns,
   that is, in which it is the rarest word. So each occurrence of a phrase is counted once, and the
   count is complete where it is made; only pivots with very many occurrences are dealt to
   several tasks, whose counts are added up.

The order of words is by their frequency, looked up in a table of SLOTS sums (words that share a slot are
ordered by its sum, then by hash and letters): its size is fixed, whatever the vocabulary, and any order that is the same in
all tasks gives the same counts.

Defined results: a null text is empty; a null language is `und`; repeated rows count each; an empty table gives
an empty result; very long texts are taken whole, in slices that end with a piece; columns other than text and lang are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_of

#: Sums in the table by which tasks order words.
SLOTS = 1 << 22
#: Bytes of text that are cut into words at a time, and bytes of fragments that are mined in one go, about.
SLICE_BYTES, MINED_BYTES = 2 << 20, 2 << 20
#: Occurrences of a pivot beyond which it is dealt to one more task, and fragments that a row holds at most; both bound what a task has in memory.
PIVOT_ROWS, ROW_FRAGMENTS = 1 << 18, 128
_END = re.compile(rb"[.,;:!?\x0a-\x0d]+")


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """Language and whole pieces of texts in that language, lower-cased, about `most` bytes at a time. Columns: lang, text."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            data, at = text.as_py(), 0
            while at < len(data):
                end = len(data)
                if end - at > most and (found := _END.search(data, at + most)):
                    end = found.end()
                held.setdefault(lang, []).append(data[at:end].lower() if at or end < len(data) else data.lower())
                size[lang] = size.get(lang, 0) + end - at
                at = end
                if size[lang] >= most:
                    size[lang] = 0
                    yield lang, held.pop(lang)
    yield from held.items()


def worded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and the texts as numbers of words; -1 parts pieces."""
    tokens = _END.sub(b" \n ", b"\n".join(texts)).replace(b"\t", b" ").split(b" ")
    index = dict.fromkeys(tokens)
    index.pop(b"", None)
    index.pop(b"\n", None)
    words = list(index)
    index = {w: k for k, w in enumerate(words)} | {b"": -2, b"\n": -1}
    ids = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
    return words, ids[ids > -2]


def strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).view(pa.string())


def counted_words(texts: DataFrame) -> DataFrame:
    """lang, phrase (a word), f: all occurrences. texts: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in slices(batches, SLICE_BYTES):
            words, ids = worded(held)
            f = np.bincount(ids[ids >= 0], minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(words)), strings(words), pa.array(f, pa.int64())], names=["lang", "phrase", "f"])

    return texts.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def slot_sums(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots that are not empty, and the sum of their words' frequencies: SLOTS rows at most."""
    slot = F.pmod(F.xxhash64("lang", "phrase"), F.lit(SLOTS))
    found = frequent.groupBy(slot.cast("int").alias("slot")).agg(F.sum("f").alias("f")).toArrow()
    return found.column("slot").to_numpy(), found.column("f").to_numpy()


def ranked(lang: str, words: list[bytes], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, its place by rising frequency (-1: too rare for any phrase) and the frequency itself, by the slots."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    f = sums[(hashes % np.uint64(SLOTS)).astype(np.int64)]
    there = np.flatnonzero(f)
    order = sorted(zip(f[there].tolist(), hashes[there].tolist(), [words[k] for k in there], there.tolist(), strict=True))
    places = np.full(len(words), -1)
    places[[k for *_, k in order]] = np.arange(len(order))
    return places, f


def around(ids: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """Fragments, a row each: numbers of the words from `reach` before the pivot to `reach` after it; -1 where cut.

    Before the pivot only more frequent words stay, after it the pivot's own word too, so that a
    phrase which has the word twice is seen from its first place.
    """
    place = np.full(len(ids) + 2 * reach, -1)
    place[reach : len(place) - reach] = np.where(ids >= 0, places[ids], -1)
    middle = place[reach : len(place) - reach]
    columns = {0: ids}
    for side in (-1, 1):
        good = middle >= 0
        for d in range(1, reach + 1):
            other = place[reach + side * d : len(place) - reach + side * d]
            good = good & (other > middle if side < 0 else other >= middle) & (other >= 0)
            shifted = np.roll(ids, -side * d)
            columns[side * d] = np.where(good, shifted, -1)
    kept = (middle >= 0) & ((columns[-1] >= 0) | (columns[1] >= 0))
    return np.stack([columns[d][kept] for d in range(-reach, reach + 1)], axis=1)


def combined(rows: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows ordered by pivot, and how often each occurs."""
    key = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        key = (key ^ (rows[:, c] + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.lexsort((key, rows[:, reach]))
    rows = rows[order]
    # Rows with equal keys stand together; what differs from its neighbour starts a row of its own.
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[starts], np.diff(np.append(starts, len(rows)))


def fragments(texts: DataFrame, frequent: DataFrame, reach: int) -> DataFrame:
    """lang, pivot, salt, salts, parts: lines of a fragment's words without the pivot and its number, parted by tabs."""
    slot, total = slot_sums(frequent)
    sent = texts.sparkSession.sparkContext.broadcast((slot, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOTS, np.int64)
        sums[sent.value[0]] = sent.value[1]
        task = TaskContext.get().partitionId()
        for n, (lang, held) in enumerate(slices(batches, SLICE_BYTES)):
            words, ids = worded(held)
            places, f = ranked(lang, words, sums)
            rows, times = combined(around(ids, places, reach), reach)
            if not len(rows):
                continue
            named = strings([*words, b""])  # the last stands for what is cut
            columns = [named.take(pa.array(rows[:, c])) if c == reach else named.take(pa.array(np.where(rows[:, c] < 0, len(words), rows[:, c]))) for c in range(2 * reach + 1)]
            line = pc.binary_join_element_wise(*[columns[c] for c in range(2 * reach + 1) if c != reach], pc.cast(pa.array(times), pa.string()), "\t")
            first = np.diff(rows[:, reach], prepend=-1) != 0
            nth = np.arange(len(rows)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            starts = np.flatnonzero(nth % ROW_FRAGMENTS == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)), pa.int32()), line)
            pivots = rows[starts, reach]
            salts = 1 + f[pivots] // PIVOT_ROWS
            cols = [pa.repeat(pa.scalar(lang), len(pivots)), named.take(pa.array(pivots)), pa.array((task + n) % salts, pa.int64()), pa.array(salts, pa.int64()), pc.binary_join(lists, "\n")]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "pivot", "salt", "salts", "parts"])
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, "lang string, pivot string, salt bigint, salts bigint, parts string")


def mined(routed: DataFrame, reach: int, least: int) -> DataFrame:
    """lang, phrase, f: phrases that each pivot owns. Complete counts of `least` or more, and all counts of pivots dealt to several tasks."""
    names = ["lang", "phrase", "f"]

    def mine(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lines = pc.split_pattern(table.column("parts").combine_chunks(), "\n")
        of = pc.list_parent_indices(lines)
        fields = pc.split_pattern(lines.flatten(), "\t").flatten()
        width = 2 * reach + 1
        field = lambda k: fields.take(pa.array(np.arange(k, len(fields), width)))
        columns = {d: field(k) for k, d in enumerate([*range(-reach, 0), *range(1, reach + 1)])}
        columns[0] = table.column("pivot").take(of)
        times, lang, several = pc.cast(field(width - 1), pa.int64()), table.column("lang").take(of), pc.greater(table.column("salts").take(of), 1)
        there = {d: pc.not_equal(c, "") for d, c in columns.items()}
        found = []
        for size in range(2, reach + 2):
            for first in range(1 - size, 1):
                span = range(first, first + size)
                good = pc.and_(there[span[0]], there[span[-1]])
                phrase = pc.binary_join_element_wise(*[columns[d].filter(good) for d in span], " ")
                found.append(pa.table([lang.filter(good), phrase, several.filter(good), times.filter(good)], names=["lang", "phrase", "several", "f"]))
        out = pa.concat_tables(found).group_by(["lang", "phrase", "several"]).aggregate([("f", "sum")])
        out = out.filter(pc.or_(out.column("several"), pc.greater_equal(out.column("f_sum"), least))).combine_chunks()
        columns_ = [out.column(c).combine_chunks() if out.num_rows else pa.array([], kind) for c, kind in (("lang", pa.string()), ("phrase", pa.string()), ("f_sum", pa.int64()))]
        return pa.RecordBatch.from_arrays(columns_, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            # All rows of a pivot are mined together: what is held goes at the first border after enough rows.
            key = list(zip(batch.column("lang").to_pylist(), batch.column("pivot").to_pylist(), strict=True))
            bytes_ = np.cumsum(pc.binary_length(batch.column("parts")).to_numpy())
            at = 0
            for k, now in enumerate(key):
                if now != last and size + int(bytes_[k]) - (int(bytes_[at - 1]) if at else 0) > MINED_BYTES and (held or k > at):
                    if k > at:
                        held.append(batch.slice(at, k - at))
                    yield mine(held)
                    held, size, at = [], 0, k
                last = now
            held.append(batch.slice(at))
            size += int(bytes_[-1]) - (int(bytes_[at - 1]) if at else 0) if batch.num_rows else 0
        if any(b.num_rows for b in held):
            yield mine(held)
        pa.default_memory_pool().release_unused()

    dealt = routed.repartition("lang", "pivot", "salt").sortWithinPartitions("lang", "pivot")
    return dealt.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly: a up to 10**15, products of 38 digits."""
    wide = [c.cast("decimal(16,0)") for c in (a, left, right)]
    return F.call_function("div", (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of 2 to `longest` words of each language.

    a: occurrences of the phrase, within pieces that `.,;:!?` and line ends part; l and r: of its two parts at
    the cut with the least score 10**6 * a * a / (l * r); n: all words of the language. Phrases with fewer than `least`
    occurrences don't count; those that lie in a longer one with at least `share` per cent of theirs are left out.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    words = stored(counted_words(texts))
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    phrases = stored(mined(fragments(texts, frequent, longest - 1), longest - 1, least))
    known = frequent.unionByName(phrases).select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    split = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    piece = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    split = split.select("lang", "phrase", "f", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    split = split.join(known.select("lang", F.col("part").alias("left"), F.col("of").alias("l")), ["lang", "left"])
    split = split.join(known.select("lang", F.col("part").alias("right"), F.col("of").alias("r")), ["lang", "right"])
    split = split.withColumn("score", score_of(F.col("f"), F.col("l"), F.col("r")))
    scored = split.groupBy("lang", "phrase").agg(F.first("f").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What lies within a longer phrase: all its stretches of two words and more, each with the largest count.
    inner = phrases.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 2)
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    inner = inner.groupBy("lang", piece(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("f").alias("_longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    chosen = left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return chosen.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
