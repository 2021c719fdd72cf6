"""Language-model scores of whole documents, learnt from the corpus itself.

Four steps over the corpus. Words are counted over every training document, as a Spark
aggregate. Every document's words become ids, once, for training and scoring. The recurrent model (see `gru`) starts from those counts and takes its gradient steps
on every training document, once: documents are dealt over the rounds by hash, in each round every
group of documents trains a copy, and the copies are averaged weight by weight. Then every
document is scored from its first word to its end in one pass, the state carried from window to
window. The model's vocabulary grows with what it is trained on; words beyond it share the chance of
one class by their frequencies. Words outside the HEAD commonest get their counts by a join.

Defined results: a null or empty text is its end token alone; a null doc_id counts as the empty
text where its checksum is taken; repeated rows count and are scored each; without training
documents both scores are those of the add-one estimate, where every token has chance 1; an empty
table gives no row. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import pieces_of, stored, text_of
from .gru import Gru, Trainer, score

#: Words that every task holds with their counts (broadcast: about 3 MB).
HEAD = 100_000
#: The model tells the words apart that the gradient steps meet LEAST_SEEN times: LEAST_WORDS at least, MOST_WORDS (4 MB of weights) at most.
LEAST_SEEN, LEAST_WORDS, MOST_WORDS = 8, 1024, 16_384
#: Gradient steps are taken on all training tokens, in ROUNDS rounds, each on its share of the documents.
ROUNDS = 3
#: Lanes that a copy trains side by side: more, and so fewer and larger steps, where there would be over MANY_COPIES copies.
FEW_LANES, MOST_LANES, MANY_COPIES = 48, 192, 16
#: Tokens of a lane of one copy of the model in a round, until there are MOST_COPIES copies.
LANE_TOKENS, MOST_COPIES = 5_200, 2000
#: Tokens that a task packs into lanes at a time, and distinct words that it counts before it hands them on.
PACKED_TOKENS, COUNTED_WORDS = 2_000_000, 300_000
#: Texts that are cut into words at a time: bytes, a single longer text aside, which is cut in pieces.
GROUP_BYTES = 4 << 20
#: Numbers in a row when weights are averaged.
CHUNK = 1024
#: The token that ends every text; no word is empty.
END = b""


@dataclass
class Head:
    """The commonest words, by falling count, and what the estimate needs of the rest."""

    joined: bytes  # separated by blanks, which no word contains; the end token is the empty one
    counts: np.ndarray
    tokens: int
    kinds: int

    @cached_property
    def words(self) -> pa.Array:
        return pa.array(self.joined.split(b" ") if len(self.counts) else [], pa.binary()).view(pa.string())

    @cached_property
    def end(self) -> int:
        """The end token's place, the head's length where it is not in the head."""
        found = pc.index(self.words, pa.scalar(END.decode())).as_py()
        return found if found >= 0 else len(self.counts)

    @cached_property
    def log_base(self) -> np.ndarray:
        return np.log10(self.base)

    @property
    def base(self) -> np.ndarray:
        return (self.counts + 1) / self.room

    @property
    def room(self) -> int:
        return self.tokens + self.kinds + 1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def groups(texts: pa.Array) -> Iterator[tuple[slice, Iterator[pa.Array]]]:
    """Rows of GROUP_BYTES and their texts; a long text is a group by itself and comes in pieces that end at blanks."""
    start = held = 0
    for i, size in enumerate([*pc.binary_length(texts).to_pylist(), None]):
        long = size is not None and size > common.PIECE_BYTES
        if i > start and (size is None or long or held + size > GROUP_BYTES):
            yield slice(start, i), iter([texts.slice(start, i - start)])
            start, held = i, 0
        if long:
            yield slice(i, i + 1), (pa.array([piece], pa.binary()).view(pa.string()) for piece in pieces_of(texts[i].as_buffer().to_pybytes()))
            start = i + 1
        elif size is not None:
            held += size


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and how many each text has; Arrow's ASCII functions know the six blanks alone."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    lists = pc.ascii_split_whitespace(trimmed)
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0  # one empty word each
    if blank.any():
        sizes[blank] = 0
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words, sizes


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary, the end token empty), n."""

    def merged(seen: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(seen).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for batch in batches:
            texts = batch.column(0)
            for _, parts in groups(texts):
                for part in parts:
                    found = pc.value_counts(words_of(part)[0])
                    seen.append(pa.table({"word": found.field("values").view(pa.binary()), "n": found.field("counts")}))
                    held += len(found)
                    if held > 2 * COUNTED_WORDS:
                        seen = [merged(seen)]
                        held = len(seen[0])
                        if held > COUNTED_WORDS:
                            yield from seen[0].to_batches()
                            seen, held = [], 0
            if len(texts):
                seen.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([len(texts)], pa.int64())}))
        if seen:
            yield from merged(seen).to_batches()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame) -> Head:
    """HEAD rows at most come to the driver."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    rows = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    return Head(b" ".join(rows.column("word").to_pylist()), rows.column("n").to_numpy().astype(np.int64), int(total[0] or 0), int(total[1]))


def copies_and_lanes(tokens: int) -> tuple[int, int]:
    """Copies of the model in a round over all `tokens` training tokens, and lanes of each."""
    shares = tokens // ROUNDS // LANE_TOKENS
    lanes = int(np.clip(shares // MANY_COPIES, FEW_LANES, MOST_LANES))
    return int(np.clip(shares // lanes, 1, MOST_COPIES)), lanes


def small(unknown: int) -> type:
    return np.uint16 if unknown < 1 << 16 else np.int32


def encoded(docs: DataFrame, head: Head, unknown: int, copies: int) -> DataFrame:
    """A row for each of docs (doc_id, held_out, text), the text replaced by what training and scoring need of it.

    _id, doc_id, held_out; round, copy, key: where it is trained; n_tokens; ids (as bytes, the end included, words that
    the model doesn't tell apart as `unknown`); head_known, head_base: number and log10 estimate of its tokens in
    the head, head_rest the latter for those that the model doesn't tell apart; tail_words, tail_counts: its words outside the head.
    """
    sent = docs.sparkSession.sparkContext.broadcast(head)
    # The round and the copy come from apart bits of the key.
    key = F.xxhash64("doc_id", "text")
    where = (F.pmod(F.shiftright(key, 32), F.lit(ROUNDS)).cast("int").alias("round"), F.pmod(F.xxhash64(key), F.lit(copies)).cast("int").alias("copy"), key.alias("key"))
    dealt = docs.select(F.monotonically_increasing_id().alias("_id"), "doc_id", "held_out", *where, "text")
    kept = dealt.columns[:-1]
    schema = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = sent.value
        for batch in batches:
            for rows, parts in groups(batch.column("text")):
                found = coded(parts, rows.stop - rows.start, h, unknown)
                own = batch.slice(rows.start, rows.stop - rows.start).select(kept)
                yield pa.RecordBatch.from_arrays([*own.columns, *found.values()], names=[*kept, *found])

    return dealt.mapInArrow(run, f"{schema}, n_tokens bigint, ids binary, head_known bigint, head_base double, head_rest double, tail_words array<binary>, tail_counts array<bigint>")


def coded(parts: Iterator[pa.Array], n: int, head: Head, unknown: int) -> dict[str, pa.Array]:
    """encoded's columns of n texts, which come as one part, or of one text in several."""
    outside, log_base = len(head.counts), np.append(head.log_base, 0.0)
    sizes, base, rest, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    ids, tails = [], []

    def add(places: np.ndarray, words: pa.Array, owner: np.ndarray) -> np.ndarray:
        inside, value = places < outside, log_base[places]
        base[:] += np.bincount(owner, value, n)
        rest[:] += np.bincount(owner, np.where(places < unknown, 0.0, value), n)
        known[:] += np.bincount(owner[inside], minlength=n)
        if not inside.all():
            tails.append(pa.table({"owner": owner[~inside], "word": words.filter(pa.array(~inside)), "n": np.ones(len(inside) - inside.sum(), np.int64)}))
        return np.minimum(places, unknown).astype(small(unknown))

    for part in parts:
        words, here = words_of(part)
        places = pc.index_in(words, value_set=head.words).fill_null(outside).to_numpy(zero_copy_only=False)
        ids.append(add(places, words, np.repeat(np.arange(n), here)))
        sizes += here
    ends = add(np.full(n, head.end), pa.array([END.decode()] * n, pa.string()), np.arange(n))
    flat = np.insert(np.concatenate(ids), np.cumsum(sizes), ends)
    sizes += 1
    item = flat.itemsize
    as_bytes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(sizes * item)).astype(np.int32)), pa.py_buffer(flat)])
    tail = pa.concat_tables(tails).group_by(["owner", "word"], use_threads=False).aggregate([("n", "sum")]).sort_by("owner").combine_chunks() if tails else None
    offsets = np.zeros(n + 1, np.int32)
    if tail is not None:
        offsets[1:] = np.cumsum(np.bincount(tail.column("owner").to_numpy(), minlength=n))
    column = lambda name, kind: tail.column(name).combine_chunks() if tail is not None else pa.array([], kind)
    return {
        "n_tokens": pa.array(sizes),
        "ids": as_bytes,
        "head_known": pa.array(known),
        "head_base": pa.array(base),
        "head_rest": pa.array(rest),
        "tail_words": pa.ListArray.from_arrays(pa.array(offsets), column("word", pa.string()).cast(pa.string()).view(pa.binary())),
        "tail_counts": pa.ListArray.from_arrays(pa.array(offsets), column("n_sum", pa.int64())),
    }


def trained(given: DataFrame, model: Gru, copies: int, most_lanes: int) -> Gru:
    """The model after ROUNDS rounds over the training documents, `encoded` for as many copies: each document takes part in one."""
    sc = given.sparkSession.sparkContext
    unknown = model.unknown
    for r in range(ROUNDS):
        sent = sc.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(sent.value.with_flat(sent.value.flat()))
            texts, held, copy = [], 0, 0
            for batch in batches:
                copy = batch.column("copy")[0].as_py() if batch.num_rows else copy
                for text in texts_of(batch.column("ids"), unknown):
                    texts.append(text)
                    held += len(texts[-1])
                    if held >= PACKED_TOKENS:
                        trainer.run(texts, most_lanes)
                        texts, held = [], 0
            trainer.run(texts, most_lanes)
            if trainer.tokens:
                flat = trainer.model.flat()
                cut = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([copy] * n, pa.int32()), pa.array([trainer.tokens] * n, pa.int64()), pa.array(cut, pa.list_(pa.float32()))],
                    names=["chunk", "copy", "tokens", "weights"],
                )

        # Copies are few and long: more partitions than copies, so that few of them share a task.
        dealt = given.filter(F.col("round") == r).repartition(4 * copies, "copy").sortWithinPartitions("copy", "key").select("copy", "ids")
        made = dealt.groupBy("copy").applyInArrow(learn, "chunk int, copy int, tokens bigint, weights array<float>")
        rows = made.groupBy("chunk").applyInArrow(averaged, "chunk int, weights array<double>").toArrow().sort_by("chunk")  # the model itself
        if rows.num_rows:
            model = model.with_flat(rows.column("weights").combine_chunks().flatten().to_numpy())
    return model


def averaged(table: pa.Table) -> pa.Table:
    """One piece of the weights from all copies (MOST_COPIES at most), each weighing as its tokens."""
    table = table.sort_by("copy")
    rows = table.column("weights").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(table.num_rows, -1)
    mean = np.average(rows, axis=0, weights=table.column("tokens").to_numpy())
    return pa.table({"chunk": pa.array(table.column("chunk").to_pylist()[:1], pa.int32()), "weights": pa.array([mean], pa.list_(pa.float64()))})


def texts_of(ids: pa.Array, unknown: int) -> Iterator[np.ndarray]:
    """Each row's ids, without a copy."""
    for text in ids:
        yield np.frombuffer(text.as_buffer(), small(unknown))


def scored(docs: DataFrame, model: Gru, head: Head) -> DataFrame:
    """docs, `encoded`, without their ids and words, with `train_tokens` and `relative`.

    relative: log10 of the model's probability, words that the model doesn't tell apart counted as
    one, plus the estimate's log10 of those of them that are in the head.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("_id", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_rest", "ids")
    kept = docs.columns[:-2]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            # Parts of PACKED_TOKENS, or one text that has more.
            sums = np.cumsum(batch.column("n_tokens").to_numpy()) // PACKED_TOKENS
            cuts = [0, *(np.flatnonzero(np.diff(sums)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, stop - start)
                relative = score(m, list(texts_of(part.column("ids"), m.unknown))) + part.column("head_rest").to_numpy()
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, pa.array(relative)], names=[*kept, "relative"])

    return docs.mapInArrow(run, f"{schema}, relative double").withColumn("train_tokens", F.lit(head.tokens).cast("long"))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document."""
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    training = rows.filter(~F.col("held_out"))
    counts = stored(word_counts(training.select("text")))
    head = head_of(counts)

    words = int(np.clip((head.counts >= LEAST_SEEN).sum(), LEAST_WORDS, MOST_WORDS))
    model = Gru.initial(head.base[:words])
    copies, most_lanes = copies_and_lanes(head.tokens)
    given = stored(encoded(rows, head, model.unknown, copies))
    model = trained(given.filter(~F.col("held_out")), model, copies, most_lanes)

    told = stored(scored(given, model, head))
    log_base = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(head.room)))
    tail = given.select("_id", F.explode(F.arrays_zip("tail_words", "tail_counts")).alias("_t")).select("_id", F.col("_t.tail_words").alias("word"), F.col("_t.tail_counts").alias("times"))
    tail = tail.join(counts, "word", "left").groupBy("_id").agg(F.sum(F.col("times") * log_base).alias("_base"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return told.join(tail, "_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + zero("_known")).alias("n_known"),
        "train_tokens",
        (F.col("head_base") + zero("_base")).alias("base_score"),
        (F.col("relative") + zero("_base")).alias("score"),
    )
