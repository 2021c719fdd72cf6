"""Exact length histogram of encoded documents, with suffix sums for every context limit.

Lengths come from the public byte-level BPE vocabulary; documents of equal length are counted
together, and sums over all longer ones answer the rest. Defined results: a null or empty text
has length 0 and counts as a document; repeated rows count each; an empty table gives no row;
columns other than the text are not looked at. Texts of any length are encoded whole: in parts that
end where a piece of the pattern ends in any case, and a long run of white space, which the
library's pattern engine can't take, as the piece that it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, parts_of, running_sums, text_of

#: White space in a row from which a run is encoded apart from its text; the library fails beyond some 400,000.
LONG_RUN = 10_000
_RUN = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")


def around_runs(text: str) -> Iterator[tuple[str, bool]]:
    """The text in stretches, and whether a stretch is one piece, white space alone.

    The patterns of byte-level encoders take a run of white space as one piece but for its last
    character, which may go with the word that follows; at the end of a text they take it whole.
    """
    at = 0
    for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    if at < len(text):
        yield text[at:] if at else text, False


def lengths(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """One column, length: tokens of each text. ranks_file: lines of base64 token and rank."""
    if len(ranks_file) > 32 << 20:
        raise ValueError("the vocabulary file is over 32 MB")
    sent = docs.sparkSession.sparkContext.broadcast(ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, sent.value.splitlines())}
        cut, whole = (tiktoken.Encoding("lengths", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, r"[\s\S]+"))

        def length(text: str) -> int:
            return sum(len((whole if one else cut).encode_ordinary(x)) for part in parts_of(text) for x, one in around_runs(part))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(start, 256)
                yield pa.RecordBatch.from_arrays([pa.array([length(t.as_py()) for t in texts], pa.int64())], names=["length"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "length bigint")


def histogram(lengths_df: DataFrame) -> DataFrame:
    """A row for each length that occurs, as the context limit L = length:

    n_docs with that length; docs_longer and tokens_longer: of documents over it;
    total_docs, total_tokens; truncated_tokens: sum of min(length, L); quantile: share of
    documents of at most that length. Between two lengths that occur, truncated_tokens grows by
    docs_longer a step, so these rows answer every limit (see `truncated`).
    """
    counts = checkpointed(lengths_df.groupBy("length").agg(F.count("*").alias("n_docs")))
    totals = counts.agg(F.sum("n_docs"), F.sum(F.col("length") * F.col("n_docs"))).first()
    docs, tokens = (F.lit(int(x or 0)).cast("long") for x in totals)
    summed = running_sums(counts, [F.col("length").desc()], {"docs_longer": F.col("n_docs"), "tokens_longer": F.col("length") * F.col("n_docs")})
    return summed.select(
        "length",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        docs.alias("total_docs"),
        tokens.alias("total_tokens"),
        (tokens - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        ((docs - F.col("docs_longer")) / docs).alias("quantile"),
    )


def truncated(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens that a context limit leaves, for any limit from 0 on."""
    over = F.col("length") > limit
    return hist.agg(F.coalesce(F.sum(F.when(over, F.lit(limit)).otherwise(F.col("length")) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the least length that a share q of the documents doesn't exceed."""
    return hist.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))
