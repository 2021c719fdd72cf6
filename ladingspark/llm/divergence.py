"""Quality rules by distribution: how far a document's characters and common words are from its language's.

References: over all documents of a language, how often each class of characters and each of its
`common` most frequent words occurs. A document of enough words is compared with its
language's reference, if that has enough words too, by the Jensen-Shannon distance (base 2, from 0 to 1) of the two
histograms: eight classes of characters, and the common words with all other words as one more
bin. It goes if a distance exceeds its limit. A short document strays from any reference by chance; the square of the limit is
therefore raised by what is expected of so many draws, (bins - 1) / (8 n ln 2).

Before that come counts of a document's own: see `judge`.

Defined results: a null or empty text has no words and fails; a null language is `und`; repeated
rows are judged alike, and each counts for the reference; ties of common words go to the smaller word by code points; an empty table gives an empty
result; very long texts are taken whole, words a piece at a time; columns other than doc_id, lang and text are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import beside, stored, text_of

#: Classes of characters: upper case, lower case, other letters, numbers, punctuation, symbols, blanks, the rest.
CLASSES = 8
#: Limits of the two distances for long texts.
CHARACTERS, COMMON = 0.25, 0.38
#: Fewer words than this, in a document and in a reference, are not compared.
LEAST_WORDS, LEAST_REFERENCE = 50, 10_000
#: Characters of a text that are looked at a time, and lines from which digests stand for lines.
PIECE_CHARS = 1 << 20
_BLANKS = " \t\n\v\f\r"
_MARKS = "#*$%&|<>"


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of each code point; 8: one of the six ASCII blanks (class 6 too), 9 and 10: one of the counted marks (punctuation, symbol)."""
    by_letter = {"N": 3, "P": 4, "S": 5, "Z": 6}
    by_pair = {"Lu": 0, "Lt": 0, "Ll": 1, "Lo": 2, "Lm": 2}
    kinds = map(unicodedata.category, map(chr, range(0x110000)))
    table = np.fromiter((by_pair.get(k, by_letter.get(k[0], 7)) for k in kinds), np.uint8, 0x110000)
    for c in _MARKS:
        table[ord(c)] = table[ord(c)] + 5
    for c in _BLANKS:
        table[ord(c)] = 8
    return table


def text_pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE_CHARS that end at blanks."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE_CHARS:
            found = [k for c in _BLANKS if (k := text.find(c, at + PIECE_CHARS, at + 2 * PIECE_CHARS)) >= 0]
            found = found or [k for c in _BLANKS if (k := text.find(c, at + 2 * PIECE_CHARS)) >= 0]
            end = min(found) + 1 if found else end
        yield text[at:end] if at or end < len(text) else text
        at = end


def character_counts(text: str) -> np.ndarray:
    """Characters by class, and as the last two the six ASCII blanks and the counted marks."""
    found = np.zeros(11, np.int64)
    for piece in text_pieces(text):
        found += np.bincount(character_classes()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=11)
    classes = found[:CLASSES].copy()
    classes[6] += found[8]
    classes[4] += found[9]
    classes[5] += found[10]
    return np.append(classes, [found[8], found[9] + found[10]])


def numbered_words(text: str) -> tuple[dict[str, int], np.ndarray]:
    """Number of each distinct word, and the text as numbers."""
    index: dict[str, int] = {}
    parts = []
    for piece in text_pieces(text):
        # bytes.split parts at the six ASCII blanks alone.
        words = [w.decode() for w in piece.encode().split()] if not piece.isascii() or _other_blank(piece) else piece.split()
        new = [w for w in dict.fromkeys(words) if w not in index]
        index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
        parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    return index, np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _other_blank(piece: str) -> bool:
    """Whether str.split would part an ASCII text where a word goes on."""
    return any(c in piece for c in "\x1c\x1d\x1e\x1f")


def repeated_words(numbers: np.ndarray, window: int = 5) -> int:
    """Words that lie in a window of `window` words which occurs twice or more."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ numbers[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    if not equal.any():
        return 0
    # Hashes say where to look; equal windows are found among these places word by word.
    places = np.sort(order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])])
    rows = np.stack([numbers[places + k] for k in range(window)], axis=1)
    _, of, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = places[times[of.ravel()] > 1]
    depth = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(depth[:-1])))


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line; 128-bit digests stand for the lines of a long text."""
    if len(text) <= PIECE_CHARS:
        lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
        return len(lines) - len(set(lines))
    digests, at = bytearray(), 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if end > at and (line := text[at:end]).strip(_BLANKS):
            digests += xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
        at = end + 1
    return len(digests) // 16 - len(np.unique(np.frombuffer(digests, "S16"))) if digests else 0


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))


def references(docs: DataFrame, common: int = 64) -> DataFrame:
    """ref_lang, ref_words (all words), ref_classes (characters by class), ref_common (the most frequent words), ref_counts (theirs): a row a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words: dict[str, Counter] = {}
                classes: dict[str, np.ndarray] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    text = text.as_py()
                    index, numbers = numbered_words(text)
                    own = words.setdefault(lang, Counter())
                    for w, n in zip(index, np.bincount(numbers, minlength=len(index)).tolist(), strict=True):
                        own[w] += n
                    classes[lang] = classes.get(lang, 0) + character_counts(text)[:CLASSES]
                for lang, own in words.items():
                    size = len(own) + 1
                    sums = pa.array([None] * (size - 1) + [classes[lang].tolist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), size), pa.array([*own, None], pa.string()), pa.array([*own.values(), sum(own.values())], pa.int64()), sums], names=["lang", "word", "n", "classes"])

    counts = prepared(docs).select("lang", "text").mapInArrow(count, "lang string, word string, n bigint, classes array<bigint>")
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(CLASSES)]
    # The row without a word has a language's sums; both kinds meet in one aggregate.
    table = stored(counts.groupBy("lang", "word").agg(F.sum("n").alias("n"), *sums))
    whole = table.filter("word is null").select("lang", F.col("n").alias("ref_words"), F.array(*[f"c{k}" for k in range(CLASSES)]).alias("ref_classes"))
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("word"))
    top = table.filter("word is not null").select("lang", "word", "n").withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= common)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("_place", "word", "n"))).alias("top"))
    found = whole.join(top.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"), "left")
    return found.select(F.col("lang").alias("ref_lang"), "ref_words", "ref_classes", F.coalesce(F.col("top.word"), F.array().cast("array<string>")).alias("ref_common"), F.coalesce(F.col("top.n"), F.array().cast("array<bigint>")).alias("ref_counts"))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance in base 2 of two histograms; both must have a count."""
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / middle[x > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def exceeds(far: float, limit: float, bins: int, n: int) -> bool:
    return far * far > limit * limit + (bins - 1) / (8 * n * float(np.log(2)))


def judge(docs: DataFrame, common: int = 64, characters: float = CHARACTERS, words: float = COMMON, least: int = LEAST_WORDS, least_reference: int = LEAST_REFERENCE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, character_distance, common_distance.

    word_chars: code points in words; n_symbols: characters of `#*$%&|<>`; n_dup_lines: lines with a word that equal
    an earlier one; n_repeat_words: words in windows of five that occur twice or more; base_failed: fewer than 10 words
    or more than a fifth in such windows. kept: not failed, and within the limits of both distances (null where they are not asked for).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ref = stored(references(docs, common))
    rows = beside(prepared(docs), ref, [("lang", "ref_lang")], ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                by_lang: dict[str, tuple] = {}
                out = []
                for k, (lang, text) in enumerate(zip(part.column("lang").to_pylist(), part.column("text"), strict=True)):
                    if lang not in by_lang:
                        classes, named, counts, total = (part.column(c)[k].as_py() for c in ("ref_classes", "ref_common", "ref_counts", "ref_words"))
                        by_lang[lang] = (np.array(classes, float), named, np.array([*counts, total - sum(counts)], float), total)
                    out.append(row(text.as_py(), *by_lang[lang]))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    def row(text: str, classes: np.ndarray, named: list[str], counts: np.ndarray, total: int) -> tuple:
        chars = character_counts(text)
        index, numbers = numbered_words(text)
        n, again = len(numbers), repeated_words(numbers)
        failed = n < 10 or 100 * again > 20 * n
        one = other = None
        bad = False
        if n >= least and total >= least_reference:
            times = np.bincount(numbers, minlength=len(index))
            own = np.array([times[index[w]] if w in index else 0 for w in named])
            one, other = distance(chars[:CLASSES], classes), distance(np.append(own, n - own.sum()), counts)
            bad = exceeds(one, characters, CLASSES, len(text)) or exceeds(other, words, len(named) + 1, n)
        return n, len(text) - int(chars[CLASSES]), int(chars[CLASSES + 1]), repeated_lines(text), again, failed, not failed and not bad, one, other

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "character_distance", "common_distance"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, character_distance double, common_distance double")
