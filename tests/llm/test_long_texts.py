"""Very long texts and runs: whole results in bounded memory."""

from __future__ import annotations

import itertools
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from ladingspark.llm import bpe, common, simhash, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RUNS = (" ", "\n", "x", "7", "#", "　", " \n", "a ", "ab é")


def lengths(spark, texts):
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, length long")
    found = token_counts.lengths(docs.orderBy("length").coalesce(1), Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_text(), public_tokenizers.PATTERN)
    return [r["length"] for r in found.collect()]


def test_runs_equal_the_library(spark):
    real = Tokenizer.from_file(JSON)
    own = bpe.PrefixBpe(Path(JSON).read_text())
    texts = [pre + c * (25_000 // len(c)) + post for c in RUNS for pre, post in (("", ""), ("word", "word"), ("a\n", " b"), ("x ", "\t7"))]
    ids = [real.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(own.encode(t)) for t in texts] == ids
    assert lengths(spark, texts) == [len(x) for x in ids]


def test_runs_that_the_pattern_engine_cannot_take(spark):
    own = bpe.PrefixBpe(Path(JSON).read_text())
    texts = ["go " + c * 2_000_000 + "w" for c in (" ", "\n", "x", "7")] + [" " * 1_000_000, "\n" * 1_000_000]
    assert lengths(spark, texts) == [len(own.encode(t)) for t in texts]


def test_parts_end_between_word_and_blank(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ab  \n\t'é\x1c"), 5000))
    own = bpe.PrefixBpe(Path(JSON).read_text())
    whole = list(own.encode(text))
    monkeypatch.setattr(common, "PART_CHARS", 7)
    parts = list(common.parts_of(text))
    assert "".join(parts) == text and len(parts) > 100
    assert list(own.encode(text)) == whole == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_shingles_of_a_text_in_pieces(monkeypatch, shingle):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, shingle - 1, shingle, shingle + 1, 400):
        words = [f"w{k}" for k in rng.integers(0, 30, n)]
        text = " \n".join(words)
        cuts = [" ".join(words[i : i + shingle]) for i in range(n - shingle + 1)] or ([" ".join(words)] if words else [])
        for size in (1, 9, 1 << 20):
            monkeypatch.setattr(common, "PIECE_BYTES", size)
            assert list(simhash.hashes_of(text, shingle, 42)) == [xxhash.xxh64_intdigest(c.encode(), 42) for c in cuts]


def test_memory_of_a_long_text():
    rng = np.random.default_rng(5)
    text = " ".join(itertools.chain.from_iterable([f"w{k}" for k in rng.integers(0, 9999, 1 << 15)] for _ in range(40)))
    own = bpe.PrefixBpe(Path(JSON).read_text())
    own.encode(text[: 1 << 20])
    for work in (lambda: own.encode(text), lambda: simhash.fingerprint(simhash.hashes_of(text, 3, 42))):
        tracemalloc.start()
        work()
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert most < 10 * len(text)
