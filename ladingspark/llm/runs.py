"""Stretches of words that repeat with a period: all runs of a text, by Lyndon words.

The root of a run is the longest Lyndon word at one of its places, under the order of the words'
numbers or under the reverse order. So each text is scanned twice from right to left: what
has been scanned is a stack of Lyndon words, and a word takes those in front of it that are
larger than itself. Two suffixes are compared by their first words and, if these are equal, by their longest
common extension: a binary search over rolling hashes. A root is then extended to both sides in the same
way, and what is found is verified word by word: hashes only say where to look.

Defined results: a null or empty text has no words and no runs; repeated rows give repeated results; an
empty table gives an empty result; a null doc_id is left as it is by `planted`; very long texts are taken whole: words become numbers,
a piece of the text at a time. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces_of, text_of

#: Modulus and base of the rolling hash; words compared one by one before hashes are asked.
MODULUS, BASE, DIRECT = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1), 8
#: Words up to which numbers are held as a list, which is faster than an array and larger.
AS_LIST = 1 << 20
#: Words that are joined at a time for a digest.
JOINED = 1 << 16


def numbered(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Distinct words in order of first place, and the text as their numbers."""
    index: dict[bytes, int] = {}
    parts = []
    for piece in pieces_of(text):
        words = piece.split()
        new = [w for w in dict.fromkeys(words) if w not in index]
        index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
        parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    return list(index), np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Extensions:
    """Longest common extensions of places in a sequence of numbers."""

    def __init__(self, ids: Sequence[int]):
        self.ids, self.n = ids, len(ids)
        self.sums: array | None = None
        self.powers: array | None = None
        self.seen: dict[int, tuple[int, int]] = {}

    def prepare(self) -> None:
        sums, powers, h, p = array("Q", [0]), array("Q", [1]), 0, 1
        for x in self.ids:
            h = (h * BASE + x + 1) % MODULUS
            p = p * BASE % MODULUS
            sums.append(h)
            powers.append(p)
        self.sums, self.powers = sums, powers

    def same(self, i: int, j: int, size: int) -> bool:
        """By hashes, whether the stretches of that size at i and j are equal."""
        sums, p = self.sums, self.powers[size]
        return (sums[i + size] - sums[i] * p - sums[j + size] + sums[j] * p) % MODULUS == 0

    def searched(self, most: int, good) -> int:
        """Largest size up to most for which good holds, if it holds for all smaller ones: steps that double, then halving."""
        if self.sums is None:
            self.prepare()
        low, step = 0, 1
        while low + step <= most and good(low + step):
            low += step
            step *= 2
        high = min(most, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if good(middle) else (low, middle - 1)
        return low

    def forward(self, i: int, j: int) -> int:
        """Words that are equal from i and from j (the larger) on."""
        ids, n = self.ids, self.n
        size, most = 0, min(DIRECT, n - j)
        while size < most and ids[i + size] == ids[j + size]:
            size += 1
        if size < DIRECT or size == n - j:
            return size
        # The last answer at this distance holds on if it begins within what has just been compared.
        place, known = self.seen.get(j - i, (-1, 0))
        if i <= place <= i + size:
            size = place - i + known
        else:
            size += self.searched(n - j - size, lambda more: self.same(i + size, j + size, more))
        self.seen[j - i] = (i, size)
        return size

    def backward(self, i: int, j: int) -> int:
        """Words that are equal before i and before j (the larger)."""
        ids = self.ids
        size, most = 0, min(DIRECT, i)
        while size < most and ids[i - size - 1] == ids[j - size - 1]:
            size += 1
        if size < DIRECT or size == i:
            return size
        return size + self.searched(i - size, lambda more: self.same(i - size - more, j - size - more, more))


def lyndon_ends(ids: Sequence[int], lce: Extensions, reverse: bool) -> array:
    """Of each place the end of the longest Lyndon word that begins there: the next place whose suffix is smaller. An end of text is smallest."""
    n = len(ids)
    ends = array("i", [n]) * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, ids[i]
        while j < n:
            other = ids[j]
            if own == other:
                size = lce.forward(i, j)
                if j + size == n:
                    break
                larger = ids[i + size] > ids[j + size]
            else:
                larger = own > other
            if larger != reverse:
                break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(numbers: np.ndarray, least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of at least `least` words and `repeats` periods, by start, then period."""
    n = len(numbers)
    if n < least:
        return []
    ids = numbers.tolist() if n <= AS_LIST else array("i", numbers.astype(np.int32).tobytes())
    lce, found = Extensions(ids), set()
    for reverse in (False, True):
        ends = np.frombuffer(lyndon_ends(ids, lce, reverse), np.int32)
        begins = np.arange(n, dtype=np.int32)
        # A root can only be extended if the next word on one side is equal to the one a period before or after.
        right, left = ends < n, begins > 0
        right[right] = numbers[ends[right]] == numbers[begins[right]]
        left[left] = numbers[begins[left] - 1] == numbers[ends[left] - 1]
        latest: dict[int, tuple[int, int]] = {}
        for i in np.flatnonzero(right | left)[::-1].tolist():
            j = int(ends[i])
            period = j - i
            start, end = latest.get(period, (n, 0))
            if start <= i and j <= end:
                continue  # a root of the run that was found last
            end = j + (lce.forward(i, j) if j < n else 0)
            start = i - lce.backward(i, j)
            # What was compared word by word needs no proof.
            if (end - j >= DIRECT or i - start >= DIRECT) and not verified(ids, start, end, period):
                start, end = extended(ids, i, j)
            latest[period] = (start, end)
            if end - start >= max(least, repeats * period):
                found.add((start, end - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def verified(ids: Sequence[int], start: int, end: int, period: int) -> bool:
    """Whether the stretch has the period and ends where the period does, word by word."""
    stops = (start == 0 or ids[start - 1] != ids[start - 1 + period]) and (end == len(ids) or ids[end] != ids[end - period])
    return stops and all(ids[at : min(at + JOINED, end - period)] == ids[at + period : min(at + JOINED, end - period) + period] for at in range(start, end - period, JOINED))


def extended(ids: Sequence[int], i: int, j: int) -> tuple[int, int]:
    """Start and end of the period j - i around i and j, word by word: what remains if hashes were wrong."""
    start, end, period = i, j, j - i
    while end < len(ids) and ids[end] == ids[end - period]:
        end += 1
    while start and ids[start - 1] == ids[start - 1 + period]:
        start -= 1
    return start, end


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.flatnonzero(np.cumsum(depth[:n]) == 0)


def planted(numbers: np.ndarray, doc_id: object) -> np.ndarray:
    """The words as the query's contract has them: in a tenth of the documents, by the id's checksum, those from a place on repeat with a period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(numbers)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return numbers
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return numbers[np.where(at < a, at, a + (at - a) % p)]


def periodic_runs(docs: DataFrame, least: int = 6, repeats: int = 4, rewrite=None) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run; null without one), runs_sha256, collapsed_sha256.

    A run is a stretch of at least `least` words and `repeats` periods that no neighbouring word extends.
    rewrite: a function of the words' numbers and the doc_id that gives other numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

    def row(doc_id: object, text: bytes) -> tuple:
        words, numbers = numbered(text)
        if rewrite is not None:
            numbers = rewrite(numbers, doc_id)
        found = runs_of(numbers, least, repeats)
        listed, rest = hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(found), JOINED):
            listed.update("".join(f"{s},{size},{p}\n" for s, size, p in found[at : at + JOINED]).encode())
        kept = numbers[kept_words(len(numbers), found)] if found else numbers
        for at in range(0, len(kept), JOINED):
            rest.update((b" " if at else b"") + b" ".join(map(words.__getitem__, kept[at : at + JOINED].tolist())))
        start, length, period = min(found, key=lambda run: (-run[1], run[0], run[2])) if found else (None, None, None)
        return len(found), start, length, period, 1000 * length // period if found else None, listed.hexdigest(), rest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part.column(0), part.column(1).cast(pa.binary())
                columns = zip(*(row(i.as_py(), t.as_py()) for i, t in zip(ids, texts, strict=True)), strict=True)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema_names)

    schema_names = [c.split(" ")[0] for c in schema.split(", ")]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
