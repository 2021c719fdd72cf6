"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece the unique last token of its encoding is stored. The candidates are
the vocabulary tokens that end there (an automaton over all tokens gives them); a candidate
stands if the last token of the prefix before it can stand next to it, that is, if merging
would not cross the border between the two. Following the last tokens back gives the ids.
A long text goes in parts that end where a piece ends in any case, so that beside the text only
its ids are held, four bytes each, and what one part or one piece needs.

The rules for cutting a text into pieces, and added tokens, are read from the tokenizer's file.
Defined results: a null text is the empty text, with no ids; every other text is encoded whole,
piece by piece, however long; an empty table gives no row; a vocabulary that lacks a token for some
single byte can't encode every text and is refused.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import parts_of, text_of

#: Pieces and pairs whose results are remembered (all are forgotten when so many are there), and the longest piece that is remembered; they bound memory alone.
CACHE_PIECES, CACHE_PAIRS, CACHE_CHARS = 1_000_000, 1 << 19, 64
#: Ids that are looked up at a time where ids become numerals or bytes.
LOOKED_UP = 1 << 16
#: The pattern by which byte-level BPE files with "use_regex" cut a text.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space by Unicode's White_Space property, for \s in the pattern above.
BLANK = r"\p{White_Space}"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable ones for themselves, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pieces(dict):
    """The ids of pieces, four bytes each; a piece that is not remembered is worked out."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class PrefixBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: raw(t) for t, i in vocab.items() if t not in self.added}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.single = {raw(t)[0]: i for t, i in vocab.items() if len(t) == 1 and t in letters}
        if len(self.single) < 256:
            raise ValueError(f"the vocabulary has tokens for {len(self.single)} of 256 single bytes")
        #: rank and result of joining two ids; the parts and rank of an id that a merge makes.
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.joined[pair] = (rank, whole)
            self.parts.setdefault(whole, (rank, *pair))
        self.ending = ahocorasick.Automaton()
        for i in [*self.single.values(), *self.parts]:
            self.ending.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.size_of = {i: len(data) for i, data in self.bytes_of.items()}
        self.ending.make_automaton()
        self.piece = regex.compile(PIECE.replace(r"[^\s", f"[^{BLANK}").replace(r"\S", rf"\P{{White_Space}}").replace(r"\s", BLANK))
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.fits: dict[int, bool] = {}
        self.known = Pieces(self.piece_ids)
        self.numerals = np.array([str(i) for i in range(max(self.bytes_of) + 1)], object)
        self.written = np.full(len(self.numerals), b"", object)
        for i, data in self.bytes_of.items():
            self.written[i] = data

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes leaves a border between them.

        Take the two apart in the reverse order of their merges. At each step the tokens that
        meet at the border must not have a merge that would have come before the merges that
        made what stands there.
        """
        a, b, before = left, right, 1 << 60
        good = True
        while True:
            rank = self.joined.get((a, b), (1 << 60,))[0]
            # Equal ranks can only be the same pair overlapping itself; the left one is taken first.
            if rank < before:
                good = False
                break
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                break
            if pb is None or (pa_ is not None and pa_[0] > pb[0]):
                before, a = pa_[0], pa_[2]
            else:
                # A merge on the right that has the same rank as one over the border comes after it.
                before, b = pb[0] + 1, pb[1]
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        self.fits[left << 32 | right] = good
        return good

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece, worked out."""
        data = piece.encode().decode("latin-1")
        end = len(data)
        last = [-1] * (end + 1) if end <= 4 * CACHE_CHARS else array("i", [-1]) * (end + 1)
        fits, compatible = self.fits.get, self.compatible
        for at, (token, size) in self.ending.iter(data):
            at += 1
            if last[at] < 0:
                if at != size:
                    left = last[at - size]
                    good = fits(left << 32 | token)
                    if not good and (good is False or not compatible(left, token)):
                        continue
                last[at] = token
        out, size_of = array("i"), self.size_of
        while end:
            token = last[end]
            out.append(token)
            end -= size_of[token]
        out.reverse()
        return out.tobytes()

    def ids_by_part(self, text: str) -> Iterator[array]:
        """Ids of the text, a part at a time."""
        ids_of = self.known.__getitem__
        for section in parts_of(text):
            out = array("i")
            for part in self.split_added.split(section) if self.split_added else [section]:
                if part in self.added:
                    out.append(self.added[part])
                else:
                    out.frombytes(b"".join(map(ids_of, self.piece.findall(part))))
            yield out

    def encode(self, text: str) -> array:
        out = array("i")
        for ids in self.ids_by_part(text):
            out += ids
        return out

    def forget(self) -> None:
        """Drop what is remembered of pieces and pairs."""
        self.known.clear()
        self.fits.clear()

    @staticmethod
    def looked_up(table: np.ndarray, ids: Sequence[int]) -> Iterator[list]:
        """The table's entries of the ids, some at a time."""
        places = np.asarray(ids, np.int32)
        for start in range(0, len(places), LOOKED_UP):
            yield table[places[start : start + LOOKED_UP]].tolist()

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(b"".join(some) for some in self.looked_up(self.written, ids)).decode("utf-8", "replace")

    def listed(self, ids: Sequence[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(",".join(some) for some in self.looked_up(self.numerals, ids))


@lru_cache(maxsize=4)
def loaded(content: str) -> PrefixBpe:
    return PrefixBpe(content)


def encode(docs: DataFrame, tokenizer_json: str, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the ids and (with_text) the decoded text.

    Workers outlive a task and go on to other stages; the encoder stays in them, what it remembers of
    the texts does not.

    tokenizer_json: the file's content; at most a few MB, it travels with the task. Other columns
    are not looked at; repeated rows give repeated results.
    """
    if len(tokenizer_json) > 32 << 20:
        raise ValueError("the tokenizer file is over 32 MB")
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "") + (", decoded string" if with_ids and with_text else "")

    def digests(bpe: PrefixBpe, text: str) -> tuple[int, str, str, np.ndarray | None, str | None]:
        """The row of a text; without ids nothing of a part is held but its digests' state."""
        n, ids_sha, text_sha, all_ids, decoded = 0, hashlib.sha256(), hashlib.sha256(), array("i"), []
        for ids in bpe.ids_by_part(text):
            if len(ids):
                ids_sha.update((("," if n else "") + bpe.listed(ids)).encode())
            n += len(ids)
            back = bpe.decode(ids)
            text_sha.update(back.encode())
            if with_ids:
                all_ids += ids
            if with_ids and with_text:
                decoded.append(back)
        return n, ids_sha.hexdigest(), text_sha.hexdigest(), np.frombuffer(all_ids, np.int32) if with_ids else None, "".join(decoded) if with_ids and with_text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    n, ids_sha, dec_sha, ids, decoded = zip(*(digests(bpe, text.as_py()) for text in part.column("text")), strict=True)
                    cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(dec_sha)]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                    if with_ids and with_text:
                        cols, names = [*cols, pa.array(decoded)], [*names, "decoded"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
        finally:
            bpe.forget()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
