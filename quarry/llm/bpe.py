"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters so that one Aho-Corasick automaton (pyahocorasick) over all tokens finds, in one
pass, the longest token that starts at each byte. Encoding walks the piece from left to right with the longest token and
backtracks to the next shorter one whenever two adjacent tokens are not compatible, i.e. the merges would not leave
that boundary standing. Compatibility of a pair is memoised, a bit per byte remembers dead ends, and so a piece of any
length takes time linear in its bytes and gives the tokens of the merge loop exactly.

Defined results: null text encodes as empty text (0 tokens); ids follow row order of the input; repeated rows give repeated
results; further input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the memo of encoded pieces, for each Python worker: two generations of so many entries, pieces up to so many bytes.
MEMO_ENTRIES, MEMO_BYTES = 100_000, 64
#: Bound of the memo of token pairs, for each Python worker.
PAIR_ENTRIES = 400_000

ENCODED_SCHEMA = "doc_id long, ids binary, n_tokens long"


#: A space between two white spaces, or between one and the text's end: white space runs across it. At every other space
#: the split pattern has a boundary, and what is on either side splits on its own.
_RUN = re.compile(r" (?<=\s )(?:\s|\Z)")


def splits_at_spaces(pattern: str) -> bool:
    """Whether the pattern is the one of which it is known that every single space starts a piece and that letters with at most one
    space before them are one piece."""
    import public_tokenizers

    return pattern == public_tokenizers.PATTERN


class ByteBPE:
    """Encoder and decoder for a rank file: one base64 token and its rank a line."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for tok, rank in ranks.items():
            self.tokens[rank] = tok
        self.sizes = [len(tok) for tok in self.tokens]
        self.find = regex.compile(pattern).findall
        self.by_words = splits_at_spaces(pattern)
        self._splits()
        self.auto = ahocorasick.Automaton()
        for tok, rank in ranks.items():
            if rank in self.reachable:
                self.auto.add_word(tok.decode("latin-1"), (len(tok) - 1, rank))
        self.auto.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def _splits(self) -> None:
        """For each token the last pair that the merges join for it; tokens that the merges never make stay out."""
        self.left, self.right, self.pair = {}, {}, {}
        self.reachable: set[int] = set()
        for tok, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(tok) == 1:
                self.left[rank] = self.right[rank] = rank
                self.reachable.add(rank)
                continue
            parts = self._merge(tok, below=rank)
            if len(parts) == 2:
                a, b = (self.ranks[p] for p in parts)
                self.left[rank], self.right[rank] = a, b
                self.pair[a, b] = rank
                self.reachable.add(rank)
        self.shorter = {}
        for rank in self.reachable:
            tok = self.tokens[rank]
            self.shorter[rank] = next((r for n in range(len(tok) - 1, 0, -1) if (r := self.ranks.get(tok[:n], -1)) in self.reachable), -1)

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        """The merge loop by its definition, with ranks under ``below`` only; used on single tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a boundary between tokens a and b: undo merges, latest first, looking for an earlier one across it."""
        x, y, limit = a, b, len(self.tokens)
        while True:
            joined = self.pair.get((x, y))
            if joined is not None and joined < limit:
                fits = False
                break
            if x > y:
                limit, x = x, self.right[x]
                if x != limit:
                    continue
                limit, y = y + 1, self.left[y]
                if y + 1 == limit:
                    fits = True
                    break
            else:
                limit, y = y + 1, self.left[y]
                if y + 1 != limit:
                    continue
                limit, x = x, self.right[x]
                if x == limit:
                    fits = True
                    break
        if len(self.compatible) >= PAIR_ENTRIES:
            self.compatible.clear()
        self.compatible[a, b] = fits
        return fits

    def _encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [-1] * n
        for end, (size, rank) in self.auto.iter(raw.decode("latin-1")):
            longest[end - size] = rank  # ends grow, so the last is the longest; sizes are stored less 1
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        sizes, known, last = self.sizes, self.compatible, -1
        at, token = 0, longest[0]
        while at < n:
            end = at + sizes[token]
            if open_at[end]:
                fits = known.get((last, token)) if out else True
                if fits or fits is None and self._fits(last, token):
                    out.append(token)
                    at, last = end, token
                    if at < n:
                        token = longest[at]
                    continue
            token = self.shorter[token]
            if token < 0:
                open_at[at] = 0
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
        return out

    def encode_to_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Words with the space before them are looked up whole; only unknown ones meet the split pattern. Texts with runs
        of white space around a space, where the pattern looks further, go to the pattern as they are, and so do all texts
        under a pattern that is not known to split at spaces."""
        if not self.by_words or _RUN.search(text) is not None:
            return b"".join(map(self._remembered, self.find(text)))
        words = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.find(text)
        out = list(map(self.words.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._word(words[i])
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older_words.get(word)
        if ids is None:
            if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):  # letters only: one piece
                ids = self._remembered(word)
            else:
                ids = b"".join(map(self._remembered, self.find(word)))
        if len(word) <= MEMO_BYTES:
            if len(self.words) >= MEMO_ENTRIES:
                self.words, self.older_words = {}, self.words
            self.words[word] = ids
        return ids

    def _remembered(self, piece: str) -> bytes:
        ids = self.memo.get(piece) or self.older.get(piece)
        if ids is None:
            ids = array("I", self._encode_piece(piece)).tobytes()
        if len(piece) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_to_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict = {}


def load(rank_file: str, pattern: str) -> ByteBPE:
    """One encoder for each Python worker and vocabulary; workers are reused between tasks."""
    key = (rank_file, pattern)
    if key not in _loaded:
        _loaded[key] = ByteBPE(rank_file, pattern)
    return _loaded[key]


def load_tokens(rank_file: str) -> list[bytes]:
    """The bytes of each token, all that decoding needs."""
    key = (rank_file, "")
    if key not in _loaded:
        with open(rank_file, "rb") as f:
            ranks = {int(rank): base64.b64decode(tok) for tok, rank in (line.split() for line in f if line.strip())}
        _loaded[key] = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
    return _loaded[key]


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids, n_tokens) for each row of ``docs`` (doc_id, text). ``rank_file`` is a path that every worker can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for batch in batches:
            ids = [bpe.encode_to_bytes(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED_SCHEMA)


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded binary) for each row of ``encode``'s result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = load_tokens(rank_file).__getitem__
        for batch in batches:
            raw = [b"".join(map(token, np.frombuffer(x.as_py() or b"", dtype="<u4").tolist())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, ENCODED_SCHEMA + ", decoded binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded): ``decode`` of ``encode``, by one Python worker a task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        token = bpe.tokens.__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = [bpe.encode_to_bytes(t.as_py() or "") for t in part.column(1)]
                raw = [b"".join(map(token, np.frombuffer(x, dtype="<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED_SCHEMA + ", decoded binary")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
