"""Byte-level BPE by longest matches and backtracking, in time linear in the text.

Bytes map to Latin-1 characters so that pyahocorasick finds, from any position
of a pre-token, the longest vocabulary entry that starts there: a first pass gives the
longest matches one after the other, others are looked up where a step back leads. The encoder
takes longest matches and steps back to shorter ones while the last two tokens
cannot stand side by side; positions found to lead nowhere are marked, so each
is tried once. Whether two tokens can be adjacent is decided by undoing their
merges in order of rank and is memoised. The result equals rank-order merging.

Pre-tokens are cut by the standard library's expressions, with the character classes spelled out as
ranges; texts with characters beyond U+FFFF go to the slower library that knows the classes.
The memory of pre-tokens and of adjacent pairs is bounded: when half of it is new, the older half goes.

Edge cases: a null text is empty: no ids, the digests of empty strings. Special
tokens are ordinary text. Every row is encoded, repeated rows too. ``encode`` keeps other
columns; its ``ids`` replace a column of that name. ``digests`` reads doc_id and text only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import emit

#: White space as Unicode's White_Space property; the library's \s has more (U+001C to U+001F).
PRETOKEN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}")
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _ranges(kind: str) -> str:
    """The characters up to U+FFFF of a class, as ranges."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{kind}+", every))


@lru_cache(1)
def finders():
    """findall of the pattern, for texts up to U+FFFF and for all."""
    fast = PRETOKEN
    for kind in (r"\p{White_Space}", r"\p{L}", r"\p{N}"):
        own = _ranges(kind)
        fast = re.sub(r"\[[^]]*\]|" + re.escape(kind), lambda m, kind=kind, own=own: m[0].replace(kind, own) if m[0][0] == "[" else f"[{own}]", fast)
    fast = fast.replace(r"\S", f"[^{_ranges(chr(92) + 'p{White_Space}')}]")
    return re.compile(fast).findall, regex.compile(PRETOKEN.replace(r"\S", r"\P{White_Space}")).findall


class ByteBPE:
    """Encoder for a rank file (lines of base64 token and rank)."""

    def __init__(self, path: str, cached: int = 160_000) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = dict(map(reversed, self.ranks.items()))
        self.decimal = {i: str(i) for i in self.tokens}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        top = max(self.tokens) + 1
        self.size = [len(self.tokens.get(i, b"")) for i in range(top)]
        prefix = {r: self._prefix(t) for t, r in self.ranks.items()}
        self.shorter = [prefix.get(i) for i in range(top)]
        for rank in sorted(self.tokens):
            self._learn(rank)
        self.adjacent.clear()
        self.pieces = _Pieces(self, cached)
        self.short, self.any = finders()

    def _prefix(self, token: bytes) -> int | None:
        """The longest proper prefix that is a token."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def _learn(self, rank: int) -> None:
        """Finds the last merge that makes a token, from the merges of lower rank."""
        token, left = self.tokens[rank], self.shorter[rank]
        while left is not None:
            right = self.ranks.get(token[len(self.tokens[left]) :])
            if right is not None and max(left, right) < rank and self._fits(left, right):
                self.split[rank] = left, right
                self.merged[left, right] = rank
                return
            left = self.shorter[left]

    def fits(self, left: int, right: int) -> bool:
        known = self.adjacent.get((left, right))
        if known is None:
            if len(self.adjacent) > 200_000:
                self.adjacent.clear()
            known = self.adjacent[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges that made the two tokens."""
        bound = 1 << 62
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            # Undo the later of the two last merges; what it made bounds the merges still open.
            for side in ((0, 1) if left > right else (1, 0)):
                if side == 0 and left in self.split:
                    bound, left = left, self.split[left][1]
                    break
                if side == 1 and right in self.split:
                    bound, right = right + 1, self.split[right][0]
                    break
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        said = raw.decode("latin-1")
        matches, size, shorter, adjacent = self.automaton.iter_long, self.size, self.shorter, self.adjacent
        longest = {end - n + 1: rank for end, (rank, n) in matches(said)}
        closed = bytearray(len(raw) + 1)  # positions from which no tokens reach the end
        out: list[int] = []
        pos, last, token = 0, -1, longest[0]
        while True:
            while token is not None:
                end = pos + size[token]
                if not closed[end]:
                    fits = last < 0 or adjacent.get((last, token))
                    if fits is None:
                        fits = self.fits(last, token)
                    if fits:
                        break
                token = shorter[token]
            else:
                closed[pos] = 1
                token = out.pop()
                pos -= size[token]
                last = out[-1] if out else -1
                token = shorter[token]
                continue
            if end == len(raw):
                return (*out, token)
            out.append(token)
            pos, last, token = end, token, longest.get(end)
            if token is None:
                token = longest[pos] = next(matches(said, pos))[1][0]

    def find(self, text: str) -> list[str]:
        return (self.any if BEYOND.search(text) else self.short)(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    """Ids of pre-tokens, at most ``cached``: those of this half and, until it is full, of the one before."""

    def __init__(self, encoder: ByteBPE, cached: int) -> None:
        self.encoder, self.half, self.before = encoder, cached // 2, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encoder.encode_piece(piece)
        if len(piece) <= 64:
            if len(self) >= self.half:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def encoder(path: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(path)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) in place of the text column."""
    if text_col != "ids":
        docs = docs.drop("ids")
    schema = docs.select(*[c for c in docs.columns if c != text_col]).withColumn("ids", F.array(F.lit(0))).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            ids = pa.array((own.encode(t or "") for t in batch.column(at).to_pylist()), pa.list_(pa.int32()))
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, ids], names=[*names, "ids"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, spaced) and of the bytes decoded from them; ``with_ids``: source and the ids too."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    named = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields, named = [*fields, ("source", pa.string()), ("ids", pa.list_(pa.int32()))], named + ", source string, ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)

        def rows():
            for batch in batches:
                for doc, text, *source in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                    ids = own.encode(text.as_py() or "")
                    said = " ".join(map(own.decimal.__getitem__, ids))
                    row = doc, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()
                    yield (*row, *source, ids) if with_ids else row

        yield from emit(rows(), schema, (lambda row: 4 * row[1]) if with_ids else None)

    return docs.select("doc_id", "text", *(["source"] if with_ids else [])).mapInArrow(run, named)


VOCABULARY = "byte_bpe_50k.tiktoken"


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digests(docs, public_tokenizers.path(VOCABULARY))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids themselves, per row of the mix, with its document and source."""
    return digests(docs, public_tokenizers.path(VOCABULARY), with_ids=True)
