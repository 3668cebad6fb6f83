"""Byte-level BPE encoding and decoding, in time linear in the text.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton of all vocabulary tokens can run over a
piece of text. A sequence of tokens is the result of the merges exactly if each two adjacent tokens are
compatible, that is, if merging their joined bytes gives these two again. The encoder takes the longest token at
each place, and steps back to shorter ones (marking places from which no way leads on) where neighbours aren't
compatible. Answers about neighbours are remembered, as are the ids of pieces seen before, both within bounds: a
memory that is full is emptied, and a text always gets its ids from what was found for it, not from the memory.

Defined results: null texts are empty, the empty text has no ids; texts are taken whole, whatever their length;
ids of special tokens never come up; repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glossmill.llm.common import slices

#: Pieces, their characters and pairs that are remembered at most; beyond that, a memory is emptied.
PIECES, PIECE_CHARS, PAIRS = 800_000, 16_000_000, 1_000_000
#: Stands between pieces: no byte maps to it.
BETWEEN = "Ā"

VOCABULARY = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def table(ranks: bytes) -> dict[bytes, int]:
    """The tokens of a file of lines of a token in base 64 and its rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}


def splitter(pattern: str = public_tokenizers.PATTERN) -> Callable[[str], list[str]]:
    """What cuts a text into pieces. For the public pattern, two forms that cut alike and sooner: letters, the most
    frequent pieces, are tried first (none of the other pieces begins with one), and texts of ASCII only, of which
    letters, digits and spaces are few, go to the standard library."""
    if pattern != public_tokenizers.PATTERN:
        return regex.compile(pattern).findall
    every = regex.compile(r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
    space = "".join(map(re.escape, filter(regex.compile(r"\s").match, map(chr, range(128)))))
    ascii_only = re.compile(rf" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^{space}A-Za-z0-9]+|[{space}]+(?![^{space}])|[{space}]+").findall
    return lambda text: ascii_only(text) if text.isascii() else every(text)


class Encoder:
    """Encodes and decodes by the ranks of a file: lines of a token in base 64 and its rank, which is its id."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = table(ranks)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.split = splitter(pattern)
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for t, r in self.ranks.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.pieces: dict[str, bytes] = {}
        self.piece_chars = 0
        self.pairs: dict[int, bool] = {}
        self.prefix: dict[int, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges as they are defined: join the adjacent parts of lowest rank, leftmost first, while any can be."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            if rank == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def shorter(self, token: int) -> int:
        """The longest token that this one begins with, other than itself; -1 if there is none."""
        if (known := self.prefix.get(token)) is None:
            whole = self.tokens[token]
            known = self.prefix[token] = next((r for n in range(len(whole) - 1, 0, -1) if (r := self.ranks.get(whole[:n])) is not None), -1)
        return known

    def backtracked(self, piece: str, taken: list[int], token: int) -> list[int]:
        """The ids of a piece (in Latin-1). taken: compatible tokens that it begins with; token: one that doesn't fit on."""
        tokens, pairs, prefix, longest = self.tokens, self.pairs, self.prefix, self.longest
        at, size, dead = sum(len(tokens[t]) for t in taken), len(piece), bytearray(len(piece) + 1)
        token = self.shorter(token)
        while at < size:
            while token >= 0:
                if not dead[at + len(tokens[token])]:
                    if not taken:
                        break
                    fits = pairs.get(taken[-1] << 32 | token)
                    if self.compatible(taken[-1], token) if fits is None else fits:
                        break
                token = prefix[token] if token in prefix else self.shorter(token)
            if token >= 0:
                taken.append(token)
                at += len(tokens[token])
                if at < size:
                    token = next(self.automaton.iter_long(piece[at : at + longest]))[1]
            else:
                dead[at] = 1
                token = taken.pop()
                at -= len(tokens[token])
                token = self.shorter(token)
        return taken

    def found(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece: one run of the automaton over all, as longest tokens mostly fit together."""
        raw = [p.encode() for p in pieces]
        whole = [self.ranks.get(b) for b in raw]
        left = [(p, b.decode("latin-1")) for p, b, r in zip(pieces, raw, whole) if r is None]
        out = {p: r.to_bytes(4, "little") for p, r in zip(pieces, whole) if r is not None}
        if not left:
            return out
        run = self.automaton.iter_long(BETWEEN.join(s for _, s in left))
        begin, pairs = 0, self.pairs
        for piece, s in left:
            ids, end, last = [], begin + len(s) - 1, -1
            for at, token in run:
                if last >= 0:
                    known = pairs.get(last << 32 | token)
                    if not (self.compatible(last, token) if known is None else known):
                        if at < end:  # the rest of this piece
                            for at, _ in run:
                                if at == end:
                                    break
                        ids = self.backtracked(s, ids, token)
                        break
                ids.append(token)
                if at == end:
                    break
                last = token
            out[piece] = array("I", ids).tobytes()
            begin = end + 2
        return out

    def remember(self, made: dict[str, bytes]) -> None:
        chars = sum(map(len, made))
        if len(self.pieces) + len(made) > PIECES or self.piece_chars + chars > PIECE_CHARS:
            self.pieces.clear()
            self.piece_chars = 0
        if len(made) <= PIECES and chars <= PIECE_CHARS:
            self.pieces.update(made)
            self.piece_chars += chars

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, whatever the memory has room for."""
        out = list(map(self.pieces.get, pieces))
        if None in out:
            made = self.found(list({p for p, i in zip(pieces, out) if i is None}))
            out = [made[p] if i is None else i for p, i in zip(pieces, out)]
            self.remember(made)
        return out

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        return b"".join(self.ids_of(self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(ranks: bytes, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """The encoder of these ranks, built once a process."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def over_texts(
    docs: DataFrame, columns: list[str], row: Callable[[Encoder, str], tuple], schema: pa.Schema, ddl: str, path: str | None = None
) -> DataFrame:
    """columns of docs, and what row gives for each text. The rank file is read here and sent to the workers."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in slices(batches):
            made = list(zip(*(row(enc, t or "") for t in batch.column("text").to_pylist()))) or [[]] * len(schema)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(m, f.type) for m, f in zip(made, schema))], names=[*columns, *schema.names])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return docs.select(*columns, docs["text"].cast("string").alias("text")).mapInArrow(run, kept + ddl)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens."""
    schema = pa.schema([("ids", pa.binary()), ("n_tokens", pa.int64())])

    def row(enc: Encoder, text: str) -> tuple:
        ids = enc.encode(text)
        return ids, len(ids) // 4

    return over_texts(docs, ["doc_id"], row, schema, "ids binary, n_tokens long", path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text's own bytes (round_trip)."""
    schema = pa.schema([("ids", pa.binary()), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())])

    def row(enc: Encoder, text: str) -> tuple:
        ids = enc.encode(text)
        return ids, len(ids) // 4, enc.decode(ids) == text.encode()

    return over_texts(docs, ["doc_id"], row, schema, "ids binary, n_tokens long, round_trip boolean", path)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows of ids; bytes that are no UTF-8 become replacement characters."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in slices(batches):
            texts = [None if i is None else enc.decode(i).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again."""
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(enc: Encoder, text: str) -> tuple:
        ids = enc.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()

    return over_texts(docs, ["doc_id"], row, schema, "n_tokens long, ids_sha256 string, decoded_sha256 string", path)
