"""Token counts under edits: a segment tree of pre-tokens per document.

A document's pre-tokens (the pieces that the tokeniser's pattern cuts, which are encoded separately) are kept in
leaves of some LEAF pieces, with their characters and tokens, under a segment tree of sums. The tree is part of
the stored state. An edit replaces a range of characters: the tree says which leaves hold it, those leaves' text is
cut and encoded again from shortly before the range up to the first old boundary behind it from which the old
pieces hold on, and the sums above are updated. Text and pieces of other leaves are neither cut nor encoded nor
looked at; when the row is written again they are copied as they lie.

The context before: whether a piece ends where it does depends on two characters behind its end at most, so pieces
that end two or more before the range stay. Behind the range: cutting goes from left to right and doesn't look
back, so it goes on as before once it meets an old boundary; leaves are taken on until it does.

Defined results: null texts are empty; edits apply in the order of their number, each to the text that the former
ones left; ranges are clipped to the text, a null replacement is empty; documents without edits keep their counts;
edits of unknown documents are dropped; an empty table gives an empty result. Texts may have any length: pieces that
the memory of the encoder has no room for are found anew.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.bpe import VOCABULARY, Encoder, encoder, read_ranks
from glossmill.llm.common import fresh, slices

#: Pieces of a leaf; one that has grown fourfold is split, and the sums are built anew from those of the leaves.
LEAF = 64
#: Characters behind a piece's end on which the end may depend.
CONTEXT = 2
EDITS = "array<struct<start:int,end:int,text:string>>"
STATE = "text string, piece_chars binary, piece_tokens binary, tree binary, n_tokens long"


def counted(enc: Encoder, pieces: list[str]) -> list[int]:
    """Tokens of each piece."""
    return [len(ids) >> 2 for ids in enc.ids_of(pieces)]


def packed(numbers: list[int]) -> bytes:
    """Numbers in a byte each, or in four if one needs more; the first byte says which."""
    return b"\1" + bytes(numbers) if max(numbers, default=0) < 256 else b"\4" + array("I", numbers).tobytes()


def unpacked(data: bytes, first: int, last: int) -> list[int]:
    if data[0] == 1:
        return list(data[1 + first : 1 + last])
    out = array("I")
    out.frombytes(data[1 + 4 * first : 1 + 4 * last])
    return out.tolist()


def heap(sums: list[int]) -> list[int]:
    """A segment tree: the sums from half its length on, and above each two of them theirs, down to the total at 1."""
    size = 1 << max(0, len(sums) - 1).bit_length()
    out = [0] * size + sums + [0] * (size - len(sums))
    for i in range(size - 1, 0, -1):
        out[i] = out[2 * i] + out[2 * i + 1]
    return out


class Leaf:
    """Pieces that follow on each other: where they are in the stored row, or, once touched, they themselves."""

    __slots__ = ("at", "first", "pieces", "text", "chars", "tokens")

    def __init__(self, at: int, first: int, pieces: int):
        self.at, self.first, self.pieces = at, first, pieces
        self.text: str | None = None


class PieceTree:
    """Characters and tokens of the pieces of one document, summed over leaves in two segment trees."""

    def __init__(self, text: str, piece_chars: bytes, piece_tokens: bytes, tree: bytes):
        self.stored = text, piece_chars, piece_tokens
        numbers = array("i")
        numbers.frombytes(tree)
        n = numbers[0]
        self.size = 1 << max(0, n - 1).bit_length()
        self.chars = numbers[1 + n : 1 + n + 2 * self.size].tolist()
        self.tokens = numbers[1 + n + 2 * self.size :].tolist()
        self.leaves: list[Leaf] = []
        at = first = 0
        for pieces, chars in zip(numbers[1 : 1 + n], self.chars[self.size :]):
            self.leaves.append(Leaf(at, first, pieces))
            at, first = at + chars, first + pieces

    @staticmethod
    def built(enc: Encoder, text: str) -> tuple[bytes, bytes, bytes, int]:
        """piece_chars, piece_tokens, tree, n_tokens of a text that is read whole."""
        pieces = enc.split(text)
        chars, tokens = list(map(len, pieces)), counted(enc, pieces)
        starts = range(0, max(1, len(pieces)), LEAF)
        sums = [heap([sum(x[i : i + LEAF]) for i in starts]) for x in (chars, tokens)]
        tree = array("i", [len(starts), *(min(LEAF, len(pieces) - i) for i in starts), *sums[0], *sums[1]])
        return packed(chars), packed(tokens), tree.tobytes(), sums[1][1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return sum(leaf.pieces for leaf in self.leaves)

    def touched(self, k: int) -> Leaf:
        """A leaf with its text and pieces."""
        leaf = self.leaves[k]
        if leaf.text is None:
            text, chars, tokens = self.stored
            leaf.chars = unpacked(chars, leaf.first, leaf.first + leaf.pieces)
            leaf.tokens = unpacked(tokens, leaf.first, leaf.first + leaf.pieces)
            leaf.text = text[leaf.at : leaf.at + self.chars[self.size + k]]
        return leaf

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (past the end, the last one with any), and where it begins."""
        at, begin = 1, 0
        if not self.chars[1]:
            return 0, 0
        char = max(0, min(char, self.chars[1] - 1))
        while at < self.size:
            at *= 2
            if char >= begin + self.chars[at]:
                begin += self.chars[at]
                at += 1
        return at - self.size, begin

    def update(self, k: int) -> None:
        """The sums above a leaf that was touched."""
        leaf = self.leaves[k]
        for sums, now in ((self.chars, len(leaf.text)), (self.tokens, sum(leaf.tokens))):
            i = self.size + k
            change = now - sums[i]
            while i and change:
                sums[i] += change
                i >>= 1

    def edit(self, enc: Encoder, start: int, end: int, new: str) -> int:
        """Replaces the characters from start to end; how many pieces were encoded again."""
        length = self.chars[1]
        start = min(max(start, 0), length)
        end = min(max(end, start), length)
        shift = len(new) - (end - start)
        first, begin = self.find(start - CONTEXT)
        head = self.touched(first)
        keep, kept = 0, 0  # pieces of the first leaf that stay, and their characters
        while keep < head.pieces - 1 and begin + kept + head.chars[keep] <= start - CONTEXT:
            kept += head.chars[keep]
            keep += 1
        # what is cut again, from the first piece that may change: leaves up to the one behind the range, then more
        last, text = first, head.text[kept:]
        at = begin + kept
        more = 1

        def extend() -> bool:
            nonlocal last, text, more
            part = [self.touched(k).text for k in range(last + 1, min(len(self.leaves), last + 1 + more))]
            last, text, more = last + len(part), text + "".join(part), 2 * more
            return bool(part)

        while at + len(text) < end + CONTEXT and extend():
            pass
        text = text[: start - at] + new + text[end - at :]
        begin_old, new_end = at, start - at + len(new)
        leaf, i, old = first, keep, begin_old  # the old boundary that new ones are held against
        pieces: list[str] = []
        done, synced = 0, False
        whole = last == len(self.leaves) - 1
        while not synced:
            for m in enc.pattern.finditer(text, done):
                if not whole and m.end() > len(text) - CONTEXT:
                    break
                pieces.append(m[0])
                done = m.end()
                if done < new_end:
                    continue
                want = begin_old + done - shift
                while old < want and leaf <= last:
                    behind = self.leaves[leaf]
                    if i < behind.pieces:
                        old += behind.chars[i]
                        i += 1
                    else:
                        leaf, i = leaf + 1, 0
                if synced := old == want and old >= end:
                    break
            else:
                if whole:
                    leaf, i, old = last, self.leaves[last].pieces, length
                    break
            if not synced:
                whole = not extend() or last == len(self.leaves) - 1
        if leaf > last:
            leaf, i = last, self.leaves[last].pieces
        behind = self.leaves[leaf]
        rest = sum(behind.chars[i:])
        tail, tail_chars, tail_tokens = behind.text[len(behind.text) - rest :] if rest else "", behind.chars[i:], behind.tokens[i:]
        head.text = head.text[:kept] + "".join(pieces) + tail
        head.chars = head.chars[:keep] + [len(p) for p in pieces] + tail_chars
        head.tokens = head.tokens[:keep] + counted(enc, pieces) + tail_tokens
        head.pieces = len(head.chars)
        for k in range(first + 1, leaf + 1):
            self.leaves[k].text, self.leaves[k].chars, self.leaves[k].tokens, self.leaves[k].pieces = "", [], [], 0
        if head.pieces > 4 * LEAF:
            self.split(first)
        else:
            for k in range(first, leaf + 1):
                self.update(k)
        return len(pieces)

    def split(self, k: int) -> None:
        """A leaf cut into small ones, leaves without pieces left out, and the sums built anew from the leaves' sums."""
        big, parts, at = self.leaves[k], [], 0
        for i in range(0, big.pieces, LEAF):
            part = Leaf(0, 0, min(LEAF, big.pieces - i))
            part.chars, part.tokens = big.chars[i : i + LEAF], big.tokens[i : i + LEAF]
            size = sum(part.chars)
            part.text = big.text[at : at + size]
            at += size
            parts.append(part)
        sums = [(leaf, c, t) for leaf, c, t in zip(self.leaves, self.chars[self.size :], self.tokens[self.size :])]
        sums[k : k + 1] = [(p, len(p.text), sum(p.tokens)) for p in parts]
        sums = [(leaf, len(leaf.text), sum(leaf.tokens)) if leaf.text is not None else (leaf, c, t) for leaf, c, t in sums if leaf.pieces]
        self.leaves = [x[0] for x in sums]
        self.chars, self.tokens = heap([x[1] for x in sums]), heap([x[2] for x in sums])
        self.size = len(self.chars) // 2

    def flat(self) -> tuple[str, bytes, bytes, bytes]:
        """text, piece_chars, piece_tokens and tree for the stored row: what wasn't touched is copied as it lies."""
        text, *stored = self.stored
        runs: list[list] = []  # leaves that lie side by side in the stored row are one run
        for k, leaf in enumerate(self.leaves):
            if leaf.text is not None:
                runs.append([leaf, 0, 0, 0, 0])
            else:
                end = leaf.at + self.chars[self.size + k]
                if runs and runs[-1][0] is None and runs[-1][4] == leaf.first:
                    runs[-1][2], runs[-1][4] = end, leaf.first + leaf.pieces
                else:
                    runs.append([None, leaf.at, end, leaf.first, leaf.first + leaf.pieces])
        out = []
        for which, data in zip(("chars", "tokens"), stored):
            narrow = data[0] == 1 and all(max(getattr(r[0], which), default=0) < 256 for r in runs if r[0])
            if narrow:
                out.append(b"\1" + b"".join(bytes(getattr(r[0], which)) if r[0] else data[1 + r[3] : 1 + r[4]] for r in runs))
            else:
                out.append(packed([x for r in runs for x in (getattr(r[0], which) if r[0] else unpacked(data, r[3], r[4]))]))
        tree = array("i", [len(self.leaves), *(leaf.pieces for leaf in self.leaves), *self.chars, *self.tokens])
        return "".join(r[0].text if r[0] else text[r[1] : r[2]] for r in runs), *out, tree.tobytes()


def build_state(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, piece_chars, piece_tokens, tree, n_tokens: the state that is kept, from which edits start."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in slices(batches):
            text = pc.fill_null(batch.column("text"), "")
            chars, tokens, tree, n = zip(*(PieceTree.built(enc, t) for t in text.to_pylist()))
            parts = [
                batch.column("doc_id"), text, pa.array(chars, pa.binary()), pa.array(tokens, pa.binary()), pa.array(tree, pa.binary()),
                pa.array(n, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(parts, names=["doc_id", "text", "piece_chars", "piece_tokens", "tree", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {STATE}")


def apply_listed(state: DataFrame, path: str | None = None) -> DataFrame:
    """State rows that also have edits (an array of start, end, text): the state after them, the count before them
    (n_before), and how many edits there were (n_edits), pieces (n_pieces) and pieces encoded again (n_reencoded)."""
    ranks = state.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))
    fields = [
        ("text", pa.string()), ("piece_chars", pa.binary()), ("piece_tokens", pa.binary()), ("tree", pa.binary()), ("n_tokens", pa.int64()),
        ("n_before", pa.int64()), ("n_edits", pa.int32()), ("n_pieces", pa.int32()), ("n_reencoded", pa.int32()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in slices(batches):
            out = []
            for text, chars, tokens, tree, before, edits in zip(
                *(batch.column(c).to_pylist() for c in ("text", "piece_chars", "piece_tokens", "tree", "n_tokens", "edits"))
            ):
                kept, again = PieceTree(text, chars, tokens, tree), 0
                for e in edits or ():
                    again += kept.edit(enc, e["start"] or 0, e["end"] or 0, e["text"] or "")
                row = kept.flat() if edits else (text, chars, tokens, tree)
                out.append((*row, kept.total, before, len(edits or ()), kept.n_pieces, again))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(m, t) for m, (_, t) in zip(zip(*out), fields))],
                names=["doc_id", *(f for f, _ in fields)],
            )

    kind = state.schema["doc_id"].dataType.simpleString()
    rows = state.select("doc_id", "text", "piece_chars", "piece_tokens", "tree", "n_tokens", F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"doc_id {kind}, {STATE}, n_before long, n_edits int, n_pieces int, n_reencoded int")


def apply_edits(state: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """The state after a log of edits (doc_id, number, start, end, text). A document's edits follow on each other, so
    one task applies them, and its memory holds them: they are the log of one document, not of a key or a source."""
    one = F.struct("number", "start", "end", "text")
    plain = F.transform(
        F.sort_array(F.collect_list(one)),
        lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["text"].alias("text")),
    )
    of = fresh(state, "of")
    log = edits.groupBy(F.col("doc_id").alias(of)).agg(plain.alias("edits"))
    return apply_listed(state.drop("edits").join(log, F.col("doc_id") == F.col(of), "left").drop(of), path)


def sample_edits(state: DataFrame) -> DataFrame:
    """state with three edits for every document, fixed by its id: an insertion, a deletion of up to 40 characters
    and a replacement of up to 12, at hashed places."""
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    at = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), size.cast("long")).cast("int")
    word = F.concat(F.lit(" "), F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 9), F.lit("'s "))
    edit = lambda a, n, text: F.struct(a.alias("start"), (a + n).alias("end"), text.alias("text"))
    insertion = edit(at("insert"), 0, F.coalesce(word, F.lit("?")))
    deletion = edit(at("delete"), F.pmod(at("length"), F.lit(41)), F.lit(""))
    replacement = edit(at("replace"), F.pmod(at("width"), F.lit(13)), F.lit("Ersatz\n\n"))
    return state.withColumn("edits", F.array(insertion, deletion, replacement))
