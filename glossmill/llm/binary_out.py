"""Token ids in training order, as fixed-stride binary shards.

Documents are packed: the ids of each, ended by the id that ends a text, follow on each other and are cut into
sequences of SEQUENCE ids. A document goes to a bucket by a hash of its id and text, and documents of a bucket are
in the order of those hashes, so that the sequences and their numbers depend on the documents alone and not on
files, partitions or cores; a bucket's last sequence is padded. A keyed Feistel network over the next power of two,
walked along its cycle until it comes back below the number of sequences, permutes their numbers into global slots.
Shard k holds a range of slots in order, every record of the same size, so slot s is at byte (s - first) * stride of
its shard's file (the stride is a record and the newline that Spark's writer ends it by): reads are sequential, and
resume at any slot by arithmetic.

A record: 8 bytes slot, 4 bytes count of its ids that aren't padding, 4 bytes CRC-32 of all its ids (big-endian), then
SEQUENCE little-endian unsigned 16-bit ids (32-bit where the vocabulary needs it).

Rows that are equal in id and text are interchangeable. Up to a limit they share a bucket; of those that are more (a
bounded number of different ones, whatever the input) copies are counted and dealt over the buckets.

Defined results: a null or empty text is one end mark; repeated rows are packed as often as they come; texts are
tokenised whole, whatever their length; an empty table has no slots and no shards. doc_id may be of any type that can
be hashed; columns of any other name may be there.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.bpe import PIECE_CHARS, PIECES, VOCABULARY, read_ranks, splitter, table
from glossmill.llm.common import identity, removed, shared_path, slices, written

#: Ids of a sequence; sequences of a shard at least, and shards at most: beyond those, shards grow (by powers of two).
SEQUENCE, SHARD_SLOTS, SHARDS = 1024, 16_384, 65_536
#: Ids of a bucket, about; and buckets at most, whose offsets are broadcast.
BUCKET_IDS, BUCKETS = 1 << 20, 65_536
#: Buckets of a task at most, where there are some tasks a core.
TOGETHER, TASKS_A_CORE = 8, 4
#: Copies of a row from which they are dealt over the buckets; at most that many different rows have more.
HOT_COPIES, HOT_ROWS = 1000, 100_000
ROUNDS = 8
#: Bytes of the texts that are tokenised together, about; of a word that goes to the library among others, at most. White
#: space, and what some call so.
TEXT_BYTES, WORD_BYTES = 16 << 20, 1000
WHITE = r"[\s\pZ\x{85}\x0b\x1c-\x1f]"
#: Shards are written in so many waves; Spark's setting by which a write's shuffle files go when it ends.
WAVES = 2
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
KEY = 0x5EED_0F_7A11


def round_keys(key: int) -> list[int]:
    """A key for each round, by splitmix64."""
    out, state = [], key
    for _ in range(ROUNDS):
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) % 2**64
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) % 2**64
        out.append(z ^ z >> 31)
    return out


def mixed(half: np.ndarray, key: int) -> np.ndarray:
    z = (half + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(32)


def feistel(x: np.ndarray, bits: int, keys: list[int], back: bool = False) -> np.ndarray:
    """A permutation of the numbers below 2**bits, or its inverse. The halves' widths swap in each round."""
    right = bits // 2
    left = bits - right
    high, low = x >> np.uint64(right), x & np.uint64((1 << right) - 1)
    if not back:
        for i, k in enumerate(keys):
            width = left if i % 2 == 0 else right  # of the half that is masked now
            high, low = low, high ^ mixed(low, k) & np.uint64((1 << width) - 1)
    else:
        for i, k in reversed(list(enumerate(keys))):
            width = left if i % 2 == 0 else right
            high, low = low ^ mixed(high, k) & np.uint64((1 << width) - 1), high
    return high << np.uint64(right) | low


def permuted(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """A keyed permutation of the numbers below n: those that leave the range walk on until they are in it."""
    bits, keys = max(2, (n - 1).bit_length()), round_keys(key)
    y = feistel(x.astype(np.uint64), bits, keys, back)
    while (out := y >= n).any():
        y[out] = feistel(y[out], bits, keys, back)
    return y.astype(np.int64)


def white(words: pa.StringArray, edge: str) -> np.ndarray:
    """Which words begin (^) or end ($) with white space; an empty one does."""
    return np.array(pc.match_substring_regex(words, f"^{WHITE}|^$" if edge == "^" else f"{WHITE}$|^$"))


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The different words of the texts, which word is where, and the bounds of the texts in that. A text is cut at each space
    with no white space on one of its sides, before which a piece ends; other spaces stand within words."""
    cut = pc.split_pattern(texts, " ")
    coded, bounds = cut.flatten().dictionary_encode(), np.array(cut.offsets)
    words, at = coded.dictionary, np.array(coded.indices)
    joins = np.append(False, white(words, "$")[at[:-1]] & white(words, "^")[at[1:]])  # a word to the one before
    joins[bounds[:-1]] = False
    if not joins.any():
        return words, at, bounds
    begin = np.flatnonzero(~joins)
    size = np.diff(np.append(begin, len(at)))
    several = np.repeat(size > 1, size)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[size > 1])), pa.int32()), words.take(pa.array(at[several])))
    joined = pc.binary_join(lists, " ").dictionary_encode()
    bounds = np.append(0, np.cumsum(~joins))[bounds]
    at = at[begin]
    at[size > 1] = len(words) + np.array(joined.indices)
    return pa.concat_arrays([words, joined.dictionary]), at, bounds


class Pieces(dict):
    """The ids of texts, as bytes.

    Each different word of many texts is encoded once, with the space before it (ended). Most go to the library; first words,
    those with white space at an end and long ones are cut into pieces (encode), whose ids are remembered within bounds. That
    splitting is ours, as the library's own gives up on long runs of white space."""

    def __init__(self, ranks: bytes, width: int):
        tokens = table(ranks)
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={})
        self.one, self.kind, self.chars = self.library._core_bpe.encode_single_piece, {2: "H", 4: "I"}[width], 0
        self.split, self.id_kind, self.sizes = splitter(), np.dtype(f"<u{width}"), np.zeros(max(tokens.values()) + 1, np.int64)
        for token, rank in tokens.items():
            self.sizes[rank] = len(token)

    def __missing__(self, piece: str) -> bytes:
        ids = array(self.kind, self.one(piece.encode())).tobytes()
        if len(self) >= PIECES or self.chars + len(piece) > PIECE_CHARS:
            self.clear()
            self.chars = 0
        if len(piece) <= PIECE_CHARS:
            self[piece] = ids
            self.chars += len(piece)
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def spaced(self, words: pa.StringArray) -> pa.BinaryArray:
        """The ids of a space and each word. Words that neither begin nor end with white space go to the library as one text:
        a piece ends with each, and the tokens' lengths tell where."""
        alone = white(words, "^") | white(words, "$") | (np.array(pc.binary_length(words)) > WORD_BYTES)
        most = words.filter(pa.array(~alone))
        text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(most)], pa.int32()), most), " ")[0].as_py()
        ids = self.library.encode_to_numpy(text, disallowed_special=())
        ends = np.cumsum(np.array(pc.binary_length(most), np.int64) + 1)
        reached = np.cumsum(self.sizes[ids])
        last = np.searchsorted(reached, ends)
        if (reached[last] != ends).any():
            raise RuntimeError("a token goes beyond its word")
        bounds = (np.append(0, last + 1) * self.id_kind.itemsize).astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(most), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype(self.id_kind))])
        rest = pa.array([self.encode(" " + w) for w in words.filter(pa.array(alone)).to_pylist()], pa.binary())
        where = np.empty(len(words), np.int64)
        where[np.argsort(alone, kind="stable")] = np.arange(len(words))
        return pa.concat_arrays([made, rest]).take(pa.array(where))

    def ended(self, texts: pa.StringArray, mark: bytes) -> pa.BinaryArray:
        """The ids of each text, and mark. There are no nulls."""
        words, at, bounds = words_of(texts)
        n = len(texts)
        first = words.take(pa.array(at[bounds[:-1]])).to_pylist()  # have no space before them
        at[bounds[:-1]] = len(words) + np.arange(n)
        ids = pa.concat_arrays([self.spaced(words), pa.array([*map(self.encode, first), mark], pa.binary())])
        taken = ids.take(pa.array(np.insert(at, bounds[1:], len(words) + n)))  # word by word; those of a text stand together
        ends = np.frombuffer(taken.buffers()[1], np.int32)[bounds + np.arange(n + 1)]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), taken.buffers()[2]])


_PIECES: dict[tuple[bytes, int], Pieces] = {}


def pieces_of(ranks: bytes, width: int) -> Pieces:
    """Built once a process."""
    if (ranks, width) not in _PIECES:
        _PIECES[ranks, width] = Pieces(ranks, width)
    return _PIECES[ranks, width]


def by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some TEXT_BYTES of texts; a longer text is in one of them."""
    for batch in batches:
        upto = np.cumsum(np.array(pc.binary_length(pc.fill_null(batch.column("text"), "")), np.int64))
        cuts = [0, *np.flatnonzero(np.diff(upto // TEXT_BYTES)) + 1, batch.num_rows]
        yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if i < j)


def tokenised(docs: DataFrame, ranks: bytes) -> tuple[DataFrame, int, int]:
    """a, b (the identity of id and text), doc_id, n, ids (ended) of each row; the bytes of an id; the id that ends a text."""
    end = max(table(ranks).values()) + 1
    width = 2 if end < 1 << 16 else 4
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    mark = end.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(shared.value, width)
        for batch in by_bytes(batches):
            ids = pieces.ended(pc.fill_null(batch.column("text"), ""), mark)
            n = pa.array(np.array(pc.binary_length(ids), np.int64) // width)
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("a", "b", "doc_id")), n, ids], names=["a", "b", "doc_id", "n", "ids"])

    a, b = identity(docs, ["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(a.alias("a"), b.alias("b"), "doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"a long, b long, doc_id {kind}, n long, ids binary"), width, end


def dealt(rows: DataFrame, buckets: int, hot_copies: int) -> DataFrame:
    """rows with bucket, part and times: how often the row counts in the bucket. Rows of more than hot_copies copies are
    one row a bucket; there are few, found by a count of identities, and known to all tasks."""
    counts = rows.groupBy("a", "b").agg(F.count("*").alias("copies")).filter(F.col("copies") > hot_copies)
    hot = F.broadcast(counts)  # rows / hot_copies at most, of which hot_copies makes HOT_ROWS or fewer
    cold = rows.join(hot, ["a", "b"], "left_anti").withColumns(
        {"bucket": F.pmod("a", F.lit(buckets)).cast("int"), "part": F.lit(0), "times": F.lit(1).cast("long")}
    )
    values = [c for c in rows.columns if c not in ("a", "b")]
    warm = rows.join(hot, ["a", "b"]).groupBy("a", "b", "copies").agg(*[F.first(c).alias(c) for c in values])
    parts = F.least(F.col("copies"), F.lit(buckets)).cast("int")
    warm = warm.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    times = F.floor(F.col("copies") / parts) + (F.col("part") < F.col("copies") % parts).cast("long")
    warm = warm.withColumns({"bucket": F.pmod(F.col("a") + F.col("part"), F.lit(buckets)).cast("int"), "times": times})
    names = ["a", "b", *values, "bucket", "part", "times"]
    return cold.select(names).unionByName(warm.select(names))


def packed(rows: DataFrame, n_buckets: int, length: int, width: int, pad: int, key: int) -> tuple[DataFrame, int]:
    """slot, n_tokens, doc_ids, ids of each sequence, and how many there are."""
    spark = rows.sparkSession
    sizes = dict(sorted((r.bucket, r.n) for r in rows.groupBy("bucket").agg(F.sum(F.col("n") * F.col("times")).alias("n")).collect()))  # a row a bucket
    offsets, total = {}, 0
    for bucket, n in sizes.items():
        offsets[bucket] = total
        total += -(-n // length)
    first = spark.sparkContext.broadcast(offsets)
    size, mark = length * width, pad.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole buckets, in order; a sequence is made at once, and few wait to be sent."""
        done: list[tuple] = []
        bucket, number, parts, ids_of, filled = None, 0, [], [], 0

        def cut() -> None:
            nonlocal number, parts, ids_of, filled
            done.append((first.value[bucket] + number, filled // width, ids_of, b"".join(parts) + mark * ((size - filled) // width)))
            number, parts, ids_of, filled = number + 1, [], [], 0

        def sent(kind: pa.DataType) -> pa.RecordBatch:
            number, n, ids_of, ids = zip(*done)
            done.clear()
            slot = permuted(np.array(number, np.int64), total, key)
            return pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(n, pa.int32()), pa.array(ids_of, pa.list_(kind)), pa.array(ids, pa.binary())],
                names=["slot", "n_tokens", "doc_ids", "ids"],
            )

        kind = None
        for batch in slices(batches):
            kind = batch.schema.field("doc_id").type
            for b, doc_id, ids, times in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids", "times"))):
                if b != bucket:
                    if filled:
                        cut()
                    bucket, number = b, 0
                for _ in range(times):
                    at, n = 0, len(ids)
                    while at < n:
                        part = ids[at : at + size - filled]
                        parts.append(part)
                        ids_of.append(doc_id)
                        at, filled = at + len(part), filled + len(part)
                        if filled == size:
                            cut()
                            if len(done) >= 1024:
                                yield sent(kind)
        if filled:
            cut()
        if done:
            yield sent(kind)

    kind = rows.schema["doc_id"].dataType.simpleString()
    together = max(1, min(TOGETHER, n_buckets // (TASKS_A_CORE * spark.sparkContext.defaultParallelism)))
    task = F.floor(F.col("bucket") / together).cast("int")
    mine = rows.repartitionById(-(-n_buckets // together), task).sortWithinPartitions("bucket", "a", "b", "part").select(
        "bucket", "doc_id", "ids", "times"
    )
    return mine.mapInArrow(run, f"slot long, n_tokens int, doc_ids array<{kind}>, ids binary"), total


def big_endian(number: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * size, "0"))


def write_shards(rows: DataFrame, path: str, slots: int, first: int, last: int) -> None:
    """The records of the shards from first to before last as a binary file each, in the order of slots, by Spark's own
    writer (whose commits survive lost executors and whose file systems are Spark's). Each record ends in one newline."""
    shard = F.floor(F.col("slot") / slots).cast("int")
    record = F.concat(big_endian(F.col("slot"), 8), big_endian(F.col("n_tokens").cast("long"), 4), big_endian(F.crc32("ids"), 4), "ids")
    mine = rows.select(shard.alias("shard"), "slot", record.alias("record")).filter(F.col("shard").between(first, last - 1))
    mine = mine.repartitionById(last - first, F.col("shard") - first).sortWithinPartitions("shard", "slot")
    mine.select(
        "shard", F.col("record").cast("string").alias("value")
    ).write.mode("append").option("maxRecordsPerFile", 0).partitionBy("shard").option("lineSep", "\n").text(path)


def stride(width: int, length: int) -> int:
    return 16 + width * length + 1


def written_order(
    docs: DataFrame, path: str | None = None, length: int = SEQUENCE, shard_slots: int | None = None, key: int = KEY, at: str | None = None,
    waves: int = WAVES, bucket_ids: int = BUCKET_IDS, hot_copies: int | None = None,
) -> DataFrame:
    """Writes the shards below a new folder (or at) and gives slot, shard, file, offset, n_tokens, doc_ids, crc32 for
    each sequence: file is its shard's file, offset the byte in it at which its record begins, doc_ids the documents
    that it holds parts of, in order, and crc32 that of its ids.

    Tokens are staged once as documents and once as sequences, the first going when the second is there; shards are
    written in waves, whose shuffle files go with them. The files' lengths are held against the slots.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    at = at or shared_path(spark, "training-shards")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        made, width, pad = tokenised(docs, read_ranks(path or public_tokenizers.path(VOCABULARY)))
        whole = shared_path(spark, "token-documents")
        rows = written(made, whole, compression="zstd")
        size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids")).first()
        buckets = max(1, min(BUCKETS, size["ids"] // bucket_ids))
        hot = max(HOT_COPIES, size["rows"] // HOT_ROWS) if hot_copies is None else hot_copies
        made, n = packed(dealt(rows, buckets, hot), buckets, length, width, pad, key)
        sequences = written(made, shared_path(spark, "token-sequences"), compression="zstd")
        removed(spark, whole)
        slots = shard_slots or max(SHARD_SLOTS, 1 << max(0, -(-n // SHARDS) - 1).bit_length())
        shards = -(-n // slots)
        each = max(1, -(-shards // waves))
        for first in range(0, shards, each):
            write_shards(sequences, at, slots, first, min(shards, first + each))
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)
    if n == 0:
        return spark.createDataFrame([], f"slot long, shard int, file string, offset long, n_tokens int, doc_ids array<{kind}>, crc32 long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(at)
    found = files.select(  # SHARDS at most
        F.regexp_extract("path", "shard=([0-9]+)", 1).cast("int").alias("shard"), F.col("path").alias("file"), "length"
    ).collect()
    wrong = [r.file for r in found if r.length != stride(width, length) * min(slots, n - r.shard * slots)]
    if wrong or sorted(r.shard for r in found) != list(range(shards)):
        raise RuntimeError(f"{len(found)} files for {shards} shards, of wrong length: {wrong[:3]}")
    place = F.broadcast(spark.createDataFrame([(r.shard, r.file) for r in found], "shard int, file string"))
    rows = sequences.select(
        "slot", F.floor(F.col("slot") / slots).cast("int").alias("shard"), "n_tokens", "doc_ids", F.crc32("ids").alias("crc32")
    )
    return rows.join(place, "shard").select(
        "slot", "shard", "file", (F.col("slot") % slots * stride(width, length)).alias("offset"), "n_tokens", "doc_ids", "crc32"
    )


def read_back(spark: SparkSession, at: str, width: int = 2, length: int = SEQUENCE, shard: int | None = None) -> DataFrame:
    """slot, n_tokens, crc32, ids of the records in the files below at (of one shard, if asked), record by record: large
    files are split between tasks at records' bounds."""
    size = stride(width, length)
    records = spark.sparkContext.binaryRecords(f"{at}/shard={'*' if shard is None else shard}/part-*", size)
    return spark.createDataFrame(
        records.map(lambda r: (*struct.unpack(">qiI", r[:16]), bytearray(r[16:-1]))), "slot long, n_tokens int, crc32 long, ids binary"
    )
