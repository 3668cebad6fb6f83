"""N-grams of a corpus as packed arrays of hashes: what tasks send each other is a few long binaries a bucket instead of a row an n-gram.

Words are hashed once by Spark (64 bits). A task takes some texts at a time, hashes their n-grams in numpy, and reduces what it has
before it sends it; buckets of n-grams meet by a second hash, so that an n-gram has 64 bits and those of its bucket. A share of the n-grams
are those that begin with a word of the share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions import text as T

#: Words that a task takes at a time, and n-grams of one size in a bucket, about. A text is never cut, so a longer one is taken alone.
SLICE_WORDS, BUCKET_NGRAMS = 400_000, 1_500_000
#: Characters of a word, about, and buckets of a share at most.
WORD_CHARS, BUCKETS = 5, 1 << 14
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    return x ^ (x >> np.uint64(29))


def hashed(docs: DataFrame, keep: list[str], text: str = "text", lower: bool = False) -> DataFrame:
    """keep and h, the hashes of a text's words in their order."""
    t = F.lower(F.col(text)) if lower else F.col(text)
    return docs.select(*keep, F.transform(T.words(F.coalesce(t, F.lit(""))), lambda x: F.xxhash64(x)).alias("h"))


def buckets_of(chars: int, shares: int) -> int:
    """Buckets of each size of n-grams in a share."""
    return int(min(BUCKETS, 1 + chars // (WORD_CHARS * BUCKET_NGRAMS * shares)))


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text (behind it) of parts of a batch, their words' hashes and how many each has."""
    h = batch.column("h")
    lens = h.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = h.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lens)])
    i = 0
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_WORDS, "right")) - 1)
        yield i, j, flat[ends[i] : ends[j]], lens[i:j]
        i = j


def grams(words: np.ndarray, lens: np.ndarray, sizes: tuple[int, ...], share: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size n: n, the texts that the n-grams of the share are of (in order), their hashes, and hashes for their buckets."""
    doc = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(words)) if share[1] == 1 else np.flatnonzero(mixed(words, C) % np.uint64(share[1]) == np.uint64(share[0]))
    doc, left = doc[at], np.cumsum(lens)[doc[at]] - at
    a, b = words[at], mixed(words[at], B)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            fits = left >= n
            at, doc, left, a, b = at[fits], doc[fits], left[fits], a[fits], b[fits]
            last = words[at + (n - 1)]
            a, b = mixed(a, A) + last, mixed(b, D) + mixed(last, B)
        if n in sizes:
            yield n, doc, a, b


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes, int]]:
    """Each bucket that is there, its rows of the columns one column after the other as bytes, and how many they are."""
    order = np.argsort(bucket, kind="stable")  # 16 bits: by counting
    bucket, columns = bucket[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    for i, j in zip(starts, [*starts[1:], len(bucket)]):
        yield int(bucket[i]), b"".join(c[i:j].tobytes() for c in columns), int(j - i)


def joined(table: pa.Table, kinds: list[type]) -> list[np.ndarray]:
    """The columns of all packed rows of a table (size, data)."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for rows, data in zip(table.column("size").to_pylist(), (x.as_buffer() for x in table.column("data"))):
        at = 0
        for part, kind in zip(parts, kinds):
            part.append(np.frombuffer(data, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


PACKED = "n int, bucket int, size int, data binary"


def packed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["n", "bucket", "size", "data"])


def spots(b: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(b, A) % np.uint64(buckets)).astype(np.uint16)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def two_largest(a: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by a: where each a begins, the row of its largest c1, that, and the largest of the other c1 and all c2."""
    starts = firsts(a)
    if len(starts) == len(a):
        return starts, starts, c1, c2
    sizes = np.diff(np.append(starts, len(a)))
    most = np.maximum.reduceat(c1, starts)
    row = np.arange(len(a))
    top = np.minimum.reduceat(np.where(c1 == np.repeat(most, sizes), row, len(a)), starts)
    other = np.maximum(c1, c2)
    other[top] = c2[top]
    return starts, top, most, np.maximum.reduceat(other, starts)


def lost_matches(hashes: DataFrame, share: tuple[int, int], buckets: int, parts: int) -> DataFrame:
    """seq and the matches that a text lacks (l1..l4) by the leads that it has in n-grams of a share; texts without any are left out.
    hashes: seq (a whole number, different in all rows) and h. A slice sends a row an n-gram."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("seq").to_numpy()
            for i, j, words, lens in slices(batch):
                out = []
                for n, doc, a, b in grams(words, lens, (1, 2, 3, 4), share):
                    order = np.argsort(a, kind="stable")  # texts stay in order within an n-gram
                    a, doc, b = a[order], doc[order], b[order]
                    own = firsts(a, doc)
                    c = np.diff(np.append(own, len(a))).astype(np.int32)
                    a, doc, b = a[own], doc[own], b[own]
                    if not len(a):
                        continue
                    starts, top, most, second = two_largest(a, c, np.zeros(len(c), np.int32))
                    columns = [a[starts], seqs[i:j][doc[top]], most, second]
                    out += [(n, k, size, data) for k, data, size in by_bucket(spots(b[starts], buckets), columns)]
                yield packed(out)

    def lead(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        a, seq, c1, c2 = joined(table, [np.uint64, np.int64, np.int32, np.int32])
        order = np.argsort(a)
        a, seq, c1, c2 = a[order], seq[order], c1[order], c2[order]
        _, top, most, second = two_largest(a, c1, c2)
        ahead = most > second
        seq, leads = seq[top][ahead], (most - second)[ahead]
        spot = (mixed(seq.view(np.uint64), D) % np.uint64(parts)).astype(np.uint16)
        return pa.Table.from_batches([packed([(n, k, size, data) for k, data, size in by_bucket(spot, [seq, leads])])])

    def summed(table: pa.Table) -> pa.Table:
        every = []
        for n in range(1, 5):
            some = table.filter(pc.equal(table.column("n"), n))
            seq, leads = joined(some, [np.int64, np.int32])
            every.append((seq, leads))
        ids, place = np.unique(np.concatenate([s for s, _ in every]), return_inverse=True)
        out, at = {"seq": ids}, 0
        for n, (seq, leads) in enumerate(every, 1):
            sums = np.bincount(place[at : at + len(seq)], leads, len(ids))  # exact below 2 ** 53
            out[f"l{n}"], at = sums.astype(np.int64), at + len(seq)
        return pa.table(out)

    leads = hashes.mapInArrow(cut, PACKED).groupBy("n", "bucket").applyInArrow(lead, PACKED)
    return leads.groupBy("bucket").applyInArrow(summed, "seq long, l1 long, l2 long, l3 long, l4 long")


def distinct_counts(hashes: DataFrame, sizes: tuple[int, ...], share: tuple[int, int], buckets: int) -> DataFrame:
    """n, total and unique_ngrams (in parts, to be added) of a share of the n-grams of each size. hashes: h."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, lens in slices(batch):
                out = []
                for n, _, a, b in grams(words, lens, sizes, share):
                    order = np.argsort(a)
                    a, b = a[order], b[order]
                    own = firsts(a)
                    times = np.diff(np.append(own, len(a))).astype(np.int32)
                    out += [(n, k, size, data) for k, data, size in by_bucket(spots(b[own], buckets), [a[own], times])]
                yield packed(out)

    def counted(table: pa.Table) -> pa.Table:
        a, times = joined(table, [np.uint64, np.int32])
        return pa.table(
            {"n": pa.array([table.column("n")[0].as_py()], pa.int32()), "total": pa.array([int(times.sum(dtype=np.int64))]), "unique_ngrams": pa.array([len(firsts(np.sort(a)))])}
        )

    return hashes.mapInArrow(cut, PACKED).groupBy("n", "bucket").applyInArrow(counted, "n int, total long, unique_ngrams long")


def held_by_windows(hashes: DataFrame, window: int, stride: int, size: int, windows: int, some: tuple[int, int]) -> DataFrame:
    """held (in parts, to be added): the different words of all windows, each stride words further, by the words of some chunks of so many
    places. hashes: begin (the place of a text's first word) and h. A chunk gets the words of a window before it too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, rows = batch.column("begin").to_numpy(), []
            for begin, h in zip(begins.tolist(), batch.column("h")):
                words = h.values.to_numpy()
                end = begin + len(words)
                for k in range(max(some[0], begin // size), min(some[1], (end + window - 2) // size + 1)):
                    lo, hi = max(begin, k * size - window + 1), min(end, (k + 1) * size)
                    if hi > lo:
                        rows.append((k, lo, words[lo - begin : hi - begin].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, kinds)], names=["chunk", "at", "data"])

    def held(table: pa.Table) -> pa.Table:
        begin, table = table.column("chunk")[0].as_py() * size, table.sort_by("at")
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("data")]
        g = np.concatenate([np.arange(at, at + len(w)) for at, w in zip(table.column("at").to_pylist(), words)])
        word = np.concatenate(words)
        order = np.argsort(word, kind="stable")
        same = word[order][1:] == word[order][:-1]
        opens = np.zeros(len(g), np.int64)  # the first window that begins behind a word's earlier place
        opens[order[1:][same]] = g[order[:-1][same]] // stride + 1
        mine = g >= begin
        first = np.maximum(np.maximum(opens, (g - window) // stride + 1), 0)[mine]
        last = np.minimum(g // stride, windows - 1)[mine]
        return pa.table({"held": pa.array([int(np.maximum(last - first + 1, 0).sum())])})

    return hashes.mapInArrow(deal, "chunk long, at long, data binary").groupBy("chunk").applyInArrow(held, "held long")


def before(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows in groups (key: 0, 1, ... in order; within one by time): which open a group, the largest c of the group before a row (0 if
    none), the row that had it first, and the second largest."""
    n, row = len(key), np.arange(len(key))
    opens = np.ones(n, bool)
    opens[1:] = key[1:] != key[:-1]
    wide = np.int64(1) << np.int64(32)

    def largest(x: np.ndarray) -> np.ndarray:
        """The largest x of the group before each row: groups rise, so that one running maximum does for all."""
        run = np.maximum.accumulate(key * wide + x)
        out = np.zeros(n, np.int64)
        out[1:] = run[:-1] - key[1:] * wide
        out[opens] = 0
        return out

    m1 = largest(c)
    holder = np.zeros(n, np.int64)
    holder[1:] = np.maximum.accumulate(np.where(opens | (c > m1), row, 0))[:-1]
    return opens, m1, holder, largest(np.minimum(c, m1))


def lead_changes(hashes: DataFrame, share: tuple[int, int], buckets: int, parts: int) -> DataFrame:
    """rh, doc, t, d1..d4: by how much the matches that doc lacks change as the text t of its run comes. hashes: rh (a hash of the run), o
    (the order; different within a run) and h. Of a slice only those rows are sent whose count is above the second largest before them."""

    def ordered(run: np.ndarray, o: np.ndarray, a: np.ndarray, *rest: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((o, run, a))
        return [x[order] for x in (run, o, a, *rest)]

    def groups(a: np.ndarray, run: np.ndarray) -> np.ndarray:
        new = np.zeros(len(a), np.int64)
        new[firsts(a, run)] = 1
        return np.cumsum(new) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, os_ = batch.column("rh").to_numpy(), batch.column("o").to_numpy()
            for i, j, words, lens in slices(batch):
                out = []
                for n, doc, a, b in grams(words, lens, (1, 2, 3, 4), share):
                    order = np.argsort(a, kind="stable")
                    a, doc, b = a[order], doc[order], b[order]
                    own = firsts(a, doc)
                    c = np.diff(np.append(own, len(a))).astype(np.int64)
                    run, o, a, b, c = ordered(runs[i:j][doc[own]], os_[i:j][doc[own]], a[own], b[own], c)
                    opens, _, _, m2 = before(groups(a, run), c)
                    some = opens | (c > m2)
                    run, o, a, b, c = run[some], o[some], a[some], b[some], c[some]
                    # an n-gram of a run is one, so both say where it goes
                    spot = spots(b ^ mixed(run.view(np.uint64), C), buckets)
                    out += [(n, k, size, data) for k, data, size in by_bucket(spot, [a, run, o, c.astype(np.int32)])]
                yield packed(out)

    def changes(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        a, run, o, c = joined(table, [np.uint64, np.int64, np.int64, np.int32])
        run, o, a, c = ordered(run, o, a, c.astype(np.int64))
        key = groups(a, run)
        opens, _, _, m2 = before(key, c)
        some = opens | (c > m2)  # nothing else changes what comes after it
        run, o, c, key = run[some], o[some], c[some], key[some]
        opens, m1, holder, m2 = before(key, c)
        ahead = ~opens & (c > m1)
        # a new text has all that no other has; it takes from the holder what it gains on the second, and leads by what it has more
        events = [
            (o, o, run, np.where(opens, c, c - m1), opens | ahead),
            (o[holder], o, run, np.where(ahead, m2 - m1, m2 - c), ~opens),
        ]
        doc, t, run, d = (np.concatenate([e[k][e[4]] for e in events]) for k in range(4))
        spot = (mixed(doc.view(np.uint64) ^ run.view(np.uint64), D) % np.uint64(parts)).astype(np.uint16)
        return pa.Table.from_batches([packed([(n, k, size, data) for k, data, size in by_bucket(spot, [run, doc, t, d.astype(np.int32)])])])

    def summed(table: pa.Table) -> pa.Table:
        every = [joined(table.filter(pc.equal(table.column("n"), n)), [np.int64, np.int64, np.int64, np.int32]) for n in range(1, 5)]
        run, doc, t, d = (np.concatenate([e[k] for e in every]) for k in range(4))
        n = np.repeat(np.arange(4), [len(e[0]) for e in every])
        order = np.lexsort((t, doc, run))
        run, doc, t, d, n = run[order], doc[order], t[order], d[order], n[order]
        starts = firsts(run, doc, t)
        sums = {f"d{k + 1}": np.add.reduceat(np.where(n == k, d, 0).astype(np.int64), starts) if len(d) else np.zeros(0, np.int64) for k in range(4)}
        return pa.table({"rh": run[starts], "doc": doc[starts], "t": t[starts], **sums})

    rows = hashes.select("rh", "o", "h").mapInArrow(cut, PACKED).groupBy("n", "bucket").applyInArrow(changes, PACKED)
    return rows.groupBy("bucket").applyInArrow(summed, "rh long, doc long, t long, d1 long, d2 long, d3 long, d4 long")
