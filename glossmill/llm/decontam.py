"""Benchmark decontamination by spaced-seed hashing.

Texts are runs of letters and digits, lower-cased. A mask picks some of the positions of a window and ignores the
others, so windows that differ only at ignored positions hash alike. Hashes of all windows of all documents meet
those of the benchmark; every hit fixes a diagonal (document position less item position), on which the tokens of
both are compared: an item is found in a document if, over some stretch of MIN_OVERLAP tokens (the whole item, if
shorter), at least SIMILARITY of the tokens agree, so up to a fifth may be substituted. Tokens of the item that lie
outside the document count as different.

The masks lose nothing: whichever positions of a stretch of 8 to 20 tokens are substituted, within the similarity,
one of them meets the rest at some place (a test tries all patterns). Shorter items get masks of their own length
that leave out one position each.

DataFrame functions only. A benchmark of up to BLOCKS blocks of hashes is broadcast block by block: positions are
exploded and hashed within one stage of generated code, and only hits leave it, so nothing of a document is shuffled
but the stretch that a hit points at. For a larger one, hashes of windows and of items are joined by shuffle, in one
pass, and hits are joined back to their documents. Both give the same.

Defined results: null or empty texts match nothing; items of fewer than LEAST_TOKENS tokens are evidence of
nothing and are skipped; items without an id aren't listed, but documents that hold them aren't clean; benchmark rows
that share an id are all searched; in the list, repeated rows of one doc_id are one document, which has what any of
them has, but clean judges each row by its own text; empty tables give an empty result. Columns of any other name may
be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import few, fresh, identity, staged

#: Masks: 1 counts, 0 is ignored; and the tokens from which an item needs no masks of its own.
MASKS, SHORT = ("110111", "11100011", "1011011"), 8
MIN_OVERLAP, SIMILARITY, LEAST_TOKENS = 20, 0.8, 5
#: Hashes broadcast at once (a row is some 40 bytes), and blocks of them for which documents are read again each time.
BLOCK_ROWS, BLOCKS = 500_000, 4

SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def picked(words: Column, at: Column, mask: str, tag: int) -> Column:
    """The hash of the window at a position, as a mask sees it."""
    return F.xxhash64(F.lit(tag), *[F.get(words, at + i) for i, m in enumerate(mask) if m == "1"])


def positions(size: Column, span: int, edge: int = 0) -> Column:
    """Where windows of a span start, also those that begin or end so many tokens outside."""
    return F.when(size >= span - edge, F.sequence(F.lit(-edge), size - span + edge))


def index(items: DataFrame, masks: list[tuple[int, str, bool]]) -> DataFrame:
    """hash, key, at of every window of every item. A mask of short items is for items of its length only."""
    rows = None
    for tag, mask, short in masks:
        mine = items.filter(F.col("n") == len(mask) if short else F.col("n") >= SHORT)
        part = mine.select("key", "words", F.explode(positions(F.col("n"), len(mask))).alias("at")).select(
            picked(F.col("words"), F.col("at"), mask, tag).alias("hash"), "key", "at"
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def searched(benchmark: DataFrame) -> DataFrame:
    """key, item_id, words, n of each item that is searched for. Rows that share an id are items of their own, unless
    their words are the same."""
    items = benchmark.select("item_id", F.filter(tokens(F.col("text")), lambda w: w != "").alias("words"))
    items = items.withColumn("n", F.size("words")).filter(F.col("n") >= LEAST_TOKENS)
    named = F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "words")
    return items.withColumn("key", F.unhex(F.md5(named))).dropDuplicates(["key"])


def found_items(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY,
    block_rows: int = BLOCK_ROWS, most_blocks: int = BLOCKS,
) -> DataFrame:
    """doc_id, a, b (the identity of id and text), item_id and r (matched, doc_at, tokens) of each diagonal on which an
    item is found."""
    items = searched(benchmark)
    lengths = sorted(r.n for r in items.filter(F.col("n") < SHORT).select("n").distinct().collect())  # at most SHORT of them
    one_off = [(n, "".join("0" if i == k else "1" for i in range(n))) for n in lengths for k in range(n)]
    every = [(i, m, False) for i, m in enumerate(masks)] + [(100 + i, m, True) for i, (_, m) in enumerate(one_off)]
    hashes = index(items, every)
    blocks = max(1, -(-hashes.count() // block_rows))
    # a mask that leaves out the first or last token of a short item also fits with that token outside the document
    least = min(len(m) for _, m, _ in every)
    a, b = identity(docs, ["doc_id", "text"])
    row = ["doc_id", "a", "b"]
    words = docs.select("doc_id", a.alias("a"), b.alias("b"), tokens(F.col("text")).alias("words"))
    windows = words.select(*row, "words", F.explode(positions(F.size("words"), least, 1 if one_off else 0)).alias("at"))
    seen = F.explode(F.array(*[picked(F.col("words"), F.col("at"), m, tag) for tag, m, _ in every]))
    seeds = hashes.select("hash", "key", F.col("at").alias("item_at")).distinct()
    diagonal = (F.col("at") - F.col("item_at")).alias("diagonal")
    item = items.select("key", "item_id", F.col("words").alias("item"), "n")
    if blocks <= most_blocks:
        windows = windows.select(*row, "words", "at", seen.alias("hash"))
        hits = None
        for i in range(blocks):
            mine = lambda df: df if blocks == 1 else df.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i)  # noqa: B023, E731
            found = windows.join(
                F.broadcast(mine(seeds)), "hash"
            ).select(*row, "key", diagonal, "words").join(F.broadcast(mine(item)), "key")
            hits = found if hits is None else hits.unionByName(found)
    else:
        met = windows.select(*row, "at", seen.alias("hash")).join(
            seeds.hint("shuffle_hash"), "hash"
        ).select(*row, "key", diagonal).distinct()
        # rows that are equal in id and text are one; an id without a text, or the other way round, has hashes too
        hits = met.join(words.select("a", "b", "words").dropDuplicates(["a", "b"]), ["a", "b"]).join(item, "key")
    # the document under the item, null where the item juts out
    cut = F.greatest(F.lit(0), -F.col("diagonal"))
    under = F.concat(
        F.array_repeat(F.lit(None).cast("string"), cut), F.slice("words", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.col("n") - cut)
    )
    hits = hits.select(*row, "key", "diagonal", under.alias("under"), "item_id", "item", "n")
    once = hits.groupBy(*row, "key", "diagonal").agg(F.first(F.struct("under", "item_id", "item", "n")).alias("h"))
    same = F.zip_with("h.under", "h.item", lambda x, y: F.when(x.eqNullSafe(y) & x.isNotNull(), 1).otherwise(0))
    checked = once.withColumn("same", same).withColumn("width", F.least(F.lit(min_overlap), F.col("h.n")))
    agree = lambda i: F.aggregate(F.slice("same", i + 1, F.col("width")), F.lit(0), lambda acc, x: acc + x)
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.size("same") - F.col("width")), lambda i: F.struct(agree(i).alias("matched"), (-i).alias("from"))
        )
    )
    scored = checked.withColumn("best", best).filter(F.col("best.matched") >= F.ceil(F.col("width") * F.lit(similarity) - F.lit(1e-9)))
    at = F.greatest(F.col("diagonal") - F.col("best.from"), F.lit(0)).cast("long")
    return scored.select(
        *row, F.col("h.item_id").alias("item_id"),
        F.struct(F.col("best.matched").alias("matched"), at.alias("doc_at"), F.col("width").cast("long").alias("tokens")).alias("r"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id, item_id, doc_at, tokens, matched: each item found in a document, at its best diagonal.

    doc_at is the token of the document where the compared stretch begins, tokens its length and matched how
    many of its tokens agree. Of rows that share an id, the best one counts; items without an id aren't listed.
    """
    best = found_items(docs, benchmark, **kw).filter(F.col("item_id").isNotNull()).groupBy("doc_id", "item_id").agg(F.max("r").alias("r"))
    return best.select(
        "doc_id", F.col("item_id").cast("long").alias("item_id"), "r.doc_at", "r.tokens", F.col("r.matched").cast("long").alias("matched")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without the rows whose text is contaminated, columns as they were."""
    a, b = identity(docs, ["doc_id", "text"])
    x, y = fresh(docs, "bad_a"), fresh(docs, "bad_b")
    bad = staged(found_items(docs, benchmark, **kw).select(F.col("a").alias(x), F.col("b").alias(y)).distinct(), "contaminated")
    return docs.withColumns({x: a, y: b}).join(few(bad), [x, y], "left_anti").drop(x, y)
