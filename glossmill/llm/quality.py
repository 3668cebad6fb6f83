"""Line-first quality rules.

Lines are judged one by one, by three rules: punctuation (too many symbols or doubled marks for its words, or a
long run of words without a mark), navigation (items between separators) and boilerplate. Lines that fail are
removed; a document goes if less than KEPT_PERCENT of its words' characters are left. Figures of the whole text, which
are independent of the lines, come first: those fail a document by themselves.

Boilerplate is what stands in many documents whatever is around it. So the evidence is counted over the corpus, in any
language: a line fails if at least COMMON texts in a thousand have it (LEAST_TEXTS at least), below at least half as
many different lines and above as many. Copies of a text count once, and near copies, in which a line has the same
neighbours on a side, aren't evidence. Such lines are COMMON-th parts of all lines, so their hashes are few (1000 / COMMON times
the lines that a text has on average, whatever the corpus) and known to all tasks. Notices whose phrases make up most
of a line fail too, however rare.

Defined results: a null text has no words; blank lines are kept and weigh nothing; a text without words fails the
base rule; repeated rows give repeated results, an empty table an empty one. There are no ties. Texts are read whole, and other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import few, passing, slices

#: Fixed values of the base rule and of the line rules.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
MARKS = ",.!?:;…，。！？"
DOUBLED = ("!!", "??")
SEPARATORS = "|»›•·"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "privacy policy", "terms of use", "terms of service", "cookie", "javascript", "copyright", "©", "click here", "sign up for", "subscribe to", "lorem ipsum", "skip to content",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "sous licence", "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "hier klicken",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "haga clic", "bajo licencia",
)
#: Words of a line for each phrase in it, up to which the line is a notice.
WORDS_A_PHRASE = 15
#: Texts in a thousand that have a line, and texts at least, from which it is evidence of boilerplate.
COMMON, LEAST_TEXTS = 1, 20
#: What is cut off both ends of a line before it is held against others.
BLANKS = " \t\v\f\r"
#: A line fails with over 1 symbol in 10 words, over 3 doubled marks in 10 words, fewer than 1 mark in 60
#: words (from 12 words on), or 3 separators with at most 5 words (separators counted) each.
WORDS_A_SYMBOL, DOUBLED_IN_TEN, LONG_LINE, WORDS_A_MARK, LEAST_SEPARATORS, WORDS_A_SEPARATOR = 10, 3, 12, 60, 3, 5
#: The share of its words' characters that a document must keep.
KEPT_PERCENT = 40


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows that are found twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n] + np.uint64(1)
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():  # different hashes are different windows
        return 0
    rank = ids.astype(np.int64)
    width = 1
    while width < size:  # exact: windows of 2, 4 and 8 words numbered by pairs of the former numbers
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def common_lines(docs: DataFrame) -> frozenset[int]:
    """Hashes of the lines that stand in many texts, each among different neighbours. Texts are cut into lines once; what is kept of
    them meanwhile are the lines' hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    least = max(LEAST_TEXTS, -(-docs.count() * COMMON // 1000))
    trimmed = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: F.length(x) > 0)
    hashed = docs.select(F.xxhash64(text).alias("of"), F.transform(trimmed, lambda x: F.xxhash64(x)).alias("line")).filter(F.size("line") > 0)
    with passing(docs.sparkSession) as keep:
        lines = keep(hashed, "line-hashes")
        # a line that isn't there so often isn't in so many texts; texts and neighbours are told apart for those left only
        once = lines.select(F.explode("line").alias("line")).groupBy("line").count()
        often = keep(once.filter(F.col("count") >= least).select("line"), "frequent-lines")
        # an end of a text is a neighbour of its own
        end = lambda name: F.array(F.xxhash64("of", F.lit(name)))
        above, below = F.concat(end("top"), F.slice("line", 1, F.size("line") - 1)), F.concat(F.slice("line", 2, F.size("line")), end("bottom"))
        rows = lines.select("of", "line", above.alias("above"), below.alias("below")).select("of", F.inline(F.arrays_zip("line", "above", "below")))
        counts = rows.join(few(often), "line", "left_semi").groupBy("line").agg(
            F.countDistinct("of").alias("texts"), F.countDistinct("above").alias("above"), F.countDistinct("below").alias("below")
        )
        common = counts.filter((F.col("texts") >= least) & (2 * F.least("above", "below") >= F.col("texts")))
        return frozenset(r["line"] for r in common.select("line").collect())


def line_hash(line: str) -> int:
    """As Spark hashes it."""
    h = xxhash.xxh64_intdigest(line.strip(BLANKS).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def failing_rule(line: str, n_words: int, common: frozenset[int] = frozenset()) -> str | None:
    """The rule that a line with words fails."""
    separators = sum(map(line.count, SEPARATORS))
    if separators >= LEAST_SEPARATORS and n_words <= WORDS_A_SEPARATOR * separators:
        return "navigation"
    symbols, doubled = sum(map(line.count, SYMBOLS)), sum(map(line.count, DOUBLED))
    unmarked = n_words >= LONG_LINE and WORDS_A_MARK * sum(map(line.count, MARKS)) < n_words
    if symbols * WORDS_A_SYMBOL > n_words or 10 * doubled > DOUBLED_IN_TEN * n_words or unmarked:
        return "punctuation"
    if common and line_hash(line) in common:
        return "boilerplate"
    low = line.lower()
    phrases = sum(p in low for p in BOILERPLATE)
    return "boilerplate" if phrases and n_words <= WORDS_A_PHRASE * phrases else None


def judged(text: str, common: frozenset[int] = frozenset()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines removed by each rule,
    share of the words' characters kept, and the text without the lines removed."""
    raw = text.encode()
    words = raw.split()  # splits at the ASCII spaces only, as these are bytes
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    dups, out, stay, removed = 0, [], 0, {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in text.split("\n"):
        n = len(line.encode().split())
        if not n:
            out.append(line)
            continue
        dups += line in seen
        seen.add(line)
        if rule := failing_rule(line, n, common):
            removed[rule] += 1
        else:
            out.append(line)
            stay += len(line) - sum(map(line.count, " \t\v\f\r"))
    repeated = repeated_words(words)
    base_failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n_words
    kept = not base_failed and 100 * stay >= KEPT_PERCENT * word_chars
    return n_words, word_chars, sum(map(text.count, SYMBOLS)), dups, repeated, base_failed, kept, removed["punctuation"], removed["navigation"], removed["boilerplate"], stay / word_chars if word_chars else 0.0, "\n".join(out)


FIELDS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("removed_punctuation", "long"), ("removed_navigation", "long"),
    ("removed_boilerplate", "long"), ("kept_share", "double"), ("cleaned", "string"),
)
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, the figures and verdict of each document, and its text without the lines that fail (cleaned)."""
    shared = docs.sparkSession.sparkContext.broadcast(common_lines(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = list(zip(*(judged(t or "", shared.value) for t in batch.column("text").to_pylist()))) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(m, ARROW[k]) for m, (_, k) in zip(made, FIELDS))],
                names=["doc_id", *(n for n, _ in FIELDS)],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in FIELDS)
    )
