"""Secret scans over an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content. The ledger holds the pairs (blob, rule
version) that have been scanned, with their findings; a scan reads only pairs that it lacks, each distinct blob
once, and findings are joined back to every path and version that has the blob. Addresses are held against the ledger
first, so that texts of known blobs don't move. A history is scanned step by step: a step brings versions or rule packs,
and extends the ledger by the pairs that are new with it.

DataFrame functions only. Positions come without any Python: split() gives the pieces between the matches that
regexp_extract_all() gives, and running sums of both lengths are the matches' starts and ends.

Defined results: a null text counts as empty (a blob like any other), rows without findings get zeros and an
empty list, repeated rows stay repeated, an empty table gives an empty result. Equal texts are one blob; a blob's
copies meet as partial aggregates, one a task. Columns of any name may be there but the one that is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import fresh, identity, shared_path, staged


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches are findings if the group has the least length."""

    kind: str
    pattern: str
    group: int
    least: int


#: The patterns of the base kinds, in the order of the kinds, then those of known providers' formats.
#: hex and access ask for their least length in the pattern: a shorter run can't hold or hide a longer match.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
PROVIDERS = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat", r"xox[abpr]-[A-Za-z0-9-]{10,}", 0, 1),
)
#: Rule versions: a change of a pack's rules needs a new name, and only that pack is scanned again.
PACKS: dict[str, tuple[Rule, ...]] = {"base-1": BASE, "providers-1": PROVIDERS}
ORDER = {r.kind: i for i, r in enumerate(BASE + PROVIDERS)}
#: Addresses (numbers of 8 bytes) that are broadcast at most, to pick out the texts to scan; blobs with findings, and their
#: findings, that are broadcast at most, to be laid on rows where those are.
PICKED, FOUND, FOUND_SPANS = 1_000_000, 100_000, 1_000_000

SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def content_address(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256)


def blobs(versions: DataFrame, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """blob, content: each distinct content once. wanted: the blobs that matter, of which the texts alone are moved if they
    are few enough to be broadcast; others may come along."""
    rows = versions.select(content_address(text).alias("blob"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("content"))
    if wanted is not None and wanted.count() <= PICKED:
        picked = wanted.select(F.xxhash64("blob").alias("picked")).distinct()
        rows = rows.join(F.broadcast(picked), F.xxhash64("blob") == F.col("picked"), "left_semi")
    return rows.groupBy("blob").agg(F.first("content").alias("content"))


def matches(text: Column, rules: tuple[Rule, ...], of: dict[str, str], todo: Column) -> Column:
    """For each rule of the packs to do that matches at all: its kind, the pieces between its matches, and the matches."""
    found = [
        F.when(
            F.array_contains(todo, of[r.kind]) & text.rlike(r.pattern),
            F.struct(
                F.lit(r.kind).alias("kind"), F.split(text, r.pattern, -1).alias("between"),
                F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias("match"),
            ),
        ) for r in rules
    ]
    return F.array_compact(F.array(*found))


def scan(blobs: DataFrame, packs: dict[str, tuple[Rule, ...]]) -> DataFrame:
    """blob, pack, spans for the pairs of blobs and packs that have findings. blobs: blob, content, todo (its packs)."""
    rules = {r.kind: r for p in packs.values() for r in p}
    of = {r.kind: name for name, p in packs.items() for r in p}
    kinds = F.create_map(
        *[x for k in rules for x in (F.lit(k), F.struct(F.lit(ORDER.get(k, 99)).alias("ord"), F.lit(of[k]).alias("pack")))]
    )
    by_kind = Window.partitionBy("blob", "kind").orderBy("at")
    rows = (
        blobs.select("blob", F.explode(matches(F.col("content"), tuple(rules.values()), of, F.col("todo"))).alias("m"))
        .select("blob", "m.kind", F.posexplode(F.arrays_zip("m.between", "m.match")).alias("at", "x"))
        .select("blob", "kind", "at", F.length("x.between").alias("gap"), "x.match")
        .withColumn("end", (F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(by_kind)).cast("int"))
    )
    long_enough = None
    for k, r in rules.items():
        size = F.length(F.regexp_extract("match", r.pattern, r.group)) if r.group else F.length("match")
        long_enough = F.when(F.col("kind") == k, size >= r.least) if long_enough is None else long_enough.when(
            F.col("kind") == k, size >= r.least
        )
    span = F.struct((F.col("end") - F.length("match")).alias("start"), kinds[F.col("kind")]["ord"].alias("ord"), "end", "kind")
    found = rows.filter(F.col("match").isNotNull() & long_enough).select(
        "blob", kinds[F.col("kind")]["pack"].alias("pack"), span.alias("span")
    )
    return found.groupBy("blob", "pack").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def unseen(addresses: DataFrame, ledger: DataFrame, packs: list[str]) -> DataFrame:
    """blob, todo: addresses (blob) with the packs that the ledger lacks for them, where there are any."""
    every = F.array(*[F.lit(p) for p in packs])
    seen = ledger.filter(F.col("pack").isin(packs)).groupBy("blob").agg(F.collect_set("pack").alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return addresses.join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)


def new_pairs(
    versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, packs: dict[str, tuple[Rule, ...]] | None = None
) -> DataFrame:
    """blob, pack, spans (empty if none) of the pairs of versions' blobs and packs that the ledger (none: an empty one)
    lacks. All packs are scanned in one pass over the distinct blobs, each blob for those that it lacks."""
    packs = PACKS if packs is None else packs
    if ledger is None:
        todo = blobs(versions, text).withColumn("todo", F.array(*[F.lit(p) for p in packs]))
    else:
        lacking = staged(unseen(versions.select(content_address(text).alias("blob")).distinct(), ledger, list(packs)), "unseen-blobs")
        todo = blobs(versions, text, lacking).join(lacking, "blob")
    pairs = todo.select("blob", F.explode("todo").alias("pack"))
    return pairs.join(scan(todo, packs), ["blob", "pack"], "left").select(
        "blob", "pack", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")
    )


def extend_ledger(
    versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, packs: dict[str, tuple[Rule, ...]] | None = None
) -> DataFrame:
    """The ledger with what new_pairs adds to it."""
    new = new_pairs(versions, text, ledger, packs)
    return new if ledger is None else ledger.select("blob", "pack", "spans").unionByName(new)


def blob_findings(
    versions: DataFrame | None, text: str = "text", ledger: DataFrame | None = None, packs: dict[str, tuple[Rule, ...]] | None = None
) -> DataFrame:
    """blob, spans (of all packs, sorted) for blobs that have findings, as a staged table. Pairs of versions that the ledger
    lacks are scanned; without versions the ledger is taken as it is."""
    packs = PACKS if packs is None else packs
    if versions is not None:
        ledger = extend_ledger(versions, text, ledger, packs)
    found = ledger.filter(F.col("pack").isin(*packs) & (F.size("spans") > 0))
    return staged(found.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")), "findings")


def ledger_of(steps: list[tuple[DataFrame, dict[str, tuple[Rule, ...]]]], text: str = "text", at: str | None = None) -> DataFrame:
    """The ledger of a history: for each step, the pairs of its versions and packs that the steps before lack are
    scanned and appended to the table in a new folder of the shared one (or at, which may hold a ledger already)."""
    spark = steps[0][0].sparkSession
    kept = at is not None and spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration()).exists(
        spark._jvm.org.apache.hadoop.fs.Path(at)
    )
    at = at or shared_path(spark, "secret-ledger")
    schema = f"blob string, pack string, spans {SPAN}"
    for versions, packs in steps:
        ledger = spark.read.schema(schema).parquet(at) if kept else None
        new_pairs(versions, text, ledger, packs).write.mode("append").parquet(at)  # files of a step that fails don't count
        kept = True
    return spark.read.schema(schema).parquet(at)


def scanned(versions: DataFrame, text: str = "text") -> DataFrame:
    """The findings of versions through a new ledger, of which every blob is scanned once for every pack."""
    return blob_findings(None, ledger=ledger_of([(versions, PACKS)], text))


def with_spans(versions: DataFrame, found: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """versions with the spans of each row's blob as out, a name that versions doesn't have. Findings of few blobs are
    broadcast, and no text moves. Of more, rows are dealt by blob and salt, and findings repeated for each salt, so that a blob
    of many copies is spread. The salt is a hash of the row's columns: a task that is repeated deals its rows as before."""
    if out in versions.columns:
        raise ValueError(f"versions has a column {out} already")
    row = F.struct(*[F.col(f"`{c}`") for c in versions.columns]).alias("row")
    size = found.agg(F.count("*").alias("blobs"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    if size["blobs"] <= FOUND and size["spans"] <= FOUND_SPANS:
        done = versions.select(row, content_address(text).alias("blob")).join(F.broadcast(found), "blob", "left")
    else:
        salts = 16
        salt = F.pmod(identity(versions, [c for c in versions.columns if c != text])[0], F.lit(salts)).cast("int")
        left = versions.select(row, content_address(text).alias("blob"), salt.alias("salt"))
        right = found.select("blob", "spans", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        done = left.join(right, ["blob", "salt"], "left")
    return done.select("row.*", F.coalesce("spans", F.array().cast(SPAN)).alias(out))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(rows: DataFrame, spans: str = "spans") -> DataFrame:
    """The counts and digests of a row's spans."""
    s = F.col(spans)
    of = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(s, lambda x: x["ord"] < len(BASE))
    return rows.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"),
    )


def digested(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The digest of each document, by its doc_id; other columns don't matter."""
    return digest(with_spans(docs.select("doc_id", "text"), found))


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """text with each run of overlapping spans replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        after = s["start"] >= acc["at"]
        out = F.when(
            after, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        ).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, found: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with the spans of each text replaced by a mark; the column of its length, if there is one, follows the texts
    that change. Columns as they were; null texts stay null."""
    spans = fresh(docs, "spans")
    rows = with_spans(docs, found, text, spans)
    new = fresh(rows, "redacted")
    rows = rows.withColumn(new, F.when(F.col(f"`{text}`").isNotNull(), redact(F.col(f"`{text}`"), F.col(spans))))
    put = {text: F.col(new)}
    if length in docs.columns:
        put[length] = F.when(F.size(spans) > 0, F.length(new).cast(docs.schema[length].dataType)).otherwise(F.col(length))
    return rows.select(*[put.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
