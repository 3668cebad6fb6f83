"""Sources and sinks: collected reviews as JSON lines or CSV, templates, datasets, event logs and configuration."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "source string, platform string, review_id string, title string, body string, rating double, author string, product string, url string, metadata map<string,string>"

#: Supersets of the logs' fields over all versions: all may be null, numbers are doubles.
LOGS = {
    "generation": "timestamp timestamp_ntz, review_id string, session_id string, model string, rating double, persona string, time double, cost double, attempt double, had_feedback boolean",
    "quality": "timestamp timestamp_ntz, review_id string, stage string, session_id string, length double, unique_words double, self_bleu_diversity double, sentiment_alignment double, passed_statistical boolean, attempt_number double, adaptive_threshold double, bias_check struct<is_unrealistic:boolean,unrealistic_score:double,sentiment_mismatch:struct<is_mismatch:boolean,sentiment:string,confidence:double,expected_sentiment:string,alignment_score:double,rating:double,predicted_rating:double,rating_difference:double,threshold_used:double,method:string>,generic_patterns:struct<is_generic:boolean,generic_score:double,found_generic_phrases:array<string>,repetition_score:double,exclamation_ratio:double>,threshold_used:double,circuit_breaker_active:boolean,attempt_number:double>",
    "judge": "timestamp timestamp_ntz, review_id string, session_id string, overall_score double, individual_scores map<string,string>, secondary_scores map<string,string>, judge_consensus struct<enabled:boolean,agreement_rate:double,agreed_count:double,total_comparisons:double>, final_decision string, feedback string, evaluation_time double, primary_judge string, dimension_scores map<string,double>",
    "rejections": "timestamp timestamp_ntz, review_id string, session_id string, attempt double, reasons array<string>",
}
SESSION_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) - (.*?) - ([A-Z]+) - (.*)$"

# Columns of the collection templates, and the columns that aren't metadata.
TEMPLATE_COLUMNS = ("id", "platform", "product", "title", "body", "rating", "author", "url")
TEMPLATE_EXTRA = {
    "g2": ("company_size", "industry", "role"), "capterra": ("company_size", "industry", "use_case"),
    "reddit": ("subreddit", "thread_title"),
}
KNOWN_COLUMNS = ("id", "review_id", "title", "body", "review_text", "rating", "author", "user", "product", "tool", "url", "platform")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Collected reviews (JSON lines). A missing path is an empty table; rows without a body are left out. Texts may be of any length:
    at the parser's own bound of 20 million characters a row would be taken for a broken one, and lost."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], REVIEW)
    return spark.read.schema(REVIEW).option("maxStringLen", 2**31 - 1).json(path).filter(F.col("body").isNotNull())


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of reviews as it is: quoted commas, quotes and line breaks in fields; all columns are text."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def normalise(raw: DataFrame, source: str) -> DataFrame:
    """Rows of any collection in the shape of REVIEW: the first filled column of each group of names; other columns are
    metadata."""

    def first(*names: str, default: str | None = ""):
        filled = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*filled, F.lit(default)) if filled else F.lit(default).cast("string")

    rest = [c for c in raw.columns if c not in KNOWN_COLUMNS]
    metadata = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]) if rest else F.create_map()
    return raw.select(
        F.lit(source).alias("source"), first("platform", default=source).alias("platform"), first("id", "review_id", default=None).alias("review_id"), first("title").alias("title"), first("body", "review_text").alias("body"),
        first("rating", default="0").cast("double").alias("rating"), first("author", "user").alias("author"), first("product", "tool").alias("product"), first("url").alias("url"), metadata.cast("map<string,string>").alias("metadata"),
    )


def append_reviews(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_template(spark: SparkSession, path: str, platform: str) -> None:
    """An empty CSV that only has its header."""
    columns = (*TEMPLATE_COLUMNS, *TEMPLATE_EXTRA.get(platform, ()))
    spark.createDataFrame([(",".join(columns),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def dataset_rows(reviews: DataFrame) -> DataFrame:
    """Accepted reviews in the 13 columns of the dataset."""
    c = F.col
    return reviews.select(
        c("review_id").alias("id"), "text", "rating", c("persona.name").alias("persona"), c("model_used").alias("model"), "seed_words",
        "generation_time", "cost", c("statistical_metrics").alias("statistical_scores"), c("llm_judge_results").alias("llm_judge_scores"),
        "final_decision", "regeneration_count", c("persona").alias("metadata"),
    )


def write_dataset(reviews: DataFrame, path: str) -> None:
    dataset_rows(reviews).write.mode("overwrite").json(path)


def logged(rows: DataFrame, session_id: str) -> DataFrame:
    """Event rows with the time and session they are logged in."""
    return rows.withColumns(
        {"timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "session_id": F.lit(session_id)}
    )


def append_log(rows: DataFrame, path: str, session_id: str) -> None:
    logged(rows, session_id).write.mode("append").json(path)


def read_log(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.schema(LOGS[kind]).json(path)


def read_session_log(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, logger, level, message of text logs; lines of another form are left out."""
    line = lambda i: F.regexp_extract("value", SESSION_LINE, i)
    rows = spark.read.option("lineSep", "\n").text(path).filter(F.col("value").rlike(SESSION_LINE))
    return rows.select(
        F.to_timestamp_ntz(line(1), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("timestamp"), line(2).alias("logger"), line(3).alias("level"),
        line(4).alias("message"),
    )


def session_log_rest(spark: SparkSession, path: str) -> DataFrame:
    """file, line of what read_session_log leaves out: further lines of an entry, and whatever else is there."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return rows.filter(~F.col("line").rlike(SESSION_LINE))


class Collection:
    """Reviews as lines of JSON, taken from files as those come: accepted and rejected rows are tables, and a scan reads only
    files that none before it has read.

    A line is rejected if it is no JSON object, if a field is of another type, or if it has no body, and is kept as it is with
    its file and the reason. Each scan is a batch of a file stream; its folders are numbered and replace themselves, so
    that a batch that is repeated after a failure leaves one copy. Blank lines are lines.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def scan(self, source: str) -> None:
        lines = self.spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", True).text(source)
        lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
        run = lines.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()
        run.awaitTermination()

    def take(self, lines: DataFrame, number: int) -> None:
        parsed = F.from_json("line", f"{REVIEW}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        rows = lines.withColumn("r", parsed)
        fields = F.when(~F.startswith(F.ltrim(F.col("line")), F.lit("{")) | F.try_parse_json("line").isNull(), "not an object")
        rows = rows.withColumn("why", F.coalesce(fields, F.when(F.col("r._bad").isNotNull(), "a field of another type"), F.when(F.col("r.body").isNull(), "no body")))
        rows.filter("why is null").select("file", *[F.col(f"r.{f.name}") for f in lines.sparkSession.createDataFrame([], REVIEW).schema]).write.mode("overwrite").parquet(f"{self.path}/accepted/batch={number}")
        rows.filter("why is not null").select("file", "line", "why", F.col("r.review_id").alias("review_id")).write.mode("overwrite").parquet(f"{self.path}/rejected/batch={number}")

    def accepted(self) -> DataFrame:
        return self.spark.read.schema(f"file string, {REVIEW}, batch long").parquet(f"{self.path}/accepted")

    def rejected(self) -> DataFrame:
        return self.spark.read.schema("file string, line string, why string, review_id string, batch long").parquet(f"{self.path}/rejected")


def session_id(at: str = "now") -> str:
    from datetime import datetime

    return (datetime.now() if at == "now" else datetime.fromisoformat(at)).strftime("%Y%m%d_%H%M%S")


def logger(session: str, path: str | None = None):
    """The logger of a session: lines in the form that read_session_log reads, to the error stream and, if a path on this
    machine is given, to a file. The same session has one logger, however often it is asked for."""
    import logging

    log = logging.getLogger(f"glossmill.{session}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        log.propagate = False
        for handler in (logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])):
            handler.setFormatter(logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s"))
            log.addHandler(handler)
    return log


def captured(ask: Callable[[str], str]) -> list[tuple]:
    """Reviews typed in (rows of REVIEW), field by field, until a title is blank; a rating that is no number is 0."""
    rows = []
    while title := ask("Title (blank to end): ").strip():
        body, rating, author, product, platform = (
            ask(f"{name}: ").strip() for name in ("Text", "Rating (1 to 5)", "Author", "Product", "Platform")
        )
        try:
            stars = float(rating)
        except ValueError:
            stars = 0.0
        rows.append(("manual", platform or "manual", f"manual_{len(rows) + 1:04d}", title, body, stars, author, product, "", {}))
    return rows


def asked_config(ask: Callable[[str], str]) -> Config:
    """A configuration from answers; a blank one keeps the default, weights are made to sum to 1."""
    base = Config()
    take = lambda text, default, kind: kind(x) if (x := ask(f"{text} [{default}]: ").strip()) else default

    def weighted(text: str, default: tuple) -> tuple:
        given = [x.split(":") for x in ask(f"{text}, as name:weight, comma-separated [{default[0][0]}]: ").split(",") if x.strip()]
        pairs = [(x[0].strip(), float(x[1]) if len(x) > 1 else 1.0) for x in given]
        total = sum(w for _, w in pairs)
        return tuple((n, w / total) for n, w in pairs) if pairs and total > 0 else default

    return Config(
        domain=take("Domain", base.domain, str), target_samples=take("Samples", base.target_samples, int),
        personas=weighted("Personas", base.personas), models=weighted("Models", base.models),
    )


def config_yaml(c: Config) -> str:
    """What load_config reads."""
    import json

    q = json.dumps  # strings and numbers of JSON are YAML
    lines = ["generation:", f"  domain: {q(c.domain)}", f"  target_samples: {c.target_samples}", "personas:"]
    lines += [f"  - {{name: {q(n)}, weight: {w!r}}}" for n, w in c.personas]
    lines += ["models:"] + [f"  - {{provider: {q(n)}, weight: {w!r}}}" for n, w in c.models]
    lines += ["rating_distribution:"] + [f"  {i}_star: {w!r}" for i, w in enumerate(c.ratings, 1)]
    lines += ["quality_thresholds:" + ("" if c.thresholds else " {}")] + [f"  {k}: {q(v)}" for k, v in c.thresholds.items()]
    return "\n".join(lines) + "\n"


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metrics row as JSON; columns whose names begin with an underscore stay out."""
    metrics.select(*[c for c in metrics.columns if not c.startswith("_")]).coalesce(1).write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Config:
    """A run's settings. Weights of ratings, personas and models must sum to 1 within a hundredth."""

    domain: str = "software"
    target_samples: int = 100
    personas: tuple[tuple[str, float], ...] = (("a team lead", 1.0),)
    ratings: tuple[float, float, float, float, float] = (0.05, 0.10, 0.20, 0.35, 0.30)
    models: tuple[tuple[str, float], ...] = (("offline", 1.0),)
    thresholds: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, weights in (
            ("ratings", self.ratings), ("personas", [w for _, w in self.personas]), ("models", [w for _, w in self.models])
        ):
            if not 0.99 <= sum(weights) <= 1.01:
                raise ValueError(f"the weights of {name} sum to {sum(weights)}, not 1")


def parse_config(text: str) -> Config:
    """YAML of sections generation, personas, rating_distribution, models and quality_thresholds."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading a configuration needs PyYAML; build a Config instead") from e
    d = yaml.safe_load(text) or {}
    g, stars = d.get("generation", {}), d.get("rating_distribution", {})
    base = Config()
    return Config(
        domain=g.get("domain", base.domain), target_samples=int(g.get("target_samples", base.target_samples)),
        personas=tuple((p["name"], float(p["weight"])) for p in d.get("personas", [])) or base.personas,
        ratings=tuple(float(stars[f"{i}_star"]) for i in range(1, 6)) if stars else base.ratings,
        models=tuple((f"{m['provider']}/{m['name']}" if m.get("name") else m["provider"], float(m["weight"])) for m in d.get("models", [])) or base.models,
        thresholds=dict(d.get("quality_thresholds", {})),
    )


def load_config(path: str) -> Config:
    """The configuration in a YAML file."""
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


def api_key(variable: str) -> str:
    """A key from the driver's environment; it never enters a plan."""
    if not (value := os.environ.get(variable)):
        raise KeyError(f"{variable} is not set")
    return value
