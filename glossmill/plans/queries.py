"""Queries over the driver's tables, one for each family of operators, and the same in SQL.

Documents play the reviews: seq is doc_id, the rating 1 + doc_id % 5, the model source, the session lang and the
attempt 1 + doc_id % 3. What documents don't have (costs, times, verdicts, histories) is made of doc_id by the same
arithmetic on both sides. Doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import sentiment as S
from glossmill.functions import text as T
from glossmill.operators import bleu_state, diversity, gates, generate, judge, metrics, models, realism, windows
from glossmill.plans import judging
from glossmill.plans.staging import shared_path, spread, staged
from glossmill.sources import io, providers
from glossmill.streaming import breaker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(c(n), 6).alias(n) if t == "double" else c(n) for n, t in df.dtypes])

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read(spark, sf_dir, "documents"))
    return d.select(
        c("doc_id").alias("seq"), "text", (c("doc_id") % 5 + 1).cast("int").alias("rating"), c("source").alias("model"),
        c("lang").alias("session"), (c("doc_id") % 3 + 1).cast("int").alias("attempt"),
    )


# What SQL says for the functions above.
BASE = "r AS (SELECT doc_id AS seq, text, CAST(1 + doc_id % 5 AS INT) AS rating, source AS model, lang AS session, CAST(1 + doc_id % 3 AS INT) AS attempt FROM documents)"


def w(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def hits(low: str, keywords: Sequence[str], weight: int = 1) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({low}, {quoted(k)}) THEN {weight} ELSE 0 END" for k in keywords) + ")"


STATS_SQL = rf"""
    SELECT len({w('text')}) AS n, len(list_distinct({w('lower(text)')})) AS u, len(string_split(text, '.')) AS s,
        list_avg(list_transform(list_filter(string_split(text, '.'), lambda p: len({w('p')}) > 0), lambda p: len({w('p')}))) AS wps,
        len(regexp_extract_all(text, '(?i)\b(?:{"|".join(T.TECH_TERMS)})\b')) AS tt
    FROM {{table}}"""


@query(f"""
SELECT round(avg(n), 6) AS avg_length, round(stddev_pop(n), 6) AS std_length, round(avg(u), 6) AS avg_unique_words, round(avg(s), 6) AS avg_sentences,
    round(avg(wps), 6) AS avg_words_per_sentence, round(avg(tt), 6) AS avg_tech_terms, CAST(min(n) AS BIGINT) AS min_length, CAST(max(n) AS BIGINT) AS max_length
FROM ({STATS_SQL.format(table='documents')})""")
def corpus_stats(spark, sf_dir):
    return realism.corpus_stats(reviews(spark, sf_dir).select("text"))


@query(
    f"SELECT doc_id AS seq, CAST(len({w('text')}) AS BIGINT) AS n_words, CAST(len(list_distinct({w('lower(text)')})) AS BIGINT) AS n_unique, CAST(len(string_split(text, '.')) AS BIGINT) AS n_sentences FROM documents"
)
def word_metrics(spark, sf_dir):
    return realism.text_metrics(reviews(spark, sf_dir)).select("seq", "n_words", "n_unique", "n_sentences")


@query(rf"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)\b(?:{'|'.join(T.TECH_TERMS)})\b')) AS BIGINT) AS n_tech_terms FROM pages")
def tech_terms(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.tech_term_count(c("html")).alias("n_tech_terms"))


@query(
    f"SELECT CAST(count(*) AS BIGINT) AS total_words, count(DISTINCT t) AS vocabulary_size, round(count(DISTINCT t) / count(*), 6) AS ttr FROM (SELECT unnest({w('lower(text)')}) AS t FROM documents)"
)
def ttr(spark, sf_dir):
    return diversity.type_token(reviews(spark, sf_dir))


@query(f"""
WITH t AS (SELECT doc_id, unnest({w('lower(text)')}) AS t, generate_subscripts({w('lower(text)')}, 1) AS i FROM documents),
g AS (SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM t), k AS (SELECT unnest(range((SELECT (count(*) - 100) // 50 + 1 FROM g))) AS k)
SELECT round(avg(d / 100.0), 6) AS mattr FROM (SELECT k, count(DISTINCT t) AS d FROM k JOIN g ON g.g // 50 IN (k.k, k.k + 1) GROUP BY k)""")
def mattr(spark, sf_dir):
    return diversity.mattr(reviews(spark, sf_dir))


@query(f"""
WITH t AS (SELECT doc_id, unnest({w('lower(text)')}) AS t, generate_subscripts({w('lower(text)')}, 1) AS i FROM documents),
g AS (SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM t), k AS (SELECT unnest(range((SELECT (count(*) - 100) // 30 + 1 FROM g))) AS k)
SELECT round(avg(d / 100.0), 6) AS mattr FROM (SELECT k, count(DISTINCT t) AS d FROM k JOIN (SELECT t, g, unnest(range(greatest((g - 70) // 30, 0), g // 30 + 1)) AS at FROM g) x ON x.at = k.k AND x.g >= k.k * 30 AND x.g < k.k * 30 + 100 GROUP BY k)""")
def mattr_every_30(spark, sf_dir):
    """A stride that doesn't divide the window."""
    return diversity.mattr(reviews(spark, sf_dir), 100, 30)


def ngram_sql(n: int) -> str:
    grams = f"list_transform(range(1, len(a) - {n - 2}), lambda i: array_to_string(a[i:i+{n - 1}], ' '))"
    return f"SELECT CAST(count(*) AS BIGINT) AS total, count(DISTINCT g) AS unique_ngrams, round(count(DISTINCT g) / count(*), 6) AS diversity FROM (SELECT unnest({grams}) AS g FROM (SELECT {w('lower(text)')} AS a FROM documents))"


@query(ngram_sql(2))
def bigram_diversity(spark, sf_dir):
    return diversity.ngram_diversity(reviews(spark, sf_dir), 2)


@query(ngram_sql(3))
def trigram_diversity(spark, sf_dir):
    return diversity.ngram_diversity(reviews(spark, sf_dir), 3)


BLEU_SQL = f"""
t AS (SELECT doc_id AS seq, {w('text')} AS a FROM documents),
g AS (SELECT seq, n, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i+n-1], ' '))) AS g FROM t, (SELECT unnest([1, 2, 3, 4]) AS n)),
k AS (SELECT seq, n, g, count(*) AS c FROM g GROUP BY ALL),
o AS (SELECT n, g, max(CASE WHEN x = 1 THEN seq END) AS s1, max(CASE WHEN x = 1 THEN c END) AS c1, coalesce(max(CASE WHEN x = 2 THEN c END), 0) AS c2
    FROM (SELECT *, row_number() OVER (PARTITION BY n, g ORDER BY c DESC, seq) AS x FROM k) WHERE x <= 2 GROUP BY n, g),
m AS (SELECT seq, n, sum(least(c, CASE WHEN s1 = k.seq THEN c2 ELSE c1 END)) AS m FROM k JOIN o USING (n, g) GROUP BY seq, n),
l AS (SELECT seq, len(a) AS len FROM t),
f AS (SELECT x.seq, arg_min(y.len, abs(y.len - x.len) * 1000000 + y.len) AS ref FROM l x JOIN l y ON x.seq <> y.seq GROUP BY x.seq),
p AS (SELECT l.seq, len, ref, n, coalesce(m, 0) AS m, greatest(len - n + 1, 1) AS d FROM l JOIN f USING (seq) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) LEFT JOIN m USING (seq, n)),
b AS (SELECT seq, CASE WHEN max(CASE WHEN n = 1 THEN m END) = 0 THEN 0 ELSE CASE WHEN max(len) > max(ref) THEN 1 ELSE exp(1 - max(ref) / max(len)) END * exp(sum(0.25 * ln(CASE WHEN m = 0 THEN 0.1 / d ELSE m / d END))) END AS bleu FROM p GROUP BY seq)"""


@query(f"WITH {BLEU_SQL} SELECT seq, round(bleu, 6) AS bleu FROM b")
def self_bleu_docs(spark, sf_dir):
    return diversity.self_bleu_docs(reviews(spark, sf_dir))


@query(f"WITH {BLEU_SQL} SELECT round(1 - avg(bleu), 6) AS self_bleu_diversity FROM b")
def self_bleu(spark, sf_dir):
    return diversity.self_bleu_diversity(reviews(spark, sf_dir))


@query(SQL["self_bleu"])
def self_bleu_appended(spark, sf_dir):
    """The same of documents that come in four batches, from a stored state that each of them changes."""
    rows = reviews(spark, sf_dir).select("seq", "text")
    edges = rows.select(c("seq").cast("double").alias("o")).approxQuantile("o", [0.25, 0.5, 0.75], 0.01)
    corpus = bleu_state.Corpus(spark, shared_path(spark, "corpus"))
    for i in range(4):
        mine = (c("seq") > edges[i - 1] if i else F.lit(True)) & (c("seq") <= edges[i] if i < 3 else F.lit(True))
        corpus.append(rows.filter(mine), i)
    return corpus.diversity()


COS_SQL = "cs AS (SELECT list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"


@query(f"WITH {COS_SQL} SELECT count(*) AS pairs, round(avg(s), 6) AS avg_similarity, round(stddev_pop(s), 6) AS std_similarity FROM cs")
def cosine_moments(spark, sf_dir):
    return diversity.cosine_moments(read(spark, sf_dir, "embeddings"))


@query(f"WITH {COS_SQL} SELECT round(max(s), 6) AS max_similarity, round(min(s), 6) AS min_similarity FROM cs")
def cosine_extremes(spark, sf_dir):
    return diversity.cosine_extremes(read(spark, sf_dir, "embeddings"))


OVERALL_SQL = f"""
{BLEU_SQL}, {COS_SQL}, d AS (SELECT 1 - avg(bleu) AS x FROM b), s AS (SELECT 1 - avg(s) AS x FROM cs),
y AS (SELECT count(DISTINCT t) / count(*) AS x FROM (SELECT unnest({w('lower(text)')}) AS t FROM documents)),
b2 AS (SELECT diversity AS x FROM ({ngram_sql(2).replace('round(count(DISTINCT g) / count(*), 6)', 'count(DISTINCT g) / count(*)')})),
b3 AS (SELECT diversity AS x FROM ({ngram_sql(3).replace('round(count(DISTINCT g) / count(*), 6)', 'count(DISTINCT g) / count(*)')})),
overall AS (SELECT round(d.x, 6) AS self_bleu_diversity, round(s.x, 6) AS semantic_diversity, round(y.x, 6) AS ttr, round(b2.x, 6) AS bigram_diversity, round(b3.x, 6) AS trigram_diversity,
    round(0.3 * d.x + 0.3 * s.x + 0.2 * y.x + 0.1 * b2.x + 0.1 * b3.x, 6) AS overall_score FROM d, s, y, b2, b3)"""


@query(f"WITH {OVERALL_SQL} SELECT * FROM overall")
def overall_diversity(spark, sf_dir):
    one = diversity.overall(reviews(spark, sf_dir), read(spark, sf_dir, "embeddings"))
    return one.select("self_bleu_diversity", "semantic_diversity", "ttr", "bigram_diversity", "trigram_diversity", "overall_score")


def scores_sql(p: S.Profile) -> str:
    """CTE s: all scores of a profile for r; sentences are cut, trimmed and counted once."""
    low = "lower(text)"
    sure = lambda lead: f"least(0.5::DOUBLE + ({lead}) * 0.08::DOUBLE, 0.90::DOUBLE)"
    fall = lambda a: f"greatest({a[0]}::DOUBLE - attempt * {a[1]}::DOUBLE, {a[2]}::DOUBLE)"
    base = "CASE rating " + " ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(p.base, 1)) + f" ELSE {p.base_default}::DOUBLE END"
    trim = r"regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')"
    return f"""
s0 AS (SELECT *, {hits(low, p.strong_positive, 2)} + {hits(low, p.positive)} AS pos, {hits(low, p.strong_negative, 2)} + {hits(low, p.negative)} AS neg, {hits(low, p.phrases)} AS found,
    list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {trim}), lambda x: length(x) > 10) AS st FROM r),
s1 AS (SELECT *, CASE WHEN pos > neg + {p.margin} THEN 'POSITIVE' WHEN neg > pos + {p.margin} THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment,
    CASE WHEN pos > neg + {p.margin} THEN {sure('pos - neg')} WHEN neg > pos + {p.margin} THEN {sure('neg - pos')} ELSE 0.45::DOUBLE END AS confidence,
    CASE WHEN rating <= 2 THEN 'NEGATIVE' WHEN rating = 3 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS expected_sentiment,
    greatest({base} - attempt * {p.base_step}::DOUBLE, {p.base_floor}::DOUBLE) AS sentiment_threshold,
    list_filter(list_transform(st, lambda x: {w('x')}[1:2]), lambda x: len(x) >= 2) AS starts,
    (length(text) - length(replace(text, '!', '')))::DOUBLE / greatest(len(st), 1) AS exclamation_ratio, found / {len(p.phrases)}.0::DOUBLE AS generic_score FROM s0),
s2 AS (SELECT *, CASE WHEN sentiment = expected_sentiment THEN confidence WHEN expected_sentiment = 'NEUTRAL' THEN {p.neutral_alignment}::DOUBLE ELSE 1::DOUBLE - confidence END AS alignment_score,
    CASE WHEN len(st) > 1 AND len(starts) > 1 THEN 1::DOUBLE - len(list_distinct(starts))::DOUBLE / len(starts) ELSE 0::DOUBLE END AS repetition_score FROM s1),
s3 AS (SELECT *, found >= {p.least_phrases} OR (repetition_score > {p.repetition}::DOUBLE AND exclamation_ratio > {p.exclamation}::DOUBLE) AS is_generic,
    ((rating >= 4 AND sentiment = 'NEGATIVE') OR (rating <= 2 AND sentiment = 'POSITIVE')) AND confidence > {p.sure}::DOUBLE AND NOT alignment_score >= sentiment_threshold AS is_mismatch FROM s2),
s AS (SELECT *, CASE WHEN is_mismatch THEN {fall(p.mismatch_weight)} * confidence ELSE 0::DOUBLE END + CASE WHEN is_generic THEN {p.generic_weight}::DOUBLE * generic_score ELSE 0::DOUBLE END
    + CASE WHEN repetition_score > 0.4::DOUBLE THEN {p.repetition_weight}::DOUBLE ELSE 0::DOUBLE END AS raw, {fall(p.reject)} AS reject_threshold FROM s3)"""


def sentiment_sql(p: S.Profile) -> str:
    return f"WITH {BASE}, {scores_sql(p)} SELECT seq, CAST(pos AS INT) AS pos_score, CAST(neg AS INT) AS neg_score, sentiment, round(confidence, 6) AS confidence, expected_sentiment, round(alignment_score, 6) AS alignment_score, is_mismatch, round(sentiment_threshold, 6) AS sentiment_threshold FROM s"


SENTIMENT = (
    "seq", "pos_score", "neg_score", "sentiment", "confidence", "expected_sentiment", "alignment_score", "is_mismatch",
    "sentiment_threshold",
)


@query(sentiment_sql(S.LENIENT))
def keyword_sentiment(spark, sf_dir):
    return S.with_scores(reviews(spark, sf_dir), S.LENIENT).select(*SENTIMENT)


@query(sentiment_sql(S.STRICT))
def keyword_sentiment_strict(spark, sf_dir):
    return S.with_scores(reviews(spark, sf_dir), S.STRICT).select(*SENTIMENT)


@query(f"WITH {BASE}, {scores_sql(S.STRICT)} SELECT expected_sentiment, sentiment, count(*) AS n FROM s GROUP BY ALL")
def sentiment_confusion(spark, sf_dir):
    return S.with_scores(reviews(spark, sf_dir), S.STRICT).groupBy("expected_sentiment", "sentiment").agg(F.count("*").alias("n"))


#: Keywords that the test tables' invented words do hold, so that scores vary.
DATA_PROFILE = S.Profile(
    **{
        **S.STRICT.__dict__, "name": "data", "strong_positive": ("tion", "ment"), "positive": ("the", "que", "heit", "our"),
        "strong_negative": ("ness", "erie"), "negative": ("and", "sch", "eau", "ado"), "phrases": ("of the", "in the", "de la", "que de"),
    }
)


@query(sentiment_sql(DATA_PROFILE))
def keyword_sentiment_own_words(spark, sf_dir):
    return S.with_scores(reviews(spark, sf_dir), DATA_PROFILE).select(*SENTIMENT)


def thresholds_sql() -> str:
    out = []
    for p in (S.LENIENT, S.STRICT):
        base = "CASE rating " + " ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(p.base, 1)) + " END"
        fall = lambda a: f"round(greatest({a[0]}::DOUBLE - attempt * {a[1]}::DOUBLE, {a[2]}::DOUBLE), 6)"
        out.append(
            f"SELECT DISTINCT '{p.name}' AS profile, rating, attempt, round(greatest({base} - attempt * {p.base_step}::DOUBLE, {p.base_floor}::DOUBLE), 6) AS alignment_threshold, {fall(p.reject)} AS reject_threshold, {fall(p.mismatch_weight)} AS mismatch_weight FROM r"
        )
    return f"WITH {BASE} " + " UNION ALL ".join(out)


@query(thresholds_sql())
def adaptive_thresholds(spark, sf_dir):
    keys = reviews(spark, sf_dir).select("rating", "attempt").distinct()
    of = lambda p: keys.select(
        F.lit(p.name).alias("profile"), "rating", "attempt",
        S.alignment_threshold(c("rating"), c("attempt"), p).alias("alignment_threshold"),
        S.falling(*p.reject, c("attempt")).alias("reject_threshold"), S.falling(*p.mismatch_weight, c("attempt")).alias("mismatch_weight"),
    )
    return of(S.LENIENT).unionByName(of(S.STRICT))


@query(
    f"WITH {BASE}, {scores_sql(DATA_PROFILE)} SELECT seq, round(generic_score, 6) AS generic_score, is_generic, array_to_string(list_filter([{', '.join(quoted(p) for p in DATA_PROFILE.phrases)}], lambda p: contains(lower(text), p)), '|') AS found FROM s"
)
def generic_patterns(spark, sf_dir):
    return S.with_scores(reviews(spark, sf_dir), DATA_PROFILE).select(
        "seq", "generic_score", "is_generic", F.array_join("found_generic", "|").alias("found")
    )


@query(
    f"WITH {BASE}, {scores_sql(S.LENIENT)} SELECT seq, round(repetition_score, 6) AS repetition_score, round(exclamation_ratio, 6) AS exclamation_ratio FROM s"
)
def repetition(spark, sf_dir):
    return S.with_scores(reviews(spark, sf_dir), S.LENIENT).select("seq", "repetition_score", "exclamation_ratio")


@query(
    f"WITH {BASE}, {scores_sql(DATA_PROFILE)} SELECT seq, round(least(raw, 1), 6) AS unrealistic_score, round(reject_threshold, 6) AS reject_threshold, raw > reject_threshold AS is_unrealistic FROM s"
)
def unrealistic_score(spark, sf_dir):
    return S.with_scores(reviews(spark, sf_dir), DATA_PROFILE).select("seq", "unrealistic_score", "reject_threshold", "is_unrealistic")


def star_sql(p: S.Profile) -> str:
    f = p.star_factors
    a = f"CASE d WHEN 0 THEN k WHEN 1 THEN k * {f[1]}::DOUBLE WHEN 2 THEN k * {f[2]}::DOUBLE ELSE k * {f[3]}::DOUBLE END"
    strong = " OR ".join(f"(d BETWEEN {lo} AND {hi} AND k > {x}::DOUBLE)" for lo, hi, x in p.star_mismatch)
    return f"WITH {BASE}, x AS (SELECT seq, abs(CAST(1 + (seq // 5) % 5 AS INT) - rating) AS d, (50 + seq % 50) / 100.0::DOUBLE AS k FROM r) SELECT seq, round({a}, 6) AS alignment_score, ({strong}) AND NOT ({a}) >= 0.2::DOUBLE AS is_mismatch FROM x"


@query(star_sql(S.STRICT))
def star_sentiment(spark, sf_dir):
    p, k = ((F.floor(c("seq") / 5) % 5) + 1).cast("int"), (F.lit(50) + c("seq") % 50) / F.lit(100.0)
    return reviews(spark, sf_dir).select(
        "seq", S.star_alignment(p, c("rating"), k, S.STRICT).alias("alignment_score"),
        S.star_mismatch(p, c("rating"), k, F.lit(0.2), S.STRICT).alias("is_mismatch"),
    )


THRESHOLDS = gates.Thresholds()
_T = THRESHOLDS
GATES_SQL = f"""
{BASE}, {scores_sql(DATA_PROFILE)},
q AS (SELECT *, len({w('text')}) AS n, len(list_distinct({w('lower(text)')})) AS u, (seq % 10) / 10.0::DOUBLE AS div FROM s),
x AS (SELECT *, list_filter([
    CASE WHEN n < {_T.min_length} THEN format('Too short: {{}} words (min: {_T.min_length})', n) END,
    CASE WHEN n > {_T.max_length} THEN format('Too long: {{}} words (max: {_T.max_length})', n) END,
    CASE WHEN u < {_T.min_unique_words} THEN format('Low vocabulary: {{}} unique words (min: {_T.min_unique_words})', u) END,
    CASE WHEN div < {1 - _T.max_self_bleu}::DOUBLE THEN format('Too similar to existing reviews (diversity: {{:.2f}})', div) END,
    CASE WHEN alignment_score < sentiment_threshold THEN format('Sentiment-rating mismatch (alignment: {{:.2f}}, threshold: {{:.2f}})', alignment_score, sentiment_threshold) END,
    CASE WHEN raw > reject_threshold THEN format('Unrealistic patterns (score: {{:.2f}})', least(raw, 1)) END], lambda z: z IS NOT NULL) AS reasons FROM q)"""


def gated(spark, sf_dir) -> DataFrame:
    return gates.check(reviews(spark, sf_dir).withColumn("self_bleu_diversity", (c("seq") % 10) / F.lit(10.0)), THRESHOLDS, DATA_PROFILE)


@query(
    f"WITH {GATES_SQL} SELECT seq, CAST(n AS BIGINT) AS n_words, CAST(u AS BIGINT) AS n_unique, array_to_string(reasons, '; ') AS reasons, len(reasons) = 0 AS passed FROM x"
)
def quality_gates(spark, sf_dir):
    return gated(spark, sf_dir).select("seq", "n_words", "n_unique", F.array_join("reasons", "; ").alias("reasons"), "passed")


def class_sql(x: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {' OR '.join(f'contains(lower({x}), {quoted(k)})' for k in words)} THEN '{name}'" for name, words in gates.ISSUES
    ) + " ELSE 'other' END"


@query(
    f"WITH {GATES_SQL}, e AS (SELECT unnest(reasons) AS reason FROM x) SELECT {class_sql('reason')} AS issue, count(*) AS n FROM e GROUP BY 1"
)
def issue_class(spark, sf_dir):
    return gated(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy(
        gates.issue_class(c("reason")).alias("issue")
    ).agg(F.count("*").alias("n"))


@query(
    f"WITH {GATES_SQL} SELECT reason, count(*) AS n, min(seq) AS first_seen FROM (SELECT seq, unnest(reasons) AS reason FROM x) GROUP BY reason"
)
def gate_reason_histogram(spark, sf_dir):
    return metrics.reason_histogram(gated(spark, sf_dir))


@query(f"""
WITH {GATES_SQL}, h AS (SELECT reason, count(*) AS n, min(seq) AS first_seen FROM (SELECT seq, unnest(reasons) AS reason FROM x) GROUP BY reason)
SELECT reason, n, first_seen, round(n::DOUBLE / (SELECT count_if(len(reasons) > 0) FROM x) * 100, 6) AS pct FROM h ORDER BY n DESC, first_seen, reason LIMIT 10""")
def top_rejections(spark, sf_dir):
    return metrics.top_reasons(staged(gated(spark, sf_dir).select("seq", "reasons"), "gated"))


HISTORY_SQL = "CASE seq % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['length', 'length'] WHEN 2 THEN ['sentiment', 'sentiment'] ELSE ['diversity', 'diversity'] END"


@query(f"""
WITH {GATES_SQL}, y AS (SELECT *, attempt + 0 AS cnt, {HISTORY_SQL} AS h0, CASE WHEN len(reasons) > 0 THEN {class_sql('reasons[1]')} END AS cls FROM x),
z AS (SELECT *, CASE WHEN cnt >= 2 AND cls IS NOT NULL THEN list_append(h0, cls) ELSE h0 END AS h FROM y),
v AS (SELECT *, CASE WHEN cls IS NOT NULL AND cnt >= 2 AND len(h) >= 3 AND len(list_distinct(h[-3:])) = 1 THEN h[-1] END AS stuck, CASE WHEN rating <= 3 THEN 4 ELSE {_T.max_regeneration_attempts} END AS most FROM z)
SELECT seq, CASE WHEN len(reasons) = 0 THEN 'accept' WHEN stuck IN ('sentiment', 'unrealistic') THEN CASE WHEN alignment_score > 0.25 THEN 'accept' ELSE 'reject' END WHEN stuck IS NOT NULL AND stuck <> 'llm_judge_error' THEN 'reject' WHEN cnt < most THEN 'regenerate' ELSE 'reject' END AS decision,
    stuck IS NOT NULL AND stuck <> 'llm_judge_error' AS forced, array_to_string(h, '|') AS history FROM v""")
def decision(spark, sf_dir):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    h = F.when(c("seq") % 4 == 0, a()).when(c("seq") % 4 == 1, a("length", "length")).when(
        c("seq") % 4 == 2, a("sentiment", "sentiment")
    ).otherwise(a("diversity", "diversity"))
    rows = gates.decide(gated(spark, sf_dir).withColumns({"count": c("attempt"), "history": h}), THRESHOLDS)
    return rows.select("seq", "decision", "forced", F.array_join("history", "|").alias("history"))


REALISM_SQL = f"""
n AS (SELECT doc_id AS seq, text, len({w('text')}) AS n, len(list_distinct({w('lower(text)')})) AS u, len(string_split(text, '.')) AS k FROM documents),
q AS (SELECT *, n BETWEEN 50 AND 500 AS a, n > 0 AND u / n > 0.5 AS b, k BETWEEN 1 AND 20 AS c FROM n)"""


@query(
    f"WITH {REALISM_SQL} SELECT seq, a AS length_reasonable, b AS has_variation, c AS sentence_structure, round((a::INT + b::INT + c::INT) / 3.0, 6) AS realism_score FROM q"
)
def single_review_realism(spark, sf_dir):
    return realism.single_review(reviews(spark, sf_dir)).select(
        "seq", "length_reasonable", "has_variation", "sentence_structure", "realism_score"
    )


@query(
    f"WITH {REALISM_SQL}, z AS (SELECT seq, CASE WHEN length(text) < 50 THEN format('Review too short: {{}} < 50', length(text)) WHEN length(text) > 500 THEN format('Review too long: {{}} > 500', length(text)) WHEN (a::INT + b::INT + c::INT) / 3.0 < 0.5 THEN format('Low realism score: {{:.2f}}', ((a::INT + b::INT + c::INT) / 3.0)::DOUBLE) END AS reason FROM q) SELECT seq, reason, reason IS NULL AS passed FROM z"
)
def character_length_check(spark, sf_dir):
    return realism.character_length_check(reviews(spark, sf_dir)).select("seq", "reason", "passed")


@query(f"""
WITH {BASE.replace('CAST(1 + doc_id % 3 AS INT) AS attempt', '1 AS attempt')}, {scores_sql(DATA_PROFILE)},
q AS (SELECT *, len({w('text')}) AS n, len(list_distinct({w('lower(text)')})) AS u, len(string_split(text, '.')) AS k, (seq % 10) / 10.0::DOUBLE AS div FROM s),
z AS (SELECT *, ((n BETWEEN 50 AND 500)::INT + (n > 0 AND u / n > 0.5)::INT + (k BETWEEN 1 AND 20)::INT) / 3.0::DOUBLE AS rs FROM q),
v AS (SELECT seq, list_filter([CASE WHEN n < 50 THEN format('Too short: {{}} words', n) END, CASE WHEN n > 500 THEN format('Too long: {{}} words', n) END, CASE WHEN u < 20 THEN format('Low vocabulary: {{}} unique words', u) END,
    CASE WHEN div < 0.5 THEN format('Too similar to existing reviews: {{:.2f}}', div) END, CASE WHEN alignment_score < 0.7::DOUBLE THEN 'Sentiment-rating mismatch' END, CASE WHEN raw > reject_threshold THEN 'Unrealistic patterns detected' END,
    CASE WHEN rs < 0.7 THEN format('Low realism score: {{:.2f}}', rs) END], lambda i: i IS NOT NULL) AS issues FROM z)
SELECT seq, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS passed FROM v""")
def unified_validator(spark, sf_dir):
    rows = gates.validate(
        reviews(spark, sf_dir).drop("attempt").withColumn("self_bleu_diversity", (c("seq") % 10) / F.lit(10.0)), DATA_PROFILE
    )
    return rows.select("seq", F.array_join("issues", "; ").alias("issues"), "passed")


@query(f"""
WITH a AS (SELECT avg(n) AS l, avg(u) AS u, avg(s) AS s FROM ({STATS_SQL.format(table='documents')})), b AS (SELECT avg(n) AS l, avg(u) AS u, avg(s) AS s FROM ({STATS_SQL.format(table='benchmark')})),
d AS (SELECT a.l AS sl, a.u AS su, a.s AS ss, b.l AS rl, b.u AS ru, b.s AS rs, abs(a.l - b.l) / b.l AS dl, abs(a.u - b.u) / b.u AS du, abs(a.s - b.s) / b.s AS ds FROM a, b),
e AS (SELECT *, 1 - least(1, (dl + du + ds) / 3) AS score FROM d)
SELECT round(sl, 6) AS synthetic_avg_length, round(su, 6) AS synthetic_avg_unique_words, round(ss, 6) AS synthetic_avg_sentences, round(rl, 6) AS real_avg_length, round(ru, 6) AS real_avg_unique_words, round(rs, 6) AS real_avg_sentences,
    round(dl * 100, 6) AS length_diff_pct, round(du * 100, 6) AS unique_words_diff_pct, round(ds * 100, 6) AS sentence_diff_pct, round(score, 6) AS realism_score,
    CASE WHEN score > 0.9 THEN 'excellent' WHEN score > 0.8 THEN 'good' WHEN score > 0.7 THEN 'moderate' ELSE 'needs_improvement' END AS comparison_quality FROM e""")
def realism_compare(spark, sf_dir):
    return realism.compare(realism.corpus_stats(reviews(spark, sf_dir)), realism.corpus_stats(read(spark, sf_dir, "benchmark")))


RUN_SQL = "g AS (SELECT doc_id AS seq, source AS model, doc_id % 3 <> 0 AS accepted, (doc_id % 100) / 10.0::DOUBLE AS time, (doc_id % 7) * 0.001::DOUBLE AS cost, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 50) / 53.0::DOUBLE END AS quality_score, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE (doc_id % 20) / 23.0::DOUBLE END AS judge_score FROM documents)"
ROLLUP_SQL = """m AS (SELECT model, count(*) AS samples_generated, count_if(accepted) AS samples_accepted, sum(time) AS total_time, sum(cost) AS total_cost,
    coalesce(avg(CASE WHEN accepted THEN quality_score END), 0) AS avg_quality_score, coalesce(avg(CASE WHEN accepted THEN judge_score END), 0) AS avg_llm_judge_score FROM g GROUP BY model)"""


def run_rows(spark, sf_dir) -> DataFrame:
    d = reviews(spark, sf_dir).select("seq", "model", "rating")
    return d.withColumns(
        {
            "accepted": c("seq") % 3 != 0, "time": (c("seq") % 100) / F.lit(10.0), "cost": (c("seq") % 7) * F.lit(0.001),
            "quality_score": F.when(c("seq") % 4 != 0, (c("seq") % 50) / F.lit(53.0)),
            "judge_score": F.when(c("seq") % 6 != 0, (c("seq") % 20) / F.lit(23.0)),
        }
    )


@query(f"""
WITH {RUN_SQL}, {ROLLUP_SQL} SELECT model, samples_generated, CAST(samples_accepted AS BIGINT) AS samples_accepted, round(total_time, 6) AS total_time, round(total_cost, 6) AS total_cost, round(avg_quality_score, 6) AS avg_quality_score, round(avg_llm_judge_score, 6) AS avg_llm_judge_score,
    round(samples_accepted / samples_generated, 6) AS acceptance_rate, round(total_time / samples_generated, 6) AS avg_time_per_sample, round(total_cost / samples_generated, 6) AS cost_per_sample FROM m""")
def model_rollup(spark, sf_dir):
    return metrics.model_rollup(run_rows(spark, sf_dir))


@query(
    f"WITH {RUN_SQL} SELECT count(*) AS total_generated, CAST(count_if(accepted) AS BIGINT) AS total_accepted, CAST(count_if(NOT accepted) AS BIGINT) AS total_rejected, round(sum(cost), 6) AS total_cost, round(sum(time), 6) AS total_time, round(count_if(accepted) / count(*), 6) AS success_rate FROM g"
)
def pipeline_totals(spark, sf_dir):
    return metrics.totals(run_rows(spark, sf_dir))


@query(
    f"WITH {RUN_SQL}, {ROLLUP_SQL} SELECT model, round(total_cost / samples_generated, 6) AS cost_per_sample FROM m WHERE samples_accepted > 0 ORDER BY round(total_cost / samples_generated, 9), model LIMIT 1"
)
def best_model(spark, sf_dir):
    return metrics.best_model(metrics.model_rollup(run_rows(spark, sf_dir)))


@query(
    "SELECT CAST(k AS INT) AS rating, (SELECT count(*) FROM documents WHERE 1 + doc_id % 5 = k) AS n, round(100.0 * (SELECT count(*) FROM documents WHERE 1 + doc_id % 5 = k) / (SELECT count(*) FROM documents), 6) AS pct FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k)"
)
def rating_distribution(spark, sf_dir):
    return metrics.rating_distribution(reviews(spark, sf_dir))


@query(
    "WITH x AS (SELECT r_name AS name, (r_regionkey + 1) / 15.0::DOUBLE AS weight FROM region), t AS (SELECT sum(weight) AS t FROM x) SELECT name, round(weight, 6) AS weight, round(100 * weight / t, 6) AS share_pct, t BETWEEN 0.99 AND 1.01 AS loads, abs(t - 1) < 1e-6 AS exact FROM x, t"
)
def distribution_check(spark, sf_dir):
    return metrics.distribution_check(
        read(spark, sf_dir, "region").select(c("r_name").alias("name"), ((c("r_regionkey") + 1) / F.lit(15.0)).alias("weight"))
    )


@query(
    f"WITH {RUN_SQL} SELECT seq, round(avg(quality_score) OVER (ORDER BY seq), 6) AS avg_quality_score, round(avg(judge_score) OVER (ORDER BY seq), 6) AS avg_judge_score FROM g"
)
def running_means(spark, sf_dir):
    return metrics.running_means(run_rows(spark, sf_dir), "seq", ["quality_score", "judge_score"])


OVERLAP_SQL = f"""
a AS (SELECT conv_id, turn, list_distinct({w('lower(text)')}) AS a FROM conversations),
b AS (SELECT *, list(a) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p FROM a),
o AS (SELECT conv_id, turn, p, list_transform(list_filter(p, lambda x: len(x) > 0 AND len(a) > 0), lambda x: len(list_intersect(a, x)) / len(a)) AS o FROM b),
v AS (SELECT conv_id, turn, CASE WHEN coalesce(len(p), 0) = 0 THEN NULL WHEN len(o) = 0 THEN 0 ELSE list_avg(o) END AS v FROM o)"""


@query(
    f"WITH {OVERLAP_SQL} SELECT conv_id, turn, round(v, 6) AS avg_overlap, round(CASE WHEN v IS NULL THEN 9 ELSE greatest(5, 10 - v * 10) END, 6) AS uniqueness_score FROM v"
)
def last_k_overlap(spark, sf_dir):
    rows = judge.last_overlaps(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn")
    return rows.select("conv_id", "turn", "avg_overlap", judge.uniqueness_fallback(c("avg_overlap")).alias("uniqueness_score"))


@query(
    "SELECT event_id, coalesce(event_type = lag(event_type, 1) OVER w AND event_type = lag(event_type, 2) OVER w, false) AS stuck FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
)
def three_identical(spark, sf_dir):
    return windows.three_identical(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "stuck")


@query(
    "SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) >= 2 AS tripped FROM events"
)
def two_of_three(spark, sf_dir):
    return windows.two_of_three(
        read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], c("event_type") == "error"
    ).select("event_id", "tripped")


@query("""
WITH g AS (SELECT *, event_type IN ('error', 'click') AS f, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT event_id, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS run_length, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) >= 3 AS stopped FROM g""")
def failure_runs(spark, sf_dir):
    return windows.failure_runs(
        read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], c("event_type").isin("error", "click"), 3
    ).select("event_id", "run_length", "stopped")


@query("""
WITH s AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, length(props) AS a FROM events)
SELECT event_id, count(*) OVER w AS requests, CAST(sum(a) OVER w AS BIGINT) AS amount_in_window FROM s WINDOW w AS (ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def rate_window_60s(spark, sf_dir):
    return windows.rate_window(
        read(spark, sf_dir, "events"), "ts", F.length("props").cast("long")
    ).select("event_id", "requests", "amount_in_window")


@query(
    "SELECT user_id, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS window_start_s, count(*) AS failures, count(*) >= 3 AS tripped FROM events WHERE event_type = 'error' GROUP BY 1, 2"
)
def breaker_windows(spark, sf_dir):
    rows = windows.breaker_windows(read(spark, sf_dir, "events"), ["user_id"], "ts", c("event_type") == "error")
    return rows.select("user_id", F.unix_seconds("window_start").alias("window_start_s"), "failures", "tripped")


@query("""
WITH RECURSIVE f AS (SELECT user_id AS k, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'error') AS i FROM events),
s AS (SELECT k, i, ts, ts AS since, bad::BIGINT AS n FROM f WHERE i = 1 UNION ALL
    SELECT f.k, f.i, f.ts, CASE WHEN epoch_us(f.ts) - epoch_us(s.since) > 259200000000 THEN f.ts ELSE s.since END, CASE WHEN epoch_us(f.ts) - epoch_us(s.since) > 259200000000 THEN 0 ELSE s.n END + f.bad::BIGINT FROM s JOIN f ON s.k = f.k AND f.i = s.i + 1)
SELECT CAST(k AS VARCHAR) AS key, CAST(epoch_us(ts) AS BIGINT) AS ts_us, n AS failures_so_far, n >= 3 AS active FROM s""")
def breaker_on_access(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", (c("event_type") == "error").alias("failed"))
    rows = breaker.batch(e, "user_id", "ts", "failed", seconds=3 * 86400)  # users' events are days apart, not seconds
    return rows.select("key", F.unix_micros("ts").alias("ts_us"), "failures_so_far", "active")


JUDGE_SAID = "CASE WHEN doc_id % 3 = 0 THEN 'PASS' ELSE 'FAIL' END"


@query(f"""
WITH s AS (SELECT doc_id, text, doc_id % 8 AS m, ((doc_id % 10) || '.5')::DOUBLE AS sc, {JUDGE_SAID} AS de FROM documents),
v AS (SELECT *, regexp_extract(text, '"([^"]+)"', 1) AS inner_quote, {hits('lower(text)', judge.PASS_WORDS)} > {hits('lower(text)', judge.FAIL_WORDS)} AS good FROM s)
SELECT doc_id AS seq, CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 0 ELSE 5 END AS parse_strategy,
    CASE WHEN m <= 4 THEN sc WHEN m = 5 THEN CASE WHEN good THEN 7 ELSE 4 END WHEN m = 6 THEN 0 ELSE 7 END::DOUBLE AS score,
    CASE WHEN m = 6 THEN 'FAIL' WHEN m = 5 THEN CASE WHEN good THEN 'PASS' ELSE 'FAIL' END ELSE de END AS decision,
    CASE WHEN m <= 3 THEN text WHEN m IN (4, 7) THEN CASE WHEN text <> '' THEN nullif(regexp_extract(text || '"', '^([^"]+)"', 1), '') END
        WHEN m = 5 THEN substr(regexp_replace(regexp_replace('A word: ' || text, '^[\\s\\x0b\\x1c-\\x1f]+', ''), '[\\s\\x0b\\x1c-\\x1f]+$', ''), 1, 200) ELSE 'Evaluation failed: empty response' END AS feedback, m = 6 AS parsing_failed FROM v""")
def judge_parse(spark, sf_dir):
    """Replies of eight forms, whose feedback is a document's whole text."""
    d = reviews(spark, sf_dir).select(c("seq").alias("doc_id"), "text")
    sc, de = F.concat((c("doc_id") % 10).cast("string"), F.lit(".5")), F.when(c("doc_id") % 3 == 0, "PASS").otherwise("FAIL")
    body = F.to_json(F.struct(sc.cast("double").alias("authenticity_score"), de.alias("decision"), c("text").alias("feedback")))
    plain = F.concat(F.lit('feedback: "'), c("text"), F.lit('"'))
    m = c("doc_id") % 8
    text = (
        F.when(m == 0, body).when(m == 1, F.concat(F.lit("Here: ```json\n"), body, F.lit("\n``` done"))).when(m == 2, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(m == 3, F.concat(F.lit("Result: "), body, F.lit(" end")))
        .when(m == 4, F.concat(F.lit("authenticity_score: "), sc, F.lit(", decision: "), F.lower(de), F.lit(", "), plain)).when(m == 5, F.concat(F.lit("A word: "), c("text")))
        .when(m == 6, "").otherwise(F.concat(F.lit("Decision: "), de, F.lit("; "), plain))
    )
    rows = judge.parse(d.withColumns({"criterion": F.lit("authenticity"), "reply": text}))
    return rows.select(
        c("doc_id").alias("seq"), F.coalesce("parse_strategy", F.lit(0)).alias("parse_strategy"), "score", "decision", "feedback",
        "parsing_failed",
    )


@query(f"""
WITH {BASE}, x AS (SELECT seq, rating, lower(text) AS l, len({w('text')}) AS n, len(list_filter(string_split(text, '.'), lambda s: length(regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '')) > 10)) AS k FROM r),
h AS (SELECT *, {hits('l', judge.SPECIFIC)} AS sp, {hits('l', judge.BALANCE)} AS ba, {hits('l', judge.FALLBACK_POSITIVE)} AS po, {hits('l', judge.FALLBACK_NEGATIVE)} AS ne, {hits('l', judge.FALLBACK_TECHNICAL)} AS te FROM x)
SELECT seq, round((least(9, 5 + n / 25) + least(9, 4 + sp) + CASE WHEN ba > 0 THEN 8 ELSE 6 END + 7 + least(9, 5 + k / 2)) / 5, 6) AS authenticity_score,
    CASE WHEN rating >= 4 AND po > ne THEN least(9, 6 + po) WHEN rating <= 2 AND ne > po THEN least(9, 6 + ne) WHEN rating = 3 THEN 7 ELSE 5 END::DOUBLE AS alignment_score, round(least(9, 5 + te * 0.5), 6)::DOUBLE AS expertise_score FROM h""")
def judge_fallbacks(spark, sf_dir):
    t = c("text")
    return reviews(spark, sf_dir).select(
        "seq", judge.authenticity_fallback(t)["authenticity_score"].alias("authenticity_score"),
        judge.alignment_fallback(t, c("rating")).alias("alignment_score"),
        judge.expertise_fallback(t)["expertise_score"].alias("expertise_score"),
    )


JUDGED_SQL = """j AS (SELECT doc_id AS seq, i, ['authenticity', 'alignment', 'expertise', 'uniqueness'][i] AS criterion, CASE WHEN (doc_id + i) % 9 = 0 THEN 'n/a' ELSE CAST((doc_id * i) % 11 AS VARCHAR) END AS score,
    CASE WHEN (doc_id + i) % 4 > 0 THEN 'PASS' ELSE 'FAIL' END AS decision, (doc_id + i) % 11 = 0 AS parsing_failed, (doc_id + i) % 5 = 0 AS fallback, (doc_id + i) % 5 <> 0 AS llm_success FROM documents, (SELECT unnest([1, 2, 3, 4]) AS i))"""


def judged(spark, sf_dir) -> DataFrame:
    d = reviews(spark, sf_dir).select("seq", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"))
    n = c("seq") + c("i")
    names = F.array(*[F.lit(x) for x in judge.CRITERIA])
    return d.withColumns(
        {
            "criterion": F.element_at(names, c("i")),
            "score": F.when(n % 9 == 0, "n/a").otherwise(((c("seq") * c("i")) % 11).cast("string")),
            "decision": F.when(n % 4 > 0, "PASS").otherwise("FAIL"), "parsing_failed": n % 11 == 0, "fallback": n % 5 == 0,
            "llm_success": n % 5 != 0, "feedback": F.concat(F.lit("note "), c("i").cast("string")),
        }
    )


@query(f"""
WITH {JUDGED_SQL}, v AS (SELECT seq, coalesce(avg(TRY_CAST(score AS DOUBLE) / 10), 0.5) AS overall_score, coalesce(bool_and(CASE WHEN NOT parsing_failed THEN decision = 'PASS' END), true) AS all_passed, CAST(count_if(parsing_failed) AS BIGINT) AS errors_count, CAST(count_if(fallback) AS BIGINT) AS fallback_count, CAST(count_if(llm_success) AS BIGINT) AS llm_success_count,
    string_agg(criterion || '=' || coalesce(round(TRY_CAST(score AS DOUBLE) / 10, 1), 0.5)::DOUBLE, ',' ORDER BY criterion) AS dimensions FROM j GROUP BY seq)
SELECT seq, round(overall_score, 6) AS overall_score, dimensions, all_passed, errors_count, fallback_count, llm_success_count, CASE WHEN all_passed AND overall_score >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS final_decision FROM v""")
def judge_overall(spark, sf_dir):
    v = judge.verdicts(judged(spark, sf_dir), ["seq"])
    dims = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("dimension_scores")),
            lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 1).cast("string")),
        ),
        ",",
    )
    return v.select(
        "seq", "overall_score", dims.alias("dimensions"), "all_passed", "errors_count", "fallback_count", "llm_success_count",
        "final_decision",
    )


@query("""
WITH p AS (SELECT doc_id AS seq, c, CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS p, CASE WHEN (CASE c WHEN 'authenticity' THEN 1 - toxic ELSE toxic END) = 1 THEN 'PASS' ELSE 'FAIL' END AS s FROM labels, (SELECT unnest(['authenticity', 'alignment']) AS c))
SELECT seq, round(avg((p = s)::INT), 6) AS agreement_rate, CAST(count_if(p = s) AS BIGINT) AS agreed_count, count(*) AS total_comparisons FROM p GROUP BY seq""")
def judge_consensus(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select(
        c("doc_id").alias("seq"), "quality", "toxic", F.explode(F.array(F.lit("authenticity"), F.lit("alignment"))).alias("criterion")
    )
    say = lambda x: F.when(x == 1, "PASS").otherwise("FAIL")
    first = rows.select("seq", "criterion", say(c("quality")).alias("decision"))
    second = rows.select(
        "seq", "criterion", say(F.when(c("criterion") == "authenticity", 1 - c("toxic")).otherwise(c("toxic"))).alias("decision")
    )
    return judge.consensus(first, second, ["seq"])


@query(
    f"WITH {JUDGED_SQL} SELECT seq, string_agg(upper(criterion[1]) || criterion[2:] || ' [' || decision || ']' || CASE WHEN fallback THEN ' [FALLBACK]' ELSE '' END || ': note ' || i, ' | ' ORDER BY i) AS feedback FROM j GROUP BY seq"
)
def judge_feedback(spark, sf_dir):
    return judge.joined_feedback(judged(spark, sf_dir), ["seq"])


@query(f"""
WITH {JUDGED_SQL}, v AS (SELECT seq, coalesce(avg(TRY_CAST(score AS DOUBLE) / 10), 0.5) AS o, coalesce(bool_and(CASE WHEN NOT parsing_failed THEN decision = 'PASS' END), true) AS ok, count_if(parsing_failed) AS e,
    string_agg(CASE WHEN coalesce(TRY_CAST(score AS DOUBLE) / 10, 0.5) < 0.6 THEN criterion || format('({{:.1f}}): ', coalesce(TRY_CAST(score AS DOUBLE) / 10, 0.5)) || 'note ' || i END, ' | ' ORDER BY criterion) AS d,
    string_agg(upper(criterion[1]) || criterion[2:] || ' [' || decision || ']' || CASE WHEN fallback THEN ' [FALLBACK]' ELSE '' END || ': note ' || i, ' | ' ORDER BY i) AS f FROM j GROUP BY seq)
SELECT seq, CASE WHEN e >= 3 THEN format('LLM Judge evaluation failed ({{}} errors) - possible API issue', e) WHEN ok AND o >= 0.6 THEN '' ELSE 'Failed LLM Judge: ' || coalesce(d, f) || CASE WHEN o < 0.7 THEN format('; LLM Judge score too low: {{:.2f}} (min: 0.7)', o) ELSE '' END END AS reasons FROM v""")
def judge_gate(spark, sf_dir):
    rows = judged(spark, sf_dir)
    v = judge.verdicts(rows, ["seq"]).join(judge.joined_feedback(rows, ["seq"]), "seq").join(
        rows.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("criterion", "feedback"))).alias("dimension_feedback")), "seq"
    )
    v = v.withColumn("dimension_scores", F.map_from_entries(F.array_sort(F.map_entries("dimension_scores"))))
    return judge.gate(v, 0.7).select("seq", F.array_join("judge_reasons", "; ").alias("reasons"))


@query("""
WITH RECURSIVE f AS (SELECT lang, doc_id % 4 <> 0 AS ok, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
s AS (SELECT lang, 0::BIGINT AS i, 0::DOUBLE AS rate FROM (SELECT DISTINCT lang FROM documents) UNION ALL SELECT s.lang, f.i, CASE WHEN f.ok THEN (floor(s.rate * (f.i - 1)) + 1) / f.i ELSE s.rate END FROM s JOIN f ON s.lang = f.lang AND f.i = s.i + 1)
SELECT a.lang AS session, round(arg_max(a.rate, a.i), 6) AS rate_parity, round((SELECT avg((doc_id % 4 <> 0)::INT) FROM documents d WHERE d.lang = a.lang), 6) AS rate FROM s a GROUP BY a.lang""")
def pass_rate_fold(spark, sf_dir):
    return metrics.pass_rate_parity(reviews(spark, sf_dir).withColumn("ok", c("seq") % 4 != 0), "session", "seq", "ok")


def price_sql(model: str, prices: dict, default: tuple, side: int) -> str:
    return f"CASE {model} " + " ".join(
        f"WHEN '{k}' THEN {v[side]}::DOUBLE" for k, v in prices.items()
    ) + f" ELSE {default[side]}::DOUBLE END"


COST_MODELS = ("gpt-4", "gpt-4o-mini", "gemini-pro", "gemini-2.0-flash-exp", "other", "llama:free")
COST_PROVIDERS = ("openai", "gemini", "groq", "openrouter", "local")


@query(f"""
WITH x AS (SELECT doc_id AS seq, {list(COST_PROVIDERS)}[doc_id % 5 + 1] AS p, {list(COST_MODELS)}[doc_id % 6 + 1] AS m, n_chars::DOUBLE AS i, (n_chars // 2)::DOUBLE AS o, doc_id % 2 = 0 AS b FROM documents)
SELECT seq, round(CASE p WHEN 'openai' THEN (i / 1000 * {price_sql('m', metrics.PER_THOUSAND, metrics.PER_THOUSAND_DEFAULT, 0)} + o / 1000 * {price_sql('m', metrics.PER_THOUSAND, metrics.PER_THOUSAND_DEFAULT, 1)}) * CASE WHEN b THEN 0.5 ELSE 1 END
    WHEN 'gemini' THEN i / 1000000 * {price_sql('m', metrics.PER_MILLION, metrics.PER_MILLION_DEFAULT, 0)} + o / 1000000 * {price_sql('m', metrics.PER_MILLION, metrics.PER_MILLION_DEFAULT, 1)} WHEN 'groq' THEN (i + o) * 1e-7
    WHEN 'openrouter' THEN CASE WHEN contains(m, ':free') THEN 0 ELSE (i * 0.0001 + o * 0.0003) / 1000 END ELSE 0 END::DOUBLE * 1000, 6) AS cost_thousandths FROM x""")
def cost_model(spark, sf_dir):
    pick = lambda options, n: F.element_at(F.array(*[F.lit(o) for o in options]), (c("doc_id") % n + 1).cast("int"))
    d = read(spark, sf_dir, "documents")
    paid = metrics.cost(
        pick(COST_PROVIDERS, 5), pick(COST_MODELS, 6), c("n_chars").cast("double"), F.floor(c("n_chars") / 2).cast("double"),
        c("doc_id") % 2 == 0,
    )
    return d.select(c("doc_id").alias("seq"), (paid.cast("double") * 1000).alias("cost_thousandths"))


@query("""
SELECT 'csv' AS source, CASE WHEN doc_id % 3 = 0 THEN 'csv' ELSE source END AS platform, CAST(doc_id AS VARCHAR) AS review_id, CASE WHEN doc_id % 4 = 0 THEN 'review: ' || text ELSE text END AS body,
    CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 + doc_id % 5 END::DOUBLE AS rating, lang AS author, 'tool' || doc_id % 7 AS product, '' AS url, source AS extra FROM documents""")
def normalise_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    raw = d.select(
        c("doc_id").cast("string").alias("id"), F.when(c("doc_id") % 3 == 0, "").otherwise(c("source")).alias("platform"),
        F.when(c("doc_id") % 4 == 0, "").otherwise(c("text")).alias("body"), F.concat(F.lit("review: "), c("text")).alias("review_text"),
        F.when(c("doc_id") % 5 != 0, (c("doc_id") % 5 + 1).cast("string")).alias("rating"), c("lang").alias("user"),
        F.concat(F.lit("tool"), (c("doc_id") % 7).cast("string")).alias("tool"), c("source").alias("extra"),
    )
    return io.normalise(raw, "csv").select(
        "source", "platform", "review_id", "body", "rating", "author", "product", "url", c("metadata")["extra"].alias("extra")
    )


def unit_sql(key: str, salt: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}/{salt}/' || {key}), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE)"


def choose_sql(key: str, salt: str, options: Sequence[str]) -> str:
    return f"[{', '.join(map(quoted, options))}][CAST(floor({unit_sql(key, salt)} * {len(options)}) AS INT) + 1]"


def weighted_sql(key: str, salt: str, options) -> str:
    total, so_far, out = float(sum(x for _, x in options)), 0.0, "CASE"
    for value, x in options[:-1]:
        so_far += x
        out += f" WHEN {unit_sql(key, salt)} < {so_far / total!r}::DOUBLE THEN {quoted(value) if isinstance(value, str) else value}"
    return f"{out} ELSE {quoted(options[-1][0]) if isinstance(options[-1][0], str) else options[-1][0]} END"


PERSONAS = (("a team lead", 0.5), ("a solo developer", 0.3), ("an analyst", 0.2))
RATINGS = (0.05, 0.10, 0.20, 0.35, 0.30)
MODELS = (("offline/a", 0.7), ("offline/b", 0.3))


@query(
    f"SELECT doc_id AS seq, {weighted_sql('doc_id', 'persona', PERSONAS)} AS persona, CAST({weighted_sql('doc_id', 'rating', list(enumerate(RATINGS, 1)))} AS INT) AS rating, {weighted_sql('doc_id', 'model', MODELS)} AS model_key FROM documents"
)
def weighted_assignment(spark, sf_dir):
    return generate.specs(
        reviews(spark, sf_dir).select("seq"), "seq", PERSONAS, RATINGS, MODELS
    ).select("seq", "persona", "rating", "model_key")


FOCUS_SQL = "list_slice(list_transform(list_sort([" + ", ".join(
    f"{{'u': {unit_sql('doc_id', f'focus{i}')}, 'o': {quoted(o)}}}" for i, o in enumerate(generate.FOCUS_AREAS)
) + "]), lambda x: x.o), 1, 3)"
SPEC_SQL = f"""
p AS (SELECT doc_id AS seq, doc_id % 3 AS retry, CASE doc_id % 4 WHEN 0 THEN 'needs technical detail' WHEN 1 THEN 'be more unique' WHEN 2 THEN 'not authentic' END AS feedback,
    {weighted_sql('doc_id', 'persona', PERSONAS)} AS persona, CAST({weighted_sql('doc_id', 'rating', list(enumerate(RATINGS, 1)))} AS INT) AS rating, {choose_sql('doc_id', 'tone', generate.TONES)} AS tone, {choose_sql('doc_id', 'style', generate.STYLES)} AS style, {choose_sql('doc_id', 'scenario', generate.SCENARIOS)} AS scenario,
    {choose_sql('doc_id', 'job', generate.JOBS)} AS job, {choose_sql('doc_id', 'company', generate.COMPANY_TYPES)} AS company, {choose_sql('doc_id', 'use', generate.USE_CASES)} AS usecase, array_to_string({FOCUS_SQL}, ', ') AS focus,
    array_to_string([{', '.join(choose_sql('doc_id', f'word{i}', generate.SEED_WORDS) for i in range(5))}], ', ') AS seeds,
    CAST(floor({unit_sql('doc_id', 'least')} * 51) + 50 AS INT) AS lo, CAST(floor({unit_sql('doc_id', 'most')} * 351) + 150 AS INT) AS hi FROM documents)"""


def spec_rows(spark, sf_dir) -> DataFrame:
    m = c("seq") % 4
    return generate.specs(reviews(spark, sf_dir).select("seq"), "seq", PERSONAS, RATINGS, MODELS).withColumns(
        {
            "retry": c("seq") % 3,
            "feedback": F.when(m == 0, "needs technical detail").when(m == 1, "be more unique").when(m == 2, "not authentic"),
        }
    )


@query(
    f"WITH {SPEC_SQL} SELECT seq, tone, style, scenario, job AS random_job, company AS random_company_type, focus AS focus_areas, seeds AS seed_words, lo AS min_words, hi AS max_words FROM p"
)
def random_specs(spark, sf_dir):
    return spec_rows(spark, sf_dir).select(
        "seq", "tone", "style", "scenario", "random_job", "random_company_type", F.array_join("focus_areas", ", ").alias("focus_areas"),
        F.array_join(F.slice("seed_words", 1, 5), ", ").alias("seed_words"), "min_words", "max_words",
    )


_G = " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in generate.GUIDANCE.items())


@query(f"""
WITH {SPEC_SQL} SELECT seq, 'Write an authentic SaaS review as ' || persona || '.' || chr(10) || 'Role: ' || job || '; company: ' || company || '; use: ' || usecase || '.' || chr(10) || 'Rating: ' || rating || '/5, ' || CASE rating {_G} END || '.' || chr(10)
    || 'Tone: ' || tone || '; style: ' || style || '; scenario: ' || scenario || '; focus: ' || focus || '.' || chr(10) || 'Work in these words: ' || seeds || '.' || CASE WHEN rating >= 4 THEN {quoted(generate.POSITIVE_BLOCK)} WHEN rating <= 2 THEN {quoted(generate.NEGATIVE_BLOCK)} ELSE {quoted(generate.NEUTRAL_BLOCK)} END || {quoted(generate.TECHNICAL_BLOCK)}
    || CASE WHEN coalesce(feedback, '') <> '' AND retry > 0 THEN {quoted(generate.FEEDBACK_BLOCK)} || feedback ELSE '' END AS system_prompt,
    'Write a ' || rating || '-star review of ' || lo || ' to ' || hi || ' words.' || CASE seq % 4 WHEN 0 THEN chr(10) || chr(10) || 'Stress: specific technical detail.' WHEN 1 THEN chr(10) || chr(10) || 'Stress: other examples and structure.' WHEN 2 THEN chr(10) || chr(10) || 'Stress: personal experience.' ELSE '' END AS user_prompt,
    round(least(1.0 + 0.1 * retry, 1.5), 6)::DOUBLE AS temperature FROM p""")
def prompt_render(spark, sf_dir):
    return spec_rows(spark, sf_dir).select(
        "seq", generate.system_prompt(F.lit("SaaS")).alias("system_prompt"), generate.user_prompt().alias("user_prompt"),
        generate.retry_temperature(c("retry")).alias("temperature"),
    )


@query("""
SELECT doc_id AS seq, CASE WHEN doc_id % 4 >= 2 THEN text END AS text, CASE WHEN doc_id % 4 < 2 THEN 0 ELSE n_chars / 1000.0 * 0.03 * 0.5 + 100 / 1000.0 * 0.06 * 0.5 END::DOUBLE AS cost0,
    doc_id % 4 >= 2 AS success, CASE doc_id % 4 WHEN 0 THEN 'Result not found in batch output' WHEN 1 THEN 'overloaded' END AS error FROM documents""".replace("n_chars / 1000.0 * 0.03 * 0.5 + 100 / 1000.0 * 0.06 * 0.5", "round((n_chars / 1000.0::DOUBLE * 0.03::DOUBLE + 0.1::DOUBLE * 0.06::DOUBLE) * 0.5::DOUBLE, 6)").replace("cost0", "cost"))
def batch_result_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    requests = d.select(c("doc_id").alias("seq"), F.concat(F.lit("request-"), c("doc_id").cast("string")).alias("custom_id"))
    m = c("doc_id") % 4
    results = d.filter(m != 0).select(
        F.concat(F.lit("request-"), c("doc_id").cast("string")).alias("custom_id"), F.when(m == 1, 503).otherwise(200).alias("status_code"),
        c("text").alias("content"), c("n_chars").alias("prompt_tokens"), F.lit(100).cast("long").alias("completion_tokens"),
        F.when(m == 1, "overloaded").alias("error"),
    )
    return metrics.batch_results(requests, results, "gpt-4").select("seq", "text", "cost", "success", "error")


def stripped_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[\s\x0b\x1c-\x1f]+', ''), '[\s\x0b\x1c-\x1f]+$', '')"


@query(f"""
WITH a AS (SELECT doc_id AS seq, {stripped_sql("CASE doc_id % 4 WHEN 0 THEN '  ' || text || chr(10) WHEN 1 THEN chr(34) || ' ' || text || ' ' || chr(34) WHEN 2 THEN '```text' || chr(10) || text || chr(10) || '```' ELSE text END")} AS t FROM documents),
b AS (SELECT seq, CASE WHEN (starts_with(t, '"') AND ends_with(t, '"')) OR (starts_with(t, chr(39)) AND ends_with(t, chr(39))) THEN CASE WHEN length(t) > 1 THEN {stripped_sql('substr(t, 2, length(t) - 2)')} ELSE '' END ELSE t END AS t FROM a),
l AS (SELECT seq, t, string_split(t, chr(10)) AS l FROM b)
SELECT seq, CASE WHEN starts_with(t, '```') AND ends_with(t, '```') AND len(l) > 2 THEN {stripped_sql('array_to_string(l[2:len(l) - 1], chr(10))')} ELSE t END AS cleaned FROM l""")
def clean_text(spark, sf_dir):
    """Whole texts in blanks, quotes and code blocks, or as they are."""
    t, m = c("text"), c("seq") % 4
    raw = F.when(m == 0, F.concat(F.lit("  "), t, F.lit("\n"))).when(m == 1, F.concat(F.lit('" '), t, F.lit(' "'))).when(
        m == 2, F.concat(F.lit("```text\n"), t, F.lit("\n```"))
    ).otherwise(t)
    return reviews(spark, sf_dir).select("seq", T.clean_generated(raw).alias("cleaned"))


@query(
    "SELECT doc_id AS seq, round(CASE doc_id % 4 WHEN 0 THEN (doc_id + 1000) / 1000.0 + 0.5 WHEN 1 THEN doc_id % 60 + 0.25 + 0.5 ELSE power(2, doc_id % 3) END::DOUBLE, 6) AS wait_seconds FROM documents"
)
def rate_limit_wait(spark, sf_dir):
    m = c("seq") % 4
    said = F.when(
        m == 0, F.concat(F.lit("Rate limit. Please try again in "), F.format_number(c("seq") + 1000, 0), F.lit("ms. Thanks"))
    ).when(m == 1, F.concat(F.lit("Please try again in "), (c("seq") % 60).cast("string"), F.lit(".25s. Bye"))).when(m == 2, "Please try again in a while").otherwise("busy")
    return reviews(spark, sf_dir).select("seq", T.wait_seconds(said, c("seq") % 3).alias("wait_seconds"))


@query(
    f"WITH {GATES_SQL} SELECT seq, CASE WHEN seq % 3 > 0 THEN CASE WHEN seq % 2 = 0 THEN CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ' | ') END ELSE CASE WHEN seq % 5 = 0 THEN NULL ELSE 'judge says' END END END AS feedback FROM x"
)
def retry_feedback(spark, sf_dir):
    said = F.when(c("seq") % 5 == 0, "").otherwise("judge says")
    return gated(spark, sf_dir).select("seq", gates.feedback(c("seq") % 3, c("seq") % 2 == 0, c("reasons"), said).alias("feedback"))


@query()
def prefix_self_bleu(spark, sf_dir):
    from glossmill.operators.prefix_bleu import prefix_diversity

    return prefix_diversity(reviews(spark, sf_dir).withColumn("run", c("session")), "run", "seq")


@query(f"""
WITH {BASE}, t AS (SELECT seq, session || '/' || model AS run, {w('text')} AS a FROM r),
g AS (SELECT run, seq, n, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i+n-1], ' '))) AS g FROM t, (SELECT unnest([1, 2, 3, 4]) AS n)),
k AS (SELECT run, seq, n, g, count(*) AS c FROM g GROUP BY ALL),
p AS (SELECT x.run, x.seq AS i, y.seq AS j, x.n, x.g, least(x.c, y.c) AS v FROM k x JOIN k y ON x.run = y.run AND x.n = y.n AND x.g = y.g AND x.seq <> y.seq),
m AS (SELECT run, i, t, n, sum(v) AS m FROM (SELECT p.run, i, t.seq AS t, n, g, max(v) AS v FROM p JOIN t ON t.run = p.run AND t.seq >= i AND t.seq >= j GROUP BY ALL) GROUP BY ALL),
f AS (SELECT x.run, x.seq AS i, z.seq AS t, len(x.a) AS len, arg_min(len(y.a), abs(len(y.a) - len(x.a)) * 1000000 + len(y.a)) AS ref FROM t x JOIN t y ON x.run = y.run AND x.seq <> y.seq JOIN t z ON z.run = x.run AND z.seq >= x.seq AND z.seq >= y.seq GROUP BY ALL),
b AS (SELECT f.run, f.i, f.t, CASE WHEN max(CASE WHEN q.n = 1 THEN coalesce(m, 0) END) = 0 THEN 0 ELSE CASE WHEN max(len) > max(ref) THEN 1 ELSE exp(1 - max(ref) / max(len)) END
    * exp(sum(0.25 * ln(CASE WHEN coalesce(m, 0) = 0 THEN 0.1 ELSE m END / greatest(len - q.n + 1, 1)))) END AS bleu FROM f CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) q LEFT JOIN m ON m.run = f.run AND m.i = f.i AND m.t = f.t AND m.n = q.n GROUP BY f.run, f.i, f.t)
SELECT t.run, t.seq, round(coalesce(1 - x.bleu, 1), 6) AS self_bleu_diversity FROM t LEFT JOIN (SELECT run, t, avg(bleu) AS bleu FROM b GROUP BY run, t) x ON x.run = t.run AND x.t = t.seq""")
def prefix_self_bleu_by_model(spark, sf_dir):
    """The series of each model in each session; its SQL lays every text beside every other of its run so far."""
    from glossmill.operators.prefix_bleu import prefix_diversity

    rows = reviews(spark, sf_dir).withColumn("run", F.concat_ws("/", "session", "model"))
    return prefix_diversity(rows, "run", "seq")


@query("""
SELECT x.vec_id, round(max(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))), 6) AS max_similarity FROM embeddings x LEFT JOIN embeddings y ON y.vec_id < x.vec_id GROUP BY x.vec_id""")
def prefix_max_similarity(spark, sf_dir):
    return diversity.max_similarity_before(read(spark, sf_dir, "embeddings"))


@query(f"""
WITH m AS (SELECT x.vec_id, max(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS m FROM embeddings x LEFT JOIN embeddings y ON y.vec_id < x.vec_id GROUP BY x.vec_id),
u AS (SELECT doc_id AS seq, len(list_distinct({w('lower(text)')})) AS u, m FROM documents LEFT JOIN m ON vec_id = doc_id),
z AS (SELECT *, CASE WHEN m > 0.3 THEN format('Too similar to previous reviews: {{:.2f}} > 0.3', m) WHEN u < 50 THEN format('Insufficient unique words: {{}} < 50', u) END AS reason FROM u)
SELECT seq, CAST(u AS BIGINT) AS n_unique, round(m, 6) AS max_similarity, reason, reason IS NULL AS passed FROM z""")
def history_check(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(c("vec_id").alias("seq"), "embedding")
    return diversity.history_check(reviews(spark, sf_dir), vectors, max_similarity=0.3)


@query(f"""
WITH {BASE}, {OVERALL_SQL}, n AS (SELECT count(*) AS n, {', '.join(f'count_if(rating = {k}) AS n{k}' for k in range(1, 6))} FROM r), x AS (SELECT n, {' + '.join(f'(n{k} - n * {p}::DOUBLE) * (n{k} - n * {p}::DOUBLE) / (n * {p}::DOUBLE)' for k, p in enumerate(RATINGS, 1))} AS chi2 FROM n)
SELECT n AS dataset_size, round(chi2, 6) AS chi2, chi2 > 9.488 AS is_biased, overall_score, chi2 <= 9.488 AND overall_score > 0.6 AS passed FROM x, overall""")
def dataset_validation(spark, sf_dir):
    rows = diversity.validate_dataset(reviews(spark, sf_dir), read(spark, sf_dir, "embeddings"), dict(enumerate(RATINGS, 1)))
    return rows.select("dataset_size", "chi2", "is_biased", "overall_score", "passed")


def said_sql(criterion: str) -> str:
    """The prompt that a judge gets, and what the judge of rules says to it: the first bytes of the prompt's SHA-256."""
    earlier = f"CASE WHEN len(b) > 0 THEN chr(10) || 'Earlier texts:' || chr(10) || array_to_string(list_transform(b, lambda x: substr(x, 1, {judging.SHOWN_BEFORE})), chr(10)) ELSE '' END"
    middle = {"uniqueness": earlier, "expertise": "chr(10) || 'Domain: saas; role: a team lead'"}.get(criterion, "''")
    return f"""SELECT seq, '{criterion}' AS criterion, {judge.CRITERIA.index(criterion)} AS o, {criterion[0]} AS stand_in, {'5.5' if criterion == 'expertise' else '6.0'}::DOUBLE AS least,
        sha256('Criterion: {criterion}' || chr(10) || {quoted(judging.ASK[criterion])} || chr(10) || 'Rating: ' || rating || {middle} || chr(10) || 'Text:' || chr(10) || substr(text, 1, {judging.SHOWN}) || chr(10) || 'Give {criterion}_score (0 to 10), decision (PASS or FAIL) and feedback.') AS h FROM facts"""


FACTS_SQL = f"""
x AS (SELECT *, lower(text) AS l, len({w('text')}) AS n, len(list_filter(string_split(text, '.'), lambda s: length(regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '')) > 10)) AS k, list_distinct({w('lower(text)')}) AS own,
    list(text) OVER (PARTITION BY session, model ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ten FROM r),
y AS (SELECT *, coalesce(ten, [])[1:3] AS b, list(own) OVER (PARTITION BY session, model ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS five,
    {hits('l', judge.SPECIFIC)} AS sp, {hits('l', judge.BALANCE)} AS ba, {hits('l', judge.FALLBACK_POSITIVE)} AS po, {hits('l', judge.FALLBACK_NEGATIVE)} AS ne, {hits('l', judge.FALLBACK_TECHNICAL)} AS te FROM x),
z AS (SELECT *, list_transform(list_filter(five, lambda q: len(q) > 0 AND len(own) > 0), lambda q: len(list_intersect(own, q)) / len(own)) AS shares FROM y),
facts AS (SELECT seq, text, rating, b, (least(9, 5 + n / 25) + least(9, 4 + sp) + CASE WHEN ba > 0 THEN 8 ELSE 6 END + 7 + least(9, 5 + k / 2)) / 5 AS a,
    CASE WHEN rating >= 4 AND po > ne THEN least(9, 6 + po) WHEN rating <= 2 AND ne > po THEN least(9, 6 + ne) WHEN rating = 3 THEN 7 ELSE 5 END::DOUBLE AS al, least(9, 5 + te * 0.5)::DOUBLE AS e,
    CASE WHEN coalesce(len(five), 0) = 0 THEN 9 ELSE greatest(5, 10 - 10 * CASE WHEN len(shares) = 0 THEN 0 ELSE list_avg(shares) END) END::DOUBLE AS u FROM z)"""


@query(f"""
WITH {BASE}, {FACTS_SQL}, p AS ({' UNION ALL '.join(said_sql(k) for k in judge.CRITERIA).replace("'alignment' AS criterion, 1 AS o, a AS", "'alignment' AS criterion, 1 AS o, al AS")}),
v AS (SELECT *, ('0x' || substr(h, 3, 2))::INT % 16 = 0 AS down, 4 + ('0x' || substr(h, 1, 2))::INT % 6 AS given FROM p),
d AS (SELECT *, CASE WHEN down THEN stand_in ELSE given END::DOUBLE AS score, CASE WHEN CASE WHEN down THEN stand_in >= least ELSE given >= 6 END THEN 'PASS' ELSE 'FAIL' END AS decision FROM v),
s AS (SELECT seq, avg(score / 10) AS overall, bool_and(decision = 'PASS') AS every, count_if(down) AS down FROM d GROUP BY seq)
SELECT seq AS review_id, round(overall, 6) AS overall_score, every AS all_passed, 0::BIGINT AS errors_count, CAST(down AS BIGINT) AS fallback_count, CAST(4 - down AS BIGINT) AS llm_success_count, CASE WHEN every AND overall >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS final_decision, 1.0::DOUBLE AS agreement_rate FROM s""")
def judge_evaluation(spark, sf_dir):
    d = judge.last_overlaps(reviews(spark, sf_dir), ["session", "model"], "seq")
    rows = judge.context(d, ["session", "model"], "seq", chars=judging.SHOWN_BEFORE)
    rows = rows.withColumns({"review_id": c("seq"), "persona": F.lit("a team lead"), "domain": F.lit("saas")})
    verdict = judging.evaluate(rows, providers.RuleJudge, providers.RuleJudge)
    return verdict.select(
        "review_id", "overall_score", "all_passed", "errors_count", "fallback_count", "llm_success_count", "final_decision",
        "agreement_rate",
    )


@query("""
WITH RECURSIVE f AS (SELECT user_id AS k, event_id, event_type <> 'view' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS n, false AS fb, NULL::BIGINT AS event_id FROM (SELECT DISTINCT k FROM f) UNION ALL
    SELECT s.k, f.i, CASE WHEN s.n >= 5 OR NOT f.bad THEN 0 ELSE s.n + 1 END, s.n >= 5, f.event_id FROM s JOIN f ON s.k = f.k AND f.i = s.i + 1)
SELECT CAST(k AS VARCHAR) AS key, event_id AS o, n AS failures, fb AS fallback FROM s WHERE i > 0""")
def judge_breaker(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(c("user_id").alias("k"), "event_id", (c("event_type") != "view").alias("failed"))
    return breaker.consecutive(e, "k", "event_id", "failed")


@query(SQL["breaker_on_access"])
def breaker_stream(spark, sf_dir):
    """The breaker as a stream that is stopped half way and goes on from its checkpoint."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", (c("event_type") == "error").alias("failed"))
    rows = breaker.replayed(e, "ts", lambda s: breaker.stream(s, "user_id", "ts", "failed", seconds=3 * 86400))
    return rows.select("key", F.unix_micros("ts").alias("ts_us"), "failures_so_far", "active")


@query("""
WITH RECURSIVE f AS (SELECT user_id AS k, event_id, event_type <> 'view' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) AS us FROM events),
s AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS n, false AS fb, NULL::BIGINT AS us FROM (SELECT DISTINCT k FROM f) UNION ALL
    SELECT s.k, f.i, CASE WHEN s.n >= 5 OR NOT f.bad THEN 0 ELSE s.n + 1 END, s.n >= 5, f.us FROM s JOIN f ON s.k = f.k AND f.i = s.i + 1)
SELECT CAST(k AS VARCHAR) AS key, us AS o, n AS failures, fb AS fallback FROM s WHERE i > 0""")
def judge_breaker_stream(spark, sf_dir):
    """Failures in a row as a stream, the order being that of time, stopped and resumed twice."""
    e = read(spark, sf_dir, "events").select(
        c("user_id").alias("k"), "ts", F.unix_micros(c("ts").cast("timestamp")).alias("o"), (c("event_type") != "view").alias("failed")
    )
    return breaker.replayed(e, "ts", lambda s: breaker.consecutive_stream(s, "k", "o", "failed"), (0.3, 0.7))


@query("""
SELECT CAST(user_id AS VARCHAR) AS key, CAST(epoch_us(ts) AS BIGINT) AS ts_us, count(*) OVER w AS requests, CAST(sum(length(props)) OVER w AS BIGINT) AS amount_in_window
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW)""")
def rate_stream(spark, sf_dir):
    """Calls and amounts of a user in the last half day (users' events are hours apart, not seconds), as a stream."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", F.length("props").alias("amount"))
    rows = breaker.replayed(e, "ts", lambda s: breaker.rate_stream(s, "user_id", "ts", "amount", 43_200))
    return rows.select("key", F.unix_micros("ts").alias("ts_us"), "requests", "amount_in_window")


HASHED_SQL = f"""
h AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {models.DIMENSIONS} AS INT) AS p, count(*) AS n FROM (SELECT doc_id, unnest({w('lower(text)')}) AS t FROM documents) GROUP BY 1, 2),
v AS (SELECT doc_id, list_transform(range({models.DIMENSIONS}), lambda i: coalesce(map_extract(m, i::INT)[1], 0)::DOUBLE) AS v FROM (SELECT doc_id, map(list(p), list(n)) AS m FROM h GROUP BY doc_id))"""


@query(f"WITH {HASHED_SQL} SELECT doc_id, array_to_string(list_transform(v, lambda x: x::BIGINT), ' ') AS embedding FROM v")
def hashed_vectors(spark, sf_dir):
    v = models.hashed_vectors(read(spark, sf_dir, "documents"), ["doc_id"])
    return v.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), " ").alias("embedding"))


@query(f"""
WITH {HASHED_SQL}, cs AS (SELECT list_cosine_similarity(x.v, y.v) AS s FROM v x JOIN v y ON x.doc_id < y.doc_id)
SELECT count(*) AS pairs, round(avg(s), 6) AS avg_similarity, round(stddev_pop(s), 6) AS std_similarity FROM cs""")
def encoded_cosine_moments(spark, sf_dir):
    return diversity.cosine_moments(models.hashed_vectors(read(spark, sf_dir, "documents"), ["doc_id"]))


@query(f"""
WITH {BASE}, {scores_sql(S.LENIENT)}, m AS (SELECT *, {hits('lower(text)', S.LENIENT.positive)} - {hits('lower(text)', S.LENIENT.negative)} AS lead FROM s),
k AS (SELECT *, greatest(1, least(5, 3 + lead)) AS stars, least(0.95, 0.5 + 0.1 * abs(lead))::DOUBLE AS sure FROM m)
SELECT seq, CAST(stars AS INT) AS predicted_stars, round(sure, 6) AS star_confidence, round(sure * CASE abs(stars - rating) WHEN 0 THEN 1 WHEN 1 THEN {S.LENIENT.star_factors[1]} WHEN 2 THEN {S.LENIENT.star_factors[2]} ELSE {S.LENIENT.star_factors[3]} END::DOUBLE, 6) AS alignment_score, 'stars' AS method FROM k""")
def star_model(spark, sf_dir):
    return models.star_sentiment(reviews(spark, sf_dir), models.LexiconStars).select(
        "seq", "predicted_stars", "star_confidence", "alignment_score", "method"
    )


@query(f"""
WITH {BLEU_SQL}, n AS (SELECT doc_id AS seq, len({w('text')}) AS n, len(list_distinct({w('lower(text)')})) AS u FROM documents)
SELECT seq, round(1 - bleu, 6) AS self_bleu_diversity, array_to_string(list_filter([CASE WHEN n < 50 THEN 'Too short' END, CASE WHEN n > 500 THEN 'Too long' END, CASE WHEN u < 20 THEN 'Low vocabulary' END, CASE WHEN 1 - bleu < 0.5 THEN 'Too similar to existing reviews' END], lambda x: x IS NOT NULL), '; ') AS gates FROM b JOIN n USING (seq)""")
def gates_by_self_bleu(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    bleu = diversity.self_bleu_docs(rows).select("seq", (F.lit(1.0) - c("bleu")).alias("self_bleu_diversity"))
    done = gates.check(rows.join(bleu, "seq"), gates.Thresholds(), S.LENIENT, breaker=F.lit(True))
    return done.select(
        "seq", "self_bleu_diversity",
        F.array_join(F.transform("reasons", lambda x: F.regexp_extract(x, r"^([^:(]+?) *[:(]", 1)), "; ").alias("gates"),
    )


from glossmill.plans import round_trips  # noqa: E402, F401  registers its queries
