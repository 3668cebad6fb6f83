"""Sources, sinks, providers, prompts, rounds and the breaker as a stream."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glossmill.operators import gates, generate, metrics
from glossmill.plans import report, rounds
from glossmill.sources import io, providers
from glossmill.streaming import breaker


def test_reviews(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in [{"body": "good", "rating": 5}, {"body": ""}, {"title": "no body"}]))
    assert [r.body for r in io.read_reviews(spark, str(tmp_path / "r.jsonl")).collect()] == ["good", ""]
    assert io.read_reviews(spark, str(tmp_path / "missing.jsonl")).count() == 0


def test_csv_to_reviews(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,platform,body,review_text,rating,user,extra\n1,,"a, ""b""\nc",old,,ann,e1\n2,g2,,old,4.5,,e2\n')
    rows = io.normalise(io.read_review_csv(spark, str(tmp_path / "x.csv")), "csv").orderBy("review_id").collect()
    assert (
        rows[0].platform, rows[0].body, rows[0].rating, rows[0].author, rows[0].metadata
    ) == ("csv", 'a, "b"\nc', 0.0, "ann", {"extra": "e1"})
    assert (rows[1].platform, rows[1].body, rows[1].rating, rows[1].url) == ("g2", "old", 4.5, "")
    io.append_reviews(io.normalise(io.read_review_csv(spark, str(tmp_path / "x.csv")), "csv"), str(tmp_path / "out"))
    io.append_reviews(io.normalise(io.read_review_csv(spark, str(tmp_path / "x.csv")), "csv"), str(tmp_path / "out"))
    assert io.read_reviews(spark, str(tmp_path / "out")).count() == 4


def test_collected_reviews_keep_odd_ids_and_long_texts(spark, tmp_path):
    """Rows of negative ids, blank texts and texts beyond the parser's own bound come back as in the query's SQL; one without an id is there."""
    import duckdb

    from glossmill.plans.queries import QUERIES, SQL

    rows = [(-3, "a", "en", "s"), (-2, "b", "en", "s"), (0, "", "de", "s"), (1, "", "de", "s"), (2, "x" * 20_000_001, "fr", "s"), (3, "c\r\nd", "fr", "s")]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["collected_reviews"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({SQL['collected_reviews']})").fetchall())
    spark.createDataFrame([(None, "a", "en", "s"), *rows[:2]], schema).write.parquet(str(tmp_path / "no-id" / "documents.parquet"))
    assert QUERIES["collected_reviews"](spark, str(tmp_path / "no-id")).count() == 3


def test_template_and_logs(spark, tmp_path):
    io.write_template(spark, str(tmp_path / "t"), "g2")
    assert spark.read.text(str(tmp_path / "t")).first()[0].endswith("url,company_size,industry,role")
    io.append_log(
        spark.createDataFrame([("r1", 2, ["a", "b"])], "review_id string, attempt int, reasons array<string>"), str(tmp_path / "log"), "s1"
    )
    r = io.read_log(spark, "rejections", str(tmp_path / "log")).first()
    assert (r.review_id, r.attempt, r.reasons, r.session_id) == ("r1", 2.0, ["a", "b"], "s1") and r.timestamp is not None
    (tmp_path / "s.log").write_text("2025-12-09 00:17:26,123 - pipe - INFO - it - began\nnoise\n")
    line = io.read_session_log(spark, str(tmp_path / "s.log")).collect()
    assert len(line) == 1 and (line[0].logger, line[0].level, line[0].message) == ("pipe", "INFO", "it - began")


def test_config(tmp_path):
    with pytest.raises(ValueError):
        io.Config(ratings=(0.5, 0.1, 0.1, 0.1, 0.1))
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(
        "generation: {domain: saas, target_samples: 7}\npersonas: [{name: p, weight: 1.0}]\nrating_distribution: {1_star: 0.2, 2_star: 0.2, 3_star: 0.2, 4_star: 0.2, 5_star: 0.2}\nmodels: [{provider: x, name: m, weight: 1.0}]\nquality_thresholds: {min_length: 9}\n"
    )
    c = io.load_config(str(tmp_path / "c.yaml"))
    assert (c.domain, c.target_samples, c.models, c.thresholds) == ("saas", 7, (("x/m", 1.0),), {"min_length": 9})


def test_draws_don_t_depend_on_partitions(spark):
    personas, models = (("a", 0.5), ("b", 0.5)), (("m", 1.0),)
    draw = lambda df: {r.id: tuple(r) for r in generate.specs(df, "id", personas, (0.2,) * 5, models).collect()}
    one = draw(spark.range(3000).coalesce(1))
    assert one == draw(spark.range(3000).repartition(7))
    ratings = [r[2] for r in one.values()]
    assert all(abs(ratings.count(k) / 3000 - 0.2) < 0.03 for k in range(1, 6))


def test_retries():
    class Flaky:
        def __init__(self):
            self.n = 0

        def generate(self, *a, **k):
            self.n += 1
            if self.n == 1:
                return {"success": False, "error": "Please try again in 1,200ms."}
            if self.n == 2:
                raise RuntimeError("boom")
            return {"success": True, "text": "fine", "time": 0, "cost": 0}

    waits = []
    r = providers.Retrying(Flaky(), 3, waits.append).generate("s", "u")
    assert r["success"] and waits == [1.7, 2.0]
    assert not providers.Retrying(Flaky(), 1, waits.append).generate("s", "u")["success"]
    with pytest.raises(KeyError):
        providers.make("nope")


def test_rounds_end_and_respect_attempts(spark):
    c = io.Config(domain="saas", target_samples=40)
    t = gates.Thresholds(min_length=110, max_length=400, max_self_bleu=0.99, max_regeneration_attempts=2)
    done = rounds.run(spark, c, providers.TemplateProvider, t).collect()
    assert sorted(r.seq for r in done) == list(range(1, 41))
    assert all(r.attempt <= 3 and r.decision in ("accept", "reject") for r in done) and {r.decision for r in done} == {"accept", "reject"}
    assert all(not r.reasons for r in done if r.decision == "accept" and r.attempt == 1)


def test_waves_fill_the_target_or_give_up(spark):
    c = io.Config(domain="saas", target_samples=30)
    some = gates.Thresholds(min_length=110, max_length=400, max_self_bleu=0.99, max_regeneration_attempts=0)
    done = rounds.fill(spark, c, providers.TemplateProvider, some).collect()
    assert sum(r.decision == "accept" for r in done) == 30 and len(done) > 30 and len({r.seq for r in done}) == len(done)
    none = gates.Thresholds(min_length=10_000, max_length=20_000, max_regeneration_attempts=0)
    assert {r.decision for r in rounds.fill(spark, c, providers.TemplateProvider, none).collect()} == {"reject"}


def test_dataset_and_metrics_sinks(spark, tmp_path):
    from glossmill.operators import judge

    rows = spark.sql(
        "select 'r1' as review_id, 't' as text, 5 as rating, named_struct('name', 'p', 'weight', 1.0D) as persona, 'm' as model_used, array('a') as seed_words, 1.5D as generation_time, 0.1D as cost, named_struct('length', 3) as statistical_metrics, cast(null as struct<overall_score:double>) as llm_judge_results, 'accept' as final_decision, 0 as regeneration_count"
    )
    io.write_dataset(rows, str(tmp_path / "d"))
    r = json.loads(next((tmp_path / "d").glob("part-*.json")).read_text())
    assert (r["id"], r["persona"], r["model"], r["metadata"]["weight"], r["statistical_scores"]) == ("r1", "p", "m", 1.0, {"length": 3})
    io.write_metrics(spark.sql("select 3 as total, array(1.0D) as _scores"), str(tmp_path / "m"))
    assert json.loads(next((tmp_path / "m").glob("part-*.json")).read_text()) == {"total": 3}
    s = spark.createDataFrame(
        [(True, 0, "0.5"), (False, 1, "0.5"), (False, 0, "0.5"), (False, 0, "x"), (None, None, "1")], "s boolean, e int, o string"
    )
    assert [x[0] for x in s.select(judge.usable_score(F.col("s"), F.col("e"), F.col("o"))).collect()] == [None, None, 0.5, None, 1.0]


def test_batch_results(spark):
    q = spark.createDataFrame([("request-0",), ("request-1",), ("request-2",)], "custom_id string")
    r = spark.createDataFrame(
        [("request-0", 200, "t", 1000, 1000, None), ("request-1", 500, None, None, None, None)],
        "custom_id string, status_code int, content string, prompt_tokens long, completion_tokens long, error string",
    )
    got = {x.custom_id: (x.text, x.success, x.error, round(x.cost, 6)) for x in metrics.batch_results(q, r, "gpt-4").collect()}
    assert got == {
        "request-0": ("t", True, None, 0.045), "request-1": (None, False, "Unknown error", 0.0),
        "request-2": (None, False, "Result not found in batch output", 0.0),
    }


def test_report_of_an_empty_run():
    zero = {
        k: 0.0 for k in (
            "overall_score", "self_bleu_diversity", "semantic_diversity", "vocabulary_size", "ttr", "mattr", "bigram_diversity",
            "trigram_diversity",
        )
    }
    text = report.markdown(zero, {"avg_similarity": 0.0}, [], {}, [], {"realism_score": 0.5}, [], {}, 10)
    assert "Accepted: 0" in text and "no real texts" in text


def events(spark):
    at = datetime(2025, 1, 1)
    return [
        ("k", at + timedelta(seconds=s), f) for s, f in (
            (0, True), (10, True), (20, True), (200, False), (301, True), (302, True), (700, False)
        )
    ]


WANT = [1, 2, 3, 3, 1, 2, 0]


def test_breaker_over_a_table(spark):
    df = spark.createDataFrame(events(spark), "key string, ts timestamp, failed boolean")
    got = breaker.batch(df, "key", "ts", "failed").orderBy("ts").collect()
    assert [r.failures_so_far for r in got] == WANT and [r.active for r in got] == [n >= 3 for n in WANT]


def test_throttle():
    clock, slept = [0.0], []

    class Fast:
        def generate(self, *a, **k):
            clock[0] += 1
            return {"success": True, "text": "t", "tokens": {"total": 10}}

    def sleep(s):
        slept.append(s)
        clock[0] += s

    p = providers.Throttled(Fast(), calls=2, tokens=1000, now=lambda: clock[0], sleep=sleep)
    for _ in range(3):
        p.generate("s", "u")
    assert slept == [59.0]


def test_chat_provider(monkeypatch):
    monkeypatch.setenv("SOME_KEY", "k")
    seen = {}

    def post(url, body, headers):
        seen.update(body, **headers)
        if body["model"] == "down":
            raise RuntimeError("Please try again in 2s.")
        return {"choices": [{"message": {"content": " hi "}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}

    r = providers.ChatProvider("u", "m", "SOME_KEY", lambda m, i, o, c: i + o / 10, post=post).generate("s", "u", 0.5)
    assert r["success"] and r["text"] == "hi" and r["cost"] == 3.4 and seen["temperature"] == 0.5 and seen["Authorization"] == "Bearer k"
    assert providers.ChatProvider("u", "down", "SOME_KEY", post=post).generate("s", "u")["error"] == "Please try again in 2s."
    with pytest.raises(KeyError):
        providers.ChatProvider("u", "m", "NO_SUCH_KEY")


def test_log_stream_writes_a_batch_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    q = breaker.append_log(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.json(str(tmp_path / "log")).count() == 5


def test_command_line(spark, tmp_path, capsys):
    from glossmill.__main__ import main

    assert main(["list"]) == 0 and "self_bleu" in capsys.readouterr().out
    assert main(["query", "distribution_check", "/root/testdata/sf0.001", "-o", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5
