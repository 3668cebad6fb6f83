"""Judge and breaker in the rounds, batches of requests, models as stages, folds, and what is typed in."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glossmill.functions import sentiment as S
from glossmill.operators import gates, judge, metrics, models, prefix
from glossmill.plans import judging, rounds
from glossmill.plans.staging import shared_dir
from glossmill.sources import batch, io, providers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this module
EASY = {"min_length": 1, "max_length": 10_000, "min_unique_words": 1, "max_self_bleu": 1.0}


class Judge:
    """Gives every criterion the same score, and counts nothing that isn't in the prompt."""

    def __init__(self, score):
        self.score = score

    def generate(self, system_prompt, user_prompt, temperature=None, max_tokens=1024):
        criterion = user_prompt.split("\n", 1)[0].removeprefix("Criterion: ")
        return {
            "text": json.dumps(
                {f"{criterion}_score": self.score, "decision": "PASS" if self.score >= 6 else "FAIL", "feedback": f"{criterion} is weak"}
            ),
            "success": True,
        }


class Words:
    def generate(self, system_prompt, user_prompt, temperature=None, max_tokens=1024):
        return {"text": f"plain words {hash(system_prompt) % 10**9} about a tool. " * 3, "success": True, "time": 0.0, "cost": 0.0}


def test_a_failing_judge_rejects_what_passes_the_gates(spark):
    c = io.Config(target_samples=6)
    t = gates.Thresholds(**EASY, max_regeneration_attempts=1)
    done = rounds.run(spark, c, providers.TemplateProvider, t, primary=lambda: Judge(3)).collect()
    assert len(done) == 6 and all(r.decision == "reject" and r.attempt == 2 and r.judge_score == 0.3 for r in done)
    assert all(r.reasons[0].startswith("Failed LLM Judge: ") and "authenticity(0.3): authenticity is weak" in r.reasons[0] for r in done)
    assert all(any(x.startswith("LLM Judge score too low: 0.30") for x in r.reasons) for r in done)
    kind = rounds.run(spark, c, providers.TemplateProvider, t, primary=lambda: Judge(8), secondary=lambda: Judge(8)).collect()
    assert all(r.decision == "accept" and r.judge_score == 0.8 and r.attempt == 1 for r in kind)


def test_the_judge_is_not_asked_about_what_the_gates_reject(spark):
    strict = gates.Thresholds(min_length=10_000, max_length=20_000, max_regeneration_attempts=0)
    done = rounds.run(spark, io.Config(target_samples=4), providers.TemplateProvider, strict, primary=lambda: Judge(9)).collect()
    assert all(r.judge_score is None and r.reasons[0].startswith("Too short") for r in done)


def test_a_tripped_breaker_lets_candidates_pass(spark):
    now = [0.0]
    b = rounds.Breaker(trip_at=3, seconds=300, now=lambda: now[0])
    rows = spark.createDataFrame([(i, 1 + i % 2, i % 4 != 2) for i in range(12)], "seq int, rating int, is_unrealistic boolean")
    open_at = lambda: {r.seq for r in rows.filter(b.open_for(rows)).collect()}
    # rating 2 fails at 1, 3, 5, ...; rating 1 at 0, 4, 8: from the third failure on, every check of that rating passes
    assert open_at() == {5, 7, 9, 11, 8, 10}
    assert open_at() == set(range(12))  # it stays open in the next round
    now[0] = 301.0
    assert open_at() == {5, 7, 9, 11, 8, 10}  # a check after the interval clears the counts
    now[0] = 601.0
    assert open_at() == set(range(12))


def test_an_open_breaker_reaches_the_gates(spark):
    class Angry:
        def generate(self, *a, **k):
            return {
                "text": "It is terrible and awful. It is horrible and bad. It is the worst, and broken. It is useless garbage.",
                "success": True, "time": 0.0, "cost": 0.0,
            }

    c = io.Config(target_samples=8, ratings=(0.0, 0.0, 0.0, 0.0, 1.0))
    t = gates.Thresholds(**EASY, max_regeneration_attempts=0)
    done = rounds.run(spark, c, Angry, t, profile=S.STRICT, breaker=rounds.Breaker(trip_at=3)).orderBy("seq").collect()
    unrealistic = [any("Unrealistic" in x for x in r.reasons) for r in done]
    assert [r.breaker_open for r in done] == [False, False] + [True] * 6 and unrealistic == [True, True] + [False] * 6
    assert [r.decision for r in done] == ["reject"] * 2 + ["accept"] * 6


def test_context_is_the_first_three_of_the_last_ten(spark):
    df = spark.createDataFrame([("s", i, f"text {i} " + "x" * 500) for i in range(14)], "s string, seq int, text string")
    got = {r.seq: [b[:7].strip() for b in r.before] for r in judge.context(df, ["s"], "seq").collect()}
    assert got[0] == [] and got[2] == ["text 0", "text 1"] and got[9] == ["text 0", "text 1", "text 2"] and got[13] == ["text 3", "text 4", "text 5"]
    assert all(len(b) <= 200 for r in judge.context(df, ["s"], "seq").collect() for b in r.before)


def test_judging_gives_feedback_by_criterion(spark):
    rows = spark.createDataFrame(
        [(1, "a text", 5, "p", "d", [], None)],
        "review_id int, text string, rating int, persona string, domain string, before array<string>, avg_overlap double",
    )
    r = judging.evaluate(rows, lambda: Judge(5)).first()
    assert r.dimension_feedback == {k: f"{k} is weak" for k in judge.CRITERIA} and r.final_decision == "FAIL"


class Service:
    """Jobs that end after two questions; the second file's job fails."""

    def __init__(self, bad=()):
        self.files, self.asked, self.bad = [], {}, bad

    def upload(self, lines):
        self.files.append(lines)
        return f"f{len(self.files) - 1}"

    def create(self, file_id):
        return {"id": f"job-{file_id}", "status": "validating", "output_file_id": None}

    def status(self, job_id):
        n = self.asked[job_id] = self.asked.get(job_id, 0) + 1
        end = "failed" if job_id.removeprefix("job-") in self.bad else "completed"
        return {"id": job_id, "status": end if n == 2 else "in_progress", "output_file_id": "out-" + job_id.removeprefix("job-f")}

    def content(self, file_id):
        lines = [json.loads(x) for x in self.files[int(file_id.removeprefix("out-"))]]
        answer = lambda x: {
            "custom_id": x["custom_id"],
            "response": {
                "status_code": 200,
                "body": {
                    "choices": [{"message": {"content": x["body"]["messages"][1]["content"].upper()}}],
                    "usage": {"prompt_tokens": 1000, "completion_tokens": 1000},
                },
            },
        }
        return [json.dumps(answer(x)) for x in lines if "lost" not in x["body"]["messages"][1]["content"]]

    def jobs(self, limit):
        return [{"id": f"j{i}", "status": "completed"} for i in range(30)]

    def models(self):
        return ["b", "a"]


def prompts(spark, n=7):
    return spark.createDataFrame(
        [(i, "system", "lost" if i == 3 else f"say {i}", 1.0) for i in range(n)],
        "id int, system_prompt string, user_prompt string, temperature double",
    )


def test_batches(spark):
    slept, service = [], Service()
    got = {r.id: r for r in batch.run(prompts(spark), service, "gpt-4", "id", job_requests=3, sleep=slept.append).collect()}
    assert len(got) == 7 and [len(f) for f in service.files] == [3, 3, 1] and slept == [60] * 6
    assert all(got[i].text == f"SAY {i}" and got[i].success and round(got[i].cost, 6) == 0.045 and got[i].batch_mode for i in got if i != 3)
    assert not got[3].success and got[3].error == "Result not found in batch output"


def test_batches_that_fail_are_asked_for_one_by_one(spark):
    got = {
        r.id: r for r in batch.run(
            prompts(spark), Service(bad=("f1",)), "gpt-4", "id", provider=providers.TemplateProvider, job_requests=3, sleep=lambda s: None
        ).collect()
    }
    assert len(got) == 7 and sorted(i for i, r in got.items() if not r.batch_mode) == [3, 4, 5] and all(
        got[i].success and got[i].text for i in (3, 4, 5)
    )
    none = batch.run(prompts(spark), Service(bad=("f0", "f1", "f2")), "gpt-4", "id", job_requests=3, sleep=lambda s: None).collect()
    assert len(none) == 7 and all(r.error == "the batch ended badly" and not r.success for r in none)


def test_lists_of_a_service(monkeypatch):
    assert len(batch.list_jobs(Service())) == 10 and len(batch.list_jobs(Service(), 3)) == 3 and batch.list_models(Service()) == ["a", "b"]
    monkeypatch.setenv("A_KEY", "k")
    seen = []

    def ask(method, url, body, headers):
        seen.append((method, url, headers["Authorization"]))
        return {
            "/files": b'{"id": "f"}', "/batches": b'{"id": "j", "status": "validating"}', "/content": b"one\ntwo",
            "/models": b'{"data": [{"id": "m"}]}',
        }[next(k for k in ("/content", "/files", "/batches", "/models") if k in url)]

    s = batch.HttpBatchService("http://x/", "A_KEY", ask)
    assert s.create(s.upload(["{}"]))["id"] == "j" and s.content("f") == ["one", "two"] and s.models() == ["m"] and s.status("j")["id"] == "j"
    assert all(a == "Bearer k" for _, _, a in seen)
    assert batch.list_models(object()) == []


def test_encoders_and_star_models_that_fail(spark):
    class Lengths:
        def encode(self, texts):
            return [[len(t), 1.0] for t in texts]

    class Picky(models.LexiconStars):
        def stars(self, texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("boom")
            return super().stars(texts)

    df = spark.createDataFrame(
        [(1, "great and easy", 5, 1), (2, "boom", 4, 1), (3, None, 3, 1)], "seq int, text string, rating int, attempt int"
    )
    assert {r.seq: r.embedding for r in models.encode(df, Lengths, ["seq"]).collect()} == {1: [14.0, 1.0], 2: [4.0, 1.0], 3: [0.0, 1.0]}
    assert models.encode(df.limit(0), Lengths, ["seq"]).count() == 0
    got = {r.seq: r for r in models.star_sentiment(df, Picky).collect()}
    assert got[1].method == "stars" and got[1].predicted_stars == 5 and got[2].method == "keywords" and got[2].predicted_stars is None
    keyword = {r.seq: r.alignment_score for r in S.with_scores(df, S.LENIENT).collect()}
    assert got[2].alignment_score == keyword[2]


def test_buckets_of_skewed_orders(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BUCKET_ROWS", 10)
    monkeypatch.setattr(prefix, "GROUP", 4)
    values = [2**i for i in range(40)] * 4 + [5] * 60 + [10**12 + i for i in range(50)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "o long, i long").repartition(4)
    got = [(r.o, r.i, r.s) for r in prefix.running(df, "o", {"s": F.lit(1).cast("long")}, tie=["i"]).orderBy("o", "i").collect()]
    assert [s for _, _, s in got] == list(range(1, len(values) + 1)) and [x[:2] for x in got] == sorted(
        (v, i) for i, v in enumerate(values)
    )
    cuts = [1.0, 3.0, 4.0, 9.0, 10.0, 11.0]
    below = spark.createDataFrame(
        [(x,) for x in (0.5, 1.0, 3.5, 10.5, 99.0, None)], "x double"
    ).select(prefix.below(F.col("x"), cuts).alias("n")).collect()
    assert [r.n for r in below] == [0, 0, 2, 5, 6, None]


def test_the_best_model_among_equals(spark):
    rows = [("b", True, 0.1)] * 3 + [("a", True, 0.3), ("a", True, 0.0), ("a", False, 0.0)] + [("c", False, 0.0)] * 9
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(
            [(m, ok, 1.0, x, None, None) for m, ok, x in order],
            "model string, accepted boolean, time double, cost double, quality_score double, judge_score double",
        )
        assert metrics.best_model(metrics.model_rollup(df.repartition(3))).first().model == "a"


def test_what_is_typed_in(tmp_path):
    answers = iter(["A title", "a text", "4.5", "ann", "tool", "", "Other", "more", "many", "", "", "g2", " "])
    rows = io.captured(lambda prompt: next(answers))
    assert [(r[1], r[2], r[4], r[5]) for r in rows] == [("manual", "manual_0001", "a text", 4.5), ("g2", "manual_0002", "more", 0.0)]
    answers = iter(["saas", "7", "lead:2,dev:2", ""])
    c = io.asked_config(lambda prompt: next(answers))
    assert (c.domain, c.target_samples, c.personas, c.models) == ("saas", 7, (("lead", 0.5), ("dev", 0.5)), (("offline", 1.0),))
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(io.config_yaml(c))
    assert io.load_config(str(tmp_path / "c.yaml")) == c


def test_trials_and_loggers(tmp_path):
    t = providers.timed(providers.TemplateProvider(), 2)
    assert t["runs"] == 2 and t["succeeded"] == 2 and t["last"]
    log = io.logger("s1", str(tmp_path / "s.log"))
    assert io.logger("s1") is log
    log.info("it began")
    assert (tmp_path / "s.log").read_text().rstrip().endswith(" - glossmill.s1 - INFO - it began")


def test_an_unset_shared_folder_is_an_error_on_a_cluster(spark):
    class Cluster:
        """A session of a cluster that names no folder."""

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    def getCheckpointDir(self):
                        return type("None_", (), {"isDefined": lambda s: False})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_services(monkeypatch):
    for _, variable in providers.SERVICES.values():
        monkeypatch.setenv(variable, "k")
    seen, said = [], []

    def post(url, body, headers):
        seen.append((url, body, headers))
        if "contents" in body:
            return {"candidates": [{"content": {"parts": [{"text": "one two "}, {"text": "three"}]}}]}
        return {
            "choices": [{"message": {"content": said.pop(0) if said else " fine "}}],
            "usage": {"prompt_tokens": 1000, "completion_tokens": 1000},
        }

    r = providers.by_key("gemini/gemini-pro", post=post).generate("be brief", "say it", 0.3, 50)
    url, body, headers = seen[-1]
    assert url.endswith("/models/gemini-pro:generateContent") and headers == {"x-goog-api-key": "k"}
    assert body["contents"][0]["parts"][0]["text"] == "be brief\n\nsay it"
    assert body["generationConfig"] == {"topP": 0.95, "topK": 40, "maxOutputTokens": 50, "temperature": 0.3}
    assert r["text"] == "one two three" and r["tokens"] == {
        "input": 5, "output": 3, "total": 9
    } and r["cost"] == pytest.approx((5.2 * 0.5 + 3.9 * 1.5) / 1e6)
    assert providers.by_key("openai/gpt-4", post=post).generate("s", "u")["cost"] == pytest.approx(0.09)
    assert providers.by_key("openrouter/x:free", post=post).generate("s", "u")["cost"] == 0.0
    assert providers.by_key("openrouter/x", post=post).generate("s", "u")["cost"] == pytest.approx(0.0004)
    waits, said[:] = [], ['""', '" wrapped "']
    r = providers.by_key("groq/m", post=post, sleep=waits.append).generate("s", "u")
    assert r["success"] and r["text"] == "wrapped" and len(waits) == 1 and r["cost"] == pytest.approx(2e-4)
    assert providers.unwrapped("```json\n{}\n```") == "{}" and providers.unwrapped("'a' b") == "'a' b" and providers.unwrapped('"') == '"'
    with pytest.raises(KeyError):
        providers.by_key("nobody/m")


def test_local_models_are_loaded_once_and_let_go(spark, monkeypatch):
    import types

    loads = []

    def pipeline(task, model):
        loads.append(model)
        return lambda chat, **k: [
            {"generated_text": [*chat, {"role": "assistant", "content": "" if "hush" in chat[1]["content"] else " hello "}]}
        ]

    p = providers.by_key("local/tiny")
    assert not p.generate("s", "u")["success"]  # without the library, a failure and no exception
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(pipeline=pipeline))
    assert p.generate("s", "u")["text"] == "hello" and not p.generate("s", "hush")["success"] and loads == ["tiny"]
    p.close()
    assert p.run is None


def test_providers_are_closed_at_the_end_of_a_task(spark, tmp_path):
    mark = str(tmp_path / "closed")

    class Closing(providers.TemplateProvider):
        def close(self):
            open(mark, "w").close()

    from glossmill.operators import generate

    assert generate.call(prompts(spark), Closing, ["id"]).count() == 7 and (tmp_path / "closed").exists()
