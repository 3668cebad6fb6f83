"""State that grows with what comes: Self-BLEU of batches, closest lengths in time, frequent values, slots, collections."""

import collections
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from glossmill.operators import bleu_state, diversity, gates, metrics, prefix_bleu
from glossmill.plans import staging
from glossmill.plans.queries import QUERIES
from glossmill.sources import io, providers

WORDS = ["red", "blue", "one", "two", "tree", "house", "is", "a"]


def some_texts(rng, n):
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 8, 20])))) for i in range(n)]


def scores(df):
    return {r.seq: round(r.bleu, 9) for r in df.collect()}


@pytest.mark.parametrize("looked_up", [500_000, 0])
def test_batches_give_what_one_pass_gives(spark, tmp_path, monkeypatch, looked_up):
    monkeypatch.setattr(bleu_state, "LOOKED_UP", looked_up)
    rng = random.Random(4)
    rows = some_texts(rng, 60) + [(60, None)]
    df = spark.createDataFrame(rows, "seq long, text string")
    corpus = bleu_state.Corpus(spark, str(tmp_path / "state"))
    assert corpus.diversity().first()[0] == 0.0
    for i, (lo, hi) in enumerate(((0, 20), (20, 21), (21, 50), (50, 61))):
        corpus.append(df.filter(F.col("seq").between(lo, hi - 1)), i)
        some = df.filter(F.col("seq") < hi).withColumn("text", F.coalesce("text", F.lit("")))
        assert scores(corpus.scores()) == scores(diversity.self_bleu_docs(some))
    before = scores(corpus.scores())
    corpus.append(df.filter("seq < 30"), 2)  # a batch that comes again changes nothing
    assert scores(corpus.scores()) == before and corpus.versions() == [0, 1, 2, 3]


def test_a_batch_touches_its_own_ngrams_and_their_holders(spark, tmp_path):
    corpus = bleu_state.Corpus(spark, str(tmp_path / "state"))
    rng = random.Random(5)
    first = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for i in range(200)]
    corpus.append(spark.createDataFrame(first, "seq long, text string"), 0)
    new = [(1000, "w1 w2 w3 w4 w5"), (1001, "quite new words here")]
    corpus.append(spark.createDataFrame(new, "seq long, text string"), 1)
    grams = corpus.table("ngrams", bleu_state.GRAMS).filter("version = 1").count()
    texts = {r.seq for r in corpus.table("texts", bleu_state.TEXTS).filter("version = 1").collect()}
    mine = sum(len({tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}) for _, t in new for n in range(1, 5))
    assert 0 < grams <= mine
    assert {1000, 1001} <= texts and len(texts) <= 2 + 2 * 5  # of the old texts at most those that held one of the five words


def test_batches_in_shares_leave_the_state_alone_on_disk(spark, tmp_path, monkeypatch):
    """Batches may differ in their shares; what is needed only while a batch is taken in goes."""
    df = spark.createDataFrame(some_texts(random.Random(7), 40), "seq long, text string")
    corpus = bleu_state.Corpus(spark, str(tmp_path / "state"))
    shared = staging.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    for i, (lo, hi, shares) in enumerate(((0, 15, 3), (15, 22, 1), (22, 40, 4))):
        monkeypatch.setattr(diversity, "SHARE_CHARS", 10)
        monkeypatch.setattr(diversity, "SHARES", shares)
        corpus.append(df.filter(F.col("seq").between(lo, hi - 1)), i)
    monkeypatch.undo()
    assert set(os.listdir(shared)) == before
    assert scores(corpus.scores()) == scores(diversity.self_bleu_docs(df))


def test_a_batch_that_broke_off_leaves_nothing(spark, tmp_path):
    corpus = bleu_state.Corpus(spark, str(tmp_path / "state"))
    df = spark.createDataFrame(some_texts(random.Random(6), 12), "seq long, text string")
    corpus.append(df.filter("seq < 6"), 0)
    before = scores(corpus.scores())
    (tmp_path / "state/ngrams/version=1").mkdir()
    df.limit(1).select(F.lit(1).alias("a")).write.mode("overwrite").parquet(str(tmp_path / "state/ngrams/version=1"))  # no marker: not whole
    assert scores(corpus.scores()) == before
    corpus.append(df.filter("seq >= 6"), 1)
    assert scores(corpus.scores()) == scores(diversity.self_bleu_docs(df))


def closest(rows):
    """By text and time: the closest length of another text so far, the shorter of two."""
    out = {}
    for o, n in rows:
        for t, _ in rows:
            others = [m for p, m in rows if p <= t and p != o]
            if t >= o and others:
                out[o, t] = min(others, key=lambda m: (abs(m - n), m))
    return out


@pytest.mark.parametrize("spread, lengths", [(400, 7), (12, 3), (400, 20_000), (1, 5)])
def test_closest_lengths_in_time(spread, lengths, spark):
    rng = random.Random(spread)
    runs = {"hot": [(i, rng.randrange(spread)) for i in range(90)], "down": [(i, 200 - i) for i in range(60)], "up": [(i, i * i) for i in range(40)], "one": [(5, 5)], None: [(i, 3) for i in range(9)]}
    rows = [(r, o, o // 16, n) for r, texts in runs.items() for o, n in texts]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "r string, o long, bucket int, len long")
    got = prefix_bleu.closest_lengths(df, lengths).collect()
    for r, texts in runs.items():
        events = collections.defaultdict(list)
        for e in got:
            if e.r == r:
                events[e.doc].append((e.t, e.ref))
        for (o, t), want in closest(texts).items():
            known = [x for x in sorted(events[o]) if x[0] <= t]
            last = [ref for u, ref in known if u == known[-1][0]]
            n = dict(texts)[o]
            assert min(last, key=lambda m: (abs(m - n), m)) == want, (r, o, t)


def bleu(words, others):
    """The score of a text against all others, by its definition."""
    if not words or not others:
        return 0.0
    counts = lambda w, n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    log, first = 0.0, 0
    for n in range(1, 5):
        own, most = counts(words, n), collections.Counter()
        for o in others:
            for g, k in counts(o, n).items():
                if g in own:
                    most[g] = max(most[g], k)
        hit = sum(min(k, most[g]) for g, k in own.items())
        first = hit if n == 1 else first
        log += 0.25 * math.log((hit or 0.1) / max(1, len(words) - n + 1))
    ref = min((len(o) for o in others), key=lambda m: (abs(m - len(words)), m))
    return 0.0 if not first else (1.0 if len(words) > ref else math.exp(1 - ref / len(words))) * math.exp(log)


def test_the_prefix_query_over_a_whole_session(spark, monkeypatch):
    monkeypatch.setattr(prefix_bleu, "LENGTHS", 10)
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'de'").collect())
    got = {r.seq: r.self_bleu_diversity for r in QUERIES["prefix_self_bleu"](spark, sf).filter("run = 'de'").collect()}
    assert set(got) == {i for i, _ in docs} and len(docs) > 15
    for k in range(len(docs)):
        texts = [w for _, w in docs[: k + 1]]
        want = 1.0 if k == 0 else 1 - sum(bleu(w, texts[:i] + texts[i + 1 :]) for i, w in enumerate(texts)) / len(texts)
        assert got[docs[k][0]] == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("counters", [3, 40, 100_000])
def test_frequent_values_are_exact(spark, monkeypatch, counters):
    rng = random.Random(counters)
    values = [f"v{int(rng.paretovariate(0.7))}" for _ in range(6000)] + [f"rare {i}" for i in range(3000)] + ["hot"] * 4000 + [None] * 50
    df = spark.createDataFrame([(v,) for v in rng.sample(values, len(values))], "v string").repartition(5)
    got = {r.value: r.n for r in metrics.frequent(df, 5, counters).collect()}
    want = collections.Counter(v for v in values if v is not None)
    assert got == {v: want[v] for v in got} and {v for v, _ in want.most_common(5)} <= set(got)
    if counters < 100_000:
        assert len(got) < len(want) / 2  # most values were never counted one by one
    assert metrics.frequent(df.limit(0), 5).count() == 0


def test_top_reasons_break_ties_by_first_places(spark):
    rows = [(i, [f"r{i % 12}", "same"] if i % 3 else []) for i in range(240)]
    df = spark.createDataFrame(rows, "seq long, reasons array<string>")
    got = [tuple(r) for r in metrics.top_reasons(df, counters=4).collect()]
    count = collections.Counter(x for _, rs in rows for x in rs)
    first = {}
    for i, rs in rows:
        for x in rs:
            first.setdefault(x, i)
    want = sorted(count, key=lambda x: (-count[x], first[x], x))[:10]
    assert got == [(x, count[x], first[x], count[x] / 160 * 100) for x in want]
    assert metrics.top_reasons(df.filter("size(reasons) = 0")).count() == 0


def test_slots_settle_by_their_attempts(spark):
    t = gates.Thresholds(max_regeneration_attempts=5)
    short, mood, judge = "Too short: 3 words (min: 50)", "Sentiment-rating mismatch (alignment: 0.10, threshold: 0.20)", "LLM Judge evaluation failed (4 errors) - possible API issue"
    slots = {
        "at once": [[]], "later": [[short], [short], []], "stuck": [[short]] * 9, "mood": [[mood]] * 9, "hard": [[short], [mood]] * 9,
        "judge": [[judge]] * 9, "open": [[short], [mood]], "hot": [[short], [mood], [short], [mood], [short], [mood]] * 200,
    }
    rows = [(k, i, r, 2 if k == "hard" else 5, 0.5) for k, v in slots.items() for i, r in enumerate(v)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "slot string, o int, reasons array<string>, rating int, alignment_score double")
    got = collections.defaultdict(list)
    for r in sorted(gates.settle(df, "slot", "o", t).collect(), key=lambda r: r.o):
        got[r.slot].append((r.o, r.decision))
    again = lambda n, last: [(i, "regenerate") for i in range(n)] + [(n, last)]
    assert got["at once"] == again(0, "accept") and got["later"] == again(2, "accept")
    assert got["stuck"] == again(4, "reject") and got["mood"] == again(4, "accept")  # the same class in attempts 2, 3 and 4
    assert got["hard"] == again(4, "reject") and got["hot"] == again(5, "reject")  # attempts run out, sooner for hard ratings
    assert got["judge"][-1][1] == "accept" and got["open"] == [(0, "regenerate"), (1, "regenerate")]


def test_a_collection_keeps_what_it_rejects(spark, tmp_path):
    source, c = tmp_path / "in", io.Collection(spark, str(tmp_path / "collection"))
    source.mkdir()
    lines = [json.dumps({"review_id": "1", "body": "good", "rating": 4}), "no json", "", "[1]", json.dumps({"review_id": "2"}), json.dumps({"review_id": "3", "body": "x", "rating": "many"})]
    (source / "a.jsonl").write_text("\n".join(lines) + "\n")
    c.scan(str(source))
    assert [(r.review_id, r.body, r.rating) for r in c.accepted().collect()] == [("1", "good", 4.0)]
    bad = {r.line: r.why for r in c.rejected().collect()}
    assert bad == {"no json": "not an object", "": "not an object", "[1]": "not an object", lines[4]: "no body", lines[5]: "a field of another type"}
    assert c.accepted().count() + c.rejected().count() == len(lines) and all(r.file.endswith("a.jsonl") for r in c.rejected().collect())
    (source / "b.jsonl").write_text(lines[0] + "\n")
    c.scan(str(source))
    c.scan(str(source))
    assert c.accepted().count() == 2 and c.accepted().filter("batch = 1").select("file").first()[0].endswith("b.jsonl")  # the first file isn't read again


def test_what_services_say():
    assert [providers.wait_seconds(m, 3) for m in ("Please try again in 250ms. Bye", "Please try again in 1,500ms", "try again in 2.25s. Bye", "busy")] == [0.75, 2.0, 2.75, 8.0]
    given = {' "a" ': "a", "```text\na\nb\n```": "a\nb", "'```\nx\n```'": "x", "```x```": "```x```", '"': '"', "plain 'x'": "plain 'x'", '""': ""}
    assert {k: providers.unwrapped(k) for k in given} == given
    assert providers.Draft().generate("", "Draft:\na b")["text"] == "a b" and not providers.Draft().generate("", "Draft:\n")["success"]


def test_moments_equal_a_scan_and_old_files_stay_unread(spark, tmp_path, monkeypatch):
    from glossmill.operators import moments, realism

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["API", "data", "is", "fine."]) for _ in range(rng.randrange(1, 30))) for _ in range(90)] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    source, kept = str(tmp_path / "in"), moments.Stored(spark, str(tmp_path / "state"))
    same = lambda: all(a == pytest.approx(b) for a, b in zip(kept.stats(source).first(), realism.corpus_stats(spark.read.parquet(source)).first()))
    df.limit(40).repartition(3).write.parquet(source)
    first = kept.refresh(source)
    assert len(first) == 3 and same() and kept.refresh(source) == []
    df.coalesce(1).write.mode("append").parquet(source)
    read = []
    monkeypatch.setattr(moments, "text_metrics", lambda rows, f=moments.text_metrics: read.extend(rows.inputFiles()) or f(rows))
    second = kept.refresh(source)
    assert len(second) == 1 and not set(second) & set(first) and same()
    assert len(read) == 1 and not any(f.split("/")[-1] in read[0] for f in first)  # old files weren't read
    next(f for f in (tmp_path / "in").glob("*.parquet") if f.name in first[0]).unlink()
    assert kept.refresh(source) == [] and same()  # a file that went counts no longer
    none = realism.compare(kept.stats(source), moments.Stored(spark, str(tmp_path / "other")).stats(str(tmp_path / "state"))).first()
    assert none.realism_score == 0.5


def test_a_batch_is_appended_once(spark, tmp_path):
    from glossmill.sources.once import Table

    t = Table(spark, str(tmp_path / "t"))
    assert t.read("id long").count() == 0
    assert t.append(spark.range(5), 0) and not t.append(spark.range(5), 0) and t.append(spark.range(5, 8), 1)
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("on purpose"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="on purpose"):
        t.append(broken, 2)
    assert sorted(r.id for r in t.read("id long").collect()) == list(range(8))
    spark.range(3).write.json(str(tmp_path / "t/rows/lost"))  # a driver that ended before its entry
    assert t.append(spark.range(8, 10), 2) and t.read("id long").count() == 10
    assert "lost" in t.clean() and t.clean() == [] and t.read("id long").count() == 10


def test_two_writers_of_a_batch_leave_one_copy(spark, tmp_path, monkeypatch):
    from glossmill.sources.once import Table

    a, b = Table(spark, str(tmp_path / "t"), "parquet"), Table(spark, str(tmp_path / "t"), "parquet")
    looks = []
    monkeypatch.setattr(b, "batches", lambda f=b.batches: looks.append(1) or ({} if len(looks) == 1 else f()))  # b looked before a was done
    assert a.append(spark.range(4), 7)
    assert not b.append(spark.range(4), 7) and a.read("id long").count() == 4 and len(b.clean()) == 1
