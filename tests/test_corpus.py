"""Corpus measures against plain Python: Self-BLEU over all pairs, growing corpora, windows, cosines, prefix sums."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.operators import diversity, metrics, packed, prefix_bleu, windows
from glossmill.operators.prefix import running
from glossmill.operators.prefix_bleu import prefix_diversity
from glossmill.plans import staging


def plain_bleu(hyp, refs):
    if not hyp:
        return 0.0
    log = 0.0
    for n in range(1, 5):
        grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))  # noqa: E731, B023
        mine, most = grams(hyp), Counter()
        for r in refs:
            for g, c in grams(r).items():
                most[g] = max(most[g], c)
        m, d = sum(min(c, most[g]) for g, c in mine.items()), max(1, len(hyp) - n + 1)
        if n == 1 and m == 0:
            return 0.0
        log += 0.25 * math.log(m / d if m else 0.1 / d)
    ref = min((len(r) for r in refs), key=lambda x: (abs(x - len(hyp)), x))
    return math.exp(log) * (1.0 if len(hyp) > ref else math.exp(1 - ref / len(hyp)))


def some_texts(n, seed):
    rng = random.Random(seed)
    out = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 15, 40]))) for _ in range(n)]
    return out + [out[-1], "", "Zed only here", "A a B b"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(some_texts(40, 3))), "seq long, text string").repartition(3)


def test_self_bleu(corpus):
    texts = [t.split() for t in some_texts(40, 3)]
    got = {r.seq: r.bleu for r in diversity.self_bleu_docs(corpus).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_bleu(t, texts[:i] + texts[i + 1 :]), abs=1e-12), t
    assert diversity.self_bleu_diversity(corpus).first()[0] == pytest.approx(1 - np.mean(list(got.values())))


def test_self_bleu_of_no_and_one_text(spark):
    one = spark.createDataFrame([(1, "a b c")], "seq long, text string")
    assert diversity.self_bleu_diversity(one).first()[0] == 0.0 and diversity.self_bleu_diversity(one.limit(0)).first()[0] == 0.0


@pytest.mark.parametrize("bucket", [3, 1000])
def test_growing_corpus(spark, bucket):
    texts = some_texts(25, 8)
    df = spark.createDataFrame(
        [("r", i, t) for i, t in enumerate(texts)] + [("q", 1, "x y z"), ("q", 2, "x y z")], "run string, seq long, text string"
    )
    got = {(r.run, r.seq): r.self_bleu_diversity for r in prefix_diversity(df, "run", "seq", bucket_texts=bucket).collect()}
    words = [t.split() for t in texts]
    for k in range(1, len(words)):
        want = 1 - np.mean([plain_bleu(words[i], words[:i] + words[i + 1 : k + 1]) for i in range(k + 1)])
        assert got["r", k] == pytest.approx(want, abs=1e-12)
    assert got["r", 0] == 1.0 and got["q", 1] == 1.0 and len(got) == len(texts) + 2


def test_growing_corpus_query_over_ids_beyond_a_thousand(spark, tmp_path):
    from glossmill.plans.queries import QUERIES

    ids = [3, 500, 999, 1000, 1001, 1999, 2500, 7000, 123_456]
    texts = ["a b c d e", "a b c", "f g h i", "a b c d e", "f g h", "z", "f g h i", "a b c d", "k a b c d e"]
    rows = [
        (i, t, lang, "s") for lang, shift in (("en", 0), ("de", 1)) for i, t in zip((x * 2 + shift for x in ids), texts)
    ] + [(9001, None, "fr", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.run, r.seq): r.self_bleu_diversity for r in QUERIES["prefix_self_bleu"](spark, str(tmp_path)).collect()}
    words = [t.split() for t in texts]
    want = [1.0] + [
        1 - np.mean([plain_bleu(words[i], words[:i] + words[i + 1 : k + 1]) for i in range(k + 1)]) for k in range(1, len(words))
    ]
    assert got == {("en", i * 2): pytest.approx(w, abs=1e-6) for i, w in zip(ids, want)} | {
        ("de", i * 2 + 1): pytest.approx(w, abs=1e-6) for i, w in zip(ids, want)
    } | {("fr", 9001): 1.0}


@pytest.mark.parametrize("n, window, stride, chunk", [(3, 100, 50, 50), (40, 100, 50, 1), (40, 100, 30, 2), (40, 7, 1, 3), (40, 5, 8, 1), (40, 1, 1, 4)])
def test_mattr(spark, monkeypatch, n, window, stride, chunk):
    monkeypatch.setattr(diversity, "CHUNK_WINDOWS", chunk)
    texts = [t * 3 for t in some_texts(n, 5)] + ["same " * 60]
    words = [w for t in texts for w in t.lower().split()]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(3)
    want = [len(set(words[i : i + window])) / window for i in range(0, len(words) - window + 1, stride)]
    assert diversity.mattr(df, window, stride).first()[0] == pytest.approx(np.mean(want) if want else len(set(words)) / len(words))


def test_ngram_diversity_of_short_texts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A b a B"), (3, "")], "seq long, text string")
    assert tuple(diversity.ngram_diversity(df, 2).first()) == (3, 2, pytest.approx(2 / 3))
    assert tuple(diversity.ngram_diversity(df.limit(1), 2).first()) == (0, 0, 0.0)


def test_cosines(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(57, 6))
    x[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    c = (u @ u.T)[np.triu_indices(57, 1)]
    m = diversity.cosine_moments(df).first()
    assert (m.pairs, m.avg_similarity, m.std_similarity) == (57 * 28, pytest.approx(c.mean()), pytest.approx(c.std()))
    for block in (8, 4096):
        e = diversity.cosine_extremes(df, block_rows=block).first()
        assert (e.max_similarity, e.min_similarity) == (pytest.approx(c.max()), pytest.approx(c.min()))
    assert diversity.cosine_moments(df.limit(0)).first().avg_similarity == 0.0


@pytest.mark.parametrize("kind", ["clusters", "copies", "zeros", "one"])
def test_extremes_of_vectors_that_lie_together(spark, kind):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(6, 8)), 40, axis=0) + 0.05 * rng.normal(size=(240, 8))
    x = {"clusters": x, "copies": np.repeat(x[:4], 50, axis=0), "zeros": np.zeros((20, 8)), "one": x[:1]}[kind]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(size > 0, size, 1)
    c = (u @ u.T)[np.triu_indices(len(x), 1)]
    for block in (7, 60, 4096):
        e = diversity.cosine_extremes(df, block_rows=block).first()
        assert (e.max_similarity, e.min_similarity) == ((pytest.approx(c.max()), pytest.approx(c.min())) if len(c) else (None, None))
        got = {r.vec_id: r.max_similarity for r in diversity.max_similarity_before(df, block_rows=block).collect()}
        assert got == {i: pytest.approx((u[:i] @ u[i]).max(), abs=1e-12) if i else None for i in range(len(x))}


def test_running_sums_over_buckets(spark, monkeypatch):
    from glossmill.operators import prefix

    monkeypatch.setattr(prefix, "BUCKET_ROWS", 10)
    rng = random.Random(2)
    values = sorted(rng.sample(range(10_000), 200))
    df = spark.createDataFrame([(v, v % 7) for v in values], "o long, x long").repartition(5)
    got = [r.s for r in running(df, "o", {"s": F.col("x")}).orderBy("o").collect()]
    assert got == list(np.cumsum([v % 7 for v in values]))


def test_rates_and_runs(spark):
    df = spark.sql("select id, timestamp_seconds(1000 + id * 20) as ts, id % 4 <> 0 as bad from range(400)")
    got = {r.id: (r.requests, r.amount_in_window) for r in windows.rate_window(df, "ts", F.lit(2).cast("long"), 60, slot=100).collect()}
    assert got[0] == (1, 2) and got[5] == (3, 6) and len(got) == 400
    runs = {r.id: r.run_length for r in windows.failure_runs(df, [], ["id"], F.col("bad"), 3).collect()}
    assert [runs[i] for i in range(6)] == [0, 1, 2, 3, 0, 1]


def test_pass_rate_fold(spark):
    flags = [True, False, True, True, False, False, True]
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate(flags)], "s string, i int, f boolean")
    rate = 0.0
    for n, f in enumerate(flags, 1):
        rate = (int(rate * (n - 1)) + 1) / n if f else rate
    r = metrics.pass_rate_parity(df, "s", "i", "f").first()
    assert r.rate_parity == pytest.approx(rate) and r.rate == pytest.approx(4 / 7)


def test_ngrams_in_shares(spark, monkeypatch):
    """Shares of the n-grams, of which one at a time is on disk, give what all of them at once give."""
    words = ["alpha", "beta", "gamma", "delta", "beta", "omega"]
    texts = [" ".join(words[(i * j) % 6] for j in range(1, 3 + i % 17)) for i in range(60)] + ["", " ".join(words)]
    reviews = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    whole = sorted(map(tuple, diversity.bleu_parts(reviews).collect()))
    made = []
    in_shares = diversity.in_shares
    monkeypatch.setattr(diversity, "in_shares", lambda spark, make, shares, name: made.append(shares) or in_shares(spark, make, shares, name))
    monkeypatch.setattr(diversity, "SHARE_CHARS", 500)
    monkeypatch.setattr(diversity, "SHARES", 5)
    before = spark.conf.get(staging.SHUFFLE_CLEANUP, None)
    assert sorted(map(tuple, diversity.bleu_parts(reviews).collect())) == whole
    assert made == [5] and spark.conf.get(staging.SHUFFLE_CLEANUP, None) == before
    some = spark.createDataFrame([(0, ["a", "b", "a"])], "seq long, w array<string>")
    grams = lambda share: sorted(map(tuple, diversity.ngram_rows(some, ["seq"], (1, 2, 3, 4), share=share).collect()))
    assert sorted(grams((0, 2)) + grams((1, 2))) == grams((0, 1)) and len(grams((0, 1))) == 6


def test_shares_read_hashes_of_words(spark, monkeypatch):
    """Texts are cut into words once, not by each share; texts of one id are still one text of two pieces."""
    texts = [" ".join(f"w{(i * j) % 11}" for j in range(1, 4 + i % 13)) for i in range(40)]
    reviews = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    plans, in_shares = [], diversity.in_shares
    monkeypatch.setattr(diversity, "SHARE_CHARS", 300)
    monkeypatch.setattr(diversity, "SHARES", 3)
    with monkeypatch.context() as m:
        m.setattr(diversity, "in_shares", lambda spark, make, shares, name: plans.append(make(0)._jdf.queryExecution().toString()) or in_shares(spark, make, shares, name))
        got = {r.seq: r.bleu for r in diversity.self_bleu_docs(reviews).collect()}
    assert len(plans) == 1 and "split(" not in plans[0]
    words = [t.split() for t in texts]
    assert got == {i: pytest.approx(plain_bleu(w, words[:i] + words[i + 1 :])) for i, w in enumerate(words)}
    twice = reviews.unionByName(reviews.filter("seq = 3"))
    assert diversity.self_bleu_docs(twice).filter("seq = 3").count() == 2


def test_overall_hashes_lower_case_words_once(spark, monkeypatch):
    """All measures of lower-case words come from one table of hashes, and are those of the single measures; windows cross chunks and texts."""
    rng = random.Random(5)
    texts = [" ".join(f"W{rng.randrange(30)}" for _ in range(rng.choice((0, 1, 30, 90, 260)))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "vec_id long, embedding array<double>")
    monkeypatch.setattr(diversity, "CHUNK_WINDOWS", 3)
    made, hashed = [], packed.hashed
    monkeypatch.setattr(packed, "hashed", lambda *a, **k: made.append(k.get("lower", False)) or hashed(*a, **k))
    one = diversity.overall(df, vectors).first()
    assert made == [True, False]
    words = [w.lower() for t in texts for w in t.split()]
    starts = range(0, len(words) - 100 + 1, 50)
    assert one.mattr == pytest.approx(np.mean([len(set(words[i : i + 100])) / 100 for i in starts]))
    assert (one.total_words, one.vocabulary_size) == (len(words), len(set(words)))
    for n, name in ((2, "bigram_diversity"), (3, "trigram_diversity")):
        grams = [tuple(w[i : i + n]) for t in texts for w in [t.lower().split()] for i in range(len(w) - n + 1)]
        assert one[name] == pytest.approx(len(set(grams)) / len(grams)) and diversity.ngram_diversity(df, n).first().total == len(grams)


def test_prefix_series_in_shares(spark, monkeypatch):
    """The series over a growing corpus, with n-grams in shares."""
    rng = random.Random(8)
    rows = [(k % 2, k, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 25)))) for k in range(50)]
    df = spark.createDataFrame(rows, "run int, seq long, text string")
    series = lambda: {(r.run, r.seq): round(r.self_bleu_diversity, 9) for r in prefix_diversity(df, "run", "seq", bucket_texts=20).collect()}
    whole, made = series(), []
    in_shares = prefix_bleu.in_shares
    monkeypatch.setattr(prefix_bleu, "in_shares", lambda spark, make, shares, name: made.append(shares) or in_shares(spark, make, shares, name))
    monkeypatch.setattr(diversity, "SHARE_CHARS", 300)
    monkeypatch.setattr(diversity, "SHARES", 3)
    assert series() == whole and made == [3]


def test_prefix_shares_read_hashes_of_words(spark, monkeypatch):
    """The series cuts texts into words once, not for each share, whatever the slices and buckets; a run may have no name."""
    rng = random.Random(3)
    rows = [(None if k % 3 == 0 else str(k % 3), k, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 30)))) for k in range(48)]
    df = spark.createDataFrame(rows, "run string, seq long, text string").repartition(3)
    plans, in_shares = [], prefix_bleu.in_shares
    monkeypatch.setattr(diversity, "SHARE_CHARS", 300)
    monkeypatch.setattr(diversity, "SHARES", 3)
    monkeypatch.setattr(prefix_bleu, "in_shares", lambda spark, make, shares, name: plans.append(make(0)._jdf.queryExecution().toString()) or in_shares(spark, make, shares, name))
    got = {(r.run, r.seq): r.self_bleu_diversity for r in prefix_diversity(df, "run", "seq", bucket_texts=10).collect()}
    assert len(plans) == 1 and "split(" not in plans[0] and len(got) == len(rows)
    for run in (None, "1", "2"):
        mine = [(k, t.split()) for r, k, t in rows if r == run]
        words = [w for _, w in mine]
        for i, (k, _) in enumerate(mine):
            want = 1 - np.mean([plain_bleu(words[j], words[:j] + words[j + 1 : i + 1]) for j in range(i + 1)]) if i else 1.0
            assert got[run, k] == pytest.approx(want, abs=1e-12)


def test_changes_of_the_lead():
    """Largest and second largest counts before each row of a group, and who had the largest first."""
    key, c = np.array([0, 0, 0, 0, 1, 1, 2]), np.array([2, 2, 5, 3, 1, 4, 7])
    opens, m1, holder, m2 = packed.before(key, c)
    assert opens.tolist() == [True, False, False, False, True, False, True]
    assert m1.tolist() == [0, 2, 2, 5, 0, 1, 0] and m2.tolist() == [0, 0, 2, 2, 0, 0, 0]
    assert [int(h) for h, o in zip(holder, opens) if not o] == [0, 0, 2, 4]


def test_windows_and_diversity_in_shares(spark, monkeypatch):
    """MATTR by shares of places, distinct n-grams by shares of hashes, and the table of texts gone afterwards."""
    rng = random.Random(9)
    texts = [" ".join(f"W{rng.randrange(9)}" for _ in range(rng.choice((0, 1, 7, 40, 130)))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    monkeypatch.setattr(diversity, "CHUNK_WINDOWS", 2)
    measures = lambda: [diversity.mattr(df, 10, 3).first()[0], tuple(diversity.ngram_diversity(df, 2).first()), tuple(diversity.ngram_diversity(df, 3).first())]
    whole, made = measures(), []
    in_shares = diversity.in_shares
    monkeypatch.setattr(diversity, "in_shares", lambda spark, make, shares, name: made.append(shares) or in_shares(spark, make, shares, name))
    monkeypatch.setattr(diversity, "SHARE_CHARS", 500)
    monkeypatch.setattr(diversity, "SHARES", 4)
    assert measures() == whole and made == [4, 4, 4]
