"""Whitening, URL filters and hard negatives against brute force, and on nulls, ties, repeats, empty tables and clashing names."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm import negatives, registry, url_filter, vectors, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
CLASH = "x array<double>, d int, key string, `row` string, id string, n long, component string, rank string, host string, path string, rule string, at string, bucket string, copies string, anchor string, score string"
CLASHING = ([1.0], 1, "k", "r", "i", 5, "c", "k", "h", "p", "u", "a", "b", "c", "a", "s")


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], f"vec_id long, embedding array<float>, label int, {CLASH}").repartition(3)


def plain_whitening(rows, most=4):
    """n, sums, deviation and whitened of each row by the covariance itself, in long integers and doubles."""
    xs = {i: [math.floor(256 * np.float64(np.float32(c))) for c in v] for i, v in rows}
    fit = sorted({tuple(x) for x in xs.values()})
    n, a = len(fit), np.array(fit, float)
    sums = [sum(c) for c in zip(*fit)]
    e, v = np.linalg.eigh(np.cov(a.T, bias=True))
    e, v = e[::-1][:most], v[:, ::-1].T[:most]
    of = {i: (sum((n * c - s) ** 2 for c, s in zip(x, sums)), v @ (np.array(x) - np.array(sums) / n) / np.sqrt(e)) for i, x in xs.items()}
    return n, of, e / np.trace(np.cov(a.T, bias=True))


def same_but_for_signs(got, want, tol=1e-9):
    """got and want: id to values by component."""
    signs = {}
    for i, w in want.items():
        for k, value in enumerate(w):
            if abs(value) > 1e-3:
                signs.setdefault(k, math.copysign(1, got[i][k] * value))
            assert abs(got[i][k] - signs.get(k, 1) * value) < tol * max(1, abs(value)), (i, k)


def test_whitening_equals_the_covariance_method(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, want, share = plain_whitening(rows)
    for fan, block, parts in ((8, 4096, None), (2, 16, 7)):
        monkeypatch.setattr(whitening, "FAN", fan)
        monkeypatch.setattr(whitening, "BLOCK", block)
        given = spark.read.parquet(f"{SF}/embeddings.parquet")
        out = (registry.QUERIES["op11_embedding_whitening"](spark, SF) if parts is None else whitening.whitened(given.repartition(parts))).collect()
        assert len(out) == 4 * len(rows) and {r.component for r in out} == {1, 2, 3, 4}
        got = {i: [0.0] * 4 for i, _ in rows}
        for r in out:
            got[r.vec_id][r.component - 1] = r.whitened
            assert r.n == n and r.deviation == want[r.vec_id][0] and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        same_but_for_signs(got, {i: w for i, (_, w) in want.items()})


def test_the_tree_merges_partitions(spark, monkeypatch):
    """R of many partitions is R of all rows, and no task of the tree gets more than FAN factors."""
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (500, 6))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(20)
    of = whitening.Whitening(500, tuple(int(s) for s in x.sum(0)), np.zeros((0, 6)), np.zeros(0), 0.0)
    r = whitening.triangle(fit, 6, of)
    c = x - x.mean(0)
    assert r.shape == (6, 6) and np.allclose(r.T @ r, c.T @ c)


def test_whitening_of_repeats_nulls_and_flat_dimensions(spark):
    rng = random.Random(2)
    base = [[rng.uniform(-1, 1), rng.uniform(-1, 1), 0.25, -0.0] for _ in range(40)]
    rows = [(i, v, 0) for i, v in enumerate(base)] + [(7, base[7], 0), (None, base[3], None), (90, None, 1), (91, [1.0, None, 0.0, 0.0], 1), (92, [1.0, NAN, 0.0, 0.0], 1), (93, [1.0, INF, 0.0, 0.0], 1), (94, [], 1), (95, [1.0, 2.0], 1)]
    out = whitening.whitened(table(spark, rows)).collect()
    n, want, _ = plain_whitening([(i, v) for i, v in enumerate(base)], 2)
    assert {r.component for r in out} == {1, 2}  # two dimensions don't vary
    count = Counter(r.vec_id for r in out)
    assert count[7] == 4 and count[None] == 2 and set(count) == {*range(40), None}
    assert all(r.n == n == 40 for r in out) and all(r.identity_error < 1e-9 for r in out)
    got = {i: [next(r.whitened for r in out if r.vec_id == i and r.component == k) for k in (1, 2)] for i in range(40)}
    same_but_for_signs(got, {i: w for i, (_, w) in want.items()})
    # a repeated vector counts once in the fit
    assert {r.deviation for r in out if r.vec_id is None} == {want[3][0]}


def test_whitening_without_variance(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    one = whitening.whitened(table(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)]))
    assert one.count() == 0 and one.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_are_exact_beyond_small_integers(spark):
    rows = [(i, [float(2**20 + i * 3), float(i * i)], 0) for i in range(50)]
    _, want, _ = plain_whitening([(i, v) for i, v, _ in rows], 2)
    out = whitening.whitened(table(spark, rows)).collect()
    assert all(r.deviation == want[r.vec_id][0] for r in out)
    huge = whitening.whitened(table(spark, [(i, [1e16 * (i - 1), float(i)], 0) for i in range(4)])).collect()
    assert huge and all(r.deviation is None for r in huge)


def plain_parts(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path[:end]


def plain_verdict(url, rules, default="allow"):
    host, path = plain_parts(url)
    fit = [
        (len(h) + len(p), len(h), h + p, v) for h, p, v in rules
        if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


def judged(spark, urls, rules, parts=3):
    pages = spark.createDataFrame([(i, u, *CLASHING) for i, u in urls], f"page_id long, url string, {CLASH}").repartition(parts)
    return sorted(map(tuple, url_filter.judged(pages, url_filter.rules_of(spark, rules)).collect()), key=repr)


def urls_of(rng, n):
    """Urls and rules over few labels, so that many nest."""
    labels, steps = ["a", "b", "www", "com", "net", ""], ["/", "en/", "x", "é", "en", "//"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(0, 4)))
    path = lambda: rng.choice(["", "/" + "".join(rng.choice(steps) for _ in range(rng.randint(0, 4)))])
    urls = [(i, rng.choice(["http://", "HTTPS://", "", "x://y://"]) + rng.choice([host(), host().upper()]) + path() + rng.choice(["", "?q=/en/", "#/x", "?a#b"])) for i in range(n)]
    return urls, [(host(), path(), rng.choice(["allow", "block"])) for _ in range(n // 4)]


def deduplicated(rules):
    """Of rules with equal host and path one that blocks wins."""
    return [(h, p, max(v for a, b, v in rules if (a, b) == (h, p))) for h, p in {(h, p) for h, p, _ in rules}]


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_rules_equal_every_rule_tried(spark, seed, monkeypatch):
    monkeypatch.setattr(url_filter, "POINTS", 40)  # many buckets, which long intervals span
    urls, rules = urls_of(random.Random(seed), 600)
    want = sorted(((i, *plain_verdict(u, deduplicated(rules))) for i, u in urls), key=repr)
    assert judged(spark, urls, rules) == want
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", 0)  # by shuffle, keys of many rows salted
    monkeypatch.setattr(url_filter, "HOT", 5)
    assert judged(spark, urls, rules, 5) == want


def test_bounds_place_keys_as_a_search_does(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SIDE", 3)
    bounds = sorted({bytes([rng]) * k for rng in (65, 66, 90, 200) for k in (1, 2, 3)})
    keys = [b"", b"A", b"AA", b"AB", b"BBBB", b"Z", b"\xff", b"\xc8\xc8\xc8", b"\x00"]
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "at binary").withColumn("n", url_filter.bucket(F.col("at"), bounds))
    assert {bytes(r.at): r.n for r in rows.collect()} == {k: sum(b <= k for b in bounds) for k in keys}


def test_urls_that_are_odd(spark):
    rules = [*url_filter.RULES, ("", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("org", "/", None)]
    urls = [
        (1, None), (2, ""), (3, "no scheme/en/"), (4, "http://www.Example.COM/en/x"), (5, "http://xexample.com/en/"), (6, "http://com"), (7, "http://com/"),
        (8, "http:///en/"), (9, "http://" + "a." * 60_000 + "com/" + "y" * 100_000), (10, "http://example.com./en/"), (11, "http://u@example.com:80/en/"),
        (12, "http://a.net/es?x=/es/"), (13, "http://a.net/es/"), (13, "http://a.net/es/"), (None, "http://b.org/"), (14, "https://é.com/"), (15, "http://ÉX.com/É"),
    ]
    live = [r for r in rules if None not in r]
    assert judged(spark, urls, rules) == sorted(((i, *plain_verdict(u, live)) for i, u in urls), key=repr)
    assert judged(spark, [], rules) == []
    assert judged(spark, urls, [("", "", "allow")])[0][4] == "allow"
    nothing = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judged(nothing, url_filter.rules_of(spark).limit(0), "block").collect()] == [(1, "a", "/b", None, "block")]


def test_keys_are_swept_once_and_no_further_than_rules_reach(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(url_filter, "swept", lambda points, rules, bounds, f=url_filter.swept: seen.append(points.count()) or f(points, rules, bounds))
    urls = [(i, f"http://host.example.com/en/{i}") for i in range(500)]
    assert {r[3] for r in judged(spark, urls, url_filter.RULES)} == {"example.com/en/"}
    assert seen == [3]  # com, example.com and host.example.com, each with /en/


def plain_negatives(rows, k=5, m=3):
    """rows: id, label (of the query), vector."""
    xs = {i: np.array([math.floor(256 * np.float64(np.float32(c))) for c in v]) for i, _, v in rows}
    label = {i: (y + 1) % 10 if i % 7 == 0 else y for i, y, _ in rows}
    out = []
    for a in [i for i in xs if i % 50 == 0]:
        score = {i: int(xs[a] @ xs[i]) for i in xs if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:k]:
            good = [i for i in order if label[i] != label[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(good[:m], 1)]
    return sorted(out)


@pytest.mark.parametrize("first", [4, 9])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, first):
    monkeypatch.setattr(negatives, "FIRST", first)
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, registry.QUERIES["op13_hard_negatives"](spark, SF).collect()))
    assert got == plain_negatives(rows) and got


def mined(given):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(given, F.col("vec_id") % 50 == 0, label)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hard_negatives_with_ties(spark, monkeypatch, seed):
    """Few values, so that scores tie; small blocks, so that they meet in many groups; pairs gathered in small parts."""
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "AT_ONCE", 2)
    monkeypatch.setattr(negatives, "GATHERED", 7)
    monkeypatch.setattr(negatives, "FIRST", seed)
    monkeypatch.setattr(negatives, "SPARSE", 0.4)
    rng = random.Random(seed)
    rows = [(10 * i, rng.randint(0, 2 if seed == 1 else 0), [rng.choice([-0.5, 0.0, 0.01, 0.25, 1.0]) for _ in range(3)]) for i in range(1200)]
    got = sorted(map(tuple, mined(table(spark, [(i, v, y) for i, y, v in rows])).collect()))
    assert got == plain_negatives(rows) and len(got) > 100


def test_hard_negatives_of_odd_rows(spark):
    rows = [(50, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.8, 0.4], 2), (3, [0.7, 0.4], 3), (4, [0.9, 0.3], 1)]
    odd = [(5, [1.0, 0.5], None), (6, None, 2), (8, [0.8, None], 2), (9, [0.8, NAN], 2), (11, [INF, 0.1], 2), (12, [], 2), (13, [0.8, 0.4, 0.1], 2), (2, [0.8, 0.4], 2), (None, [0.8, 0.4], 2)]
    want = sorted(map(tuple, mined(table(spark, rows)).collect()))
    assert want == plain_negatives([(i, y, v) for i, v, y in rows]) and want
    got = list(map(tuple, mined(table(spark, rows + odd)).collect()))
    pairs = {r[:2] for r in want}
    assert [sorted(r[3] for r in want if r[:2] == p) for p in sorted(pairs)] == [sorted(r[3] for r in got if r[:2] == p and r[3] is not None) for p in sorted(pairs)]
    lists = [[r[3] for r in sorted((r for r in got if r[:2] == pair), key=lambda r: r[2])] for pair in {r[:2] for r in got}]
    assert any(None in ids for ids in lists)
    assert all(ids.index(2) + 1 == ids.index(None) for ids in lists if None in ids)  # a null id comes after equal scores
    assert mined(table(spark, [])).count() == 0 and mined(table(spark, [(1, [1.0], 1)])).count() == 0
    with pytest.raises(Exception, match="too large"):
        mined(table(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)])).count()


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [0.9, 0.1], 1), (1, [0.8, 0.0], 2)]
    got = sorted(map(tuple, mined(table(spark, rows)).collect()))
    assert [r[:2] for r in got] == [(50, 50)] * 2 and {r[3] for r in got} == {1}


def test_candidates_go_before_their_last_planes():
    """Most pairs never get to the exact product."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    block, added = negatives.Block(x), []
    block.plane = lambda anchors, a, r, at, f=block.plane: added.append((at, len(a))) or f(anchors, a, r, at)
    a, r, score = negatives.best_of(block, np.arange(4000), x[:50], 6)
    want = x[:50] @ x.T
    assert (score == want[a, r]).all()
    for i in range(50):
        kept = set(r[a == i])
        assert set(np.argsort(-want[i], kind="stable")[:6]) <= kept
    sizes = [n for _, n in sorted(added, reverse=True)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < 0.02 * 50 * 4000 and len(a) < 0.005 * 50 * 4000


def test_vectors_of_the_most_frequent_length(spark):
    rows, d = vectors.integers(table(spark, [(1, [0.5], 1), (2, [0.5, -0.001], 1), (3, [1.0, 2.0], 1)]), "embedding", {"key": F.col("vec_id")})
    assert d == 2 and {r.key: r.x for r in rows.collect()} == {2: [128, -1], 3: [256, 512]}
