"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import public_tokenizers as P
from glossmill.llm import binary_out, bpe, common, components, decontam, langid, quality, registry, secret_scan, sharding, simhash, token_edits, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.read_ranks(P.path(bpe.VOCABULARY)))


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_encoder_equals_the_library(encoder, library):
    rng = random.Random(1)
    for alphabet in ("abcdeéß 'st12  \n\t!?日本👍zthein ing", "aehinrst", "ab", " ", "'rsve "):
        for _ in range(300):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))
            ids = encoder.encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
            assert encoder.decode(ids).decode() == t
    assert np.frombuffer(encoder.encode("".join(rng.choice("aehinrst") for _ in range(50_000))), "<u4").size


def test_splitting_is_that_of_the_pattern():
    import regex

    rng, cut, plain = random.Random(6), bpe.splitter(), regex.compile(P.PATTERN).findall
    every = [chr(i) for i in range(128)]
    wide = every + list("éß日本١²Ⅷ½ǅ\u0301\u00a0\u2003\u3000\u0085\u200b👍ªº")
    for alphabet in (every, wide, list("'srtvemld  \n"), list("'LLl ve1a\t\x1c\x1f\x0b")):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
            assert cut(t) == plain(t), t
    assert bpe.splitter(r"\w+")("a b") == ["a", "b"]


def test_encoder_survives_emptied_memories(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 20)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    own = bpe.Encoder(bpe.read_ranks(P.path(bpe.VOCABULARY)))
    for k in range(30):  # texts that share pieces with what is remembered, and have more than there is room for
        t = " ".join(f"word{i % (k + 3)} inging{i}tionable" for i in range(200 if k % 3 else 8))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        assert len(own.pieces) <= 20


def test_encoder_takes_pieces_longer_than_its_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 30)
    own = bpe.Encoder(bpe.read_ranks(P.path(bpe.VOCABULARY)))
    for t in ("the cat", "the cat " + "ab" * 40 + " sat", "sat the " + "x" * 200, "the " + "cd" * 20):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        assert token_edits.counted(own, own.split(t)) == [len(library.encode_ordinary(p)) for p in own.split(t)]


def test_round_trips(spark, rows, library):
    got = {r.doc_id: r for r in registry.QUERIES["op4_byte_bpe"](spark, SF).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_decode(spark, docs, rows):
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == dict(rows)


def stored(tree):
    """The tree as it is read from the state again."""
    return token_edits.PieceTree(*tree.flat())


def test_edits_equal_a_new_count(encoder, monkeypatch):
    rng = random.Random(5)
    alphabet = "abc de's  re \n\t!?12é日  "
    for k in range(800):
        monkeypatch.setattr(token_edits, "LEAF", rng.choice([2, 3, 64]))
        t = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 40, 900])))
        tree = token_edits.PieceTree(t, *token_edits.PieceTree.built(encoder, t)[:3])
        for _ in range(5):
            a = rng.randint(0, len(t) + 2)
            b, new = a + rng.choice([0, 1, 3, 10, -2, 500]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 30])))
            at = min(a, len(t))
            t = t[:at] + new + t[max(at, min(b, len(t))) :]
            tree.edit(encoder, a, b, new)
            pieces = encoder.split(t)
            assert tree.total == sum(token_edits.counted(encoder, pieces)) and tree.chars[1] == len(t) and tree.n_pieces == len(pieces)
            text, chars, tokens, _ = tree.flat()
            assert text == t and token_edits.unpacked(chars, 0, len(pieces)) == [len(p) for p in pieces]
            assert token_edits.unpacked(tokens, 0, len(pieces)) == token_edits.counted(encoder, pieces)
            if rng.random() < 0.4:
                tree = stored(tree)


def test_pieces_too_long_for_a_byte(encoder):
    t = "short " + "x" * 1000 + " and more " * 50
    tree = token_edits.PieceTree(t, *token_edits.PieceTree.built(encoder, t)[:3])
    tree.edit(encoder, len(t), len(t), " end")
    tree = stored(tree)
    tree.edit(encoder, 3, 300, "")
    assert tree.flat()[0] == (t + " end")[:3] + (t + " end")[300:] and tree.total == len(encoder.encode(tree.flat()[0])) // 4


def test_edits_touch_little(encoder, library):
    """Work follows the edit, not the document: the same edits in texts of any size touch as many pieces and leaves."""
    seen = []
    for words in (2_000, 20_000, 200_000):
        rng = random.Random(1)
        t = " ".join(rng.choice(["alpha", "beta", "it's", "of", "gamma,", "7 x"]) for _ in range(words))
        tree = token_edits.PieceTree(t, *token_edits.PieceTree.built(encoder, t)[:3])
        encoded, splits = [], []
        one = type(
            "One", (),
            {
                "pattern": type("Pattern", (), {"finditer": lambda self, x, at: splits.append(len(x)) or encoder.pattern.finditer(x, at)})(),
                "ids_of": lambda self, p: encoded.extend(p) or encoder.ids_of(p),
            },
        )()
        for at in (10, len(t) // 2, len(t) - 5):
            tree.edit(one, at, at + 7, "EDIT ed's")
        touched = sum(leaf.text is not None for leaf in tree.leaves)
        assert len(encoded) <= 40 and max(splits) <= 2000 and touched <= 9
        seen.append(len(encoded))
        assert tree.total == len(library.encode_ordinary(tree.flat()[0]))
    assert max(seen) - min(seen) <= 12


def test_query_edits_the_kept_state(spark, docs, library, monkeypatch):
    """Edits start from what is stored: sums that are forged there come through."""
    state = token_edits.build_state(docs.limit(5)).cache()
    edited = {r.doc_id: r for r in token_edits.apply_listed(token_edits.sample_edits(state)).collect()}
    assert all(r.n_tokens == len(library.encode_ordinary(r.text)) and r.n_reencoded <= 80 for r in edited.values())
    again = token_edits.apply_listed(
        token_edits.sample_edits(spark.createDataFrame(list(edited.values())).select(*state.columns))
    ).collect()
    assert all(r.n_tokens == len(library.encode_ordinary(r.text)) for r in again)
    got = {r.doc_id: r for r in registry.QUERIES["op3_token_counts"](spark, SF).collect()}
    assert all(got[i].n_tokens == r.n_tokens for i, r in edited.items())


def test_edit_logs(spark, library):
    docs = spark.createDataFrame([(1, "one two three"), (2, "untouched"), (3, None)], "doc_id long, text string")
    log = spark.createDataFrame(
        [(1, 2, 0, 3, "ONE"), (1, 1, 13, 13, " four"), (3, 1, 0, 0, "new"), (9, 1, 0, 0, "?")],
        "doc_id long, number int, start int, end int, text string",
    )
    state = token_edits.apply_edits(token_edits.build_state(docs), log)
    got = {r.doc_id: r for r in state.collect()}
    assert {i: r.text for i, r in got.items()} == {1: "ONE two three four", 2: "untouched", 3: "new"}
    assert all(r.n_tokens == len(library.encode_ordinary(r.text)) for r in got.values())
    again = token_edits.apply_edits(state, log.filter("doc_id = 1").withColumn("text", F.lit("x")))
    assert all(r.n_tokens == len(library.encode_ordinary(r.text)) for r in again.collect())


def spans_of(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark):
    rng = random.Random(7)
    parts = [
        "token=", "secret: ", "api_key = '", "PASSWORD=\"", "AKIA", "abc", "deadbeef", "0123456789abcdef", "é👍", " ", "ABCDEFGHIJKLMN",
        "\n", "=", "eyJ", ".", "token",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.with_spans(docs, secret_scan.blob_findings(docs))).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(spans_of(t).encode()).hexdigest(), t


def test_ledger_scans_only_what_it_lacks(spark):
    first = spark.createDataFrame([("a", 1, "token=abcdefabcdef"), ("b", 1, "nothing")], "path string, version int, text string")
    later = spark.createDataFrame(
        [("c", 2, "token=abcdefabcdef"), ("a", 2, "password = supersecret99")], "path string, version int, text string"
    )
    one = secret_scan.extend_ledger(first, packs={"base-1": secret_scan.BASE})
    assert one.count() == 2 and one.filter("size(spans) > 0").count() == 1
    both = secret_scan.extend_ledger(later, ledger=one, packs={"base-1": secret_scan.BASE}).cache()
    assert both.count() == 3  # a blob that was seen isn't scanned again
    everything = secret_scan.extend_ledger(later, ledger=both)
    assert everything.groupBy("pack").count().collect() and everything.filter("pack = 'providers-1'").count() == 2
    paths = secret_scan.with_spans(
        first.unionByName(later), secret_scan.blob_findings(None, ledger=both)
    ).select("path", "version", F.size("spans").alias("n")).collect()
    assert {(r.path, r.version): r.n for r in paths} == {("a", 1): 1, ("b", 1): 0, ("c", 2): 1, ("a", 2): 1}
    forged = both.withColumn("spans", F.array().cast(secret_scan.SPAN))  # were the blob scanned again, it would be found
    assert secret_scan.extend_ledger(first, ledger=forged, packs={"base-1": secret_scan.BASE}).filter("size(spans) > 0").count() == 0


def test_findings_scan_what_the_ledger_lacks(spark):
    first = spark.createDataFrame([(1, "token=abcdefabcdef"), (2, "nothing")], "doc_id long, text string")
    later = spark.createDataFrame(
        [(3, "password = supersecret99"), (4, "token=abcdefabcdef"), (5, "ghp_" + "a1B2" * 9)], "doc_id long, text string"
    )
    one = secret_scan.extend_ledger(first, packs={"base-1": secret_scan.BASE})
    spans = lambda ledger: {
        r.doc_id: r.spans for r in secret_scan.digest(
            secret_scan.with_spans(later, secret_scan.blob_findings(later, ledger=ledger))
        ).collect()
    }
    assert spans(one) == spans(None) and all(spans(one).values())
    forged = one.withColumn("spans", F.array().cast(secret_scan.SPAN))  # a pair that was scanned isn't scanned again
    assert {i for i, s in spans(forged).items() if s} == {3, 5}


def test_secret_query_and_stage_extend_a_ledger(spark, docs, rows, monkeypatch):
    """Each pair of a text and a pack is scanned once."""
    import corpus_pipeline

    made, new_pairs = [], secret_scan.new_pairs
    monkeypatch.setattr(secret_scan, "new_pairs", lambda *a, **b: made.append(new_pairs(*a, **b)) or made[-1])
    distinct = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    for run in (lambda: registry.op5_secret_scans(spark, SF), lambda: corpus_pipeline.secret_scans(spark, docs, SF)):
        made.clear()
        run()
        pairs = [(r.blob, r.pack) for m in made for r in m.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(b, p) for b in distinct for p in secret_scan.PACKS}


@pytest.fixture
def no_automatic_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_known_blobs_do_not_move(spark, docs, rows, monkeypatch):
    distinct = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    full = secret_scan.ledger_of([(docs, secret_scan.PACKS)])
    assert full.count() == 2 * len(distinct) and secret_scan.new_pairs(docs, ledger=full).count() == 0
    known = sorted(distinct)[5:]
    some = full.filter(F.col("blob").isin(known))
    new = {r.blob for r in secret_scan.new_pairs(docs, ledger=some).collect()}
    assert new == distinct - set(known)
    lacking = secret_scan.unseen(docs.select(secret_scan.content_address("text").alias("blob")).distinct(), some, list(secret_scan.PACKS))
    moved = secret_scan.blobs(docs, "text", lacking)
    assert {r.blob for r in moved.collect()} == new
    lines = plan_of(moved).split("\n")  # the pick stands below the exchange of contents
    assert next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(blob" in x) < next(i for i, x in enumerate(lines) if "LeftSemi, BuildRight" in x)
    monkeypatch.setattr(secret_scan, "PICKED", 0)  # too many to pick by broadcast
    assert {r.blob for r in secret_scan.new_pairs(docs, ledger=some).collect()} == new


def test_findings_are_laid_on_rows_where_they_are(spark, docs, monkeypatch, no_automatic_broadcasts):
    found = secret_scan.scanned(docs)
    few = secret_scan.redacted(docs, found)
    assert "Exchange hashpartitioning" not in plan_of(few)
    want = sorted(map(repr, few.collect()))
    monkeypatch.setattr(secret_scan, "FOUND", 0)
    many = secret_scan.redacted(docs, found)
    assert "Exchange hashpartitioning" in plan_of(many) and sorted(map(repr, many.collect())) == want


def test_stages_leave_rows_where_they_are(spark, docs, monkeypatch, no_automatic_broadcasts):
    """Few that go are broadcast as numbers; more are found by a join of all, to the same rows."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    for run in (simhash.first_of_each, lambda d: decontam.clean(d, benchmark)):
        few = run(docs)
        assert "Exchange hashpartitioning" not in plan_of(few)
        want = sorted(map(repr, few.collect()))
        with monkeypatch.context() as m:
            m.setattr(common, "FEW", 0)
            assert sorted(map(repr, run(docs).collect())) == want and 0 < len(want) < docs.count()
        assert sorted(map(repr, run(docs.repartition(3)).collect())) == want  # not from files


def test_a_ledger_goes_on_where_it_was(spark, tmp_path):
    at = str(tmp_path / "ledger")
    first = spark.createDataFrame([("token=abcdefabcdef",), ("nothing",)], "text string")
    later = spark.createDataFrame([("token=abcdefabcdef",), ("secret: 0123456789abcdef",)], "text string")
    base = {"base-1": secret_scan.BASE}
    assert secret_scan.ledger_of([(first, base)], at=at).count() == 2
    assert secret_scan.ledger_of([(later, base)], at=at).count() == 3
    assert secret_scan.ledger_of(
        [(later, secret_scan.PACKS)], at=at
    ).groupBy("pack").count().orderBy("pack").collect() == [("base-1", 3), ("providers-1", 2)]


def test_redaction(spark):
    r = spark.createDataFrame([("é token=abcdefabcdef0123 end",), ("clean",), (None,)], "text string").withColumn("doc_id", F.lit(1))
    rows = secret_scan.with_spans(r, secret_scan.blob_findings(r))
    assert {
        x[0] for x in rows.select(F.when(F.col("text").isNotNull(), secret_scan.redact(F.col("text"), F.col("spans")))).collect()
    } == {"é <secret> end", "clean", None}


def brute_contamination(docs, items):
    """Every item laid on every place of every document."""
    toks = lambda t: re.split(r"[^\w]+|_+", t.lower())
    number: dict[str, int] = {}
    ids = lambda w: np.array([number.setdefault(x, len(number)) for x in w], int)
    out = set()
    for i, t in docs:
        w = ids(toks(t))
        for j, b in items:
            x = ids([y for y in toks(b) if y])
            n, width = len(x), min(decontam.MIN_OVERLAP, len(x))
            if n < decontam.LEAST_TOKENS:
                continue
            padded = np.concatenate([np.full(n, -1), w, np.full(n, -1)])
            same = np.lib.stride_tricks.sliding_window_view(padded, n) == x
            sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
            if ((sums[:, width:] - sums[:, :-width]).max() >= 0.8 * width - 1e-9):
                out.add((i, j))
    return out


def test_decontamination(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 50)))) for k in range(20)]
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 3:
            x = items[i % 20][1].split()
            for _ in range(int(len(x) * rng.choice([0, 0.05, 0.15, 0.3]))):
                x[rng.randrange(len(x))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = x
        docs.append((i, " ".join(w).replace("w1 ", "W1, ")))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got == brute_contamination(docs, items)
    planted = {
        (i, i % 20) for i, t in docs if i % 3 and len(items[i % 20][1].split()) > 4 and " ".join(
            re.split(r"\W+", items[i % 20][1])
        ) in " ".join(re.split(r"\W+", t.lower()))
    }
    assert planted <= got
    small = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b, block_rows=200).collect()}
    assert small == got  # blocks change nothing
    joined = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b, block_rows=200, most_blocks=1).collect()}
    assert joined == got  # nor does a join by shuffle


def test_decontamination_at_the_edges(spark):
    items = [(n, " ".join(f"{c}{n}" for c in "abcdefg"[:n])) for n in (5, 6, 7)]
    docs = []
    for n, text in items:
        w = text.split()
        for part in (w[1:], w[:-1], w[2:], w[:-2]):
            docs += [
                (len(docs), " ".join(part)), (len(docs) + 1, " ".join([*part, "more", "words", "here"])),
                (len(docs) + 2, " ".join(["more", "words", "here", *part])),
            ]
    got = {
        (r.doc_id, r.item_id) for r in decontam.contaminated(
            spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        ).collect()
    }
    assert got == brute_contamination(docs, items) and {(0, 5), (3, 5)} <= got


def test_decontamination_of_shared_and_missing_ids(spark):
    one, two, three = "a b c d e f g h i", "k l m n o p q r s", "t u v w x y z aa bb"
    items = spark.createDataFrame([(1, one), (1, two), (1, two), (None, three)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, one), (2, two), (3, three), (4, "nothing of the kind"), (5, "a b c d e f changed changed changed"), (5, one)],
        "doc_id long, text string",
    )
    assert {(r.doc_id, r.item_id, r.matched) for r in decontam.contaminated(docs, items).collect()} == {(1, 1, 9), (2, 1, 9), (5, 1, 9)}
    # each row by its own text: of the two rows with id 5 the clean one stays
    assert sorted((r.doc_id, r.text[:9]) for r in decontam.clean(docs, items).collect()) == [(4, "nothing o"), (5, "a b c d e")]


def test_masks_lose_nothing():
    """Whichever tokens of a stretch are substituted, within the similarity, one of the masks meets the others."""
    import math
    from itertools import combinations

    for n in range(decontam.SHORT, decontam.MIN_OVERLAP + 1):
        seeds = [sum(1 << k for k, c in enumerate(m) if c == "1") << at for m in decontam.MASKS for at in range(n - len(m) + 1)]
        for errors in combinations(range(n), n - math.ceil(decontam.SIMILARITY * n - 1e-9)):
            bits = sum(1 << e for e in errors)
            assert any(not bits & s for s in seeds), (n, errors)


def test_shards(spark, docs):
    rows = sharding.shard(docs, sharding.TREE, sharding.GROWN).collect()
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and any(r.grown_shard == 8 for r in rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)


def test_shards_follow_weights_and_move_little(spark):
    from dataclasses import replace

    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    tree = sharding.topology(2, 2, 2)
    r0 = tree.children[0]
    k0 = r0.children[0]
    heavier = replace(
        tree,
        children=(
            replace(r0, children=(replace(k0, children=(replace(k0.children[0], leaf_weight=3.0), k0.children[1])), r0.children[1])),
            tree.children[1],
        ),
    )
    a = {r.doc_id: r.shard for r in sharding.shard(ids, tree).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(ids, heavier).collect()}
    share = lambda m, s: sum(v == s for v in m.values()) / 20_000
    assert all(abs(share(a, s) - 0.125) < 0.01 for s in range(8)) and abs(share(b, 0) - 0.3) < 0.02
    # region 1's inner shares don't change: what leaves it goes to region 0, nothing moves inside it
    assert all(not (a[i] >= 4 and b[i] >= 4 and a[i] != b[i]) for i in a) and all(not (a[i] < 4 <= b[i]) for i in a)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    s = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("aB É \t\nx ") for _ in range(rng.randint(0, 40)))
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def clusters(points, limit):
    label = list(range(len(points)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i, p in enumerate(points):
        for j in range(i):
            if (p ^ points[j]).bit_count() <= limit and find(i) != find(j):
                label[find(i)] = find(j)
    return [find(i) for i in range(len(points))]


def some_points(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set()
    while len(out) < n:
        p = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return sorted(out)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("leaf, dense", [(8, 10**9), (8, 20), (10**6, 10**9)])
def test_search_finds_every_link(monkeypatch, leaf, dense):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "DENSE", dense)
    points = some_points(600, 9)
    a, b = simhash.search(np.array(points, np.uint64), np.ones(len(points), bool), 2)
    stars = simhash.Stars(len(points))
    at = {p: i for i, p in enumerate(points)}
    stars.link(np.array([at[int(x)] for x in a], int), np.array([at[int(x)] for x in b], int))
    assert same_partition(stars.label.tolist(), clusters(points, 2))


def test_shards_of_the_tree_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARDS", ((60, None),))
    monkeypatch.setattr(simhash, "ASKED", 1)  # most shards are dealt to several parts
    points = some_points(900, 12)
    df = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in points], "fp long")
    found = components.components(simhash.links(df, len(points), 2))
    root = {r.node % (1 << 64): r.root for r in found.collect()}
    assert same_partition([root.get(p, p) for p in points], clusters(points, 2))


def test_rows_sent_and_largest_group_of_many_points():
    """Uniform points, for which bounds prune least: few visits, and no group far above the mean."""
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 64, 1 << 20, dtype=np.uint64)
    shards = simhash.n_shards(len(points))
    sample = rng.choice(points, simhash.SAMPLE * shards, replace=False)
    nodes = simhash.grow(sample, shards, 2)
    parts = simhash.parts_of(nodes, sample, 2)
    sent = simhash.dealt(points, nodes, parts, 2)
    groups = np.bincount(sent["shard"] * 1000 + sent["part"])
    assert len(points) < len(sent["fp"]) <= 3 * len(points) and groups.max() <= 4 * len(points) / shards
    # each point is at home in one shard, in all of its parts, and asks once in each shard that it is sent to
    home = sent["home"]
    assert len(np.unique(sent["shard"][home] * (1 << 21) + np.searchsorted(np.sort(points), sent["fp"][home].view(np.uint64)))) == len(points)
    assert sent["asks"].sum() == len(simhash.route(nodes, points, 2)[0]) and sent["asks"][~home].all()
    # near pairs that lie in different shards meet
    near = points[:20_000] ^ (np.uint64(1) << rng.integers(0, 64, 20_000, dtype=np.uint64))
    places = [dict(zip(*(lambda d: (d["fp"][d["home"]].tolist(), d["shard"][d["home"]].tolist()))(simhash.dealt(x, nodes, parts, 2)))) for x in (points[:20_000], near)]
    visits = [simhash.dealt(x, nodes, parts, 2) for x in (points[:20_000], near)]
    seen = [set(zip(v["fp"].tolist(), v["shard"].tolist())) for v in visits]
    for a, b in zip(points[:20_000].view(np.int64).tolist(), near.view(np.int64).tolist()):
        assert (a, places[1][b]) in seen[0] or (b, places[0][a]) in seen[1]


def test_shards_grow_with_the_points():
    assert [simhash.n_shards(n) for n in (0, 100, 20_000, 1 << 20, 1 << 23, 1 << 28, 1 << 30)] == [1, 1, 2, 8, 64, 64, 256]


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(300))


def test_near_duplicates_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    texts = ["a b c d e f g"] * 10 + ["h i j k l"] * 2 + ["other words stand here", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(d).collect()}
    assert got == {**dict.fromkeys(range(10), 0), 10: 10, 11: 10, 12: 12, 13: 13, 14: 13}
    assert sorted(r.doc_id for r in simhash.first_of_each(d).collect()) == [0, 10, 12, 13]


def test_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4097, 100_003):
        x = np.arange(n)
        y = binary_out.permuted(x, n)
        assert sorted(y.tolist()) == x.tolist() and (binary_out.permuted(y, n, back=True) == x).all()
    assert (binary_out.permuted(np.arange(1000), 1000, key=1) != binary_out.permuted(np.arange(1000), 1000, key=2)).any()


def files_of(table):
    return {f: open(f.removeprefix("file:"), "rb").read() for f in {r.file for r in table}}


@pytest.mark.parametrize("shard_slots", [50, 100_000])
def test_written_order_is_in_the_files(spark, docs, rows, library, shard_slots):
    """Records read at their offsets, put back into the order before the permutation, are all documents' ids."""
    size, end = 128, 50256
    table = sorted(binary_out.written_order(docs, length=size, shard_slots=shard_slots, bucket_ids=20_000).collect(), key=lambda r: r.slot)
    n, files, stride = len(table), files_of(table), 16 + 2 * size + 1
    assert [r.slot for r in table] == list(range(n)) and len(files) == -(-n // shard_slots) and sum(map(len, files.values())) == n * stride
    found = {}
    for r in table:
        data = files[r.file][r.offset : r.offset + stride]
        assert f"/shard={r.slot // shard_slots}/" in r.file and r.shard == r.slot // shard_slots and data[-1:] == b"\n"
        assert int.from_bytes(data[:8], "big") == r.slot and int.from_bytes(data[8:12], "big") == r.n_tokens
        assert int.from_bytes(data[12:16], "big") == r.crc32 == zlib.crc32(data[16:-1])
        ids = np.frombuffer(data[16:-1], "<u2").tolist()
        assert ids[r.n_tokens :] == [end] * (size - r.n_tokens)
        found[r.slot] = ids[: r.n_tokens], r.doc_ids
    order = binary_out.permuted(np.arange(n), n).tolist()
    whole, named = [], []
    for slot in order:
        ids, of = found[slot]
        assert len(of) == ids.count(end) + (ids[-1] != end) if ids else not of
        whole += ids
        for i in of:
            if not named or named[-1] != i:
                named.append(i)
    text, at, got = dict(rows), 0, []
    for i in named:
        stop = whole.index(end, at)
        assert whole[at:stop] == library.encode_ordinary(text[i])
        got.append(i)
        at = stop + 1
    assert sorted(got) == sorted(text) and at == len(whole)


def test_slots_do_not_depend_on_the_layout(spark, docs):
    """The same rows in other files, orders and numbers of partitions have the same slots; copies of a row too."""
    rows = docs.select("doc_id", "text").unionByName(
        docs.select("doc_id", "text").limit(1).crossJoin(spark.range(30)).select("doc_id", "text")
    )
    tables = [rows.repartition(2), rows.repartition(4).orderBy(F.desc("text")), rows.coalesce(1)]
    for hot in (None, 3):
        made = [
            sorted(
                (r.slot, r.n_tokens, tuple(r.doc_ids), r.crc32) for r in binary_out.written_order(
                    t, length=64, bucket_ids=5_000, hot_copies=hot
                ).collect()
            ) for t in tables
        ]
        assert made[0] == made[1] == made[2]
        assert sum(x[1] for x in made[0]) == sum(
            r.n for r in binary_out.tokenised(rows, bpe.read_ranks(P.path(bpe.VOCABULARY)))[0].select("n").collect()
        )


def test_records_are_read_back(spark, docs, tmp_path):
    at = str(tmp_path / "shards")
    table = {r.slot: r for r in binary_out.written_order(docs, length=64, shard_slots=50, at=at).collect()}
    back = binary_out.read_back(spark, at, length=64).collect()
    assert {r.slot: (r.n_tokens, r.crc32) for r in back} == {s: (r.n_tokens, r.crc32) for s, r in table.items()}
    assert all(zlib.crc32(r.ids) == r.crc32 for r in back)
    assert sorted(r.slot for r in binary_out.read_back(spark, at, length=64, shard=1).collect()) == list(range(50, min(100, len(table))))


def test_long_runs_of_white_space_are_tokenised(encoder):
    pieces = binary_out.pieces_of(bpe.read_ranks(P.path(bpe.VOCABULARY)), 2)
    for t in (" " * 300_000 + "x", "\n \t" * 50_000, "ab" * 50_000):
        assert np.frombuffer(pieces.encode(t), "<u2").tolist() == np.frombuffer(encoder.encode(t), "<u4").tolist()


def test_texts_are_tokenised_by_words_as_the_library_does(library):
    """Wherever white space stands, and in batches of any size; parts of an array too."""
    pieces, mark, rng = binary_out.pieces_of(bpe.read_ranks(P.path(bpe.VOCABULARY)), 2), b"\x50\xc4", random.Random(12)
    words = ["a", "the", "x1", "12", "'s", "'ll", "...", ",", "é", "漢字", "👍", "\x00", "<|endoftext|>", "\u200b", "\u180e", "\ufeff"]
    white = [" ", "  ", "   ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000"]
    texts = ["".join(rng.choices(words + white + [" "] * often, k=rng.randrange(30))) for often in (0, 16, 80) for _ in range(3000)]
    texts += ["", " ", "  ", "a ", " a", "x" * 3000 + " y " + "z" * 1000, "a" + "\n" * 5000 + "b c", "a" + " " * 300_000 + "b c"]
    made = [np.array([*library.encode_ordinary(t), 50256], "<u2").tobytes() for t in texts[:-1]] + [pieces.encode(texts[-1]) + mark]
    whole = pa.array(texts)
    assert pieces.ended(whole, mark).to_pylist() == made
    assert pieces.ended(whole.slice(10, 500), mark).to_pylist() == made[10:510]
    assert [x for i in range(200) for x in pieces.ended(whole.slice(i, 1), mark).to_pylist()] == made[:200]


def test_a_word_is_tokenised_once_in_many_texts(spark, monkeypatch):
    """What is encoded are different words, however often they come, and whatever white space stands between."""
    pieces, mark = binary_out.pieces_of(bpe.read_ranks(P.path(bpe.VOCABULARY)), 2), b"\x50\xc4"
    seen, sent, split, library = [], [], pieces.split, pieces.library
    monkeypatch.setattr(pieces, "split", lambda t: seen.append(len(t)) or split(t))

    class Counted:
        def encode_to_numpy(self, text, **options):
            sent.append(len(text))
            return library.encode_to_numpy(text, **options)

    monkeypatch.setattr(pieces, "library", Counted())
    texts = [f"Some words, and some words{gap}once more. " * 200 + f"number{i}" for i in range(100) for gap in ("\n", "   ", "\n    ")]
    ids = pieces.ended(pa.array(texts), mark).to_pylist()
    assert ids[7] == b"".join(map(pieces.__getitem__, split(texts[7]))) + mark
    assert sum(sent) < 5000 and sum(seen) < 5000 < sum(map(len, texts)) / 400


def test_small_buckets_share_tasks(spark, docs):
    """Many buckets are fewer tasks, and there are tasks for all cores; slots don't change (see the layouts above)."""
    made, width, pad = binary_out.tokenised(docs, bpe.read_ranks(P.path(bpe.VOCABULARY)))
    cores = spark.sparkContext.defaultParallelism
    for buckets in (1, 7, 20 * cores, 100 * cores):
        rows = binary_out.dealt(made, buckets, 1000)
        tasks = binary_out.packed(rows, buckets, 128, width, pad, binary_out.KEY)[0].rdd.getNumPartitions()
        assert min(buckets, 4 * cores) <= tasks <= max(buckets / 8 + 1, 8 * cores)


def test_written_order_of_no_rows_and_null_ids(spark):
    table = spark.createDataFrame([(None, "some text"), (5, None), (-3, "")], "doc_id long, text string")
    (row,) = binary_out.written_order(table, length=8).collect()
    assert sorted(row.doc_ids, key=str) == [-3, 5, None] and row.n_tokens == 5
    assert binary_out.written_order(table.limit(0)).count() == 0


def test_quality_figures(spark, docs, rows):
    rng = random.Random(8)
    texts = [t for _, t in rows[:60]] + [
        "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))) for _ in range(100)
    ]
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = {}
        for i in range(len(w) - 7):
            windows.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = quality.judged(t)
        assert got[:5] == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert got[5] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (got[5] and got[6])


def test_quality_verdicts():
    prose = "This is a sentence that goes on for a while, as they do. Another one follows it here."
    assert quality.judged(
        f"{prose}\nA third one, of other words, stands on the second line of it.\nAll rights reserved."
    )[6:10] == (True, 0, 0, 1)
    assert quality.judged("Home | News | Sport | Weather | Contact | About | Login | Search | Help | Shop | More")[6] is False
    assert quality.judged("\n".join(["*** buy *** now *** it *** is *** cheap *** today ***"] * 3))[6] is False
    assert quality.judged(f"{prose}\nHome | News | Sport | More")[11] == prose
    assert quality.judged(
        "We talked for an hour about how a browser keeps each cookie, and why a page may ask for one before it shows anything."
    )[9] == 0
    assert quality.judged(f"{prose}\nAlle Rechte vorbehalten.\n{prose} And more of it.")[9] == 1


def test_lines_of_many_texts_are_boilerplate(spark):
    """Evidence is counted over different texts and neighbours; copies and near copies are none."""
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice(words) for _ in range(12)) + "."
    texts = [f"{prose()}\n  Wir nutzen Technik von Dritten.\t\n{prose()}" for _ in range(30)]  # among other lines each time
    texts += ["\n".join(["this text is copied.", "and so is this line."])] * 50
    base = [prose() for _ in range(8)]
    texts += ["\n".join([*base[:7], f"{base[7]} {i}"]) for i in range(40)]  # near copies: the same neighbours
    texts += [f"{prose()}\nseldom seen.\n{prose()}" for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert quality.common_lines(df) == {quality.line_hash("Wir nutzen Technik von Dritten.")}
    got = {r.doc_id: r for r in quality.cleaned(df).collect()}
    assert all(got[i].removed_boilerplate == (i < 30) and ("Wir" not in got[i].cleaned) for i in got)
    assert quality.common_lines(df.limit(0)) == frozenset()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.QUERIES["op2_toxicity"](spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id"
    ).filter("held_out").collect()
    good = [r.score for r in rows if r.toxic == 1]
    bad = [r.score for r in rows if r.toxic == 0]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert sum(b >= 0.7 for b in bad) <= 0.02 * len(bad)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_scores_equal_the_formula(spark, docs):
    """The score of each text from its n-grams, the weights and the logistic function; and the weights from their definition."""
    import math

    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    weights, b = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, (weights, b)).collect()}
    every = {i: {g for w in set(t.lower().split()) for g in toxicity.grams(w)} for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    for i, grams in every.items():
        z = b + math.fsum(sorted(weights.get(g, 0.0) for g in grams))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-500, min(500, z))))) < 1e-9
    # log-count ratios of the n-grams by plain counting: the features are those largest in standard errors
    seen = {r.doc_id: r.toxic for r in labels.filter(~toxicity.held_out()).collect()}
    counts, size = {}, [sum(v == c for v in seen.values()) for c in (0, 1)]
    for i, c in seen.items():
        for x in {toxicity.bucket(g) for g in every[i]}:
            counts.setdefault(x, [0, 0])[c] += 1
    ratio = lambda n: abs(math.log((n[1] + 1) / (size[1] + 2) / ((n[0] + 1) / (size[0] + 2)))) / math.sqrt(1 / (n[1] + 1) + 1 / (n[0] + 1))
    ranked = sorted(
        (x for x, n in counts.items() if sum(n) >= toxicity.LEAST_ROWS), key=lambda x: (-ratio(counts[x]), x)
    )[: toxicity.FEATURES]
    least = ratio(counts[ranked[-1]])
    assert {toxicity.bucket(g) for g in weights} <= {x for x, n in counts.items() if ratio(n) >= least - 1e-9}


def plain_logistic(x, y, ridge):
    """Weights and intercept by Newton's steps, both classes weighing the same."""
    x, n = np.hstack([x, np.ones((len(x), 1))]).astype(float), len(x)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        gradient = x.T @ (weight * (p - y)) / n + penalty * w
        curve = (x.T * (weight * p * (1 - p))) @ x / n + np.diag(penalty + 1e-12)
        w = w - np.linalg.solve(curve, gradient)
    return w[:-1], w[-1]


def test_the_solver_equals_newtons():
    rng = np.random.default_rng(3)
    x = ((rng.random((400, 8)) < 0.4) * rng.normal(size=8)).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ rng.normal(size=8)) + 1))).astype(np.float32)
    w, b = toxicity.logistic(x, y)
    want, c = plain_logistic(x, y, toxicity.RIDGE)
    assert np.allclose(w, want, atol=0.02) and abs(b - c) < 0.02


def test_a_whole_fit_by_plain_counting(spark, monkeypatch):
    """Features, their ratios and the weights of 36 texts, from the definitions."""
    import math

    rng = random.Random(8)
    words = ["awful", "vile", "nice", "calm", "tree", "house"]
    rows = [(i, " ".join(rng.choice(words[:4] if rng.random() < 0.7 else words[2:]) for _ in range(4)), rng.randint(0, 1)) for i in range(54)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "FEATURES", 24)
    got = {r.doc_id: r.score for r in toxicity.classified(docs, labels).collect()}
    seen = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    size = [sum(y == c for _, y in seen) for c in (0, 1)]
    every = lambda t: {toxicity.bucket(g) for w in set(t.split()) for g in toxicity.grams(w)}
    counts = {}
    for t, y in seen:
        for g in every(t):
            counts.setdefault(g, [0, 0])[y] += 1
    ratio = {g: math.log((n[1] + 1) / (size[1] + 2) / ((n[0] + 1) / (size[0] + 2))) for g, n in counts.items() if sum(n) >= toxicity.LEAST_ROWS}
    told = lambda g: abs(ratio[g]) / math.sqrt(1 / (counts[g][1] + 1) + 1 / (counts[g][0] + 1))
    kept = sorted(ratio, key=lambda g: (-told(g), g))[:24]
    row = lambda t: [ratio[g] if g in every(t) else 0.0 for g in kept]
    w, b = plain_logistic(np.array([row(t) for t, _ in seen]), np.array([float(y) for _, y in seen]), toxicity.RIDGE)
    for i, t, _ in rows:
        assert abs(got[i] - 1 / (1 + math.exp(-(np.dot(row(t), w) + b)))) < 0.03, t


def test_toxicity_never_sees_held_out_labels(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["op7_language_id"](spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_languages_equal_brute_force(spark, docs):
    """Counts by a plain loop over n-grams, cosines with every centroid, and the nearest one."""
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    mask = (1 << 32) - 1

    def brute(text):
        c = [ord(x) if x.isalpha() else 32 for x in text.lower()]
        out = np.zeros(langid.BUCKETS)
        shift = 32 - langid.BUCKETS.bit_length() + 1
        for i in range(len(c)):
            hashes = [c[i] * 0x9E3779B1 & mask] if c[i] != 32 else []
            if i + 1 < len(c) and (c[i] != 32 or c[i + 1] != 32):
                hashes.append((c[i] * 0x85EBCA6B & mask) ^ ((c[i + 1] * 0xC2B2AE35 & mask) + 1 & mask))
            if i + 2 < len(c) and c[i + 1] != 32:
                hashes.append((c[i] * 0x27D4EB2F & mask) ^ (c[i + 1] * 0x165667B1 & mask) ^ ((c[i + 2] * 0xD3A2646C & mask) + 2 & mask))
            for h in hashes:
                out[(h ^ h >> 15) * 0x2C1B3C6D % (1 << 32) >> shift] += 1
        return out

    for r in docs.limit(25).collect():
        v = np.sqrt(brute(r.text)) * model["idf"]
        cosines = model["vectors"] @ (v / np.linalg.norm(v))
        assert got[r.doc_id].lang_pred == model["langs"][model["of"][int(cosines.argmax())]] and abs(
            got[r.doc_id].score - cosines.max()
        ) < 1e-5


def test_the_fit_of_languages_by_plain_loops(spark):
    """Weights of buckets, centroids and bounds of 45 texts, from the definitions."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"), "lang").limit(45)
    rows = texts.collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    mine = sorted({(r.lang, r.text) for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1})
    counted = {t: langid.counts(t) for _, t in mine}
    counted = {t: c for t, c in counted.items() if c is not None}
    n = sum(t in counted for _, t in mine)
    idf = [math.log((1 + n) / (1 + sum(counted[t][i] > 0 for _, t in mine if t in counted))) + 1 for i in range(langid.BUCKETS)]
    assert np.allclose(model["idf"], idf, atol=1e-5)
    assert model["langs"] == sorted({lang for lang, t in mine if t in counted})
    for place, lang in enumerate(model["langs"]):
        v = [np.sqrt(counted[t]) * np.array(idf) for x, t in mine if x == lang and t in counted]
        v = [x / np.linalg.norm(x) for x in v]
        mean = sum(v) / len(v)
        at = [max(range(len(v)), key=lambda i: v[i] @ mean)]
        while len(at) < min(langid.CENTROIDS, len(v)):  # the one furthest from those that were taken
            at.append(min(range(len(v)), key=lambda i: max(v[i] @ v[j] for j in at)))
        c = [v[i] for i in at]
        for _ in range(10):
            near = [max(range(len(c)), key=lambda k: x @ c[k]) for x in v]
            c = [sum(x for x, k in zip(v, near) if k == j) if j in near else c[j] for j in range(len(c))]
            c = [x / np.linalg.norm(x) for x in c]
        got = model["vectors"][model["of"] == place]
        assert len(got) == len(c) and all(min(np.abs(g - x).max() for x in c) < 1e-4 for g in got)
        least = np.quantile([max(x @ y for y in c) for x in v], 0.01)
        assert np.allclose(model["least"][model["of"] == place], least, atol=1e-4)


def test_languages_are_not_learned_from_held_out_rows(docs):
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(other)
    assert a["langs"] == b["langs"] and (a["vectors"] == b["vectors"]).all() and (a["least"] == b["least"]).all()


def test_far_texts_are_rejected(spark):
    sf = "/root/testdata/sf0.01"
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert langid.judged("это совсем другой язык с другими буквами, которых модель не знает", model)[2]
    assert langid.judged("12345 ---", model) == ("und", 0.0, True)
    long = "word and other words " * 120_000  # read in parts, with the same counts as in one
    whole, langid_chunk = langid.counts(long), langid.CHUNK
    try:
        langid.CHUNK = len(long) * 2
        assert (langid.counts(long) == whole).all()
    finally:
        langid.CHUNK = langid_chunk


def test_far_texts_in_latin_letters_are_rejected(spark):
    import base64

    sf, rng = "/root/testdata/sf0.01", random.Random(4)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    far = [
        "La casa era grande e il giardino pieno di fiori; ogni mattina la nonna apriva le finestre e preparava il caffè per tutti gli ospiti che arrivavano dalla città.",
        "Talvella järvi jäätyy ja lapset luistelevat koko päivän, mutta illalla kaikki kokoontuvat saunan jälkeen takkatulen ääreen kuuntelemaan vanhoja tarinoita.",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)), base64.b64encode(rng.randbytes(3000)).decode(),
    ]
    assert all(langid.judged(t, model)[2] for t in far)
    held = [r.text for r in docs.filter(langid.held_out() & F.col("lang").isNotNull()).select("text").collect()]
    assert sum(langid.judged(t, model)[2] for t in held) <= 0.01 * len(held)  # clean texts stay


def test_pipeline_equals_its_parts_in_plain_python(spark, library):
    import corpus_pipeline

    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    left = sorted((r.doc_id, r.text) for r in docs.collect() if not langid.judged(r.text, model)[2])
    label, first = clusters([brute_fingerprint(t) for _, t in left], 2), {}
    for (i, _), c in zip(left, label):
        first[c] = min(first.get(c, i), i)
    left = [(i, t) for i, t in left if i in set(first.values())]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute_contamination(left, items)}
    want = {}
    for i, t in left:
        if i in bad:
            continue
        out, at = "", 0
        for x in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans_of(t).split(",") if s)):
            if x[0] >= at:
                out += t[at : x[0]] + "<secret>"
            at = max(at, x[1])
        want[i] = library.encode_ordinary(out + t[at:])
    assert got == want
