"""Stages of the pipeline against brute force."""

import random

import corpus_pipeline
import numpy as np
from kbspark.llm import shingles, simhash
from pyspark.sql import functions as F


def _words(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_near_copies_keeps_documents_of_null_and_repeated_ids(spark):
    rng = random.Random(5)
    text = [" ".join(_words(rng, 80)) for _ in range(12)]
    rows = [(None, text[i]) for i in range(6)] + [(None, text[0]), (1, text[6]), (2, text[7]), (2, text[6]), (2, text[8]), (3, text[9]), (3, text[9]), (4, text[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = [(None, text[i]) for i in range(5)] + [(1, text[6]), (2, text[7]), (2, text[8]), (3, text[9]), (4, text[5])]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_near_copies_against_brute_force(spark):
    rng = random.Random(6)
    line = _words(rng, 12)
    rows = []
    for g in range(25):
        base = _words(rng, 150)
        for edits in (0, 1, 2, 3, 4, 5, 6):
            w = list(base)
            for at in rng.sample(range(150), edits):
                w[at] = f"x{rng.random()}"
            rows.append(" ".join(w + line if g % 2 else w))
    for _ in range(6):  # a chain of texts, each near the next
        rows.append(" ".join(base := base[5:] + _words(rng, 5)))
    rows += ["", None, "one two", "One  two"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    table = dict(zip(ids, rows))

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in table.items()}
    near = {i: {j for j in sets if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0} for i in sets}
    want, seen = set(), set()
    for i in sorted(table):
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Extra columns that are called like what the stages add come through whole, and nothing else changes."""
    rng = random.Random(8)
    value = "token = sk9f8e7d6c5b4a3f2e1d"
    rows = [(i, " ".join(_words(rng, 90) + ([value] if i == 3 else [])), "ab"[i % 2], -5, ["x"], "row", "k", 7) for i in range(12)] + [(None, None, None, 1, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, words array<string>, row0 string, _key string, _copies int")
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = {r[0]: r[3:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(tuple(r)[3:] == tuple(extra[r.doc_id]) for r in got)
        if name == "quality":
            assert {r.doc_id for r in got} <= set(range(12))
        if name == "secrets":
            assert {r.doc_id: r.text for r in got} == {r[0]: r[1] and r[1].replace(value, "<secret>") for r in rows}


def test_parities_leave_no_similar_pair_out(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(400):
        common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (rng.integers(0, 120), *rng.integers(0, 30, 2)))
        x, y = np.union1d(common, a), np.union1d(common, b)
        both = len(np.intersect1d(x, y))
        similar = both >= 0.8 * max(len(x) + len(y) - both, 1)
        rows.append((similar, len(x), len(y), *(v for s in (x, y) for v in shingles.parities(s).view(np.int64).tolist())))
    ours, others = shingles.PARITIES, [f"q{i}" for i in range(len(shingles.PARITIES))]
    table = spark.createDataFrame(rows, "similar boolean, n int, m int, " + ", ".join(f"{c} long" for c in ours + others))
    got = table.groupBy("similar").agg(F.min(shingles.may_reach(0.8, F.col("n"), F.col("m"), ours, others).cast("int")).alias("least")).collect()
    assert {r.similar: r.least for r in got} == {True: 1, False: 0}


def test_pairs_of_a_group_of_near_copies_are_few(spark, monkeypatch):
    """A group of near copies proposes a few pairs a member, and sets that nobody asks for stay in their worker."""
    rng, checked, made = random.Random(11), [], []
    base = [f"w{i}" for i in range(300)]

    def text(i):
        words = list(base)
        for at in rng.sample(range(300), 2):
            words[at] = f"{words[at]}x{rng.randrange(3)}"
        return " ".join(words)

    verified, sets = shingles.verified, shingles.sets
    monkeypatch.setattr(shingles, "verified", lambda pairs, *a: checked.append(pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(shingles, "sets", lambda docs, width, *asked: made.append(sets(docs, width, *asked).count() if asked else 0) or sets(docs, width, *asked))
    n = 200
    rows = [(i, text(i)) for i in range(n)] + [(1000 + i, " ".join(f"v{i}_{j}" for j in range(80))) for i in range(50)]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 1000} == {0} and all(r.doc_id == r.component_id for r in got if r.doc_id >= 1000)
    assert made and max(made) <= n + 5, made  # of the other 50 texts next to none
    assert sum(checked) <= 6 * n, checked


def test_wide_parities_leave_no_similar_pair_out(spark):
    """Of sets on both sides of a bound of their lists' length too; of unlike long sets next to none is left open."""
    rng = np.random.default_rng(9)
    rows = []
    for size in (60, 1040, 1100, 2000, 4050):
        for share in (0.3, 0.6, 0.8, 0.85, 0.95, 1.0):
            for _ in range(4):
                common, a, b = (rng.integers(0, 1 << 63, int(n)).astype(np.uint64) for n in (size * share, size * (1 - share), size * (1 - share)))
                x, y = np.union1d(common, a), np.union1d(common, b[: len(b) // 2])
                both = len(np.intersect1d(x, y))
                similar = both >= 0.8 * (len(x) + len(y) - both)
                rows.append((similar, share, len(x), len(y), *(shingles.parities(s, shingles.wide_longs(len(s))).view(np.int64).tolist() for s in (x, y))))
    assert any(len(r[4]) != len(r[5]) for r in rows if r[0])
    table = spark.createDataFrame(rows, "similar boolean, share double, n int, m int, x array<long>, y array<long>")
    got = table.withColumn("open", shingles.may_reach_wide(0.8, F.col("n"), F.col("m"), F.col("x"), F.col("y"))).collect()
    assert all(r.open for r in got if r.similar) and not any(r.open for r in got if r.share <= 0.6)


def test_few_sets_are_made_of_long_texts_that_share_a_part(spark, monkeypatch):
    """Long texts with the same beginning and 2,000 words of their own are told apart before their sets are made."""
    rng, made = random.Random(12), []
    part = [f"w{rng.randrange(10**9)}" for _ in range(1200)]
    rows = [(i, " ".join(part + [f"v{rng.randrange(10**9)}" for _ in range(2000)])) for i in range(30)]
    rows += [(100 + i, r[1] + " end") for i, r in enumerate(rows[:3])]
    sets = shingles.sets
    monkeypatch.setattr(shingles, "sets", lambda docs, width, *asked: made.append(sets(docs, width, *asked).count() if asked else 0) or sets(docs, width, *asked))
    # The sample of texts, which tells what is frequent, is left empty, so that the common part counts as rare.
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), sample=1)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i % 100 for i, _ in rows}
    assert max(made) <= 8, made


def test_shingles_of_one_set_stay_in_their_worker(spark):
    """What two sets hold comes with all its places; of the other shingles next to none."""
    rows = [(i, 3, [i * 1000 + 1, 7, i * 1000 + 2]) for i in range(1, 40)] + [(50, 2, [60_001, 60_002]), (50, 2, None)]
    got = shingles.met_shingles(spark.createDataFrame(rows, "node long, n int, rare array<long>").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == [(7, i, 3, 1) for i in range(1, 40)]
