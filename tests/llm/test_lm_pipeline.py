"""The language model's scores and the pipeline's rows against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from kbspark.llm import lm_scoring

SCHEMA = "doc_id long, text string, source string"


def _rows(n: int, seed: int = 21) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, last = [], 0
        for _ in range(rng.randint(55, 140)):  # each word leans on the one before
            last = (7 * last + rng.randrange(6)) % 4000 if rng.random() < 0.6 else rng.randrange(4000)
            words.append(f"W{last}" if rng.random() < 0.1 else f"w{last}")
        rows.append((i, " ".join(words), "abc"[i % 3]))
    return rows


@pytest.mark.parametrize("shard_mb", [10.0, 0.004])
def test_scores_against_plain_counts(spark, shard_mb):
    """Every score lies between plain sums of the least and the greatest estimate, and held-out texts gain on the base."""
    rows = [*_rows(90), (90, None, "a"), (91, "", "a"), (92, "zzz unknown unseen", "b"), (5, _rows(6)[5][1], "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lm_scoring.score(docs, shard_mb=shard_mb, rounds=60).collect()
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    one, two, contexts = Counter(), Counter(), Counter()
    for i, t, _ in rows:
        if not held(i):
            w = tokens(t)
            one.update(w)
            two.update(zip(["\n", *w], w))
    contexts = one  # a text starts after an end, of which there is one for each text
    n, v = sum(one.values()), len(one)
    bucket = lambda c: min(math.ceil(math.log2(c + 1)), lm_scoring.BUCKETS - 1)
    events = defaultdict(list)
    for i, t, _ in rows:
        w = tokens(t)
        for a, b in zip(["\n", *w], w):
            c = contexts[a]
            events[(i, t)].append((bucket(c), two[a, b] / c if c else None, one[b] / n, 1 / (v + 1)))
    # Whatever the weights are, a score lies between the sums of the least and of the greatest estimate of each token.
    assert len(got) == len(rows)
    by_id = defaultdict(set)
    for i, t, _ in rows:
        by_id[i].add(t)
    for r in got:
        (text,) = by_id[r.doc_id]
        low = sum(math.log10(min(x for x in e[1:] if x is not None) or 1e-12) for e in events[r.doc_id, text])
        high = sum(math.log10(max(x for x in e[1:] if x is not None)) for e in events[r.doc_id, text])
        assert low - 1e-6 <= r.score <= high + 1e-6
    # Texts of held-out rows, whose pairs of words follow the training texts, are more likely than under the base.
    fresh = [r for r in got if r.held_out and r.n_tokens > 50]
    assert fresh and sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_weights_are_those_of_expectation_maximisation():
    """The fit finds, for each bucket, weights no other mixture of a fine grid beats."""
    import pandas as pd

    rng = np.random.default_rng(4)
    tally = pd.DataFrame({"bucket": rng.integers(0, 3, 200), "r2": rng.integers(-20, 40, 200), "r1": rng.integers(-10, 30, 200), "n": rng.integers(1, 50, 200)})
    got = np.array(next(iter([lm_scoring._fit(400)(tally)]))["weights"][0]).reshape(-1, 3)
    step = lm_scoring.STEP
    for b, rows in tally.groupby("bucket"):
        p = np.stack([2.0 ** (rows["r2"] / step), 2.0 ** (rows["r1"] / step), np.ones(len(rows))], 1)
        like = lambda w: float((rows["n"] * np.log(p @ w)).sum())
        grid = [np.array([i, j, 50 - i - j]) / 50 for i in range(51) for j in range(51 - i)]
        assert math.isclose(got[b].sum(), 1) and like(got[b]) >= max(map(like, grid)) - 0.5


def test_run_of_the_pipeline(spark, tmp_path):
    """A whole run: what each stage does to its input is seen in the packed rows."""
    rows = _rows(60)
    copy = rows[0][1].split()
    copy[70 % len(copy)] = "changed"
    rows += [(60, rows[1][1], "a"), (61, "too short", "b"), (62, None, "c"), (63, " ".join(["again and again"] * 60), "a")]
    rows += [(64, rows[2][1] + " password = Zk93hfQ8dLw2", "b"), (65, " ".join(copy[:1] + copy[1:]), "c")]
    docs = spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in rows], SCHEMA + ", lang string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {60, 61, 62, 63}  # an exact copy, a short text, no text, repeated words
    assert ids and ids <= set(range(66)) and not {0, 65} <= ids and not {2, 64} <= ids  # near copies
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    # The mix repeats documents: pieces of a document are a whole number of its own.
    mixed = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    for i in ids:
        assert len({n for (d, *_), n in mixed.items() if d == i}) == 1
    for path in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{path}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{path}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
