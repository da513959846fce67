"""The operators against brute force on small tables with nulls, empty and long texts, ties, copies and repeated rows."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from kbspark.llm import chaining, common, embedding_dedup, lm_scoring, mixing, packing, quality, secrets, simhash, suffix_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(7)
VOCABULARY = [f"w{i}" for i in range(400)] + ["été", "naïve", "A", "a"]
PASSAGE = " ".join(random.choice(VOCABULARY) for _ in range(150))


def _text(n: int) -> str:
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def _make():
    rows = [(i, _text(random.randint(1, 200)), "abc"[i % 3]) for i in range(40)]
    rows += [(40, None, "a"), (41, "", "b"), (42, " \t\n", None), (43, PASSAGE, "a"), (44, PASSAGE, "b"), (45, "start " + PASSAGE + " end", None)]
    rows += [(46, _text(3000), "c"), (47, "no no no no " * 100, "a"), (47, "no no no no " * 100, "a"), (48, 'password = "hunter2x" token:abc AKIA' + "Z" * 16 + " " + "0f" * 12, "a")]
    return rows


ROWS = _make()


def _rows():
    return ROWS


SCHEMA = "doc_id long, text string, source string, extra int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1) for r in _rows()], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(_rows())
    for r in got:
        w = WORD.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        three = Counter(zip(w, w[1:], w[2:]))
        again = {k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        want = (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in r.text or ""), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(none, labels).count() == 0


def test_quality_ratio_and_threshold(spark, tmp_path):
    """The ratio and the fitted threshold against brute force, through the query."""
    rng, vocabulary = random.Random(11), [f"g{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(700):
        bad = i % 3 == 0
        words = [(f"b{rng.randrange(300)}" if bad and rng.random() < 0.3 else rng.choice(vocabulary)) for _ in range(rng.randint(45, 120))]
        rows.append((i, " ".join(words), "s"))
        if i % 5:
            marks.append((i, 0 if bad else 1, int(i % 11 == 0)))
    rows += [(None, rows[1][1], "s"), (700, None, "s"), (3, rows[3][1], "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    held = {r.doc_id for r in labels.where(quality.is_held(F.col("doc_id"))).collect()}
    texts = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "k long, text string")
    grams = {r.k: r.b for r in texts.select("k", quality.ngram_buckets(common.words(F.col("text"))).alias("b")).collect()}
    kinds = {i: (q, x) for i, q, x in marks}
    trusted = {i for i, (q, x) in kinds.items() if q and not x and i not in held}
    raw, target = Counter(), Counter()
    for k, (i, *_) in enumerate(rows):
        raw.update(grams[k])
        target.update(grams[k] if i in trusted else [])
    size = 1 << quality.BITS
    n, m = sum(raw.values()) + size, sum(target.values()) + size
    llr = {k: sum(math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in g) / len(g) if g else 0.0 for k, g in grams.items()}
    passes = {k: not quality_failed(rows[k][1]) for k in llr}
    good = sorted(llr[i] for i in held if passes[i] and kinds[i] == (1, 0))
    bad = sorted(llr[i] for i in held if passes[i] and kinds[i][0] == 0)
    assert len(good) >= quality.FEWEST and len(bad) >= quality.FEWEST
    points = sorted(good + bad)
    cuts = [points[0]] + [(a + b) / 2 for a, b in zip(points, points[1:])]
    cost = lambda c: quality.LOST * sum(x < c for x in good) / len(good) + sum(x >= c for x in bad) / len(bad)
    want = min(cuts, key=lambda c: (round(cost(c), 12), c))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(docs, labels.where("quality = 1 AND toxic = 0").where(~quality.is_held(F.col("doc_id"))))
    assert math.isclose(quality.fit_threshold(docs, labels, common.materialize(model, "llr")).first().threshold, want, rel_tol=1e-9)
    got = quality.op1_quality(spark, str(tmp_path)).collect()
    key = lambda i, x, b, k: (i is None, i or 0, round(x, 9), b, k)
    assert sorted(key(r.doc_id, r.llr, r.base_failed, r.kept) for r in got) == sorted(key(rows[k][0], llr[k], not passes[k], passes[k] and llr[k] >= want) for k in llr)
    assert quality.fit_threshold(docs, labels.limit(0), common.materialize(model, "llr")).first().threshold == quality.THRESHOLD


def test_quality_counts_all_labels(spark):
    """More trusted documents than 20,000 all make the target, and more held-out ones than 4,000 of a class the threshold."""
    many = spark.range(20_100).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    assert set(quality.fit(many, many.select("doc_id")).first().ratios) == {0.0}
    ids = spark.range(45_000).select(F.col("id").alias("doc_id")).where(quality.is_held(F.col("doc_id"))).orderBy("doc_id").limit(8200).toPandas().doc_id.tolist()
    said = {kind: " ".join(f"{kind}{i}" for i in range(60)) for kind in "gb"}
    labels = spark.createDataFrame([(i, n % 2, 0) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    texts = [(i, said["g" if n % 2 or n < 14 else "b"]) for n, i in enumerate(ids)] + [(-1, said["g"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = common.materialize(quality.fit(docs, docs.where("doc_id = -1")), "llr")
    best = quality.fit_threshold(docs, labels, model).first()
    assert (best.lost, best.passed) == (0.0, 7 / 4100)


def quality_failed(text) -> bool:
    w = WORD.findall(text or "")
    three = Counter(zip(w, w[1:], w[2:]))
    again = {k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def _covered(texts: list[bytes], length: int) -> list[np.ndarray]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_suffix_dedup(docs, none, crowd):
    texts = [(r[1] or "").encode() for r in _rows()]
    want = Counter()
    for (i, *_), t, gone in zip(_rows(), texts, _covered(texts, 400)):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want[i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.repeated_spans(docs, crowd=crowd).drop("spans").collect()
    assert Counter(tuple(r) for r in got) == want
    assert suffix_dedup.repeated_spans(none).count() == 0


def test_suffix_dedup_splits_an_anchor_with_many_segments(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = letters(450)
    # One passage for all, behind and before texts that some share; pieces of it that are too short alone; an odd letter.
    heads, tails = [letters(k) for k in (0, 5, 200, 380, 700)], [letters(k) for k in (0, 7, 190, 390, 600)]
    texts = [rng.choice(heads) + core[: rng.choice((100, 380, 450))] + rng.choice(tails) for _ in range(60)]
    texts += [letters(300) + core[:k] + "!" + core[k + 1 :] + letters(300) for k in (3, 200, 224, 225, 226, 399, 400, 449)]
    raw = [t.encode() for t in texts]
    want = {i: (int(g.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()) for i, (t, g) in enumerate(zip(raw, _covered(raw, 400)))}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.repeated_spans(table, crowd=3).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want and sum(n > 0 for n, _ in want.values()) > 20


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_suffix_dedup_tells_strings_of_equal_sums_apart(spark, crowd):
    # The Thue-Morse string and its complement have one polynomial hash modulo 2^64.
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), "x" * 3]
    raw = [t.encode() for t in texts]
    want = [int(g.sum()) for g in _covered(raw, 1500)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=1500, crowd=crowd)
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == want
    places, repeated, _ = suffix_dedup.suffix_array([texts[0].encode()[:1024], texts[1].encode()[:1024], texts[0].encode()[:1024]], 1024)
    assert len(places) == 3 and repeated.sum() == 2


def test_common_prefixes():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(0, 2, 500), np.zeros(200, int), rng.integers(0, 2, 500)]).astype(np.uint8)
    a, b = rng.integers(0, 1100, 3000), rng.integers(0, 1100, 3000)
    want = [next((k for k in range(100) if data[x + k] != data[y + k]), 100) for x, y in zip(a, b)]
    assert suffix_dedup._prefixes(data, a, b, 100, block=700).tolist() == want


def test_suffix_array_order():
    parts = [bytes(random.choice(b"ab") for _ in range(random.randint(12, 60))) for _ in range(200)] + [b"aaaa" * 10]
    places, repeated, starts = suffix_dedup.suffix_array(parts, 12)
    at = {int(s) + i: p[i : i + 12] for s, p in zip(starts, parts) for i in range(len(p) - 11)}
    found = [at[int(p)] for p in places]
    count = Counter(at.values())
    assert found == sorted(found) and len(set(places.tolist())) == len(at)
    assert [count[f] > 1 for f in found] == repeated.tolist()


def test_packing(docs, none):
    got = packing.pack(docs, packing.tokenizer_paths()).toPandas()
    encode = packing._Encoder(*packing.tokenizer_paths())
    slow = packing._Encoder(packing.tokenizer_paths()[0], None, None)
    assert all(encode(r[1] or "") == slow(r[1] or "") for r in _rows())
    assert got.doc_id.nunique() == len({r[0] for r in _rows()})
    for i, text, _ in _rows():
        ids = np.array([*encode(text or ""), 2], dtype="<u4")
        for p in got[got.doc_id == i].itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and (p.piece == 0 or p.length == 1024)
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id").length.cumsum() - got.length) == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(none, packing.tokenizer_paths()).count() == 0


def test_plan_holds_every_piece():
    lengths, counts = np.unique(np.random.default_rng(0).integers(1, 1025, 20_000), return_counts=True)
    runs, held = packing.plan(dict(zip(lengths.tolist(), counts.tolist())), 1024), Counter()
    for n, lengths_of in runs:
        assert sum(lengths_of) <= 1024
        for x in lengths_of:
            held[x] += n
    assert held == Counter(dict(zip(lengths.tolist(), counts.tolist())))
    assert sum(n for n, _ in runs) < 1.05 * sum(a * b for a, b in zip(lengths, counts)) / 1024


def test_plan_against_best_fit():
    """Of lengths drawn like those of documents, the plan takes hardly more sequences than best fit of each piece does."""
    lengths = (np.random.default_rng(1).lognormal(5, 1, 3000).astype(int) + 2).clip(2, 1024)
    rooms: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else 1024) - n)
    runs = packing.plan(dict(Counter(lengths.tolist())), 1024)
    assert sum(n for n, _ in runs) <= len(rooms) * 1.004 + 1


def test_mixing(docs, none):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(_rows()) and (got.taken <= 3 * got["size"]).all()
    assert math.isclose(got.groupby("source", dropna=False).target.first().sum(), got["size"].sum())
    for _, rows in got.groupby("source", dropna=False):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= rows["size"].max()
    again = mixing.mix(docs).toPandas()
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    assert mixing.mix(none).count() == 0


def test_simhash(docs, none):
    def brute(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {i: brute(t) for i, t, _ in _rows()}
    got = simhash.near_duplicates(docs).collect()
    assert all(r.fp & (1 << 64) - 1 == want[r.doc_id] for r in got) and len(got) == len(_rows())
    near = {i: {j for j in want if (want[i] ^ want[j]).bit_count() <= 4} for i in want}
    for r in got:
        reach, todo = {r.doc_id}, [r.doc_id]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        assert r.component_id == min(reach)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_finds_all_pairs_at_four_bits(spark):
    base = [random.getrandbits(64) for _ in range(60)]
    fps = base + [x ^ sum(1 << b for b in random.sample(range(64), d)) for x in base for d in (1, 2, 3, 4)]
    fps += [base[0] ^ 1 << i for i in range(64)]  # a crowded anchor
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    parts = {r.node: r.component for r in common.connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert parts[a] == parts[b]


@pytest.mark.parametrize("crowd", [0, 200])
def test_simhash_chain_through_rows_of_other_homes(crowd):
    """A-N, N-B and B-M at 4 bits, A and B at home: N ties A and B at a small and at a large anchor."""
    a, n, b, m = 0, 0xF, 0xFF, 0xFFF
    far = [random.getrandbits(64) | 0xFFFF << 40 for _ in range(crowd)]
    fps = np.array([a, n, b, m, *far], np.uint64).view(np.int64)
    at = pd.DataFrame({"anchor": 5, "fp": fps, "home": [True, False, True, False] + [True] * crowd})
    edges = {frozenset(e) for e in simhash._compare(4)(at).itertuples(index=False)}
    assert {frozenset(e) for e in ((a, n), (n, b), (b, m))} <= edges


def test_lm_scoring(docs, none):
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    seen = Counter(w for i, t, _ in _rows() if not held(i) for w in tokens(t))
    n = sum(seen.values())
    for r in lm_scoring.score(docs).collect():
        text = next(t for i, t, _ in _rows() if i == r.doc_id)
        base = sum(math.log10((seen[w] + 1) / (n + len(seen) + 1)) for w in tokens(text))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens(text)), sum(seen[w] > 0 for w in tokens(text)), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert lm_scoring.score(none).count() == 0


def test_chaining(spark, none):
    rows = [[random.choice(VOCABULARY) + str(random.random())[2:5] for _ in range(200)] for _ in range(60)]
    passage = [f"p{i}" for i in range(70)]
    for i in range(0, 60, 3):
        rows[i][50:120] = [w if random.random() > 0.02 else "x" for w in passage]
    table = [(i, " ".join(r)) for i, r in enumerate(rows)] + [(90, None), (91, ""), (92, " ".join(rows[1])), (92, " ".join(rows[1]))]
    classes, found = chaining.passages(spark.createDataFrame(table, "doc_id long, text string"))
    names = {r.u: r.class_id for r in classes.collect()}
    pairs = [(names[r.u], names[r.v]) for r in found.collect()]
    assert {x for p in pairs for x in p} == set(range(0, 60, 3))
    assert classes.count() == len(table)
    assert chaining.passages(none)[1].count() == 0


def _groups(table):
    classes, found = chaining.passages(table)
    names = {r.u: r.class_id for r in classes.collect()}
    return {r.doc_id: r.group_id for r in classes.collect()}, [{**r.asDict(), "u": names[r.u], "v": names[r.v]} for r in found.collect()]


def _own(name: str, n: int) -> list[str]:
    return [f"{name}{i}" for i in range(n)]


def test_chaining_pairs_without_a_common_hub(spark):
    """100 and 101 share 60 words; every seed of them has many other holders that share under 50."""
    passage = _own("p", 60)
    half = lambda i, part: " ".join(_own(f"h{i}x", 40) + part + _own(f"g{i}x", 40))
    made = [(i, half(i, passage[:32] if i % 2 else passage[28:])) for i in range(60)]
    table = spark.createDataFrame([*made, (100, half(100, passage)), (101, half(101, passage))], "doc_id long, text string")
    groups, found = _groups(table)
    assert {frozenset((r["u"], r["v"])) for r in found} == {frozenset((100, 101))}
    assert all((r["end"] - r["start"], r["similarity"]) == (60, 1.0) and r["start"] == 40 for r in found)
    assert groups == {i: i for i in range(60)} | {100: 100, 101: 100}


def test_chaining_decoys_and_fuzzy_copies_against_brute_force(spark):
    """Decoys quote 16 or 36 words of what fuzzy copies share; groups and spans are those of an alignment of all pairs."""
    rng = random.Random(11)
    passage, rows = _own("p", 80), {}
    for i in range(40):
        at = rng.randrange(64)
        rows[i] = _own(f"d{i}x", 50) + passage[at : at + 16] + _own(f"e{i}x", 30)
    for i in range(40, 60):
        at = rng.randrange(44)
        rows[i] = _own(f"d{i}x", 30) + passage[at : at + 36] + _own(f"e{i}x", 30)
    for i in range(100, 106):
        copy = list(passage)
        for at in rng.sample(range(80), 4):
            copy[at] = f"x{i}"
        rows[i] = _own(f"d{i}x", 20 + i % 7) + copy + _own(f"e{i}x", 25)
    rows[200] = _own("q", 30) + rows[100] + _own("r", 30) + rows[101][:120]  # the passage twice in one text
    groups, found = _groups(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string"))
    copies = {*range(100, 106), 200}
    assert groups == {i: 100 if i in copies else i for i in rows}
    assert any(r["u"] == r["v"] == 200 for r in found)
    for r in found:
        x, y = rows[r["u"]][r["start"] : r["end"]], rows[r["v"]][r["other_start"] : r["other_end"]]
        words = {w: n for n, w in enumerate({*x, *y})}
        common_words = chaining._matched(np.array([words[w] for w in x]), np.array([words[w] for w in y]))
        assert min(len(x), len(y)) >= 50 and r["similarity"] >= 0.8 and common_words >= round(r["similarity"] * max(len(x), len(y)))


def test_chaining_repeats_inside_a_text(spark):
    passage, line = _own("p", 60), _own("l", 12)
    rows = [_own("a", 90) + passage + _own("b", 70) + passage + _own("c", 20), line * 30, _own("d", 90), line * 2 + _own("e", 60), ["no"] * 500, passage[:40] + _own("f", 60) + passage[20:] + _own("g", 9)]
    groups, found = _groups(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string"))
    assert {(r["u"], r["v"]) for r in found} == {(0, 0), (1, 1), (4, 4)}
    spans = sorted((r["start"], r["end"], r["other_start"], r["other_end"]) for r in found if r["u"] == 0)
    assert spans[0] == (90, 150, 220, 280) and all(90 <= s[0] and s[1] <= 150 and 220 <= s[2] and s[3] <= 280 for s in spans)
    assert groups == {i: i for i in range(6)}


def test_chaining_short_equal_segments_of_many_texts(spark):
    """A line of 40 words in all texts is no passage; with ten more words it is, for those that have them."""
    line = _own("l", 40)
    rows = [_own(f"a{i}x", 60) + line + _own(f"b{i}x", 60) for i in range(50)]
    for i in (7, 23, 41):
        rows[i][100:110] = _own("m", 10)
    rows[30][55:60], rows[31][55:60] = _own("n", 5), _own("n", 5)
    rows[30][100:106], rows[31][100:106] = _own("o", 6), _own("o", 6)
    groups, _ = _groups(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string"))
    assert groups == {i: i for i in range(50)} | {23: 7, 41: 7, 31: 30}


def test_chaining_query(spark, tmp_path):
    rows = [(0, " ".join(_own("a", 9) + _own("p", 60)), 1), (1, " ".join(_own("b", 9) + _own("p", 60)), 1), (2, None, 1), (2, None, 1), (3, " ".join(_own("b", 9) + _own("p", 60)), 1)]
    spark.createDataFrame(rows, "doc_id long, text string, u int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in chaining.op7_chaining(spark, str(tmp_path)).collect()}
    assert {i: (r.class_id, r.group_id, r.n_passages) for i, r in got.items()} == {0: (0, 0, 1), 1: (1, 0, 1), 3: (1, 0, 1), 2: (2, 2, 0)}
    assert [(p.start, p.end, p.other_start, p.other_end) for r in (got[0], got[1]) for p in r.passages] == [(9, 69, 9, 69)]


def test_warc(spark):
    rows = [(1, "http://a.b/x", "y" * 2000), (1, "http://a.b/x", "y" * 2000), (2, "http://a.b/x", "y" * 2000), (None, None, None), (3, "http://A.b:80/q z#f", "é\r\n\r\nWARC/1.0"), (4, "u", "y" * 999)]
    rows += [(0, "u2", "y" * 2000), (5, "u3", "y" * 999), (None, "u4", "y" * 2000), (None, "u5", "z" * 1500), (6, "u6", "é" * 600_000), (7, "u7", "x" * 17_000_000)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        other = html == "y" * 2000 and i != 2
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", 2 if other else None] += 1
    assert Counter(tuple(r) for r in got) == want
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_secrets(spark, docs, none):
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    kinds = [s.kind for s in got[48].base]
    assert kinds == ["assign", "access", "hex"] and not got[40].base and not got[41].spans
    value = "sk9f8e7d6c5b4a3f2e1d"
    many = [(i, f"token = {value}", "one") for i in range(2)] + [(5, f"see {value} here", "two")] + [(10 + i, "token: copied1234567890abcdef", str(i)) for i in range(5)]
    table = spark.createDataFrame(many, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in secrets.find_secrets(table).collect()}
    assert [s.kind for s in found[5].spans] == ["reused"] and {s.verdict for r in found.values() for s in r.base if r.doc_id >= 10} == {"example"}
    texts = {r.doc_id: r.text for r in secrets.redact(table).collect()}
    assert value not in texts[0] + texts[5] and "copied" in texts[10] and len(texts) == len(many)
    assert secrets.find_secrets(none).count() == 0 and secrets.redact(none).count() == 0


def test_secrets_short_values_and_pieces(spark):
    value = "Hunter2x9"
    texts = [f"password = {value}", f"password={value}.", f"the bare {value} here", f"end with {value}.", f"at /x/{value}?k", f"as key={value}", "a hunter2x and Hunter2x99", None, "", "7" * 50_000 + "x"]
    table = spark.createDataFrame([(i, t, "one") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in secrets.find_secrets(table).collect()}
    assert [[s.kind for s in found[i].spans if s.kind != "hex"] for i in range(9)] == [["assign"]] * 2 + [["reused"]] * 4 + [[]] * 3
    assert {s.repositories for i in (0, 1) for s in found[i].base} == {2}
    for i in range(2, 6):
        (s,) = found[i].spans
        assert texts[i][s.start : s.end] == value
    redacted = {r.doc_id: r.text for r in secrets.redact(table).collect()}
    assert all(value not in redacted[i] for i in range(6)) and all(redacted[i] == texts[i] for i in (6, 7, 8))


def test_secrets_of_letters_and_of_six_characters(spark):
    live = ["hunterpass", "Ab3xY7", "481516"]
    rows = [(f"password = {v}", "one") for v in live] + [(f"the bare {v} here", "two") for v in live]
    rows += [("secret = information", "one"), ("token: garden", "one"), ("secret: abc---", "one"), ("abc and hunterpasses", "two")]
    rows += [(f"much information {i}", str(i)) for i in range(5)] + [("a garden", "one")] * 120
    table = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in secrets.find_secrets(table).collect()}
    for i, v in enumerate(live):
        (s,) = found[3 + i].spans
        assert (s.kind, rows[3 + i][0][s.start : s.end], s.verdict) == ("reused", v, "live")
    assert [found[i].base[0].verdict for i in (6, 7)] == ["example"] * 2 and not any(found[i].spans for i in range(9, len(rows)))
    redacted = {r.doc_id: r.text for r in secrets.redact(table).collect()}
    assert all(v not in " ".join(redacted[i] for i in range(6)) for v in live) and redacted[6] == rows[6][0] and redacted[9] == rows[9][0]


def test_secrets_against_brute_force(spark):
    rng = random.Random(11)
    values = ["".join(rng.choice("abcDEF01_-") for _ in range(rng.randint(4, 12))) for _ in range(40)]
    rows = []
    for i in range(200):
        parts = [rng.choice(["password = {}", "token:{}", "{}", "see {}.", "/x/{}/y", "w{}w"]).format(rng.choice(values)) for _ in range(4)]
        rows.append((i, "é " + " words ".join(parts), rng.choice(["a", "b", "c", "d", None])))
    pattern = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    ends = "+/_.=-"
    base = {i: [(m.start(), m.end(), m[2].strip(ends) or m[2]) for m in pattern.finditer(t) if len(m[2]) >= 6] for i, t, _ in rows}
    bare = {}
    for i, t, _ in rows:
        places = {m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t)} | {m.span() for m in re.finditer(r"[A-Za-z0-9+_-]+", t)}
        trimmed = {(b - len(t[a:b].lstrip(ends)), a + len(t[a:b].rstrip(ends))) for a, b in places}
        bare[i] = sorted((a, b, t[a:b]) for a, b in trimmed if b - a >= 6 and all(b <= x or a >= y for x, y, _ in base[i]))
    owner = {i: s for i, _, s in rows}
    patterned, everywhere, holders = {}, {}, {}
    for i in base:
        for *_, v in base[i]:
            patterned.setdefault(v, set()).add(owner[i])
        for *_, v in base[i] + bare[i]:
            everywhere.setdefault(v, set()).add(owner[i])
            holders.setdefault(v, set()).add(i)
    wordlike = lambda v: len(v) < 8 or v.isalpha() or not any(c.isalpha() for c in v)
    live = {v for v, o in patterned.items() if len(o) < 3 and not (wordlike(v) and (len(everywhere[v]) >= 3 or len(holders[v]) >= 100))}
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for r in found:
        assert [(s.start, s.end) for s in r.base] == [(a, b) for a, b, _ in base[r.doc_id]]
        want = sorted((a, b) for a, b, v in bare[r.doc_id] if v in live)
        assert sorted((s.start, s.end) for s in r.spans if s.kind == "reused") == want
    assert len(found) == 200 and live and set(patterned) - live


def _linked(rows, least=0.9):
    """Brute force: (vec_id, n_links, component_id, kept) of all rows, lengths apart."""
    good = [(i, np.array(v) / max(map(abs, v))) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    want = [(i, 0, i, True) for i, v in rows if not (v and None not in v and np.isfinite(v).all() and any(v))]
    for d in {len(v) for _, v in good}:
        ids, m = np.array([i for i, v in good if len(v) == d]), np.array([v / np.linalg.norm(v) for _, v in good if len(v) == d])
        near = m @ m.T >= least
        np.fill_diagonal(near, True)
        parts = ids.copy()
        while (new := np.where(near, parts[None, :], 10**9).min(1)).tolist() != parts.tolist():
            parts = new
        want += [(int(i), int(n) - 1, int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(1), parts)]
    return Counter(want)


@pytest.mark.parametrize("cells,block", [(None, 2000), (7, 40)])
def test_embeddings(spark, cells, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, (v + rng.normal(size=64) * 0.05).tolist()) for i, v in enumerate(x[:40])]
    rows += [(i, x[0].tolist()) for i in range(400, 440)] + [(500, None), (501, [0.0] * 64), (502, [float("nan")] * 64), (503, [None] * 64), (1, x[1].tolist()), (505, [])]
    rows += [(504, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [1.0, 2.0]), (508, [1e200] * 8), (509, [1e200] * 8), (510, [3e-320] * 8), (511, [float("inf")] + [1.0] * 7)]
    rows += [(600 + i, [float(np.cos(0.05 * i)), float(np.sin(0.05 * i)), 0.0]) for i in range(60)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, node int")
    got = embedding_dedup.near_duplicates(table, block=block, cells=cells).collect()
    assert Counter(tuple(r) for r in got) == _linked(rows)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("cells,block", [(1, 20), (6, 1000), (6, 8)])
def test_embeddings_chains_across_blocks_and_cells(spark, cells, block):
    """Chains of vectors 20 degrees apart, each linked with its neighbours only, in cells of several blocks."""
    angles = np.radians(20 * np.arange(8))
    rows = []
    for c in range(20):
        for k, a in enumerate(angles):
            v = np.zeros(64)
            v[2 * c], v[2 * c + 1] = np.cos(a), np.sin(a)
            rows.append((8 * c + k, v.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(table, sure=math.inf, cells=cells, block=block).collect()
    assert {(r.vec_id, r.component_id, r.n_links) for r in got} == {(i, i - i % 8, 1 if i % 8 in (0, 7) else 2) for i in range(160)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("length, replaced", [(50, []), (55, [42]), (62, [44, 53]), (200, [i * 37 % 200 for i in range(0, 100, 5)])])
def test_chaining_links_of_like_surroundings(spark, length, replaced):
    """Segments that are equal while the words around them are only alike: nearly all pairs are linked, and none too many."""
    rows = []
    for k in range(20):
        passage = _own(f"p{k}_", length)
        other = [f"x{k}_{i}" if i in replaced else w for i, w in enumerate(passage)]
        rows += [_own(f"a{k}_", 60) + passage + _own(f"b{k}_", 60), _own(f"c{k}_", 60) + other + _own(f"d{k}_", 60)]
    groups, _ = _groups(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string"))
    assert sum(groups[2 * k] == groups[2 * k + 1] == 2 * k for k in range(20)) >= 18
    assert all(groups[i] in (i, i - i % 2) for i in groups)


def test_passages_of_short_equal_runs(spark):
    """Planted pairs whose equal runs are short: every 12th or 8th of 120 words replaced, or a random tenth of 60."""
    import random

    from kbspark.llm import chaining

    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, kinds = [], ("12th", "8th", "tenth")
    for i in range(90):
        own = words(60 if i % 3 == 2 else 120)
        lost = lambda j: rng.random() < 0.1 if i % 3 == 2 else j % (12, 8)[i % 3] == 0
        other = [words(1)[0] if lost(j + 1) else w for j, w in enumerate(own)]
        rows += [(2 * i + k, " ".join(words(60) + part + words(60))) for k, part in enumerate((own, other))]
    classes, found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string"))
    group = {r.doc_id: r.group_id for r in classes.collect()}
    linked = {kind: sum(group[2 * i + 1] == 2 * i for i in range(90) if kinds[i % 3] == kind) for kind in kinds}
    assert all(g // 2 == d // 2 for d, g in group.items())
    assert linked["12th"] == 30 and linked["8th"] >= 27 and linked["tenth"] >= 26, linked
    listed = [tuple(r) for r in found.collect()]
    assert len(listed) == len(set(listed))
    assert all(r[6] >= 0.8 and min(r[2] - r[1], r[5] - r[4]) >= 50 for r in listed)


@pytest.mark.parametrize("places", [(1 << 24) - 1, 63, (1 << 62) - 1])
def test_repeated_words_whatever_hashes_share(spark, monkeypatch, places):
    """Texts longer than places are sorted by whole hash; with few upper bits left all windows share them."""
    monkeypatch.setattr(quality, "PLACES", places)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 4, 12, 40, 41, 42, 43, 300])]
    rows += [(99, " ".join(f"w{i}" for i in range(60))), (100, "x y z x y z"), (101, "a * b\n*#\n\n a $ \U0001f600"), (102, None)]
    got = {r.doc_id: r for r in quality.base_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = (text or "").split()
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        again = {k for j, x in enumerate(windows) if windows.count(x) > 1 for k in range(j, j + 3)}
        assert (got[i].n_repeat_words, got[i].word_chars, got[i].n_symbols) == (len(again), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text or ""))


@pytest.mark.parametrize("bits", [24, 6])
def test_fit_shuffles_texts_that_may_be_trusted_alone(spark, monkeypatch, bits):
    """The map has the bits of all trusted ids, also where all ids share 64 bits, and the ratios are those of plain counts."""
    monkeypatch.setattr(quality, "MAP", bits)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} x") for i in range(300)] + [(None, "null id"), (3, "again"), (4, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in (3, 3, 8, 250, 999, None)], "doc_id int")
    n = sum(bin(x & (2**64 - 1)).count("1") for x in quality.id_map(trusted.where("doc_id is not null")).first()["map"])
    assert 1 <= n <= 4 and (bits == 6 or n == 4)
    grams = docs.select("doc_id", quality.ngram_buckets(common.words(F.col("text"))).alias("b")).collect()
    raw, target = Counter(), Counter()
    for r in grams:
        raw.update(r.b or [])
        target.update(r.b if r.doc_id in (3, 8, 250) else [])
    size = 1 << quality.BITS
    want = lambda b: math.log((target[b] + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size))
    got = quality.fit(docs, trusted).first().ratios
    assert all(math.isclose(got[b], want(b), rel_tol=1e-9) for b in range(0, size, 97)) and all(math.isclose(got[b], want(b), rel_tol=1e-9) for b in raw)


def test_chaining_compares_few_of_the_texts_that_share_a_run_of_one_word(spark, monkeypatch):
    """24 times one word is no passage, and 60 times is: nodes that share the first alone are not paired, and tables go when they are read."""
    made, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, what: made.append((what, write(df, what))) or made[-1][1])
    run = lambda i, j: [f"own{i}x{j}"] * 30
    rows = [run(i, 0) + ["and"] * (60 if i in (7, 50) else 24) + run(i, 1) + ["the"] * 14 + run(i, 2) for i in range(120)]
    groups, found = _groups(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string"))
    assert groups == {i: i for i in range(120)} | {50: 7}
    compared = sum(table.count() for what, table in made if what == "pairs")
    assert 1 <= compared <= 500  # 7,140 pairs meet
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        next(table for what, table in made if what == "placed").collect()


def test_chaining_lists_passages_inside_a_group(spark):
    """Texts of one group that share a second passage, of which others hold 45 words, also as an equal segment: it is listed too."""
    rows, pairs = [], []
    for k in range(8):
        joint, second = _own(f"p{k}_", 58), _own(f"q{k}_", 58)
        first = len(rows)
        for i in range(14):
            rows.append(_own(f"d{k}_{i}_", 60) + second[i : i + 45] + _own(f"e{k}_{i}_", 60))
        for i in range(2):
            part = [f"x{k}" if i and j == 29 else w for j, w in enumerate(second)]
            rows.append(_own(f"a{k}_{i}_", 60) + joint + _own(f"b{k}_{i}_", 90) + part + _own(f"c{k}_{i}_", 60))
        pairs.append((first + 14, first + 15))
    groups, found = _groups(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string"))
    assert groups == {i: i for i in range(len(rows))} | {b: a for a, b in pairs}
    listed = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in found if (r["start"], r["end"], r["other_start"], r["other_end"]) == (208, 266, 208, 266)}
    assert listed == set(pairs)


def test_chaining_links_copies_of_a_line_by_the_words_around(spark):
    """44 words that many texts share are no passage; two texts that go on with one other word and 8 equal ones hold one."""
    rows = []
    for k in range(20):
        line, more = _own(f"l{k}_", 44), _own(f"m{k}_", 8)
        for i in range(6):
            after = _own(f"n{k}_{i}_", 1) + (more if i > 3 else _own(f"o{k}_{i}_", 8))
            rows.append(_own(f"a{k}_{i}_", 60) + line + after + _own(f"b{k}_{i}_", 60))
    groups, found = _groups(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string"))
    assert groups == {i: i - (i % 6 == 5) for i in range(len(rows))}
    assert {(r["start"], r["end"], r["other_start"], r["other_end"]) for r in found} == {(60, 113, 60, 113)}
