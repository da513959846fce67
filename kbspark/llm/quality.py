"""Quality rules: base counts, then the log-likelihood ratio of hashed n-grams under a trusted target and the corpus.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Hash buckets of the two multinomials: a fixed size, so that the model is one bounded row.
BITS = 16
#: Bits of the map of trusted ids (2^24, 2 MB), whatever the data.
MAP = 24
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: The lower bits of a window's hash that give way to its place; longer texts are sorted without that step.
PLACES = (1 << 24) - 1
#: Documents whose mean log ratio an n-gram (nats) is below the threshold are rejected. It is fitted on labels held out of the
#: target; this one serves where these have fewer than FEWEST documents of a class.
THRESHOLD = -0.14
#: One label in HELD is held out of the target; a trusted document lost weighs as much as LOST others kept.
HELD, FEWEST, LOST = 5, 20, 10
#: Ratios are sorted in ranges of 1 / RANGES, so that no task sorts them all; they lie within some 30 of zero.
RANGES = 1024


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more in the text, the first finding included.

    Texts whose windows have distinct hashes have none. In others, windows that share the upper bits of their hash with another, as
    plain numbers sorted with their places in the lower bits, are sorted by whole hash; those with an equal neighbour
    are repeated; their places, in order, add up to three words each, less where they overlap.
    """
    size = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))

    def shared(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("long"))))
        upper = lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.lit(~PLACES)) == 0, F.lit(False))
        near = _let(packed, lambda p: F.filter(p, lambda x, j: upper(x, F.get(p, j - 1)) | upper(x, F.get(p, j + 1))))
        at = F.transform(near, lambda x: x.bitwiseAND(F.lit(PLACES)).cast("int"))
        every = F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i")))
        return F.when(F.size(h) <= PLACES, F.transform(at, lambda i: F.struct(F.get(h, i).alias("h"), (i + 1).alias("i")))).otherwise(every)

    def places(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(
            F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"]))).alias("t"))),
            lambda x: x["t"],
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.when(j == F.size(p) - 1, 3).otherwise(F.least(F.lit(3), F.get(p, j + 1) - x)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    repeats = lambda h: _let(F.sort_array(shared(h)), lambda s: _let(places(s), covered))
    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)))
    return F.when(size >= 3, F.coalesce(counted, F.lit(0))).otherwise(0).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with `words`, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words added. Null texts have none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumns({"words": common.words(F.col("text")), "_lines": lines})
    return docs.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _let(F.col("words"), repeated_words),
        }
    ).drop("_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def ngram_buckets(words: Column) -> Column:
    """Buckets of the words and of the pairs of words that follow each other."""

    def of(w: Column) -> Column:
        bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << BITS)).cast("int")
        two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: bucket(F.get(w, i - 1), F.get(w, i)))
        one = F.transform(w, lambda x: bucket(x))
        return F.when(F.size(w) > 1, F.concat(one, two)).otherwise(one)

    return _let(words, of)


def id_map(ids: DataFrame) -> DataFrame:
    """One row: a map of bits, as an array of longs, with the bit of each doc_id set. Of fixed size, so it may have others' bits too."""
    words = ids.select(_place("doc_id").alias("at"), F.lit(1).cast("long").alias("one"), _bit("doc_id").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
    full = ids.sparkSession.range(1 << (MAP - 6)).select(F.col("id").alias("at")).join(words, "at", "left").na.fill(0, ["bits"])
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("map"))


def _slot(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << MAP))


def _place(doc_id: str) -> Column:
    return F.shiftright(_slot(doc_id), 6)


def _bit(doc_id: str) -> Column:
    return F.pmod(_slot(doc_id), F.lit(64)).cast("int")


def fit(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: the log ratio of target and corpus for each bucket, as an array of 2^BITS numbers.

    docs has doc_id and text, trusted the doc_ids of the target, all of which are used. Each n-gram of every document is counted,
    combined by bucket before the shuffle. Only texts whose id has its bit in the map of the trusted are shuffled to meet these ids,
    at any size; the others are counted where they lie. Both multinomials are smoothed with one count a bucket. With no trusted document all
    ratios are those of two equal models: zero.
    """
    ids = common.materialize(trusted.select("doc_id").where("doc_id is not null").distinct(), "trusted")
    bits = common.materialize(id_map(ids), "map").scalar()
    may = F.expr("shiftright(_word, _bit)").bitwiseAND(F.lit(1)) == 1
    asked = docs.select("doc_id", "text", _bit("doc_id").alias("_bit"), F.get(bits, _place("doc_id").cast("int")).alias("_word"))
    met = asked.where(may).select("doc_id", "text").join(ids.withColumn("_target", F.lit(1)).hint("merge"), "doc_id", "left").select("text", F.coalesce("_target", F.lit(0)).alias("t"))
    marked = asked.where(~may).select("text", F.lit(0).alias("t")).union(met)
    grams = marked.select(F.explode(ngram_buckets(common.words(F.col("text")))).alias("bucket"), "t")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    full = docs.sparkSession.range(1 << BITS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    listed = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), (F.sum("raw") + (1 << BITS)).alias("r"), (F.sum("target") + (1 << BITS)).alias("t"))
    ratio = lambda x: F.log((x["target"] + 1) / F.col("t")) - F.log((x["raw"] + 1) / F.col("r"))
    return listed.select(F.when(F.col("t") > (1 << BITS), F.transform("c", ratio)).otherwise(F.transform("c", lambda x: F.lit(0.0))).alias("ratios"))


def is_held(doc_id: Column) -> Column:
    """Whether a label is held out of the target, for the threshold."""
    return F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(HELD)) == 0


def with_llr(counted: DataFrame, model: DataFrame) -> DataFrame:
    """counted, as base_counts returns it, with llr added: the mean log ratio of a document's n-grams (none: 0)."""
    ratios = model.scalar()  # one value of 2^BITS numbers

    def mean(p: Column) -> Column:
        total = F.aggregate(p["b"], F.lit(0.0), lambda a, x: a + F.get(p["r"], x))
        return F.when(F.size(p["b"]) > 0, total / F.size(p["b"])).otherwise(0.0)

    pair = F.struct(ratios.alias("r"), ngram_buckets(F.col("words")).alias("b"))
    return counted.withColumn("_pair", pair).withColumn("llr", _let(F.col("_pair"), mean)).drop("words", "_pair")


def fit_threshold(docs: DataFrame, labels: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(threshold, lost, passed), one row, of held-out labels (doc_id, quality, toxic): the cut between two ratios, or the least
    ratio, that loses the fewest trusted documents and keeps the fewest of quality 0, as weighed by LOST (ties: the least
    cut), and both shares. THRESHOLD and nulls where a class has fewer than FEWEST documents.

    docs has the counts and llr, or text, to be judged by the model. Only documents that pass the base rule count, a doc_id once with its least
    ratio. All held-out labels count; documents are judged before they meet the labels, so that no text is shuffled. Ratios are sorted in ranges, and what lies
    below a range is summed over ranges, whose number is bounded.
    """
    known = labels.where(is_held(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(F.when(F.col("quality") == 1, F.when(F.coalesce("toxic", F.lit(0)) == 0, 1)).when(F.col("quality") == 0, 0)).alias("_good")
    ).where("_good is not null")
    asked = docs.where(is_held(F.col("doc_id")))
    asked = with_llr(base_counts(asked.select("doc_id", "text")), model) if model else asked
    # The base rule is asked inside the aggregate: as a filter Spark would move it below and count every document once more.
    least = asked.groupBy("doc_id").agg(F.min(F.when(~base_failed(), F.col("llr"))).alias("llr")).where("llr is not null")
    at = least.join(known, "doc_id").groupBy("llr").agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")).withColumn("_range", F.floor(F.col("llr") * RANGES))
    ranges = at.groupBy("_range").agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b"), F.max("llr").alias("_last"))
    order, every = Window.orderBy("_range"), Window.partitionBy()  # a row a range
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "_range", F.lag("_last").over(order).alias("_last"), F.coalesce(F.sum("_g").over(earlier), F.lit(0)).alias("_g"), F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_b"),
        F.sum("_g").over(every).alias("n_good"), F.sum("_b").over(every).alias("n_bad"),
    )
    before = Window.partitionBy("_range").orderBy("llr")
    below = before.rowsBetween(Window.unboundedPreceding, -1)
    cuts = at.join(ranges, "_range").select(
        F.coalesce((F.coalesce(F.lag("llr").over(before), "_last") + F.col("llr")) / 2, "llr").alias("threshold"),
        (F.col("_g") + F.coalesce(F.sum("good").over(below), F.lit(0))).alias("lost"), (F.col("n_bad") - F.col("_b") - F.coalesce(F.sum("bad").over(below), F.lit(0))).alias("passed"), "n_good", "n_bad",
    )
    cuts = cuts.where((F.col("n_good") >= FEWEST) & (F.col("n_bad") >= FEWEST)).withColumns({"lost": F.col("lost") / F.col("n_good"), "passed": F.col("passed") / F.col("n_bad")})
    best = cuts.agg(F.min(F.struct((LOST * F.col("lost") + F.col("passed")).alias("cost"), "threshold", "lost", "passed")).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(THRESHOLD)).alias("threshold"), "b.lost", "b.passed")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed and llr (mean log ratio of the document's n-grams) added; columns of docs that have these
    names are replaced.

    The target are documents labelled quality 1 and not toxic, without those held out. A document without words has llr 0.
    Null doc_ids are never trusted; repeated rows count, and are judged, each.
    """
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").where(~is_held(F.col("doc_id")))
    model = common.materialize(fit(docs.select("doc_id", "text"), trusted), "llr")
    return with_llr(base_counts(docs), model).withColumn("base_failed", base_failed())


def decide(scored: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """scored, as score returns it, with kept added, by a threshold fitted on held-out labels unless it is given. A table that was written
    is judged once; else the documents that may be held out are judged once more for the threshold."""
    least = F.lit(threshold) if threshold is not None else common.materialize(fit_threshold(scored, labels), "threshold").select("threshold").scalar()
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """docs with the base counts, base_failed, llr and kept added, by score and decide. A document without words fails the base rule."""
    return decide(score(docs, labels), labels, threshold)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its counts, the base rule and the verdict of the likelihood ratio. Null and empty texts have no
    words and fail the base rule, repeated rows and null ids a row each, and an empty table no row."""
    labels = common.table(spark, sf_dir, "labels")
    scored = score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), labels).drop("text")
    out = decide(common.materialize(scored, "scored"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
