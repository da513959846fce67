"""Bigram language model with deleted interpolation, counted and scored shard by shard.

Documents are dealt to shards. Each shard sends the counts of its distinct n-grams to the partitions that own them
(packed, a row for each pair of shard and partition), and gets back the corpus counts of those that others hold too.
So the n-gram table is only ever joined in pieces, and no token travels.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Context-frequency buckets: the bit length of the context's training count, up to this.
BUCKETS = 24
#: Steps per unit of log2 and range in which held-out events are tallied for the fit of the weights.
STEP, RANGE = 4, 48

_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = b"\n"  # no word holds a line break


class _Shard:
    """Tokens of a shard's documents as numbers: `uni` and `bi` index the sorted hashes of words (even) and of pairs
    (odd) in `keys`, and their training counts in `own`."""

    def __init__(self, texts: pa.Array, train: np.ndarray):
        flat, starts = common.split_words(texts, lower=True)
        coded = flat.dictionary_encode()
        vocabulary = coded.dictionary.cast(pa.large_binary()).to_pylist() + [_END]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
        ids = np.asarray(coded.indices, dtype=np.int64)
        n = np.diff(starts)
        self.ends = np.cumsum(n + 1)  # each document's words, then its end
        end = len(vocabulary) - 1
        tokens = np.full(int(self.ends[-1]) if len(n) else 0, end)
        is_word = np.ones(len(tokens), bool)
        is_word[self.ends - 1] = False
        tokens[is_word] = ids
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.train = train[self.doc]
        bits = np.uint64(1)
        order = np.argsort(hashes << bits, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.uni = place[tokens]
        self.context = np.concatenate([self.uni[-1:], self.uni[:-1]])  # a text starts after an end, as the last text has
        before = hashes[np.concatenate([tokens[-1:], tokens[:-1]])]
        two = (((before ^ (before >> np.uint64(31))) * _MIX + hashes[tokens]) * _MIX) | bits
        del flat, coded, is_word, before
        kinds, self.bi = np.unique(two, return_inverse=True)
        self.keys = (hashes[order] << bits, kinds)
        count = lambda at, n: np.bincount(at[self.train], minlength=n).astype(np.int64)
        self.own = (count(self.uni, len(order)), count(self.bi, len(kinds)))


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def _owner(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition that owns each key: ranges of the hash, so that sorted keys fall in contiguous pieces."""
    return np.searchsorted(np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64), keys, "right")


def _planes(values: np.ndarray) -> bytes:
    """Numbers with all first bytes, then all second bytes, and so on: the zeros of small numbers compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _request(parts: int):
    def run(table: pa.Table) -> pa.Table:
        shard = _Shard(table.column("text").combine_chunks(), ~np.asarray(table.column("held")).astype(bool))
        s, rows = table.column("shard")[0].as_py(), []
        for kind, (keys, own) in enumerate(zip(shard.keys, shard.own)):
            cuts = np.searchsorted(_owner(keys, parts), np.arange(parts + 1))
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    steps = np.diff(keys[a:b], prepend=np.uint64(0))
                    rows.append({"part": p, "shard": s, "kind": kind, "keys": _planes(steps), "counts": _planes(own[a:b].astype(np.uint32))})
        return pa.Table.from_pylist(rows, pa.schema([(c, pa.int32()) for c in ("part", "shard", "kind")] + [("keys", pa.binary()), ("counts", pa.binary())]))

    return run


def _total(table: pa.Table) -> pa.Table:
    """For the keys of one partition: to each shard the sums over the corpus where they exceed its own counts; and the
    number of training tokens and of distinct ones (shard -1)."""
    keys = [np.cumsum(_numbers(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    counts = [_numbers(k, np.uint32).astype(np.int64) for k in table.column("counts").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    sums = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)
    part, ends, rows = table.column("part")[0].as_py(), np.cumsum(sizes), []
    for shard, kind, own, a, b in zip(table.column("shard").to_pylist(), table.column("kind").to_pylist(), counts, ends - sizes, ends):
        total = sums[place[a:b]]
        more = np.flatnonzero(total > own)
        steps = np.diff(more, prepend=0).astype(np.uint32)
        rows.append({"shard": shard, "part": part, "kind": kind, "at": _planes(steps), "sums": _planes(total[more].astype(np.uint64)), "tokens": 0, "kinds": 0})
    one = (every & np.uint64(1)) == 0
    rows.append({"shard": -1, "part": 0, "kind": 0, "at": b"", "sums": b"", "tokens": int(sums[one].sum()), "kinds": int((sums[one] > 0).sum())})
    schema = [(c, pa.int32()) for c in ("shard", "part", "kind")] + [("at", pa.binary()), ("sums", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())]
    return pa.Table.from_pylist(rows, pa.schema(schema))


def _with_totals(docs: pa.Table, replies: pa.Table, parts: int) -> tuple[_Shard, tuple[np.ndarray, ...]]:
    shard = _Shard(docs.column("text").combine_chunks(), ~np.asarray(docs.column("held")).astype(bool))
    total = tuple(own.copy() for own in shard.own)
    cuts = [np.searchsorted(_owner(keys, parts), np.arange(parts + 1)) for keys in shard.keys]
    for part, kind, at, sums in zip(*(replies.column(c).to_pylist() for c in ("part", "kind", "at", "sums"))):
        if at:
            total[kind][cuts[kind][part] + np.cumsum(_numbers(at, np.uint32), dtype=np.int64)] = _numbers(sums, np.uint64).astype(np.int64)
    return shard, total


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(counts + 1)).astype(np.int64), BUCKETS - 1)


def _estimates(shard: _Shard, counts: tuple[np.ndarray, ...], tokens: int, kinds: int) -> tuple[np.ndarray, ...]:
    """Bucket of the context, and bigram, unigram and uniform estimates, of each token under the counts."""
    context = counts[0][shard.context]
    two = np.where(context > 0, counts[1][shard.bi] / np.maximum(context, 1), 0.0)
    one = counts[0][shard.uni] / max(tokens, 1)
    return _bucket(context), two, one, np.full(len(two), 1.0 / (kinds + 1))


def _tally(parts: int):
    """Held-out events of the shard's training tokens: counts without the shard's own, so each shard is held out once
    against all others. Events are tallied by context bucket and the (quantised) ratios of the estimates."""

    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("r2", pa.int32()), ("r1", pa.int32()), ("n", pa.int64())])
        if not docs.num_rows or not replies.num_rows:
            return schema.empty_table()
        shard, total = _with_totals(docs, replies, parts)
        tokens, kinds = replies.column("all_tokens")[0].as_py(), replies.column("all_kinds")[0].as_py()
        bucket, two, one, zero = _estimates(shard, tuple(t - o for t, o in zip(total, shard.own)), tokens - int(shard.train.sum()), kinds)
        use = shard.train
        with np.errstate(divide="ignore"):
            r2, r1 = (np.clip(np.round(np.log2(x[use] / zero[use]) * STEP), -RANGE * STEP, RANGE * STEP).astype(np.int64) for x in (two, one))
        side = 2 * RANGE * STEP + 1
        cell, n = np.unique((bucket[use] * side + r2 + RANGE * STEP) * side + r1 + RANGE * STEP, return_counts=True)
        return pa.table([pa.array((cell // side // side).astype(np.int32)), pa.array((cell // side % side - RANGE * STEP).astype(np.int32)), pa.array((cell % side - RANGE * STEP).astype(np.int32)), pa.array(n)], schema=schema)

    return run


def _fit(rounds: int):
    """Weights of the three estimates for each bucket, by expectation-maximisation over the tallied events."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        floor = -RANGE * STEP
        weights = np.tile([0.3, 0.4, 0.3], (BUCKETS, 1))
        for b, rows in pdf.groupby("bucket"):
            r2, r1, n = (rows[c].to_numpy() for c in ("r2", "r1", "n"))
            p = np.stack([np.where(r2 > floor, 2.0 ** (r2 / STEP), 0), np.where(r1 > floor, 2.0 ** (r1 / STEP), 0), np.ones(len(n))], 1)
            w, n = weights[b], n + 0.0
            for _ in range(rounds):
                share = p * w
                share /= share.sum(1, keepdims=True)
                w = (share * n[:, None]).sum(0) + 1e-3
                w /= w.sum()
            weights[b] = w
        return pd.DataFrame({"weights": [weights.ravel().tolist()]})

    return run


def _score(parts: int, schema: pa.Schema):
    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return schema.empty_table()
        shard, total = _with_totals(docs, replies, parts)
        tokens, kinds = replies.column("all_tokens")[0].as_py(), replies.column("all_kinds")[0].as_py()
        weights = np.array(replies.column("weights")[0].as_py()).reshape(BUCKETS, 3)
        bucket, two, one, zero = _estimates(shard, total, tokens, kinds)
        w = weights[bucket]
        w[total[0][shard.context] == 0, 0] = 0.0
        w /= w.sum(1, keepdims=True)
        logs = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * zero)
        known = total[0][shard.uni]
        base = np.log10((known + 1) / (tokens + kinds + 1))
        n = docs.num_rows
        by_doc = lambda x: np.bincount(shard.doc, x, n)
        columns = [docs.column("doc_id").combine_chunks(), docs.column("held").combine_chunks(), pa.array(np.bincount(shard.doc, minlength=n)), pa.array(by_doc(known > 0).astype(np.int64)), pa.array(np.full(n, tokens)), pa.array(by_doc(base)), pa.array(by_doc(logs))]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def score(docs: DataFrame, held: F.Column | None = None, shard_mb: float = 10.0, rounds: int = 60) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    Tokens are the lower-cased words (A-Z) and an end; null and empty texts have only the end. A token's probability
    mixes the bigram, unigram and uniform maximum-likelihood estimates; the weights depend on the bucket of the
    context's count and are fitted on counts from which a shard's own are deleted. Texts in which `held` is true
    (null: false) teach nothing. Repeated rows are scored, and counted, each. Only when no row at all is left to learn
    from is the uniform estimate alone in use. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    held = held_out(F.col("doc_id")) if held is None else held
    parts = common.parts_for(spark, common.text_bytes(docs), shard_mb * 1e6, 8)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    named = named.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).repartition(parts, "shard")
    asked = named.groupBy("shard").applyInArrow(_request(parts), "part int, shard int, kind int, keys binary, counts binary")
    replies = asked.repartition(parts, "part").groupBy("part").applyInArrow(_total, "shard int, part int, kind int, at binary, sums binary, tokens long, kinds long")
    # One plan for all that follows: the shuffled texts, requests and replies are each made once and used again.
    sums = replies.where("shard = -1").agg(F.sum("tokens").alias("all_tokens"), F.sum("kinds").alias("all_kinds"))
    replies = replies.where("shard >= 0").select("shard", "part", "kind", "at", "sums").crossJoin(F.broadcast(sums)).repartition(parts, "shard")
    tallied = named.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(_tally(parts), "bucket int, r2 int, r1 int, n long")
    tallied = tallied.groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))
    tallied = tallied.union(spark.range(1).selectExpr("0", "0", "0", "0L"))  # an event of no weight: there is always a group
    weights = tallied.groupBy().applyInPandas(_fit(rounds), "weights array<double>")  # rows bounded by buckets and steps
    schema = docs.select(
        "doc_id", F.lit(True).alias("held_out"), *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")], *[F.lit(0.0).alias(c) for c in ("base_score", "score")]
    ).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    replies = replies.crossJoin(F.broadcast(weights))  # one row
    return named.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(_score(parts, to_arrow_schema(schema)), schema)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: base score and the model's score of its whole text. Null and empty texts are one end token,
    repeated rows count and are scored each, and an empty table gives no row."""
    return score(common.table(spark, sf_dir, "documents"))
