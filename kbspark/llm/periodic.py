"""Runs of a text's words: stretches that repeat one period, found with a suffix automaton and link-cut access.

The automaton of a text has a state for each set of substrings that end at the same places, and suffix links make a tree of
the states. Walking from the state of each prefix, in order, to the root and giving the whole path the prefix's end as its
last occurrence cuts the tree into segments of one colour. A segment of colour j met at end i says: the longest string of its
deepest state, of length m, ended at j and ends at i, and nowhere between. If m >= i - j, that is a square of period i - j,
and the stretch of that period that ends at i is m + i - j words long. It is a run if the next word breaks the period.
A link-cut tree keeps each segment in a splay tree, so all walks together cost O(n log^2 n).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 24, 3
#: In a run of length n >= max(LEAST, TIMES * q), 2 * q windows of this many words or more fit, so each of them comes again
#: q words before or after it: words outside of all repeated windows are in no run.
WINDOW = LEAST - 2 * (LEAST // TIMES) + 1
#: Bytes of texts that a task looks at at once; a longer text is on its own.
BYTES = 8_000_000


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths of the longest strings, and the states of the prefixes. State 1 is the root, 0 stands for none."""
    nexts: list[dict] = [{}, {}]
    link, length, prefix = [0, 0], [0, 0], []
    last = 1
    for c in word:
        new = len(link)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[new] = link[q] = copy
                while p and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
        prefix.append(new)
        last = new
    return link, length, prefix


class Accesses:
    """A link-cut tree over a fixed tree: access(v, i) colours the path from v to the root with i.

    Every segment of one colour is a splay tree ordered by depth, whose root alone holds the colour; up of that root is
    the parent of the segment's top.
    """

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up, self.left, self.right = list(parent), [0] * n, [0] * n
        self.colour = [-1] * n

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while (y := up[top]) and (left[y] == top or right[y] == top):
            top = y
        if top == x:
            return
        self.colour[x] = self.colour[top]
        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._turn(y if (left[z] == y) == (left[y] == x) else x)
            self._turn(x)

    def _turn(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = right[x]
            left[y], right[x] = b, y
        else:
            b = left[x]
            right[y], left[x] = b, y
        if b:
            up[b] = y
        up[y], up[x] = x, z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def access(self, v: int, i: int):
        """(colour, deepest state) of the segments that the path from v met, from below, before it is coloured i."""
        met, below, x = [], 0, v
        while x:
            self._splay(x)
            if self.colour[x] >= 0:
                met.append((self.colour[x], x))
            if rest := self.right[x]:  # deeper states keep their colour, in a tree of their own
                self.colour[rest] = self.colour[x]
            self.right[x] = below
            below, x = x, self.up[x]
        self._splay(v)
        self.colour[v] = i
        return met


def runs(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, given as numbers, by start and period."""
    link, length, prefix = automaton(word)
    tree, n, out = Accesses(link), len(word), []
    for i, v in enumerate(prefix):
        for j, x in tree.access(v, i):
            period = i - j
            whole = length[x] + period
            if whole >= TIMES * period and whole >= LEAST and (i + 1 == n or word[i + 1] != word[i + 1 - period]):
                out.append((i + 1 - whole, whole, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the stretches of words whose every window of WINDOW words comes twice or more in its text, in order.

    starts says where each text's words begin (one more at the end). Windows are compared by hash: equal hashes of others
    only add words to look at.
    """
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return []
    hashed = _mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = text[:n] == text[WINDOW - 1 :]
    window = _mixed(window ^ _mixed(text[:n].astype(np.uint64)))
    at = np.flatnonzero(inside)
    order = at[np.argsort(window[at], kind="stable")]
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    places = np.flatnonzero(again)
    if not len(places):
        return []
    new = np.concatenate([[True], (np.diff(places) > 1) | (text[places[1:]] != text[places[:-1]])])
    first, last = places[new], places[np.concatenate([new[1:], [True]])]
    return list(zip(first.tolist(), (last + WINDOW).tolist()))


def texts_runs(codes: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its runs; places count from the text's first word."""
    out: list[list] = [[] for _ in range(len(starts) - 1)]
    for a, b in stretches(codes, starts):
        t = int(np.searchsorted(starts, a, side="right")) - 1
        out[t] += [(a - int(starts[t]) + s, n, q) for s, n, q in runs(codes[a:b].tolist())]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run has after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def _slices(batches):
    """The batches in slices of at most BYTES of text, or of one row."""
    for batch in batches:
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + BYTES, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapse(batches):
    """Rows (doc_id, text) to rows (doc_id, runs, collapsed)."""
    for batch in _slices(batches):
        flat, starts = common.split_words(batch.column(1))
        found = texts_runs(flat.dictionary_encode().indices.to_numpy(zero_copy_only=False), starts)
        keep = np.concatenate([np.zeros(0, bool)] + [kept_words(int(n), f) for n, f in zip(np.diff(starts), found)])
        ends = np.concatenate([[0], np.cumsum(keep)])[starts]
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat.filter(pa.array(keep)))
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
        joined = pc.binary_join(lists, pa.scalar(" ", flat.type)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_RUN)), joined], ["doc_id", "runs", "collapsed"])


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of docs (doc_id, text): all runs of at least LEAST words and TIMES periods that no neighbouring
    word extends, by start and period, and the words outside of runs or in a run's first period, joined by one space.

    Rows are on their own, and nothing is shuffled. Null and empty texts have no run and collapse to the empty text, repeated
    rows and null ids give a row each, an empty table none. Other columns don't matter. A text is held by one task, with the
    automaton of a stretch of it at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_collapse, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def repeated(doc_id: Column, text: Column) -> Column:
    """The contract's text: where the id's crc32 ends in 0, the words from a place on repeat one period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def of(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (TIMES + g % 8))
        return F.array_join(quality._let(F.struct(a.alias("a"), p.alias("p")), lambda k: F.transform(words, lambda w, i: F.when(i < k["a"], w).otherwise(F.get(words, (k["a"] + (i - k["a"]) % k["p"]).cast("int"))))), " ")

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), quality._let(common.words(text), of)).otherwise(text)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, after the repetition of the contract: its number of runs, the run of greatest exponent (nulls
    if there is none), and the digests of all runs and of the collapsed words. Null texts have no words, null ids nothing
    repeated; repeated rows a row each, and an empty table no row."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text"))
    better = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    out = collapse(docs).withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
