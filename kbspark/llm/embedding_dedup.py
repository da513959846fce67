"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products in them, one vector kept per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


#: Numbers that an assignment holds at once, so that its memory doesn't grow with the cells.
SCORES = 2_000_000


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sums(centres: np.ndarray):
    """Of each partition the sum of the vectors next to each centre."""

    def run(parts):
        total, seen = np.zeros_like(centres), np.zeros(len(centres), bool)
        for pdf in parts:
            if len(pdf):
                x = _unit(pdf["embedding"])
                near = (x @ centres.T).argmax(1)
                np.add.at(total, near, x)
                seen[near] = True
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"cell": at.astype(np.int32), "total": list(total[at])})

    return run


def fit_cells(drawn: DataFrame, k: int, rounds: int = 4) -> np.ndarray:
    """Centroids of spherical k-means over drawn (node, embedding), by sums of each partition; they begin as the k vectors
    of least hash, and empty cells keep their last centre. Only centres come to the driver."""
    first = drawn.orderBy(F.xxhash64("node"), "node").limit(k).select("embedding").toPandas()
    centres = _unit(first["embedding"])
    for _ in range(rounds):
        sums = drawn.select("embedding").mapInPandas(_sums(centres), "cell int, total array<double>")
        sums = sums.groupBy("cell").applyInPandas(lambda pdf: pd.DataFrame({"cell": pdf["cell"][:1], "total": [np.sum(np.stack(pdf["total"]), 0)]}), "cell int, total array<double>")
        for cell, total in sums.toPandas().itertuples(index=False):  # one row for each cell
            if np.linalg.norm(total) > 1e-12:
                centres[cell] = total / np.linalg.norm(total)
    return centres


_PLACED = "home string, cells array<string>"


def _assign(fitted: dict[int, np.ndarray], margins: dict[int, float]):
    """The cell of each vector, and all cells that it goes to: its own and those whose boundary with it is in reach. Each
    length of vectors has cells of its own; one without fitted cells is one cell.

    Two centres are at most 2 apart, so a cell that is in reach has a cosine at most twice the margin below the own one;
    only for such cells is the distance of the centres made, vector by vector. Nothing is held for all pairs of cells.
    """

    def run(batches):
        for batch in batches:
            at, vectors = batch.schema.names.index("embedding"), None
            sizes = np.array([len(v) for v in batch.column(at)])
            home, cells = [None] * len(sizes), [None] * len(sizes)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                if d not in fitted:
                    for i in rows:
                        home[i], cells[i] = f"{d}", [f"{d}"]
                    continue
                step = max(1, min(1000, SCORES // len(fitted[d])))
                for j in range(0, len(rows), step):
                    part = rows[j : j + step]
                    vectors = np.asarray(batch.column(at).take(pa.array(part)).flatten(), np.float64).reshape(-1, d)
                    s = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ fitted[d].T
                    own = s.argmax(1)
                    below = s[np.arange(len(s)), own][:, None] - s
                    row, cell = np.nonzero(below <= 2 * margins[d] + 1e-9)
                    reach = cell == own[row]
                    for a in range(0, len(row), max(1, SCORES // d)):
                        at_once = slice(a, a + max(1, SCORES // d))
                        r, c = row[at_once], cell[at_once]
                        gap = np.linalg.norm(fitted[d][own[r]] - fitted[d][c], axis=1)
                        reach[at_once] |= below[r, c] <= margins[d] * gap
                    row, cell = row[reach], cell[reach]
                    cuts = np.searchsorted(row, np.arange(len(s) + 1))
                    for i, h, a, b in zip(part, own, cuts, cuts[1:]):
                        home[i], cells[i] = f"{d}-{h}", [f"{d}-{c}" for c in cell[a:b]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.string()), pa.array(cells, pa.list_(pa.string()))], [*batch.schema.names, "home", "cells"])

    return run


def forest(hit: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows, columns) of each group that the hits tie together."""
    left, out = hit.any(1), []
    free = np.ones(hit.shape[1], bool)
    while left.any():
        root = int(left.argmax())
        rows, columns, front = [], [], np.array([root])
        while len(front):
            left[front] = False
            rows.append(front)
            new = np.flatnonzero(hit[front].any(0) & free)
            free[new] = False
            columns.append(new)
            front = np.flatnonzero(hit[:, new].any(1) & left) if len(new) else new
        out.append((root, np.concatenate(rows), np.concatenate(columns)))
    return out


def _compare(least: float):
    """Links of a block of a cell's home vectors with a block of all vectors in the cell: how many each has, as rows
    (src, src, links), and edges that tie what is linked together, as rows of -1 links.

    A pair of two cells may meet in both: then each side counts it where it is at home. Where one side isn't sent to
    the other's cell, both count it here."""

    def run(homes: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(homes) and len(others):
            node, other, n, m = homes["node"].to_numpy(), others["other"].to_numpy(), homes["n"].to_numpy(), others["m"].to_numpy()
            hit = _unit(homes["embedding"]) @ _unit(others["vector"]).T >= least
            hit &= node[:, None] != other[None, :]
            away = others["at"] != others["of_cell"]
            kinds, of = np.unique(others["at"].to_numpy(str), return_inverse=True)
            sent = np.array([np.isin(kinds, c) for c in homes["cells"]])[:, of]
            links = hit.astype(np.int64)
            out.append((node, node, links @ m))
            back = (links * (~sent & away.to_numpy()[None, :])).T @ n
            some = np.flatnonzero(back)
            out.append((other[some], other[some], back[some]))
            for root, rows, columns in forest(hit):
                out += [(ids, np.full(len(ids), node[root]), np.full(len(ids), -1)) for ids in (node[rows], other[columns])]
        src, dst, links = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"src": src, "dst": dst, "links": links})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, sure: float = 3.6, block: int = 2000, cells: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id: integer, embedding: array of numbers).

    Vectors of one length are compared. Their cells, 2 * sqrt(n) of n, are fitted on a sample of 20 for each cell; every
    vector is assigned, and goes also to each cell whose boundary is within the margin. Of a linked pair in two cells one
    lies within half of their difference's extent across the boundary, so a margin of half the largest difference finds
    every pair for certain (`sure=math.inf`). The default takes `sure` of the standard deviations that a difference of
    random direction has across a boundary, and is certain up to 12 dimensions; the README has the recall measured.
    Lengths that are rarer than both 1000 vectors and a thousandth of all are one cell each. Products are in double
    precision, of vectors scaled by their largest component; nothing under `least` is linked. Vectors that are equal after
    scaling are one node with a count. Both sides of a cell are dealt in blocks, and a block emits a forest, so groups of
    any size are spread. Null, empty, zero and non-finite vectors, and those with null components, link with nothing and
    are kept; repeated rows link with each other. A null vec_id with links gets the component of the others. Other columns
    are not read.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    top = F.array_max(F.transform("embedding", lambda e: F.abs(e)))
    v = v.withColumn("top", F.when(~F.coalesce(bad, F.lit(True)), top))
    v = v.withColumn("embedding", F.when(F.col("top") > 0, F.transform("embedding", lambda e: e / F.col("top"))))
    v = common.materialize(v.select("vec_id", "embedding", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")).alias("node")), "vectors")
    nodes = v.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    nodes = common.materialize(nodes, "nodes")
    total = nodes.count()
    lengths = nodes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") >= max(1000 if cells is None else 1, total / 1000))
    fitted, margins = {}, {}
    for d, n in sorted((r["d"], r["n"]) for r in lengths.collect()):  # at most a thousand
        k = cells or math.ceil(2 * math.sqrt(n))
        every = max(1, n // (20 * k))
        drawn = nodes.where((F.size("embedding") == d) & (F.pmod(F.xxhash64("node", F.lit(1)), F.lit(every)) == 0)).select("node", "embedding")
        fitted[d] = fit_cells(drawn, k)
        margins[d] = math.sqrt(2 - 2 * least) * min(1.0, sure / math.sqrt(d)) / 2
    placed = nodes.select("node", "n", "embedding").mapInArrow(_assign(fitted, margins), f"node long, n long, embedding array<double>, {_PLACED}")
    placed = common.materialize(placed, "placed")
    members = placed.select("node", "n", "embedding", "home", F.explode("cells").alias("cell"))
    sizes = placed.select("home", F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.ceil(F.sum((F.col("home") == F.col("cell")).cast("int")) / block).cast("int").alias("across"), F.ceil(F.count("*") / block).cast("int").alias("down")
    )
    sizes = common.materialize(sizes.where("across > 0"), "sizes")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = placed.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("i", F.pmod("node", "across").cast("int")).withColumn("j", each("down"))
    others = members.join(sizes, "cell").withColumn("j", F.pmod(F.xxhash64("node"), "down").cast("int")).withColumn("i", each("across"))
    homes = homes.select("cell", "i", "j", "node", "n", "embedding", "cells").groupBy("cell", "i", "j")
    others = others.select("cell", "i", "j", "node", "n", "embedding", "home").toDF("of_cell", "of_i", "of_j", "other", "m", "vector", "at").groupBy("of_cell", "of_i", "of_j")
    found = common.materialize(homes.cogroup(others).applyInPandas(_compare(least), "src long, dst long, links long"), "links")
    parts = common.connected_components(found.where("links < 0").select("src", "dst")).withColumnRenamed("component", "root")
    nodes = nodes.select("node", "n", "least").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    links = found.where("links >= 0").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    nodes = nodes.join(roots, "root").join(links, "node").select("node", (F.col("links") + F.col("n") - 1).alias("links"), "component_id")
    out = v.select("vec_id", "node").join(nodes, "node", "left")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id"))).alias("kept"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector: its links, its group and whether it is the one kept."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
