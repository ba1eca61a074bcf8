"""Embedding near-duplicates by PCA-ordered tiled comparison.

1. Equal vectors are one class (copies never meet each other); all later steps see one unit vector a class.
2. The second-moment matrix of all unit vectors is summed by Spark (one row a matrix entry and task), and its eigenvectors turn the
   vectors so that leading dimensions carry most of the length.
3. Vectors are ranged by the angle of their first coordinate into tiles. A tile's rows grow with the square root of all (SCALE times it), up to TILE_BYTES, so that
   what pairs of tiles move grows with the power 1.5 of the vectors and not with their square. Two vectors' angles differ by no more than
   the angle between the vectors, so only tiles whose angle ranges come within acos(threshold) meet (found by a join on
   angle cells, not by a cross join).
4. A pair of tiles is compared ROWS rows at a time, accumulating LEAD dimensions at a time. After each step the rest of a product is at most the product
   of the suffix norms (Cauchy-Schwarz); columns in which no product can reach the threshold any more drop out, and the rows are done when none is left.
5. A tile pair returns a row a class with links: how many vectors it links, and the smallest class that it reaches within the
   tiles - never the pairs themselves. Connected components over these rows give the groups.

All sums are in double precision. Comparisons grow with the square of the classes where angles do not tell tiles apart; memory does not. Batches of tile
pairs are bounded by Arrow's bytes a batch.

Cases: null and zero vectors and those with null or non-finite components link with nothing. Vectors of different length
do not link. Ties: a product equal to the threshold links. Null ids: a component's id is its smallest non-null one. Repeated rows count as vectors of their own. An empty table
gives an empty result. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Rows of a tile: SCALE times the square root of all classes, 256 at least and TILE_BYTES at most.
SCALE, TILE_BYTES = 32, 16 << 20
LEAD, ROWS = 16, 128


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, under links i - j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b) of products >= threshold; the columns come in falling order of variance."""
    dims, slack = a.shape[1], 1e-12
    steps = [*range(lead, dims, lead), dims]
    rest = [{k: np.sqrt((x[:, k:] ** 2).sum(1)) for k in steps} for x in (a, b)]
    found: list[tuple] = []
    for r in range(0, len(a), ROWS):
        rows = slice(r, r + ROWS)
        cols, value, done = np.arange(len(b)), np.zeros((len(a[rows]), len(b))), 0
        for k in steps:
            value += a[rows, done:k] @ b[cols, done:k].T
            done = k
            live = (value + np.outer(rest[0][k][rows], rest[1][k][cols]) >= threshold - slack).any(0)
            if not live.all():
                cols, value = cols[live], value[:, live]
            if not len(cols):
                break
        i, j = np.nonzero(value >= threshold)
        found.append((i + r, cols[j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def embedding_groups(vectors: DataFrame, *, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int | None = None) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    id_type = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = scratch.stage(rows.where(fine).groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "embedding-classes")

    def unit(column: pa.Array) -> np.ndarray:
        v = np.array(column.to_pylist(), np.float64)
        v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        return v / np.sqrt((v**2).sum(1, keepdims=True))

    def by_length(batch: pa.RecordBatch):
        lengths = np.array([len(x) for x in batch.column("v")])
        for n in np.unique(lengths).tolist():
            yield n, batch.take(pa.array(np.flatnonzero(lengths == n)))

    def moments(batches):
        total: dict = {}
        for batch in batches:
            for n, part in by_length(batch):
                u = unit(part.column("v"))
                total[n] = total.get(n, 0) + u.T @ u
        for n, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * (n * n), pa.int32()), pa.array(np.arange(n * n).astype(np.int32)), pa.array(m.ravel())], names=["n", "k", "m"])

    found: dict = {}
    for r in classes.select("v").mapInArrow(moments, "n int, k int, m double").groupBy("n", "k").agg(F.sum("m").alias("m")).collect():
        found.setdefault(r.n, {})[r.k] = r.m
    bases = {}
    for n, entries in found.items():
        _, vectors_ = np.linalg.eigh(np.array([entries[k] for k in range(n * n)]).reshape(n, n))
        bases[n] = np.ascontiguousarray(vectors_[:, ::-1])

    def turned(batches):
        for batch in batches:
            for n, part in by_length(batch):
                y = unit(part.column("v")) @ bases[n]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("copies"), pa.array([n] * len(y), pa.int32()), pa.array(np.arccos(np.clip(y[:, 0], -1, 1))), pa.array([x.tobytes() for x in y], pa.binary())], names=["node", "copies", "n", "angle", "y"]
                )

    count = classes.count()
    tile = tile or max(256, min(int(SCALE * math.sqrt(count)), TILE_BYTES // (8 * max(bases, default=1))))
    tiles = max(1, -(-count // tile))
    ranged = classes.select("node", "copies", "v").mapInArrow(turned, "node long, copies long, n int, angle double, y binary").repartitionByRange(tiles, "n", "angle")

    def blocks(batches):
        """Blocks of one task's range, in order of the angle."""
        held: dict = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(row[2], []).append(row)
                if len(held[row[2]]) >= tile:
                    yield block(held.pop(row[2]))
        for part in held.values():
            yield block(part)

    def block(part: list) -> pa.RecordBatch:
        angles = [r[3] for r in part]
        return pa.RecordBatch.from_arrays(
            [pa.array([part[0][2]], pa.int32()), pa.array([min(angles)]), pa.array([max(angles)]), pa.array([np.array([r[0] for r in part], "<i8").tobytes()], pa.binary()), pa.array([np.array([r[1] for r in part], "<i8").tobytes()], pa.binary()), pa.array([b"".join(r[4] for r in part)], pa.binary())],
            names=["n", "low", "high", "nodes", "copies", "y"],
        )

    ordered = ranged.sortWithinPartitions("n", "angle")
    table = scratch.stage(ordered.mapInArrow(blocks, "n int, low double, high double, nodes binary, copies binary, y binary").withColumn("block", F.monotonically_increasing_id()), "embedding-blocks")
    width = math.acos(threshold) + 1e-9
    cells = table.select("n", "block", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width) + 1)).alias("cell"))
    left, right = (cells.select("n", F.col("block").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"), "cell") for x in "ab")
    meet = left.join(right, ["n", "cell"]).where((F.col("a") <= F.col("b")) & (F.col("a_low") - width <= F.col("b_high")) & (F.col("b_low") - width <= F.col("a_high"))).select("n", "a", "b").distinct()
    meet = scratch.stage(meet, "embedding-meet")
    side = lambda x: table.select(F.col("block").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("nodes", "copies", "y")])
    work = meet.join(side("a"), "a").join(side("b"), "b").select("n", "a", "b", "a_nodes", "a_copies", "a_y", "b_nodes", "b_copies", "b_y")

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n, a, b, a_nodes, a_copies, a_y, b_nodes, b_copies, b_y = (c[k].as_py() for c in batch.columns)
                na, nb = np.frombuffer(a_nodes, "<i8"), np.frombuffer(b_nodes, "<i8")
                i, j = close_pairs(np.frombuffer(a_y).reshape(-1, n), np.frombuffer(b_y).reshape(-1, n), threshold)
                if a == b:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                links = np.zeros(len(na) + len(nb), np.int64)
                links[: len(na)] = np.bincount(i, weights=np.frombuffer(b_copies, "<i8")[j], minlength=len(na))
                links[len(na) :] = np.bincount(j, weights=np.frombuffer(a_copies, "<i8")[i], minlength=len(nb))
                nodes = np.concatenate([na, nb])
                ids, back = np.unique(nodes, return_inverse=True)
                label = spanning(len(ids), back[i], back[len(na) + j])
                has = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[has]), pa.array(links[has]), pa.array(ids[label[back[has]]])], names=["node", "links", "least"])

    linked = scratch.stage(work.mapInArrow(compare, "node long, links long, least long"), "embedding-links")
    parts = connected_components(linked.select(F.col("node").alias("src"), F.col("least").alias("dst")), scratch)
    degree = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("node", "rep", "v", "copies").join(degree, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    named = scratch.stage(named, "embedding-groups")
    scratch.release(named)
    out = rows.withColumn("key", F.when(fine, F.col("v"))).join(named.withColumnRenamed("v", "key"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).cast(id_type)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
