"""Distances of many vectors to many others, tile by tile.

A tile is a bounded block of centroids (or of query vectors) that all tasks hold while they
read the rows once; distances are matrix products. Tiles meet by a combined minimum or sum
for each row, so neither the centroids nor the queries ever have to fit one row or one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.session import materialize

#: Bytes of one tile of vectors.
TILE_BYTES = 4 << 20
#: Rows compared with a tile at a time, and (query, label) sums that a task holds.
ROWS = 2048
SUMS = 1 << 22


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def tiles(table: DataFrame, key: str, rows: int, tile_rows: int) -> Iterator[list]:
    """The rows of a written table in bounded blocks, dealt by hash."""
    n = max(1, math.ceil(rows / tile_rows))
    for i in range(n):
        yield table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i).collect()


def _against(rows: DataFrame, held, schema: str, body: Callable) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            yield body(batch, sent.value)

    return rows.mapInArrow(run, schema)


def nearest_by_tiles(df: DataFrame, means: DataFrame, vector: str, out: str, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Add the label of the nearest mean and its distance; ``means``: label, mean; ties to the smallest label."""
    table = materialize(means.select("label", "mean"), "means")
    labels, width = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("mean")), F.lit(1))).first()
    kind = table.schema["label"].dataType.simpleString()
    names = df.columns
    rows = materialize(df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(vector).cast("array<double>").alias("v"),
                                 F.monotonically_increasing_id().alias("i")), "rows")

    def best(batch: pa.RecordBatch, tile) -> pa.RecordBatch:
        names_, centres, squares = tile
        x = _matrix(batch.column(1))
        d = (x ** 2).sum(1)[:, None] - 2 * x @ centres.T + squares
        # products round: all that may be nearest are compared once more, difference by difference
        at, c = np.nonzero(d <= d.min(1)[:, None] + 1e-9 * (1 + np.abs(d).max(1))[:, None])
        exact = ((x[at] - centres[c]) ** 2).sum(1)
        order = np.lexsort((c, exact, at))
        first = order[np.unique(at[order], return_index=True)[1]]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact[first]), names_.take(pa.array(c[first]))], names=["i", "d", "label"])

    parts = []
    for tile in tiles(table, "label", labels, max(1, tile_bytes // (8 * width))):
        if tile:
            tile.sort(key=lambda r: r["label"])
            centres = np.array([r["mean"] for r in tile], np.float64)
            held = (pa.array([r["label"] for r in tile], LABEL[kind]), centres, (centres ** 2).sum(1))
            parts.append(_against(rows.select("i", "v"), held, f"i long, d double, label {kind}", best))
    if not parts:
        return df.withColumns({out: F.lit(None).cast(kind), "distance": F.lit(None).cast("double")})
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("i").agg(F.min(F.struct("d", "label")).alias("best"))
    return rows.join(found, "i").select("row.*", F.col("best.label").alias(out), F.sqrt("best.d").alias("distance"))


def silhouettes_by_tiles(df: DataFrame, table: DataFrame, label: str, vector: str, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Add the silhouette on squared distances; ``table``: label, n, sq (mean square), mean.

    A row takes its own cluster from one tile and the nearest other one from any.
    """
    table = materialize(table.select("label", "n", "sq", "mean"), "clusters")
    labels, width = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("mean")), F.lit(1))).first()
    rows = materialize(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(label).alias("label"),
                                 F.col(vector).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("i")), "rows")

    def part(batch: pa.RecordBatch, tile) -> pa.RecordBatch:
        place, n, squares, means = tile
        x = _matrix(batch.column(2))
        d = (x ** 2).sum(1)[:, None] - 2 * x @ means.T + squares
        own = np.array([place.get(v, -1) for v in batch.column(1).to_pylist()], np.int64)
        here, at = own >= 0, np.arange(len(x))
        mine = np.where(here, d[at, np.maximum(own, 0)], np.nan)
        d[at[here], own[here]] = np.inf
        other = d.min(1)
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(mine, mask=~here), pa.array(np.where(here, n[np.maximum(own, 0)], 0), mask=~here),
            pa.array(other, mask=np.isinf(other))], names=["i", "own", "n", "other"])

    parts = []
    for tile in tiles(table, "label", labels, max(1, tile_bytes // (8 * width))):
        if tile:
            held = ({r["label"]: k for k, r in enumerate(tile)}, np.array([r["n"] for r in tile]), np.array([r["sq"] for r in tile]),
                    np.array([r["mean"] for r in tile], np.float64))
            parts.append(_against(rows.select("i", "label", "v"), held, "i long, own double, n long, other double", part))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("i").agg(F.max("own").alias("own"), F.max("n").alias("n"), F.min("other").alias("b"))
    a = F.col("own") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))
    value = F.when(F.col("n") == 1, F.lit(0.0)).otherwise((F.col("b") - a) / F.greatest("b", a))
    return rows.drop("label").join(found, "i").select("row.*", value.alias("silhouette"))


def euclidean_silhouettes(df: DataFrame, key: str, label: str, vector: str, queries, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Silhouette on plain distances for the query rows: key, label, silhouette.

    ``queries`` is a condition, such as ``key % 50 = 0``: the mean distance of a row to each
    cluster needs all rows, so a stated set of queries is compared with all of them, block by
    block. Each block is one reading, which adds up distances by (query, label).
    """
    rows = materialize(df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"),
                                 queries.alias("asked"), F.monotonically_increasing_id().alias("i")), "rows")
    counts = materialize(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "counts")
    asked = rows.where("asked")
    many, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    labels = counts.count()
    size = max(1, min(tile_bytes // (8 * width), SUMS // max(labels, 1)))
    kind = rows.schema["label"].dataType.simpleString()
    parts = []
    for block in tiles(asked, "i", many, size):
        if not block:
            continue
        sent = rows.sparkSession.sparkContext.broadcast(([r["i"] for r in block], np.array([r["v"] for r in block], np.float64)))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            total: dict = {}
            for batch in _pieces(batches):
                x = _matrix(batch.column(1))
                names = batch.column(0).to_pylist()
                known = {v: k for k, v in enumerate(dict.fromkeys(names))}
                member = np.array([known[v] for v in names])
                d = np.sqrt(np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ q.T + (q ** 2).sum(1), 0))
                for v, k in known.items():
                    total[v] = total.get(v, 0) + d[member == k].sum(0)
            for v, s in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([v] * len(ids), LABEL[kind]), pa.array(s)],
                                                 names=["i", "label", "total"])

        parts.append(rows.select("label", "v").mapInArrow(sums, f"i long, label {kind}, total double"))
    if not parts:
        return df.sparkSession.createDataFrame([], f"key long, label {kind}, silhouette double")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    each = every.groupBy("i", "label").agg(F.sum("total").alias("total")).join(F.broadcast(counts) if labels <= 100_000 else counts, "label")
    own = asked.select("i", "key", F.col("label").alias("mine"))
    same = F.col("label") == F.col("mine")
    found = each.join(own, "i").groupBy("i", "key", "mine").agg(
        F.max(F.when(same, F.col("n"))).alias("n"), F.max(F.when(same, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"))
    value = F.when(F.col("n") == 1, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return found.select(F.col("key").alias(key), F.col("mine").alias(label), value.alias("silhouette"))


#: Arrow types of the labels.
LABEL = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}
