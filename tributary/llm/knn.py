"""Exact top-k by inner product: a Voronoi kNN join with pivots, summaries and bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.runtime import local, map_batches, table

PIVOTS = 64
#: Score of a query against itself. Its negative is in range too, so that it sorts last.
NEVER = np.iinfo(np.int64).min + 1
#: Rows of a group, and queries, that one task meets; larger groups are cut into parts, and queries into blocks.
PART_ROWS, QUERY_ROWS = 4096, 8192


def integers(vectors: DataFrame, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; vectors null or with null or non-finite components go."""
    ok = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull()).where(ok).select(F.col(key).cast("long").alias("id"), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if n and len(flat) % n or n and len(set(np.diff(col.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats where they hold every sum exactly, by 64-bit integers elsewhere."""
    top = np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0).astype(float) * a.shape[1]
    if top < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if top >= 2**63:
        raise ValueError("an inner product may leave 64 bits")
    return a @ b.T


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products among vectors (id, v) with other ids; ties to the
    smaller id, all if there are fewer.

    1. Pivots are a bounded sample of vectors. Each vector joins the group of its nearest pivot. A group's summary is its
       size, its radius about the pivot and, for each component, the least and largest value: PIVOTS rows for the driver, whatever the input.
    2. For a query, a group's score is at most the sum of q_i times the end of component i that makes it larger, and at most
       its product with the pivot and the radius times the query's length; at least the same with the other end, and less the
       radius. The k-th largest of the lower bounds, each counted as often as its group has rows, or of the products with
       the pivots, is a floor (k+1-th, as the query itself may be there): groups whose upper bound is below it hold no answer.
    3. A query goes only to the other groups (all parts of a large one), a group only to blocks of queries that need it. There
       scores are exact, and each part's few best are merged.

    A vector that is shorter than others counts as 0 where they go on. Vectors with one id stay apart, as do queries with one id, which
    each get their k. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or pivots < 1:
        return spark.createDataFrame([], schema)
    even = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(max(width, 1)) - F.size("v"))).alias("v")
    rows = table(vectors.select("id", even))
    wide = queries.agg(F.max(F.size("v"))).first()[0] or 0
    if wide > width:  # what no vector has makes no difference
        queries = queries.withColumn("v", F.slice("v", 1, max(width, 1)))
    asked = table(queries.select("id", even, F.monotonically_increasing_id().alias("r")))
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(pivots).collect()], float)
    half = (sample**2).sum(axis=1) / 2

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)).astype(float)
            near = np.argmax(x @ sample.T - half, axis=1)
            away = np.sqrt(((x - sample[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(away)], ["id", "v", "cell", "away"])

    voronoi = table(map_batches(rows, grouped, "id long, v array<long>, cell int, away double"))
    known = {r.cell: (r.n, r.radius) for r in voronoi.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    cuts = {c: max(1, round(m / PART_ROWS)) for c, (m, _) in known.items()}
    cut = F.create_map(*[x for c, m in cuts.items() for x in (F.lit(c), F.lit(m))])[F.col("cell")]
    blocks = max(1, round(asked.count() / QUERY_ROWS))
    ends = voronoi.select("cell", F.posexplode("v").alias("i", "x")).groupBy("cell", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    summary = local(ends.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("e")).select("cell", F.col("e.low").alias("low"), F.col("e.high").alias("high")).orderBy("cell"))
    low, high = np.array(summary.low.tolist(), float), np.array(summary.high.tolist(), float)
    names = summary.cell.to_numpy(np.int32)
    count, radius = (np.array([known[c][i] for c in names.tolist()], float) for i in (0, 1))
    centre = sample[names]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                own = batch.slice(a, 256)
                q = _matrix(own.column(1)).astype(float)
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                near, reach = q @ centre.T, np.sqrt((q**2).sum(axis=1))[:, None] * radius
                top = np.minimum(up @ high.T + down @ low.T, near + reach)
                bottom = np.maximum(up @ low.T + down @ high.T, near - reach)
                order = np.argsort(-bottom, axis=1)
                held = np.cumsum(count[order], axis=1)
                at = np.argmax(held >= k + 1, axis=1)
                floor = np.where(held[:, -1] >= k + 1, np.take_along_axis(bottom, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], -np.inf)
                if len(sample) > k:
                    floor = np.maximum(floor, -np.partition(-(q @ sample.T), k, axis=1)[:, k])
                floor -= 1e-9 * (1 + np.abs(top).max(axis=1) + np.abs(bottom).max(axis=1))  # what floats may be off
                qi, pi = np.nonzero(top >= floor[:, None])
                qi = pa.array(qi)
                yield pa.RecordBatch.from_arrays([pa.array(names[pi]), own.column(0).take(qi), own.column(2).take(qi), own.column(1).take(qi)], ["cell", "q", "r", "v"])

    sent = map_batches(asked.select("id", "v", "r"), routed, "cell int, q long, r long, v array<long>")
    sent = table(sent.select("cell", F.explode(F.sequence(F.lit(0), (cut - 1).cast("int"))).alias("part"), F.pmod(F.xxhash64("r", F.lit(31)), F.lit(blocks)).cast("int").alias("block"), "q", "r", "v"))
    key = ["cell", "part", "block"]
    needed = sent.select(*key).distinct().select("cell", "part", (F.col("block") + 0).alias("block"))
    parted = voronoi.select("cell", F.pmod(F.xxhash64("id", F.lit(29)), cut).cast("int").alias("part"), "id", "v").join(needed, ["cell", "part"])

    def solved(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q", "r", "id", "score")})
        if not len(left) or not len(right):
            return none
        right = right.sort_values("id", kind="stable")
        x, ids = np.stack(right["v"].to_numpy()), right["id"].to_numpy()
        out = [none]
        for a in range(0, len(left), 256):
            block = left[a : a + 256]
            s = _exact(np.stack(block["v"].to_numpy()), x)
            s[block["q"].to_numpy()[:, None] == ids[None, :]] = NEVER
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids are in order, so ties fall to the smaller
            val = np.take_along_axis(s, best, 1)
            out.append(pd.DataFrame({"q": np.repeat(block["q"].to_numpy(), best.shape[1]), "r": np.repeat(block["r"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "score": val.ravel()}))
        found = pd.concat(out)
        return found[found["score"] != NEVER]

    scored = sent.groupBy(*key).cogroup(parted.groupBy(*key)).applyInPandas(solved, T.StructType([T.StructField(c, T.LongType()) for c in ("q", "r", "id", "score")]))
    merged = scored.groupBy("q", "r").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))
    return merged.select(F.col("q").alias("query_id"), F.posexplode("best").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """top_k of all rows for the queries whose key is divisible by every."""
    own = table(integers(vectors, 256, key, column))
    return top_k(own, own.where(F.col("id") % every == 0), k)
