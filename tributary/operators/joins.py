"""Equi-joins of two relations by named physical strategies, steered with hints.

All names give the same rows: a true inner join, whatever repeats on either side. Null keys match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of keys that `mpsm` merges each for itself.
RUNS = 32
#: Bytes, as the optimizer estimates them, up to which a side is broadcast or met by nested loops.
MOST_BROADCAST, MOST_NESTED = 64 << 20, 16 << 20


@dataclass(frozen=True)
class Strategy:
    hint: str
    operator: str
    single: bool = False


STRATEGIES = {
    "npo": Strategy("broadcast", "BroadcastHashJoin"),
    "npo_st": Strategy("broadcast", "BroadcastHashJoin", True),
    "pro": Strategy("shuffle_hash", "ShuffledHashJoin"),
    "prh": Strategy("shuffle_hash", "ShuffledHashJoin"),
    "prho": Strategy("shuffle_hash", "ShuffledHashJoin"),
    "rj": Strategy("shuffle_hash", "ShuffledHashJoin", True),
    "m_pass": Strategy("merge", "SortMergeJoin"),
    "m_way": Strategy("merge", "SortMergeJoin"),
    "mpsm": Strategy("merge", "SortMergeJoin"),
    "nl": Strategy("shuffle_replicate_nl", "CartesianProduct"),
}
#: Build and probe sides partitioned or not, and probing by stealing, as a strategy each.
SIDES = {(True, True): "pro", (False, True): "npo", (False, False): "npo", (True, False): "pro"}


def size_of(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def choose(name: str, build: DataFrame) -> Strategy:
    """The strategy of a name. A build side too large to broadcast falls back to a shuffled hash join; nested loops over a large
    one raise ValueError."""
    key = name.lower().replace("-", "_")
    if key not in STRATEGIES:
        raise ValueError(f"unknown join algorithm {name!r}")
    own = STRATEGIES[key]
    if own.hint == "broadcast" and size_of(build) > MOST_BROADCAST:
        return Strategy("shuffle_hash", "ShuffledHashJoin", own.single)
    if own.hint == "shuffle_replicate_nl" and size_of(build) > MOST_NESTED:
        raise ValueError("nested loops are for small build sides only")
    return own


def sides(build_partitioned: bool, probe_partitioned: bool, steal: bool = False) -> str:
    """The algorithm name for a choice of sides; stealing needs an unpartitioned build side."""
    if steal and build_partitioned:
        raise ValueError("stealing needs an unpartitioned build side")
    return SIDES[build_partitioned, probe_partitioned]


def _keyed(df: DataFrame, key: str, columns: list[str], side: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), *[F.col(c).alias(f"{side}_{c}") for c in columns])


def join(name: str, r: DataFrame, s: DataFrame, r_key: str, s_key: str, r_columns: list[str], s_columns: list[str]) -> DataFrame:
    """(key, r_<columns>, s_<columns>) of all pairs with equal keys; R is the build side. Names can't clash."""
    own = choose(name, r)
    left, right = _keyed(r, r_key, r_columns, "r"), _keyed(s, s_key, s_columns, "s")
    on = ["key"]
    if name.lower() == "mpsm":
        # runs end at quantiles of R's keys, so that each holds as many of its rows; they are found while the query runs
        ends = left.agg(F.percentile_approx("key", [i / RUNS for i in range(1, RUNS)])).scalar()
        run = F.when(F.col("ends").isNull(), 0).otherwise(F.size(F.filter("ends", lambda e: e < F.col("key"))))
        left, right = (t.withColumn("ends", ends).withColumn("run", run).drop("ends") for t in (left, right))
        on = ["run", "key"]
    if own.single:
        left, right = left.coalesce(1), right.coalesce(1)
    out = right.join(left.hint(own.hint), on, "inner")
    return out.select("key", *[f"r_{c}" for c in r_columns], *[f"s_{c}" for c in s_columns])


def count(name: str, r: DataFrame, s: DataFrame, r_key: str, s_key: str) -> DataFrame:
    return join(name, r, s, r_key, s_key, [], []).agg(F.count(F.lit(1)).alias("matches"))


def semi(r: DataFrame, s: DataFrame, r_key: str, s_key: str) -> DataFrame:
    """The rows of S that have a match, each once: what a merge that moves on in S alone gives where R's keys repeat."""
    return s.join(r.select(F.col(r_key).cast("long").alias("_key")).hint("merge"), F.col(s_key).cast("long") == F.col("_key"), "left_semi")


def histogram(rows: DataFrame, key: str = "key", mask: int = 511) -> DataFrame:
    return rows.groupBy(F.col(key).bitwiseAND(F.lit(mask).cast("long")).alias("slot")).agg(F.count(F.lit(1)).alias("matches"))


def _by_id(df: DataFrame, ids: list[str], columns: list[str], side: str) -> DataFrame:
    names = [f"{side}_{c}" for c in ids]
    others = [F.col(c).alias(f"{side}_{c}") for c in dict.fromkeys(columns) if c not in ids]
    grouped = df.groupBy(*[F.col(c).alias(n) for c, n in zip(ids, names)]).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(1).alias("_one"), *others)).alias("_row"))
    once = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("row ids repeat")))
    return grouped.withColumn("_row", once).select(*names, *[F.col(f"_row.{side}_{c}") for c in dict.fromkeys(columns) if c not in ids])


def late(r: DataFrame, s: DataFrame, r_key: str, s_key: str, r_id: list[str], s_id: list[str], r_columns: list[str], s_columns: list[str]) -> DataFrame:
    """Keys and row ids are joined first; columns come by joining back on the ids, so wide rows move only where they match.

    Ids must be unique on their side; a repeated one fails the query when it runs, as it would repeat pairs."""
    pairs = join("pro", r, s, r_key, s_key, r_id, s_id)
    wide_r, wide_s = _by_id(r, r_id, r_columns, "r"), _by_id(s, s_id, s_columns, "s")
    out = pairs.join(wide_r, [f"r_{c}" for c in r_id]).join(wide_s, [f"s_{c}" for c in s_id])
    return out.select("key", *[f"r_{c}" for c in r_columns], *[f"s_{c}" for c in s_columns])


def salted(r: DataFrame, s: DataFrame, r_key: str, s_key: str, r_columns: list[str], s_columns: list[str], rows: int = 100_000) -> DataFrame:
    """An inner join in which a key with more than `rows` rows in S is spread over as many tasks as it takes.

    Only the hot keys of R are repeated. There are at most |S| / rows of them, so the table of hot keys is joined as AQE finds its
    size when the query runs: by broadcast below its limit, by a shuffle above."""
    left, right = _keyed(r, r_key, r_columns, "r"), _keyed(s, s_key, s_columns, "s")
    hot = right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select("key", F.ceil(F.col("n") / rows).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    one = left.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    two = right.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64(*[c for c in right.columns]), salts).cast("int")).drop("salts")
    return two.join(one.hint("shuffle_hash"), ["key", "salt"]).select("key", *[f"r_{c}" for c in r_columns], *[f"s_{c}" for c in s_columns])


def physical(df: DataFrame) -> str:
    """The plan that runs, for assertions."""
    return df._jdf.queryExecution().executedPlan().toString()


def edge_selectivity(r: DataFrame, s: DataFrame, r_key: str, s_key: str, name: str) -> DataFrame:
    """(edge, matches, selectivity): the matches of an equi-join, and their part of all pairs; both sides are counted once each."""
    ones = lambda df, key, n: df.groupBy(F.col(key).cast("long").alias("key")).agg(F.count(F.lit(1)).alias(n))
    both = ones(r, r_key, "r").join(ones(s, s_key, "s"), "key", "full")
    sums = both.agg(F.sum(F.col("r") * F.col("s")).alias("m"), F.sum("r").alias("r"), F.sum("s").alias("s"))
    matches = F.coalesce("m", F.lit(0))
    return sums.select(F.lit(name).alias("edge"), matches.alias("matches"), (matches / (F.col("r").cast("double") * F.col("s"))).alias("selectivity"))


def pass_rate(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """(relation, rows, effective_rows, pass_rate), measured in one scan."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(condition.cast("long")), F.lit(0)).alias("effective_rows")).select(F.lit(name).alias("relation"), "rows", "effective_rows", F.round(F.col("effective_rows") / F.col("rows"), 6).alias("pass_rate"))
