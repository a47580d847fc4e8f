"""Relations (key, payload) from a seed. The payload is the row number; the same arguments give the same rows on any cluster."""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

R_SEED, S_SEED = 12345, 54321
FULL_RANGE = 2_147_483_647


def _affine(n: int, seed: int) -> tuple[int, int]:
    """(a, b) of the permutation i -> (a*i + b) mod n; a stays below 2^31, so that products fit 64 bits for n up to 2^32."""
    a = (seed * 2_654_435_761 + 1_013_904_223) % min(max(n, 2), 1 << 31) | 1
    while gcd(a, max(n, 1)) != 1:
        a += 2
    return a, (seed * 40_503 + 7) % max(n, 1)


def _permuted(i: Column, n: int, seed: int) -> Column:
    a, b = _affine(n, seed)
    return (i * F.lit(a) + F.lit(b)) % F.lit(n) + F.lit(1)


def _unit(i: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from a row number."""
    return F.shiftrightunsigned(F.xxhash64(i, F.lit(seed)), 11) / F.lit(float(1 << 53))


def primary_key(spark: SparkSession, n: int, seed: int = R_SEED) -> DataFrame:
    """Keys 1..n, each once, in scattered order."""
    return spark.range(n).select(_permuted(F.col("id"), n, seed).alias("key"), F.col("id").alias("payload"))


def foreign_key(spark: SparkSession, n: int, most: int, seed: int = S_SEED) -> DataFrame:
    """n rows that go through permutations of 1..most again and again."""
    return spark.range(n).select(_permuted(F.col("id") % most, most, seed).alias("key"), F.col("id").alias("payload"))


def foreign_key_of(primary: DataFrame, n: int, size: int) -> DataFrame:
    """n rows whose keys are those of primary (payloads 0..size-1), again and again."""
    rows = primary.sparkSession.range(n).select((F.col("id") % size).alias("at"), F.col("id").alias("payload"))
    return rows.join(primary.select(F.col("payload").alias("at"), "key"), "at").select("key", "payload")


def non_unique(spark: SparkSession, n: int, most: int, seed: int = R_SEED) -> DataFrame:
    """Uniform keys in [0, most), with repeats."""
    return spark.range(n).select(F.floor(_unit(F.col("id"), seed) * most).cast("long").alias("key"), F.col("id").alias("payload"))


def full_range(spark: SparkSession, n: int, seed: int = R_SEED) -> DataFrame:
    return non_unique(spark, n, FULL_RANGE, seed)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit ones, by the finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53) + 2.0**-54


def zipf_ranks(ids: np.ndarray, alphabet: int, theta: float, seed: int) -> np.ndarray:
    """A rank in 1..alphabet for each id, with probability in proportion to 1/rank^theta: rejection-inversion (Hoermann and Derflinger,
    1996), exact for any alphabet without a table. The t-th try of an id takes its t-th number, so a rank depends on the id alone."""
    if alphabet < 1 or theta <= 0:
        raise ValueError("the alphabet must have keys, and theta be above 0")
    flat = abs(theta - 1.0) < 1e-9
    area = lambda x: np.log(x) if flat else np.expm1((1 - theta) * np.log(x)) / (1 - theta)
    back = lambda y: np.exp(y) if flat else np.exp(np.log1p(np.maximum(y * (1 - theta), -1 + 1e-16)) / (1 - theta))
    low, high = area(1.5) - 1.0, area(alphabet + 0.5)
    near = 2.0 - back(area(2.5) - 2.0**-theta)
    out, left, t = np.zeros(len(ids), "int64"), np.arange(len(ids)), 0
    start = ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64))
    while len(left):
        u = high + _mixed(start[left] + np.uint64(t * 0xA0761D6478BD642F % (1 << 64))) * (low - high)
        x = back(u)
        k = np.clip(np.floor(x + 0.5), 1, alphabet)
        good = (k - x <= near) | (u >= area(k + 0.5) - k**-theta)
        out[left[good]] = k[good]
        left, t = left[~good], t + 1
    return out


def zipf(spark: SparkSession, n: int, alphabet: int, theta: float, seed: int = S_SEED) -> DataFrame:
    """n keys of 1..alphabet, the i-th of a permutation with probability in proportion to 1/i^theta."""
    zipf_ranks(np.arange(0), alphabet, theta, seed)

    @F.pandas_udf("long")
    def rank(i):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(zipf_ranks(i.to_numpy(), alphabet, theta, seed))

    return spark.range(n).select(_permuted(rank("id"), alphabet, seed).alias("key"), F.col("id").alias("payload"))


def text_relations(spark: SparkSession, r_size: int, s_size: int, seed: int = S_SEED) -> tuple[DataFrame, DataFrame]:
    """Lines `i|i` of the build side, and `row|key` of the probe side with uniform keys of the build side, as one column `value`."""
    probe = non_unique(spark, s_size, r_size, seed)
    return spark.range(r_size).select(F.concat_ws("|", "id", "id").alias("value")), probe.select(F.concat_ws("|", "payload", "key").alias("value"))


def generate(spark: SparkSession, n: int, alphabet: int, theta: float = 0.0, seed: int = R_SEED) -> DataFrame:
    """Zipf for theta above 0, a primary key where n is the alphabet, a foreign key else."""
    if theta > 0:
        return zipf(spark, n, alphabet, theta, seed)
    return primary_key(spark, n, seed) if n == alphabet else foreign_key(spark, n, alphabet, seed)


def workload(spark: SparkSession, r_size: int = 128_000_000, s_size: int = 128_000_000, r_seed: int = R_SEED, s_seed: int = S_SEED, skew: float = 0.0, unique: bool = True, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(R, S) by the options of a run; options that exclude each other raise ValueError."""
    if skew > 0 and (whole or not unique) or whole and not unique:
        raise ValueError("skew, non-unique keys and the full range exclude each other")
    if whole:
        r = full_range(spark, r_size, r_seed)
        return r, foreign_key_of(r, s_size, r_size)
    if not unique:
        return non_unique(spark, r_size, r_size, r_seed), non_unique(spark, s_size, r_size, s_seed)
    r = primary_key(spark, r_size, r_seed)
    return r, zipf(spark, s_size, r_size, skew, s_seed) if skew > 0 else foreign_key(spark, s_size, r_size, s_seed)
