"""Paired statistics on unit x method tables, cluster-aware where the design asks for it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def holm(tests: DataFrame, family: list[str]) -> DataFrame:
    """tests(p) with p_holm: step-down maxima of p * (m - i), at most 1; ties by `id`."""
    w = Window.partitionBy(*family)
    d = tests.withColumn("m", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("p", "id")) - 1)
    run = w.orderBy("p", "id").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("p_holm", F.least(F.lit(1.0), F.max(F.col("p") * (F.col("m") - F.col("i"))).over(run))).drop("m", "i")


def average_rank(rows: DataFrame, part: list[str], by: str, name: str, descending: bool = False) -> DataFrame:
    order = F.col(by).desc() if descending else F.col(by).asc()
    r = F.rank().over(Window.partitionBy(*part).orderBy(order)) + (F.count("*").over(Window.partitionBy(*part, by)) - 1) / 2.0
    return rows.withColumn(name, r)


def a12(rows: DataFrame, unit: list[str], label: str) -> DataFrame:
    """P(x > y) + P(x = y) / 2 for label 1 against label 0, from average ranks."""
    r = average_rank(rows, unit, "x", "r")
    g = r.groupBy(*unit).agg(F.sum(F.when(F.col(label) == 1, F.col("r"))).alias("s"), F.sum(F.when(F.col(label) == 1, 1.0)).alias("m"), F.sum(F.when(F.col(label) == 0, 1.0)).alias("n"))
    return g.select(*unit, ((F.col("s") - F.col("m") * (F.col("m") + 1) / 2) / (F.col("m") * F.col("n"))).alias("a12"))


def signed_rank_p(d: np.ndarray) -> float:
    """Two-sided Wilcoxon signed-rank p; zeros dropped; exact without ties up to 50 values, else normal."""
    d = d[d != 0]
    n = len(d)
    if n == 0:
        return 1.0
    r = pd.Series(np.abs(d)).rank().to_numpy()
    w = min(r[d > 0].sum(), r[d < 0].sum())
    if n <= 50 and len(np.unique(np.abs(d))) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    _, c = np.unique(np.abs(d), return_counts=True)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (c**3 - c).sum() / 48)
    return float(math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2))) if sd else 1.0


def wilcoxon(pairs: DataFrame, keys: list[str], types: str) -> DataFrame:
    """p for each key over pairs(..., d); a key is a pair of methods, so groups are as large as there are units."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"n": [len(pdf)], "p": [signed_rank_p(pdf.d.to_numpy(float))]})

    return pairs.groupBy(*keys).applyInPandas(run, f"{types}, n long, p double")


def bootstrap_ci(groups: DataFrame, keys: list[str], resamples: int = 2000, seed: int = 11) -> DataFrame:
    """2.5 % and 97.5 % points of the mean over resampled groups(unit, s, n); multiplicities come from hashes.

    Each group is drawn Poisson(1) times in each resample, so no group list is gathered.
    """
    d = groups.crossJoin(F.broadcast(groups.sparkSession.range(resamples).withColumnRenamed("id", "b")))
    u = (F.pmod(F.xxhash64("unit", "b", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    times, total, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        total += p
        times = times + F.when(u > total, 1).otherwise(0)
        p /= k + 1
    means = d.withColumn("t", times).groupBy(*keys, "b").agg(F.try_divide(F.sum(F.col("s") * F.col("t")), F.sum(F.col("n") * F.col("t"))).alias("mean"))
    return means.groupBy(*keys).agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))


def random_intercept(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[float, float]:
    """(estimate, standard error) of the mean under a random intercept per group, by REML on (n, sum, sum of squares)."""
    big, within = n.sum(), (q - s * s / n).sum()
    mean = s / n

    def deviance(ratio: float) -> tuple[float, float, float]:
        w = n / (1 + ratio * n)
        mu = (w * mean).sum() / w.sum()
        rss = within + (w * (mean - mu) ** 2).sum()
        var = rss / (big - 1)
        return (big - 1) * math.log(max(var, 1e-300)) + np.log1p(ratio * n).sum() + math.log(w.sum()), mu, var / w.sum()

    grid = np.concatenate([[0.0], np.logspace(-6, 4, 400)])
    best = min(grid, key=lambda r: deviance(r)[0])
    _, mu, var = deviance(best)
    return float(mu), math.sqrt(max(var, 0))
