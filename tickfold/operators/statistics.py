"""What a series of run times tells: rows of elapsed DOUBLE, null for a run that failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds between the groups of fast, usual and slow runs.
CUTS = (6.25, 7.25)


def valid(runs: DataFrame) -> DataFrame:
    return runs.na.drop(subset=["elapsed"])


def group(elapsed: Column, cuts: tuple[float, ...] = CUTS) -> Column:
    """0 below the first cut, 1 from it on, and so on."""
    return sum(((elapsed >= c).cast("int") for c in cuts), F.lit(0))


def _quantiles(places: tuple[float, ...], accuracy: int | None) -> Column:
    """Exact quantiles, for which a task holds the distinct values of a group, or with accuracy such whose rank is off by
    at most a share of 1 / accuracy, from a sketch of bounded size."""
    at = F.array(*[F.lit(p) for p in places])
    return F.percentile("elapsed", at) if accuracy is None else F.percentile_approx("elapsed", at, accuracy)


def summary(runs: DataFrame, by: tuple[str, ...] = (), accuracy: int | None = None) -> DataFrame:
    """by, runs, n (those that ended), mean, median, sd, se, min and max; sd and se are 0 for a single run."""
    e = F.col("elapsed")
    sd = F.coalesce(F.stddev_samp(e), F.lit(0.0))
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count(e).alias("n"), F.avg(e).alias("mean"), F.get(_quantiles((0.5,), accuracy), F.lit(0)).alias("median"), sd.alias("sd"), (sd / F.sqrt(F.count(e))).alias("se"), F.min(e).alias("min"), F.max(e).alias("max"))


def histogram(runs: DataFrame, bins: int = 150) -> DataFrame:
    """bin, n and density of equal bins from the least to the largest; the last holds its upper end. Empty bins are left
    out. Least and largest are joined as one row."""
    rows = valid(runs)
    ends = rows.agg(F.min("elapsed").alias("lo"), F.max("elapsed").alias("hi"), F.count("*").alias("all"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("elapsed") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    binned = rows.crossJoin(F.broadcast(ends)).select(F.when(width > 0, place).otherwise(0).alias("bin"), width.alias("w"), "all")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), (F.count("*") / (F.first("all") * F.first("w"))).alias("density"))


def box(runs: DataFrame, accuracy: int | None = None) -> DataFrame:
    """q1, median, q3, the whiskers' ends within 1.5 ranges of the quartiles, and how many runs lie beyond."""
    rows = valid(runs)
    q = rows.agg(_quantiles((0.25, 0.5, 0.75), accuracy).alias("q")).select(*[F.get("q", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col("elapsed").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.crossJoin(F.broadcast(q)).groupBy("q1", "median", "q3").agg(F.min(F.when(near, F.col("elapsed"))).alias("low"), F.max(F.when(near, F.col("elapsed"))).alias("high"), F.count_if(~near).alias("fliers"))


def mixture(runs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """component, weight, mean and variance of a Gaussian mixture, by mean."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["elapsed"], outputCol="features").transform(valid(runs))
    model = GaussianMixture(k=k, seed=seed).fit(rows)
    found = sorted((float(g.mean[0]), float(g.cov.toArray()[0, 0]), float(w)) for g, w in zip(model.gaussians, model.weights))
    return runs.sparkSession.createDataFrame([(i, w, m, v) for i, (m, v, w) in enumerate(found)], "component int, weight double, mean double, variance double")


def densities(parts: DataFrame, low: float, high: float, points: int = 1000) -> DataFrame:
    """x and density of a mixture on an even grid."""
    grid = parts.sparkSession.range(points).select((F.lit(low) + F.col("id") * F.lit((high - low) / (points - 1))).alias("x"))
    pdf = F.col("weight") * F.exp(-F.pow(F.col("x") - F.col("mean"), 2) / (2 * F.col("variance"))) / F.sqrt(2 * F.pi() * F.col("variance"))
    return grid.crossJoin(F.broadcast(parts)).groupBy("x").agg(F.sum(pdf).alias("density"))
