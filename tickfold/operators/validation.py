"""Results held against golden ones by mean relative error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.functions.book import ALPHAS, EPSILON, metric, relative_error

THRESHOLD = 0.01
WINDOW = ("093000", "145700")


def in_window(rows: DataFrame) -> DataFrame:
    """The times that count; narrower than the sessions."""
    return rows.where(F.col("tradeTime").between(*WINDOW))


def aligned(gold: DataFrame, found: DataFrame, epsilon: float = EPSILON, days: list[str] | None = None) -> DataFrame:
    """day, tradeTime and a relative error for each factor, of the full outer join; NaN where one side is missing.
    Only days of gold count; other days are told by ``extra_days``. days: those of gold, where they are known."""
    for rows in (gold, found):
        if missing := [a for a in ALPHAS if a not in rows.columns]:
            raise ValueError(f"missing {', '.join(missing)}")
    own = found.where(F.col("day").isin(days)) if days is not None else found.join(gold.select("day").distinct(), "day", "left_semi")
    a, b = in_window(gold).alias("a"), in_window(own).alias("b")
    both = a.join(b, (F.col("a.day") == F.col("b.day")) & (F.col("a.tradeTime") == F.col("b.tradeTime")), "full_outer")
    return both.select(F.coalesce("a.day", "b.day").alias("day"), F.coalesce("a.tradeTime", "b.tradeTime").alias("tradeTime"), *[relative_error(F.col(f"a.{c}"), F.col(f"b.{c}"), epsilon).alias(c) for c in ALPHAS])


def errors_by_day(errors: DataFrame) -> DataFrame:
    """The mean error of each factor over a day's times; one NaN makes it NaN."""
    return errors.groupBy("day").agg(*[F.avg(a).alias(a) for a in ALPHAS])


def verdict(by_day: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """factor, err (the mean over days, each day alike), shown and ok (below threshold; NaN is not)."""
    means = by_day.agg(*[F.avg(a).alias(a) for a in ALPHAS])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(a).alias("factor"), F.col(a).alias("err")) for a in ALPHAS])).alias("x")).select("x.*")
    return long.select("factor", "err", metric(F.col("err")).alias("shown"), F.coalesce((F.col("err") < threshold) & ~F.isnan("err"), F.lit(False)).alias("ok"))


def missing_days(gold: DataFrame, found: DataFrame) -> DataFrame:
    return gold.select("day").distinct().join(found.select("day"), "day", "left_anti").orderBy("day")


def extra_days(gold: DataFrame, found: DataFrame) -> DataFrame:
    return missing_days(found, gold)


def passes(gold: DataFrame, found: DataFrame) -> bool:
    """Whether no day is missing or extra and every factor is within the threshold."""
    if missing_days(gold, found).limit(1).count() or extra_days(gold, found).limit(1).count():
        return False
    return verdict(errors_by_day(aligned(gold, found))).where(~F.col("ok")).limit(1).count() == 0
