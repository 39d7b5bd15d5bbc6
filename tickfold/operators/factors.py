"""From snapshots to factors to means: the state of the snapshot before, the session filter, the cross-section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickfold.functions.book import ALPHAS, SESSIONS, depth_sums, factors, in_session

#: A file; the stock stands first because sorts compare the first key fastest, and days are few.
SEQUENCE = ("stock", "day")
#: Order of the lines of a file: the place of the split they were read in, where there is one, and the line's in it.
ORDER = ("start", "pos")


def with_depth(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumns(depth_sums())


def with_previous(rows: DataFrame) -> DataFrame:
    """Adds prev: sec, ap1, bp1, sb and sa of the line before in the same file, null for the first line and where time
    goes back. The order is the file's, not the clock's; equal times are no reset, and neither is a break."""
    order = Window.partitionBy(*SEQUENCE).orderBy(*[c for c in ORDER if c in rows.columns])
    held = ("sec", "ap1", "bp1", "sb", "sa")
    rows = rows.withColumns({f"_{c}": F.lag(c).over(order) for c in held})
    return rows.withColumn("prev", F.when(F.col("_sec") <= F.col("sec"), F.struct(*[F.col(f"_{c}").alias(c) for c in held]))).drop(*[f"_{c}" for c in held])


def snapshot_factors(snapshots: DataFrame, keep: tuple[str, ...] = (), alphas: tuple[str, ...] = ALPHAS) -> DataFrame:
    """day, sec, keep and alphas of the snapshots in session. The filter comes after the state: a session's first
    snapshot is compared with the last one before it."""
    rows, own = with_previous(with_depth(snapshots)), factors()
    return rows.where(in_session()).select("day", "sec", *keep, *[own[a].alias(a) for a in alphas])


def cross_mean(rows: DataFrame, alphas: tuple[str, ...] = ALPHAS) -> DataFrame:
    """day, sec and the mean of each factor over all rows there are at that time; nothing is filled in.

    Factors are never null, so one count serves all of them: half the buffers that as many averages would carry."""
    return rows.groupBy("day", "sec").agg(*[(F.sum(a) / F.count(F.lit(1))).alias(a) for a in alphas])


def partial_sums(rows: DataFrame, by: tuple[str, ...] = (), alphas: tuple[str, ...] = ALPHAS) -> DataFrame:
    """day, sec, by, sum_1 to sum_n and cnt: what can be added up later, as by a job that gets a day in parts."""
    return rows.groupBy("day", "sec", *by).agg(*[F.sum(a).alias(a.replace("alpha", "sum")) for a in alphas], F.count("*").alias("cnt"))


def merge_sums(parts: DataFrame, alphas: tuple[str, ...] = ALPHAS) -> DataFrame:
    """The means of partial sums."""
    return parts.groupBy("day", "sec").agg(*[(F.sum(a.replace("alpha", "sum")) / F.sum("cnt")).alias(a) for a in alphas])


def day_local_means(snapshots: DataFrame, alphas: tuple[str, ...] = ALPHAS) -> DataFrame:
    """The same means with whole days dealt to tasks: one exchange, of the raw rows, serves the row before and the groups.

    For many days of moderate size, as a day is one task's work; ``factor_means`` cuts finer."""
    return cross_mean(snapshot_factors(snapshots.repartition("day"), alphas=alphas), alphas)


def fixed_mean(rows: DataFrame, stocks: int = 300, alphas: tuple[str, ...] = ALPHAS) -> DataFrame:
    """Sums over a fixed number of stocks, as an older form of the job had it; biased where stocks are missing."""
    return rows.groupBy("day", "sec").agg(*[(F.sum(a) / F.lit(stocks)).alias(a) for a in alphas])


def dense_grid(means: DataFrame, step: int = 3) -> DataFrame:
    """A row for every step of the sessions of each day in means; factors are null where there is no row."""
    days = means.select("day").distinct()
    ticks = F.concat(*[F.sequence(F.lit(a), F.lit(z), F.lit(step)) for a, z in SESSIONS])
    return days.select("day", F.explode(ticks).alias("sec")).join(means, ["day", "sec"], "left")


def factor_means(snapshots: DataFrame, alphas: tuple[str, ...] = ALPHAS) -> DataFrame:
    """The whole job: two exchanges, one for the order within files, one for the groups after partial sums."""
    return cross_mean(snapshot_factors(snapshots, alphas=alphas), alphas)
