"""The factors of a stream of snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickfold.functions.book import ALPHAS, factors, in_session
from tickfold.operators.factors import ORDER, with_depth

STATE = "sec int, ap1 double, bp1 double, sb double, sa double"


def with_previous(rows: DataFrame) -> DataFrame:
    """rows with prev, as the batch operator makes it, by state kept for each day and stock; lag is not for streams.
    Rows of one file in one batch are put in the file's order; files are to arrive in order. State is one row."""
    schema, names = rows.schema, rows.columns
    order, held = [c for c in ORDER if c in names], ["sec", "ap1", "bp1", "sb", "sa"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(parts)).sort_values(order, ignore_index=True)
        prev = x[held].shift(1).astype("float64")
        if state.exists:
            prev.loc[0] = list(state.get)
        prev[~(prev["sec"] <= x["sec"])] = float("nan")
        state.update((int(x["sec"].iloc[-1]), *x[held[1:]].iloc[-1].astype(float).tolist()))
        yield pd.concat([x[names], prev.add_prefix("_")], axis=1)

    flat = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", _sec double, _ap1 double, _bp1 double, _sb double, _sa double"
    out = rows.groupBy("day", "stock").applyInPandasWithState(step, flat, STATE, "append", GroupStateTimeout.NoTimeout)
    prev = F.when(F.col("_sec").isNotNull() & ~F.isnan("_sec"), F.struct(F.col("_sec").alias("sec"), F.col("_ap1").alias("ap1"), F.col("_bp1").alias("bp1"), F.col("_sb").alias("sb"), F.col("_sa").alias("sa")))
    return out.select(*names, prev.alias("prev"))


def factor_means(snapshots: DataFrame, ts: str | None = None, late: str = "1 minute") -> DataFrame:
    """Means as they stand, for output mode complete or update; with ts, an event time, a watermark lets groups close."""
    own = factors()
    keep = [ts] if ts else []
    rows = with_previous(with_depth(snapshots)).where(in_session()).select("day", "sec", *keep, *[own[a].alias(a) for a in ALPHAS])
    if ts:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(*keep, "day", "sec").agg(*[F.avg(a).alias(a) for a in ALPHAS])
