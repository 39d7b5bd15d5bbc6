"""What the operators of this folder share: tables, lineage cuts in the shared folder, components of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickfold.sources.scratch import cut, drop, new_path, shared_dir

__all__ = ["SPACE", "bit_filter", "bit_split", "components", "cut", "drop", "new_path", "shared_dir", "slices", "table"]
#: White space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, as Python objects of a whole batch of long texts would be many."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _marked(df: DataFrame, key: str, wanted: DataFrame, most_bits: int) -> DataFrame:
    """df with _maybe: false for most rows whose key (a long, a hash) is not in wanted, true for all whose key is.

    A bit for each key, 16 bits for each wanted row but at most most_bits (16 MB), goes to all tasks as bitmaps of 4 KB.
    Beyond that bound more rows are marked."""
    bits = 1 << 15
    while bits < min(most_bits, 16 * wanted.count()):
        bits *= 2
    place = F.pmod(F.col(key), F.lit(bits)).cast("int")
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(32767)
    maps = wanted.select(bucket.alias("_bucket"), bit.cast("long").alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.shiftright(F.col("_bit"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, F.col("_bit").bitwiseAND(7)).bitwiseAND(1) == 1, F.lit(False))
    at = df.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(maps), "_bucket", "left")
    return at.select(*df.columns, hit.alias("_maybe"))


def bit_filter(df: DataFrame, key: str, wanted: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """df without most rows whose key (a long, a hash, not null) is not in wanted; none that is in it is lost."""
    return _marked(df, key, wanted, most_bits).where("_maybe").drop("_maybe")


def bit_split(df: DataFrame, key: str, wanted: DataFrame, most_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be in wanted, and those whose key is not. The latter need no join, so no shuffle."""
    marked = _marked(df, key, wanted, most_bits)
    return marked.where("_maybe").drop("_maybe"), marked.where("not _maybe").drop("_maybe")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links of longs -> (node, component): the smallest node that can be reached.

    Labels go along links and then jump to the label of their label, so a chain of n takes about log n rounds. Each
    round is written to the shared folder; only a count of changes comes to the driver. A hub with many links is a
    skewed side of a plain equi-join, which adaptive execution splits, and minima are combined before they move.
    """
    spark = edges.sparkSession
    links_path = new_path(spark, f"{name}-links")
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), name, links_path)
    now_path = new_path(spark, f"{name}-labels")
    now = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), name, now_path)
    while True:
        told = both.join(now, both.a == now.node).select(F.col("b").alias("node"), "component").union(now)
        least = told.groupBy("node").agg(F.min("component").alias("component"))
        up = now.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = least.join(up, "component", "left").select("node", F.least("component", "above").alias("component"))
        next_path = new_path(spark, f"{name}-labels")
        then = cut(jumped, name, next_path)
        changed = then.join(now.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        if now_path:
            drop(spark, now_path)
        now, now_path = then, next_path
        if not changed:
            drop(spark, links_path)
            return now
