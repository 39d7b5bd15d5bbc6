"""Every operator as a registered query over the driver's tables, with the same query in SQL for DuckDB.

The tables hold no order book; ``from_lineitem`` makes one, and SNAPSHOTS says the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickfold.functions.book import ALPHAS, BOOK, SNAPSHOT, compact_time, compact_time_30, depth_sums, in_session, levels_array, metric, pack_key, to_hhmmss, to_seconds, unpack_day, unpack_seconds, vector_text
from tickfold.functions.floats import shortest_float
from tickfold.operators import factors as fac
from tickfold.operators import statistics as stats
from tickfold.operators import validation as val
from tickfold.plans import job
from tickfold.sources import day_csv
from tickfold.sources import snapshots as src
from tickfold.sources.day_csv import keep_first
from tickfold.sources.scratch import cut, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def rounded(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- SQL: the snapshots, the rows with sums and the row before, the factors, their means

_BOOK_SQL = ",\n".join(
    f"CAST(px-{i}-(h%{i + 1}) AS DOUBLE) AS bp{i}, CAST((h*{i}+seq*{7 * i})%97*100+100 AS DOUBLE) AS bv{i}, CAST(px+{i}+(h%{i + 2}) AS DOUBLE) AS ap{i}, CAST((h*{i + 3}+seq*{5 * i})%89*100+100 AS DOUBLE) AS av{i}" for i in range(1, 6)
)
SNAPSHOTS = f"""base AS (
  SELECT l_suppkey AS stock, l_orderkey*7 + l_partkey*3 + l_linenumber AS h, 1000 + (l_partkey % 500)*10 AS px,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
           l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS seq
  FROM lineitem),
snapshots AS (
  SELECT stock, h, concat('010', CAST(1 + seq % 5 AS VARCHAR)) AS day, CAST(floor(seq/5e0) AS INT) AS pos,
         34020 + 180*CAST(floor(seq/5e0) AS INT) AS sec, CAST((h%997)*100 AS DOUBLE) AS tb, CAST((h%991)*100 AS DOUBLE) AS ta,
         {_BOOK_SQL}
  FROM base)"""
_SUM = lambda side, times="": "+".join(f"{side}{i}{times.format(i=i)}" for i in range(1, 6))
_WEIGHED = lambda side: f"{side}1+{side}2*5e-1+{side}3*33333333e-8+{side}4*25e-2+{side}5*2e-1"
DEPTH_SQL = f"{_SUM('bv')} AS sb, {_SUM('av')} AS sa, {_SUM('bp', '*bv{i}')} AS pb, {_SUM('ap', '*av{i}')} AS pa, {_WEIGHED('bv')} AS wb, {_WEIGHED('av')} AS wa"
EMIT = "(sec BETWEEN 34200 AND 41400 OR sec BETWEEN 46800 AND 54000)"
_PREV = "LAG({c}) OVER (PARTITION BY day, stock ORDER BY pos)"
ALPHA_SQL = {
    "alpha_1": "ap1-bp1",
    "alpha_2": "(ap1-bp1)/(5e-1*(ap1+bp1)+1e-7)",
    "alpha_3": "5e-1*(ap1+bp1)",
    "alpha_4": "(bv1-av1)/(bv1+av1+1e-7)",
    "alpha_5": "(sb-sa)/(sb+sa+1e-7)",
    "alpha_6": "sb",
    "alpha_7": "sa",
    "alpha_8": "sb-sa",
    "alpha_9": "sb/(sa+1e-7)",
    "alpha_10": "(tb-ta)/(tb+ta+1e-7)",
    "alpha_11": "pb/(sb+1e-7)",
    "alpha_12": "pa/(sa+1e-7)",
    "alpha_13": "(pb+pa)/(sb+sa+1e-7)",
    "alpha_14": "pa/(sa+1e-7)-pb/(sb+1e-7)",
    "alpha_15": "(sb-sa)/5e0",
    "alpha_16": "(wb-wa)/(wb+wa+1e-7)",
    "alpha_17": "CASE WHEN p_sec<=sec THEN ap1-p_ap1 ELSE 0e0 END",
    "alpha_18": "CASE WHEN p_sec<=sec THEN 5e-1*((ap1+bp1)-(p_ap1+p_bp1)) ELSE 0e0 END",
    "alpha_19": "CASE WHEN p_sec<=sec THEN sb/(sa+1e-7)-p_sb/(p_sa+1e-7) ELSE 0e0 END",
    "alpha_20": "(ap1-bp1)/(sb+sa+1e-7)",
}


def with_factors(source: str = "snapshots") -> str:
    """CTEs up to fac: the factors of each row in session, of the named relation."""
    lags = ", ".join(f"{_PREV.format(c=c)} AS p_{c}" for c in ("sec", "ap1", "bp1", "sb", "sa"))
    return f"""depth AS (SELECT *, {DEPTH_SQL} FROM {source}), seqs AS (SELECT *, {lags} FROM depth),
fac AS (SELECT day, stock, pos, sec, {', '.join(f'{v} AS {k}' for k, v in ALPHA_SQL.items())} FROM seqs WHERE {EMIT})"""


def means_sql(alphas: tuple[str, ...] = ALPHAS, source: str = "snapshots", extra: str = "") -> str:
    return f"WITH {SNAPSHOTS}{extra}, {with_factors(source)} SELECT day, sec, {', '.join(f'round(avg({a}), 6) AS {a}' for a in alphas)} FROM fac GROUP BY day, sec"


_HMS = "concat(lpad(CAST(CAST(floor(sec/36e2) AS INT) AS VARCHAR), 2, '0'), lpad(CAST(CAST(floor(sec%3600/6e1) AS INT) AS VARCHAR), 2, '0'), lpad(CAST(sec%60 AS VARCHAR), 2, '0'))"


# ---- sources

@query("scan_snapshots", f"WITH {SNAPSHOTS} SELECT {', '.join(SNAPSHOT)} FROM snapshots")
def scan_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).select(*SNAPSHOT)


def _line() -> tuple[Column, Column]:
    """The line of a snapshot, of 57 fields, some with an empty number, and what some have after it, or null: a header or a blank line."""
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    volume = F.when(F.col("h") % 13 == 0, "").otherwise(whole("av1"))
    book = [volume if c == "av1" else whole(c) for c in BOOK]
    line = F.concat_ws(",", F.concat(F.lit("2024"), F.col("day")), to_hhmmss(F.col("sec")), *[F.lit("x")] * 10, whole("tb"), whole("ta"), *[F.lit("7")] * 3, *book, *[F.lit("1")] * 20)
    return line, F.when(F.col("h") % 3 == 0, "tradingDay,tradeTime,recvTime").when(F.col("h") % 3 == 1, "")


def _lines() -> Column:
    """The lines of a snapshot."""
    return F.array_compact(F.array(*_line()))


def _text() -> Column:
    """The same as text, each with its end; without array functions, below which Spark would interpret the whole line."""
    line, other = _line()
    return F.concat(line, F.lit("\n"), F.when(other.isNull(), "").otherwise(F.concat(other, F.lit("\n"))))


def lines_of(rows: DataFrame) -> DataFrame:
    """day, stock (text), pos and value: snapshots as lines."""
    return rows.select("day", F.col("stock").cast("string").alias("stock"), "pos", F.explode(_lines()).alias("value"))


_EMPTIED = "CASE WHEN h%13=0 THEN 0e0 ELSE av1 END AS av1"


@query("parse_lines", f"WITH {SNAPSHOTS} SELECT day, CAST(stock AS VARCHAR) AS stock, pos, sec, {', '.join(('tb', 'ta', *(c for c in BOOK if c != 'av1')))}, {_EMPTIED} FROM snapshots")
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(snapshots(spark, sf_dir)).select("stock", "pos", "value")
    return src.parse_lines(rows).where(~F.col("bad")).select(*SNAPSHOT)


# ---- the file job: a tree of snapshot files, what is read of it, and what is written

_FILES: dict[tuple[str, str], str] = {}


def file_tree(spark: SparkSession, sf_dir: str) -> str:
    """The root of a tree <MMDD>/<stock>/snapshot.csv in the shared folder, made once a session, with a day without rows."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILES:
        root = new_path(spark, "tree")
        # the exchange by stock also serves the order within files, so lines are never shuffled
        rows = snapshots(spark, sf_dir).withColumn("line", F.row_number().over(Window.partitionBy("stock", "day").orderBy("pos")))
        src.write_files(rows.select("day", F.col("stock").cast("string").alias("stock"), "line", _text().alias("text")), f"{root}/tree")
        fs, empty = src._fs(spark, f"{root}/tree/0109")
        fs.mkdirs(empty)
        _FILES[key] = f"{root}/tree"
    return _FILES[key]


def file_run(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a run of the file job over the tree."""
    out = f"{new_path(spark, 'run')}/run_1"
    job.factor_job(spark, file_tree(spark, sf_dir), out)
    return out


_TREE = f"{SNAPSHOTS}, files AS (SELECT * REPLACE (CASE WHEN h%13=0 THEN 0e0 ELSE av1 END AS av1) FROM snapshots)"
_FILE_MEANS = f"WITH {_TREE}, {with_factors('files')}, m AS (SELECT day, sec, {', '.join(f'avg({a}) AS {a}' for a in ALPHAS)} FROM fac GROUP BY day, sec)"


@query("file_scan", f"WITH {_TREE} SELECT CAST(stock AS VARCHAR) AS stock, concat('2024', day) AS trading_day, row_number() OVER (PARTITION BY day, stock ORDER BY pos) AS line, day, sec, {', '.join(('tb', 'ta', *BOOK))} FROM files")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the tree, each line in its file's order."""
    rows = src.read_snapshots(spark, file_tree(spark, sf_dir))
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("stock", "day").orderBy("start", "pos")))
    return rows.select("stock", "trading_day", "line", "day", "sec", "tb", "ta", *BOOK)


@query("file_days", f"WITH {SNAPSHOTS} SELECT DISTINCT day FROM snapshots UNION ALL SELECT '0109'")
def file_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by their folders; one has no file."""
    return spark.createDataFrame([(d,) for d in src.discover_days(spark, file_tree(spark, sf_dir))], "day string")


@query("file_job", f"{_FILE_MEANS} SELECT day, {_HMS} AS \"tradeTime\", {', '.join(f'CAST(CAST({a} AS FLOAT) AS DOUBLE) AS {a}' for a in ALPHAS)} FROM m")
def file_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in, one CSV a day out, read back: means as 32-bit numbers."""
    rows = day_csv.read_days(spark, file_run(spark, sf_dir))
    return rows.select("day", "tradeTime", *[F.col(a).cast("float").cast("double").alias(a) for a in ALPHAS])


@query("file_output", f"{_FILE_MEANS}, f AS (SELECT day, count(*) AS n, min({_HMS}) AS first, max({_HMS}) AS last FROM m GROUP BY day UNION ALL SELECT '0109', 0, NULL, NULL) SELECT concat(day, '.csv') AS file, 'tradeTime,{','.join(ALPHAS)}' AS header, n, first, last FROM f")
def file_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files themselves: names, header lines, numbers of rows and the first and last time in the order of lines."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    lines = spark.read.text(file_run(spark, sf_dir)).select(name.alias("file"), F.struct(F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("p")).alias("at"), "value", F.col("value").rlike("^[0-9]").alias("data"))
    time = F.when(F.col("data"), F.substring("value", 1, 6))
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.count_if("data").alias("n"), F.min_by(time, F.when(F.col("data"), F.col("at"))).alias("first"), F.max_by(time, F.when(F.col("data"), F.col("at"))).alias("last"))


@query("day_from_path", f"WITH {SNAPSHOTS} SELECT day AS path_day, CAST(stock AS VARCHAR) AS path_stock, count(*) AS n FROM snapshots GROUP BY 1, 2")
def day_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("file:/data"), "day", F.col("stock").cast("string"), F.lit("snapshot.csv"))
    parts = snapshots(spark, sf_dir).select(src.path_part(path, 3).alias("path_day"), src.path_part(path, 2).alias("path_stock"))
    return parts.groupBy("path_day", "path_stock").agg(F.count("*").alias("n"))


@query("newest_run", "SELECT arg_max(dir, k) AS dir FROM (SELECT dir, concat(max(mtime), dir) AS k FROM (SELECT concat('run_', CAST(l_suppkey AS VARCHAR)) AS dir, CAST(l_shipdate AS VARCHAR) AS mtime FROM lineitem) GROUP BY dir)")
def newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("run_"), F.col("l_suppkey").cast("string")).alias("dir"), F.col("l_shipdate").alias("mtime"))
    return src.newest(rows)


@query("days_listed", f"WITH {SNAPSHOTS} SELECT DISTINCT day FROM snapshots")
def days_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("pos") % 3 == 0, ".csv").when(F.col("pos") % 3 == 1, ".csv-r-00001").otherwise(".txt")
    return src.day_files(snapshots(spark, sf_dir).select(F.concat("day", ending).alias("name")))


@query("elapsed_extract", "SELECT l_linenumber, count(*) AS n, count(e) AS n_valid, round(sum(e), 4) AS total FROM (SELECT l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS e FROM lineitem) GROUP BY 1")
def elapsed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", F.concat(F.lit("@ Driver: ElapsedSec: "), F.when(F.col("l_orderkey") % 11 == 0, "NA").otherwise(F.format_string("%.4f", "l_quantity"))).alias("value"))
    return lines.select("l_linenumber", src.elapsed(lines).alias("e")).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("e").alias("n_valid"), F.round(F.sum("e"), 4).alias("total"))


# ---- projections and filters

@query("session_filter", f"WITH {SNAPSHOTS} SELECT day, count(*) AS n_rows, count(*) FILTER (WHERE {EMIT}) AS n_emit, count(*) FILTER (WHERE sec IN (34200, 41400, 46800, 54000)) AS n_ends FROM snapshots GROUP BY day")
def session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n_rows"), F.count_if(in_session()).alias("n_emit"), F.count_if(in_session() & F.col("sec").isin(34200, 41400, 46800, 54000)).alias("n_ends"))


@query("time_codec", f"WITH {SNAPSHOTS} SELECT DISTINCT sec, {_HMS} AS trade_time, sec AS back FROM snapshots")
def time_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).select("sec").distinct().withColumn("trade_time", to_hhmmss(F.col("sec"))).withColumn("back", to_seconds(F.col("trade_time")))


@query("key_pack", f"WITH {SNAPSHOTS} SELECT DISTINCT day, sec, CAST(CAST(day AS INT)*32768 + sec - 21600 AS INT) AS packed FROM snapshots WHERE {EMIT}")
def key_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).where(in_session()).select("day", "sec").distinct().withColumn("packed", pack_key(F.col("day"), F.col("sec")))


@query("key_unpack", f"WITH {SNAPSHOTS} SELECT DISTINCT day, sec FROM snapshots WHERE {EMIT}")
def key_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = snapshots(spark, sf_dir).where(in_session()).select(pack_key(F.col("day"), F.col("sec")).alias("k")).distinct()
    return packed.select(unpack_day(F.col("k")).alias("day"), unpack_seconds(F.col("k")).alias("sec"))


@query("key_pack_date", f"WITH {SNAPSHOTS} SELECT DISTINCT day, sec, ((34*16 + CAST(substr(day, 1, 2) AS BIGINT))*32 + CAST(substr(day, 3, 2) AS BIGINT))*131072 + sec AS compact, CAST(((34*16 + CAST(substr(day, 1, 2) AS BIGINT))*32 + CAST(substr(day, 3, 2) AS BIGINT))*32768 + sec - 21600 AS INT) AS compact_30 FROM snapshots WHERE {EMIT}")
def key_pack_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with the year, as older forms of the job had them; the days are those of 2024."""
    date = F.concat(F.lit("2024"), F.col("day"))
    return snapshots(spark, sf_dir).where(in_session()).select("day", "sec").distinct().select("day", "sec", compact_time(date, F.col("sec")).alias("compact"), compact_time_30(date, F.col("sec")).alias("compact_30"))


def _depth(name: str, columns: tuple[str, str]) -> None:
    @query(name, f"WITH {SNAPSHOTS}, depth AS (SELECT *, {DEPTH_SQL} FROM snapshots) SELECT day, sec, {', '.join(f'round(avg({c}), 3) AS {c}' for c in columns)} FROM depth GROUP BY day, sec")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = depth_sums()
        return snapshots(spark, sf_dir).select("day", "sec", *[own[c].alias(c) for c in columns]).groupBy("day", "sec").agg(*[F.round(F.avg(c), 3).alias(c) for c in columns])


for _name, _columns in (("book_depth", ("sb", "sa")), ("book_vwap", ("pb", "pa")), ("book_weighted", ("wb", "wa"))):
    _depth(_name, _columns)


@query("book_levels", f"WITH {SNAPSHOTS}, depth AS (SELECT *, {DEPTH_SQL} FROM snapshots) SELECT day, round(sum(sb), 2) AS sb, round(sum(sa), 2) AS sa, round(sum(pb), 2) AS pb FROM depth GROUP BY day")
def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums from the array form of the book."""
    fold = lambda f: F.aggregate("book", F.lit(0.0), lambda a, x: a + f(x))
    rows = snapshots(spark, sf_dir).select("day", levels_array().alias("book")).select("day", fold(lambda x: x["bv"]).alias("sb"), fold(lambda x: x["av"]).alias("sa"), fold(lambda x: x["bp"] * x["bv"]).alias("pb"))
    return rows.groupBy("day").agg(*[F.round(F.sum(c), 2).alias(c) for c in ("sb", "sa", "pb")])


# ---- factors, one query each

def _alpha(name: str) -> None:
    @query(f"alpha_{int(name[6:]):02d}", means_sql((name,)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fac.factor_means(snapshots(spark, sf_dir), (name,)), (name,))


for _name in ALPHAS:
    _alpha(_name)


# ---- the row before

@query("lag_prev", f"WITH {SNAPSHOTS}, {with_factors()} SELECT day, stock, pos, p_sec AS prev_sec, p_ap1 AS prev_ap1, p_bp1 AS prev_bp1, p_sb AS prev_sb, p_sa AS prev_sa FROM seqs")
def lag_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fac.with_previous(fac.with_depth(snapshots(spark, sf_dir)))
    return rows.select("day", "stock", "pos", *[F.col(f"prev.{c}").alias(f"prev_{c}") for c in ("sec", "ap1", "bp1", "sb", "sa")])


_CHANGES = ("alpha_17", "alpha_18", "alpha_19")
_CHANGED = ", ".join(f"round({a}, 6) AS {a}" for a in _CHANGES)
_BACK = ", back AS (SELECT * REPLACE (34020 + 180*CASE pos WHEN 60 THEN 61 WHEN 61 THEN 60 ELSE pos END AS sec) FROM snapshots)"


@query("lag_reset_backwards", f"WITH {SNAPSHOTS}{_BACK}, {with_factors('back')} SELECT day, stock, pos, sec, {_CHANGED} FROM fac")
def lag_reset_backwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two rows are swapped in time, the second of them has no row before."""
    swapped = F.when(F.col("pos") == 60, 61).when(F.col("pos") == 61, 60).otherwise(F.col("pos"))
    rows = snapshots(spark, sf_dir).withColumn("sec", (F.lit(34020) + F.lit(180) * swapped).cast("int"))
    return rounded(fac.snapshot_factors(rows, ("stock", "pos"), _CHANGES), _CHANGES).select("day", "stock", "pos", "sec", *_CHANGES)


def _carry(name: str, sec: int) -> None:
    @query(name, f"WITH {SNAPSHOTS}, {with_factors()} SELECT day, stock, sec, {_CHANGED} FROM fac WHERE sec = {sec}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fac.snapshot_factors(snapshots(spark, sf_dir), ("stock",), _CHANGES).where(F.col("sec") == sec), _CHANGES).select("day", "stock", "sec", *_CHANGES)


_carry("lag_prewindow_carry", 34200)
_carry("lag_lunch_carry", 46800)


# ---- the cross-section

@query("cross_mean_all", means_sql())
def cross_mean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fac.factor_means(snapshots(spark, sf_dir)), ALPHAS)


@query("cross_partial_final", means_sql())
def cross_partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by part of the stocks, then merged."""
    rows = fac.snapshot_factors(snapshots(spark, sf_dir), ("stock",)).withColumn("part", F.col("stock") % 4)
    return rounded(fac.merge_sums(fac.partial_sums(rows, ("part",))), ALPHAS)


@query("cross_partial", f"WITH {SNAPSHOTS}, {with_factors()} SELECT day, sec, {', '.join(f'round(sum({a}), 4) AS sum_{a[6:]}' for a in ALPHAS)}, count(*) AS cnt FROM fac GROUP BY day, sec")
def cross_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fac.partial_sums(fac.snapshot_factors(snapshots(spark, sf_dir)))
    return out.select(*[F.round(c, 4).alias(c) if c.startswith("sum") else F.col(c) for c in out.columns])


@query("cross_count", f"WITH {SNAPSHOTS} SELECT day, sec, count(*) AS n, count(DISTINCT stock) AS n_stocks FROM snapshots WHERE {EMIT} GROUP BY day, sec")
def cross_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).where(in_session()).groupBy("day", "sec").agg(F.count("*").alias("n"), F.countDistinct("stock").alias("n_stocks"))


@query("cross_fixed_300", f"WITH {SNAPSHOTS}, {with_factors()} SELECT day, sec, {', '.join(f'round(sum({a})/3e2, 5) AS {a}' for a in ALPHAS)} FROM fac GROUP BY day, sec")
def cross_fixed_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fac.fixed_mean(fac.snapshot_factors(snapshots(spark, sf_dir)))
    return out.select("day", "sec", *[F.round(a, 5).alias(a) for a in ALPHAS])


@query("dense_grid", f"WITH {SNAPSHOTS}, {with_factors()}, m AS (SELECT day, sec, round(avg(alpha_3), 6) AS alpha_3 FROM fac GROUP BY day, sec), t AS (SELECT unnest(generate_series(34200, 41400, 3)) AS sec UNION ALL SELECT unnest(generate_series(46800, 54000, 3))) SELECT d.day, CAST(t.sec AS INT) AS sec, alpha_3 FROM (SELECT DISTINCT day FROM m) d CROSS JOIN t LEFT JOIN m ON m.day = d.day AND m.sec = t.sec")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fac.dense_grid(fac.factor_means(snapshots(spark, sf_dir), ("alpha_3",))), ("alpha_3",))


@query("dup_rows_averaged", f"WITH {SNAPSHOTS}, {with_factors()}, f2 AS (SELECT * FROM fac UNION ALL SELECT * FROM fac WHERE stock % 3 = 0) SELECT day, sec, {', '.join(f'round(avg({a}), 6) AS {a}' for a in ALPHAS)}, count(*) AS n FROM f2 GROUP BY day, sec")
def dup_rows_averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one stock and time count as often as they come."""
    copies = F.when(F.col("stock") % 3 == 0, 2).otherwise(1)
    both = fac.snapshot_factors(snapshots(spark, sf_dir), ("stock",)).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return rounded(both.groupBy("day", "sec").agg(*[(F.sum(a) / F.count(F.lit(1))).alias(a) for a in ALPHAS], F.count("*").alias("n")), ALPHAS)


@query("gappy_mean", means_sql(source="gappy", extra=", gappy AS (SELECT * FROM snapshots WHERE h % 7 <> 0)"))
def gappy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing snapshots: means over those there are."""
    return rounded(fac.factor_means(snapshots(spark, sf_dir).where(F.col("h") % 7 != 0)), ALPHAS)


_ZERO = f", zero AS (SELECT * REPLACE ({', '.join(f'0e0 AS {c}' for c in BOOK if c[1] == 'v')}, 0e0 AS tb, 0e0 AS ta) FROM snapshots)"


@query("eps_zero_depth", f"WITH {SNAPSHOTS}{_ZERO}, {with_factors('zero')} SELECT day, stock, sec, {', '.join(f'round({a}, 6) AS {a}' for a in ALPHAS)} FROM fac")
def eps_zero_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book without volume gives numbers, not errors; row by row, as sums of such large numbers depend on their order."""
    empty = snapshots(spark, sf_dir).withColumns({c: F.lit(0.0) for c in (*[c for c in BOOK if c[1] == "v"], "tb", "ta")})
    return rounded(fac.snapshot_factors(empty, ("stock",)), ALPHAS)


@query("day_local_mean", means_sql())
def day_local_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan that deals whole days."""
    return rounded(fac.day_local_means(snapshots(spark, sf_dir)), ALPHAS)


@query("vector_text", f"WITH {SNAPSHOTS} SELECT day, stock, pos, concat('Factors: [', concat_ws(', ', CAST(CAST(tb AS BIGINT) AS VARCHAR), CAST(CAST(ap1 AS BIGINT) AS VARCHAR), CAST(CAST(bv1 AS BIGINT) AS VARCHAR)), ']') AS shown FROM snapshots")
def vector_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).withColumns({c: F.col(c).cast("bigint") for c in ("tb", "ap1", "bv1")})
    return rows.select("day", "stock", "pos", vector_text(("tb", "ap1", "bv1")).alias("shown"))


# ---- results

@query("day_partitioned_sorted", f"WITH {SNAPSHOTS}, {with_factors()}, m AS (SELECT day, sec, round(avg(alpha_1), 6) AS alpha_1 FROM fac GROUP BY day, sec) SELECT day, row_number() OVER (PARTITION BY day ORDER BY sec) AS line, {_HMS} AS trade_time, alpha_1 FROM m")
def day_partitioned_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each day's file in their order."""
    m = rounded(fac.factor_means(snapshots(spark, sf_dir), ("alpha_1",)), ("alpha_1",))
    return m.withColumn("line", F.row_number().over(Window.partitionBy("day").orderBy("sec"))).select("day", "line", to_hhmmss(F.col("sec")).alias("trade_time"), "alpha_1")


@query("float_format", f"WITH {SNAPSHOTS} SELECT DISTINCT px_text FROM (SELECT regexp_replace(CAST(CAST(5e-1*(ap1+bp1) + (h%1000)/16e0 AS FLOAT) AS VARCHAR), '\\.0$', '') AS px_text FROM snapshots)")
def float_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.lit(0.5) * (F.col("ap1") + F.col("bp1")) + F.col("h") % 1000 / F.lit(16.0)
    return snapshots(spark, sf_dir).select(shortest_float(value.cast("float")).alias("px_text")).distinct()


@query("metric_format", f"WITH {SNAPSHOTS} SELECT DISTINCT CASE WHEN h % 9 = 0 THEN '0' ELSE printf('%.2e', tb/4096e0 + 1e-3) END AS shown FROM snapshots")
def metric_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).select(metric(F.when(F.col("h") % 9 == 0, 0.0).otherwise(F.col("tb") / 4096.0 + F.lit(1e-3))).alias("shown")).distinct()


# ---- validation: golden means against means with known faults

_PAIR = f"""WITH {SNAPSHOTS}, {with_factors()}, gold AS (SELECT day, {_HMS} AS t, {', '.join(f'avg({a}) AS {a}' for a in ALPHAS)} FROM fac GROUP BY day, sec),
pred AS (SELECT * REPLACE (alpha_1*1005e-3 AS alpha_1, alpha_2*102e-2 AS alpha_2) FROM gold WHERE NOT (day = '0103' AND t = '100000') AND day <> '0105'),
win_g AS (SELECT * FROM gold WHERE day <> '0105' AND t BETWEEN '093000' AND '145700'), win_p AS (SELECT * FROM pred WHERE t BETWEEN '093000' AND '145700'),
errs AS (SELECT coalesce(g.day, p.day) AS day, coalesce(g.t, p.t) AS tradeTime, {', '.join(f"coalesce(abs(g.{a}-p.{a})/abs(g.{a}+1e-7), CAST('NaN' AS DOUBLE)) AS {a}" for a in ALPHAS)} FROM win_g g FULL OUTER JOIN win_p p ON g.day = p.day AND g.t = p.t)"""


GOLD_DAYS = ["0101", "0102", "0103", "0104"]


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Golden means, written once, and others made from them."""
    gold = cut(fac.factor_means(snapshots(spark, sf_dir)).select("day", to_hhmmss(F.col("sec")).alias("tradeTime"), *ALPHAS), "gold")
    pred = gold.where(~((F.col("day") == "0103") & (F.col("tradeTime") == "100000")) & (F.col("day") != "0105"))
    return gold.where("day <> '0105'"), pred.withColumns({"alpha_1": F.col("alpha_1") * 1.005, "alpha_2": F.col("alpha_2") * 1.02})


@query("validate_outer_align", f"{_PAIR} SELECT day, tradeTime, {', '.join(f'round({a}, 6) AS {a}' for a in ALPHAS)} FROM errs")
def validate_outer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(val.aligned(*_pair(spark, sf_dir), days=GOLD_DAYS), ALPHAS)


@query("validate_err_by_day", f"{_PAIR} SELECT day, {', '.join(f'round(avg({a}), 6) AS {a}' for a in ALPHAS)} FROM errs GROUP BY day")
def validate_err_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(val.errors_by_day(val.aligned(*_pair(spark, sf_dir), days=GOLD_DAYS)), ALPHAS)


_VERDICTS = " UNION ALL ".join(f"SELECT '{a}' AS factor, round(avg({a}), 6) AS err, (NOT isnan(avg({a})) AND avg({a}) < 1e-2) AS ok FROM by_day" for a in ALPHAS)


@query("validate_verdict", f"{_PAIR}, by_day AS (SELECT day, {', '.join(f'avg({a}) AS {a}' for a in ALPHAS)} FROM errs WHERE day <> '0103' GROUP BY day) {_VERDICTS}")
def validate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the day that lacks a time: alpha_2 is 2 % off and fails, alpha_1 at 0.5 % passes."""
    gold, pred = (x.where("day <> '0103'") for x in _pair(spark, sf_dir))
    return val.verdict(val.errors_by_day(val.aligned(gold, pred, days=GOLD_DAYS))).select("factor", F.round("err", 6).alias("err"), "ok")


_DAYS = f"WITH {SNAPSHOTS}, gold AS (SELECT DISTINCT day FROM snapshots), pred AS (SELECT DISTINCT CASE day WHEN '0102' THEN '0109' ELSE day END AS day FROM snapshots)"


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = snapshots(spark, sf_dir).select("day")
    return gold, gold.select(F.when(F.col("day") == "0102", "0109").otherwise(F.col("day")).alias("day"))


@query("days_missing", f"{_DAYS} SELECT day FROM gold EXCEPT SELECT day FROM pred")
def days_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.missing_days(*_days(spark, sf_dir))


@query("days_extra", f"{_DAYS} SELECT day FROM pred EXCEPT SELECT day FROM gold")
def days_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.extra_days(*_days(spark, sf_dir))


@query("shard_union_dedup", f"WITH {SNAPSHOTS}, {with_factors()}, m AS (SELECT day, sec, round(avg(alpha_3), 6) AS alpha_3 FROM fac GROUP BY day, sec), u AS (SELECT 0 AS shard, * FROM m WHERE sec < 45000 UNION ALL SELECT 1, day, sec, -alpha_3 FROM m WHERE sec > 40000) SELECT day, sec, alpha_3, shard FROM (SELECT *, row_number() OVER (PARTITION BY day, sec ORDER BY shard) AS n FROM u) WHERE n = 1")
def shard_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards of a day that share some times; the first shard's rows are kept."""
    m = rounded(fac.factor_means(snapshots(spark, sf_dir), ("alpha_3",)), ("alpha_3",))
    one, two = m.where("sec < 45000").withColumn("shard", F.lit(0)), m.where("sec > 40000").withColumns({"alpha_3": -F.col("alpha_3"), "shard": F.lit(1)})
    return keep_first(one.unionByName(two), ["day", "sec"], ["shard"])


# ---- run times, as a rule makes them from lineitem

_RUNS = "WITH runs AS (SELECT CASE WHEN (l_orderkey*7+l_partkey*3+l_linenumber) % 101 = 0 THEN NULL ELSE 55e-1 + ((l_orderkey*7+l_partkey*3+l_linenumber) % 251)/1e2 END AS elapsed FROM lineitem)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.when(h % 101 != 0, F.lit(5.5) + h % 251 / F.lit(100.0)).alias("elapsed"))


_SUMMARY = "count(*) AS runs, count(elapsed) AS n, round(avg(elapsed), 6) AS mean, round(median(elapsed), 6) AS median, round(coalesce(stddev_samp(elapsed), 0), 6) AS sd, round(coalesce(stddev_samp(elapsed), 0)/sqrt(count(elapsed)), 6) AS se, min(elapsed) AS min, max(elapsed) AS max"
_ROUNDED = ("mean", "median", "sd", "se")


@query("runtime_stats", f"{_RUNS} SELECT {_SUMMARY} FROM runs")
def runtime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summary(runs(spark, sf_dir)), _ROUNDED)


@query("runtime_groups", f"{_RUNS} SELECT CASE WHEN elapsed >= 725e-2 THEN 2 WHEN elapsed >= 625e-2 THEN 1 ELSE 0 END AS grp, {_SUMMARY} FROM runs WHERE elapsed IS NOT NULL GROUP BY 1")
def runtime_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summary(stats.valid(runs(spark, sf_dir)).withColumn("grp", stats.group(F.col("elapsed"))), ("grp",)), _ROUNDED)


@query("runtime_hist", f"{_RUNS}, e AS (SELECT min(elapsed) AS lo, (max(elapsed)-min(elapsed))/150 AS w, count(elapsed) AS n FROM runs) SELECT CAST(least(floor((elapsed-lo)/w), 149) AS INT) AS bin, count(*) AS n, round(count(*)/(any_value(e.n)*any_value(w)), 6) AS density FROM runs, e WHERE elapsed IS NOT NULL GROUP BY 1")
def runtime_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram(runs(spark, sf_dir)), ("density",))


@query("runtime_quartiles", f"{_RUNS}, q AS (SELECT quantile_cont(elapsed, 25e-2) AS q1, median(elapsed) AS median, quantile_cont(elapsed, 75e-2) AS q3 FROM runs WHERE elapsed IS NOT NULL), r AS (SELECT elapsed, q.*, elapsed BETWEEN q1-15e-1*(q3-q1) AND q3+15e-1*(q3-q1) AS near FROM runs, q WHERE elapsed IS NOT NULL) SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(elapsed) FILTER (WHERE near) AS low, max(elapsed) FILTER (WHERE near) AS high, count(*) FILTER (WHERE NOT near) AS fliers FROM r GROUP BY 1, 2, 3")
def runtime_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.box(runs(spark, sf_dir)), ("q1", "median", "q3"))


@query("runtime_gmm")
def runtime_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectation maximisation; SQL cannot say it."""
    return rounded(stats.mixture(runs(spark, sf_dir)), ("weight", "mean", "variance"))


@query("runtime_gmm_density")
def runtime_gmm_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's density on an even grid over the run times; SQL cannot say it."""
    rows = runs(spark, sf_dir)
    low, high = rows.agg(F.min("elapsed"), F.max("elapsed")).first()
    return rounded(stats.densities(stats.mixture(rows), low, high), ("x", "density"))
