"""Rules of the engine on small hand-made files and rows."""

import datetime
import math
import os
import random
import re
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickfold.functions import book
from tickfold.functions.floats import shortest
from tickfold.operators import factors as fac
from tickfold.operators import statistics as stats
from tickfold.operators import validation as val
from tickfold.plans import job
from tickfold.sources import day_csv
from tickfold.sources import snapshots as src

HEAD = ",".join(["tradingDay", "tradeTime"] + [f"c{i}" for i in range(2, 57)])


def line(time, ap1=102, bp1=100, volume=10, day="20240102", **at):
    f = [day, time] + ["x"] * 10 + ["300", "100"] + ["1"] * 3
    for level in range(10):
        f += [str(bp1 - level), str(volume), str(ap1 + level), str(volume)]
    for k, v in at.items():
        f[int(k[1:])] = v
    return ",".join(f)


def book_time(sec):
    return f"{sec // 3600:02d}{sec // 60 % 60:02d}{sec % 60:02d}"


def tree(root, files):
    for name, lines in files.items():
        p = root / name / "snapshot.csv"
        p.parent.mkdir(parents=True)
        p.write_text("".join(x + "\n" for x in lines))
    return str(root)


def factors_of(spark, root):
    rows = fac.snapshot_factors(src.read_snapshots(spark, root), ("stock", "pos"))
    out = {}
    for r in rows.orderBy("day", "stock", "pos").collect():
        out.setdefault((r.day, r.stock), []).append(r)
    return out


def test_headers_and_blank_lines_are_no_data(spark, tmp_path):
    root = tree(tmp_path, {"0102/a": [HEAD, line("093000"), HEAD, "", line("093003")], "0103/b": [HEAD]})
    rows = factors_of(spark, root)
    assert [r.sec for r in rows["0102", "a"]] == [34200, 34203] and ("0103", "b") not in rows


def test_sessions_include_both_ends(spark, tmp_path):
    times = ["092957", "093000", "113000", "113003", "125957", "130000", "150000", "150003"]
    rows = factors_of(spark, tree(tmp_path, {"0102/a": [line(t) for t in times]}))
    assert [r.sec for r in rows["0102", "a"]] == [34200, 41400, 46800, 54000]


def test_state_is_carried_from_outside_the_session(spark, tmp_path):
    lines = [line("092957", ap1=101), line("093000", ap1=103), line("113003", ap1=110), line("130000", ap1=111)]
    a = factors_of(spark, tree(tmp_path, {"0102/a": lines}))["0102", "a"]
    assert [r.alpha_17 for r in a] == [2.0, 1.0]


def test_time_that_goes_back_resets_one_row_and_equal_times_do_not(spark, tmp_path):
    lines = [line("093000", ap1=101), line("093003", ap1=103), line("093003", ap1=106), line("093000", ap1=110), line("093006", ap1=111)]
    a = factors_of(spark, tree(tmp_path, {"0102/a": lines}))["0102", "a"]
    assert [r.alpha_17 for r in a] == [0.0, 2.0, 3.0, 0.0, 1.0]


def test_files_do_not_leak_and_first_rows_count(spark, tmp_path):
    root = tree(tmp_path, {"0102/a": [line("093000", ap1=101)], "0102/b": [line("093000", ap1=105), line("093003", ap1=106)]})
    rows = factors_of(spark, root)
    assert rows["0102", "b"][0].alpha_17 == 0.0
    means = {r.sec: r for r in fac.factor_means(src.read_snapshots(spark, root)).collect()}
    assert means[34200].alpha_17 == 0.0 and means[34200].alpha_1 == 3.0 and means[34203].alpha_1 == 6.0


def test_empty_number_is_zero_and_zero_depth_is_no_error(spark, tmp_path):
    root = tree(tmp_path, {"0102/a": [line("093000", c20="")], "0102/b": [line("093000", volume=0)]})
    rows = factors_of(spark, root)
    assert rows["0102", "a"][0].alpha_7 == 40.0
    assert all(math.isfinite(rows["0102", "b"][0][f"alpha_{i}"]) for i in range(1, 21))


def test_lines_out_of_format_are_quarantined(spark, tmp_path):
    root = tree(tmp_path, {"0102/a": [line("093000"), line("93000"), line("093003", c18="-5"), "20240102,093006,1"]})
    assert src.read_snapshots(spark, root).count() == 1
    assert src.read_snapshots(spark, root, quarantine=True).count() == 3


def test_days_can_be_chosen_and_misplaced_rows_are_told(spark, tmp_path):
    root = tree(tmp_path, {"0102/a": [line("093000")], "0103/a": [line("093000")]})
    assert src.read_snapshots(spark, root, ["0102"]).select("day").distinct().count() == 1
    assert src.misplaced(src.read_snapshots(spark, root)).count() == 1
    assert src.read_snapshots(spark, f"{root}/*/*/snapshot.csv").count() == 2


def test_files_of_many_splits_keep_their_order(spark, tmp_path):
    """Splits of 1 KB, dealt to tasks in any order: the row before is still that of the file."""
    lines = [HEAD] + [line(book_time(34200 + 3 * i), ap1=102 + i * i % 17) for i in range(120)]
    root = tree(tmp_path, {"0102/a": lines, "0102/b": lines[:40]})
    whole = factors_of(spark, root)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(f"{root}/*/*/snapshot.csv").rdd.getNumPartitions() > 20
        parts = {}
        for r in fac.snapshot_factors(src.read_snapshots(spark, root), ("stock",)).collect():
            parts.setdefault((r.day, r.stock), []).append(r)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: len(v) for k, v in parts.items()} == {("0102", "a"): 120, ("0102", "b"): 39}
    for k, v in parts.items():
        assert [(r.sec, r.alpha_17) for r in sorted(v, key=lambda r: r.sec)] == [(r.sec, r.alpha_17) for r in whole[k]]


def test_too_many_bad_lines_publish_nothing(spark, tmp_path, caplog):
    root = tree(tmp_path / "in", {"0102/a": [line("093000"), line("93000")], "0103/a": [line("093000")]})
    with pytest.raises(ValueError, match="1 of 3 lines"):
        job.factor_job(spark, root, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and not [x for x in os.listdir(tmp_path) if x.startswith("out")]
    with caplog.at_level("INFO", "tickfold"):
        job.factor_job(spark, root, str(tmp_path / "out"), most_bad=0.5, mode="days")
    assert "3 lines, 1 out of format, 1 in the folder of another day" in caplog.text and (tmp_path / "out/0103.csv").exists()


def test_one_partition_a_day(spark):
    days = [f"{m:02d}{d:02d}" for m in range(1, 13) for d in range(1, 26)]
    rows = spark.createDataFrame([(d, i) for d in days for i in range(3)], "day string, i int")
    dealt = day_csv.by_day(rows, days)
    assert dealt.rdd.getNumPartitions() == 300
    assert {tuple(r) for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("day"), F.count("*")).select("count(DISTINCT day)", "count(1)").collect()} == {(1, 3)}


def test_whole_days_need_one_exchange(spark, tmp_path):
    root = tree(tmp_path, {"0102/a": [line("093000"), line("093003", ap1=105)], "0103/b": [line("093000", ap1=107)]})
    rows = src.read_snapshots(spark, root)
    means = fac.day_local_means(rows)
    assert means._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(means.collect()) == sorted(fac.factor_means(rows).collect())


def test_newest_run_is_the_root_or_right_in_it(spark, tmp_path):
    for name in ("run_1/0102.csv", "run_2/0102.csv", "run_2/deeper/0102.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    os.utime(tmp_path / "run_1/0102.csv", (2e9, 2e9))
    os.utime(tmp_path / "run_2/deeper/0102.csv", (3e9, 3e9))
    assert src.newest_run(spark, str(tmp_path)).endswith("/run_1") and src.newest_run(spark, str(tmp_path / "run_2/none")) is None


def test_results_with_other_columns_and_orders_are_read_together(spark, tmp_path):
    (tmp_path / "0102.csv").write_text(",".join(day_csv.HEADER) + "\n" + ",".join(["93000"] + [str(i) for i in range(1, 21)]) + "\n")
    head = ["more", *reversed(day_csv.HEADER)]
    (tmp_path / "0103.csv").write_text(",".join(head) + "\n" + ",".join(["x", *[str(i) for i in range(20, 0, -1)], "093003"]) + "\n")
    got = {(r.day, r.tradeTime): [r[a] for a in book.ALPHAS] for r in day_csv.read_days(spark, str(tmp_path)).collect()}
    assert got == {("0102", "093000"): [float(i) for i in range(1, 21)], ("0103", "093003"): [float(i) for i in range(1, 21)]}
    (tmp_path / "0104.csv").write_text("tradeTime,alpha_1\n")
    with pytest.raises(ValueError, match="0104.csv lacks alpha_2"):
        day_csv.read_days(spark, str(tmp_path))


def test_results_are_fetched_and_threads_are_told(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/0102.csv").write_text("x")
    job.fetch(spark, str(tmp_path / "out"), str(tmp_path / "copy"))
    assert (tmp_path / "copy/0102.csv").read_text() == "x"
    busy = next(job.monitor(os.getpid(), 0.1, 3))
    assert 1 <= len(busy) <= 3 and all(t in job.threads(os.getpid()) for t, _, _ in busy) and not job.threads(2**30)


def test_mixture_is_a_fixed_point_of_expectation_maximisation(spark):
    """One more step by hand leaves weights, means and variances where they are; the density grid is the textbook's."""
    dice = random.Random(4)
    x = [dice.gauss(*dice.choice([(5.8, 0.1), (6.7, 0.15), (7.6, 0.1)])) for _ in range(3000)]
    parts = stats.mixture(spark.createDataFrame([(v,) for v in x], "elapsed double")).orderBy("component").collect()
    pdf = lambda v, p: p.weight * math.exp(-((v - p["mean"]) ** 2) / (2 * p.variance)) / math.sqrt(2 * math.pi * p.variance)
    share = [[pdf(v, p) / sum(pdf(v, q) for q in parts) for p in parts] for v in x]
    for k, p in enumerate(parts):
        n = sum(s[k] for s in share)
        mean = sum(s[k] * v for s, v in zip(share, x)) / n
        assert (p.weight, p["mean"], p.variance) == pytest.approx((n / len(x), mean, sum(s[k] * (v - mean) ** 2 for s, v in zip(share, x)) / n), abs=0.02)
    rows = spark.createDataFrame(parts)
    for r in stats.densities(rows, 5.0, 8.0, 7).collect():
        assert r.density == pytest.approx(sum(pdf(r.x, p) for p in parts))


def test_approximate_quantiles_are_within_their_rank(spark):
    runs = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("elapsed"))
    assert abs(stats.summary(runs, accuracy=200).first()["median"] - 10_000) <= 100 + 1
    b = stats.box(runs, accuracy=200).first()
    assert abs(b.q1 - 5000) <= 101 and abs(b.q3 - 15_000) <= 101


def test_factor_values(spark):
    bp, ap, bv, av = (100, 99, 98, 97, 96), (102, 103, 104, 105, 106), (10, 20, 30, 40, 50), (5, 10, 15, 20, 25)
    row = {"day": "0102", "stock": "a", "pos": 1, "sec": 34203, "tb": 300.0, "ta": 100.0}
    for i in range(5):
        row |= {f"bp{i + 1}": float(bp[i]), f"bv{i + 1}": float(bv[i]), f"ap{i + 1}": float(ap[i]), f"av{i + 1}": float(av[i])}
    df = fac.with_depth(spark.createDataFrame([row])).withColumn("prev", F.struct(F.lit(101.0).alias("ap1"), F.lit(100.0).alias("bp1"), F.lit(100.0).alias("sb"), F.lit(100.0).alias("sa")))
    got = df.select(*[c.alias(k) for k, c in book.factors().items()]).first()
    expected = [2, 0.019802, 101, 0.333333, 0.333333, 150, 75, 75, 2, 0.5, 97.333333, 104.666667, 99.777778, 7.333333, 15, 0.333333, 1, 0.5, 1, 0.008889]
    assert [round(x, 6) for x in got] == pytest.approx(expected, abs=1e-6)


def test_lag_equals_the_array_form(spark):
    rows = src.from_lineitem(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    a = fac.with_previous(fac.with_depth(rows)).select("day", "stock", "pos", "prev")
    one = fac.with_depth(rows).groupBy("day", "stock").agg(F.sort_array(F.collect_list(F.struct("pos", "sec", "ap1", "bp1", "sb", "sa"))).alias("r"))
    before = lambda x, i: F.when(F.get("r", i - 1)["sec"] <= x["sec"], F.struct(*[F.get("r", i - 1)[c].alias(c) for c in ("sec", "ap1", "bp1", "sb", "sa")]))
    b = one.select("day", "stock", F.explode(F.transform("r", lambda x, i: F.struct(x["pos"].alias("pos"), before(x, i).alias("prev")))).alias("x")).select("day", "stock", "x.*")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_file_plan_has_two_exchanges_and_no_python(spark, tmp_path):
    root = tree(tmp_path, {"0102/a": [line("093000")]})
    plan = fac.factor_means(src.read_snapshots(spark, root))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan and "Arrow" not in plan


def test_keys(spark):
    rows = spark.createDataFrame([("0312", 9 * 3600 + 30 * 60 + 5, 10236221), ("1130", 14 * 3600 + 45 * 60 + 30, 37059370)], "day string, sec int, k int")
    for r in rows.select("*", book.pack_key(F.col("day"), F.col("sec")).alias("p"), book.unpack_day(F.col("k")).alias("d"), book.unpack_seconds(F.col("k")).alias("s")).collect():
        assert (r.p, r.d, r.s) == (r.k, r.day, r.sec)


def test_keys_with_a_year_keep_the_order(spark):
    rows = spark.createDataFrame([("19900101", 21600), ("20251231", 54000), ("20260101", 21600), ("20531231", 86399), ("20540101", 40000), ("20240101", 100)], "d string, s int")
    got = [tuple(r) for r in rows.select(book.compact_time(F.col("d"), F.col("s")), book.compact_time_30(F.col("d"), F.col("s"))).collect()]
    assert [k for k, _ in got[:4]] == sorted(k for k, _ in got[:4]) and got[3][0] == (63 << 26 | 12 << 22 | 31 << 17 | 86399)
    assert got[4] == (None, None) and got[5][1] is None and 0 <= got[1][1] < got[2][1] < 2**30


def test_partial_sums_of_two_vectors(spark):
    rows = spark.createDataFrame([("0102", 1, *[1.0] * 20), ("0102", 1, *[2.0] * 20)], ["day", "sec", *book.ALPHAS])
    got = fac.partial_sums(rows).first()
    assert got.cnt == 2 and all(got[f"sum_{i}"] == 3.0 for i in range(1, 21))
    assert fac.merge_sums(fac.partial_sums(rows)).first().alpha_7 == 1.5


def test_shortest_floats():
    f32 = lambda b: struct.unpack("<f", struct.pack("<I", b))[0]
    cases = {5.0: "5", 0.1: "0.1", 1.6777216e7: "16777216", 1e10: "10000000000", -0.00012345: "-0.00012345", float("nan"): "0", float("inf"): "0", -float("inf"): "0", 0.0: "0", -0.0: "0"}
    assert all(shortest(k) == v for k, v in cases.items())
    dice = random.Random(42)
    for _ in range(20_000):
        x = f32(dice.getrandbits(32))
        s = shortest(x)
        assert "e" not in s.lower() and not s.endswith(".0")
        assert s == "0" if not math.isfinite(x) or x == 0 else struct.pack("<f", float(s)) == struct.pack("<f", x)


def test_job_writes_days_that_read_back_and_validate(spark, tmp_path, capsys):
    root = tree(tmp_path / "in", {"0102/a": [line("093000"), line("093003", ap1=105)], "0102/b": [line("093000", ap1=107)], "0103/a": [HEAD], "0104/a": [line("100000", day="20240104")]})
    (tmp_path / "in/0105").mkdir()
    out = str(tmp_path / "out")
    assert job.factor_job(spark, root, out) > 0
    assert sorted(x for x in os.listdir(out) if not x.startswith(".")) == ["0102.csv", "0103.csv", "0104.csv", "0105.csv"]
    text = (tmp_path / "out/0102.csv").read_text().splitlines()
    assert text[0] == ",".join(day_csv.HEADER) and [x[:6] for x in text[1:]] == ["093000", "093003"]
    assert text[1].split(",")[1] == "4.5" and (tmp_path / "out/0103.csv").read_text() == text[0] + "\n"
    back = {r.tradeTime: r for r in day_csv.read_days(spark, out, ["0102"]).collect()}
    mean = {r.sec: r for r in fac.factor_means(src.read_snapshots(spark, root, ["0102"])).collect()}
    for a in book.ALPHAS:
        assert struct.pack("<f", back["093000"][a]) == struct.pack("<f", mean[34200][a])
    with pytest.raises(FileExistsError):
        job.factor_job(spark, root, out)
    assert job.validate(spark, out, out) and "alpha_1: PASS err=0" in capsys.readouterr().out
    os.remove(tmp_path / "out/0103.csv")
    assert src.newest_run(spark, str(tmp_path / "out")).endswith("/out")


def means(spark, rows):
    return spark.createDataFrame([(d, t, *[x] * 20) for d, t, x in rows], "day string, tradeTime string, " + ", ".join(f"{a} double" for a in book.ALPHAS))


def test_validation(spark):
    gold = means(spark, [("0102", "093000", 1.0), ("0102", "093003", 2.0), ("0102", "145703", 9.0)])
    assert val.passes(gold, gold)
    assert val.passes(gold, gold.withColumn("alpha_3", F.col("alpha_3") * 1.005))
    assert not val.passes(gold, gold.withColumn("alpha_3", F.col("alpha_3") * 1.02))
    assert not val.passes(gold, gold.where("tradeTime <> '093003'"))
    assert val.passes(gold, gold.where("tradeTime <> '145703'"))
    assert not val.passes(gold, gold.unionByName(means(spark, [("0103", "093000", 1.0)])))
    assert not val.passes(gold.unionByName(means(spark, [("0103", "093000", 1.0)])), gold)
    with pytest.raises(ValueError, match="alpha_9"):
        val.aligned(gold, gold.drop("alpha_9"))


def test_shards_are_joined_and_first_rows_kept(spark, tmp_path):
    row = lambda t, x: ",".join([t] + [str(x)] * 20)
    head = ",".join(day_csv.HEADER)
    (tmp_path / "0102.csv-r-00000").write_text("\n".join([head, row("93000", 1), row("93003", 2)]) + "\n")
    (tmp_path / "0102.csv-r-00001").write_text("\n".join([head, row("93003", 7), row("93006", 3)]) + "\n")
    got = {r.tradeTime: r.alpha_1 for r in day_csv.read_days(spark, str(tmp_path)).collect()}
    assert got == {"093000": 1.0, "093003": 2.0, "093006": 3.0}
    with pytest.raises(FileNotFoundError):
        day_csv.read_days(spark, str(tmp_path), ["0109"])


def test_statistics(spark):
    runs = spark.createDataFrame([(x,) for x in (6.0, 6.5, 7.0, 8.0, None, 30.0)], "elapsed double")
    s = stats.summary(runs).first()
    assert (s.runs, s.n, s.median, s.max) == (6, 5, 7.0, 30.0) and s.se == pytest.approx(s.sd / math.sqrt(5))
    assert stats.summary(runs.where("elapsed = 6")).first().sd == 0.0
    b = stats.box(runs).first()
    assert (b.q1, b["median"], b.q3, b.fliers, b.high) == (6.5, 7.0, 8.0, 1, 8.0)
    h = stats.histogram(runs, 4).collect()
    assert sum(r.n for r in h) == 5 and sum(r.density for r in h) * 6 == pytest.approx(1)
    lines = spark.createDataFrame([("@ Driver: ElapsedSec: 6.6774",), ("@ Driver: ElapsedSec: NA",), ("x",)], "value string")
    assert [r[0] for r in lines.select(src.elapsed(lines)).collect()] == [6.6774, None, None]
    parts = spark.createDataFrame([(0, 1.0, 0.0, 1.0)], "component int, weight double, mean double, variance double")
    assert stats.densities(parts, -5, 5, 101).agg(F.sum("density") * 0.1).first()[0] == pytest.approx(1, abs=1e-3)


def test_newest_goes_by_time_then_name(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", at), ("b", at), ("c", at - datetime.timedelta(1))], "dir string, mtime timestamp")
    assert src.newest(rows).first().dir == "b"


def test_stream_equals_batch(spark, tmp_path):
    from tickfold.streaming import means as stream

    lines = [line("092957", ap1=101), line("093000", ap1=103), line("093003", ap1=104), line("093000", ap1=109)]
    rows = src.read_snapshots(spark, tree(tmp_path / "in", {"0102/a": lines, "0102/b": lines[1:]})).select(*book.SNAPSHOT)
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    q = stream.factor_means(source).writeStream.outputMode("complete").format("memory").queryName("stream_means").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got, expected = ({(r.day, r.sec): [round(r[a], 9) for a in book.ALPHAS] for r in x.collect()} for x in (spark.table("stream_means"), fac.factor_means(rows)))
    assert got == expected


def test_trees_are_written_by_tasks_and_listed_by_few(spark, tmp_path):
    """Every file has its name when the tasks end, lines in order, and neither listing nor reading makes a job of thousands of tasks."""
    rows = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("010"), (F.col("id") % 2 + 1).cast("string")).alias("day"), (F.col("id") % 1000).cast("string").alias("stock"), (F.floor(F.col("id") / 1000) + 1).alias("line"))
    texts = rows.select("day", "stock", "line", F.concat(F.lit(line("0930")[:9]), F.format_string("0930%02d", "line"), F.lit(line("093000")[15:] + "\n")).alias("text"))
    numbered = texts.withColumn("line", F.row_number().over(Window.partitionBy("stock", "day").orderBy("line")))
    assert src.write_files(numbered, f"{tmp_path}/tree") == 1000
    assert sorted(os.listdir(tmp_path / "tree/0101")) == sorted(str(i) for i in range(0, 1000, 2))
    assert {tuple(os.listdir(tmp_path / "tree/0102" / str(i))) for i in range(1, 1000, 2)} == {("snapshot.csv",)}
    assert (tmp_path / "tree/0101/8/snapshot.csv").read_text().splitlines() == [line(f"0930{i:02d}") for i in range(1, 5)]
    spark.sparkContext.setJobGroup("listing", "")
    try:
        assert src.read_snapshots(spark, f"{tmp_path}/tree").count() == 4000
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages if s) <= 64


def test_lines_are_those_of_the_text_reader_however_large_the_file(spark, tmp_path, monkeypatch):
    rows = [line("093000"), line("093003", ap1=105), line("093006", ap1=109)]
    for name, text in {"0102/a": "﻿" + "\r\n".join(rows) + "\r\n", "0102/_b": "\r".join(rows), "0102/c/deep": "\n".join(rows), "0103/d e": "\n".join([HEAD, *rows]), "0104/.f": ""}.items():
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "snapshot.csv").write_bytes(text.encode())
    by_text = spark.read.text([f"{tmp_path}/{x}/snapshot.csv" for x in ("0102/a", "0102/_b", "0103/d e", "0104/.f")]).where("value <> ''")
    expected = sorted(tuple(r) for r in by_text.select("_metadata.file_path", "value").collect())
    for whole in (src.WHOLE, 1000, 0):
        monkeypatch.setattr(src, "WHOLE", whole)
        lines = src.read_lines(spark, str(tmp_path)).where("value <> ''")
        assert sorted(tuple(r) for r in lines.select("path", "value").collect()) == expected and len(expected) == 10
    assert src.read_lines(spark, f"{tmp_path}/*/*/snapshot.csv", ["0103"]).where("value <> ''").count() == 4


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    """At 60 times sf0.1 Spark's own split of 300,000 files would be 9,375 tasks of 32 files; every line is still there once."""
    for i in range(1500):
        (tmp_path / f"0102/{i}").mkdir(parents=True)
        (tmp_path / f"0102/{i}/snapshot.csv").write_text(f"{i}\n")
    lines = src.read_lines(spark, str(tmp_path)).where("value <> ''")
    assert lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(int(r.value) for r in lines.collect()) == list(range(1500))


def test_lines_are_made_and_parsed_by_compiled_code(spark, tmp_path):
    """No lambda, below which Spark interprets a line's expressions, and no method above 8000 bytes, which Java interprets."""
    from tickfold.plans import catalogue

    rows = catalogue.snapshots(spark, "/root/testdata/sf0.001")
    text = rows.select(catalogue._text().alias("text"), F.concat(F.array_join(catalogue._lines(), "\n"), F.lit("\n")).alias("joined"))
    assert text.where("text is null or text <> joined").count() == 0 < text.where("text like '%\n%\n'").count()
    assert "lambda" not in rows.select(catalogue._text())._jdf.queryExecution().executedPlan().toString()
    text = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString
    read = fac.factor_means(src.read_snapshots(spark, tree(tmp_path, {"0102/a": [line("093000")]})))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert 0 < max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text(read._jdf.sparkSession().sessionState().executePlan(read._jdf.queryExecution().logical(), read._jdf.queryExecution().mode()).executedPlan()))) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
