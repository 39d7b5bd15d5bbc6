"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

``measures`` counts what the rules need of each text. ``calibrate`` chooses, for every stratum (language) and rule, a
cutoff from a fixed grid, on the labelled documents that pass the base rules (the holdout; nothing else is learned from
labels). A cutoff counts as safe if an exact binomial test rejects "at least alpha / rules of the good documents of this
stratum lie beyond it" at level delta / (strata x rules) (Bonferroni). Within one rule and stratum the cutoffs are tested
from the most lenient to the strictest and testing stops at the first that fails (fixed sequence): so all safe ones hold
at once, and any of them may be chosen, by the same labels too; it is the one that rejects most bad documents for each
good one. So with confidence 1 - delta no stratum loses more than alpha of its good documents that pass the base rules
to the cutoffs together. A stratum with too few good labels to pass any test gets no cutoffs; such strata are left out
before anything comes to the driver, so a dirty language column costs nothing.

Defined results: a null text counts as empty; a null language is a stratum of its own ('und'); labels that are null,
contradictory or repeated count row by row, rows with a null quality not at all; an empty table gives an empty table;
other columns of the input are kept, but those with the names of the added columns are replaced, and those named as in
INNER left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickfold.llm.shared import SPACE, cut

WINDOW = 8
RULES = ("symbols", "bangs", "dup_lines", "repeats", "stutter")
GRID = (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)
INNER = ("_w", "_l", "_h", "_g", "_s", "_p", "_symbols", "_bangs", "_dup_lines", "_repeats", "_stutter")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_stutter", "n_lines")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts of COUNTS, base_failed and the rates named in RULES.

    All in-row array functions: no shuffle, and a row's state is in proportion to its own text. Repeated windows are
    found by 64-bit hashes of the words; the sort that locates them runs only for texts that have some.
    """
    keep = [c for c in df.columns if c not in (*COUNTS, *RULES, *INNER, "base_failed")]
    t, n = F.coalesce(F.col(text), F.lit("")), F.col("n_words").cast("int")
    df = df.select(*keep, F.array_remove(F.split(t, SPACE), "").alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    df = df.select(
        *keep,
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    m = n - (WINDOW - 1)
    df = df.select(
        *keep,
        *[c for c in COUNTS if c not in ("n_repeat_words", "n_stutter")],
        F.when(m > 1, F.transform(F.arrays_zip(*[F.slice("_h", F.lit(i + 1), m) for i in range(WINDOW)]), lambda x: F.xxhash64(x))).alias("_g"),
        F.when(n > 1, F.size(F.filter(F.arrays_zip(F.slice("_h", F.lit(1), n - 1).alias("p"), F.slice("_h", F.lit(2), n - 1).alias("q")), lambda x: x["p"] == x["q"]))).otherwise(0).cast("long").alias("n_stutter"),
    )
    again = F.col("_g").isNotNull() & (F.size(F.array_distinct("_g")) < F.size("_g"))
    df = df.withColumn("_s", F.when(again, F.sort_array(F.arrays_zip(F.col("_g").alias("h"), F.sequence(F.lit(0), F.size("_g") - 1).alias("at")))))

    def twin(i: Column, by: int) -> Column:
        return F.coalesce(F.get("_s", i + by)["h"] == F.get("_s", i)["h"], F.lit(False))

    spots = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: twin(i, -1) | twin(i, 1)), lambda i: F.get("_s", i)["at"]))
    df = df.drop("_g").withColumn("_p", F.when(F.col("_s").isNotNull(), spots))
    steps = F.transform("_p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - x, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_s", "_p")

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    rates = {"symbols": share("n_symbols", "word_chars"), "bangs": share("n_bangs", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "stutter": share("n_stutter", "n_words")}
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select(*keep, *COUNTS, failed.alias("base_failed"), *[rates[r].alias(r) for r in RULES])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n draws at p, exact up to rounding; 1 for n = 0. Summed from k down until terms vanish."""
    if n == 0:
        return 1.0
    total = 0.0
    for i in range(k, -1, -1):
        x = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        total += x
        if i < n * p and x < total * 1e-15:
            break
    return min(1.0, total)


def stratum(lang: str) -> Column:
    return F.coalesce(F.col(lang), F.lit("und"))


def calibrate(measured: DataFrame, labels: DataFrame, lang: str = "lang", key: str = "doc_id", alpha: float = 0.05, delta: float = 0.05) -> dict[str, dict[str, float]]:
    """Stratum -> rule -> safe cutoff. What comes to the driver is a histogram: rules x cutoffs x 2 rows for each stratum
    with enough good labels, so of strata at most as many as labels divided by that number."""
    marks = labels.where("quality is not null").select(F.col(key).alias("_id"), (F.col("quality") == 1).alias("_good"))
    rows = measured.where(~F.col("base_failed")).select(F.col(key).alias("_id"), stratum(lang).alias("_s"), *RULES).join(marks, "_id")
    bins = F.array(*[F.struct(F.lit(r).alias("rule"), sum((F.col(r) <= c).cast("int") for c in GRID).alias("bin")) for r in RULES])
    counts = cut(rows.select("_s", "_good", F.explode(bins).alias("b")).groupBy("_s", "_good", "b.rule", "b.bin").count(), "histogram")
    most = alpha / len(RULES)
    needed = math.ceil(math.log(delta / len(RULES)) / math.log1p(-most))  # with fewer not even a cutoff that rejects none is safe
    enough = counts.where(F.col("_good") & (F.col("rule") == RULES[0])).groupBy("_s").agg(F.sum("count").alias("n")).where(F.col("n") >= needed).select("_s")
    hist = counts.join(enough, "_s").collect()
    strata = sorted({r["_s"] for r in hist})
    level = delta / max(1, len(strata) * len(RULES))
    at: dict[tuple[str, str, bool], list[int]] = {}
    for r in hist:
        at.setdefault((r["_s"], r["rule"], r["_good"]), [0] * (len(GRID) + 1))[r["bin"]] += r["count"]
    chosen: dict[str, dict[str, float]] = {}
    for s in strata:
        chosen[s] = {}
        for rule in RULES:
            goods, bads = (at.get((s, rule, good), [0] * (len(GRID) + 1)) for good in (True, False))
            best, cutoff = 0.0, None
            for i, c in enumerate(GRID):
                lost, caught = sum(goods[: i + 1]), sum(bads[: i + 1])  # bin: grid values the rate is not above
                if binomial_tail(lost, sum(goods), most) > level:
                    break
                gain = caught / max(1, sum(bads)) - 10 * lost / sum(goods)
                if gain > best:
                    best, cutoff = gain, c
            if cutoff is not None:
                chosen[s][rule] = cutoff
    return chosen


def verdict(measured: DataFrame, cutoffs: dict[str, dict[str, float]], lang: str = "lang") -> DataFrame:
    """measured with kept: not base_failed, and no rate above its stratum's cutoff. The cutoffs are a row for each stratum
    that has some; they go to all tasks, so no row is shuffled."""
    rows = [F.struct(F.lit(s).alias("_s"), *[F.lit(by_rule.get(r)).cast("double").alias(f"_{r}") for r in RULES]) for s, by_rule in sorted(cutoffs.items()) if by_rule]
    if not rows:
        return measured.withColumn("kept", ~F.col("base_failed"))
    table = measured.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    over = F.greatest(F.lit(0), *[(F.col(r) > F.col(f"_{r}")).cast("int") for r in RULES]).cast("boolean")  # greatest skips nulls
    joined = measured.withColumn("_s", stratum(lang)).join(F.broadcast(table), "_s", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("_s", *[f"_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, *, carry: tuple[str, ...] = ("doc_id", "lang"), alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """carry of each document with its counts, rates, base_failed and kept. carry must have doc_id and lang.

    The texts are measured once, in one pass; what calibration and verdicts read is the written table."""
    measured = cut(measures(docs.select(*dict.fromkeys([*carry, "text"]))).select(*carry, *COUNTS, "base_failed", *RULES), "quality")
    return verdict(measured, calibrate(measured, labels, alpha=alpha, delta=delta))
