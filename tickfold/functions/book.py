"""Column expressions over one snapshot of a limit order book: depth sums, the twenty factors, session and time codes.

A canonical snapshot has day STRING (MMDD), stock, pos (place in its file), sec (second of day), tb and ta (total bid and
ask volume) and, for levels 1 to 5, bp, bv, ap, av (bid price and volume, ask price and volume) as DOUBLE.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 5
# Level weights (the third is that decimal, not 1/3), the term in every denominator, the sessions' seconds.
WEIGHTS = (1.0, 0.5, 0.33333333, 0.25, 0.2)
EPSILON = 1e-7
SESSIONS = ((34_200, 41_400), (46_800, 54_000))
SIX_AM, TIME_BITS = 21_600, 15
ALPHAS = tuple(f"alpha_{i}" for i in range(1, 21))
BOOK = tuple(f"{side}{i}" for i in range(1, LEVELS + 1) for side in ("bp", "bv", "ap", "av"))
SNAPSHOT = ("day", "stock", "pos", "sec", "tb", "ta", *BOOK)


def _total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def depth_sums(levels: int = LEVELS) -> dict[str, Column]:
    """sb, sa: volume; pb, pa: price times volume; wb, wa: volume by level weight; each over the first levels."""
    at = range(1, levels + 1)
    return {
        "sb": _total([F.col(f"bv{i}") for i in at]),
        "sa": _total([F.col(f"av{i}") for i in at]),
        "pb": _total([F.col(f"bp{i}") * F.col(f"bv{i}") for i in at]),
        "pa": _total([F.col(f"ap{i}") * F.col(f"av{i}") for i in at]),
        "wb": _total([F.col(f"bv{i}") * F.lit(WEIGHTS[i - 1]) for i in at]),
        "wa": _total([F.col(f"av{i}") * F.lit(WEIGHTS[i - 1]) for i in at]),
    }


def levels_array() -> Column:
    """The book as an array of structs, for a depth that is not fixed."""
    return F.array(*[F.struct(F.col(f"bp{i}").alias("bp"), F.col(f"bv{i}").alias("bv"), F.col(f"ap{i}").alias("ap"), F.col(f"av{i}").alias("av")) for i in range(1, LEVELS + 1)])


def _per(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPSILON))


def factors() -> dict[str, Column]:
    """alpha_1 to alpha_20 of a snapshot with its depth sums and prev (ap1, bp1, sb, sa of the one before, or null)."""
    c = F.col
    ap, bp, bv, av = c("ap1"), c("bp1"), c("bv1"), c("av1")
    sb, sa, depth = c("sb"), c("sa"), c("sb") + c("sa")
    spread, mid, gap = ap - bp, F.lit(0.5) * (ap + bp), sb - sa
    prev, none = c("prev"), F.lit(0.0)
    return {
        "alpha_1": spread,
        "alpha_2": _per(spread, mid),
        "alpha_3": mid,
        "alpha_4": _per(bv - av, bv + av),
        "alpha_5": _per(gap, depth),
        "alpha_6": sb,
        "alpha_7": sa,
        "alpha_8": gap,
        "alpha_9": _per(sb, sa),
        "alpha_10": _per(c("tb") - c("ta"), c("tb") + c("ta")),
        "alpha_11": _per(c("pb"), sb),
        "alpha_12": _per(c("pa"), sa),
        "alpha_13": _per(c("pb") + c("pa"), depth),
        "alpha_14": _per(c("pa"), sa) - _per(c("pb"), sb),
        "alpha_15": gap / F.lit(5.0),
        "alpha_16": _per(c("wb") - c("wa"), c("wb") + c("wa")),
        "alpha_17": F.coalesce(ap - prev["ap1"], none),
        "alpha_18": F.coalesce(F.lit(0.5) * ((ap + bp) - (prev["ap1"] + prev["bp1"])), none),
        "alpha_19": F.coalesce(_per(sb, sa) - _per(prev["sb"], prev["sa"]), none),
        "alpha_20": _per(spread, depth),
    }


def in_session(sec: str | Column = "sec") -> Column:
    """Within a session, both ends included."""
    sec = F.col(sec) if isinstance(sec, str) else sec
    return reduce(lambda a, b: a | b, [sec.between(a, z) for a, z in SESSIONS])


def to_hhmmss(sec: Column) -> Column:
    return F.format_string("%02d%02d%02d", F.floor(sec / 3600).cast("int"), F.floor(sec % 3600 / 60).cast("int"), (sec % 60).cast("int"))


def to_seconds(hhmmss: Column) -> Column:
    part = lambda at: F.substring(hhmmss, at, 2).cast("int")
    return part(1) * 3600 + part(3) * 60 + part(5)


def pack_key(day: Column, sec: Column) -> Column:
    """Day as a number above 15 bits of seconds since six."""
    return F.shiftleft(day.cast("int"), TIME_BITS).bitwiseOR((sec - SIX_AM).cast("int"))


def unpack_day(key: Column) -> Column:
    return F.lpad(F.shiftrightunsigned(key, TIME_BITS).cast("string"), 4, "0")


def unpack_seconds(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << TIME_BITS) - 1)) + SIX_AM


def date_code(date: Column, year_zero: int = 1990) -> Column:
    """15 bits of a YYYYMMDD text: years since 1990 (6), month (4), day (5); null outside of 1990 to 2053."""
    part = lambda at, n: F.substring(date, at, n).cast("int")
    years = part(1, 4) - year_zero
    return F.when(years.between(0, 63), F.shiftleft(years, 9).bitwiseOR(F.shiftleft(part(5, 2), 5)).bitwiseOR(part(7, 2)))


def compact_time(date: Column, sec: Column) -> Column:
    """32 bits, date above 17 bits of seconds, as an unsigned number; a BIGINT, so that its order is right."""
    return F.shiftleft(date_code(date).cast("bigint"), 17).bitwiseOR(sec.cast("bigint"))


def compact_time_30(date: Column, sec: Column) -> Column:
    """30 bits, date above 15 bits of seconds since six, never negative; null before six."""
    return F.when(sec >= SIX_AM, F.shiftleft(date_code(date), TIME_BITS).bitwiseOR((sec - SIX_AM).cast("int")))


def relative_error(truth: Column, found: Column, epsilon: float = EPSILON) -> Column:
    """|truth - found| / |truth + epsilon|; NaN where either is missing, so that no mean can hide a gap."""
    return F.coalesce(F.abs(truth - found) / F.abs(truth + F.lit(epsilon)), F.lit(float("nan")))


def vector_text(columns: tuple[str, ...] = ALPHAS) -> Column:
    """A vector of numbers as a line for logs."""
    return F.concat(F.lit("Factors: ["), F.concat_ws(", ", *[F.col(c).cast("string") for c in columns]), F.lit("]"))


def metric(value: Column) -> Column:
    return F.when(value == 0, "0").otherwise(F.format_string("%.2e", value))
