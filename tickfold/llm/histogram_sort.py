"""Sharding by histogram sort, in DataFrame functions only.

Keys are a 63-bit hash of the text, then the document id. The splitter between shards i - 1 and i is the place in key
order that has i / shards of all bytes below it. It is found by counting: every round deals the rows of the open
intervals into equal probes, sums exact bytes below each, and each splitter keeps the probe interval that holds its
target. A splitter is settled once a boundary between keys is within tolerance, or the interval is one key. If one key
(a group of equal texts) straddles the target by more than the tolerance, the same search goes on over the ids inside
it; so groups stay together as long as the balance allows, and a group with a third of all bytes is split. What comes
to the driver is a histogram of shards x probes rows, whatever the input. Rows move once, narrow, at the end: dealt by ranges of the keys
and sorted, so slots follow the key order at every size, and a group of equal texts is many ranges of ids. A row's slot
is its place in its range plus the rows of its shard in ranges before, a table of ranges + shards rows.

Defined results: a null text has no bytes and the hash of an empty one, a null id sorts first, repeated rows (id and
text) are one unit and stay in one shard, an empty table gives an empty table. Other columns can be carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickfold.llm.shared import cut

FIRST, LAST = -(2**63), 2**63 - 1


def splitters(rows: DataFrame, key: str, targets: list[int], base: int, tolerance: float, bits: int = 10) -> list[tuple[int, int, int]]:
    """For each target: (key k, bytes below k, bytes up to k); rows have key and size, base bytes lie below them all.

    Below k there are at most target bytes, and up to k more, unless a boundary within tolerance was met before: then
    both figures are that boundary's, and rows of k lie above it. A probe is a prefix of the key read as an unsigned
    number; each round refines the open prefixes by so many bits. Prefixes with few rows are finished key by key.
    """
    prefix = lambda shift: F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(FIRST)), shift)  # noqa: E731  order of signed longs
    signed = lambda u: u - 2**64 if u > LAST else u
    found: dict[int, tuple[int, int, int]] = {}
    open_ = {i: (0, base) for i in range(len(targets))}  # the prefix and the bytes below it
    shift, few = 64, set()
    while open_:
        exact = few >= {p for p, _ in open_.values()}
        width = shift if exact else min(bits, shift)
        wanted = sorted({p for p, _ in open_.values()})
        part = rows if shift == 64 else rows.where(prefix(shift).isin([signed(p) for p in wanted]))
        hist = part.groupBy(prefix(shift - width).alias("c")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        cells: dict[int, list[tuple[int, int, int]]] = {}
        for c, b, n in sorted((r["c"] % 2**64, r["b"], r["n"]) for r in hist):
            cells.setdefault(c >> width, []).append((c, b, n))
        shift -= width
        few = {c for own in cells.values() for c, _, n in own if n <= 1 << bits}
        for i, (p, below) in list(open_.items()):
            for c, b, _ in cells[p]:
                near = abs(below - targets[i]) <= tolerance
                if near or below + b > targets[i]:
                    break
                below += b
            else:  # the target is all there is
                c, near = c + 1, True
            if near or not shift:
                found[i] = (min(signed((c << shift) % 2**64 ^ 2**63), LAST) if c << shift < 2**64 else LAST, below, below if near else below + b)
                del open_[i]
            else:
                open_[i] = (c, below)
    return [found[i] for i in range(len(targets))]


def shard(docs: DataFrame, shards: int = 24, *, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.005, cell_rows: int = 50_000, most_cells: int = 10_000) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot. tolerance: of a shard's even share, at each splitter.

    cell_rows: rows of a range; beyond most_cells ranges they have more rows, which are sorted on disk then.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(t), 1).alias("key"), F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST)).alias("_id"), F.monotonically_increasing_id().alias("_row"),
        ), "sizes",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slack = tolerance * total / shards
    targets = [total * i // shards for i in range(1, shards)]
    ends: list[tuple[int, int]] = []  # rows of a key and id at or above the i-th lie in a shard after the i-th
    if n:
        first = splitters(rows, "key", targets, 0, slack)
        inner: dict[int, list[int]] = {}
        for i, (k, below, upto) in enumerate(first):
            if min(targets[i] - below, upto - targets[i]) > slack:
                inner.setdefault(k, []).append(i)
        ends = [(k, FIRST) if t - below <= upto - t else (k + 1, FIRST) for t, (k, below, upto) in zip(targets, first)]
        for k, which in inner.items():  # at most shards - 1 keys hold a splitter
            for i, (d, below, upto) in zip(which, splitters(rows.where(F.col("key") == k), "_id", [targets[i] for i in which], first[which[0]][1], slack)):
                ends[i] = (k, d) if targets[i] - below <= upto - targets[i] else (k, d + 1) if d < LAST else (k + 1, FIRST)
    ends.sort()
    place = F.lit(0)
    for k, d in ends:
        place = place + ((F.col("key") > k) | ((F.col("key") == k) & (F.col("_id") >= d))).cast("int") if k <= LAST else place
    cells = min(most_cells, max(1, -(-n // cell_rows)))
    order = ("key", "_id", "_row")
    dealt = rows.withColumn("shard", place).repartitionByRange(cells, *order).sortWithinPartitions(*order)
    # written, so that places stay as they are: 33 bits of place in the range below the range's number
    at = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).select("doc_id", "size", "text_crc32", "key", "shard", "_at"), "dealt").withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = at.groupBy("shard", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = runs.select("shard", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return at.join(F.broadcast(starts), ["shard", "_range"]).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("_start") + F.col("_at")).alias("slot"))
