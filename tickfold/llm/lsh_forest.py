"""Near-duplicate groups by an LSH forest of MinHash signatures, with every link confirmed on full shingle sets.

1. ``sketch``: each text's set of hashed word shingles and ``TREES * DEPTH`` minima of it. Texts with equal sets become
   one class (its smallest id), by a combined aggregate, so exact copies cost nothing further.
2. Forest: every tree orders the classes by its own run of minima. Neighbours in a tree's order that agree in a long
   enough prefix are candidates. The least depth is the largest at which a pair at the threshold is missed by all trees
   with chance under ``MISS``. Where more than ``REGION`` classes share that prefix the region is cut by a deeper
   prefix, and again, until its parts are small: the depth adapts to the density, and ``MISS`` no longer bounds the
   chance there (at depth d it is up to (1 - similarity^d)^TREES for a pair that no other member links). A part is
   compared all against all in one task, by the share of equal minima, and only a star over each set of similar ones
   leaves it: no pairs. A part still dense when all ``DEPTH`` minima agree becomes one star without being compared here.
3. Confirmation: components of those rough links bring together all that can be linked. Their texts are read again, and
   only theirs are shuffled; links are decided on full sets, by counting shared shingles through an inverted index. A
   component with many texts or shingles is cut into random blocks, each one task's work together with one pivot of
   the component. Whatever that joins with the pivot is settled. What is not is compared with itself and with those
   settled texts that can be linked with it at all: Jaccard distance is a metric, so a settled text much nearer to the
   pivot than all the others is out of reach. So a group of a million near copies costs its size, not its square; only
   groups without a middle are compared by pairs of blocks. Again only stars leave a task.
4. Components of the confirmed links, and the smallest id of each.

Defined results: words are runs of other characters than U+0009 to U+000D and space, with A-Z lowered; a text with
fewer words than a shingle has its whole sequence as one; a null text or one without words has no shingles, is linked
with nothing and is its own component; a null id sorts before all others; rows with one id and unlike texts are compared
as any others, so they need not be in one component; equal rows are; an empty table gives an empty table; other columns
are not used, also where their names clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.packing import chunks
from tickfold.llm.shared import bit_filter, bit_split, components, cut, slices

TREES, DEPTH, MISS = 16, 12, 2e-5
REGION = 2000
BLOCK_TEXTS, BLOCK_SHINGLES = 300, 500_000
NO_ID = -(2**63)
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64)
    n = max(1, len(h) - words + 1)
    total = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        total = (total ^ h[k : k + n]) * _P
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def minima(found: np.ndarray) -> bytes:
    """TREES * DEPTH minima, 16 bits of each, tree by tree."""
    x = found.astype(np.uint32)
    best = np.full(len(_A), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        best = np.minimum(best, (_A[:, None] * x[None, i : i + 2048] + _B[:, None]).min(1))
    best ^= best >> np.uint32(15)
    return (best * np.uint32(0x2C1B3C6D) & np.uint32(0xFFFF)).astype(">u2").tobytes()


def depth_for(similarity: float) -> int:
    """The largest prefix that some tree finds equal, but for a chance under MISS, for a pair at the threshold."""
    return max([d for d in range(1, DEPTH + 1) if (1 - similarity**d) ** TREES <= MISS], default=1)


def row_keys(doc_id: str, text: str) -> list[F.Column]:
    """Two hashes of a row's id and text, by which it is found again; equal rows have equal ones."""
    id_, text_ = F.col(doc_id).cast("long"), F.col(text)
    return [F.xxhash64(id_, text_).alias("k1"), F.xxhash64(text_, id_, F.lit("k2")).alias("k2")]


def sketch(docs: DataFrame, words: int, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, k1, k2, n_shingles, set_id (a digest of the set) and minima of every row, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for a, b in chunks(texts):
                sets = [shingles(t, words) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([minima(s) if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "k1", "k2", "n_shingles", "set_id", "minima"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_keys(doc_id, text), text)
    return cut(rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n_shingles long, set_id binary, minima binary"), "sketch")


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def stars(self, names: list[int]) -> list[tuple[int, int]]:
        """(smallest name of its part, name) of every other member: what the same part gives in many regions is one link."""
        least: dict[int, int] = {}
        for i, x in enumerate(names):
            r = self.root(i)
            least[r] = min(x, least.get(r, x))
        return [(a, x) for i, x in enumerate(names) if (a := least[self.root(i)]) != x]


def forest_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Rough links (a, b) between classes (node, minima): stars over what looks similar in each tree's regions."""
    least = depth_for(similarity)
    rough = similarity - 5 * float(np.sqrt(similarity * (1 - similarity) / (TREES * DEPTH)))
    keys = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("minima", 2 * DEPTH * t + 1, 2 * DEPTH).alias("order")) for t in range(TREES)])
    rows = classes.select("node", F.explode(keys).alias("k")).select("node", "k.tree", "k.order")
    depth, regions = least, None
    rows = rows.withColumn("region", F.xxhash64("tree", F.substring("order", 1, 2 * depth)))
    while True:
        sizes = rows.groupBy("region").agg(F.count("*").alias("count"), F.min("node").alias("first")).where("count > 1")
        sizes = cut(sizes, "region-sizes")  # written, so that a hot region's join can be split
        live = cut(bit_filter(rows, "region", sizes).join(sizes, "region").select("node", "tree", "order", "region", "count", "first"), "regions")
        small = live.where(F.col("count") <= REGION).select("node", "region", "order")
        regions = small if regions is None else regions.union(small)
        dense = live.where(F.col("count") > REGION)
        if depth == DEPTH or not dense.limit(1).count():
            break
        depth = min(DEPTH, depth + 2)
        rows = dense.select("node", "tree", "order", F.xxhash64("region", F.substring("order", 1, 2 * depth)).alias("region"))
    # what is as deep as a tree goes and still dense is linked whole: confirmation compares all of it
    stars = dense.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    whole = regions.join(classes, "node").select("region", "order", "node", "minima")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by region; one region is held at a time."""
        need = int(np.ceil(rough * TREES * DEPTH))

        def links(nodes: list[int], minima: list[bytes]) -> list[tuple[int, int]]:
            m = np.frombuffer(b"".join(minima), ">u2").reshape(len(minima), -1).astype(np.uint16)
            sets = Union(len(nodes))
            for i in range(1, len(nodes)):
                for j in np.flatnonzero((m[:i] == m[i]).sum(1) >= need).tolist():
                    sets.join(i, j)
            return sets.stars(nodes)

        region, nodes, minima = None, [], []
        for batch in batches:
            out = []
            for r, n, m in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if r != region:
                    if len(nodes) > 1:
                        out += links(nodes, minima)
                    region, nodes, minima = r, [], []
                nodes.append(n)
                minima.append(m)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        last = links(nodes, minima) if len(nodes) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in last], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = whole.repartition("region").sortWithinPartitions("region", "order").select("region", "node", "minima")
    return cut(dealt.mapInArrow(scan, "a long, b long").union(stars).distinct(), "rough")


def linked(sets: list[np.ndarray], percent: int, cross: int | None = None, ask: list[int] | None = None) -> Union:
    """The parts that links make of sets: 100 * intersection >= percent * union. cross: only links from before that place
    to after it. ask: only links that one of these has."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    union = Union(n)
    if n < 2 or ask == []:
        return union
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(n), size)
    by = np.argsort(code, kind="stable")
    posts, first = of[by], np.concatenate(([0], np.cumsum(np.bincount(code))))
    ends = np.cumsum(size)
    for i in ask if ask is not None else range(1, n) if cross is None else range(cross, n):
        own = code[ends[i] - size[i] : ends[i]]
        own = own[first[own + 1] - first[own] > 1]
        if not len(own):
            continue
        lengths = first[own + 1] - first[own]
        at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        shared = np.bincount(posts[at], minlength=n)
        hit = (shared > 0) & (100 * shared >= percent * (size + size[i] - shared))
        if cross is not None:
            hit[cross:] &= i < cross
            hit[:cross] &= i >= cross
        for j in np.flatnonzero(hit).tolist():
            union.join(i, j)
    return union


JOB = "component long, i int, j int, block int, node long, settled boolean, text string"
FOUND = "component long, a long, b long, distance double"


def compare(jobs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """FOUND, written: of each job (component, i, j) stars over what its links join, without a distance; and if it has rows
    of block -1, the pivot, each other text's distance from it. Texts marked settled are not compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(job: tuple, own: dict[int, tuple[int, bool, np.ndarray]]) -> list[tuple]:
            nodes, sets = list(own), [s for _, _, s in own.values()]
            cross = None if job[1] == job[2] else sum(b == job[1] for b, _, _ in own.values())
            ask = [k for k, (_, settled, _) in enumerate(own.values()) if not settled] if any(s for _, s, _ in own.values()) else None
            out = [(job[0], a, b, None) for a, b in linked(sets, percent, cross, ask).stars(nodes)]
            if own and next(iter(own.values()))[0] == -1:
                for node, s in zip(nodes, sets):
                    same = len(np.intersect1d(sets[0], s, assume_unique=True))
                    out.append((job[0], nodes[0], node, 1 - same / (len(sets[0]) + len(s) - same)))
            return out

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=[f.split()[0] for f in FOUND.split(", ")])

        job, own = None, {}
        for batch in slices(batches):
            out = []
            for c, i, j, block, node, settled, t in zip(*(x.to_pylist() for x in batch.columns)):
                if (c, i, j) != job:
                    out += results(job, own) if job else []
                    job, own = (c, i, j), {}
                if node not in own:  # equal rows come more than once; so does a pivot in its own block
                    own[node] = (block, settled, shingles(t, words))
            yield packed(out)
        yield packed(results(job, own) if job else [])

    dealt = jobs.select(*[f.split()[0] for f in JOB.split(", ")]).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "block")
    return cut(dealt.mapInArrow(run, FOUND), name)


def confirm(docs: DataFrame, classes: DataFrame, rough: DataFrame, words: int, percent: int, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Confirmed links (a, b): stars over what links join within the tasks that compare full sets."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    all_texts = docs.select(*row_keys(doc_id, text), F.col(text).alias("text"))

    def with_texts(rows: DataFrame) -> DataFrame:
        """rows (k1, k2) with their texts; other texts stay where they are, but for a few that a bitmap lets through."""
        return rows.join(bit_filter(all_texts, "k1", rows), ["k1", "k2"])

    groups = components(rough, "rough-components").join(classes.select("node", "n", "k1", "k2"), "node")
    sizes = cut(groups.groupBy("component").agg(blocks, F.min("node").alias("pivot")), "component-sizes")
    placed = cut(groups.join(sizes, "component").select("component", "node", "n", "k1", "k2", "blocks", "pivot", block), "placed")
    large = placed.where("blocks > 1")
    own = placed.select("component", "node", "k1", "k2", F.col("block").alias("i"), "block")
    pivots = large.where("node = pivot").select("component", "node", "k1", "k2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(-1).alias("block"))
    jobs = with_texts(own.unionByName(pivots)).withColumns({"j": F.col("i"), "settled": F.lit(False)})
    first = compare(jobs, words, percent, "links")
    links = first.where("distance is null").select("a", "b")
    if not large.limit(1).count():
        return links.distinct()
    # what is not joined with the pivot, and what is but can still be linked with that
    parts = components(links.join(large.select(F.col("node").alias("a")), "a", "left_semi"), "parts")
    members = large.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    middle = members.where("node = pivot").select("component", F.col("part").alias("middle"))
    far = first.where("distance is not null").groupBy("component", F.col("b").alias("node")).agg(F.min("distance").alias("distance"))
    members = cut(members.join(middle, "component").join(far, ["component", "node"]).withColumn("settled", F.col("part") == F.col("middle")), "members")
    reach = members.where("not settled").groupBy("component").agg(F.min("distance").alias("nearest"))
    left = members.join(reach, "component").where(~F.col("settled") | (F.col("distance") >= F.col("nearest") - (100 - percent) / 100 - 1e-9)).select("component", "node", "n", "k1", "k2", "settled")
    left = left.join(left.groupBy("component").agg(blocks), "component").select("component", "node", "k1", "k2", "settled", "blocks", block)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    second = compare(with_texts(cut(left, "left")).withColumn("p", F.explode(pairs)).withColumns({"i": F.col("p.i"), "j": F.col("p.j")}), words, percent, "more-links")
    return links.unionByName(second.select("a", "b")).distinct()


def grouped(docs: DataFrame, *, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and of every set of shingles (set_id) its component's least row: first (its id, NO_ID for
    null) and the keys (k1, k2) by which it is found. Rows without shingles have no set here."""
    rows = sketch(docs, words, text=text, doc_id=doc_id)
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "k1", "k2")).alias("least")
    classes = rows.where("n_shingles > 0").groupBy("set_id").agg(least, F.first("n_shingles").alias("n"), F.first("minima").alias("minima"))
    # written, so that the numbers of classes stay as they are
    classes = cut(classes.select("set_id", "least", "n", "minima", "least.k1", "least.k2", F.monotonically_increasing_id().alias("node")), "classes")
    rough = forest_links(classes.select("node", "minima"), percent / 100)
    found = components(confirm(docs, classes, rough, words, percent, text=text, doc_id=doc_id), "near")
    linked_ = classes.select("node", "set_id", "least").join(found, "node")
    best = linked_.groupBy("component").agg(F.min("least").alias("best"))
    of = linked_.join(best, "component").select("set_id", "best")
    sets = classes.select("set_id", "least").join(of, "set_id", "left").select("set_id", F.coalesce("best", "least").alias("at"))
    return rows, cut(sets.select("set_id", F.col("at.id").alias("first"), "at.k1", "at.k2"), "sets")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, sets = grouped(docs, words=words, percent=percent, text=text, doc_id=doc_id)
    out = rows.select("doc_id", "n_shingles", "set_id").join(sets.select("set_id", "first"), "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.nullif(F.col("first"), F.lit(NO_ID))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without near copies: one row, the least by id, of each component; of equal rows (id and text) one.

    Rows under one id with unlike texts are documents of their own, and so are rows with a null id and texts without
    words. All columns are kept, but those named _k1, _k2 and _hit."""
    docs = docs.drop("_k1", "_k2", "_hit")
    rows, sets = grouped(docs, words=words, percent=percent, text=text, doc_id=doc_id)
    keys = rows.groupBy("k1", "k2").agg(F.first("set_id").alias("set_id"), F.first("n_shingles").alias("n"), F.count("*").alias("times"))
    keys = keys.join(sets.select("set_id", F.col("k1").alias("c1"), F.col("k2").alias("c2")), "set_id", "left")
    chosen = (F.col("n") == 0) | F.coalesce((F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), F.lit(False))
    # rows that go, and those that stay once: only they, and few others, are shuffled
    told = cut(keys.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), chosen.alias("_hit"), "times").where("not _hit or times > 1").drop("times"), "told")
    k1, k2 = row_keys(doc_id, text)
    some, others = bit_split(docs.select("*", k1.alias("_k1"), k2.alias("_k2")), "_k1", told)
    once = some.join(told, ["_k1", "_k2"], "left")
    none = once.where("_hit is null").select(*docs.columns)
    return others.select(*docs.columns).unionByName(none).unionByName(once.where("_hit").dropDuplicates(["_k1", "_k2"]).select(*docs.columns))
