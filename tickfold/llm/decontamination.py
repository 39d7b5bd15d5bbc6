"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

1. One pass over the texts finds every n-gram of the test items, exactly, and keeps of each text only the stretches
   around such hits, as word numbers of the items' vocabulary (other words cannot match). They are written. A seed has
   four words, or three in items of fewer than ``SHORT`` words, whose edited copies have fewer words left in a row.
2. A stretch with any n-gram of an item is aligned with it, however common the n-gram is: an item whose whole copies are
   common also has partial ones. Two things that lose nothing save work: a stretch with too few of an item's words to
   reach ``SCORE`` isn't aligned, and equal spans are aligned once.
3. The alignment is local, a match 1, a mismatch or gap -0.5. The score is the best alignment's over the item's words;
   edits cost some of it but not the rest. At ``SCORE`` the text is contaminated.

Test items go out in blocks of at most about ``BLOCK_WORDS`` words, so nothing unbounded is sent to tasks or the driver.
With more than one block, one pass over the texts keeps what is around any seed of any block, told by a bitmap of at
most 16 MB, and the blocks' passes read that only: texts are read once, however large the benchmark. A common passage
makes many stretches but no pairs of texts, and no key is grouped but text and item.

Defined results: null or empty texts and items match nothing; an item of fewer words than a seed has one seed, all its
words; a null id is kept; equal rows give equal rows, of which one is kept; an empty table on either side gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.shared import cut

SEED, SHORT_SEED, SHORT = 4, 3, 25
SCORE, BLOCK_WORDS = 0.4, 1_000_000
#: Alignments a task remembers, and words whose hashes it remembers.
CACHED, HASHED = 10_000, 1_000_000
#: Places of the bitmap of all seeds, 32,768 in each of its parts.
PLACES = 1 << 27
#: Words are runs of other characters than white space and these marks.
WORD = re.compile(r"[^\s.,;:!?\"'()\[\]{}<>*#$%&|]+")
STRETCH = "doc_id long, start long, words array<int>, grams array<long>, places array<int>"
RESULT = "doc_id long, item_id long, score double, first_word long, last_word long"
_P = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def seed(words: int) -> int:
    """How many words a seed has in an item of so many."""
    return min(SHORT_SEED if words < SHORT else SEED, words)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of size word numbers; runs with an unknown word have -1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    total, known = np.full(n, size, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = words[k : k + n]
        known &= part >= 0
        total = (total ^ part.astype(np.uint64)) * _P
        total ^= total >> np.uint64(32)
    return np.where(known, (total >> np.uint64(1)).astype(np.int64), -1)


def align(item: np.ndarray, text: np.ndarray, off: float = 0.5) -> tuple[float, int, int]:
    """(score, first and last place in text) of the best local alignment; the first place is found by aligning backwards."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
        top, end, row, slope = 0.0, 0, np.zeros(len(b) + 1), off * np.arange(len(b) + 1)
        for x in a:
            new = np.zeros(len(b) + 1)
            np.maximum(row[:-1] + np.where(b == x, 1.0, -off), row[1:] - off, out=new[1:])
            np.maximum(new, 0.0, out=new)
            row = np.maximum.accumulate(new + slope) - slope  # gaps along the row
            i = int(row.argmax())
            if row[i] > top:
                top, end = float(row[i]), i
        return top, end

    score, end = best(item, text)
    _, back = best(item[::-1], text[:end][::-1])
    return score, end - back, end - 1


class Items:
    """A block of test items: numbers of words, and of each n-gram the items that have it."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.numbers: dict[str, int] = {}
        self.words = []
        for _, text in rows:
            self.words.append(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in tokens(text)], np.int64))
        self.ids = [i for i, _ in rows]
        self.of: dict[int, set[int]] = {}
        self.sizes = sorted({seed(len(w)) for w in self.words if len(w)})
        for k, w in enumerate(self.words):
            if len(w):
                for g in grams(w, seed(len(w))).tolist():
                    self.of.setdefault(g, set()).add(k)
        self.known = np.array(sorted(self.of), np.int64)
        self.margin = max((len(w) for w in self.words), default=0) * 5 // 4 + SEED


def runs(at: np.ndarray, margin: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, end, low, high): hits first to end of the sorted places at, with margin words on both sides, overlap no others."""
    breaks = [0, *(np.flatnonzero(np.diff(at) > 2 * margin) + 1).tolist(), len(at)]
    for a, b in zip(breaks, breaks[1:]):
        yield a, b, max(0, int(at[a]) - margin), int(at[b - 1]) + margin


class Hashes(dict):
    """Numbers of words that need no vocabulary; bounded by forgetting all."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HASHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) >> 1
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def candidates(source: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, start, text of the stretches of source around what may be a seed of the items own, written.

    No stretch with a seed is lost: the bitmap has all of them. The fuller it is, the more others go along."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = tokens(t)
                if words:
                    size = seed(len(words))
                    at = np.unique(grams(hashes.of(words), size) & (PLACES - 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at >> 15, pa.int32()), pa.array(at & 32767, pa.int64()), pa.array(np.full(len(at), size), pa.int32()), pa.array(np.full(len(at), len(words)), pa.int64())],
                        names=["part", "bit", "size", "words"],
                    )

    # at most PLACES / 32768 rows of 4 KB
    maps = own.select("text").mapInArrow(places, "part int, bit long, size int, words long").groupBy("part").agg(F.bitmap_construct_agg("bit"), F.collect_set("size"), F.max("words")).collect()
    whole = np.zeros(PLACES // 8, np.uint8)
    for part, bits, _, _ in maps:
        whole[part * 4096 : part * 4096 + 4096] = np.frombuffer(bits, np.uint8)
    sizes = sorted({size for m in maps for size in m[2]})
    margin = max((m[3] for m in maps), default=0) * 5 // 4 + SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out = []
            for i, start, t in zip(*(c.to_pylist() for c in batch.columns)):
                words = tokens(t)
                numbers, hit = hashes.of(words), np.zeros(len(words), bool)
                for size in sizes:
                    at = grams(numbers, size) & (PLACES - 1)
                    hit[: len(at)] |= (whole[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                if hit.any():
                    out += [(i, start + low, " ".join(words[low:high])) for _, _, low, high in runs(np.flatnonzero(hit), margin)]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "start", "text"])

    return cut(source.mapInArrow(run, "doc_id long, start long, text string"), "candidates")


def stretches(source: DataFrame, items: Items) -> DataFrame:
    """STRETCH rows of all texts of source (doc_id, start, text): runs of words around hits, with the n-grams hit and where.

    start is the number of words before source's text in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, quick = items.numbers.get, np.zeros(1 << 20, bool)
        quick[items.known & (len(quick) - 1)] = True
        for batch in batches:
            out = []
            for i, start, t in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.fromiter(map(get, tokens(t), repeat(-1)), np.int64)
                at, own = [], []
                for size in items.sizes:
                    g = grams(words, size)
                    some = np.flatnonzero((g >= 0) & quick[g & (len(quick) - 1)])
                    some = some[items.known[np.minimum(np.searchsorted(items.known, g[some]), len(items.known) - 1)] == g[some]]
                    at.append(some)
                    own.append(g[some])
                at, own = np.concatenate(at or [[]]), np.concatenate(own or [[]])
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, own = at[order].astype(np.int64), own[order].astype(np.int64)
                for a, b, low, high in runs(at, items.margin):
                    out.append((i, start + low, words[low:high].tolist(), own[a:b].tolist(), (at[a:b] - low).tolist()))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in STRETCH.split(", ")])

    return cut(source.mapInArrow(run, STRETCH), "stretches")


class Aligner:
    """Alignments of a block's items, each once for equal spans, as hot passages bring the same span again and again."""

    def __init__(self, items: Items, score: float) -> None:
        self.items, self.score = items, score
        self.own = [np.unique(w, return_counts=True) for w in items.words]
        self.known = lru_cache(CACHED)(self.aligned)

    def aligned(self, k: int, span: bytes) -> tuple[float, int, int]:
        return align(self.items.words[k], np.frombuffer(span, np.int64))

    def __call__(self, k: int, span: np.ndarray) -> tuple[float, int, int] | None:
        """(score, first and last place in span) of item k, or None below the score.

        An alignment matches no more words than item and span have in common, so where those are too few it is not made.
        """
        words, times = self.own[k]
        at = np.minimum(np.searchsorted(words, span), len(words) - 1)
        same = words[at] == span
        if np.minimum(np.bincount(at[same], minlength=len(words)), times).sum() / len(self.items.words[k]) < self.score:
            return None
        where = np.flatnonzero(same)
        low, high = int(where[0]), int(where[-1]) + 1
        points, first, last = self.known(k, np.where(same, span, -1)[low:high].tobytes())
        points /= len(self.items.words[k])
        return (points, low + first, low + last) if points >= self.score else None


def contaminated(docs: DataFrame, benchmark: DataFrame, *, score: float = SCORE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """RESULT: a row for each text and item whose best alignment reaches score."""
    spark = docs.sparkSession
    own = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    total = own.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (6 * BLOCK_WORDS)))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.col(text).alias("text"))
    if blocks > 1:
        source = candidates(source, own)
    parts = None
    for b in range(blocks):
        items = Items([tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()])
        if not len(items.known):
            continue
        found = stretches(source, items)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            aligner = Aligner(items, score)
            for batch in batches:
                out = []
                for i, start, words, g, at in zip(*(c.to_pylist() for c in batch.columns)):
                    words = np.array(words, np.int64)
                    where: dict[int, list[int]] = {}
                    for x, p in zip(g, at):
                        for k in items.of[x]:
                            where.setdefault(k, []).append(p)
                    for k, places in where.items():
                        reach = len(items.words[k]) * 5 // 4 + SEED
                        spans: list[list[int]] = []  # seeds apart from each other are aligned apart
                        for p in places:
                            if spans and p - reach <= spans[-1][1]:
                                spans[-1][1] = p + reach
                            else:
                                spans.append([max(0, p - reach), p + reach])
                        for low, high in spans:
                            if best := aligner(k, words[low:high]):
                                out.append((i, items.ids[k], best[0], start + low + best[1], start + low + best[2]))
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in RESULT.split(", ")])

        hits = found.repartition(F.col("doc_id"), F.col("start")).mapInArrow(run, RESULT)
        parts = hits if parts is None else parts.unionByName(hits)
    if parts is None:
        return spark.createDataFrame([], RESULT)
    best = F.max(F.struct("score", -F.col("first_word"), "last_word")).alias("b")
    return parts.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.col2")).alias("first_word"), "b.last_word")
