"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, rotated by their place
(product by component), a text's or a language's vector is the bundle (sum) of its trigrams' vectors, and a text gets
the language whose prototype has the largest cosine with it. Words are padded with a blank that has a vector too;
trigrams across words don't count.

``learn`` bundles every labelled text in one pass; a task sends one vector for each language. ``predict`` is a pass
without a shuffle. Letters of all scripts count: a to z have vectors of their own, others share hashed ones.

Defined results: a null text or one without letters is 'und' with score 0; a text that no prototype resembles gets the
nearest one with its cosine, not below 0; without anything to learn from all texts are 'und'; ties go to the first
language in order of name; other columns are kept, those named lang_pred and score replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickfold.llm.packing import chunks

LETTERS, DIMENSIONS, SEED = 128, 512, 20240607


class Space:
    """The letters' vectors, and the counted trigrams of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))
        first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
        self.pairs = (first[:, None, :] * second[None, :, :]).reshape(LETTERS * LETTERS, dimensions)
        self.letters = letters
        self.of = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = ord(x.lower()[0])
                self.of[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 % 2**32) % (LETTERS - 27)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(codes, counts)"""
        s = self.of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        s = np.concatenate(([0], s, [0])).astype(np.uint32)
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]  # runs of other characters are one blank
        codes = (s[:-2] << 14 | s[1:-1] << 7 | s[2:])[s[1:-1] != 0] if len(s) > 2 else s[:0]
        codes.sort()
        at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else codes
        return codes[at], np.diff(np.append(at, len(codes)))

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.letters.shape[1], np.float64)
        for i in range(0, len(codes), 4096):
            c = codes[i : i + 4096]
            out += counts[i : i + 4096].astype(np.float32) @ (self.pairs[c >> 7] * self.letters[c & 127]).astype(np.float32)
        return out


_spaces: dict[tuple[int, int], Space] = {}


def space(dimensions: int, seed: int) -> Space:
    if (dimensions, seed) not in _spaces:
        _spaces[dimensions, seed] = Space(dimensions, seed)
    return _spaces[dimensions, seed]


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, list[float]]:
    """Language -> prototype from all rows with both; what comes to the driver is one vector for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = space(dimensions, seed), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                by: dict[str, list[str]] = {}
                for t, x in zip(texts[a:b], langs[a:b]):
                    by.setdefault(x, []).append(t)
                for x, own in by.items():
                    sums[x] = sums.get(x, 0) + at.bundle(*at.trigrams("\n".join(own)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    partial = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang).mapInArrow(run, "lang string, vector array<double>")
    summed = partial.select("lang", F.posexplode("vector").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, list[float]] = {}
    for r in sorted(summed.collect(), key=lambda r: (r["lang"], r["i"])):
        out.setdefault(r["lang"], []).append(r["v"])
    return out


def predict(docs: DataFrame, prototypes: dict[str, list[float]], *, text: str = "text", carry: tuple[str, ...] | None = None, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """carry (all columns of docs) with lang_pred and score, the cosine cut to 0 to 1."""
    names = sorted(k for k, v in prototypes.items() if any(v))
    table = np.array([np.array(prototypes[k]) / np.linalg.norm(prototypes[k]) for k in names]).reshape(len(names), dimensions)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score") and (carry is None or f.name in carry)]
    names_in = [f.name for f in kept] + [text] * (text not in [f.name for f in kept])
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = space(dimensions, seed)
        for batch in batches:
            texts, langs, scores = batch.column(names_in.index(text)).to_pylist(), [], []
            for t in texts:
                codes, counts = at.trigrams(t or "")
                norm = np.linalg.norm(v := at.bundle(codes, counts)) if len(codes) and names else 0
                cosines = table @ v / norm if norm else []
                best = int(np.argmax(cosines)) if norm else -1
                langs.append(names[best] if norm else "und")
                scores.append(min(1.0, max(0.0, float(cosines[best]))) if norm else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema.fields])

    return docs.select(*names_in).mapInArrow(run, schema)


def held_out(key: str = "doc_id", folds: int = 5):
    """A fifth of the ids by checksum; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, labelled: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """carry with lang_pred, score and held_out; learned from the rows of labelled that aren't held out."""
    return predict(docs, learn(labelled.where(~held_out())), carry=carry).withColumn("held_out", held_out())
