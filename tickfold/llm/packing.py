"""Packing token pieces into sequences: first-fit decreasing over a tournament tree, in randomised groups.

``tokenise`` cuts each document's ids into pieces of at most ``length`` tokens and gives each piece a random deal.
``place`` packs groups of about ``group_pieces`` dealt pieces independently: pieces fall by length, and a tournament
tree whose inner nodes hold the largest free room below them finds the first sequence that fits in log time. A group
wastes about one sequence, so padding stays small while no task ever holds more than a group. ``sequences`` joins the
pieces of each sequence. Groups are dealt by piece, not by id or source, so no key is hot.

Defined results: a null text is an empty one and has only the end id; a null id is kept; equal rows are documents of
their own; an empty table gives an empty table; columns named in ``carry`` go along.
"""

from __future__ import annotations

import os
import random
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickfold.llm.shared import cut

LENGTH = 4096
#: The array type of 32-bit words.
WORD = "I" if array("I").itemsize == 4 else "L"


#: Letters whose lower case and normal form are one letter each, and marks that no pattern of a tokenizer takes into a word.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)")


class _Known(dict):
    """What find gives for a key, remembered for at most so many keys."""

    def __init__(self, find: Callable[[str], bytes], most: int) -> None:
        self.find, self.most = find, most

    def __missing__(self, key: str) -> bytes:
        ids = self.find(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = ids
        return ids


class Tokens:
    """Ids of texts as little-endian 32-bit words, by any tokenizer; quickly by one that drops white space and lowers case.

    For such a tokenizer the ids of a text are those of its blank-separated parts in a row, and parts repeat, so their ids
    are remembered, ``most`` of them at a time; memory is bounded by that and the largest text. Of a part of plain letters
    and marks the letters' ids come straight from the tokenizer's model; what is plain is checked against the whole
    tokenizer first (``agrees``). Other parts go through all of it. A tokenizer that does not take blank-separated parts one
    by one (``cuts``) gets whole texts.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.words, self.marks = _Known(self.spelt, most), _Known(lambda m: self.whole([m])[0], most)
        byte = [*range(33, 127), *range(161, 173), *range(174, 256)]  # how byte-level models write bytes
        self.byte = {b: chr(b) for b in byte} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in byte)}
        sample = ["Two  words, 3 of\nthem: it's \u00e9t\u00e9\n\n x", " a b  c ", "\n", "one", "\u65e5\u672c \u8a9e. \U0001f600 z"]
        self.cuts = [b"".join(self.whole([w for w in re.split("[ \n]", t) if w])) for t in sample] == self.whole(sample)
        self.fast = self.cuts and self.agrees()
        self.known = _Known(self.part, most) if self.fast else {"": b""}

    def agrees(self) -> bool:
        """Whether the shortcut gives what the tokenizer gives, on every plain letter, in and between words, and mark."""
        letters = [chr(c) for c in range(256) if (m := PLAIN.fullmatch(chr(c))) and m[1]]
        parts = [x + y for x in letters for y in ("", "ing", "A", "\u00e9t")] + ["th" + x + m for x in letters for m in (".", ",%%%", "!!")]
        return all(self.plain(p) == self.whole([p])[0] for p in parts)

    def whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def spelt(self, word: str) -> bytes:
        """Ids of plain letters in lower case, from the model."""
        if not word:
            return b""
        spelt = word if word.isascii() else "".join(map(self.byte.__getitem__, word.encode()))
        return array(WORD, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def plain(self, part: str) -> bytes | None:
        if part.isascii() and part.isalpha():  # most parts, for which matching would cost as much as all the rest
            return self.words[part.lower()]
        m = PLAIN.fullmatch(part)
        if not m:
            return None
        word, marks = m[1].lower(), m[2]
        return self.words[word] + self.marks[marks] if marks else self.words[word]

    def part(self, part: str) -> bytes:
        return ids if (ids := self.plain(part)) is not None else self.whole([part])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.whole(texts)
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        if not self.fast:
            new = {w for p in parts for w in p}.difference(self.known)
            if len(self.known) + len(new) > self.most:
                self.known = {"": b""}
                new = {w for p in parts for w in p}.difference(self.known)
            rest = list(new)
            self.known.update(zip(rest, self.whole(rest)))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]


_tokens: dict[str, Tokens] = {}


def chunks(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tokenise(docs: DataFrame, path: str, *, length: int = LENGTH, end: int = 2, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, start, length, ids (binary), doc_tokens and deal of each piece; written once, so that deals stay as they are."""
    kinds = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([kinds[c] for c in carry] + [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("deal", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        dice, last = random.Random(TaskContext.get().partitionId()), int(end).to_bytes(4, "little")
        for batch in batches:
            texts = [t or "" for t in batch.column(len(carry)).to_pylist()]
            for a, b in chunks(texts):
                at, start, size, ids, whole = [], [], [], [], []
                for i, x in enumerate(_tokens[path].encode(texts[a:b]), a):
                    x += last
                    for s in range(0, len(x), 4 * length):
                        at.append(i)
                        start.append(s // 4)
                        ids.append(piece := x[s : s + 4 * length])
                        size.append(len(piece) // 4)
                        whole.append(len(x) // 4)
                rows = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).take(rows) for k in range(len(carry))] + [pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(whole, pa.int64()), pa.array([dice.getrandbits(48) for _ in at], pa.int64())],
                    names=[f.name for f in schema.fields],
                )

    return cut(docs.select(*carry, text).mapInArrow(run, schema), "pieces")


def first_fit(lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, which must fall: the first bin with room for it, found from the tree's root."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    tree, out = [room] * (2 * leaves), []
    for x in lengths:
        i = 1
        while i < leaves:
            i *= 2
            if tree[i] < x:
                i += 1
        out.append((i - leaves, room - tree[i]))
        tree[i] -= x
        while i > 1:
            i //= 2
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
    return out


def place(pieces: DataFrame, *, length: int = LENGTH, group_pieces: int = 5000) -> DataFrame:
    """pieces with sequence_id and offset; any columns beside length and deal go along."""
    groups = max(1, -(-pieces.count() // group_pieces))
    names = [c for c in pieces.columns if c != "deal"]
    schema = T.StructType([f for f in pieces.schema.fields if f.name != "deal"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["deal"].to_numpy(), -rows["length"].to_numpy()))
        rows = rows.take(pa.array(order))
        bins = first_fit(rows["length"].to_pylist(), length)
        out = [rows[c] for c in names] + [pa.array([(key[0].as_py() << 32) | b for b, _ in bins], pa.int64()), pa.array([o for _, o in bins], pa.int64())]
        return pa.table(out, names=[f.name for f in schema.fields])

    return pieces.withColumn("_group", F.pmod("deal", F.lit(groups))).groupBy("_group").applyInArrow(lambda key, rows: pack(key, rows), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, pieces in order of offset), ends (where each piece ends); a sequence is bounded by its length."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return parts.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"), F.transform("p", lambda x: x["offset"] + x["length"]).alias("ends"))


def pack(docs: DataFrame, path: str, *, length: int = LENGTH, end: int = 2, group_pieces: int = 5000, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pieces of docs, with their ids, placed in sequences."""
    return place(tokenise(docs, path, length=length, end=end, carry=carry), length=length, group_pieces=group_pieces)
