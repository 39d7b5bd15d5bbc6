"""Chat formatting as prefix trees: conversations that share first turns share their tokens.

A turn is written ``<turn ROLE>TEXT</turn>`` and a line end; in roles and texts ``\\``, ``<`` and ``>`` get a ``\\``
before them, so no text can hold a mark and unescaping gives it back. ``trees`` sorts the conversations by the digests
of their turns, which is depth-first order of the tree of all conversations, deals them by ranges of that order and
walks each range once: a turn that equals the one before it on the same path is not emitted again. A row is a tree: its
token ids depth-first, and for every node its tokens' place, the position id of its first token (positions go on from
its parent's), the span of tokens under the loss mask (an assistant's text) and the intervals of tokens that its tokens
may attend to besides their own earlier ones: those of its ancestors. When a tree has ``most`` tokens a new one starts
and repeats the open path, so a first turn that a third of all conversations share is neither one row nor one task.
``positions`` and ``conversations`` read a tree back.

Defined results: null texts and roles are empty; rows of a conversation go by turn (nulls first), then role and text,
and equal rows count each; a null conv_id is an id like any other; an empty table gives an empty table; other columns
are not used. One conversation is one row, as its format is; conversations are not split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.shared import slices

MARKS = re.compile(r"([\\<>])")
MARKED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>((?:[^\\<>]++|\\.)*+)</turn>\n", re.S)
#: How byte-level tokenizers cut texts before they merge (a published pattern, for the characters of AGREED): letters and
#: numbers up to U+024F are spelt out.
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PRE = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]++| ?[{_N}]++| ?[^\s{_L}{_N}]++|\s+(?!\S)|\s+")
AGREED = re.compile(r"[\t\n\r -~\u00a0-\u024f]*+")
NODE = "struct<start:int,end:int,position:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>"
TREE = f"ids array<int>, nodes array<{NODE}>, leaves array<struct<conv_id:bigint,node:int>>"
_tokenizers: dict[str, object] = {}


def escape(text: str) -> str:
    return MARKS.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return MARKED.sub(r"\1", text)


def tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


class Encoder:
    """Ids of texts by a byte-level tokenizer, which cuts texts into parts before it merges; parts come again, so their ids
    are remembered, ``most`` of them at a time. Where that isn't how the tokenizer cuts, whole texts go through it."""

    def __init__(self, path: str, most: int = 200_000) -> None:
        self.tokenizer, self.most, self.known = tokenizer(path), most, {}
        sample = ["It's  a \n\n test,\tisn't it?? 12 apples' caf\u00e9 \u00a0 x\u00d7y  ", " <turn user> a</turn>\n", "<|endoftext|> we'LL've 3rd\r\n  "]
        self.cuts = True
        self.cuts = [x.tobytes() for x in self(sample)] == [x.tobytes() for x in self.whole(sample)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parts = [PRE.findall(t) if self.cuts and AGREED.fullmatch(t) else None for t in texts]
        new = set().union(*(p for p in parts if p is not None)).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, set().union(*(p for p in parts if p is not None))
        new = list(new)
        self.known.update(zip(new, (x.tobytes() for x in self.whole(new))))
        get = self.known.__getitem__
        rest = iter(self.whole([t for t, p in zip(texts, parts) if p is None]))
        return [next(rest) if p is None else np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]


_encoders: dict[str, Encoder] = {}


@lru_cache
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens of a byte-level tokenizer in a row, and where each token's start (and the last one's end)."""
    tok = tokenizer(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such vocabularies
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    tokens = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
    own = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
    return np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in own])))


def spelt(ids: np.ndarray, path: str) -> tuple[bytes, np.ndarray]:
    """The bytes of tokens in a row, and where each token's start (and the last one's end)."""
    table, starts = byte_table(path)
    lengths = starts[ids + 1] - starts[ids]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return table[np.repeat(starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes(), ends


class Tree:
    """A tree as it is written: its tokens, and flat columns of its nodes."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.nodes: list[tuple[int, int, int, int, int]] = []
        self.attends: list[tuple[tuple[int, int], ...]] = []
        self.leaves: list[tuple[int | None, int]] = []


def packed(trees: list[Tree]) -> pa.RecordBatch:
    def lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)

    def column(rows: list[tuple], k: int, kind: pa.DataType) -> pa.Array:
        return pa.array([r[k] for r in rows], kind)

    nodes = [n for t in trees for n in t.nodes]
    attends = [a for t in trees for a in t.attends]
    spans = [x for a in attends for x in a]
    span = pa.StructArray.from_arrays([column(spans, k, pa.int32()) for k in (0, 1)], ["start", "end"])
    node = pa.StructArray.from_arrays([*(column(nodes, k, pa.int32()) for k in range(5)), lists([len(a) for a in attends], span)], ["start", "end", "position", "loss_start", "loss_end", "attends"])
    leaves = [x for t in trees for x in t.leaves]
    leaf = pa.StructArray.from_arrays([column(leaves, 0, pa.int64()), column(leaves, 1, pa.int32())], ["conv_id", "node"])
    ids = np.concatenate([x for t in trees for x in t.ids] or [np.empty(0, np.int32)])
    columns = [lists([t.size for t in trees], pa.array(ids, pa.int32())), lists([len(t.nodes) for t in trees], node), lists([len(t.leaves) for t in trees], leaf)]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "nodes", "leaves"])


def trees(turns: DataFrame, path: str, *, most: int = 32_768) -> DataFrame:
    """TREE rows of all conversations; path is of a byte-level tokenizer, whose ids can be decoded exactly."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    keyed = whole.select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: x["text"]).alias("texts"), F.transform("t", lambda x: F.xxhash64(x["role"], x["text"])).alias("key"))
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode, marks = _encoders[path], {}
        tail = encode(["</turn>\n"])[0]
        now, done = Tree(), []
        stack: list[tuple] = []  # of the open path: role, text, node, end of the node, its position's end, what its child attends to

        def flush() -> None:
            nonlocal now
            if now.leaves:
                done.append(now)
            stack.clear()
            now = Tree()

        for batch in slices(batches):
            conversations = list(zip(*(c.to_pylist() for c in batch.columns)))
            fresh = list({t for _, _, texts in conversations for t in texts})
            bodies = dict(zip(fresh, encode([escape(t) for t in fresh])))  # a text once, however many say it
            for role in {r for _, roles, _ in conversations for r in roles} - marks.keys():
                if len(marks) >= 10_000:
                    marks.clear()
                marks[role] = encode([f"<turn {escape(role)}>"])[0]
            for conv_id, roles, texts in conversations:
                same = 0
                while same < min(len(stack), len(roles)) and stack[same][0] == roles[same] and stack[same][1] == texts[same]:
                    same += 1
                if not same or now.size >= most:
                    flush()
                    same = 0
                del stack[same:]
                for r, t in zip(roles[same:], texts[same:]):
                    head = marks[r] if r in marks else encode([f"<turn {escape(r)}>"])[0]
                    body, start = bodies[t], now.size
                    position, attends = stack[-1][3:] if stack else (0, ())
                    first = start + len(head)
                    end = first + len(body) + len(tail)
                    now.ids += (head, body, tail)
                    now.size = end
                    now.nodes.append((start, end, position, first, first + len(body) if r == "assistant" else first))
                    now.attends.append(attends)
                    below = (*attends[:-1], (attends[-1][0], end)) if attends and attends[-1][1] == start else (*attends, (start, end))
                    stack.append((r, t, len(now.nodes) - 1, position + end - start, below))
                now.leaves.append((conv_id, stack[-1][2]))
            if done:
                yield packed(done)
                done.clear()
        flush()
        if done:
            yield packed(done)

    return ordered.mapInArrow(run, TREE)


def positions(trees: DataFrame) -> DataFrame:
    """trees with position_ids, one for each token."""
    return trees.withColumn("position_ids", F.flatten(F.transform("nodes", lambda n: F.sequence(n["position"], n["position"] + n["end"] - n["start"] - 1))))


def read_back(trees: DataFrame, path: str) -> DataFrame:
    """conv_id, formatted, roles, texts and loss (the unescaped text under the mask) of each conversation, from tokens alone.

    A node that many conversations share is spelt and taken apart once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("loss", pa.string())])
        for batch in slices(batches, 64):
            for row in range(batch.num_rows):
                raw, ends = spelt(batch.column(0)[row].values.to_numpy(), path)
                nodes = batch.column(1)[row].values
                start, end, low, high = (nodes.field(k).to_numpy() for k in ("start", "end", "loss_start", "loss_end"))
                attends = nodes.field("attends").to_pylist()
                at, parts = {}, []
                for i, (a, b, x, y) in enumerate(zip(ends[start].tolist(), ends[end].tolist(), ends[low].tolist(), ends[high].tolist())):
                    formatted = raw[a:b].decode()
                    ((role, text),) = TURN.findall(formatted)
                    at[int(start[i])] = i
                    parts.append((formatted, unescape(role), unescape(text), unescape(raw[x:y].decode())))
                out: list[tuple] = []
                for leaf in batch.column(2)[row].as_py():
                    last, steps = leaf["node"], []
                    for span in attends[last]:
                        s = span["start"]
                        while s < span["end"]:
                            steps.append(parts[at[s]])
                            s = int(end[at[s]])
                    steps.append(parts[last])
                    out.append((leaf["conv_id"], "".join(p[0] for p in steps), [p[1] for p in steps], [p[2] for p in steps], "".join(p[3] for p in steps)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)

    return trees.select("ids", "nodes", "leaves").mapInArrow(run, "conv_id long, formatted string, roles array<string>, texts array<string>, loss string")
