"""The registered queries over the whole smallest tables: columns, row counts, and brute force where SQL has no say."""

import collections
import zlib

import numpy as np
import pytest
from test_operators import brute, check_shards, counts

from tickfold.llm import decontamination, license_scan, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op2": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3": {"doc_id": "bigint", "license": "string", "containment": "double", "first_word": "bigint", "n_words": "bigint"},
    "op4": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op6": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op8": {"doc_id": "bigint", "item_id": "bigint", "score": "double"},
    "op9": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op10": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
}


def run(spark, op):
    return next(f for n, f in queries.queries().items() if n.startswith(f"{op}_"))(spark, SF)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("op", COLUMNS)
def test_columns(spark, op):
    kinds = dict(run(spark, op).dtypes)
    assert COLUMNS[op].items() <= kinds.items()


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_quality_query(spark, texts):
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in run(spark, "op1").collect()} == {i: counts(t) for i, t in texts}


def test_license_query(spark, texts):
    """Templates by containment in the stretch given, and none that any stretch of twice the template's size holds is lost."""
    plain = lambda t: [w for x in (t or "").lower().split() if (w := x.strip(license_scan.EDGE))]
    got, expected = {(r.doc_id, r.license): r for r in run(spark, "op3").collect()}, set()
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    for i, t in texts:
        w = plain(t)
        for name, template in license_scan.TEMPLATES.items():
            x = plain(template)
            q = min(5, len(x))
            own, all_ = set(grams(x, q)), grams(w, q)
            if any(len(own & set(all_[k : k + 2 * len(own)])) >= 0.8 * len(own) for k, g in enumerate(all_) if g in own):
                expected.add((i, name))
            if r := got.get((i, name)):
                part = set(grams(w[r.first_word : r.first_word + r.n_words], q))
                assert r.containment == len(own & part) / len(own) >= 0.8
    assert expected and expected <= set(got)


def test_shard_query(spark, texts):
    rows = run(spark, "op4").collect()
    sizes = check_shards(rows, texts, 24)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_decontamination_query(spark, texts):
    """Texts that hold a whole item are found; what is found shares a seed with its item."""
    items = {r.item_id: decontamination.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    got, whole, seeded = {(r.doc_id, r.item_id) for r in run(spark, "op8").collect()}, set(), set()
    for i, t in texts:
        w = decontamination.tokens(t)
        own, spaced = {n: grams(w, n) for n in range(1, 6)}, f" {' '.join(w)} "
        for k, x in items.items():
            n = decontamination.seed(len(x))
            if own[n] & grams(x, n):
                seeded.add((i, k))
            if f" {' '.join(x)} " in spaced:
                whole.add((i, k))
    assert whole and whole <= got <= seeded


def test_packing_query(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    parts, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in run(spark, "op9").collect():
        parts[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, x in texts:
        ids, at = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in seqs.values():
        ends = [0]
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == ends[-1]
            ends.append(r.offset + r.length)
        assert ends[-1] <= 4096


def test_near_duplicate_query(spark, texts):
    sets, root = brute(texts, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run(spark, "op10").collect()} == {i: (len(sets[i][0]), root[i], root[i] == i) for i, _ in texts}
