"""From raw documents to packed training sequences: five stages, each written and read again as the next one's input.

Every stage works on all rows of its predecessor. Defined results, for all stages: rows are documents, also where an id
is null or comes again with another text; a null text counts as empty; texts of any length are used whole; an empty
table gives an empty table; columns beside those of documents are dropped at the first stage, also where their names
clash with the operators' own. What a stage does with ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickfold.llm import hyperdimensional, packing
from tickfold.llm.decontamination import contaminated
from tickfold.llm.lsh_forest import one_of_each
from tickfold.llm.quality_rules import quality_rules
from tickfold.llm.queries import tokenizer_path
from tickfold.llm.shared import bit_split, cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The least cosine with a learned language's prototype; unlike texts are meant to be below. The README gives how many
#: documents it drops.
LEAST_LIKENESS = 0.15


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the risk-controlled rules; null, empty and short texts don't. Equal rows fare alike; a null
    language is a stratum of its own. Labels are joined by id, so rows with one id count with the same label."""
    return quality_rules(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: with letters, and with some likeness to a learned language.

    Learned from the labelled documents that stage kept, without the held-out fifth. Ties go to the first language in
    order of name; equal rows fare alike; where no document has a language, none can be told and none is kept."""
    docs = docs.select(*COLUMNS)
    told = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LIKENESS)
    return hyperdimensional.identify(docs, docs, carry=COLUMNS).where(told).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity of 0.8 or more).

    Of equal rows (id and text) one is kept. Unlike texts under one id, or under none, are documents of their own; ties
    within a group go by a hash of the row; texts without words are linked with nothing."""
    return one_of_each(docs.select(*COLUMNS))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows are told by a hash of id and text, so a clean text stays where
    another one under its id, or under none, goes; equal rows fare alike."""
    keyed = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", "text"))
    found = contaminated(keyed, table(spark, sf_dir, "benchmark"), doc_id="_row")
    found = cut(found.select(F.col("doc_id").alias("_row")).distinct(), "contaminated")
    some, others = bit_split(keyed, "_row", found)
    return others.unionByName(some.join(found, "_row", "left_anti").select(keyed.columns)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with their sequence and offset; equal rows are packed each."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("language_id", language), ("near_dedup", near), ("decontamination", clean_of_benchmark), ("packing", packed)]
#: The stages hash, align and pack; SQL cannot express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
