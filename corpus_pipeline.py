"""documents, filtered, cleaned of common lines, de-duplicated, mixed and packed.

Each stage takes all that its predecessor kept; all but the last return the
columns of ``documents``, with ``n_chars`` as the text then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from linkgraph.llm.common import Scratch
from linkgraph.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates share this much of their shingles of so many words; ``op7`` has its own, tighter rule.
NEAR_PERCENT, NEAR_SHINGLE = 80, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in many documents go from all but one."""
    cleaned = line_dedup.clean_lines(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays."""
    return jaccard_join.one_of_each(docs, percent=NEAR_PERCENT, size=NEAR_SHINGLE).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix of sources takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; the copies of a document are packed each."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]
#: SQL has neither the joins' components nor the rounding's coins nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the whole corpus of ``sf_dir``; every stage is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
