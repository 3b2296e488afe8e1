"""A corpus made ready for training, stage by stage.

Each stage takes what its predecessor wrote, works on all of it, and applies one operator:

1. ``quality_rules`` drops the documents that the rules reject, and takes the frequent lines out of the others;
   ``n_chars`` follows.
2. ``exact_dedup`` keeps one row of equal texts, that of the largest doc_id.
3. ``simhash`` keeps one document of each near-duplicate group, that of the smallest doc_id.
4. ``mixing`` brings the sources to their target weights: a document becomes a row per whole copy
   that the mix takes of it, and one row with the words of the blocks taken once more.
5. ``sentencepiece`` encodes and decodes what the mix holds.

The mix is chosen by seeded hashes and tokens come from a vocabulary file, which SQL cannot express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, mixing, quality_rules, sentencepiece_bpe, simhash
from tablewright.llm.common import stored
from tablewright.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """NULL, empty and short texts go; lines are frequent by their host, NULL being one."""
    return quality_rules.clean(docs, length="n_chars")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """NULL and empty texts are equal; of equal ids one row stays; very long texts are compared whole."""
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group the smallest id stays, one row of it where it is repeated; texts without words form a group."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """NULL sources are one source; texts without words have nothing to give and go."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, max_epochs=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and the ids themselves."""
    encoded = sentencepiece_bpe.encode_and_decode(docs, tokenizer_path())
    return sentencepiece_bpe.digests(encoded, F.col("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", drop_rejected),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
