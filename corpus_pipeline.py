"""The corpus pipeline: documents in, token digests of a clean, deduplicated mix out.

Each stage takes the session, the documents that its predecessor kept and the
data folder, and its result is written and read again before the next. In all
stages a null text counts as empty, every repeated row is a document of its
own, an empty table gives an empty one, and extra columns pass under their own
names, whatever these are, but for those that a stage's docstring names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, mixing, ngram_join, secret_scans, toxicity
from marlstone.sources import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones does not hold to be toxic. Columns ``score`` and ``predicted`` don't pass."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=docs.columns).where("predicted = 0").drop("score", "predicted")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id. All without words stay."""
    return ngram_join.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; n_chars follows the text, and a null text stays null. A column ``secrets`` doesn't pass."""
    redacted = secret_scans.redact(secret_scans.scan(docs))
    changed = F.size("secrets") > 0
    return redacted.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("secrets")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document, whole, as often as it is drawn, shuffled within shards; those without words are never drawn.

    Columns ``size``, ``source_size``, ``target``, ``taken``, ``draws``, ``draw``, ``shard``, ``shards`` and ``shard_key`` don't pass.
    """
    return mixing.written_out(mixing.mix(docs)).drop("shard")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, and numbers and digests of each drawn document's tokens and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Toxicity is a trained model and the tokens follow a merge list, so SQL has no form of the whole;
#: tests/llm compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the documents of ``sf_dir``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
