"""A corpus pipeline of five stages over documents; each calls one operator of ``kpiweave.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiweave.llm import decontaminate, languages, near_copies, pieces, secrets
from kpiweave.llm.common import bounded_batches, table, written

#: Bytes of an Arrow batch: stages share executors, whose workers keep the memory of the stages before.
STAGE_BATCH_BYTES = 4 << 20


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones too) and texts that speak against every learned language go."""
    bounded_batches(spark, STAGE_BATCH_BYTES)
    found = languages.identify(docs, docs, result="__language")
    return found.where("__language.known").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by alike sets of 5-word shingles (80 percent) the one with the least id stays."""
    bounded_batches(spark, STAGE_BATCH_BYTES)
    return near_copies.one_of_each(docs, length=5, least=80).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds; ``n_chars`` follows. No row goes."""
    bounded_batches(spark, STAGE_BATCH_BYTES)
    found = secrets.mask_secrets(docs, changed="__changed")
    changed = F.when(F.col("__changed"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and whether they decode to the text."""
    bounded_batches(spark, STAGE_BATCH_BYTES)
    found = pieces.encode_checked(docs, public_tokenizers.path("piece_bpe_32k.model"), same="round_trip")
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("languages", keep_known_languages),
    ("near copies", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]
#: SQL cannot parse by automata or encode pieces; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
