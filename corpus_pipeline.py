"""From raw documents to a training mixture, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
before the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import decontaminate, mixing, pii, quality_rules, simhash
from sigloom.llm.store import Kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule table rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule convicts go."""
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts."""
    return pii.sanitise(docs, everywhere=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The source mixture: each document once for each pass that takes it."""
    return mixing.realise(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("mixture", mixture),
]

#: SimHash needs XXH64 and components, which DuckDB's SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and
    read back, so that a lost executor never costs more than one stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, kept = kept, Kept(out, name.replace(" ", "-"))
        docs = kept.df
        if before is not None:
            before.drop()
    raise ValueError("STAGES is empty")
