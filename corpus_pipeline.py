"""The corpus pipeline: documents through five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import decontaminate, language, mixing, near_copies, sharding
from quarrykit.llm.common import cut, first_of_repeats, keep_rows, shared_folder, small, table, text_hash

#: A text of which fewer of the n-grams are known in its language than this is in none of the learned ones.
LEAST_COVERAGE = 0.25


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the documents; those without letters and those in no known one go."""
    said = language.identify(docs.select(F.struct("*").alias("_doc"), "text"), language.trained(docs))
    return said.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("coverage") >= LEAST_COVERAGE)).select("_doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component of near copies (five-word Jaccard 0.8); of repeated rows one."""
    found = near_copies.near_copies(docs)
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    stay = cut(found.filter(first).groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")))
    kept, repeated = keep_rows(docs, stay, "left_semi"), stay.filter("rows > 1")
    return kept if repeated.isEmpty() else first_of_repeats(kept, repeated)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    hit = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("doc_id", "text_hash")
    return keep_rows(docs, cut(hit.distinct()), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; repeated rows together as often as it takes them."""
    plan = cut(mixing.mix(docs).groupBy("doc_id", "text_hash").agg(F.sum("repeats").cast("int").alias("times"), F.count("*").alias("rows")))
    repeated = plan.filter("rows > 1")
    docs = docs if repeated.isEmpty() else first_of_repeats(docs, repeated)
    same = F.col("doc.doc_id").eqNullSafe(F.col("id")) & (text_hash(F.col("doc.text")) == F.col("hash"))
    taken = docs.select(F.struct("*").alias("doc")).join(small(plan.filter("times > 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "times")), same)
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document."""
    return sharding.shard(docs)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: None: learned, fitted and iterated stages have no SQL form; tests compare each with brute force.
ORACLE_SQL = None
