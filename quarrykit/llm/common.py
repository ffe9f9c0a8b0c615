"""What the corpus operators share: tables, word splitting, cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.sources.folders import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java classes of what stands between words: anything but digits, letters and non-ASCII; white space.
NOT_ITEM_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE = r"[\x20\x09-\x0D]+"
#: Rows of a few numbers that are broadcast at most, some 50 MB.
SMALL = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """``df``, of a few narrow columns and cheap to count, to be broadcast if it has SMALL rows at most; else joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= SMALL else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; plain ASCII text takes the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, between: str) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def text_hash(text: Column) -> Column:
    """Tells rows apart that carry the same doc_id."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of documents with (doc_id, text_hash) rows, nulls equal; texts are not shuffled for few keys."""
    keys = small(keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    on = F.col("_d.doc_id").eqNullSafe(F.col("_k._id")) & (text_hash(F.col("_d.text")) == F.col("_k._hash"))
    return docs.alias("_d").join(keys.alias("_k"), on, how)


def first_of_repeats(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with one of the rows of each (doc_id, text_hash) of ``keys``: that whose columns come first as JSON text."""
    one = keep_rows(docs, keys, "left_semi").select(F.struct("*").alias("doc")).groupBy(F.col("doc.doc_id"), text_hash(F.col("doc.text"))).agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return keep_rows(docs, keys, "left_anti").unionByName(one.select("doc.*"))


def pieces(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The whole text in parts of about ``most`` characters, cut at ASCII white space, so that memory stays bounded."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files: columns are packed, a reader takes those it needs."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, name: str, index: str = "index") -> DataFrame:
    """``df`` stored, with a number from 0 without gaps for each row, without a sort and without one task for all rows.

    A row's place within its task is stored with it; one row a task is put in order to know how many rows stand before.
    """
    placed = stored(df.withColumn("_at", F.monotonically_increasing_id()), name)
    task = F.shiftright("_at", 33)
    tasks = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = tasks.select("_task", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(small(starts), task == F.col("_task")).withColumn(index, place).drop("_at", "_task", "_before")
