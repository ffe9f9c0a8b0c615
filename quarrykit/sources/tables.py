"""Reading files as tables or texts, by kind; writing them. Everything through Spark's readers, so any store will do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.functions.hygiene import clean_cell, clean_header

#: Kind by extension.
KINDS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "txt": "text", "md": "text", "parquet": "parquet", "orc": "orc"}


def kind_of(path: str) -> str:
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending not in KINDS:
        raise ValueError(f"no reader for .{ending}; known: {', '.join(sorted(KINDS))}")
    return KINDS[ending]


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind) of files by their first bytes."""
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "25504446", "pdf").when(head == "504B0304", "zip").when(head == "D0CF11E0", "ole2").when(head == "50415231", "parquet").when(F.substring(F.trim(F.col("content").cast("string")), 1, 1).isin("{", "["), "json").otherwise("text")
    return spark.read.format("binaryFile").load(path).select("path", kind.alias("kind"))


def document_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def typed(df: DataFrame) -> DataFrame:
    """Cells cleaned; columns of which over half of all rows parse become numbers, else times. One pass to decide."""
    df = df.toDF(*clean_header(df.columns)).select("*")
    df = df.select(*[clean_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    aggs = [x for i, c in enumerate(df.columns) for x in (F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(f"n{i}"), F.count(F.try_to_timestamp(F.col(f"`{c}`"))).alias(f"t{i}"), F.count(F.col(f"`{c}`")).alias(f"c{i}"))]
    r = df.agg(F.count("*").alias("rows"), *aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        if r["rows"] and not r[f"c{i}"]:
            continue  # an empty column
        q = F.col(f"`{c}`")
        numeric, dated = 2 * r[f"n{i}"] > r["rows"], 2 * r[f"t{i}"] > r["rows"]
        out.append((F.expr(f"try_cast(`{c}` AS DOUBLE)") if numeric else F.try_to_timestamp(q) if dated else q).alias(c))
    return df.dropna("all").select(*out)


def surveyed(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, spans) of text files: how each is decoded, and whether a quoted field of it may span lines.

    A mark at a file's beginning says the encoding; else it is UTF-8 if all lines are, else ISO-8859-1, which any bytes
    are. One pass over lines of bytes, which large files are split for; a line with an odd number of quotes spans.
    """
    at, raw = F.col("_metadata.file_path").alias("path"), F.col("value")
    lines = spark.read.text(path).select(at, F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("line"), raw.alias("value"))
    start = F.min_by(F.hex(F.substring(F.col("value").cast("binary"), 1, 3)), "line").alias("first")
    files = lines.groupBy("path").agg(start, F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.bool_or(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).alias("spans"))
    marked = F.when(F.col("first").startswith("FFFE"), "UTF-16LE").when(F.col("first").startswith("FEFF"), "UTF-16BE")
    # lines of UTF-16 cannot be told apart by bytes, so that such files are read whole
    return files.select("path", F.coalesce(marked, F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1")).alias("encoding"), (F.col("spans") | marked.isNotNull()).alias("spans"))


#: Quotes within a field are doubled, as most writers do.
QUOTES = {"quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> DataFrame:
    """Strings of CSV files, each in its encoding; files whose fields keep to a line are split among tasks. Columns go by name."""
    if encoding:
        return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, encoding=encoding, sep=sep, **QUOTES)
    alike: dict[tuple[str, bool], list[str]] = {}
    for r in surveyed(spark, path).orderBy("path").collect():  # a row a file, as Spark lists them on the driver too
        alike.setdefault((r["encoding"].replace("LE", "").replace("BE", ""), r["spans"]), []).append(r["path"])
    parts = [spark.read.csv(files, header=True, inferSchema=False, multiLine=spans, encoding=of, sep=sep, **QUOTES) for (of, spans), files in sorted(alike.items())]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else spark.read.csv(path, header=True, sep=sep)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file's list of objects as rows, its object of lists as columns, any other object as a text (path, text)."""
    df = spark.read.json(path, multiLine=True)
    heads = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if heads is None or heads["c"] != "{":
        return df
    if all(isinstance(f.dataType, T.ArrayType) for f in df.schema):
        return df.select(F.explode(F.arrays_zip(*[F.col(f"`{c}`") for c in df.columns])).alias("_x")).select(*[F.col("_x")[c].alias(c) for c in df.columns])
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def decoded(raw: Column) -> Column:
    """Bytes that Spark read as text: UTF-8 where they are, else ISO-8859-1; a mark at the beginning is left out."""
    return F.regexp_replace(F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1")), "^\ufeff", "")


def read_table(spark: SparkSession, path: str, kind: str | None = None, encoding: str | None = None, infer: bool = True) -> DataFrame:
    """The rows of files of one kind; without ``encoding`` that of each CSV file is found out."""
    kind = kind or kind_of(path)
    if kind in ("csv", "tsv"):
        df = read_csv(spark, path, "\t" if kind == "tsv" else ",", encoding)
        return typed(df) if infer else df
    if kind == "json":
        return read_json(spark, path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "text":
        return paragraphs(spark, path)
    return spark.read.format(kind).load(path)


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, text): trimmed paragraphs of text files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), decoded(F.col("value")).alias("value"))
    return files.select("path", F.posexplode(F.split("value", r"\n\s*\n")).alias("at", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")


def write_table(df: DataFrame, path: str, kind: str | None = None, by: list[str] | None = None, encoding: str = "UTF-8") -> None:
    """CSV with header, JSON lines, Parquet or ORC; partitioned by columns if asked."""
    kind = kind or kind_of(path)
    writer = df.write.partitionBy(*by) if by else df.write
    if kind in ("csv", "tsv"):
        writer = writer.options(header="true", sep="\t" if kind == "tsv" else ",", encoding=encoding, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **QUOTES)
    writer.format({"jsonl": "json", "tsv": "csv"}.get(kind, kind)).save(path)


def upsert_document(spark: SparkSession, chunks: DataFrame, path: str, key: str = "doc_hash") -> None:
    """Write chunks to a table partitioned by document; only the documents that come are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def delete_document(spark: SparkSession, path: str, value: str, to: str, key: str = "doc_hash") -> None:
    """All rows but those of one document; rows without a key stay."""
    spark.read.parquet(path).filter(~F.col(key).eqNullSafe(value)).write.partitionBy(key).parquet(to)
