"""Reports in rows: long figures of columns, categories, metric catalogues; what is told of hits, documents and chunks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.functions.hygiene import fine_unit
from quarrykit.operators.profile import completeness, numeric_columns, unpivoted

#: What stands around the context of hits.
OPENING = "DATA CONTEXT (DO NOT SUMMARIZE, DO NOT REPEAT VERBATIM):\n-------------------------------------------------------\n"
CLOSING = "\n-------------------------------------------------------"
SEPARATOR = "\n\n---\n\n"


def long_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(name, total, average, least, most, std, records, nulls, populated_pct) of numeric columns in one pass; std is 0 for one record."""
    columns = columns or numeric_columns(df)

    def of(c: str) -> Column:
        v, n = F.col(f"`{c}`").cast("double"), F.count(F.col(f"`{c}`"))
        std = F.when(n == 1, 0.0).otherwise(F.stddev_samp(v))
        return F.struct(F.lit(c).alias("name"), F.sum(v).alias("total"), F.avg(v).alias("average"), F.min(v).alias("least"), F.max(v).alias("most"), std.alias("std"), n.alias("records"), (F.count("*") - n).alias("nulls"), F.when(F.count("*") > 0, F.round(n / F.count("*") * 100, 1)).alias("populated_pct"))

    return df.agg(F.array(*[of(c) for c in columns]).alias("_r")).select(F.inline("_r"))


def categories(df: DataFrame, columns: list[str] | None = None, top: int = 10, most: int = 10) -> DataFrame:
    """(name, distinct, rank, value, count): the most frequent values of the first ``most`` string columns, nulls apart.

    Counts by value combine before the shuffle; the best of 32 parts of a column are ranked first, so that no task sorts
    all values of one.
    """
    columns = (columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])[:most]
    counts = unpivoted(df, columns, "string").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("count"))
    distinct = counts.groupBy("name").agg(F.count("*").alias("distinct"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "value"))
    few = counts.withColumn("_part", F.pmod(F.hash("value"), F.lit(32))).withColumn("rank", rank("name", "_part")).filter(F.col("rank") <= top)
    best = few.withColumn("rank", rank("name")).filter(F.col("rank") <= top)
    return best.join(F.broadcast(distinct), "name").select("name", "distinct", "rank", "value", "count")  # a row a column


def top_missing(df: DataFrame, n: int = 10) -> DataFrame:
    """(name, nulls, missing_pct) of the columns that miss most, those that miss something only."""
    return completeness(df).filter("nulls > 0").orderBy(F.desc("nulls"), "name").limit(n).select("name", "nulls", "missing_pct")


def all_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, name, unit, least, most, average) of the numeric columns of several tables."""
    each = []
    for table, df in tables.items():
        units = {c: fine_unit(c) for c in numeric_columns(df)}
        unit = F.element_at(F.create_map(*[x for c, u in units.items() for x in (F.lit(c), F.lit(u).cast("string"))]), F.col("name")) if units else F.lit(None)
        each.append(long_report(df, list(units)).select(F.lit(table).alias("table_name"), "name", unit.alias("unit"), "least", "most", "average"))
    return reduce(DataFrame.unionByName, each)


def display_name(name: Column) -> Column:
    """A column's name for a reader: flow, measure and underscores left out, words capitalised."""
    return F.initcap(F.trim(F.replace(F.regexp_replace(name, r"^(PROD|SALES|INJ)_|_VOL$", ""), F.lit("_"), F.lit(" "))))


def display_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns named for a reader; of names that fall together the later keep theirs."""
    taken: dict[str, str] = {}
    for c in df.columns:
        shown = re.sub(r"^(PROD|SALES|INJ)_|_VOL$", "", c).replace("_", " ").strip().title()
        taken[c] = shown if shown and shown not in taken.values() else c
    return df.toDF(*[taken[c] for c in df.columns])


def amount(value: Column) -> Column:
    """A number with two decimals and thousands parted."""
    return F.format_number(value, 2)


def structured_context(hits: DataFrame, source: str, key: str, text: str, table: Column, most: int = 8000) -> DataFrame:
    """(context): one row for a short list of hits: each text once, under its source, in the order of sources, cut at ``most`` characters."""
    first = hits.select(F.coalesce(source, F.lit("unknown")).alias("s"), F.col(key).alias("k"), F.col(text).alias("t"), table.alias("is_table")).groupBy("t").agg(F.min(F.struct("s", "k", "is_table")).alias("f"))
    label = F.concat(F.when(F.col("f.is_table"), "### Data from ").otherwise("### Info from "), F.col("f.s"), F.lit(":\n"), F.coalesce("t", F.lit("")))
    told = first.agg(F.array_sort(F.collect_list(F.struct("f.s", "f.k", label.alias("told")))).alias("all")).filter(F.size("all") > 0)
    combined = F.array_join(F.transform("all", lambda x: x["told"]), SEPARATOR)
    return told.select(F.concat(F.lit(OPENING), F.substring(combined, 1, most), F.lit(CLOSING)).alias("context"))


def document_texts(chunks: DataFrame, doc: str, order: str, text: str, kind: str | None = None) -> DataFrame:
    """(doc, chunks, tables, text): the whole text of each document, chunks in order, and how many of them are tables."""
    tables = F.count_if(F.col(kind) == "table") if kind else F.lit(0).cast("long")
    each = chunks.groupBy(doc).agg(F.count("*").alias("chunks"), tables.alias("tables"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))).alias("all"))
    return each.select(doc, "chunks", "tables", F.array_join(F.transform("all", lambda x: x["t"]), "\n\n").alias("text"))


def chunk_summary(chunks: DataFrame, kind: str = "kind", tokens: str = "tokens", source: str = "doc") -> DataFrame:
    """One row: chunks by kind, their tokens, the mean as a whole number, how many sources."""
    of = lambda k: F.count_if(F.col(kind) == k)
    n, total = F.count("*"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long")
    return chunks.agg(n.alias("total_chunks"), total.alias("total_tokens"), of("table").alias("table_chunks"), of("text").alias("text_chunks"), of("statistics").alias("stats_chunks"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("avg_tokens"), F.count_distinct(source).alias("sources"))
