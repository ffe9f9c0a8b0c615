"""Chunking: fixed windows by expression; budgeted splitters as small per-document helpers; row batches; tables as text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from quarrykit.functions.hygiene import LEAST, NOISE, chunk_hash


def fixed(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk, piece): windows of ``size`` characters, each starting ``overlap`` before the end of the last."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    cut = docs.filter(F.length(text) > 0).select(key, text, F.posexplode(starts).alias("chunk", "start"))
    return cut.select(key, "chunk", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("piece"))


def windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """Windows of ``size`` characters, cut behind their last full stop if it lies beyond half of them and text follows."""
    at = 0
    while at < len(text):
        stop = text.rfind(".", at, at + size) + 1 - at if at + size < len(text) else 0
        end = at + (stop if stop - 1 > size / 2 else size)
        yield text[at:end]
        at = max(end - overlap, at + 1)


def sentence_windows(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200, most: int = 1 << 20) -> DataFrame:
    """(key, chunk, piece): like ``fixed``, but a window ends with a sentence where it can; null and empty texts have none.

    Pieces leave a task by about ``most`` characters, so that it holds one batch of texts and no more.
    """
    schema = T.StructType([docs.select(key).schema[0], T.StructField("chunk", T.IntegerType()), T.StructField("piece", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, str]] = []
            held = 0

            def out() -> pa.RecordBatch:
                of, chunks, pieces = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(chunks, pa.int32()), pa.array(pieces, pa.string())], schema.names)  # noqa: B023

            for i in range(batch.num_rows):
                for chunk, piece in enumerate(windows(batch.column(1)[i].as_py() or "", size, overlap)):
                    rows.append((i, chunk, piece))
                    held += len(piece)
                    if held >= most:
                        yield out()
                        rows, held = [], 0
            if rows:
                yield out()

    return docs.select(key, text).mapInArrow(cut, schema)


def split_table(text: str, tokens: int, spare: int = 50) -> Iterator[str]:
    """A Markdown table in parts within a token budget, a token being four characters; the header heads each part.

    The header reaches to the rule within the first three lines, else it is the first line; ``spare`` tokens are kept
    free. No row is dropped: one that alone is over the budget is a part of its own.
    """
    lines = text.strip().split("\n")
    rule = next((i for i, line in enumerate(lines[:3]) if "|" in line and "---" in line), 0)
    head, rows = "\n".join(lines[: rule + 1]), lines[rule + 1 :]
    budget, held, used = tokens - len(head) // 4 - spare, [], 0
    for row in rows:
        if held and used + len(row) // 4 > budget:
            yield "\n".join([head, *held])
            held, used = [], 0
        held.append(row)
        used += len(row) // 4
    if held or text.strip():
        yield "\n".join([head, *held])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _table_parts(texts: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([list(split_table(t or "", int(n))) for t, n in zip(texts, tokens, strict=True)])


def table_parts(tables: DataFrame, key: str, text: str, tokens: int = 2000) -> DataFrame:
    """(key, part, piece): Markdown tables split by ``split_table``."""
    return tables.select(key, F.posexplode(_table_parts(F.col(text), F.lit(tokens))).alias("part", "piece"))


def noise(text: str) -> bool:
    """What ``hygiene.is_noise`` says, for one text."""
    text = text.strip().lower()
    return len(text) < LEAST or any(re.search(p, text) for p in NOISE)


def table_like(text: str) -> bool:
    """What ``hygiene.is_table`` says, for one text."""
    lines = text.split("\n")
    return sum(line.count("|") > 1 for line in lines) > 1 and any(re.match(r"\|\s*-+\s*\|", line) for line in lines)


def packed(parts: Iterable[str], tokens: int, joint: str, overlap: int = 0) -> Iterator[str]:
    """Parts joined while their tokens fit; the last of a full chunk, if it fits the overlap, begins the next one too."""
    held: list[str] = []
    for part in parts:
        if held and sum(len(p) // 4 for p in held) + len(part) // 4 > tokens:
            yield joint.join(held)
            held = held[-1:] if overlap and len(held[-1]) // 4 <= overlap else []
        held.append(part)
    if held:
        yield joint.join(held)


def split_text(text: str, tokens: int, overlap: int = 0) -> Iterator[str]:
    """A text in chunks within a budget of tokens, four characters each: whole if it fits, tables by rows, else by paragraphs.

    Paragraphs are packed together, and those over the budget by sentences, apart from their neighbours; one sentence may
    be over it. Paragraphs that are noise are left out, and so is a text that is noise as a whole.
    """
    if len(text) // 4 <= tokens:
        if not noise(text):
            yield text
        return
    if table_like(text):
        yield from split_table(text, tokens)
        return
    paragraphs = [p for p in map(str.strip, re.split(r"\n\n+", text)) if not noise(p)]
    for long, together in groupby(paragraphs, key=lambda p: len(p) // 4 > tokens):
        if long:
            for p in together:
                yield from packed(filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", p))), tokens, " ")
        else:
            yield from packed(together, tokens, "\n\n", overlap)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(texts: pd.Series, most: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([list(split_text(t or "", int(m), int(o))) for t, m, o in zip(texts, most, overlap, strict=True)])


def budgeted(docs: DataFrame, key: str, text: str, tokens: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk, piece, hash) within a token budget, a token being four characters."""
    parts = F.posexplode(_split(F.col(text), F.lit(tokens), F.lit(overlap))).alias("chunk", "piece")
    return docs.select(key, parts).withColumn("hash", chunk_hash(F.col("piece")))


class DocumentChunks:
    """Table function over the parts of documents (doc, place, kind, text), a call for each document, its parts in order.

    Kinds in order are statistics, table and text, whatever their places. Tables are split by rows, texts by
    ``split_text``; noise is left out. A text that stood in the document before is left out, a table only if it is of
    fewer than BRIEF tokens, so that rows are never lost. Chunks are numbered from 0 as they come.
    """

    BRIEF = 100
    KINDS = ("statistics", "table", "text")

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.number = 0

    @staticmethod
    def analyze(parts: AnalyzeArgument, tokens: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name: f.dataType for f in parts.dataType.fields}
        if set(fields) != {"doc", "place", "rank", "kind", "text"}:
            raise ValueError("parts have the columns doc, place, rank, kind and text")
        schema = T.StructType().add("doc", fields["doc"]).add("chunk", T.IntegerType()).add("kind", T.StringType()).add("text", T.StringType()).add("hash", T.StringType()).add("tokens", T.IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc")], orderBy=[OrderingColumn("rank"), OrderingColumn("place"), OrderingColumn("text")])

    def eval(self, part: T.Row, tokens: int, overlap: int) -> Iterator[tuple]:
        kind, text = part["kind"], part["text"] or ""
        pieces = [text] if kind == "statistics" else split_text(text, tokens, overlap) if kind == "text" else split_table(text, tokens)
        for piece in pieces:
            mark, size = hashlib.sha256(piece.encode("utf-8", "replace")).hexdigest()[:16], len(piece) // 4
            said_before = mark in self.seen and (kind == "text" or size < self.BRIEF)
            if not piece or kind != "statistics" and (said_before or kind == "table" and noise(piece)):
                continue
            if kind != "statistics":
                self.seen.add(mark)
            yield part["doc"], self.number, "table" if kind == "text" and table_like(piece) else kind, piece, mark, size
            self.number += 1


def document_chunks(parts: DataFrame, tokens: int = 2000, overlap: int = 50) -> DataFrame:
    """(doc, chunk, kind, text, hash, tokens) of documents given as parts (doc, place, kind, text); see DocumentChunks."""
    kinds = F.array(*[F.lit(k) for k in DocumentChunks.KINDS])
    ranked = parts.select("doc", "place", F.array_position(kinds, F.col("kind")).alias("rank"), "kind", "text").filter("rank > 0")
    return F.udtf(DocumentChunks)(ranked.asTable(), F.lit(tokens), F.lit(overlap))


def first_of_each(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """One row per hash, the first by (key, order); aggregated before the shuffle."""
    rest = [c for c in chunks.columns if c != "hash"]
    return chunks.groupBy("hash").agg(F.min(F.struct(key, order, *[c for c in rest if c not in (key, order)])).alias("_r")).select("hash", *[F.col("_r")[c].alias(c) for c in rest])


def cell(c: Column, most: int = 100) -> Column:
    return F.substring(F.replace(F.coalesce(c.cast("string"), F.lit("NULL")), F.lit("|"), F.lit("\\|")), 1, most)


def table_chunks(df: DataFrame, group: Column, order: str, columns: list[str]) -> DataFrame:
    """(bucket, rows, body): Markdown of the rows of each bucket, header first. Choose buckets of bounded size."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'|'.join(' --- ' for _ in columns)}|\n"
    lines = df.groupBy(group.alias("bucket")).agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("x"))
    return lines.select("bucket", "rows", F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("body"))


def key_values(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) of lines like ``name: value``."""
    line = docs.select(key, F.explode(F.split(text, "\n")).alias("line")).filter(F.instr("line", ":") > 1)
    return line.select(key, F.trim(F.substring_index("line", ":", 1)).alias("name"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))


def markdown_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, cells): the rows of Markdown tables in a text, header included, rules left out; empty cells stay."""
    line = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "_l")).withColumn("_l", F.trim("_l"))
    rows = line.filter(F.col("_l").rlike(r"^\|.*\|$") & ~F.col("_l").rlike(r"^\|[\s:|-]*\|$"))
    inner = F.substring(F.col("_l"), F.lit(2), F.length("_l") - 2)
    return rows.select(key, "line", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))
