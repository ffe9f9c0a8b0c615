"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of 10 words (shorter items are one window). A window is the set of its
shingles at their offsets; containing it whole means sharing all of them, so the necessary prefix is its rarest
shingle. One pass over the documents keeps the positions of shingles that any window has, with the words around
them; their counts give the order of rarity; each window then joins on its rarest shingle alone. Length and
position bound the start (0 <= position - offset, start + length <= document length), and the words of the window
are compared with those of the document.

Nulls and odd rows: a null or empty text has no words and is never contaminated; a null item_id counts as the item
'null'; repeated rows are separate documents, judged alike; an empty benchmark leaves all documents clean; only the
columns named are read, so extra ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm.common import NOT_ITEM_WORD, ascii_lower, cut, stored, table, text_hash, words

WINDOW, SHINGLE = 10, 5
#: Windows are broadcast in blocks of at most this many, each some 300 bytes; more blocks mean more passes.
BLOCK = 200_000


def item_words(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ITEM_WORD)


def shingle_at(tokens: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from ``at`` on (from 0); null if they would pass the end."""
    parts = [F.get(tokens, at + i) for i in range(length)]
    return F.when(at + length <= F.size(tokens), F.xxhash64(F.lit(length), *parts))


def windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, tokens, block) and which items have them (wid, item)."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")
    tokens = benchmark.select(item, item_words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0))))
    cut_out = cut(tokens.select("item", "all", start.alias("start")).select("item", F.slice("all", F.col("start") + 1, window).alias("tokens")).distinct())
    distinct = cut(cut_out.select("tokens").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return distinct, cut_out.join(distinct, "tokens").select("wid", "item")


def shingles(distinct: DataFrame, lengths: list[int]) -> DataFrame:
    """(wid, tokens, length, offset, h) of every window."""
    made = []
    for n in lengths:
        of = distinct.filter(F.size("tokens") >= n) if n == max(lengths) else distinct.filter(F.size("tokens") == n)
        at = of.select("wid", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - n)).alias("offset"))
        made.append(at.select("wid", "tokens", F.size("tokens").alias("length"), "offset", shingle_at(F.col("tokens"), F.col("offset"), n).alias("h")))
    return reduce(DataFrame.unionByName, made)


def occurrences(docs: DataFrame, of: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """One row per document, and one per place where a shingle of ``of`` stands, with the words around it.

    The explode, the hash and the broadcast join run in one generated stage; nothing is shuffled.
    """
    known = F.broadcast(of.select(F.col("h").alias("_h")).distinct())
    tokens = docs.select("rid", "doc_id", text_hash(F.col("text")).alias("text_hash"), item_words(F.col("text")).alias("all"))
    placed = tokens.select("rid", "doc_id", "text_hash", "all", F.posexplode_outer("all").alias("at", "word"))
    hashes = [shingle_at(F.col("all"), F.col("at"), n) for n in lengths]
    placed = placed.withColumn("h", hashes[0]) if len(hashes) == 1 else placed.withColumn("h", F.explode(F.array(*hashes)))
    first = F.greatest(F.col("at") - window + 1, F.lit(0))
    around = F.when(F.col("_h").isNotNull(), F.slice("all", first + 1, 2 * window))
    return placed.join(known, F.col("h") == F.col("_h"), "left").filter("_h is not null or at is null or at = 0").select("rid", "doc_id", "text_hash", F.size("all").alias("n_words"), "at", F.col("_h").alias("h"), first.alias("first"), around.alias("around"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, spans, items) for every document.

    ``spans``: sorted (start, length) of the windows found; ``items``: the sorted item_ids that have them.
    """
    distinct, of_item = windows(benchmark, window)
    many = distinct.count()
    if many == 0:
        n = F.size(item_words(F.col("text")))
        none = F.array().cast("array<struct<start:int,length:int>>")
        return docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), n.alias("n_words"), F.lit(0).alias("n_hit"), none.alias("spans"), F.array().cast("array<string>").alias("items"))
    short = [r[0] for r in distinct.select(F.least(F.size("tokens"), F.lit(shingle)).alias("n")).distinct().collect()]
    found, base = [], None
    blocks = -(-many // block)
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    docs = docs if blocks == 1 else stored(docs, "decontaminate")  # every block must see the same ids
    for b in range(blocks):
        part = distinct if blocks == 1 else distinct.filter(F.pmod(F.xxhash64("tokens"), F.lit(blocks)) == b)
        parts = cut(shingles(part, sorted(short)))
        seen = cut(occurrences(docs, parts, sorted(short), window))
        base = seen if base is None else base
        rarity = seen.filter("h is not null").groupBy("h").agg(F.count("*").alias("count"))
        # a window of which some shingle stands nowhere drops out with the inner join of its rarest one
        rarest = parts.join(rarity, "h", "left").groupBy("wid").agg(F.min_by(F.struct("h", "offset", "length", "tokens", "count"), F.struct(F.coalesce("count", F.lit(0)), "h", "offset")).alias("p")).filter("p.count > 0").select("wid", "p.*").drop("count")
        start = F.col("at") - F.col("offset")
        inside = (start >= F.col("first")) & (start + F.col("length") <= F.col("n_words"))
        same = F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("length")) == F.col("tokens")
        found.append(seen.filter("h is not null").join(F.broadcast(rarest), "h").filter(inside & same).select("rid", start.alias("start"), "length", "wid"))
    spans = reduce(DataFrame.unionByName, found)
    many_items = of_item.count()
    of_item = F.broadcast(of_item) if many_items <= 10 * block else of_item
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    hits = spans.join(of_item, "wid").groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")).withColumn("n_hit", merged)
    documents = base.filter("at is null or at = 0").dropDuplicates(["rid"]) if len(short) > 1 else base.filter("at is null or at = 0")
    return documents.select("rid", "doc_id", "text_hash", F.greatest("n_words", F.lit(0)).alias("n_words")).join(hits, "rid", "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("spans", F.array()).alias("spans"), F.coalesce("items", F.array()).alias("items")
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_decontaminate": op1_decontaminate}

_SPLIT = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_SPLIT} AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[i + 1 : i + k], ' ') AS t
        FROM (SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
pos AS (SELECT rid, i, k, array_to_string(w[i + 1 : i + k], ' ') AS t
       FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT rid, i, pos.k AS k, item FROM pos JOIN win ON pos.k = win.k AND pos.t = win.t),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)"""
}
