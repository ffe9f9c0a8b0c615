"""Sharding by a k-d tree over document metadata, split at weighted medians.

Each node holds the documents of a run of shards. It is split along its widest dimension (spread in the node by
spread overall) where the bytes to the left are to those of all as its left shards to all its shards, until every
leaf is one shard. The median is found by counting: a row's key is a 63-bit number (22 bits of the dimension's value
between the node's least and greatest, 12 of a hash of the whole value, 14 of the text, 15 of the row), and each round
sums bytes in equal cells of the range that holds the median, for all nodes at once, and goes on in the cell it lies in. The tree's figures stand as
arrays by node in the expressions; one row per node comes to the driver, and no text is shuffled.

Dimensions: language, source, log of the size. Strings count by the six bytes after what all of the node's values
begin with, and values that agree in these too still stay apart by their hash. Null values sort first, a null text has
size 1. Equal texts of one language and source stand side by side in every order, so copies stay together but where a
median falls inside their group: under the law ``bytes`` a group larger than a shard must be parted. Rows of equal
doc_id and text stay together. An empty table gives an empty result; only the columns named are read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import cut, table

SHARDS = 8
DIMENSIONS = ("lang", "source", "by_size")
SIZE = DIMENSIONS.index("by_size")
VALUE_BITS, NAME_BITS, TEXT_BITS, ROW_BITS = 22, 12, 14, 15
#: A round of a median counts bytes in so many cells of each node.
CELLS = 1 << 15
#: A median is near enough when the cell it falls in holds at most this share of a shard.
NEAR = 1e-4
#: Rows of a shard are numbered in buckets of about this many.
BUCKET_ROWS = 100_000


def metadata(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), *names, F.log2(size.cast("double")).alias("by_size"), F.xxhash64("doc_id", crc).alias("tie"))


def ordinal(text: Column, skip: Column) -> Column:
    """A number in the order of the six bytes after the first ``skip``."""
    head = F.hex(F.substring(F.encode(text, "UTF-8"), skip + 1, F.lit(6)))
    return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")


def ordinal_of(text: str, skip: int) -> float:
    """``ordinal`` of one value, on the driver."""
    return float(int.from_bytes(text.encode()[skip : skip + 6].ljust(6, b"\0"), "big"))


def by_node(values: list, kind: str) -> Column:
    """The value of the row's node, from an array that Spark folds into a literal."""
    return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("node"))


class Ranges:
    """Least and greatest of each dimension in a node."""

    def __init__(self, row) -> None:
        self.ends = [(row[f"min_{c}"], row[f"max_{c}"]) for c in DIMENSIONS]
        self.bytes = row["bytes"]

    def skip(self, d: int) -> int:
        return 0 if d == SIZE else len(commonprefix([x.encode() for x in self.ends[d]]))

    def number(self, d: int, skip: int) -> tuple[float, float]:
        return self.ends[d] if d == SIZE else tuple(ordinal_of(x, skip) for x in self.ends[d])

    def widest(self, overall: Ranges) -> int:
        def spread(d: int) -> tuple[float, bool]:
            low, high = self.number(d, overall.skip(d))
            least, most = overall.number(d, overall.skip(d))
            return (high - low) / ((most - least) or 1.0), self.ends[d][0] != self.ends[d][1]

        return max(range(len(DIMENSIONS)), key=spread)


def keyed_by(placed: DataFrame, dims: list[int], skips: list[int], lows: list[float], scales: list[float]) -> DataFrame:
    """``placed`` with the key along its node's dimension, null in a node of one shard (dimension -1)."""
    dim = by_node(dims, "int")
    name = F.when(dim == SIZE, F.col("size").cast("string")).otherwise(F.get(F.array("lang", "source"), dim))
    value = F.when(dim == SIZE, F.col("by_size")).otherwise(ordinal(name, by_node(skips, "int")))
    placed = placed.withColumns({"dim_name": name, "scaled": F.floor((value - by_node(lows, "double")) * by_node(scales, "double"))})
    bits = lambda c, n: c.bitwiseAND((1 << n) - 1)
    key = F.shiftleft(F.greatest(F.lit(0), F.least("scaled", F.lit((1 << VALUE_BITS) - 1))), NAME_BITS + TEXT_BITS + ROW_BITS)
    key += F.shiftleft(bits(F.xxhash64("dim_name"), NAME_BITS), TEXT_BITS + ROW_BITS) + F.shiftleft(bits(F.xxhash64("text_crc32", "size"), TEXT_BITS), ROW_BITS) + bits(F.col("tie"), ROW_BITS)
    return placed.withColumn("key", F.when(F.col("dim_name").isNotNull(), key)).drop("dim_name", "scaled")


def medians(keyed: DataFrame, ends: dict[int, tuple[int, int, int]], nodes: int, near: float) -> dict[int, int]:
    """Per node the last key that goes left. ends: least and greatest key, bytes that are to go left. keyed: (node, key, size)."""
    open_, done = dict(ends), {}
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    start = F.struct(zero.alias("upto"), none.alias("low"), none.alias("high"), zero.alias("bytes"))

    def step(a: Column, x: Column) -> Column:
        """The first cell with which the bytes reach the goal, and the bytes up to it."""
        upto = a["upto"] + x["bytes"]
        here = F.struct(a["upto"].alias("upto"), x["low"].alias("low"), x["high"].alias("high"), x["bytes"].alias("bytes"))
        return F.when(a["low"] >= 0, a).when(upto >= F.col("goal"), here).otherwise(F.struct(upto.alias("upto"), none.alias("low"), none.alias("high"), zero.alias("bytes")))

    while open_:
        of = lambda f: by_node([f(*open_[n]) if n in open_ else -1 for n in range(nodes)], "long")  # noqa: B023, E731
        cell = F.expr("(key - low) div width")
        inside = keyed.withColumns({"low": of(lambda a, b, g: a), "high": of(lambda a, b, g: b), "width": of(lambda a, b, g: (b - a) // CELLS + 1)}).filter("key between low and high")
        sums = inside.groupBy("node", cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        cells = sums.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("low", "high", "bytes"))).alias("cells"))  # CELLS at most
        for node, x in cells.withColumn("goal", of(lambda a, b, g: g)).select("node", F.aggregate("cells", start, step)).collect():
            want = open_[node][2] - x["upto"]
            if x["low"] == x["high"] or x["bytes"] <= near:
                done[node] = x["high"] if want * 2 >= x["bytes"] else x["low"] - 1  # the cell goes as a whole, whichever side is nearer
                del open_[node]
            else:
                open_[node] = (x["low"], x["high"], want)
    return done


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every document, by number of shards or by bytes per shard."""
    placed = cut(metadata(docs)).withColumn("node", F.lit(0))
    columns, overall, rows, tree = placed.columns, None, 0, [shards or 1]  # tree: shards of each node, from left to right
    while overall is None or max(tree) > 1:
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max)]
        found = {r["node"]: r for r in placed.groupBy("node").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends).collect()}
        if overall is None:
            if not found:
                break
            overall, rows = Ranges(found[0]), found[0]["rows"]
            shards = shards or max(1, math.ceil(overall.bytes / target_bytes))
            tree = [shards]
            if shards == 1:
                break
        dims, skips, lows, scales, goals = [], [], [], [], {}
        for node, k in enumerate(tree):
            at = Ranges(found[node]) if k > 1 and node in found else None
            d = at.widest(overall) if at else -1
            skip = at.skip(d) if at else 0
            low, high = at.number(d, skip) if at else (0.0, 0.0)
            for x, to in ((d, dims), (skip, skips), (low, lows), (((1 << VALUE_BITS) - 1) / (high - low) if high > low else 0.0, scales)):
                to.append(x)
            if at:
                goals[node] = (0, (1 << 63) - 1, at.bytes * (k // 2) // k)
        keyed = cut(keyed_by(placed, dims, skips, lows, scales))
        last = medians(keyed.select("node", "key", "size"), goals, len(tree), NEAR * overall.bytes / shards)
        halves = [(k,) if k == 1 else (k // 2, k - k // 2) for k in tree]
        first = [sum(map(len, halves[:i])) for i in range(len(halves))]
        right = F.col("key") > by_node([last.get(n, (1 << 63) - 1) for n in range(len(tree))], "long")
        placed = keyed.withColumn("node", by_node(first, "int") + F.when(right, 1).otherwise(0)).select(*columns)
        tree = [k for half in halves for k in half]
    placed = placed.withColumnRenamed("node", "shard").withColumn("bucket", F.pmod("tie", F.lit(max(32, rows // (BUCKET_ROWS * len(tree))))))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = counts.select("shard", "bucket", (F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "doc_id"))
    slot = (F.col("before") + F.col("rank") - 1).cast("long")
    return placed.withColumn("rank", rank).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_shard": op4_shard}
#: None: the median search is a driver loop over SQL steps; tests compare it with a plain k-d tree.
ORACLE_SQL: dict[str, str] = {}
