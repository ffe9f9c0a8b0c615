"""The stored BM25 index against the search that counts in the row, through adding, deleting and merging."""

import glob

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import retrieve
from quarrykit.operators.keyword_index import KeywordIndex, postings

FOLDER = "/root/testdata/sf0.01"
TERMS = ["idiot", "stupid", "onthe", "idiot"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("key"), "text").cache()


def hits(df):
    return [(r["key"], round(r["score"], 9)) for r in df.collect()]


def plain(docs, query, k=10):
    return hits(retrieve.bm25(docs, "text", query, k).select("key", "score"))


def test_search_and_changes(spark, docs, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"), bucket=16)
    assert index.search(TERMS).hits.collect() == [] and index.delete(docs) == 0
    even = F.col("key") % 2 == 0
    assert index.add(docs.filter(even)) == docs.filter(even).count()
    assert hits(index.search(TERMS).hits) == plain(docs.filter(even), TERMS)
    index.add(docs.filter(~even))
    for query in (TERMS, ["onthe"], ["trash", "the", "nowherefound"], ["nowherefound"], []):
        assert hits(index.search(query, 7).hits) == (plain(docs, query, 7) if query else [])
    assert hits(index.search(TERMS, 10_000).hits) == plain(docs, TERMS, 10_000)

    seven = F.col("key") % 7 == 0
    assert index.delete(docs.filter(seven)) == docs.filter(seven).count()
    assert index.delete(docs.filter(seven)) == 0
    left = docs.filter(~seven)
    assert hits(index.search(TERMS).hits) == plain(left, TERMS)
    index.merge()
    assert len(index.state()["segments"]) == 1 and not index.state()["deleted"]
    assert hits(index.search(TERMS).hits) == plain(left, TERMS)
    again = KeywordIndex(spark, str(tmp_path / "again"), bucket=16)
    again.add(left)
    same = lambda i: sorted((r["term"], r["bucket"], tuple(r["keys"]), tuple(r["tfs"]), tuple(r["dls"])) for r in i.read(i.state(), "postings").collect())
    assert same(index) == same(again)  # a merge is a rebuild

    changed = docs.filter(even).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" idiot stupid")))
    index.upsert(changed)
    whole = changed.unionByName(left.filter(~even))
    assert hits(index.search(TERMS).hits) == plain(whole, TERMS)
    with pytest.raises(ValueError, match="is in the index"):
        index.add(changed.limit(3))
    assert index.state()["docs"] == whole.count()


def test_only_rows_of_the_terms_and_of_good_buckets_are_read(spark, docs, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"), bucket=4)
    index.add(docs)
    rare = docs.select(F.explode(F.array_distinct(retrieve.tokens(F.col("text")))).alias("t")).groupBy("t").count().filter("count between 2 and 4").orderBy("t").first()["t"]
    found = index.search([rare, "that", "the", "onthe", "is"], 3)
    assert hits(found.hits) == plain(docs, [rare, "that", "the", "onthe", "is"], 3)
    common = index.search([rare, "est", "an", "er"], 2)
    assert hits(common.hits) == plain(docs, [rare, "est", "an", "er"], 2)
    assert common.rows > 100 and common.read < common.rows / 2
    plan = common.hits._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(term" in plan


def test_dedup_keys_and_odd_texts(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([("a", "well oil"), ("b", "well oil"), ("c", None), ("d", ""), ("e", "the of")], "key string, text string")
    assert index.add(rows, dedup=True) == 3  # a stands for b, c for d
    assert index.add(rows, dedup=True) == 0 and index.state()["docs"] == 3
    assert hits(index.search(["well"]).hits) == plain(rows.filter("key IN ('a', 'c', 'e')"), ["well"])
    with pytest.raises(ValueError, match="null"):
        index.add(spark.createDataFrame([(None, "x y")], "key string, text string"))
    with pytest.raises(ValueError, match="twice"):
        index.add(spark.createDataFrame([("z", "x y"), ("z", "other")], "key string, text string"))
    assert index.delete(rows) == 3 and index.search(["well"]).hits.collect() == []
    index.merge()
    assert index.state()["segments"] == [] and index.search(["well"]).hits.collect() == []
    assert len(glob.glob(str(tmp_path / "index/versions/at=*/*.parquet"))) == index.state()["version"]


def test_postings_of_a_bucket():
    """A row for each term of a bucket, with the documents in the order of their keys and what bounds their scores."""
    docs = pa.table({"bucket": pa.array([3, 3, 3], pa.int32()), "key": ["c", "a", "b"], "dl": pa.array([3, 1, 2], pa.int32()), "words": ["oil well oil", "gas", "gas oil"]})
    got = {r["term"]: (r["bucket"], r["n"], r["most"], r["least"], r["keys"], r["tfs"], r["dls"]) for r in postings(docs).to_pylist()}
    assert got == {"oil": (3, 2, 2, 2, ["b", "c"], [1, 2], [2, 3]), "gas": (3, 2, 1, 1, ["a", "b"], [1, 1], [1, 2]), "well": (3, 1, 1, 3, ["c"], [1], [3])}
