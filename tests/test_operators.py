"""Hand-worked fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarrykit.functions import hygiene
from quarrykit.operators import aggregate, chunk, profile, retrieve, trend
from quarrykit.plans import router
from quarrykit.sources import tables
from quarrykit.streaming import events as windows

WELLS = [("Well-A", 1, 100.0, 1000.0, 50.0), ("Well-A", 2, 150.0, 1500.0, 75.0), ("Well-B", 3, 200.0, 2000.0, 100.0), ("Well-B", 4, 250.0, 2500.0, 125.0)]


@pytest.fixture(scope="module")
def wells(spark):
    rows = [(n, datetime.datetime(2024, 1, d), o, g, w) for n, d, o, g, w in WELLS]
    return spark.createDataFrame(rows, "ITEM_NAME string, START_DATETIME timestamp, PROD_OIL_VOL double, PROD_GAS_VOL double, PROD_WAT_VOL double")


def test_profile(wells):
    r = profile.numeric_profile(wells).filter("name = 'PROD_OIL_VOL'").first()
    assert (r["sum"], r["mean"], r["min"], r["max"], r["median"]) == (700, 175, 100, 250, 175)
    assert round(r["std"], 6) == 64.549722
    one = profile.numeric_profile(wells.limit(1)).first()
    assert one["std"] is None


def test_groups(wells):
    assert {r[0]: r[1] for r in aggregate.group_agg(wells, "ITEM_NAME", "PROD_OIL_VOL").collect()} == {"Well-A": 250, "Well-B": 450}
    r = aggregate.comparisons(wells, "ITEM_NAME", "PROD_OIL_VOL").collect()
    assert [(x["kind"], x["difference"], x["pct"], x["significance"]) for x in r] == [("top_vs_second", 200, 80, "high")]
    with pytest.raises(ValueError, match="unknown aggregate"):
        aggregate.group_agg(wells, "ITEM_NAME", "PROD_OIL_VOL", "eval")
    assert profile.correlations(wells, ["PROD_OIL_VOL", "PROD_GAS_VOL"]).first()["r"] == pytest.approx(1)


def test_trends(wells):
    r = trend.trend_thirds(wells, "START_DATETIME", "PROD_OIL_VOL", "ITEM_NAME").first()
    assert (r["first_mean"], r["last_mean"], r["change_pct"], r["direction"], r["confidence"]) == (100, 250, 150, "up", "low")
    assert trend.trend_ols(wells, "START_DATETIME", "PROD_OIL_VOL", "ITEM_NAME").isEmpty()
    assert trend.outliers_iqr(wells, "PROD_OIL_VOL", "ITEM_NAME").isEmpty()
    assert trend.outliers_expected(wells, "PROD_OIL_VOL", "ITEM_NAME").isEmpty()


def test_products(spark):
    df = spark.createDataFrame([("Widget A", 1000, "North"), ("Widget B", 1500, "South"), ("Widget C", 800, "East"), ("Widget D", 2000, "West"), ("Widget E", 1200, "North")], "product string, sales long, region string")
    top = aggregate.two_sided(df, "product", "sales").orderBy("rank").collect()
    assert [(r["product"][-1], r["total"]) for r in top] == [("D", 2000), ("B", 1500), ("E", 1200), ("A", 1000), ("C", 800)] and {r["of_total"] for r in top} == {5}
    got = {r["name"]: r["value"] for r in profile.metrics(df, ["sales"], ["product", "region"]).collect()}
    assert got == {"Total sales": 6500, "Average sales": 1300, "Maximum sales": 2000, "Minimum sales": 800, "Total Records": 5, "Unique region": 4}
    two = {r["kind"]: (r["difference"], round(r["pct"], 2)) for r in aggregate.comparisons(df, "product", "sales").collect()}
    assert two == {"top_vs_second": (500, 33.33), "top_vs_bottom": (1200, 150)}
    assert profile.confidence(5, 6, 2, 0.0) == "low"


CHUNKS = [("doc1", 0, "Oil production increased by 10% in Q1"), ("doc1", 1, "Gas volumes remained stable throughout the year"), ("doc1", 2, "Water injection rates were optimized"), ("doc2", 0, "Total oil output reached 1 million barrels")]


def test_search(spark):
    df = spark.createDataFrame([(f"{d}:{i}", d, i, t) for d, i, t in CHUNKS], "key string, doc string, chunk int, text string")
    got = {r["key"]: round(r["score"], 6) for r in retrieve.bm25(df, "text", ["oil", "production"]).collect()}
    assert got == {"doc1:0": 1.938663, "doc2:0": 0.651279}
    assert [r["key"] for r in retrieve.bm25(df, "text", ["oil"], within=F.col("doc") == "doc2").collect()] == ["doc2:0"]
    context = {r["key"]: r["context"] for r in retrieve.with_context(df, "doc", "chunk", "text").collect()}
    assert context["doc2:0"] == CHUNKS[3][2] and context["doc1:0"].count("---") == 1 and context["doc1:1"].count("---") == 2


def test_fusion(spark):
    v = spark.createDataFrame([("doc1:0", 0.9), ("doc1:1", 0.7)], "key string, score double")
    k = spark.createDataFrame([("doc1:1", 5.0), ("doc1:0", 4.0)], "key string, score double")
    got = [(r["key"], round(r["score"], 9), r["sources"]) for r in retrieve.fuse({"vector": (v, 0.6), "keyword": (k, 0.4)}, "key").collect()]
    assert got == [("doc1:0", 0.016287678, "keyword,vector"), ("doc1:1", 0.016234796, "keyword,vector")]


def test_cosine(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]])], "id int, v array<float>")
    got = {r["id"]: round(r["score"], 6) for r in retrieve.vector_search(df, "v", [1.0, 0.0], "id").collect()}
    assert got == {0: 1.0, 2: 0.707107, 1: 0.0, 3: 0.0}


@pytest.mark.parametrize(("question", "mode"), [("how to eat ice cream", "freeform"), ("how to cook pasta", "freeform"), ("what is 2 plus 2", "data"), ("show me gas production", "data"), ("what is in the document", "overview"), ("what is total oil production", "data"), ("analyze data quality and missing values", "data"), ("fix the bug", "system")])
def test_modes(spark, question, mode):
    assert router.mode(question) == mode
    assert spark.createDataFrame([(question,)], "q string").select(router.mode_column(F.col("q"))).first()[0] == mode


def test_metric_columns(wells):
    assert router.metric_columns(["oil"], wells.columns) == ["PROD_OIL_VOL"]
    assert router.metric_columns(router.metrics_in("gas production"), wells.columns) == ["PROD_GAS_VOL"]
    assert router.answer("total oil production", wells).first()[0] == 700
    assert router.charts("oil trend over time", wells, ["PROD_OIL_VOL"])["kinds"] == ["time_series"]


def test_hygiene(spark):
    assert hygiene.clean_header([" a b ", "a b", "", "Unnamed: 3", "x$"]) == ["a_b", "a_b_1", "Column_3", "Column_4", "x"]
    assert hygiene.unit_of("unit_price") == "currency" and hygiene.unit_of("zzz") is None
    cells = spark.createDataFrame([("1", "1"), ("2", "2"), ("x", "3"), ("", "x")], "half string, most string")
    assert dict(tables.typed(cells).dtypes) == {"half": "string", "most": "double"}
    flags = spark.createDataFrame([("page 3 of 9",), ("-----------",), ("",), (None,), ("an ordinary line",)], "t string")
    assert [r[0] for r in flags.select(hygiene.is_noise(F.col("t"))).collect()] == [True, True, True, True, False]


def test_union(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("y", 2.5)], "v string, w double")
    assert sorted(map(tuple, aggregate.union_tables(a, b).collect()), key=str) == [(1, "x", None), (None, "y", 2.5)]
    c = spark.createDataFrame([("z",)], "k string")
    assert {r["k"] for r in aggregate.union_tables(a, c).collect()} == {"1", "z"}


def test_windows_end_with_sentences_and_tables_keep_their_rows():
    text = "a" * 70 + "." + "b" * 100
    assert list(chunk.windows(text, 100, 10)) == [text[:71], text[61:161], text[151:]] and list(chunk.windows("", 100, 10)) == []
    assert list(chunk.windows("x" * 50 + "." + "y" * 99, 100, 0))[0] == "x" * 50 + "." + "y" * 49  # not beyond half
    head, rows = "| a |\n| --- |", [f"| {i:030d} |" for i in range(40)]
    parts = list(chunk.split_table("\n".join([head, *rows]), 100))
    assert len(parts) > 3 and all(p.startswith(head + "\n") and len(p) // 4 <= 100 for p in parts)
    assert [line for p in parts for line in p.split("\n")[2:]] == rows
    assert list(chunk.split_table("", 100)) == [] and list(chunk.split_table("| a |", 100)) == ["| a |"]


def test_chunks(spark):
    text = "First one. Second one! " * 60
    parts = list(chunk.split_text(text, 50, 10))
    assert all(sum(len(s) // 4 for s in p.replace("! ", "!|").replace(". ", ".|").split("|")) <= 50 for p in parts) and " ".join(parts) == text.strip()
    para = ["One paragraph of words, number %02d." % i for i in range(6)]  # of 8 tokens
    assert list(chunk.split_text("\n\n".join([*para[:3], "page 3", *para[3:]]), 30, 9)) == ["\n\n".join(para[:3]), "\n\n".join(para[2:5]), "\n\n".join(para[4:])]
    assert list(chunk.split_text("\n\n".join(para), 30, 7)) == ["\n\n".join(para[:3]), "\n\n".join(para[3:])]
    long = "A sentence of nine tokens, or about so. " * 5
    assert list(chunk.split_text(f"{para[0]}\n\n{long}\n\n{para[1]}", 20, 9)) == [para[0], *[" ".join([long[:39]] * 2)] * 2, long[:39], para[1]]
    assert list(chunk.split_text("page 3 of 4", 50)) == [] and list(chunk.split_text("", 50)) == [] and list(chunk.split_text("  some words here ", 50)) == ["  some words here "]
    df = spark.createDataFrame([(1, "a: b\nc:d:e\nnothing"), (2, None)], "id int, t string")
    marks = df.select(hygiene.is_noise(F.col("t")), hygiene.is_table(F.col("t"))).collect()
    assert [tuple(r) for r in marks] == [(chunk.noise(t), chunk.table_like(t)) for t in ("a: b\nc:d:e\nnothing", "")]
    assert {tuple(r) for r in chunk.key_values(df, "id", "t").collect()} == {(1, "a", "b"), (1, "c", "d:e")}
    rows = chunk.table_chunks(spark.createDataFrame([(1, "a|b"), (2, None)], "id int, v string"), F.lit(0), "id", ["id", "v"]).first()
    assert rows["body"].split("\n")[2:] == ["| 1 | a\\|b |", "| 2 | NULL |"]


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name, n\na,1\nb,2\nc,x\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("name", "string"), ("n", "double")] and df.filter("n is null").count() == 1
    tables.write_table(df, str(tmp_path / "o.parquet"))
    assert tables.read_table(spark, str(tmp_path / "o.parquet")).count() == 3
    (tmp_path / "p.txt").write_text("one\n\ntwo\nlines\n")
    assert [r["text"] for r in tables.read_table(spark, str(tmp_path / "p.txt")).collect()] == ["one", "two\nlines"]
    assert {r["kind"] for r in tables.sniff(spark, str(tmp_path / "t.csv")).collect()} == {"text"}
    with pytest.raises(ValueError, match="no reader"):
        tables.kind_of("x.pdf")


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.stream(spark, str(tmp_path / "in"), source.schema, 1)
    seen: dict = {}
    q = windows.for_each(windows.by_kind(stream, "ts", "event_type", "value", delay="100 days"), lambda df, _: seen.update({(r["start"], r["event_type"]): r["count"] for r in df.collect()}), str(tmp_path / "state"), "update")
    q.awaitTermination()
    assert seen == {(r["start"], r["event_type"]): r["count"] for r in windows.by_kind(source, "ts", "event_type", "value").collect()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_delete_document_keeps_rows_without_key(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "doc_hash string, n int")
    tables.upsert_document(spark, chunks, f"{tmp_path}/t")
    tables.delete_document(spark, f"{tmp_path}/t", "a", f"{tmp_path}/u")
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/u").collect()) == [2, 3]


def test_cooldown_and_compression(spark):
    at = [0, 10, 299, 301, 620, 5000, 5299, 5300]
    rows = [(s, "a", 60.0) for s in at] + [(305, "b", 99.0), (100, "a", 1.0), (200, None, 70.0)]
    df = spark.createDataFrame(rows, "s long, kind string, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = windows.alerts_with_cooldown(df, "ts", "kind", "v", 50.0).select("kind", F.unix_timestamp("fired").alias("s")).collect()
    assert sorted((r["kind"] or "", r["s"]) for r in got) == [("", 200), ("a", 0), ("a", 301), ("a", 620), ("a", 5000), ("a", 5300), ("b", 305)]
    texts = spark.createDataFrame([("One two. Three four five! Six.",), ("a b c d e f g h",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(retrieve.compressed(F.col("t"), 5)).collect()] == ["One two. Three four five!", "a b c d e...", "", ""]
    few = spark.createDataFrame([("One two.\n\nThree  four. ",), (" One  two. Three four five six.",)], "t string")
    assert [r[0] for r in few.select(retrieve.compressed(F.col("t"), 5)).collect()] == ["One two.\n\nThree  four. ", " One  two."]


def test_document_chunks(spark):
    table = "| a |\n| --- |\n| 1 |"
    wide = "| column name |\n| --- |\n" + "\n".join(f"| {i:040d} |" for i in range(12))
    rows = [("d", 9, "statistics", "## Document Statistics: d"), ("d", 1, "text", "Some text that is told."), ("d", 2, "text", "Some text that is told."), ("d", 5, "table", table), ("d", 6, "table", table), ("d", 7, "table", wide), ("d", 8, "table", wide), ("d", 3, "text", table), ("d", 4, "text", "page 4"), ("e", 1, "text", None), ("e", 2, "table", ""), ("e", 3, "odd", "left out"), (None, 1, "text", "without a document")]
    got = chunk.document_chunks(spark.createDataFrame(rows, "doc string, place int, kind string, text string").repartition(3), 200, 10).collect()
    mine = [(r["chunk"], r["kind"], r["text"]) for r in sorted((r for r in got if r["doc"] == "d"), key=lambda r: r["chunk"])]
    assert mine == [(0, "statistics", "## Document Statistics: d"), (1, "table", table), (2, "table", wide), (3, "table", wide), (4, "text", "Some text that is told.")]
    assert [(r["chunk"], r["text"]) for r in got if r["doc"] is None] == [(0, "without a document")] and not [r for r in got if r["doc"] == "e"]
    assert all(r["tokens"] == len(r["text"]) // 4 for r in got)
    none = chunk.document_chunks(spark.createDataFrame([], "doc long, place int, kind string, text string"))
    assert none.collect() == [] and none.dtypes[0] == ("doc", "bigint")


def test_correlation_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 20)) + 1e6
    x[:, 1] = -x[:, 0] + 0.1 * rng.normal(size=500)
    x[rng.random((500, 20)) < 0.2] = np.nan
    x[:, 5] = 3.0
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`c.{i}` double" for i in range(20))).repartition(5)
    got = {(r["left_column"], r["right_column"]): r for r in profile.correlation_matrix(df).collect()}
    assert len(got) == 400
    for i in range(20):
        for j in range(20):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[f"c.{i}", f"c.{j}"]
            assert r["n"] == both.sum() and (r["r"] is None if 5 in (i, j) else abs(r["r"] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9)
    assert [(r["left_column"], r["right_column"]) for r in profile.correlations(df, top=1).collect()] == [("c.0", "c.1")]
    assert profile.correlations(df.select("`c.0`")).collect() == [] and all(r["n"] == 0 and r["r"] is None for r in profile.correlation_matrix(df.limit(0)).collect())


def test_semantic_types(spark):
    rows = [(i, i % 3, float(i), f"2024-01-{i % 28 + 1:02}", "x" * 150 + str(i), None, i % 2 == 0, i) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, small int, v double, day string, note string, none string, flag boolean, row_id int")
    assert {r["name"]: r["kind"] for r in profile.semantic_types(df).collect()} == {"n": "id", "small": "numeric", "v": "numeric", "day": "datetime", "note": "text", "none": "unknown", "flag": "boolean", "row_id": "id"}
    assert {r["name"]: r["kind"] for r in profile.semantic_types(df.limit(0)).collect()}["note"] == "unknown"


def test_places_in_an_order(spark):
    """Also where nearly all rows have one value."""
    from quarrykit.operators.order import placed

    rows = [(7 if i % 10 else i, i) for i in range(5000)]
    got = placed(spark.createDataFrame(rows, "v int, id int").repartition(9), ["v", F.desc("id")], "place").collect()
    want = sorted(rows, key=lambda r: (r[0], -r[1]))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(5000))
    assert placed(spark.createDataFrame([], "v int"), ["v"], "place").collect() == []


def test_windows_leave_in_parts(spark):
    """Pieces of a batch leave a task in parts of some characters, texts longer than these too, each with its key and number."""
    texts = ["", None, "x" * 950 + ". " + "y" * 3000, "One sentence. " * 400, "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    got = [tuple(r) for r in chunk.sentence_windows(df, "id", "t", most=2000).collect()]
    assert got == [(i, n, piece) for i, t in enumerate(texts) for n, piece in enumerate(chunk.windows(t or "", 1000, 200))]


def test_a_search_makes_only_its_terms(spark):
    """Lengths stand in rows of their own, so that a search needs no other term; it gives what the search in the row gives."""
    df = spark.createDataFrame([(1, "well oil well"), (2, "oil gas"), (3, None), (4, "the of"), (5, "gas gas gas field")], "id long, t string")
    postings = retrieve.index_terms(df, "id", "t")
    assert sorted((r["id"], r["dl"], r["tf"]) for r in postings.filter("term is null").collect()) == [(1, 3, 0), (2, 2, 0), (3, 0, 0), (4, 0, 0), (5, 4, 0)]
    for query in (["well", "gas", "gas"], ["nowhere"], []):
        want = retrieve.bm25(df, "t", query).select("id", "score").collect() if query else []
        found = retrieve.search_index(postings, "id", query)
        assert [(r["id"], round(r["score"], 12)) for r in found.collect()] == [(r["id"], round(r["score"], 12)) for r in want]
    assert retrieve.term_statistics(postings).count() == 4
