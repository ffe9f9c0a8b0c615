"""Files of several encodings and shapes."""

import json

import pytest
from pyspark.sql import functions as F

from quarrykit.sources import tables

TEXT = 'name,n,note\nMüller,1,"a, b"\nÑandú,2,"two\nlines ""quoted"""\nçédille,3,\n'
PLAIN = "name,n,note\nMüller,4,x\n"


def test_encodings_read_alike(spark, tmp_path):
    for i, (encoding, text) in enumerate([("utf-8", TEXT), ("utf-8-sig", TEXT), ("latin-1", TEXT), ("utf-16", TEXT), ("latin-1", PLAIN), ("utf-8", PLAIN)]):
        (tmp_path / f"{i}.csv").write_bytes(text.encode(encoding))
    found = {r["path"].rpartition("/")[2]: (r["encoding"], r["spans"]) for r in tables.surveyed(spark, str(tmp_path)).collect()}
    assert found == {"0.csv": ("UTF-8", True), "1.csv": ("UTF-8", True), "2.csv": ("ISO-8859-1", True), "3.csv": ("UTF-16LE", True), "4.csv": ("ISO-8859-1", False), "5.csv": ("UTF-8", False)}
    for i in range(4):
        rows = tables.read_table(spark, str(tmp_path / f"{i}.csv")).orderBy("n").collect()
        assert [tuple(r) for r in rows] == [("Müller", 1.0, "a, b"), ("Ñandú", 2.0, 'two\nlines "quoted"'), ("çédille", 3.0, None)]
    all_of_them = tables.read_table(spark, str(tmp_path), "csv")
    assert all_of_them.dtypes == [("name", "string"), ("n", "double"), ("note", "string")] and all_of_them.count() == 14 and all_of_them.filter("name = 'Müller'").count() == 6


def test_large_files_are_split(spark, tmp_path):
    (tmp_path / "long.csv").write_text("k,v\n" + "".join(f"{i},{'x' * 100}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        df = tables.read_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4 and df.agg(F.count_distinct("k")).first()[0] == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("data, want", [([{"a": 1, "b": "x"}, {"a": 2}], [(1, "x"), (2, None)]), ({"a": [1, 2], "b": ["x", "y"]}, [(1, "x"), (2, "y")]), ({"a": [1, 2], "b": ["x"]}, [(1, "x"), (2, None)])])
def test_json_shapes(spark, tmp_path, data, want):
    (tmp_path / "d.json").write_text(json.dumps(data, indent=1))
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "d.json")).orderBy("a").collect()] == want


def test_other_json_and_texts(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": {"b": 1}, "c": [1]}')
    assert [r["text"] for r in tables.read_table(spark, str(tmp_path / "d.json")).collect()] == ['{"a": {"b": 1}, "c": [1]}']
    for name, encoding in (("a.txt", "latin-1"), ("b.txt", "utf-8-sig")):
        (tmp_path / name).write_bytes("Größe\n\n  zwei \n".encode(encoding))
        assert [r["text"] for r in tables.read_table(spark, str(tmp_path / name)).collect()] == ["Größe", "zwei"]
