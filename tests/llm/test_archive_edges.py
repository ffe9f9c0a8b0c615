"""Archives of odd pages: packages that roll over, tied page ids, very long payloads, clashing columns, no rows."""

import hashlib

import pytest

from quarrykit.llm import archive, common


@pytest.mark.parametrize("few", [True, False])
def test_odd_pages(spark, monkeypatch, few):
    monkeypatch.setattr(archive, "MOST_RECORDS", 3)  # many packages
    if not few:
        monkeypatch.setattr(common, "SMALL", 0)
    long, same = "x" * 3_000_000, "y" * 2000
    rows = [(1, "a", same), (2, None, same), (2, "b", same), (3, "c", long), (4, "d", None), (5, "e", ""), (6, "f", "short"), (7, "g", "short"), (None, "h", same), (9, "i", "ü" * 600), (10, "j", "ü" * 600)]
    pages = spark.createDataFrame([(*r, "clash", 1, True) for r in rows], "page_id long, url string, html string, digest string, last int, large boolean").coalesce(1)
    manifest = archive.write_packages(pages)
    assert manifest.count() == 4 and sum(r["records"] for r in manifest.collect()) == len(rows)
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in archive.read_packages(manifest).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    last = {same: 2, "ü" * 600: 10}
    want = [(i, u, "revisit" if last.get(t, i) != i else "response", len((t or "").encode()), sha(t), last[t] if last.get(t, i) != i else None) for i, u, t in rows]
    assert got == sorted(want, key=str)
    assert archive.read_packages(archive.write_packages(pages.limit(0))).collect() == []
