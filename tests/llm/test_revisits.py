import random

import pytest
from pyspark.sql import functions as F

from tabulon.llm import revisits

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, key string, status string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("url,want", [
    ("HTTP://www.Example.com:80/a/?b=2&a=1&utm_source=x#f", "example.com/a?a=1&b=2"),
    ("https://user@m.example.com", "m.example.com"),
    ("example.com/Path/", "example.com/Path"),
    ("https://www2.example.com/?ref=1", "example.com"),
    ("", ""),
    ("HTTPS://www.www.example.com:443:80/a//?&b= 1 &a#x", "example.com/a?a&b= 1"),
    ("u@http://v@x.com", "x.com"),
    (" http://\nx.com::80 /y /\t", "x.com/y"),
])
def test_canonical_url(spark, url, want):
    assert spark.range(1).select(revisits.canonical_url(F.lit(url))).first()[0] == want


def test_canonical_url_is_its_own_canonical_form(spark):
    rng = random.Random(3)
    pieces = ["http://", "HTTPS://", "www.", "www2.", "a", "B.c", "@", ":", "80", "443", "/", "?", "&", "=", "#", " ", "\n", "ref=1", "utm_x", "x:", "İ"]
    urls = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(4000)]
    once = spark.createDataFrame([(u,) for u in urls], "u string").select("u", revisits.canonical_url(F.col("u")).alias("a"))
    bad = once.withColumn("b", revisits.canonical_url(F.col("a"))).filter("a <> b").collect()
    assert not bad


def test_points_that_fall_together(spark):
    """Many captures at one time are one point; the latest response strictly before them answers all."""
    rows = [(i, "h.com", 50, "response" if i % 2 else "revisit", {"etag": "e"}) for i in range(400)] + [(1000, "h.com", 40, "response", {"etag": "e"}), (1001, "h.com", 60, "revisit", {"etag": "e"})]
    got = {r.record_id: r.source_id for r in revisits.resolve(rows_of(spark, rows), 5).collect()}
    assert got.pop(1001) == 399 and len(got) == 200 and set(got.values()) == {1000}


def test_resolution(spark):
    rows = [
        (1, "http://a.com/x", 100, "response", {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}),
        (2, "https://www.a.com/x#f", 500_000, "revisit", {"etag": 'W/"1"', "date": "d2", "content-type": "no"}),
        (3, "http://a.com/x", 400_000, "response", {"ETag": '"2"', "Last-Modified": "m"}),
        (4, "http://a.com/x", 500_001, "revisit", {"Etag": '"2"', "ETAG": '"9"'}),
        (5, "http://a.com/x", 300_000, "revisit", {"etag": '"1"', "date": "d3"}),
        (6, "http://a.com/x", 100, "revisit", {"etag": '"1"'}),
        (7, "http://a.com/x", 600_000, "revisit", {"last-modified": "m"}),
        (8, "http://a.com/x", 600_000, "revisit", None),
        (9, None, 600_000, "revisit", {"etag": '"2"'}),
        (10, "http://a.com/x", None, "revisit", {"etag": '"2"'}),
    ]
    for blocks in (1, 3, 50):
        got = {r.record_id: r for r in revisits.resolve(rows_of(spark, rows), blocks).collect()}
        assert {k: (r.source_id, r.status) for k, r in got.items()} == {
            2: (3, "mismatch"), 4: (3, "resolved"), 5: (1, "resolved"), 6: (None, "no_earlier"),
            7: (3, "resolved"), 8: (3, "unverified"), 9: (None, "no_earlier"), 10: (None, "no_earlier"),
        }
        assert got[5].headers == {"etag": '"1"', "content-type": "t", "date": "d3"}
        assert got[2].headers == {"etag": 'W/"1"', "date": "d2", "content-type": "no"}


def test_repeated_and_empty(spark):
    rows = [(1, "u.com", 1, "response", {"etag": "a"})] * 3 + [(2, "u.com", 2, "revisit", {"etag": "a"})] * 2
    got = revisits.resolve(rows_of(spark, rows)).collect()
    assert len(got) == 2 and all(r.status == "resolved" and r.source_id == 1 for r in got)
    assert revisits.resolve(rows_of(spark, [])).count() == 0
