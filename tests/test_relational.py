import datetime
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import relational as r


def walked(rows, limit):
    out, seen = set(), {}
    for page, pos, url, title in sorted(x for x in rows if x[2] and x[3] and x[3].strip()):
        urls, titles = seen.setdefault(page, (set(), set()))
        low = title.strip().lower()
        if url not in urls and low not in titles and len(urls) < limit:
            urls.add(url)
            titles.add(low)
            out.add((page, pos))
    return out


@pytest.mark.parametrize("limit", [1, 7, 200])
def test_two_key_dedup_equals_the_walk(spark, limit):
    pick = random.Random(limit)
    rows = [(pick.choice([1, 1, 1, 2, 3]), i, pick.choice(["", None, *"abcdefghijklmnopqrst"]), pick.choice(["", " ", None, *"ABCDEFghijklmnopqrstuvwxyzab"])) for i in range(400)]
    df = spark.createDataFrame(rows, "page int, pos int, url string, title string")
    # All pages in one pass, all in rounds, and some in either.
    for page_rows in (10_000, 0, 90):
        got = r.two_key_dedup(df, "page", "pos", F.col("url"), F.col("title"), limit, page_rows).collect()
        assert {(x.page, x.pos) for x in got} == walked([tuple("" if v is None else v for v in x) for x in rows], limit)
        assert len(got) == len({(x.page, x.pos) for x in got})


def test_two_key_dedup_settles_chains(spark):
    """Each row shares its url with the one before it or its title with the next: every second one stays."""
    rows = [(1, i, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(16)]
    df = spark.createDataFrame(rows, "page int, pos int, url string, title string")
    for page_rows in (100, 3):
        assert {x.pos for x in r.two_key_dedup(df, "page", "pos", F.col("url"), F.col("title"), page_rows=page_rows).collect()} == set(range(0, 16, 2))
    assert r.two_key_dedup(df.limit(0), "page", "pos", F.col("url"), F.col("title")).count() == 0


def test_degraded_compares_with_the_day_before_only(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(day, 10, 10, 1.0), (day + datetime.timedelta(1), 8, 10, 0.8), (day + datetime.timedelta(3), 7, 10, 0.7), (day + datetime.timedelta(4), 0, 4, 0.0)]
    got = r.degraded(spark.createDataFrame(rows, "day date, ok long, total long, ratio double")).orderBy("day").collect()
    assert [x.degraded for x in got] == [False, True, False, True]
    assert [x.drop is None for x in got] == [True, False, True, False]
