from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from citewright.llm import queries, reputation

PAGES = [
    (1, "http://A.Example.net/en/x?y=1#z"), (2, "https://example.net/fr/"), (3, "http://m.example.com/de/"), (4, "http://example.com/Den/"),
    (5, "ftp://x.org/fr/1"), (6, "http://org/fr/"), (7, "http://borg/fr/"), (8, "http://good.example.com?q=/de/"), (9, "no address"), (10, None),
    (11, ""), (12, "://"), (13, "http://bad.example.org/a"), (14, "http://net"), (15, "http://net/"), (16, "http://bad.example.org:80/a"),
    (17, "http://xnet/en/"), (18, "http://u@h.example.net/EN/"), (19, "a://b://c.net/x"), (20, "http://" + "a." * 3000 + "com/" + "p" * 50_000),
]


def test_equals_sql(spark):
    rows = PAGES + [(100 + n, f"http://bad.example.org/{n}") for n in range(60)] + [(200 + n, f"http://h{n}.example.com/{n}") for n in range(40)]
    rows += [(1, PAGES[0][1]), (None, "http://bad.example.org/b")]
    rows += [(400 + n, f"http://{host}/{n}") for n, host in enumerate(["a.b.co.uk:8080", "b.co.uk", "co.uk", "uk", "z.de", "com.au", "q.xco.uk"])]
    labels = [(100 + n, int(n % 9 == 0), 0) for n in range(60)] + [(200 + n, 1, int(n % 11 == 0)) for n in range(40)]
    labels += [(4, None, 0), (8, 1, None), (8, 0, None), (13, 0, None), (4, None, 1), (100, 0, 1), (9999, 1, 0), (None, 1, 0), (400, 1, 0), (401, 1, 0), (404, 0, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "mean": F.lit(1)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("page", F.lit(1))
    found = reputation.judged(pages, marks, queries.URL_RULES)
    got = sorted(map(tuple, found.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    con.register("labels", marks.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    assert got == sorted(con.execute(queries.OP5_SQL).fetchall(), key=str)
    verdicts = {row[0]: (row[3], row[4]) for row in got}
    assert verdicts[1] == ("example.net/en/", "allow") and verdicts[2] == ("net/", "block") and verdicts[14] == (None, verdicts[14][1])
    assert verdicts[13] == (None, "block") and verdicts[200] == (None, "allow") and verdicts[6] == ("org/fr/", "allow") and verdicts[7][0] is None


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_tables(spark, labelled):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = reputation.judged(pages if labelled else pages.limit(0), labels, queries.URL_RULES)
    assert found.count() == (len(PAGES) if labelled else 0)


def test_few_labels_lean_on_the_domain(spark):
    rows = [(n, f"http://big{n % 3}.good.com/") for n in range(90)] + [(100 + n, f"http://big{n % 3}.bad.com/") for n in range(90)]
    rows += [(300, "http://new.good.com/"), (301, "http://new.bad.com/")]
    labels = [(n, int(n % 10 > 0), 0) for n in range(90)] + [(100 + n, int(n % 10 == 0), 0) for n in range(90)]
    found = reputation.judged(
        spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ()
    )
    mean = {row.page_id: row.posterior for row in found.collect()}
    assert mean[300] > 0.8 and mean[301] < 0.2


def test_names_under_a_country_are_domains_of_their_own(spark):
    rows = [(n, f"http://h{n % 3}.good.co.uk/") for n in range(90)] + [(100 + n, f"http://h{n % 3}.bad.co.uk/") for n in range(90)]
    rows += [(300, "http://new.good.co.uk/"), (301, "http://new.bad.co.uk/")]
    labels = [(n, int(n % 10 > 0), 0) for n in range(90)] + [(100 + n, int(n % 10 == 0), 0) for n in range(90)]
    found = reputation.judged(
        spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ()
    )
    mean = {row.page_id: row.posterior for row in found.collect()}
    assert mean[300] > 0.8 and mean[301] < 0.2
