"""What keeps work in proportion to its input: rows dealt to all tasks, state and batches that stay small."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark import shared
from quillmark.functions import dates, extract, terms
from quillmark.operators import dedup, graph, greedy
from quillmark.plans import catalog
from tests.conftest import SF


@pytest.mark.parametrize("name", ["k04_terms", "k05_leaders", "k07_posting_chain", "m07_articles"])
def test_long_work_is_dealt_to_all_tasks(spark, name):
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 16


def test_texts_are_dealt_with_repeated_keys(spark):
    one = spark.createDataFrame([(1, f"Contact: a{k}@b.org") for k in range(200)] + [(None, None)], "k int, t string").coalesce(1)
    found = extract.posting(one, "k", "t")
    assert found.rdd.getNumPartitions() >= 16 and found.count() == 201
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_readers_share_the_tokens_of_a_text():
    text = "Salary: EUR 900 per month. Duration: 2 years."
    assert terms.tokens(text) is terms.tokens(text)
    assert (terms.salary(text), terms.duration(text)) == ("EUR 900 per month", "2 years")


def test_days_before_year_one(spark):
    days = spark.range(1).select(dates.relative(F.lit("30000 months ago"), F.lit("2024-01-01").cast("date")).alias("d"), F.lit("2024-01-01").cast("date").alias("e"))
    told = days.select(dates.told(F.col("d")).alias("d"), dates.told(F.col("e")).alias("e"), dates.told(F.lit(None).cast("date")).alias("n")).first()
    assert told.d == "0442-11-20 (BC)"
    assert told.e == "2024-01-01" and told.n is None


def test_pages_are_parsed_in_slices(spark):
    from quillmark.sources import html

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(600)), "url": ["http://a/"] * 600, "html": ["<a href='b'>c</a>"] * 600})
    assert [b.num_rows for b in html._slices(iter([batch]))] == [256, 256, 88]
    pages = spark.createDataFrame([(k, "http://a/", "<title>t</title><a href='b'>c</a>") for k in range(600)] + [(600, None, None)], "page_id long, url string, html string").coalesce(1)
    assert {tuple(r)[1:] for r in html.links(pages).collect()} == {("http://a/b", "c")} and html.links(pages).count() == 600
    assert html.records(pages).where("title = 't' and n_links = 1 and pairs = '{}'").count() == 600


def test_joins_of_lines_are_dealt_by_their_number(spark, monkeypatch):
    from quillmark.plans import relational
    from quillmark.shared import parts_for

    assert parts_for(spark, 10_000_000) == 20 and parts_for(spark, 10) == 4
    monkeypatch.setattr(relational, "parts_for", lambda spark, rows: 33)
    assert catalog.QUERIES["c14_directed_edge_count"](spark, SF).rdd.getNumPartitions() == 33


@pytest.mark.parametrize("name", ["h04_dedup_components", "h05_dedup_fused", "h06_dedup_sequence_ratio", "h07_dedup_in_order"])
def test_joins_of_postings_broadcast_nothing_that_grows(spark, monkeypatch, name):
    """The size of a compressed file says little about the rows in it, so no plan may rest on it. Tables of few rows are broadcast; here no table is one, an empty one neither."""
    plans = []
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())

    def cut(df, name):
        told(df)
        return shared.cut(df, name)

    monkeypatch.setattr(shared, "FEW", -1)
    for module in (dedup, graph, greedy):
        monkeypatch.setattr(module, "cut", cut)
    told(catalog.QUERIES[name](spark, SF))
    assert any("SortMergeJoin" in p for p in plans)
    assert [line for p in plans for line in p.splitlines() if "Broadcast" in line] == []


def test_few_rows_may_be_broadcast(spark):
    some = spark.range(10)
    assert shared.counted(some) == 10 and shared.counted(spark.range(shared.FEW + 7)) == shared.FEW + 1
    joined = lambda side: spark.range(5).join(side, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in joined(shared.apart(some, 10)) and "Broadcast" not in joined(shared.apart(some)) + joined(shared.apart(some, shared.FEW + 1))
