"""Reports of several sheets in one commit."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillmark.operators import report
from quillmark.sources import report_store


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(f"u{k}", f"Post {k}", ["US", "EU", "Korea", "Asia"][k % 4], datetime.date(2026, 6, 1) + datetime.timedelta(days=k), k % 5) for k in range(40)]
    return spark.createDataFrame(rows, "url string, title string, region string, deadline date, tier int")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("Ada", "ETH"), ("Bob", None)], "name string, institute string")


def read(spark, path, **options):
    return {(r.sheet, r.key): r.cells for r in spark.read.format("report").options(**options).load(path).collect()}


def test_one_commit(spark, tmp_path, jobs, people):
    spark.dataSource.register(report_store.Report)
    path, day = f"file://{tmp_path}/r", F.lit(datetime.date(2026, 6, 1))
    counts = report_store.write(report.workbook(jobs, people, day), path)
    assert counts == {"Dashboard": 5, "EU": 10, "Korea": 10, "Other": 10, "PIs": 2, "US": 10}
    got = read(spark, path)
    assert len(got) == 47 and got["US", "u0"]["Title"] == "Post 0" and got["PIs", "Ada"]["Institute"] == "ETH" and got["Dashboard", "All"]["n"] == "40" and got["Dashboard", "All"]["week"] == "8"
    assert not report.complete(sorted({s for s, _ in got}))
    first = report_store.manifest(path)
    assert all(f["new"] for f in first["files"])

    changed = jobs.withColumn("title", F.when(F.col("url") == "u4", "Changed").otherwise(F.col("title"))).where("url <> 'u5'")
    report_store.write(report.workbook(changed, people, day), path)
    second = report_store.manifest(path)
    new = {(f["sheet"], f["part"]) for f in second["files"] if f["new"]}
    assert second["version"] == 2 and {s for s, _ in new} <= {"US", "EU", "Dashboard"} and len(new) <= 3  # nothing else is written
    now = read(spark, path)
    assert now["US", "u4"]["Title"] == "Changed" and ("EU", "u5") not in now and now["Dashboard", "All"]["n"] == "39"
    assert read(spark, path, version="1") == got


def test_failed_write_leaves_the_old_report(spark, tmp_path, jobs, people):
    spark.dataSource.register(report_store.Report)
    path, day = f"file://{tmp_path}/r", F.lit(datetime.date(2026, 6, 1))
    assert report_store.manifest(path) == {"version": 0, "files": []}
    report_store.write(report.workbook(jobs, people, day), path)
    before = read(spark, path)
    bad = report.workbook(jobs.withColumn("title", F.when(F.col("url") == "u7", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.lit("new"))), people, day)
    with pytest.raises(Exception):  # noqa: B017
        bad.repartition("sheet", "part").write.format("report").mode("overwrite").option("path", path).save()
    assert read(spark, path) == before and report_store.manifest(path)["version"] == 1
