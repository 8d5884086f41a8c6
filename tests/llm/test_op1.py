from pyspark.sql import functions as F

from quillmark.llm import op1_fixity as op1
from tests.llm.conftest import SF


def test_audit_finds_what_a_full_comparison_finds(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in op1.query(pages).collect()}
    a = {r.id: r for r in op1.records(pages).collect()}
    b = {r.id: r for r in op1.records(op1.replica_of(pages)).collect()}
    at = 0
    for i in sorted(a):
        want = "missing" if i not in b else "intact" if a[i].digest == b[i].digest else "damaged"
        assert (got[i].status, got[i].record_offset, got[i].record_sha256) == (want, at, a[i].digest)
        at += a[i].size
    assert len(got) == len(a) and {"missing", "damaged"} <= {r.status for r in got.values()}


def test_descent_touches_only_what_differs(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 50) for i in range(300)], "page_id long, url string, html string")
    ours = op1.laid_out(op1.records(pages)).selectExpr("*", "offset div 400 as range").cache()
    levels = op1.tree(op1.leaves(ours))
    assert len(levels) >= 3 and levels[-1].count() == 1
    assert op1.mismatching(levels, levels).count() == 0
    other = ours.selectExpr("id", "c", "if(id = 123, 'bad', digest) digest", "size", "offset", "range")
    bad = op1.mismatching(levels, op1.tree(op1.leaves(other))).collect()
    assert [r.node for r in bad] == [ours.where("id = 123").first().range]


def test_odd_rows(spark):
    kind = "page_id long, url string, html string, digest int"
    a = [(1, None, None, 1), (2, "u", "", 1), (None, "u", "x", 1), (3, "u", "y" * 3_000_000, 1), (4, "u", "same", 1), (4, "u", "same", 1), (5, "u", "gone", 1)]
    b = [(1, None, "", 1), (2, "u", "", 1), (None, "u", "x", 1), (3, "u", "y" * 3_000_000, 1), (4, "u", "same", 1), (4, "u", "SAME", 1), (6, "u", "new", 1)]
    x, y = (op1.records(spark.createDataFrame(r, kind)) for r in (a, b))
    ours, found = op1.audit(x, y)
    assert sum(r.c for r in ours.collect()) == 7
    assert sorted((r.id, r.status) for r in found.collect())[-2:] == [(5, "missing"), (6, "extra")]
    assert {(r.id, r.status) for r in found.collect()} == {(1, "damaged"), (4, "damaged"), (5, "missing"), (6, "extra")}
    none = x.limit(0)
    assert op1.audit(none, none)[1].count() == 0
    assert {r.status for r in op1.audit(x, none)[1].collect()} == {"missing"} and sum(r.n for r in op1.audit(x, none)[1].collect()) == 7
    assert {r.status for r in op1.audit(none, y)[1].collect()} == {"extra"} and sum(r.n for r in op1.audit(none, y)[1].collect()) == 7


def test_a_replica_has_its_own_places(spark):
    """Records of the replica that stand elsewhere are found; what a missing or longer one shifts is not blamed."""
    at, rows = 0, []
    for i in range(400):
        rows.append((i, f"http://h/{i}", "x" * (30 + i % 7), at))
        at += 100 + len(f"http://h/{i}") + i % 7
    kind = "page_id long, url string, html string, at long"
    copy = [list(r) for r in rows if r[0] != 50]
    copy[100][2] += "grown"
    by = {r[0]: r for r in copy}
    by[210][3], by[211][3] = by[211][3], by[210][3]  # exchanged
    by[300][3] = 10**9  # at the file's end
    ours = op1.records(spark.createDataFrame(rows, kind))
    theirs = op1.records(spark.createDataFrame([tuple(r) for r in copy], kind), offset_col="at")
    _, found = op1.audit(ours, theirs, range_bytes=1000)
    got = {r.id: r.status for r in found.collect()}
    assert got[50] == "missing" and got[copy[100][0]] == "damaged" and got[210] == got[211] == "moved" and got[300] == "moved"
    assert len(got) < 20 and {s for i, s in got.items() if i not in (50, copy[100][0])} == {"moved"}  # 300's range alone besides
    plain = op1.records(spark.createDataFrame([tuple(r) for r in copy], kind))
    assert {r.id: r.status for r in op1.audit(ours, plain, range_bytes=1000)[1].collect()} == {50: "missing", copy[100][0]: "damaged"}


def test_repeated_records_without_ids(spark):
    rows = [(None, "u", f"body {i % 3}") for i in range(60)] + [(7, "u", "x")]
    other = [(None, "u", f"body {i % 3 if i < 57 else 9}") for i in range(60)] + [(7, "u", "x")]
    kind = "page_id long, url string, html string"
    ours, found = op1.audit(*(op1.records(spark.createDataFrame(r, kind)) for r in (rows, other)), range_bytes=500)
    assert sum(r.c for r in ours.collect()) == 61
    assert sorted((r.status, r.n) for r in found.collect()) == [("damaged", 1)] * 3


def test_ranges_of_a_long_replica_are_bounded(spark):
    ours = spark.createDataFrame([(i, "u", "x" * 50) for i in range(3)], "page_id long, url string, html string")
    long = spark.createDataFrame([(i, "u", "x" * 50 + ("!" if i == 1 else "")) for i in range(10_000)] + [(None, "u", str(i)) for i in range(2_000)], "page_id long, url string, html string")
    for a, b in ((ours, long), (ours.limit(0), long)):
        x, y = op1.records(a), op1.records(b)
        laid = op1.laid_out(x.drop("place")).selectExpr("*", "offset div 4096 as range")
        placed = op1.overhang(op1.laid_out(op1.ranged(y, op1.beginnings(laid))), laid, 4096)
        assert max(r.b for r in placed.groupBy("range").agg(F.sum(F.col("size") * F.col("c")).alias("b")).collect()) < 2 * 4096
        assert placed.count() == 12_000
        got = op1.audit(x, y, 4096)[1].groupBy("status").agg(F.sum("n").alias("n")).collect()
        n = a.count()
        assert {r.status: r.n for r in got} == ({"extra": 11_997, "damaged": 1} if n else {"extra": 12_000})
    back = op1.audit(op1.records(long), op1.records(ours), 4096)[1].groupBy("status").agg(F.sum("n").alias("n")).collect()
    assert {r.status: r.n for r in back} == {"missing": 11_997, "damaged": 1}
