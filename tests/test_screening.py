from difflib import SequenceMatcher
from math import log10

import pytest
from pyspark.sql import functions as F

from quillmark.functions import screening as S


def test_small_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.first_block(F.lit(" First part\nstill.\n \nSecond"))) == "First part\nstill."
    assert one(S.match_score(F.lit("Ada Byron"), F.lit("ada  byron"), F.lit("MIT"), F.lit("At MIT, Boston"), F.lit(1000))) == pytest.approx(1.3 + log10(1000) / 60)
    assert one(S.match_score(F.lit("Ada Byron"), F.lit("Zed Q"), F.lit(None).cast("string"), F.lit(""), F.lit(0))) is None
    like = SequenceMatcher(None, "ada byron", "ada b").ratio()
    assert one(S.match_score(F.lit("Ada Byron"), F.lit("Ada B"), F.lit(""), F.lit("x"), F.lit(0))) == pytest.approx(like)
    assert S.expanded_query("crispr", ["gene editing", "cas9"]) == '(crispr[Title/Abstract] OR "gene editing"[Title/Abstract] OR cas9[Title/Abstract])'
    none = F.lit(None).cast("string")
    assert one(S.lab_page(none)) is False and one(S.is_site(none)) is False and one(S.needs_browser(none)) is True and one(S.institute_of(none)) == "" and one(S.department(none)) is None
    assert one(S.department(F.lit("in the School of Life Sciences and Medicine, Basel"))).startswith("School of Life Sciences and Medicine") and one(S.department(F.lit("서울대 생명과학과 모집"))) == "생명과학과"
    assert one(S.country_in(none, [], [], {"france": "France"})) is None


def test_functions_under_sql_names(spark):
    from quillmark.functions import text as X
    from quillmark.functions.register import register
    from quillmark.operators import dedup

    register(spark)
    rows = [(1, "Post-Doctoral  Fellow in Cells"), (2, "The Université de Genève, Inc."), (3, "ab"), (4, "합성생물학 연구")]
    spark.createDataFrame(rows, "k long, t string").createOrReplaceTempView("named")
    df = spark.table("named")
    got = {r.k: r for r in spark.sql("SELECT k, norm_title(t) a, norm_inst(t) b, infer_field(t) c, minhash_sig(t) d, extract_pi('PI: Ada Byron.') e, extract_deadline('Deadline: 2026-03-01') f FROM named").collect()}
    want = {r.k: r for r in df.select("k", X.norm_title("t").alias("a"), X.norm_institute("t").alias("b")).collect()}
    signed = {r.k: r.signature for r in dedup.signatures(df, "k", "t").collect()}
    for k, r in got.items():
        assert (r.a, r.b, r.d, r.e, r.f) == (want[k].a, want[k].b, signed[k], "Ada Byron", "2026-03-01")
    assert got[4].c == "Synthetic Biology" and got[1].c is None
