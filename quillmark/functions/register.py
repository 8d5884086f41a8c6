"""The library's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillmark.functions import employer, extract, korean, people, terms
from quillmark.functions import text as X
from quillmark.sources.cards import parse_cards

_TITLE = (r"trim(regexp_replace(lower(t), '\\s+', ' '))", r"post[- ]?doc(toral|torate)?\\b", r"^(postdoc|research) (position|fellowship|fellow|researcher|research associate|associate)( in| on| for)?\\b")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """Makes the Python functions, and views of the JVM ones as SQL functions, known to the session."""
    spark.udf.register("strip_accents", X.strip_accents)
    spark.udf.register("strip_html", X.strip_html)
    spark.udf.register("seq_ratio", X.sequence_ratio)
    spark.udf.register("posting_fields", extract._fields)
    spark.udf.register("extract_sections", extract._fields)
    spark.udf.register("extract_deadline", extract.deadline_of)
    spark.udf.register("extract_pi", people.leader_of)
    spark.udf.register("extract_terms", terms.terms)
    spark.udf.register("extract_employer", employer.employer_of)
    spark.udf.register("valid_name", people.valid_name)
    spark.udf.register("korean_fields", korean.korean_fields)
    spark.udtf.register("parse_cards", parse_cards)
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION norm_text(t STRING) RETURNS STRING RETURN trim(regexp_replace(lower(t), '\\s+', ' '))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(x, y, (a, b) -> coalesce(a, 0D) * coalesce(b, 0D)), 0D, (s, v) -> s + v)"
        " / nullif(sqrt(aggregate(x, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(y, 0D, (s, v) -> s + v * v)), 0D)"
    )
    base, kind, lead = _TITLE
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_title(t STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(regexp_replace({base}, '{kind}', 'postdoc'), '{lead}', ''), '\\\\s+', ' '))")
    folded = f"translate(t, '{X.ACCENTED}', '{X.PLAIN}')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION norm_inst(t STRING) RETURNS STRING RETURN "
        f"trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace({folded}, '[,.]', ' ')), '\\\\s+', ' ')), '^the ', ''), ' (inc|ltd|gmbh|llc)$', ''))"
    )
    cases = " ".join(f"WHEN lower(t) RLIKE {_quoted(p)} THEN {_quoted(label)}" for label, p in korean.FIELDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION infer_field(t STRING) RETURNS STRING RETURN CASE {cases} END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION minhash_sig(t STRING) RETURNS ARRAY<BIGINT> RETURN transform(sequence(1L, 128L), k -> array_min(transform("
        "array_distinct(transform(sequence(1, greatest(length(t) - 2, 1)), i -> cast(conv(substring(md5(substring(t, i, 3)), 1, 8), 16, 10) AS BIGINT) % 2147483647)), "
        "x -> ((k * 1103515245 % 2147483647 + 1) * x + k * 12345677 % 2147483647) % 2147483647)))"
    )
