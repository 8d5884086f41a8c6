"""Relevance of postings to a profile: ordered exclusion, keyword score and the order of a list."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as X


@dataclass(frozen=True)
class Profile:
    """What a reader is looking for; read once on the driver."""

    keywords: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    regions: dict[str, int] = field(default_factory=lambda: {"US": 1, "EU": 2, "Korea": 3, "Asia": 4, "Other": 5})
    stale_days: int = 120
    #: Words in a title that make a post one for students, for others than researchers, or for faculty; that no title has;
    #: and that say that a post is of the reader's field.
    student_titles: tuple[str, ...] = ()
    other_titles: tuple[str, ...] = ()
    faculty_titles: tuple[str, ...] = ()
    garbage_titles: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()

    @classmethod
    def from_yaml(cls, text: str) -> Profile:
        import yaml

        found = yaml.safe_load(text) or {}
        words = ("keywords", "exclude", "student_titles", "other_titles", "faculty_titles", "garbage_titles", "signals")
        return cls(**{w: tuple(found.get(w) or ()) for w in words}, regions=dict(found.get("regions") or cls().regions), stale_days=int(found.get("stale_days", 120)))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; a rule named ``keep`` is an escape and ends the search."""
    out = None
    for name, holds in rules:
        value = F.lit(None).cast("string") if name == "keep" else F.lit(name)
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out


def exclusion(profile: Profile, as_of: Column) -> Column:
    """Why a posting is left out, or null. The order of rules matters: a title that says postdoc escapes the
    rules below it."""
    title = F.lower(F.coalesce("title", F.lit("")))
    blob = F.concat_ws(" ", title, F.lower(F.coalesce("field", F.lit(""))))
    year = F.regexp_extract(title, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    words = "|".join(map(_quoted, profile.exclude)) or r"(?!)"
    return first_reason(
        [
            ("expired", F.col("deadline") < as_of),
            ("past year", (year != "") & (F.when(year != "", year).cast("int") < F.year(as_of))),
            ("stale", F.col("deadline").isNull() & (F.datediff(as_of, F.col("posted")) > profile.stale_days)),
            ("keyword", blob.rlike(words)),
            ("keep", title.rlike(r"post-?\s?doc")),
            ("student", title.rlike(r"\bph\.?d\b|doctoral (student|candidate)|\bmaster")),
            ("not research", title.rlike(r"\b(nurse|accountant|administrator|sales|secretary)\b")),
            ("faculty", title.rlike(r"\b(professor|lecturer|faculty)\b") & (F.col("region") != "Korea")),
            ("garbage", X.is_garbage_title("title")),
        ]
    )


def _quoted(word: str) -> str:
    import re

    return re.sub(r"([^\w\s])", r"\\\1", word.lower())


# Titles that say that a post is for researchers, whatever else they say.
RESEARCH_TITLES = ("postdoc", "post-doc", "postdoctoral", "post-doctoral", "research fellow")


def _text(jobs: DataFrame, *names: str) -> Column:
    """The columns that ``jobs`` has, in lower case, with blanks between."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names if n in jobs.columns)))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def _date(name: str) -> Column:
    """An ISO date, or null."""
    return F.try_to_timestamp(F.substring(F.col(name).cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def left_out(jobs: DataFrame, profile: Profile, as_of: Column, korean: Column | None = None) -> Column:
    """Why a report leaves a posting out, or null, by the first rule that holds: its deadline has passed; its title has
    a year before this one; it was posted in an earlier year and has no deadline; its title, field or keywords have an excluded
    word; its title is one for students, or for others than researchers (a research title ends the search and keeps
    the post); one for faculty, but in Korea or with a research title; a title is too short (4 characters with
    Hangul, else 10) or none; ``korean``, if given, doesn't hold of a Korean title. Descriptions aren't looked at."""
    title = _text(jobs, "title")
    straight = F.regexp_replace(title, "[\u2018\u2019]", "'")
    research = _holds(title, RESEARCH_TITLES)
    years = F.transform(F.regexp_extract_all(title, F.lit(r"(?<!\d)(20\d{2})(?!\d)")), lambda y: y.cast("int"))
    due, posted = (_date(c) if c in jobs.columns else F.lit(None).cast("date") for c in ("deadline", "posted"))
    given = F.coalesce(F.col("deadline").cast("string"), F.lit("")) != "" if "deadline" in jobs.columns else F.lit(False)
    hangul = title.rlike("[가-힣]")
    student, other = _holds(title, profile.student_titles), _holds(straight, profile.other_titles)
    region = F.coalesce(F.col("region"), F.lit("")) if "region" in jobs.columns else F.lit("")
    return first_reason(
        [
            ("expired", F.coalesce(due < as_of, F.lit(False))),
            ("past year", F.exists(years, lambda y: y < F.year(as_of))),
            ("stale", ~given & F.coalesce(F.year(posted) < F.year(as_of), F.lit(False))),
            ("keyword", _holds(_text(jobs, "title", "field", "keywords"), profile.exclude)),
            ("keep", student & research),
            ("student", student),
            ("keep", other & research),
            ("not research", other),
            ("faculty", _holds(title, profile.faculty_titles) & (region != "Korea") & ~research),
            ("short", F.length(F.trim(title)) < F.when(hangul, 4).otherwise(10)),
            ("garbage", _holds(title, profile.garbage_titles)),
            ("not of the field", hangul & ~korean if korean is not None else F.lit(False)),
        ]
    )


def worth_mailing(jobs: DataFrame, profile: Profile) -> Column:
    """Whether a mail takes a posting: no excluded word in title, field, keywords or description; no title for others than
    researchers or for faculty (but in Korea), unless it is a research title too; a real title of 10 characters or more; and a
    match score, or an institution of tier 1 or 2, or a word of the reader's field."""
    blob, title = _text(jobs, "title", "field", "keywords", "description"), _text(jobs, "title")
    research = _holds(title, RESEARCH_TITLES)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in jobs.columns else F.lit(0)
    region = F.coalesce(F.col("region"), F.lit("")) if "region" in jobs.columns else F.lit("")
    bad = _holds(blob, profile.exclude) | (_holds(title, profile.other_titles) & ~research) | (_holds(title, profile.faculty_titles) & (region != "Korea") & ~research)
    bad = bad | (F.length(F.trim(title)) < 10) | _holds(title, profile.garbage_titles)
    return ~bad & ((number("match_score") != 0) | number("tier").between(1, 2) | _holds(blob, profile.signals))


def scored(jobs: DataFrame, profile: Profile) -> DataFrame:
    text = F.concat_ws(" ", "title", "field", "description")
    return jobs.withColumn("score", X.keyword_score(text, list(profile.keywords)) if profile.keywords else F.lit(0.0))


def ranked(jobs: DataFrame, profile: Profile) -> DataFrame:
    """In the order of region, tier, h-index and score; equal rows by url."""
    pairs = [F.lit(x) for kv in profile.regions.items() for x in kv]
    place = F.coalesce(F.create_map(*pairs)[F.col("region")], F.lit(len(profile.regions) + 1))
    return jobs.orderBy(place, F.asc_nulls_last("tier"), F.desc_nulls_last("h_index"), F.desc("score"), "url")
