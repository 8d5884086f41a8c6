"""Report tables: sheets, dashboard counts, urgency, trends and their sinks."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import terms
from quillmark.functions.dates import urgency_colour
from quillmark.operators import ranking

#: Regions with a sheet of their own, in the order of their priority; all others share "Other".
REGIONS = ("US", "EU", "Korea")


def sheet(region: Column) -> Column:
    return F.when(region.isin(*REGIONS), region).otherwise("Other")


def tier_label(tier: Column, company: Column) -> Column:
    return F.when(company, "Company").when(tier.between(1, 4), F.concat(F.lit("T"), tier.cast("string"))).otherwise("")


def papers(c: str, n: int) -> list[Column]:
    """Title columns of the first ``n`` papers of an array of structs, "" where there are fewer."""
    return [F.coalesce(F.get(F.col(c), F.lit(k)).getField("title"), F.lit("")).alias(f"{c}_{k + 1}") for k in range(n)]


def rows(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Postings as report rows: sheet, labels, days to the deadline with a colour, and their rank on the sheet
    by tier (companies first), score and identifier."""
    days = F.datediff(F.col("deadline"), as_of)
    place = F.when(F.col("is_company"), 0).otherwise(F.coalesce("tier", F.lit(999)))
    told = jobs.withColumns({"sheet": sheet(F.col("region")), "tier_label": tier_label(F.col("tier"), F.col("is_company")), "days_left": days, "colour": urgency_colour(days), "__place": place})
    return ranking.ranked(told, ["sheet"], ["__place", F.desc_nulls_last("score"), "url"]).drop("__place")


# The columns of a report of postings and of leaders, and the sheets that a whole report has.
JOB_COLUMNS = (
    "Tier", "Title", "PI Name", "Institute", "Department", "Country", "Region", "Field", "Keywords", "Position Summary", "Responsibilities",
    "Preferred Qualifications", "Degree Required", "Skills/Techniques", "Requirements (Full)", "Salary", "Duration", "Contract Type",
    "Start Date", "Conditions (Full)", "Posted Date", "Deadline", "Application Materials", "Description", "Contact Email", "Info URL 1",
    "Info URL 2", "Info URL 3", "Job URL", "Job URL 2", "Lab URL", "Scholar URL", "Dept URL", "Match Score", "Source", "Status",
)
PI_COLUMNS = (
    "Name", "Institute", "Tier", "Country", "h-index", "Citations", "Fields", "Recommendation Score", "Recent Paper 1", "Recent Paper 2",
    "Scholar URL",
)
SHEETS = ("US", "EU", "Korea", "Other", "PIs", "Dashboard")


def filled(df: DataFrame, *names: str) -> Column:
    """The first of the columns that ``df`` has and that is filled, as text; else an empty string."""
    values = [F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*values, F.lit(""))


def job_columns(jobs: DataFrame, key: str) -> DataFrame:
    """``key`` and the report's columns of each posting. What is stored goes first, then what its terms say; a
    column that ``jobs`` lacks is empty."""
    at = lambda c, k, f=None: (F.coalesce(F.get(F.col(c), F.lit(k)) if f is None else F.get(F.col(c), F.lit(k)).getField(f), F.lit("")) if c in jobs.columns else F.lit(""))
    conditions = F.concat_ws(" ", filled(jobs, "conditions"), filled(jobs, "description"))
    needs = F.concat_ws(" ", filled(jobs, "requirements"), filled(jobs, "description"))
    told = jobs.withColumns({"__c": terms.terms(conditions, F.lit("")), "__r": terms.terms(needs, filled(jobs, "title"))})
    first = lambda *names, term=None: F.when(filled(jobs, *names) != "", filled(jobs, *names)).otherwise(F.coalesce(term, F.lit("")) if term is not None else F.lit(""))
    company = F.col("is_company") if "is_company" in jobs.columns else F.lit(False)
    tier = F.col("tier") if "tier" in jobs.columns else F.lit(None).cast("int")
    from_terms = {"Degree Required": ("degree", "__r"), "Salary": ("salary", "__c"), "Duration": ("duration", "__c"), "Contract Type": ("contract", "__c"), "Start Date": ("start_date", "__c")}
    stored = {
        "Title": ("title",), "PI Name": ("pi_name",), "Institute": ("institute",), "Department": ("department",), "Country": ("country",), "Region": ("region",), "Field": ("field",), "Keywords": ("keywords",),
        "Position Summary": ("summary", "pi_research_summary"), "Responsibilities": ("responsibilities",), "Preferred Qualifications": ("preferred",), "Skills/Techniques": ("skills",), "Requirements (Full)": ("requirements",),
        "Conditions (Full)": ("conditions",), "Posted Date": ("posted_date",), "Deadline": ("deadline",), "Application Materials": ("materials", "application_materials"), "Description": ("description",), "Contact Email": ("contact_email",),
        "Job URL": ("url",), "Lab URL": ("lab_url",), "Scholar URL": ("scholar_url",), "Dept URL": ("dept_url",), "Source": ("source",), "Status": ("status",),
    }
    score = F.col("match_score") if "match_score" in jobs.columns else F.lit(None).cast("double")
    made = {"Tier": tier_label(tier, F.coalesce(company, F.lit(False))), "Job URL 2": at("alt_urls", 0, "url"), "Match Score": score}
    made |= {f"Info URL {k + 1}": at("info_urls", k) for k in range(3)}
    made |= {label: first(name, term=F.col(f"{source}.{name}")) for label, (name, source) in from_terms.items()}
    made |= {label: filled(jobs, *names) for label, names in stored.items()}
    return told.select(key, *(made[c].alias(c) for c in JOB_COLUMNS))


def pi_columns(people: DataFrame, key: str) -> DataFrame:
    """``key`` and the report's columns of each leader; papers are an array of structs with a title."""
    tier = F.col("tier") if "tier" in people.columns else F.lit(None).cast("int")
    title = papers("papers", 2) if "papers" in people.columns else [F.lit("")] * 2
    made = {"Tier": tier_label(tier, F.lit(False)), "Recent Paper 1": title[0], "Recent Paper 2": title[1]}
    made |= {"Name": filled(people, "name"), "Institute": filled(people, "institute"), "Country": filled(people, "country"), "h-index": filled(people, "h_index"), "Citations": filled(people, "citations"), "Fields": filled(people, "fields"), "Recommendation Score": filled(people, "recommendation_score"), "Scholar URL": filled(people, "scholar_url")}
    return people.select(key, *(made[c].alias(c) for c in PI_COLUMNS))


def tier_totals(rows: DataFrame, by: list[str], tier: Column) -> DataFrame:
    """(by, top, middle, unranked): tiers 1 and 2, 3 and 4, and all others."""
    found = rows.groupBy(*by).agg(F.count_if(tier.isin(1, 2)).alias("top"), F.count_if(tier.isin(3, 4)).alias("middle"), F.count(F.lit(1)).alias("__all"))
    return found.select(*by, "top", "middle", (F.col("__all") - F.col("top") - F.col("middle")).alias("unranked"))


def complete(sheets: list[str]) -> list[str]:
    """The sheets that a stored report lacks; an empty list means that it is whole."""
    return [s for s in SHEETS if s not in sheets]


def subject(day: str, n_new: int, n_due: int) -> str:
    """The subject line of a digest, with what is new and what is due within a week."""
    parts = [f"{n_new} new posting{'s' * (n_new != 1)}"] + ([f"{n_due} due soon"] if n_due else [])
    return f"{day}: {', '.join(parts)}"


def dashboard(jobs: DataFrame, as_of: Column, dimensions: list[str]) -> DataFrame:
    """Counts by each dimension and in total, with how urgent the deadlines are, in one pass."""
    days = F.datediff(F.col("deadline"), as_of)
    return jobs.groupingSets([[F.col(c)] for c in dimensions] + [[]], *dimensions).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(days.between(0, 7)).alias("week"),
        F.count_if(days.between(8, 30)).alias("month"),
        F.count_if(days > 30).alias("later"),
        F.count_if(days.isNull()).alias("undated"),
    )


def increment(previous: DataFrame, new: DataFrame, dismissed: DataFrame, key: str = "url") -> DataFrame:
    """The previous report without dismissed rows, and the rows it hasn't got."""
    kept = previous.join(dismissed.select(key), key, "left_anti")
    fresh = new.join(previous.select(key), key, "left_anti").join(dismissed.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def write_sheets(report: DataFrame, path: str) -> None:
    """One folder a sheet; rewritten as a whole, so that a failed attempt leaves no half of a report."""
    report.repartition("sheet").sortWithinPartitions("sheet", "rank").write.mode("overwrite").partitionBy("sheet").parquet(path)


def email(counts: list[tuple[str, int]], best: list[tuple[str, str]], title: str) -> str:
    """A small HTML digest of counts and (label, url) pairs that have been collected already."""
    head = "".join(f"<li>{html.escape(k)}: {n}</li>" for k, n in counts)
    body = "".join(f'<tr><td><a href="{html.escape(u, quote=True)}">{html.escape(t)}</a></td></tr>' for t, u in best)
    return f"<h1>{html.escape(title)}</h1><ul>{head}</ul><table>{body}</table>"


def workbook(jobs: DataFrame, people: DataFrame, as_of: Column, key: str = "url", person: str = "name") -> DataFrame:
    """The whole report as cells (``sources.report_store``): a sheet of postings for each region, the leaders, and the
    dashboard, which is derived from the same rows in the same job."""
    from quillmark.sources.report_store import cells

    posts = job_columns(jobs.withColumn("__key", F.col(key)), "__key")
    posts = cells(posts, sheet(F.col("Region")), "__key")
    leaders = cells(pi_columns(people.withColumn("__key", F.col(person)), "__key"), F.lit("PIs"), "__key")
    days = F.datediff(F.col("deadline"), as_of)
    counts = jobs.select(sheet(F.col("region")).alias("of"), days.alias("days")).rollup("of").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("days").between(0, 7)).alias("week"), F.count_if(F.col("days").between(8, 30)).alias("month"))
    return posts.unionByName(leaders).unionByName(cells(counts.withColumn("of", F.coalesce("of", F.lit("All"))), F.lit("Dashboard"), "of", 1))
