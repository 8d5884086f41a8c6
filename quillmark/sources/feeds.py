"""Feeds and structured data: RSS items, article XML, JSON-LD postings and plain JSON, as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.shared import cut

ITEM = "title string, link string, description string, pubDate string, creator string"


def rss(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The <item> rows of RSS files."""
    found = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(ITEM).load(path)
    return found.limit(limit) if limit else found


def rss_items(df: DataFrame, xml: str) -> DataFrame:
    """``df`` with one row for each <item> of the feed in column ``xml``; broken items are left out."""
    items = F.regexp_extract_all(F.regexp_replace(F.col(xml), r"<(/?)\w+:", "<$1"), F.lit(r"(?s)(<item\b.*?</item>)"))
    parsed = F.from_xml(F.col("__item"), F.lit(ITEM))
    return df.withColumn("__item", F.explode(items)).withColumn("item", parsed).drop("__item").where("item.title is not null or item.link is not null").select(*df.columns, "item.*")


def articles(df: DataFrame, xml: str) -> DataFrame:
    """(pmid, title, year, published, abstract, authors, affiliations, last_author) of each <PubmedArticle> in column
    ``xml``. ``published`` is the date as far as it is given; parts of an abstract are joined by blanks."""
    one = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<PubmedArticle\b.*?</PubmedArticle>)"))
    lasts, fores = F.xpath("a", F.lit("//Author/LastName/text()")), F.xpath("a", F.lit("//Author/ForeName/text()"))
    return df.select(F.explode(one).alias("a")).select(
        F.get(F.xpath("a", F.lit("//PMID/text()")), F.lit(0)).alias("pmid"),
        F.xpath_string("a", F.lit("//ArticleTitle")).alias("title"),
        F.xpath_int("a", F.lit("//PubDate/Year")).alias("year"),
        F.concat_ws("-", *(F.when(F.xpath_string("a", F.lit(f"//PubDate/{part}")) != "", F.xpath_string("a", F.lit(f"//PubDate/{part}"))) for part in ("Year", "Month", "Day"))).alias("published"),
        F.array_join(F.xpath("a", F.lit("//Abstract/AbstractText/text()")), " ").alias("abstract"),
        F.arrays_zip(lasts.alias("last"), fores.alias("fore")).alias("authors"),
        F.array_distinct(F.xpath("a", F.lit("//Author//Affiliation/text()"))).alias("affiliations"),
        F.try_element_at(lasts, F.lit(-1)).alias("last_author"),
    )


def json_ld(html: Column) -> Column:
    """The JSON of every ld+json script in a page."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"))


def ld_objects(script: Column) -> Column:
    """The objects of an ld+json script: those of a list, of a graph, or the one that it is."""
    inner = F.coalesce(F.get_json_object(script, "$.@graph"), script)
    return F.when(F.trim(inner).startswith("["), F.from_json(inner, "array<string>")).otherwise(F.array(inner))


def postings(df: DataFrame, html: str) -> DataFrame:
    """``df`` with the fields of each JobPosting in its pages' structured data; a type may be one of a list."""
    get = lambda path: F.get_json_object("__ld", path)
    objects = F.flatten(F.transform(json_ld(F.col(html)), ld_objects))
    found = df.withColumn("__ld", F.explode(objects)).where(get("$.@type").rlike(r'^(\[.*")?JobPosting(".*\])?$'))
    return found.select(
        *df.columns,
        get("$.title").alias("title"),
        get("$.hiringOrganization.name").alias("institute"),
        F.coalesce(get("$.jobLocation.address.addressCountry"), get("$.jobLocation[0].address.addressCountry")).alias("country"),
        get("$.datePosted").alias("posted"),
        get("$.validThrough").alias("deadline"),
        get("$.description").alias("description"),
    )


def json_records(df: DataFrame, column: str, schema: str, path: str = "$") -> DataFrame:
    """``df`` with the fields of a JSON column (or of the objects of a list in it); bad JSON gives no row."""
    items = F.from_json(F.get_json_object(column, path), f"array<struct<{schema}>>")
    return df.withColumn("__i", F.explode(items)).select(*df.columns, "__i.*")


def gathered(sources: dict) -> tuple[DataFrame | None, dict[str, str]]:
    """(the union of those sources that could be read, with a column ``source``; why the others couldn't). A
    source is a function without arguments that returns a DataFrame. Each is read by a job of its own into the shared
    folder, so that one that fails, when it is opened or while it is read, leaves nothing behind and doesn't stop the rest."""
    found, failed = [], {}
    for name, open_ in sources.items():
        try:
            found.append(cut(open_(), "source")[0].withColumn("source", F.lit(name)))
        except Exception as e:  # whatever a source raises is its own failure
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return (union(found) if found else None), failed


def union(sources: list[DataFrame]) -> DataFrame:
    """All sources with the columns of any of them."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
