"""Text normalisation, predicates and small extractors as column expressions."""

from __future__ import annotations

import unicodedata
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c) -> Column:
    """Lower case, single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def fold_latin(c) -> Column:
    """Latin-1 letters without their accents; stays in the JVM."""
    return F.translate(col(c), ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, for all scripts."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def norm_title(c) -> Column:
    """Spellings of "postdoc" made one, and a leading job kind dropped."""
    t = F.regexp_replace(norm(c), r"post[- ]?doc(toral|torate)?\b", "postdoc")
    t = F.regexp_replace(t, r"^(postdoc|research) (position|fellowship|fellow|researcher|research associate|associate)( in| on| for)?\b", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def norm_institute(c) -> Column:
    """Accents, commas and points dropped, a leading article and a trailing company form as well."""
    t = norm(F.regexp_replace(fold_latin(c), r"[,.]", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^the ", ""), r" (inc|ltd|gmbh|llc)$", ""))


def dedup_title(c) -> Column:
    """A title as duplicates are compared by: spellings of "postdoc" made one, a leading kind of post dropped."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.lower(col(c))), r"\s+", " "), r"\bpost[\s-]?doc(toral)?\b", "postdoc")
    return F.regexp_replace(t, r"^(?:postdoc|research)\s+(?:position|fellow|researcher|associate)\s*[-:–]?\s*", "")


# Names of sites, not of places; long names and their short forms, in the order they are replaced.
SITES = (
    "academic positions", "academicpositions", "the university", "inside higher ed", "phdfinder", "higher ed jobs", "higheredjobs",
    "academickeys", "chronicle of higher education", "nature careers", "nature", "the", "times higher education", "researchgate",
    "scholarshipdb", "linkedin", "indeed", "glassdoor",
)
SHORT_FORMS = [
    ("university of california, ", "uc "), ("university of california ", "uc "), ("massachusetts institute of technology", "mit"), ("california institute of technology", "caltech"),
    ("university of north carolina at chapel hill", "unc"), ("university of north carolina", "unc"), ("unc school of medicine", "unc"), ("komen graduate training program ut mdacc", "md anderson"),
    ("md anderson cancer center", "md anderson"), ("washington university in st. louis", "washu"), ("georgia institute of technology", "georgia tech"),
]


def dedup_institute(c) -> Column:
    """An institute's name as duplicates are compared by: no accents, short forms, no trailing units; empty for sites."""
    t = fold_latin(F.lower(F.trim(col(c))))
    for long, short in SHORT_FORMS:
        t = F.replace(t, F.lit(long), F.lit(short))
    # fixed value: the units that are left out behind a dash or comma
    t = F.regexp_replace(t, r"\s*[-–—,]\s*(?:research center|centre|center|faculty|of the [\w\s]+academy|stipendier|stipendiemodul).*$", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t.isin(*SITES) | t.contains("stipendi"), "").otherwise(t)


def clean_text(c, most: int = 32000) -> Column:
    """Tags, emphasis marks and rules out, blanks collapsed, cut to ``most`` characters."""
    t = F.regexp_replace(col(c), r"<[^>]*>", " ")
    t = F.regexp_replace(t, r"(?m)^\s*[-*_]{3,}\s*$", " | ")
    t = F.regexp_replace(t, r"[*_#`]+", "")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, most)


def clean_list(c) -> Column:
    """Bulleted or numbered lines joined by "; "."""
    t = F.regexp_replace(F.trim(col(c)), r"\n\s*([-*•]|[0-9]+[.)])?\s*", "; ")
    return F.regexp_replace(t, r"^([-*•]|[0-9]+[.)])\s*", "")


def content_hash(c) -> Column:
    return F.sha2(norm(c), 256)


def snippets(c, words: list[str], least: int = 20, most: int = 500) -> Column:
    """Sentences that hold one of ``words`` and are longer than ``least``, cut to ``most``."""
    hit = lambda s: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(s), w))
    parts = F.filter(F.split(col(c), r"[.!?]\s+|\n"), lambda s: (F.length(F.trim(s)) > least) & hit(s))
    return F.transform(parts, lambda s: F.substring(F.trim(s), 1, most))


def hits(c, words: list[str]) -> Column:
    """Those of ``words`` that the text contains, in the list's order."""
    t = F.lower(col(c))
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, F.lower(w)))


def keyword_score(c, words: list[str]) -> Column:
    """Share of ``words`` in the text, to three places, halves to even."""
    return F.bround(F.size(hits(c, words)) / F.lit(float(len(words))), 3)


def first_label(c, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first (label, pattern) that matches."""
    t, out = F.lower(col(c)), None
    for label, pattern in rules:
        out = F.when(t.rlike(pattern), label) if out is None else out.when(t.rlike(pattern), label)
    return out.otherwise(F.lit(default))


def labels(c, rules: list[tuple[str, str]]) -> Column:
    """All labels whose pattern matches, in order and once each."""
    t = F.lower(col(c))
    return F.array_distinct(F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(x)) for x, p in rules))))


def is_garbage_title(c) -> Column:
    """Missing, or too short: under 4 characters in Chinese, Japanese or Korean script, else under 10."""
    t = F.trim(col(c))
    least = F.when(t.rlike(r"[　-鿿가-힯]"), 4).otherwise(10)
    return t.isNull() | (F.length(t) < least)


def needs_refresh(c, least: int = 500) -> Column:
    """A stored description that is empty, short, cut off or without the end of a sentence."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return (F.length(t) < least) | t.endswith("...") | ~t.rlike(r"[.!?]")


def url_host(c) -> Column:
    return F.lower(F.regexp_extract(col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_query(c, name: str) -> Column:
    return F.regexp_extract(col(c), rf"[?&]{name}=([^&#]*)", 1)


def unwrapped(c) -> Column:
    """The url that a search page's redirect points at, or the url itself."""
    u = col(c)
    inner = F.regexp_extract(u, r"[?&](?:uddg|url|u|q)=(https?(?:%3A|:)[^&#]+)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(u)


def first_date(c) -> Column:
    """The earliest ISO date in the text, null if none."""
    found = F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(r"(\d{4}-\d{2}-\d{2})")), lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date")), lambda d: d.isNotNull())
    return F.array_min(found)


def relative_date(as_of: Column, n: Column, unit: Column) -> Column:
    """``n`` units before ``as_of``; a month has 30 days and a year 365."""
    days = F.when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365).otherwise(1)
    return F.date_sub(F.to_date(as_of), (n * days).cast("int"))


class _Text(HTMLParser):
    """Collects visible text; blocks end lines."""

    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol dd dt".split())
    HIDDEN = frozenset(("script", "style", "template", "noscript"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_to_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def strip_html(s: pd.Series) -> pd.Series:
    return s.map(html_to_text)


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unescape(t))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def merge_distinct(parts: list, sep: str = "; ") -> Column:
    """The filled parts joined, each once whatever its case, in order."""
    given = F.filter(F.array(*(F.trim(col(p)) for p in parts)), lambda x: F.coalesce(x, F.lit("")) != "")
    lows = F.transform(given, F.lower)
    return F.array_join(F.filter(given, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1), sep)


def split_preferred(c) -> tuple[Column, Column]:
    """(required, preferred): a requirements text cut at a marker such as "Preferred:", else by its parts."""
    t = col(c)
    marker = r"(?is)^(.*?)\s*\b(?:preferred|desirable|nice to have)(?: qualifications| skills)?\s*:\s*(.*)$"
    parts = F.filter(F.split(t, r"[;\n]+"), lambda x: F.trim(x) != "")
    soft = lambda x: F.lower(x).rlike(r"prefer|desirable|advantage|a plus|ideally")
    has = t.rlike(marker)
    hard = F.array_join(F.transform(F.filter(parts, lambda x: ~soft(x)), lambda x: F.trim(x)), "; ")
    easy = F.array_join(F.transform(F.filter(parts, soft), lambda x: F.trim(x)), "; ")
    return F.when(has, F.trim(F.regexp_extract(t, marker, 1))).otherwise(hard), F.when(has, F.trim(F.regexp_extract(t, marker, 2))).otherwise(easy)


def without_boilerplate(c, patterns: list[str]) -> Column:
    """Lines that match no pattern, without later repeats of the first line."""
    lines = F.filter(F.split(col(c), r"\r?\n"), lambda x: ~F.lower(x).rlike("|".join(f"(?:{p})" for p in patterns)))
    first = F.get(F.filter(lines, lambda x: F.trim(x) != ""), F.lit(0))
    kept = F.filter(lines, lambda x, i: (F.trim(x) != F.trim(first)) | (F.length(F.trim(first)) <= 5) | (i == F.array_position(lines, first) - 1))
    return F.array_join(kept, "\n")


def url_score(c, domain, words: list[str]) -> Column:
    """3 for the domain, 2 for any of the words, 1 for an academic host."""
    host, t = url_host(c), F.lower(col(c))
    any_word = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)) if words else F.lit(False)
    return F.when(F.contains(host, F.lower(col(domain))), 3).otherwise(0) + F.when(any_word, 2).otherwise(0) + F.when(host.rlike(r"\.(edu|ac\.[a-z]{2})$"), 1).otherwise(0)


def full_name(c) -> Column:
    """At least two words, none of a single letter."""
    words = F.split(norm(c), " ")
    return (F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) > 1)


def slug_words(c) -> Column:
    """The last path segment of a url as words."""
    segment = F.regexp_extract(col(c), r"([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(segment, r"\.[a-z]+$", ""), r"[-_+]+", " ")))
