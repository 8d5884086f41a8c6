"""Tests and small cleanings of postings, pages, people and places, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import SITES, col, norm, sequence_ratio, url_host

# What restricts a post to citizens; hosts that are no group's page; what a blocked page says.
CITIZENS = (
    r"(?i)U\.?S\.?\s*citizen|citizenship\s+(?:is\s+)?require|must\s+be\s+a?\s*(?:U\.?S\.?|American)\s*citizen|U\.?S\.?\s*persons?\s+only|(?:require|need)s?\s+(?:U\.?S\.?\s*)?(?:security\s+)?clearance|"
    r"\bITAR\b|\bEAR\b.*(?:restrict|require|compliance)|permanent\s+residents?\s+(?:only|eligible|may\s+apply)"
)
SOCIAL = ("twitter.com", "x.com", "linkedin.com", "facebook.com", "youtube.com", "researchgate.net", "orcid.org", "github.com", "wikipedia.org")
BLOCKED = ["security check", "captcha", "verification successful", "ray id:", "unusual activity", "verifying that you're a real person"]
ORGANISATIONS = ("university", "institute", "college", "school", "hospital", "center", "centre", "lab")
LEADER = {"h_index": 10, "papers": 15, "recent": 3}
# Latin spellings of the commonest Korean surnames.
SURNAMES = {
    "김": "Kim", "이": "Lee", "박": "Park", "최": "Choi", "정": "Jung", "강": "Kang", "조": "Cho", "윤": "Yoon", "장": "Jang", "임": "Lim", "한": "Han",
    "오": "Oh", "서": "Seo", "신": "Shin", "권": "Kwon", "황": "Hwang", "안": "Ahn", "송": "Song", "류": "Ryu", "전": "Jeon", "홍": "Hong", "고": "Ko",
    "문": "Moon", "양": "Yang", "손": "Son", "배": "Bae", "백": "Baek", "허": "Heo", "유": "Yoo", "남": "Nam", "심": "Shim", "노": "Noh", "하": "Ha",
    "곽": "Kwak", "성": "Sung", "차": "Cha", "주": "Joo", "우": "Woo", "구": "Koo", "민": "Min",
}


def any_of(text: Column, words: list[str]) -> Column:
    """Does the text contain any of the words?"""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def blob(*columns) -> Column:
    return F.concat_ws(" ", *(F.coalesce(col(c), F.lit("")) for c in columns))


def citizens_only(*columns) -> Column:
    return blob(*columns).rlike(CITIZENS)


def lab_page(url) -> Column:
    """An http url of a host that may be a group's page."""
    u = F.coalesce(col(url), F.lit(""))
    return u.startswith("http") & ~any_of(url_host(u), SOCIAL)


def leads_a_group(h_index, papers, recent) -> Column:
    return (F.coalesce(col(h_index), F.lit(0)) >= LEADER["h_index"]) & (F.coalesce(col(papers), F.lit(0)) >= LEADER["papers"]) & (F.coalesce(col(recent), F.lit(0)) >= LEADER["recent"])


def is_site(employer) -> Column:
    """The employer is a job site's name."""
    return F.coalesce(F.lower(F.trim(col(employer))), F.lit("")).isin(*SITES)


def blocked_page(html) -> Column:
    """A page that asks who is there instead of showing anything."""
    return any_of(F.lower(F.coalesce(col(html), F.lit(""))), BLOCKED)


def needs_browser(html, least: int = 120) -> Column:
    """A page that shows hardly any text without its scripts, or is blocked."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return (F.length(F.trim(F.regexp_replace(bare, r"\s+", " "))) < least) | blocked_page(html)


def listing_page(title, text) -> Column:
    """A list of posts that calls itself one: named only by the kind of post, beginning with a count."""
    t, d = F.lower(F.trim(F.coalesce(col(title), F.lit("")))), F.trim(F.coalesce(col(text), F.lit("")))
    # fixed values: the kinds, and how such a list begins
    return t.isin("postdoctoral", "postdoc", "post-doc") & (d.rlike(r"^\d") | F.contains(d, F.lit("Postdoctoral positions\nFilters")))


def institute_of(affiliation, most: int = 120) -> Column:
    """The first part between commas that names an organisation, else the beginning of all."""
    parts = F.transform(F.split(F.coalesce(col(affiliation), F.lit("")), ","), lambda p: F.trim(p))
    named = F.filter(parts, lambda p: any_of(F.lower(p), ORGANISATIONS))
    return F.coalesce(F.get(named, F.lit(0)), F.substring(F.coalesce(col(affiliation), F.lit("")), 1, most))


def research_fields(raw, most: int = 3) -> Column:
    """Up to ``most`` of the parts of a path of fields, each once, without those that a longer one begins with."""
    parts = F.filter(F.transform(F.split(col(raw), r"[»›|]"), lambda p: F.btrim(p, F.lit(" ,."))), lambda p: p != "")
    lows = F.transform(parts, F.lower)
    once = F.filter(parts, lambda p, i: F.array_position(lows, F.lower(p)) == i + 1)
    final = F.filter(once, lambda p: ~F.exists(lows, lambda q: q.startswith(F.lower(p)) & (q != F.lower(p))))
    return F.array_join(F.slice(final, 1, most), ", ")


def first_block(text, most: int = 1000) -> Column:
    """The first paragraph: a summary where none is given."""
    return F.substring(F.trim(F.get(F.split(F.trim(col(text)), r"\n\s*\n", 2), F.lit(0))), 1, most)


def surname_in_latin(name) -> Column:
    """The usual Latin spelling of a Korean name's first syllable; other names stay."""
    n = F.trim(col(name))
    table = F.create_map(*(F.lit(x) for kv in SURNAMES.items() for x in kv))
    return F.when(F.length(n) < 2, n).otherwise(F.coalesce(table[F.substring(n, 1, 1)], n))


def expanded_query(keyword: str, synonyms: list[str]) -> str:
    """A literature query for a keyword or any of its synonyms; those of several words are quoted."""
    shown = [f'"{t}"' if " " in t else t for t in [keyword, *synonyms]]
    return "(" + " OR ".join(f"{t}[Title/Abstract]" for t in shown) + ")"


def match_score(name, other, place, affiliations, cited) -> Column:
    """How well a profile fits a name: likeness, more for the same place, a little for citations; null below 0.5."""
    like = sequence_ratio(norm(name), norm(other))
    there = F.when((F.coalesce(col(place), F.lit("")) != "") & F.contains(F.lower(col(affiliations)), F.lower(col(place))), 0.3).otherwise(0.0)
    known = F.when(col(cited) > 0, F.least(F.lit(0.1), F.log10(col(cited).cast("double")) / 60)).otherwise(0.0)
    return F.when(like >= 0.5, like + there + known)


def country_in(text, states: list[str], cities: list[str], aliases: dict[str, str], home: str = "United States") -> Column:
    """The country that a text names: by a state after a comma, by a city, or by the longest alias in it."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    codes = F.regexp_extract_all(t, F.lit(r",\s*([a-z]{2})\b"))
    here = F.arrays_overlap(codes, F.array(*map(F.lit, states))) if states else F.lit(False)
    found = F.when(here | (any_of(t, cities) if cities else F.lit(False)), home)
    for alias in sorted(aliases, key=len, reverse=True):
        found = found.when(F.contains(t, F.lit(alias)), aliases[alias])
    return found


def department(text) -> Column:
    """The first "Department of ..." or the like, or a Korean department, of 3 to 80 characters."""
    t = F.coalesce(col(text), F.lit(""))
    english = F.regexp_extract(t, r"\b((?:Department|School|Faculty|Division|Institute|Dept\.?)\s+(?:of|for)\s+[A-Z][\w&-]*(?:\s+(?:and|of|&|[A-Z][\w&-]*))*)", 1)
    korean = F.regexp_extract(t, r"([가-힣]{2,20}(?:학과|학부|공학과|대학원))", 1)
    named = F.regexp_replace(F.regexp_replace(english, r"^Dept\.?", "Department"), r"[\s,]+(?:and|of|&)?$", "")
    return F.when(F.length(named).between(3, 80), named).when(korean != "", korean)
