"""Fields of free-text postings: one chain for all of them, so that a text is read once. What a posting says of pay, length,
start, degree and contract comes from ``terms``, who leads from ``people``; dates, addresses, links and sections are
read here."""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import people, terms
from quillmark.shared import spread

DATE = re.compile(
    r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?!\d)|(?<!\d)(?P<d1>\d{1,2})[/.](?P<m1>\d{1,2})[/.](?P<y1>\d{4})|(?P<yk>\d{4})\s*년\s*(?P<mk>\d{1,2})\s*월\s*(?P<dk>\d{1,2})\s*일"
    r"|(?P<mon>[A-Za-z]{3,9})\.?[ -](?P<d2>\d{1,2})(?:st|nd|rd|th)?(?:, ?|[ -])(?P<y2>\d{4})|(?P<d3>\d{1,2})(?:st|nd|rd|th)?[ -](?P<mon2>[A-Za-z]{3,9})\.?[ -](?P<y3>\d{4})"
)
DUE = re.compile(r"(?i)(?=[dacm마접모지])(?:deadline|apply by|closing date|applications? (?:due|close)|must be received by|마감|(?:접수|모집)\s*기간|지원\s*기한)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
LINK = re.compile(r"https?://[^\s<>\"')\]]+")
SECTIONS = {
    "requirements": r"requirements?|(?:minimum |basic |required )?qualifications?|your profile|what you bring|지원\s*자격|응시\s*자격|자격\s*(?:요건|조건)",
    "preferred": r"(?:preferred|desired|desirable) (?:qualifications?|skills|experience)|nice to have|우대\s*(?:사항|조건)",
    "responsibilities": r"(?:key )?responsibilities|duties|your tasks|what you will do|담당\s*업무|수행\s*업무|직무\s*내용",
    "conditions": r"we offer|benefits|conditions|what we offer|근무\s*조건|복리\s*후생",
    "materials": r"how to apply|application (?:materials|documents|procedure)|to apply|제출\s*서류|구비\s*서류",
}
_ANY = lambda tail: "|".join(f"(?P<{k}{tail}>{v})" for k, v in SECTIONS.items())
HEADER = re.compile("(?im)^[ \t#*]*(?:" + _ANY("") + r")[ \t*]*[:：]?[ \t]*$|(?i:(?<!\w)(?:" + _ANY("_") + r"))[:：]")

NAMES = "deadline contact_email info_urls salary duration start_date degree contract leader summary requirements preferred responsibilities conditions materials".split()
FIELDS = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "info_urls" else T.StringType()) for n in NAMES])


def dates(text: str) -> list[tuple[int, str]]:
    """(place, ISO date) of every date in the usual notations; impossible ones are left out. Of two numbers before a
    year the first is the day, unless only the second can be."""
    found = []
    for m in DATE.finditer(text):
        g = m.groupdict()
        year, day = g["y"] or g["y1"] or g["yk"] or g["y2"] or g["y3"], g["d"] or g["d1"] or g["dk"] or g["d2"] or g["d3"]
        month = g["m"] or g["m1"] or g["mk"] or terms.MONTHS.get((g["mon"] or g["mon2"]).lower(), 0)
        if g["m1"] and int(month) > 12:
            day, month = month, day
        try:
            found.append((m.start(), datetime.date(int(year), int(month), int(day)).isoformat()))
        except ValueError:
            continue
    return found


def deadline(text: str) -> str | None:
    """The earliest date within 120 characters after a word for a deadline."""
    words = list(DUE.finditer(text))
    known = dates(text) if words else []
    near = [d for w in words for at, d in known if 0 <= at - w.end() <= 120]
    return min(near, default=None)


def contact(text: str) -> str | None:
    """The first address that follows a word for contact within 80 characters, else the first at all."""
    found = [m for m in EMAIL.finditer(text) if not re.match(r"(?i)no-?reply|donotreply", m.group())]
    near = [m for m in found if re.search(r"(?i)contact|e-?mail|send|enquir|inquir", text[max(0, m.start() - 80) : m.start()])]
    return (near or found)[0].group() if found else None


def sections(text: str) -> dict[str, str]:
    """The text under each known header, up to the next; what stands before the first is the summary."""
    marks = [(m.start(), m.end(), next(k.rstrip("_") for k, v in m.groupdict().items() if v)) for m in HEADER.finditer(text)]
    out: dict[str, str] = {}
    head = text[: marks[0][0]].strip() if marks else ""
    if len(head) > 40:
        out["summary"] = head
    for k, (_, end, name) in enumerate(marks):
        body = text[end : marks[k + 1][0] if k + 1 < len(marks) else len(text)].strip()
        if len(body) >= 10 and name not in out:
            out[name] = body
    return out


def fields(text: str | None) -> dict:
    if not text:
        return {}
    out = sections(text)
    told = {name: read(text) or None for name, read in terms.READERS.items()}
    return out | told | {
        "deadline": deadline(text),
        "contact_email": contact(text),
        "info_urls": list(dict.fromkeys(u.rstrip(".,;") for u in LINK.findall(text)))[:3],
        "leader": people.leader(text),
    }


@F.pandas_udf(FIELDS)
def _fields(s: pd.Series) -> pd.DataFrame:
    rows = [fields(t) for t in s]
    return pd.DataFrame({n: [r.get(n) for r in rows] for n in NAMES}, columns=NAMES)


@F.pandas_udf(T.StringType())
def deadline_of(s: pd.Series) -> pd.Series:
    return s.map(lambda t: deadline(t) if t else None)


def posting(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the fields of each text. Rows are dealt to all tasks first, as reading takes long and small files have few splits."""
    return spread(df.select(key, text)).select(key, _fields(F.col(text)).alias("f")).select(key, "f.*")


#: Labels of skills and the patterns that call for them, in order.
SKILLS = [("Python", r"\bpython\b"), ("R", r"\bprogramming in r\b|\br studio\b|\brstudio\b"), ("Sequencing", r"sequencing|\bngs\b"), ("CRISPR", r"crispr"), ("Microscopy", r"microscop"), ("Machine learning", r"machine learning|deep learning"), ("Cloning", r"\bcloning\b"), ("Mass spectrometry", r"mass spec|lc-ms")]


def label_columns(text) -> dict:
    """contract, the level of the degree, and skills of a text."""
    from quillmark.functions.text import labels

    told = terms.terms(text, F.lit(""))
    low = F.lower(told.degree)
    level = F.when(low.rlike("^(ph|doctor|박사)"), "Doctorate").when(low != "", "Master")
    return {"contract": told.contract, "degree": level, "skills": F.array_join(F.slice(labels(text, SKILLS), 1, 10), ", ")}
