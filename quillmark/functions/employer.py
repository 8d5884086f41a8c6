"""Who employs: the institution behind a posting that a job site carries under its own name.

Names of institutions are runs of capitalised words, with little words between them, that hold a word for an
institution, or are known by name. What stands around a name, or the label in front of a value, is the evidence; kinds of evidence are
tried in a fixed order, and the first name by the best kind wins. The answer says which kind it was and where.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of evidence, the best first.
KINDS = ("heading", "label", "seeks", "opening", "about", "name", "known", "at")
HEADS = frozenset("university universität université universidad università universiteit institute institut instituto college school hospital clinic klinikum center centre laboratory laboratories academy foundation council".split())
SMALL = frozenset("of the for and de la le du des der für di del & in zu".split())
#: Words that begin or end no institution's name, and words that alone make up units of one.
EDGES = frozenset("the a an our this join at in about location employer position description overview summary apply application open closing date posted department division section faculty postdoctoral postdoc research fellow assistant associate professor".split())
UNITS = frozenset("department division section faculty school college center centre laboratory institute hospital clinic medicine engineering science sciences biology chemistry physics biochemistry pathology psychology graduate our research".split())
#: Institutions whose names hold no such word; callers give more.
KNOWN = frozenset({"max planck society", "cnrs", "inserm", "riken", "eth zurich", "epfl", "embl", "csic", "csiro", "karolinska institutet", "wellcome sanger", "kaist", "postech", "caltech", "mit"})
LABELS = ("employer", "organisation", "organization", "institution", "company", "host institution", "hiring institution", "university")
HEADINGS = ("organisation/company", "organization/company", "employer", "host institution")
SEEKS = re.compile(r"\s*(?:,[^,.]{0,60},)?\s*(?:invites?|is\s+(?:seeking|looking|hiring|recruiting|inviting|pleased|accepting)|seeks?|announces?|welcomes\s+applications|has\s+an?\s+(?:open|opening|vacan))", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_][\w'’.-]*|&")


class Employer(NamedTuple):
    name: str
    kind: str
    place: int


class _Name(NamedTuple):
    text: str
    start: int
    end: int
    known: bool


def _names(text: str, known: Collection[str]) -> list[_Name]:
    """The names of institutions in a text, in order."""
    out, run = [], []

    def close() -> None:
        words = list(run)
        while words and (words[-1][0].lower() in SMALL or words[-1][0].lower().rstrip(".") in EDGES):
            words.pop()
        while words and words[0][0].lower() in EDGES - {"the"} | SMALL - {"the"}:
            words.pop(0)
        low = [w.lower().rstrip(".") for w, _, _ in words]
        proper = [w for w in low if w not in SMALL and w not in UNITS]
        flat = " ".join(low)
        hit = next((k for k in (*KNOWN, *known) if re.search(rf"(?<!\w){re.escape(k)}(?!\w)", flat)), None)
        if words and ((HEADS.intersection(low) and proper and low != ["the"] and proper not in (["university"],) and len(words) > 1) or hit):
            alone = hit is not None and not HEADS.intersection(low)
            if alone:  # the known name and nothing around it
                size = len(hit.split())
                k = next((k for k in range(len(low)) if low[k : k + size] == hit.split()), None)
                words = words if k is None else words[k : k + size]
            start, end = words[0][1], words[-1][2]
            out.append(_Name(text[start:end].rstrip(".,"), start, end, alone))

    for m in _WORD.finditer(text):
        word = m[0]
        joined = bool(run) and re.fullmatch(r"[ \t]+", text[run[-1][2] : m.start()]) is not None
        if run and not joined:
            close()
            run = []
        if word[0].isupper() or (run and word.lower() in SMALL):
            run.append((word.rstrip("."), m.start(), m.start() + len(word.rstrip("."))))
            if word.endswith(".") and len(word) > 3:
                close()
                run = []
        elif run:
            close()
            run = []
    close()
    return out


def _value(line: str, at: int) -> tuple[str, int]:
    """A label's value: the rest of its line up to what ends a name."""
    rest = re.split(r"[;|(\n]|\s{2,}|,\s|\.\s|\.$", line[at:], maxsplit=1)[0]
    lead = len(rest) - len(rest.lstrip())
    return rest.strip(), at + lead


def _labelled(text: str) -> Employer | None:
    """A value under a heading, else behind a label."""
    lines, starts, at = text.split("\n"), [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    best = None
    for k, line in enumerate(lines):
        bare = line.strip().rstrip(":").strip().lower()
        if bare in HEADINGS and (following := next((j for j in range(k + 1, len(lines)) if lines[j].strip()), None)) is not None:
            value = lines[following].strip()
            if 3 <= len(value) <= 120 and value[0].isupper():
                return Employer(value.rstrip(".,"), "heading", starts[following] + lines[following].index(value))
        m = re.match(rf"\s*(?:{'|'.join(LABELS)})\s*:\s*(?=\S)", line, re.IGNORECASE)
        if m and best is None:
            value, at = _value(line, m.end())
            if 3 <= len(value) <= 120 and value[0].isupper():
                best = Employer(value, "label", starts[k] + at)
    return best


def employer(text: str | None, known: Collection[str] = ()) -> Employer | None:
    """The employer that a posting's text names, by the best kind of evidence; None where nothing tells. ``known`` are more
    names, in lower case, of institutions that hold no word for one."""
    if not text or not text.strip():
        return None
    if found := _labelled(text):
        return found
    told: list[tuple[int, int, Employer]] = []
    for n in _names(text, known):
        before, after = text[max(0, n.start - 24) : n.start], text[n.end : n.end + 120]
        if SEEKS.match(after):
            kind = "seeks"
        elif not text[: n.start].strip() and re.match(r"\s*(?:[-–|,:\n]|$)", after):
            kind = "opening"
        elif re.search(r"(?i)\b(?:about|location:?|join)\s+(?:the\s+)?$", before):
            kind = "about"
        elif re.search(r"(?i)\b(?:based\s+)?at\s+(?:the\s+)?$", before) and n.known:
            kind = "at"
        else:
            kind = "known" if n.known else "name"
        name = n.text[4:] if n.text.startswith("The ") else n.text
        told.append((KINDS.index(kind), n.start, Employer(name, kind, n.end - len(name))))
    if told:
        return min(told)[2]
    m = re.search(r"\b(?:based\s+at|working\s+at|employed\s+(?:at|by))\s+(?:the\s+)?([A-Z][\w'’&-]*(?:\s+[A-Z][\w'’&-]*){0,4})", text)
    return Employer(m[1], "at", m.start(1)) if m and m[1].lower() not in EDGES else None


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("place", T.IntegerType())]))
def employer_of(s: pd.Series) -> pd.DataFrame:
    found = [employer(t) for t in s]
    return pd.DataFrame({"name": [e and e.name for e in found], "kind": [e and e.kind for e in found], "place": pd.array([e.place if e else None for e in found], "Int32")})
