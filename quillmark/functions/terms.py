"""Terms of a posting: pay, duration, start, degree and contract.

A text becomes tokens, and each word has a part to play: currency, period, unit of time, month, or a cue for pay, for a post
or for a beginning. Small readers put tokens together, money from signs, amounts and periods, spans from counts
and units, dates from months and numbers; how a phrase is tied to a cue beside it decides which one is meant.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Token(NamedTuple):
    text: str
    low: str
    start: int
    end: int

    @property
    def number(self) -> bool:
        return "0" <= self.text[0] <= "9"


_TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[가-힣]+|[^\W\d_가-힣]+|[^\s\w]|_")
CURRENCY = {"$", "€", "£", "₩", "usd", "eur", "gbp", "krw"}
TO = {"-", "–", "~", "to"}
PERIODS = {"year", "yr", "annum", "month", "monthly", "hour", "hourly"}
PAY = {"salary", "stipend", "compensation", "remuneration", "pay"}
PAY_KR = ("연봉", "월급", "급여", "보수", "시급", "연")
WON = ("천만원", "만원", "천원", "억원", "원")
UNITS = {"year", "years", "yr", "yrs", "month", "months"}
COUNTS = {w: k for k, w in enumerate(("one", "two", "three", "four", "five", "six"), 1)}
#: What a pay scale begins with.
SCALES = {"tv", "tvl", "nih", "grade", "band", "scale"}
SPAN_LABELS = {"duration", "length", "term"}
POSTS = {"contract", "appointment", "position", "role", "fellowship", "post"}
POST_KR = ("계약", "근무", "임용")
LINKING = {"of", "for", "is", ":", "=", "a", "an", "the", "up", "to", "range", "："}
MONTHS = {m: k for k, names in enumerate(("january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sep sept", "october oct", "november nov", "december dec"), 1) for m in names.split()}
BEGINNINGS = {"start", "starting", "commencement", "commencing", "begin", "beginning"}
DOCTOR_TITLES = ("postdoc", "post-doc", "박사후", "박사 후", "ph.d")


@lru_cache(maxsize=4)  # the readers of one text share its tokens
def tokens(text: str | None) -> list[Token]:
    return [tuple.__new__(Token, (x := m[0], x.lower(), *m.span())) for m in _TOKEN.finditer(text or "")]


def _at(t: list[Token], i: int) -> str:
    return t[i].low if 0 <= i < len(t) else ""


def _is_number(t: list[Token], i: int) -> bool:
    return 0 <= i < len(t) and t[i].number


def _whole(token: str) -> tuple[int, bool] | None:
    """(the whole part of an amount, whether it has decimals) in either notation; None if it reads as neither."""
    head, *groups = re.split("[.,]", token)
    decimals = bool(groups) and len(groups[-1]) <= 2 and token.count(token[-len(groups[-1]) - 1]) == 1
    if decimals:
        groups.pop()
    if any(len(g) != 3 for g in groups) or (groups and len(head) > 3):
        return None
    return int(head + "".join(groups)), decimals


def grouped_digits(text: str) -> str:
    """Amounts with commas between thousands and without decimals: "42.185,28 €" becomes "42,185 €". An amount below
    1,000 keeps its decimals, unless they are zeros or a sign, a percent or a slash follows."""

    def one(m: re.Match) -> str:
        read = _whole(m[0])
        if read is None:
            return m[0]
        value, decimals = read
        if decimals and value < 1000 and re.search("[1-9]", m[0][-2:].lstrip(".,")) and not re.match(r"\s*[€$£%/]", text[m.end() :]):
            return m[0]
        return f"{value:,}"

    return re.sub(r"[0-9]+(?:[.,][0-9]+)*", one, text)


def _period(t: list[Token], i: int) -> int:
    """The place behind "per year", "/hour" and the like at i, or i."""
    return i + 2 if _at(t, i) in ("per", "/") and _at(t, i + 1) in PERIODS else i


def _money(t: list[Token], i: int) -> tuple[int, bool] | None:
    """(place behind, whether a currency is named) of an amount or range of amounts at i."""
    signed = _at(t, i) in CURRENCY
    i += signed
    if not _is_number(t, i):
        return None
    i += 1
    if _at(t, i) in CURRENCY and not _is_number(t, i + 1):
        signed, i = True, i + 1
    if _at(t, i) in TO:
        more = i + 1 + (_at(t, i + 1) in CURRENCY)
        if _is_number(t, more):
            signed, i = signed or more > i + 1, more + 1
            if _at(t, i) in CURRENCY and not _is_number(t, i + 1):
                signed, i = True, i + 1
    return _period(t, i), signed


def _cued(t: list[Token], i: int, cues: set[str], linking: set[str] = LINKING, most: int = 4) -> bool:
    """Does a cue stand before i, with nothing but linking words between?"""
    for k in range(i - 1, max(-1, i - 1 - most), -1):
        if t[k].low in cues:
            return True
        if t[k].low not in linking:
            return False
    return False


def _scales(t: list[Token], i: int) -> int | None:
    """The place behind a pay scale at i: TV-L with a grade, a numbered grade or band, the NIH's."""
    low = _at(t, i)
    if low in ("tv", "tvl"):
        k = i + 1
        if low == "tv":
            k += _at(t, k) == "-"
            if _at(t, k) != "l":
                return None
            k += 1
        k += _at(t, k) == "e"
        if not _is_number(t, k):
            return None
        more = k + 2 + (_at(t, k + 2) == "e")
        return more + 1 if _at(t, k + 1) == "/" and _is_number(t, more) else k + 1
    if low == "nih" and _at(t, i + 1) in ("scale", "salary"):
        return i + 2
    return i + 2 if low in ("grade", "band", "scale") and _is_number(t, i + 1) else None


def _won(t: list[Token], i: int) -> int | None:
    """The place behind an amount in won at i."""
    if not _is_number(t, i):
        return None
    k, unit = i + 1, ""
    while k < len(t) and len(unit) < 4 and not t[k].number and any(w.startswith(unit + t[k].text) or (unit + t[k].text).startswith(w) for w in WON):
        unit += t[k].text
        k += 1
        if unit.endswith("원"):
            break
    if not unit.startswith(WON):
        return None
    if _at(t, k) == "/" and _at(t, k + 1)[:1] in ("년", "월"):
        return k + 2
    return k + 1 if _at(t, k) in ("년", "월", "연") else k


def _money_of(t: list[Token]) -> Iterator[tuple[int, int, int]]:
    """(rank, begin, end) of what may be the pay; the least rank is meant, the first of such."""
    for i, token in enumerate(t):
        if (numeric := token.number) or token.low in CURRENCY:
            got = _money(t, i)
        else:
            got = None
        if got and not (i and t[i - 1].low in CURRENCY):
            end, signed = got
            amount = next(x for x in t[i:] if x.number)
            if _cued(t, i, PAY) and (signed or len(re.sub(r"\D", "", amount.text)) > 2):
                yield 0, i, end
            elif signed:
                yield 1, i, end
        if token.low in SCALES and (end := _scales(t, i)) is not None:
            yield {"t": 2, "n": 3}.get(token.low[0], 4), i, end
        if numeric and (end := _won(t, i)) is not None:
            k = i - 1 - (_at(t, i - 1) in (":", "："))
            labelled = k >= 0 and t[k].text in PAY_KR
            yield (5 if labelled else 6), (k if labelled else i), end


def _chosen(text: str, t: list[Token], found: Iterator[tuple[int, int, int]]) -> str:
    rank = min(found, default=None)
    return text[t[rank[1]].start : t[rank[2] - 1].end] if rank else ""


def salary(text: str | None) -> str:
    """The pay that a text names, with its range and period, in plain notation."""
    t = tokens(text)
    return grouped_digits(_chosen(text or "", t, _money_of(t)))


def _span(t: list[Token], i: int) -> int | None:
    """The place behind a span of years or months at i."""
    low = _at(t, i)
    if not (low in COUNTS or (_is_number(t, i) and low.isdigit() and int(low) < 100)):
        return None
    k = i + 1
    if _at(t, k) in ("-", "–") and _is_number(t, k + 1):
        k += 2
    k += _at(t, k) == "-"
    if _at(t, k) in UNITS:
        return k + 1
    if _at(t, k).startswith("년") and k == i + 1:
        return k + 3 if _is_number(t, k + 1) and _at(t, k + 2).startswith("개월") else None if _is_number(t, k + 1) and _at(t, k + 2).startswith("월") else k + 1
    return k + 1 if _at(t, k).startswith("개월") else None


def _spans(t: list[Token], text: str) -> Iterator[tuple[int, int, int]]:
    for i, token in enumerate(t):
        if token.low in SPAN_LABELS and _at(t, i + 1) == ":" and _at(t, i + 2) == "until" and _is_number(t, i + 3):
            yield 5, i + 2, min(len(t), i + 8)
        end = _span(t, i) if token.number or token.low in COUNTS else None
        if end is None or (i and t[i - 1].low in ("-", "–") and _is_number(t, i - 2)):
            continue
        following = _at(t, end), _at(t, end + 1)
        if following[0] == "after" or (following[0] == "of" and (following[1] in ("research", "experience") or following[1].startswith("postdoc"))):
            continue
        behind = end + (following[0] in (",", "-"))
        korean = any("가" <= c <= "힣" for c in t[end - 1].text)
        near = text[max(0, t[i].start - 40) : t[end - 1].end + 40]
        if _cued(t, i, SPAN_LABELS) or (korean and "기간" in text[max(0, t[i].start - 6) : t[i].start]):
            yield 0, i, end
        elif _cued(t, i, POSTS) or _at(t, behind) in POSTS | {"term"} or (_at(t, behind) == "fixed" and "term" in (_at(t, behind + 1), _at(t, behind + 2))):
            yield 1, i, end
        elif _cued(t, i, {"renewable"}):
            yield 2, i, end
        elif (_at(t, i - 1) in ("minimum", "least", "initially") or (_at(t, i - 2), _at(t, i - 1)) == ("up", "to")) and POSTS.union(SPAN_LABELS, {"renewable"}).intersection(x.low for x in tokens(near)):
            yield 3, i, end
        elif _at(t, i - 1) == "for" and any(x.low in CURRENCY | POSTS | PAY for x in t[max(0, i - 12) : i]):
            yield 4, i, end
        elif korean and any(c in near for c in POST_KR):
            yield 6, i, end


def duration(text: str | None) -> str:
    """A span of years or months that is said of the post, not of experience."""
    t = tokens(text)
    return _chosen(text or "", t, _spans(t, text or ""))[:60]


def _date(t: list[Token], i: int) -> int | None:
    """The place behind a date at i: month, day and year in any usual order, or a month and a year."""
    year = lambda k: _is_number(t, k) and len(t[k].text) == 4 and t[k].text.isdigit()
    small = lambda k: _is_number(t, k) and t[k].text.isdigit() and len(t[k].text) <= 2
    if _at(t, i) in MONTHS:
        k = i + 1
        if year(k):
            return k + 1
        k += _at(t, k) == "-"
        if small(k):
            k += 1
            k += _at(t, k) in ("st", "nd", "rd", "th")
            k += _at(t, k) in (",", "-")
            return k + 1 if year(k) else None
        return None
    if small(i) and _at(t, i + 1) in MONTHS and year(i + 2):
        return i + 3
    if year(i) and _at(t, i + 1) in ("-", "/") and small(i + 2) and _at(t, i + 3) == _at(t, i + 1) and small(i + 4):
        return i + 5
    if year(i) and _at(t, i + 1) == "년" and small(i + 2) and _at(t, i + 3) == "월" and small(i + 4) and _at(t, i + 5).startswith("일"):
        return i + 6
    return i + 1 if _is_number(t, i) and re.fullmatch(r"\d{4}\.\d{1,2}\.\d{1,2}", t[i].text) else None


def _starts(t: list[Token]) -> Iterator[tuple[int, int, int]]:
    linking = {"date", ":", "=", "：", "on", "from", "예정", "예정일", "일", "일자", "시기", "시점"}
    for i, token in enumerate(t):
        if (token.number or token.low in MONTHS) and (end := _date(t, i)) is not None:
            if _cued(t, i, BEGINNINGS, linking) or (_at(t, i - 1) == "from" and _at(t, i - 2) == "available"):
                yield 0, i, end
            elif any(_cued(t, i, {x.text}, linking) for x in t[max(0, i - 5) : i] if x.text.startswith(("시작", "근무", "임용", "채용"))):
                yield 2, i, end
        if token.low in ("immediately", "asap"):
            yield 1, i, i + 1
        if token.low == "as" and [x.low for x in t[i : i + 4]] == ["as", "soon", "as", "possible"]:
            yield 1, i, i + 4
        if token.text == "즉시":
            before, after = _at(t, i - 1) == "채용", _at(t, i + 1) == "근무"
            yield 3, i - before, i + 1 + (after and not before)
        if token.text == "협의" and _at(t, i + 1) == "후":
            yield 3, i, i + 2


def start_date(text: str | None) -> str:
    t = tokens(text)
    return _chosen(text or "", t, _starts(t))


_DOCTOR, _MASTER = r"\b(?:Ph\.?\s?D\.?|doctoral|doctorate)", r"\b(?:master['’]?s?|M\.?\s?Sc\.?)"
_SUBJECT = r"\s+(?:degree\s+)?in\s+[^.;\n]+"
#: From the most telling on.
DEGREES = [re.compile(p, re.IGNORECASE) for p in (_DOCTOR + _SUBJECT, _MASTER + _SUBJECT, _DOCTOR + r"(?:\s+degree)?(?!\w)", r"(?:박사|석사)\s*(?:학위|소지|졸업|이상)[^.;\n]{0,40}")]


def degree(text: str | None, title: str | None = None) -> str:
    """The degree asked for, with its subject; for posts that are for doctors by their title, a doctorate."""
    found = (m[0].strip().rstrip(".")[:120] for p in DEGREES if (m := p.search(text or "")))
    return next(found, "Doctorate" if any(x in (title or "").lower() for x in DOCTOR_TITLES) else "")


#: (kind of contract, words for it, the kind that rules it out), in the order in which they are listed.
CONTRACTS = (
    ("Full-time", ("full time",), None),
    ("Part-time", ("part time",), "Full-time"),
    ("Fixed-term", ("fixed term", "temporary", "contract"), None),
    ("Permanent", ("permanent", "tenure", "tenured"), "Fixed-term"),
    ("Permanent", ("정규직",), None),
    ("Fixed-term", ("계약직", "계약제", "기간제", "임시직"), None),
    ("Intern", ("intern", "internship", "인턴"), None),
    ("Part-time", ("시간제", "파트타임"), None),
    ("Full-time", ("전일제", "상근", "전임"), None),
)


def contract(text: str | None) -> str:
    """The kinds of contract that a text names."""
    flat = f" {' '.join(re.findall(r'[^\W_]+', (text or '').lower()))} "
    english: list[str] = []
    found: list[str] = []
    for kind, words, rival in CONTRACTS:
        if rival not in english if rival else True:
            latin = any(f" {w} " in flat for w in words if w.isascii())
            if latin or any(w in flat for w in words if not w.isascii()):
                found.append(kind)
                english += [kind] * latin
    return ", ".join(dict.fromkeys(found))


READERS: dict[str, Callable[[str | None], str]] = {"salary": salary, "duration": duration, "start_date": start_date, "degree": degree, "contract": contract}
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in READERS])


@F.pandas_udf(SCHEMA)
def terms(text: pd.Series, title: pd.Series) -> pd.DataFrame:
    out = {name: text.map(read) for name, read in READERS.items()}
    return pd.DataFrame(out | {"degree": [degree(x, t) for x, t in zip(text, title)]})


@F.pandas_udf(T.StringType())
def formatted_amount(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else grouped_digits(t))
