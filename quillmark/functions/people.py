"""Who leads: names of principal investigators in postings, titles and web pages.

Runs of capitalised words are candidates. What stands beside a run, titles left aside, says whether it leads: a role
("PI:"), a relation ("supervised by", "the group of") before it, or a unit ("Lab") or role behind it. Relations are a
table of words with ranks; the best rank wins, then the first place. A gate keeps what isn't a person: words of
postings and fields, and the names of places, which callers may extend. A surname alone ("Badran Lab") is completed
from elsewhere in the text.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\s\w]")
_SYLLABLE = re.compile(r"[가-힣]")
_HANGUL = re.compile(r"[가-힣]{2,4}")
_POSSESSIVE = re.compile(r"['’]s?$")
TITLES = {"prof", "professor", "dr", "doctor", "assoc", "asst", "pd"}
PARTICLES = {"van", "von", "de", "der", "den", "del", "da", "di", "la", "le", "bin", "al"}
UNITS = {"lab", "labs", "laboratory", "laboratories", "group", "team"}

#: Words that are in no name: those of sentences, of posts and places of work, and of fields and their methods.
SENTENCE = frozenset("a an the this that these our their his her its your my we you they it and or of in on at to for from with by as is are be will have has now here all any each more about new old full full-time part part-time please apply join see read view learn click contact work working perform conduct manage develop lead post expired current open next last first further former general special national international regional global federal public central virtual".split())
WORK = frozenset("research researcher scientist science sciences scientific senior junior assistant associate postdoctoral postdoc post-doc fellow fellowship position positions job jobs career employment application applications candidate candidates student students staff people faculty professor doctor doc phd msc bsc principal investigator director head leader manager mentor advisor adviser supervisor department division institute institution university college school academy center centre hospital clinic company program programme project projects office unit lab labs laboratory group team teams campus foundation society council ministry agency network networks status description schedule skills leadership training teaching funding equity benefits food resources".split())
FIELD = frozenset("life earth data cell cells gene genes genetic genomic protein proteins human tissue tumor tumour cancer stem drug vaccine plant plants animal marine immune neural signal brain medicine medical clinical biomedical biological computational molecular synthetic structural functional pharmaceutical chemical physical metabolic organic analytical translational precision advanced applied machine deep digital quantum renewable energy climate environmental health therapy discovery design learning engineering sequencing imaging editing computing modelling modeling signalling signaling screening testing manufacturing technology technologies systems material materials management measurement development evolution language vision robotics nutrition acoustics".split())
NOT_NAMES = SENTENCE | WORK | FIELD
_FIELD_ENDINGS = ("ology", "omics", "istry", "physics", "iatry", "ometry", "ography", "genetics")
#: Directions and the like that begin names of places and of no person.
_PLACE_BEGINNINGS = {"united", "north", "south", "east", "west", "northern", "southern", "eastern", "western", "los", "las", "fort", "port", "cape", "mount", "lake", "upper", "lower", "great", "republic", "saudi", "costa"}
#: Places that read like names of persons. Callers give more of their own.
PLACES = frozenset({"san francisco", "san diego", "san jose", "san antonio", "santa barbara", "santa cruz", "santa fe", "salt lake", "ann arbor", "palo alto", "hong kong", "sri lanka", "puerto rico", "el salvador", "buenos aires", "rio de janeiro", "sao paulo", "tel aviv", "abu dhabi", "kuala lumpur", "ho chi minh", "de kalb", "baton rouge", "des moines", "chapel hill", "cold spring", "cold spring harbor", "woods hole", "oak ridge", "los alamos"})


class Run(NamedTuple):
    words: tuple[str, ...]
    begin: int  # tokens
    end: int
    possessive: bool

    @property
    def name(self) -> str:
        return " ".join(self.words)


def _plain(word: str) -> str:
    return _POSSESSIVE.sub("", word).lower()


@lru_cache(maxsize=1 << 14)
def _capitalised_word_of_name(word: str) -> bool:
    bare = _POSSESSIVE.sub("", word)
    low = bare.lower()
    if len(bare) < 2 or not bare[0].isupper() or low in NOT_NAMES or low.endswith(_FIELD_ENDINGS) or low in UNITS or low in TITLES:
        return False
    if bare.isupper() and len(bare) <= 4:
        return False
    return not low.isascii() or bool(re.search("[aeiouy]", low))


def _word_of_name(word: str) -> bool:
    """Could this be a given name or a surname by how it is written?"""
    return word[:1].isupper() and _capitalised_word_of_name(word)


def _place(words: list[str], places: Collection[str]) -> bool:
    low = [w.lower().rstrip(".,;:") for w in words]
    starts = [" ".join(low[:k]) for k in range(2, len(low) + 1)]
    return low[0] in _PLACE_BEGINNINGS or any(s in PLACES or s in places for s in starts)


def is_name(name: str | None, places: Collection[str] = ()) -> bool:
    """Does this read as a person's full name? ``places``, in lower case, are names of places besides the known ones."""
    if not name:
        return False
    if _HANGUL.fullmatch(name):
        return True
    words = name.split()
    if len(words) < 2 or len(name.strip()) < 4 or _place(words, places):
        return False
    inner = lambda w: w.lower() in PARTICLES or re.fullmatch(r"[^\W\d_]\.?", w) is not None
    ends = [w.rstrip(".,;:") for w in (words[0], words[-1])]
    first = _word_of_name(ends[0]) or (len(words) > 2 and re.fullmatch(r"[A-ZÀ-Þ]", ends[0]) is not None)
    return first and _word_of_name(ends[1]) and all(inner(w) or _word_of_name(w.rstrip(".,;:")) for w in words[1:-1])


def _runs(t: list[str]) -> Iterator[Run]:
    """The longest runs of words of a name: given names, initials and particles, up to four; single words as well."""
    i = 0
    while i < len(t):
        if not _word_of_name(t[i]) or t[i].lower() in PARTICLES:
            i += 1
            continue
        begin, words, end, own = i, [_POSSESSIVE.sub("", t[i])], i + 1, bool(_POSSESSIVE.search(t[i]))
        k, pending = i + 1, []
        while not own and k < len(t) and len(words) + len(pending) < 4:
            if len(t[k]) == 1 and t[k].isalpha() and t[k].isupper():
                pending.append(t[k] + "." * (k + 1 < len(t) and t[k + 1] == "."))
                k += len(pending[-1])
            elif t[k].lower() in PARTICLES and not t[k][0].isupper():
                pending.append(t[k])
                k += 1
            elif _word_of_name(t[k]):
                own = bool(_POSSESSIVE.search(t[k]))
                words += [*pending, _POSSESSIVE.sub("", t[k])]
                pending, k = [], k + 1
                end = k
            else:
                break
        yield Run(tuple(words), begin, end, own)
        i = max(end, i + 1)


#: Relations: what ends right before a name (titles, "the" and signs left aside), by rank. | parts alternatives of a word.
BEFORE = (
    (1, "lab|laboratory|laboratories|group|team of"),
    (1, "lab|laboratory|laboratories|group|team led|headed|directed|run by"),
    (2, "pi"),
    (2, "principal investigator"),
    (2, "supervisor|advisor|adviser"),
    (2, "project|group leader"),
    (2, "project|program|programme coordinator"),
    (2, "head of project|programme|program"),
    (2, "lab|laboratory director|head|manager"),
    (2, "reporting to"),
    (4, "supervision|direction|guidance|mentorship of"),
    (7, "directed|headed|led|managed|run|supervised|mentored by"),
    (10, "mentor"),
    (10, "mentor is"),
    (10, "faculty sponsor"),
)
_BEFORE = tuple((rank, tuple(frozenset(w.split("|")) for w in phrase.split())) for rank, phrase in BEFORE)
CONTACTS = {"contact", "inquiry", "inquiries", "enquiries", "question", "questions", "message", "directed"}
COMPANY = {"join", "with", "assist"}
ROLES_BEHIND = (("group", "leader"), ("lab", "head"), ("laboratory", "head"), ("lab", "director"), ("laboratory", "director"), ("principal", "investigator"), ("project", "leader"))


def _rank(t: list[str], run: Run) -> int | None:
    """How well the words beside a run say that it leads: 1 is best; None if nothing does."""
    k, titled, signs = run.begin - 1, False, set()
    while k >= 0 and (t[k].lower() in TITLES or t[k] in ".,:=-–()" or t[k].lower() == "the"):
        titled |= t[k].lower() in TITLES
        if t[k] == "." and not titled and t[k - 1].lower() not in TITLES:
            break
        signs.add(t[k])
        k -= 1
    before = [w.lower() for w in t[max(0, k - 5) : k + 1]]
    after = [w.lower() for w in t[run.end : run.end + 4]]
    ranks = [rank for rank, phrase in _BEFORE if len(before) >= len(phrase) and all(w in p for w, p in zip(before[-len(phrase) :], phrase))]
    unit = bool(after) and after[0] in UNITS
    if titled and (unit or run.possessive or after[:1] == ["research"]):
        ranks.append(3)
    if CONTACTS.intersection(before[-2:]) and after[:1] and after[0] in ("at", "@", "(", "["):
        ranks.append(5)
    if unit and t[run.end][0].isupper():
        ranks.append(6)
    if titled and before and before[-1] in COMPANY:
        ranks.append(8)
    if unit and before and before[-1] == "in":
        ranks.append(9)
    if "by" in before[-1:] and re.search(r"\b(directed|headed|led|supervised) (at|in) ", " ".join(w.lower() for w in t[max(0, k - 14) : k + 1])):
        ranks.append(11)
    if titled and "(" in signs and after[:1] and after[0] in ")," :
        ranks.append(12)
    if after[:1] == [","] and tuple(after[1:3]) in ROLES_BEHIND:
        ranks.append(13)
    return min(ranks, default=None)


KOREAN_ROLES = ("연구책임자", "책임교수", "지도교수", "담당교수", "소속책임자", "PI")
_KOREAN = re.compile(r"(?:" + "|".join(r"\s*".join(re.escape(c) for c in w) for w in KOREAN_ROLES) + r")\s*[:：\s]\s*([가-힣]{2,4})(?=$|[\s(,/]|교수|박사)|([가-힣]{2,4})\s*(?:교수|박사|연구원|선생)(?:님)?의?\s*(?:연구실|랩|Lab)")


def _of_unit(t: list[str], places: Collection[str], runs: list[Run] | None = None) -> str | None:
    """The first run, one word or a full name, that a lab is named after."""
    for run in _runs(t) if runs is None else runs:
        named = run.end < len(t) and t[run.end].lower() in ("lab", "laboratory") and (t[run.end][0].isupper() or run.possessive or t[run.begin - 1] in (".", "Dr", "Prof"))
        if named and len(run.name) >= 3 and (is_name(run.name, places) if len(run.words) > 1 else run.words[0].lower() not in places):
            return run.name
    return None


def full_name(surname: str | None, text: str | None, places: Collection[str] = ()) -> str | None:
    """The full name that the text gives with the surname, one with a title before it first."""
    if not surname or not text:
        return None
    t = _TOKEN.findall(text)
    runs = [r for r in _runs(t) if len(r.words) > 1 and r.name.endswith(" " + surname) and is_name(r.name, places)]
    titled = [r for r in runs if {x.lower() for x in t[max(0, r.begin - 2) : r.begin]} & TITLES]
    return next((r.name for r in (*titled, *runs)), None)


def in_title(title: str | None, places: Collection[str] = ()) -> str | None:
    """The name in a title such as "Badran Lab" or "faculty mentor Ada Byron"."""
    t = _TOKEN.findall(title or "")
    for run in _runs(t):
        k = run.begin - 1
        while k >= 0 and (t[k].lower() in TITLES or t[k] in ".:,"):
            k -= 1
        if k >= 0 and t[k].lower() in ("mentor", "advisor", "adviser", "sponsor") and is_name(run.name, places):
            return run.name
    return _of_unit(t, places)


def leader(text: str | None, places: Collection[str] = ()) -> str | None:
    """The name of who leads, by the best cue that has one; a surname alone if that is all there is."""
    if not text:
        return None
    if not text.isascii() and _SYLLABLE.search(text) and (m := _KOREAN.search(re.sub(r"\s+", " ", text))):  # either form has a name in Hangul
        return m[1] or m[2]
    t = _TOKEN.findall(text)
    runs = list(_runs(t))
    ranked = ((rank, run.begin, run.name) for run in runs if len(run.words) > 1 and is_name(run.name, places) and (rank := _rank(t, run)) is not None)
    if best := min(ranked, default=None):
        return best[2]
    surname = _of_unit(t, places, runs)
    return surname and (full_name(surname, text, places) or surname)


@F.pandas_udf(T.StringType())
def leader_of(s: pd.Series) -> pd.Series:
    return s.map(leader)


@F.pandas_udf(T.StringType())
def leader_in_title(s: pd.Series) -> pd.Series:
    return s.map(in_title)


@F.pandas_udf(T.BooleanType())
def valid_name(s: pd.Series) -> pd.Series:
    return s.map(is_name)
