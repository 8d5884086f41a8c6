"""Names, terms and Korean fields."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import extract, korean, people, terms


@pytest.mark.parametrize(
    "text, want",
    [
        ("A position in the laboratory of Dr. Ahmed Badran at the institute.", "Ahmed Badran"),
        ("PI: John Smith. The lab focuses on cells.", "John Smith"),
        ("Principal Investigator: Dr. Maria Garcia at MIT.", "Maria Garcia"),
        ("Work under the supervision of Prof. Feng Zhang on enzymes.", "Feng Zhang"),
        ("Join Prof. Jennifer Doudna's lab at Berkeley.", "Jennifer Doudna"),
        ("For inquiries contact Dr. Sarah Chen at chen@university.edu", "Sarah Chen"),
        ("Join The Michael Elowitz Lab for systems research.", "Michael Elowitz"),
        ("The project is supervised by Dr. Mitchell Ho at the NIH.", "Mitchell Ho"),
        ("Opportunity to join Dr. Christina Smolke in Stanford.", "Christina Smolke"),
        ("The team is led by Prof. David Baker at UW.", "David Baker"),
        ("Work in the Prof. Joelle Bhatt lab on stem cells.", "Joelle Bhatt"),
        ("Mentor: Dr. Emily Balskus at Harvard.", "Emily Balskus"),
        ("The project is directed by Dr. George Church at the institute.", "George Church"),
        ("Group of Prof. Dr. Thomas Schwartz in Munich.", "Thomas Schwartz"),
        ("The Badran Lab is hiring. Ahmed Badran studies ribosomes.", "Ahmed Badran"),
        ("The Coruzzi Lab is hiring.", "Coruzzi"),
        ("Research Lab of cells; Cell Biology Group", None),
        ("연구책임자: 홍길동 (hong@example.org)", "홍길동"),
        ("김철수 교수님의 연구실", "김철수"),
        ("We are seeking a postdoctoral researcher for our biology department.", None),
        ("", None),
        (None, None),
    ],
)
def test_leader(text, want):
    assert people.leader(text) == want


@pytest.mark.parametrize("title, want", [("Postdoc - Badran Lab", "Badran"), ("Postdoc in Dr. Wan's Lab", "Wan"), ("Fellow (Coruzzi Lab)", "Coruzzi"), ("Fellow, faculty mentor Lynette Cegelski", "Lynette Cegelski"), ("Research Lab manager", None), (None, None)])
def test_leader_in_title(title, want):
    assert people.in_title(title) == want


@pytest.mark.parametrize(
    "name, want",
    [("John Smith", True), ("Maria Garcia", True), ("Joanna Basta-Kaim", True), ("the university", False), ("Cell Biology", False), ("Machine Learning", False), ("ab", False), ("john", False), ("john smith", False), ("The Department", False), ("Gene Therapy", False), ("Central Hr", False), ("홍길동", True), (None, False)],
)
def test_names(name, want):
    assert people.is_name(name) is want


def test_full_name():
    assert people.full_name("Badran", "The lab of Dr. Ahmed H. Badran") == "Ahmed H. Badran"
    assert people.full_name(None, None) is None and people.full_name("Badran", "The Badran") is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("Salary: $60000 - $65000 per year", "$60,000 - $65,000 per year"),
        ("We pay €42.185,28 gross", "€42,185"),
        ("TV-L E13 applies", "TV-L E13"),
        ("NIH scale", "NIH scale"),
        ("Paid at Grade 7", "Grade 7"),
        ("42.185,28 €", "42,185 €"),
        ("급여: 연봉 5000만원", "연봉 5,000만원"),
        ("no money named", ""),
        (None, ""),
    ],
)
def test_salary(text, want):
    assert terms.salary(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Duration: 2 years", "2 years"),
        ("a 24 months fixed-term post", "24 months"),
        ("a two-year position", "two-year"),
        ("at least 3 years of experience", ""),
        ("contract for 1-2 years, renewable", "1-2 years"),
        ("계약기간: 2년 6개월", "2년 6개월"),
        ("founded 3 years ago", ""),
        (None, ""),
    ],
)
def test_duration(text, want):
    assert terms.duration(text) == want


def test_other_terms():
    assert terms.start_date("Starting date: March 1, 2026.") == "March 1, 2026" and terms.start_date("start as soon as possible") == "as soon as possible"
    assert terms.degree("PhD in Molecular Biology; skills") == "PhD in Molecular Biology" and terms.degree("", "Post-doc in x") == "Doctorate" and terms.degree(None) == ""
    assert terms.contract("Full-time, fixed-term, renewable") == "Full-time, Fixed-term" and terms.contract("계약직 상근") == "Fixed-term, Full-time" and terms.contract(None) == ""


POSTING = "모집기관: 한국생명공학연구원\n소속 부서: 합성생물학연구센터\n연구분야: 생명과학>합성생물학 기타\n연구책임자: 김철수 교수 (kim@example.org)\n담당업무: CRISPR assay 개발\n지원자격: 박사학위\n급여: 연 6,000만원\n계약기간: 2년\n근무지역: 대전\n1. 제출서류\n이력서\n추천서\n□ 우대사항\nNGS 경험"


def test_korean_fields():
    got = korean.fields(POSTING)
    assert got["institute"] == "한국생명공학연구원" and got["department"] == "합성생물학연구센터" and got["pi_name"] == "김철수"
    assert got["conditions"] == "급여: 연 6,000만원 | 계약기간: 2년 | 근무지: 대전" and got["materials"] == "이력서\n추천서" and got["preferred"] == "NGS 경험"
    assert got["field"] == "생명과학" and got["requirements"] == "박사학위" and korean.fields(None) == {}


def test_korean_columns(spark):
    titles = ["경북대학교 의과대학 면역독성/약리학교실 Post-Doc. 모집", "UNIST 생명과학과 Post-Doc. 모집", "한화생명 인천검진센터 센터장 모집", "전라북도 남원의료원 영상의학과 의사 모집", "모집", "2026.03", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "k int, t string")
    institute, unit = korean.place_of("t")
    rows = {r.k: r for r in df.select("k", korean.relevant("t").alias("bio"), korean.valid_title("t").alias("ok"), institute.alias("i"), unit.alias("d"), korean.research_field("t", F.lit("")).alias("f"), korean.keywords("t").alias("w")).collect()}
    assert (rows[0].i, rows[0].d) == ("경북대학교", "의과대학 면역독성/약리학교실")
    assert rows[1].i.endswith("(UNIST)") and rows[1].d == "생명과학과" and rows[1].f == "Life Sciences" and rows[1].w == ["생명과학"]
    assert [rows[k].bio for k in range(7)] == [True, True, False, False, False, False, False]
    assert [rows[k].ok for k in range(7)] == [True, True, True, True, False, False, False]


@pytest.mark.parametrize("name", ["San Francisco", "Los Angeles", "United States", "New York", "North Carolina", "Apply Now", "The Lab", "MIT", "Structural Genomics", "Ada", "Basel Research", ""])
def test_no_names(name):
    assert people.is_name(name) is False


@pytest.mark.parametrize("name", ["Ahmed H. Badran", "J. Craig Venter", "Ludwig van der Meer", "Zoë Kravitz", "Østergaard Ravn", "Jean-Luc D'Arcy", "Mitchell Ho"])
def test_more_names(name):
    assert people.is_name(name) is True


@pytest.mark.parametrize(
    "text, want",
    [
        ("The Apply Now Lab. x", None),
        ("Join us in San Francisco. The team is led by the Cell Biology Group.", None),
        ("PI: United States Department", None),
        ("Work with Dr. Ada Byron on proofs. Contact: Grace Hopper (gh@example.org)", "Grace Hopper"),
        ("The group is headed by Ludwig van der Meer.", "Ludwig van der Meer"),
        ("Lise Meitner, Principal Investigator", "Lise Meitner"),
        ("The project is directed at the University of Basel by Dr. Ada Byron.", "Ada Byron"),
        ("a new position (Dr. Ada Byron) is open", "Ada Byron"),
        ("Lab Director: Ahmed H. Badran", "Ahmed H. Badran"),
    ],
)
def test_more_leaders(text, want):
    assert people.leader(text) == want


def test_places_are_given_by_the_caller():
    assert people.is_name("Baton Vert") and not people.is_name("Baton Vert", {"baton vert"})
    assert people.leader("PI: Baton Vert", {"baton vert"}) is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("stipend of 45.500 EUR per annum", "45,500 EUR per annum"),
        ("Pay range: £35,000 to £40,000/yr", "£35,000 to £40,000/yr"),
        ("compensation: $22.50 per hour", "$22.50 per hour"),
        ("TV-L E13/E14", "TV-L E13/E14"),
        ("Salary: 3 levels; Band 6", "Band 6"),
        ("3 천만원", "3 천만원"),
        ("₩60,000,000", "₩60,000,000"),
        ("part 5 of 7", ""),
    ],
)
def test_more_pay(text, want):
    assert terms.salary(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("appointment of up to three years", "three years"),
        ("The contract is initially 12 months.", "12 months"),
        ("renewable for 2 years", "2 years"),
        ("Duration: until 2027-12-31", "until 2027-12-31"),
        ("2026년 3월 31일 근무", ""),
        ("We pay USD 60,000 per year for 2 years.", "2 years"),
        ("in 3 years after the PhD, role", ""),
    ],
)
def test_more_durations(text, want):
    assert terms.duration(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Anticipated start date: September 2026", "September 2026"),
        ("available from 1 May 2026", "1 May 2026"),
        ("Commencement = 2026-04-01", "2026-04-01"),
        ("Begin March-15-2026", "March-15-2026"),
        ("근무 시작일: 2026.03.01", "2026.03.01"),
        ("채용 즉시", "채용 즉시"),
        ("ASAP", "ASAP"),
        ("founded in March 2020", ""),
    ],
)
def test_more_starts(text, want):
    assert terms.start_date(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Application deadline: March 15, 2026", "2026-03-15"),
        ("Deadline: 15 March 2026", "2026-03-15"),
        ("Closing date: 15/06/2026", "2026-06-15"),
        ("Deadline: Mar 1, 2026", "2026-03-01"),
        ("지원 마감: 2026년 3월 31일", "2026-03-31"),
        ("Closing Date August-8-2021", "2021-08-08"),
        ("공고일: 2026년 3월 31일", None),
        ("Deadline 2026-02-30", None),
        ("Deadline 2026-04-31, then 2026-05-01", "2026-05-01"),
    ],
)
def test_deadlines(text, want):
    assert extract.deadline(text) == want


def test_one_chain():
    """The chain's columns are those of the extractors; there is no second version."""
    text = "Postdoc. Salary: $60000 per year. Contract: 2 years, full-time. PhD in Physics. PI: Ada Byron. Start date: May 1, 2026."
    got = extract.fields(text)
    assert {n: got[n] for n in terms.READERS} == {n: read(text) for n, read in terms.READERS.items()} == {"salary": "$60,000 per year", "duration": "2 years", "start_date": "May 1, 2026", "degree": "PhD in Physics", "contract": "Full-time, Fixed-term"}
    assert got["leader"] == people.leader(text) == "Ada Byron"


@given(st.text(max_size=150))
def test_any_text(text):
    people.leader(text), people.in_title(text), terms.salary(text), terms.duration(text), terms.start_date(text), terms.degree(text), terms.contract(text), korean.fields(text)
