"""The employer behind a posting, by eight kinds of evidence."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillmark.functions.employer import KINDS, employer

NAMES = ["University of Basel", "Stanford University", "Scripps Research Institute", "Universität Wien", "Boston Children's Hospital", "Weizmann Institute of Science", "King's College London", "Salk Institute for Biological Studies"]
TEMPLATES = {
    "heading": "Postdoc in yeast genetics\nOrganisation/Company\n{}\nDepartment of Physics",
    "label": "Postdoc wanted.\nEmployer: {}, Switzerland\nWe work on cells.",
    "seeks": "Our Department of Biology is large. {} invites applications for a fellow.",
    "opening": "{}\nPostdoctoral fellow in chemistry. We study many things.",
    "about": "We study proteins. About {}. Founded long ago.",
    "name": "The fellow will study proteins with colleagues from {} and others.",
}


@pytest.mark.parametrize("kind", TEMPLATES)
def test_kinds(kind):
    for name in NAMES:
        text = TEMPLATES[kind].format(name)
        got = employer(text)
        assert got and (got.name, got.kind) == (name, kind), (got, text)
        assert text[got.place :].startswith(name)


def test_known_and_at():
    assert employer("A post in the group for enzymes of ETH Zurich awaits.")[:2] == ("ETH Zurich", "known")
    assert employer("The fellow, based at RIKEN in Japan, studies brains.")[:2] == ("RIKEN", "at")
    assert employer("You will be based at Genentech in a team.")[:2] == ("Genentech", "at")
    assert employer("a post at Deep Sea Works", {"deep sea works"})[:2] == ("Deep Sea Works", "at")


@pytest.mark.parametrize("text", [None, "", " \n", "We are hiring postdocs.", "The Department of Biology is large.", "Our School of Medicine and the Graduate School.", "Position description. Apply now.", "a university that we don't name"])
def test_none(text):
    assert employer(text) is None


def test_precision_on_built_postings():
    rng = random.Random(257)
    noise = ["Closing date: 2026-03-01.", "We study cells and genes.", "The School of Medicine is near.", "Please apply with a CV.", "Salary: $60,000 per year."]
    right = found = 0
    for _ in range(600):
        name, kind = rng.choice(NAMES), rng.choice(list(TEMPLATES))
        tail = " ".join(rng.sample(noise, 3))
        got = employer(TEMPLATES[kind].format(name) + " " * (kind not in ("heading", "opening")) + "\n" * (kind in ("heading", "opening")) + tail)
        found += got is not None
        right += got is not None and got.name == name
    assert found == 600 and right / found > 0.97
    assert set(TEMPLATES) | {"known", "at"} == set(KINDS)


def test_sql_names(spark):
    from quillmark.functions.register import register

    register(spark)
    got = spark.sql("SELECT extract_employer('Employer: University of Basel').kind AS k, extract_employer('').name AS n, valid_name('Ada Byron') AS v, valid_name('San Francisco') AS w").first()
    assert (got.k, got.n, got.v, got.w) == ("label", None, True, False)


@given(st.text(max_size=200))
def test_any_text(text):
    employer(text)
