"""Extra columns keep their names and values, whatever they are called."""

import pytest

from quillmark.llm import near_copies, op2_url_filter, op3_simhash_dedup, op4_mixing, op5_decontamination, op6_line_dedup, op7_secrets, op8_toxicity

NAMES = "a b c d e f g h i j k n o p r s t w x y z id th fp key node root first null line gone part base copy times extra passes block weight score found host path rule verdict size words cls salt t1 t2 n_words spans items start stop label title text2 row __0 __1 __2 __3 __a __w __n __i __th __text __score __found __host __gone __copy __times __id __null __s".split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six", "one two three four five six", "", None, "password = hunter2hunter2\nl1\nl2\nl3\nl4", "l1\nl2\nl3\nl4", "zz top of the pops"]
    rows = [(None if k == 6 else k, t, "en", "s", f"http://com/en/{k}", *(f"{c}{k}" for c in NAMES)) for k, t in enumerate(texts)]
    kinds = ["doc_id long", "text string", "lang string", "source string", "url string", *(f"`{c}` string" for c in NAMES)]
    return spark.createDataFrame(rows, ", ".join(kinds)).cache()


def same(found, docs, n, last=0):
    names = docs.columns
    assert found.columns[: len(names)] == names and len(found.columns) == len(names) + last
    rows = found.collect()
    assert len(rows) == n
    at = {c: i for i, c in enumerate(names)}
    for r in rows:
        k = 6 if r[0] is None else r[0]
        assert [r[at[c]] for c in NAMES] == [f"{c}{k}" for c in NAMES]
    return rows


def test_extra_columns(spark, docs):
    same(op2_url_filter.judged(docs), docs, 7, 4)
    same(op7_secrets.scan(docs, op7_secrets.train([])), docs, 7, 1)
    model = op8_toxicity.Model(rate=0.1)
    same(op8_toxicity.scored(docs, model), docs, 7, 1)
    same(op8_toxicity.reject(docs, model), docs, 7)
    same(op3_simhash_dedup.one_of_each(docs), docs, 5)
    same(near_copies.one_of_each(docs), docs, 5)
    same(op4_mixing.mixed(docs), docs, 7)
    rows = same(op6_line_dedup.without_repeats(docs), docs, 7)
    assert {r[0]: r[1] for r in rows}[5] == ""
    items = spark.createDataFrame([(1, "zz top")], "item_id long, text string")
    same(op5_decontamination.judged(docs, items), docs, 7, 6)
    same(op5_decontamination.clean(docs, items), docs, 6)


def test_repeated_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "same text", "en", "s", i % 2) for i in range(40)] + [(None, None, "en", None, 0)] * 9, "doc_id long, text string, lang string, source string, n int")
    assert op3_simhash_dedup.one_of_each(docs).count() == 2 and near_copies.one_of_each(docs).count() == 2
    assert op4_mixing.query(docs).count() == 49 and op4_mixing.mixed(docs, budget=0.5, max_repetition=9).count() <= 49
    taken = op4_mixing.mixed(docs.where("text is not null").withColumn("source", docs.source), budget=0.55, target_entropy=0.0)
    assert taken.count() == 22  # of forty alike
    assert op6_line_dedup.query(docs).count() == 49
