import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, apply in pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = pipeline.stage(apply(spark, docs, DATA))
        ids = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and ids <= before and ids, name
        before = ids
    out = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in out.collect()} == before
    assert {r.doc_id for r in entry.queries()["pipeline"](spark, DATA).collect()} == before


def test_one_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:59], "other"]
    rows = [(4, " ".join(words)), (2, " ".join(near)), (9, " ".join(words)), (5, "quite another text of some words"), (None, " ".join(words)), (7, None), (8, ""), (2, " ".join(near))]
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], SCHEMA)
    got = pipeline.near_duplicates(spark, docs, DATA).collect()
    assert sorted(repr(r.doc_id) for r in got) == ["2", "5", "7", "8", "None"]


def test_rows_that_share_a_doc_id(spark):
    """Unlinked texts of one doc_id all stay; linked ones and copies go, whatever their ids."""
    words = [f"w{i}" for i in range(60)]
    a, near, b, c = " ".join(words), " ".join([*words[:59], "other"]), " ".join(f"b{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40))
    rows = [(1, a), (1, b), (1, near), (1, b), (2, b), (3, c), (4, c), (4, "one more text"), (5, None), (5, ""), (5, ""), (6, a), (None, a), (None, "x")]
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, DATA).collect()), key=repr)
    assert [g for g in got if g[0] == 1 and g[1] != b] in ([(1, a)], [(1, near)])
    assert [g for g in got if g[0] != 1 or g[1] == b] == sorted([(1, b), (3, c), (4, "one more text"), (5, None), (5, ""), (None, a), (None, "x")], key=repr)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_and_odd_rows(spark, name):
    apply = dict(pipeline.STAGES)[name]
    none = spark.createDataFrame([], SCHEMA)
    assert apply(spark, none, DATA).collect() == []
    good = " ".join(f"word{i} and" for i in range(30))
    odd = spark.createDataFrame([(1, None, None, None, None), (None, good, None, None, None), (2, "", "en", "s", 0), (3, good * 200, "en", "s", 0), (3, good * 200, "en", "s", 0)], SCHEMA)
    kept = [r.doc_id for r in apply(spark, odd, DATA).collect()]
    assert None in kept and (name == "quality" or 3 in kept)
