from datetime import datetime as T

from caseweave.operators import orphans
from tests.conftest import rows

TERMS = "term_id string, parents array<string>, alt_ids array<string>, obsolete boolean, replaced_by string, added_at timestamp, modified_at timestamp"


def terms(spark):
    old, new = T(2010, 1, 1), T(2024, 1, 1)
    return spark.createDataFrame(
        [
            ("X:1", [], ["X:91"], None, None, old, old),
            ("X:2", ["x:1 ", None, ""], None, True, " x:3", old, old),
            ("X:3", ["X:1"], [], True, "X:91", old, old),  # two steps and an alternative id
            ("X:4", [], [], True, None, old, old),  # withdrawn
            ("X:5", [], [], True, "X:6", old, old),  # circle
            ("X:6", [], [], True, "X:5", old, old),
            ("X:7", ["X:404"], [], True, "X:404", old, old),  # broken chain
            ("X:8", [], [], False, None, new, new),
            ("X:9", [], [], False, None, None, None),  # always there
            ("X:1", [], ["X:91"], None, None, old, old),  # repeated row
        ],
        TERMS,
    )


def test_validity(spark):
    got = {r["ref_id"]: (r["fate"], r["valid_from"]) for r in orphans.key_validity(terms(spark)).collect()}
    assert got["X:2"] == got["X:3"] == got["X:91"] == ("live", T(2010, 1, 1))
    assert got["X:4"][0] == got["X:5"][0] == got["X:6"][0] == "deleted"
    assert got["X:7"][0] == "missing"
    assert got["X:9"] == ("live", None)


def test_classify(spark):
    refs = spark.createDataFrame([("a", "X:8", T(2020, 1, 1)), ("b", "X:8", T(2025, 1, 1)), ("c", "X:0", None), ("d", "X:4", None), ("e", "X:9", T(2000, 1, 1)), ("f", "X:8", None)], "row_key string, ref_id string, ref_time timestamp")
    got = {r["row_key"]: r["reason"] for r in orphans.classify(refs, orphans.key_validity(terms(spark))).collect()}
    assert got == {"a": "late", "c": "missing", "d": "deleted"}


def test_whole_and_empty(spark):
    from caseweave.schema import CASE_RECORD

    cases = spark.createDataFrame([], CASE_RECORD + ", ingested_at timestamp")
    ann = spark.createDataFrame([(1, " x:404\t", T(2021, 3, 1)), (1, " x:404\t", T(2021, 3, 1)), (2, "", None), (3, None, None)], "ann_id bigint, hpo_id string, created_at timestamp")
    got = rows(orphans.orphans(cases, ann, terms(spark).filter("term_id = 'X:1'")))
    assert got == [("disease_annotations", "1", "X:404", "2021-03", "missing")]
    assert orphans.orphans(cases, ann.filter("false"), terms(spark).filter("false")).count() == 0
