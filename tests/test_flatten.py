import json
from datetime import datetime as T

from hypothesis import given, settings
from hypothesis import strategies as st

from caseweave.operators import flatten
from tests.conftest import rows

EV = {"source_id": "PMID:1", "section": "title"}
REC = {"id": "r", "phenotypes": [None, {"term": {"id": "X:1"}, "evidence": [EV, None, EV]}, {"evidence": EV}], "variants": {"gene": {"id": "G:1"}, "evidence": json.dumps([EV])}}


def frame(spark, payloads):
    return spark.createDataFrame([(i, "o", p, T(2024, 1, 1), "x") for i, p in payloads], "raw_id bigint, origin string, payload string, received_at timestamp, node string")


def found(spark, payloads):
    ev = flatten.evidence_table(flatten.with_parents(flatten.nodes(frame(spark, payloads))))
    return rows(ev.select("raw_id", "record_id", "item_kind", "item_pos", "evidence_pos", "source_id"))


def test_shapes(spark):
    one = [("phenotype", 1, 0), ("phenotype", 1, 2), ("phenotype", 2, 0), ("variant", 0, 0)]
    text = {**REC, "phenotypes": json.dumps(REC["phenotypes"])}
    got = found(spark, [(1, json.dumps(REC)), (2, json.dumps({"record": text})), (3, json.dumps({"records": [REC, None, {"id": 5}]})), (1, json.dumps(REC))])
    assert got == sorted([(i, "r", k, p, e, "PMID:1") for i in (1, 2, 3) for k, p, e in one], key=repr)


def test_bad_payloads(spark):
    bad = ["", None, "{", "[1]", "3", '{"id": NaN, "phenotypes": []}', "{}", '{"records": null}', '{"record": "x"}']
    assert found(spark, list(enumerate(bad))) == []
    assert found(spark, [(1, '{"id": "\\ud800x", "variants": {"evidence": {"source_id": "é\\ud800", "n": "\\ud800"}}}')]) == [(1, "?x", "variant", 0, 0, "é?")]
    assert flatten.nodes(frame(spark, [])).count() == 0


def test_extreme_payloads(spark):
    deep = "[" * 200_000 + "]" * 200_000
    odd = ['{"x": %s, ' % deep, '{"x": %s, ' % ("7" * 5000), '{"x": {"y": [1, -2.5e3, true, null, "\\u00e9", %s]}, ' % ("[" * 200_000 + '{"a": {}, "b": []}' + "]" * 200_000)]
    assert found(spark, [(i, o + '"id": "r", "variants": {"evidence": {"source_id": "PMID:1"}}}') for i, o in enumerate(odd)]) == [(i, "r", "variant", 0, 0, "PMID:1") for i in range(3)]
    assert flatten.parse('{"id": %s}' % ("7" * 5000)) == {"id": "7" * 5000}
    assert flatten.parse(deep[:-1]) is flatten.parse(deep + "x") is flatten.parse('{"a": NaN, "b": %s}' % ("7" * 5000)) is None


@settings(deadline=None)
@given(st.text(max_size=4) | st.text('[]{},:"\\0123-.eEtrufalsn \t\x0b', max_size=12) | st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)).map(lambda v: json.dumps(v, indent=1)))
def test_parse_any_is_json(text):
    try:
        want = json.loads(text, parse_constant=flatten._refuse)
    except ValueError:
        want = ValueError
    try:
        got = flatten.parse_any(text)
    except ValueError:
        got = ValueError
    assert got == want and type(got) is type(want)


def test_tables_keep_parents(spark):
    tree = flatten.nodes(frame(spark, [(1, json.dumps({"records": [REC, {**REC, "id": 7}]}))]))
    linked = flatten.with_parents(tree)
    assert rows(flatten.record_table(tree).select("record_pos", "record_id")) == [(0, "r"), (1, "7")]
    assert flatten.assertion_table(linked).filter("record_pre is null").count() == 0
    assert flatten.evidence_table(linked).filter("item_pre is null").count() == 0


leaf = st.one_of(st.none(), st.integers(), st.text(max_size=3))
tree = st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["id", "phenotypes", "variants", "evidence", "term", "records", "record"]), x, max_size=4)), max_leaves=15)


@settings(max_examples=200, deadline=None)
@given(tree)
def test_intervals_nest(value):
    got: list = []
    flatten.walk_payload(1, json.dumps(value), got)
    numbers = sorted(x for r in got for x in (r[2], r[3]))
    assert numbers == list(range(1, len(numbers) + 1))
    for a in got:
        for b in got:
            assert a[3] < b[2] or b[3] < a[2] or (a[2] <= b[2] and b[3] <= a[3]) or (b[2] <= a[2] and a[3] <= b[3])
