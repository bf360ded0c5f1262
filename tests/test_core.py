import math
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from caseweave.functions import text as tx
from caseweave.functions.durations import iso_days, onset
from caseweave.functions.ids import clean_id, newest
from caseweave.operators import dag, grounding, metrics, qa, rank, records, search
from tests.conftest import rows

TERMS = "term_id string, term_name string, parents array<string>, alt_ids array<string>, xrefs array<struct<xref:string,modifier:string>>, synonyms array<struct<syn:string,scope_kind:string>>, obsolete boolean, replaced_by string"


@pytest.fixture(scope="module")
def terms(spark):
    t = lambda i, name, parents, alts=(), xrefs=(), syn=(), obs=None, rep=None: (i, name, list(parents), list(alts), list(xrefs), list(syn), obs, rep)
    return spark.createDataFrame(
        [
            t("T:0", "all", []), t("T:1", "nervous finding", ["T:0"]), t("T:2", "head finding", ["T:0"]),
            t("T:3", "seizure", ["T:1"], alts=["T:93"], syn=[("fit of the brain", "RELATED"), ("convulsion", "EXACT")]), t("T:4", "focal seizure", ["T:3", " t:2"]),
            t("T:5", "old seizure", [], obs=True, rep="T:93"), t("T:6", "gone", [], obs=True), t("T:7", "loop a", [], obs=True, rep="T:8"), t("T:8", "loop b", [], obs=True, rep="T:7"),
            t("M:1", "disease one", [], xrefs=[("OMIM:1", "M:equivalentTo"), ("OMIM:2", None)]), t("M:2", "disease two", ["M:1"], xrefs=[("OMIM:2", "M:equivalentTo")]),
        ],
        TERMS,
    )


@pytest.fixture(scope="module")
def base(terms):
    r = dag.term_rows(terms)
    return r, dag.alias_closure(r), dag.closure(r)


def test_alias(base):
    got = dict(rows(base[1]))
    assert got["T:93"] == got["T:5"] == "T:3" and got["T:6"] == "T:6" and got["T:7"] == "T:7"


def test_closure(base):
    got = {(a, b): d for a, b, d in rows(base[2])}
    assert got["T:4", "T:0"] == 2 and got["T:4", "T:1"] == 2 and got["T:4", "T:4"] == 0 and ("T:1", "T:4") not in got
    again = base[2].join(base[2].select(F.col("term").alias("ancestor"), F.col("ancestor").alias("top")), "ancestor").select("term", "top").distinct()
    assert again.count() == len(got)  # idempotent


def test_distance(spark, base):
    pairs = spark.createDataFrame([("T:3", "T:4"), ("T:4", "T:4"), ("T:1", "T:2"), ("T:1", "M:1")], "a string, b string")
    assert {(r["a"], r["b"]): r["distance"] for r in dag.path_distance(pairs, base[2]).collect()} == {("T:3", "T:4"): 1, ("T:4", "T:4"): 0, ("T:1", "T:2"): 2, ("T:1", "M:1"): None}


@pytest.fixture(scope="module")
def ic(spark, base):
    ann = spark.createDataFrame([("d1", "T:4"), ("d1", "T:4"), ("d2", "T:3"), ("d3", "T:2"), ("d4", "T:1")], "owner string, term string")
    total = spark.createDataFrame([(4.0,)], "total double")
    return dag.information_content(base[0], dag.propagated_counts(ann, base[2]), total)


def test_information_content(ic):
    got = dict(rows(ic))
    assert got["T:0"] == pytest.approx(0) and got["T:1"] < got["T:3"] < got["T:4"] == pytest.approx(math.log(4))
    assert got["T:6"] == pytest.approx(math.log(4))


def test_pairs_and_lin(spark, base, ic):
    t = spark.createDataFrame([("T:3",), ("T:4",), ("T:2",)], "term string")
    p = dag.lin(dag.pair_ic(t, t, base[2], ic), ic)
    got = {(r["a"], r["b"]): (r["mica"], r["lin"]) for r in p.collect()}
    assert got["T:3", "T:3"][1] == 1.0 and 0 < got["T:3", "T:4"][1] < 1 and got["T:3", "T:4"][0] == "T:3"
    assert all(got[a, b] == got[b, a] for a, b in got)


def test_xrefs_and_labels(terms, base):
    exact = dag.xref_index(terms, base[1], ["OMIM:"], "equivalentTo")
    assert rows(dag.first_xref(exact, dag.xref_index(terms, base[1], ["OMIM:"]))) == [("OMIM:1", "M:1"), ("OMIM:2", "M:2")]
    labels = dict(rows(dag.label_index(terms)))
    assert labels["convulsion"] == "T:3" and "fit of the brain" not in labels and "gone" not in labels


def test_exact_and_sums(spark):
    p, g = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "b")], "id string, value string"), spark.createDataFrame([("c", "b"), ("c", "c"), ("e", "z")], "id string, value string")
    got = {r["id"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.exact(p, g, ["id"]).collect()}
    assert got == {"c": (1, 1, 1), "e": (0, 0, 1)}
    s = metrics.with_prf(metrics.exact(p, g, ["id"])).filter("id = 'c'").first()
    assert s["f1"] == 0.5


def test_graded(spark):
    p, g = spark.createDataFrame([("c", "x"), ("d", "x")], "id string, term string"), spark.createDataFrame([("c", "y"), ("c", "z"), ("e", "y")], "id string, term string")
    sim = spark.createDataFrame([("x", "y", 0.8), ("x", "z", 0.4)], "a string, b string, lin double")
    got = {r["id"]: (r["tp_p"], r["tp_r"], r["fp"], r["fn"]) for r in metrics.graded(p, g, sim, ["id"]).collect()}
    assert got["c"] == pytest.approx((0.8, 0.8, 0.2, 1.2)) and got["d"] == (0, 0, 1, 0) and got["e"] == (0, 0, 0, 1)


def test_cube_and_bootstrap(spark):
    s = spark.createDataFrame([(str(i), "f", "single" if i % 2 else "paper", 3.0, 1.0, 1.0, 3.0, 3.0) for i in range(40)], "id string, field string, track string, tp double, fp double, fn double, tp_p double, tp_r double")
    got = {r["track"]: r for r in metrics.summarise(s, ["track"]).collect()}
    assert got["all"]["n"] == 40 and got["single"]["micro_f1"] == pytest.approx(0.75)
    a, b = (rows(metrics.bootstrap(s, "id", n=50)) for _ in range(2))
    assert a == b and a[0][1] <= 0.75 <= a[0][2]


def test_hits(spark):
    ranked = spark.createDataFrame([("q", f"M:{i}", i) for i in (1, 2, 3)], "query string, item string, rank int")
    gold = spark.createDataFrame([("q", "M:3"), ("r", "M:1")], "query string, item string")
    got = metrics.hit_at_k(metrics.first_hit(ranked, gold), ranked, ks=(1, 3)).first()
    assert (got["hit_1"], got["hit_3"], got["hit_3_all"]) == (0.0, 1.0, 0.5) and got["mrr"] == pytest.approx(1 / 3) and got["mrr_all"] == pytest.approx(1 / 6)


def test_ranking(spark, base, ic):
    q = spark.createDataFrame([("q", "T:4")], "query string, term string")
    p = spark.createDataFrame([("a", "T:4"), ("b", "T:3"), ("b", "T:2"), ("c", "M:1")], "profile string, term string")
    top = rank.search(q, p, base[2], ic, 5)
    assert [r["profile"] for r in top.orderBy("rank").collect()] == ["a", "b"]
    assert rows(rank.explain(top, q, p, base[2], ic, min_ic=1.0).select("profile", "term")) == [("a", "T:4")]
    assert rows(rank.tally(top, spark.createDataFrame([("a", "M:1"), ("b", None)], "profile string, label string")).select("label", "n_profiles")) == [("M:1", 1)]


@pytest.mark.parametrize("text,phrase,cue", [
    ("Seizures were present but no hydrocephalus.", "hydrocephalus", "no"),
    ("Seizures were present but no hydrocephalus.", "Seizures", None),
    ("There was no evidence of retinal detachment. Hypertrichosis was absent.", "Hypertrichosis", "was absent"),
    ("There was no evidence of retinal detachment.", "retinal detachment", "no evidence of"),
])
def test_negation(spark, text, phrase, cue):
    at = text.index(phrase)
    df = spark.createDataFrame([(text, at, at + len(phrase))], "t string, s int, e int")
    assert df.select(tx.negation_cue(F.col("t"), F.col("s"), F.col("e"))).first()[0] == cue


def test_ranking_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(4)
    up = {f"t{i}": {f"t{i}"} for i in range(30)}
    for i in range(1, 30):
        for p in {rng.randrange(i) for _ in range(2)}:
            up[f"t{i}"] |= up[f"t{p}"]
    ic = {t: 0.0 if t == "t0" else round(rng.random() * 5, 3) for t in up}
    sets = {f"p{i}": set(rng.sample(sorted(up), rng.randrange(1, 6))) for i in range(60)} | {"p90": {"unknown"}, "p91": {"t0"}, "p92": {"t3", "unknown"}}
    frame = lambda d, name: spark.createDataFrame([(k, t) for k, v in d.items() for t in v], f"{name} string, term string")
    asked = {k: v for k, v in sets.items() if k in ("p1", "p2", "p3", "p92", "p90")}
    best = lambda a, b: max((ic[x] for x in up.get(a, set()) & up.get(b, set())), default=0.0)
    score = lambda q, p: (sum(max(best(a, b) for b in p) for a in q) / len(q) + sum(max(best(a, b) for a in q) for b in p) / len(p)) / 2
    want = {q: sorted(((-round(s, 9), p) for p, v in sets.items() if (s := score(sets[q], v)) > 0))[:7] for q in asked}
    closed, worth = spark.createDataFrame([(t, a) for t, v in up.items() for a in v], "term string, ancestor string"), spark.createDataFrame(list(ic.items()), "term string, ic double")
    for block in (2000, 2):
        monkeypatch.setattr(rank, "BLOCK", block)
        got = rank.search(frame(asked, "query"), frame(sets, "profile").repartition(3), closed, worth, 7).collect()
        assert {q: [(-round(r["score"], 9), r["profile"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] for q in asked} == want
    assert rank.search(frame(asked, "query").filter("false"), frame(sets, "profile"), closed, worth, 7).count() == 0


def test_cases_without_terms(spark):
    p, g = spark.createDataFrame([("a", "x")], "id string, value string"), spark.createDataFrame([("a", "x")], "id string, value string")
    cases = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert {r["id"]: (r["tp"], r["fp"]) for r in metrics.exact(p, g, ["id"], cases).collect()} == {"a": (1, 0), "b": (0, 0)}
    t = lambda f: f.withColumnRenamed("value", "term")
    closed = spark.createDataFrame([("x", "x")], "term string, ancestor string")
    assert rows(metrics.closure_jaccard(t(p), t(g), closed, ["id"], cases)) == [("a", 1.0), ("b", 1.0)]
    sim = spark.createDataFrame([("x", "x", 1.0)], "a string, b string, lin double")
    assert metrics.summarise(metrics.graded(t(p), t(g), sim, ["id"], cases=cases).withColumn("field", F.lit("f")), []).first()["macro_f1"] == 0.5


def test_grounding(spark, terms):
    words = grounding.dictionary(dag.label_index(terms), dag.label_index(terms, ("RELATED",), names=False))
    docs = spark.createDataFrame([(1, "Focal seizures, convulsion; no fit of the brain."), (2, None), (3, "")], "doc_id int, text string")
    one, two = grounding.ground(docs, words), grounding.ground_by_join(docs, words)
    assert rows(one) == rows(two)
    got = {r["phrase"]: (r["term"], r["negation_cue"]) for r in one.collect()}
    assert got == {"Focal seizures": ("T:4", None), "convulsion": ("T:3", None), "fit of the brain": ("T:3", "no")}
    text = docs.first()["text"]
    assert all(text[r["start_char"] : r["end_char"]] == r["phrase"] for r in one.collect())


def test_grounding_by_join_is_the_same(spark, monkeypatch):
    words = spark.createDataFrame([("seizure", "T:1"), ("seizures", "T:2"), ("focal seizure", "T:3"), ("ataxia of gait", "T:4"), ("gait", "T:5")], "phrase string, term string")
    texts = ["Seizures and a seizure, focal  seizures.", "No ataxia of gait; gait ataxia of gaits.", None, "", "seizuress", "Focal seizure. Focal seizure."]
    docs = spark.createDataFrame([(i % 5, t, i if i % 2 else None) for i, t in enumerate([*texts, *texts[:2]])], "doc_id int, text string, other int")
    for keep in (("doc_id",), ("doc_id", "other")):
        one, two = grounding.ground(docs, words, keep=keep), grounding.ground_by_join(docs, words, keep=keep)
        assert rows(one) == rows(two) and one.count() > 8
    got = [(r["phrase"], r["term"], r["negation_cue"]) for r in grounding.ground(docs.limit(1), words).collect()]
    assert got == [("Seizures", "T:2", None), ("seizure", "T:1", None), ("focal  seizures", "T:3", None)]
    many = grounding.ground_many(docs, {"a": words, "b": words.filter("term = 'T:5'")})
    monkeypatch.setattr(grounding, "MAX_DICTIONARY", 3)
    assert rows(grounding.ground_many(docs, {"a": words, "b": words.filter("term = 'T:5'")})) == rows(many)


def test_restricted_dictionary(spark):
    strict = spark.createDataFrame([("bilateral", "N:1"), ("big spleen", "H:1")], "phrase string, term string")
    loose = spark.createDataFrame([("large spleen", "H:1"), ("bilateral", "H:2"), ("spleno", "H:1")], "phrase string, term string")
    allowed = spark.createDataFrame([("H:1",), ("H:2",)], "term string")
    assert rows(grounding.dictionary(strict, loose, allowed)) == [("big spleen", "H:1"), ("large spleen", "H:1")]


@pytest.mark.parametrize("text", ["x " * 40 + "no sign of fits. Seizure", "not seen although there was Seizure", "Seizure was absent", "Seizure but not seen", "denied any Seizure", "knots of Seizure was ok; ruled out", "İİ no Seizure"])
def test_cue_in_both_ways(spark, text):
    at = text.index("Seizure")
    df = spark.createDataFrame([(text, at, at + 7)], "t string, s int, e int")
    assert df.select(tx.negation_cue(F.col("t"), F.col("s"), F.col("e"))).first()[0] == tx.cue_near(text, at, at + 7)


@pytest.mark.parametrize("text,days", [("P5Yoops", None), ("P1YT3H", None), (" P5Y ", 1826.25), ("P32W", 224.0), ("garbage", None), ("P0D", 0.0), ("P0Y", None), ("P", None), ("P1M1Y", None), ("P1Y1Y", None), (None, None)])
def test_durations_are_whole(spark, text, days):
    assert spark.createDataFrame([(text,)], "t string").select(iso_days(F.col("t"))).first()[0] == days


def test_latest_row_of_a_term(spark):
    t = spark.createDataFrame([("T:1", ["T:0"], True, T(2020, 1, 1)), ("t:1 ", ["T:2"], None, T(2021, 1, 1))], "term_id string, parents array<string>, obsolete boolean, modified_at timestamp").selectExpr(
        "*", "array() AS alt_ids", "string(null) AS replaced_by", "string(null) AS term_name"
    )
    assert rows(dag.term_rows(t).select("id", "obsolete", "parents")) == [("T:1", False, ["T:2"])]


def test_patterns(spark):
    df = spark.createDataFrame([(1, "NM_138961.3:c.35T>A (p.Leu12Ter) in STXBP1 and LCA")], "doc_id int, text string")
    assert {r["kind"] for r in grounding.variant_mentions(df).collect()} == {"hgvs.c", "hgvs.p"}
    genes = spark.createDataFrame([("STXBP1", "G:1"), ("LCA", "G:2")], "symbol string, gene string")
    assert [r["gene"] for r in grounding.gene_mentions(df, genes).collect()] == ["G:1"]


def test_durations(spark):
    df = spark.createDataFrame([("P32W",), ("P1Y6M",), ("garbage",), (None,), ("P0D",), ("P0Y",)], "d string")
    got = [r[0] for r in df.select(iso_days(F.col("d"))).collect()]
    assert got[0] == 224.0 and got[1] == pytest.approx(547.89) and got[2:] == [None, None, 0.0, None]
    assert df.select(onset(F.col("d"))["gestational_weeks"]).first()[0] == 32


def test_ids(spark):
    df = spark.createDataFrame([(" hp:1\t",), ("",), ("  ",), (None,)], "x string")
    assert [r[0] for r in df.select(clean_id(F.col("x"))).collect()] == ["HP:1", None, None, None]
    v = spark.createDataFrame([("a", T(2020, 1, 1), 1), ("a", T(2021, 1, 1), 2), ("b", None, 3), (None, None, 4)], "id string, t timestamp, v int")
    assert rows(newest(v, "id", "t", "v").select("id", "v")) == [("a", 2), ("b", 3)]


def test_quote_and_snippet(spark):
    df = spark.createDataFrame([("a  quick brown 🙂 fox", " quick   brown "), ("abc", "zz"), ("abc", "")], "t string, q string")
    assert [r[0] for r in df.select(tx.locate(F.col("t"), F.col("q"))).collect()] == [3, None, None]
    assert df.select(tx.snippet(F.col("t"), F.lit(3), F.lit(8), 2)).first()[0] == "  quick b"


def test_tiers(spark):
    df = spark.createDataFrame([(True, True, "CC BY"), (True, False, "CC0"), (True, True, None), (None, True, "CC0")], "a boolean, o boolean, l string")
    assert [r[0] for r in df.select(tx.access_tier(F.col("a"), F.col("o"), F.col("l"))).collect()] == ["full_text_quotable", "abstract_only", "full_text_facts_only", "abstract_only"]


CASE = "id string, source struct<pmid:string,pmcid:string,doi:string,title:string,license:string>, subject struct<id:string,sex:string,age_at_last_encounter:struct<iso8601duration:string>,vital_status:string>, schema_version string, confidence double, qa_flags array<string>, "


@pytest.fixture(scope="module")
def cases(spark):
    from caseweave.schema import DIAGNOSIS, PHENOTYPE, VARIANT

    ev = [("PMID:1", "body", 0, 5, None, "t")]
    ph = lambda i, ex=False, on=None, e=ev: ((i, "label " + i) if i else None, ex, (on, None), None, e)
    return spark.createDataFrame(
        [
            ("c", ("1", None, None, "t", "CC BY"), ("II-2", "FEMALE", ("P5Y",), "ALIVE"), "1.0.0", None, None, [ph("T:4"), ph("T:4"), ph("T:3", True), ph("T:1", None, "P20Y"), ph("T:5"), ph("T:404", e=[]), ph(None)],
             [(("M:1", "d"), "SOLVED", True, ev), (("M:9", "d"), None, None, None)], [(("G:1", "AAA"), "c.1A>T", None, None, None, ev)]),
            ("d", ("1", None, None, None, None), None, "1.0.0", 0.5, ["x"], None, None, []),
        ],
        CASE + f"phenotypes array<{PHENOTYPE}>, diagnoses array<{DIAGNOSIS}>, variants array<{VARIANT}>",
    )


def test_record_views(cases):
    assert rows(records.observed_terms(cases)) == [("c", ["T:1", "T:4", "T:404", "T:5"]), ("d", [])]
    assert rows(records.excluded_terms(cases)) == [("c", ["T:3"]), ("d", [])]
    assert records.unprovenanced(cases).first()["paths"] == ["phenotypes[5]=T:404", "diagnoses[1]=M:9"]
    kept = records.enforce_provenance(cases).first()
    assert kept["n_dropped"] == 2 and len(kept["phenotypes"]) == 6
    assert rows(records.track(cases)) == [("1", 2, "paper")]
    assert records.union_by_paper(cases).filter("kind = 'variant'").count() == 1


def test_phenopackets(cases):
    back = {r["id"]: r for r in records.from_phenopacket(records.to_phenopacket(cases)).collect()}
    assert back["c"]["observed"] == ["T:4", "T:1", "T:5", "T:404"] and back["c"]["excluded"] == ["T:3"] and back["c"]["genes"] == ["G:1"] and back["c"]["diseases"] == ["M:1", "M:9"] and back["c"]["pmid"] == "1"


def test_rules(spark, cases, base):
    _, alias, closed = base
    seen, out = (qa.live(records.exploded_terms(f(cases)), "term", alias) for f in (records.observed_terms, records.excluded_terms))
    raw = records.assertions(cases).filter("kind = 'phenotype' AND about IS NOT NULL").select("id", F.col("about").alias("term"))
    dx = records.assertions(cases).filter("kind = 'diagnosis'").select("id", F.col("about").alias("disease"))
    gx = records.assertions(cases).filter("kind = 'variant'").select("id", F.col("about").alias("gene"))
    pair = lambda a, b, n: spark.createDataFrame([(a, b)], f"disease string, {n} string")
    found = [
        qa.polarity_contradiction(seen, out), qa.ancestor_contradiction(seen, out, closed), qa.term_status(raw, alias), qa.onset_after_encounter(cases), qa.unmappable(dx, alias),
        qa.obligate_excluded(dx, out, pair("M:1", "T:3", "term")), qa.sex_conflict(cases, dx, pair("M:1", "Y:1", "term"), "Y:1"), qa.gene_mismatch(gx, dx, pair("M:1", "G:2", "gene")),
    ]
    v = found[0]
    for x in found[1:]:
        v = v.unionByName(x)
    codes = sorted(r["code"] for r in v.collect())
    assert codes == sorted(["polarity_contradiction", "dag_polarity_contradiction", "unknown_hpo_term", "outdated_hpo_term", "onset_after_last_encounter", "unmappable_disease", "obligate_phenotype_excluded", "sex_inheritance_conflict", "gene_disease_mismatch"])
    flagged = {r["id"]: r for r in qa.annotate(cases, v).collect()}
    assert flagged["c"]["confidence"] == round(0.5**4 * 0.9**5, 4) and flagged["d"]["confidence"] == 0.5 and flagged["d"]["qa_flags"] == ["x"]


def test_votes(spark):
    v = spark.createDataFrame([("c", k, w) for w, ks in (("1", "AB"), ("2", "AB"), ("3", "A")) for k in ks], "case string, key string, voter string")
    n = spark.createDataFrame([("c", 3)], "case string, n_voters int")
    assert rows(qa.merge_votes(v, n)) == [("c", "A", 1.0, False), ("c", "B", 0.6667, True)]


def test_retractions(spark):
    notes = spark.createDataFrame([("1", None, "+fraud;", "a"), ("1", None, "error;", "b"), ("0", "10.1/AB", "x", "a")], "pmid string, doi string, reason string, at string")
    papers = spark.createDataFrame([("p", "1", None), ("q", "2", None), ("r", None, "10.1/ab"), ("s", "9", None)], "id string, pmid string, doi string")
    got = {r["id"]: r["notice"] for r in qa.check_retractions(papers, qa.retraction_keys(notes), spark.createDataFrame([("2",)], "pmid string")).collect()}
    assert got == {"p": "error", "q": "flagged by the archive", "r": "x", "s": None}


def test_spans(spark, base):
    ev = spark.createDataFrame([("1", 1, "T:3", False, 0, 13), ("2", 1, "T:3", True, 0, 13), ("3", 1, "T:2", False, 900, 901), ("4", 1, "T:3", False, None, None), ("5", 1, "M:1", False, 0, 13), ("6", 1, "T:3", False, 13, 14)], "key string, doc_id int, term string, excluded boolean, start_char int, end_char int")
    text = spark.createDataFrame([(1, "Focal seizure was seen")], "doc_id int, text string")
    ground = spark.createDataFrame([(k, "T:4") for k in "1256"], "key string, found string")
    v = qa.span_verdicts(ev, text, ground, base[2])
    assert {r["key"]: r["verdict"] for r in v.collect()} == {"1": "supported", "2": "polarity_mismatch", "3": "offset_out_of_range", "4": "no_evidence", "5": "term_not_in_span", "6": "empty_span"}
    assert {r["verdict"]: r["rate"] for r in qa.support_rates(v).collect()}["supported"] == 0.1667


def test_search(cases, base):
    posts = search.postings(cases)
    want = search.with_descendants(cases.sparkSession.createDataFrame([("T:3",)], "value string"), base[2])
    assert rows(search.facets(posts, {"phenotype": want})) == [("c",)]
    assert search.suggestions(posts, "LABEL t", limit=2).count() == 2 and search.suggestions(posts, "l").count() == 0
    assert {r["kind"]: r["n_values"] for r in search.statistics(posts).collect()} == {"phenotype": 4, "diagnosis": 2, "variant": 1}
    assert [r["id"] for r in search.listing(posts.select("id").distinct(), cases, license="CC BY").collect()] == ["c"]
