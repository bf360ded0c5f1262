import json

import pytest

from caseweave import session
from caseweave.operators import dag, metrics, papers, qa, records, search
from caseweave.plans.corpus import kept_papers, reject_reasons
from caseweave.sources import files
from tests.conftest import rows


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("3", "d"), ("4", "e"), ("5", "f"), (None, "g"), ("10", "h")], "pmid string, id string")


@pytest.fixture(scope="module")
def available(spark):
    data = [("1", "PMC1", "full_text_quotable", "CC BY", True, None), ("2", "PMC2", "abstract_only", None, None, None), ("3", "PMC3", "full_text_facts_only", "NC", None, True), ("4", " ", "full_text_facts_only", "NC", False, False), ("10", "PMC9", "full_text_quotable", "CC0", True, None)]
    return spark.createDataFrame(data, "pmid string, pmcid string, tier string, license string, quotes_permitted boolean, retracted boolean")


def test_eval_set(spark, gold, available):
    got = papers.eval_set(gold, available, "x:").collect()
    assert [(r["pmid"], r["track"], r["n_cases"], r["quotes_permitted"]) for r in got] == [("1", "paper", 2, True), ("10", "single", 1, True), ("4", "single", 1, False)]  # by pmid as text
    assert [r["pmid"] for r in papers.eval_set(gold, available, "x:", retracted=True).collect()] == ["1", "10", "3", "4"]
    total = {(r["part"], r["value"]): (r["papers"], r["cases"]) for r in papers.eval_summary(papers.eval_set(gold, available, "x:")).collect()}
    assert total["total", "all"] == (3, 4) and total["track", "single"] == (2, 2) and total["tier", "full_text_quotable"] == (2, 3)
    assert sum(n for (part, _), (n, _) in total.items() if part == "single_split") == 2
    assert papers.source_doc(papers.eval_set(gold, available, "x:")).filter("pmid = '1'").first()["source"]["in_oa_subset"]
    assert papers.eval_set(gold.filter("false"), available, "x:").count() == 0


def test_skips_and_maps(spark, gold, available):
    bodies = spark.createDataFrame([("1",), ("1",)], "pmid string")
    assert dict(rows(papers.skips(gold, available, bodies))) == {"scored": 1, "tier": 1, "retracted": 1, "no_pmcid": 1, "not_available": 1, "no_body": 1}
    assert rows(papers.registry_map(available, gold.filter("pmid IN ('1', '4', '5')"))) == sorted([("1", "PMC1"), ("4", None), ("5", None)], key=repr)
    audit = {(r["tier"], r["license"]): (r["papers"], r["quotable"], r["permitted"]) for r in papers.licence_audit(available).collect()}
    assert audit["abstract_only", "none"] == (1, 0, 0) and audit["full_text_quotable", "CC BY"] == (1, 1, 1)
    xml = spark.createDataFrame([("A", '<r><record id="A" license="CC BY" retracted="no"><l/></record></r>'), ("B", '<error code="x"/>'), ("C", None), ("D", '<record retracted="yes"/>')], "pmcid string, xml string")
    assert rows(papers.archive_records(xml)) == sorted([("A", True, "CC BY", False), ("B", False, None, False), ("C", False, None, False), ("D", True, None, True)], key=repr)


def test_search_pages(spark):
    observed = spark.createDataFrame([("a", "t2"), ("a", "t2"), ("a", "t1"), ("b", "t1"), ("b", "t2")], "id string, term string")
    kept = papers.informative(observed)
    assert rows(kept) == [("a", "t1"), ("a", "t2")]  # counted before they are made distinct
    closed = spark.createDataFrame([("t2", "t2"), ("t2", "t0"), ("t1", "t1"), ("t1", "t0"), ("t0", "t0"), ("t9", "t9")], "term string, ancestor string")
    ic, names = spark.createDataFrame([("t0", 0.0), ("t1", 1.23456)], "term string, ic double"), spark.createDataFrame([("t1", "one")], "id string, name string")
    got = {r["term"]: r for r in papers.search_vocabulary(kept, closed, ic, names).collect()}
    assert {t: (r["number"], r["label"], r["ic"], r["n_records"], r["ancestors"]) for t, r in got.items()} == {"t0": (0, "t0", 0.0, 0, [0]), "t1": (1, "one", 1.235, 1, [0, 1]), "t2": (2, "t2", None, 1, [0, 2])}
    rec = spark.createDataFrame([("a", [(("x",),), ((None,),), (("Y",),)]), ("b", None), ("c", [(("X",),)])], "id string, variants array<struct<gene:struct<label:string>>>")
    assert rows(papers.gene_postings(rec)) == [("X", ["a", "c"]), ("Y", ["a"])]
    posts = spark.createDataFrame([(str(i), "phenotype", f"v{i % 12}", "l") for i in range(30)], "id string, kind string, value string, label string")
    assert [r["value"] for r in search.most_common(posts, 2).orderBy("place").collect()] == ["v0", "v1"]


def test_diseases(spark):
    terms = spark.createDataFrame(
        [("MONDO:1", [("OMIM:1", "equivalentTo"), ("Orphanet:5", None)], None, None), ("MONDO:2", [("OMIM:1", None), ("OMIM:2", "x")], None, None), ("MONDO:3", [], True, "MONDO:1")],
        "term_id string, xrefs array<struct<xref:string,modifier:string>>, obsolete boolean, replaced_by string",
    ).selectExpr("*", "array('x') AS parents", "array() AS alt_ids")
    alias = dag.alias_closure(dag.term_rows(terms))
    asked = spark.createDataFrame([("OMIM:1",), (" omim:2",), ("orpha:5",), ("MONDO:3",), ("MONDO:77",), ("ICD:1",), (None,), ("",)], "disease string")
    got = dict(rows(dag.normalise_diseases(asked, terms, alias)))
    assert got == {"OMIM:1": "MONDO:1", " omim:2": "MONDO:2", "orpha:5": "MONDO:1", "MONDO:3": "MONDO:1", "MONDO:77": None, "ICD:1": None, None: None, "": None}


def test_merged_records(spark):
    ev = lambda n: [("s",)] * n
    kinds = "id string, number int, phenotypes array<struct<term:struct<id:string>,excluded:boolean,evidence:array<struct<source_id:string>>>>, diagnoses array<struct<disease:struct<id:string>>>, variants array<struct<gene:struct<id:string>>>"
    p = lambda t, n=1, out=None: ((t,), out, ev(n))
    data = [("c", 1, [p("A", 4), p("A", 4), p("B"), p("D", 1, True)], [(("X",),)], None), ("c", 2, [p("a ", 4), p("B")], [(("X",),)], [(("G",),)]), ("c", 3, [p("A", 0)], None, []), ("e", 1, None, None, None)]
    got = {r["id"]: r for r in qa.consensus_records(spark.createDataFrame(data, kinds)).collect()}
    c = got["c"]
    assert c["agreement"] == {"A": 1.0, "B": 0.6667, "D!": 0.3333, "dx:X": 0.6667, "gene:G": 0.3333} and c["n_records"] == 3
    assert c["review_queue"] == ["B", "D!", "dx:X", "gene:G"] and c["confidence"] == 0.6 and c["evidence"] == {"A": 5, "B": 2, "D!": 1}
    assert got["e"]["confidence"] == 0.0 and got["e"]["agreement"] is None


def test_verdicts(spark):
    texts = spark.createDataFrame([(1, "The FOG2 gene, c.5A>G. No seizure at all.")], "doc_id int, text string")
    kinds = "key string, doc_id int, gene_label string, hgvs_c string, start_char int, end_char int, has_evidence boolean"
    data = [("a", 1, "FOG2", "", 0, 13, True), ("b", 1, "X", "c.5A>G", 10, 22, True), ("c", 1, "X", "", 0, 10, True), ("d", 1, "X", "", 0, 999, True), ("e", 1, "X", "", None, None, False), ("f", None, "X", "", 0, 1, True)]
    assert dict(rows(qa.variant_verdicts(spark.createDataFrame(data, kinds), texts).select("key", "verdict"))) == {"a": "supported", "b": "supported", "c": "term_not_in_span", "d": "offset_out_of_range", "e": "no_evidence", "f": "offset_out_of_range"}
    at = texts.first()["text"].index("seizure")
    ev = spark.createDataFrame([("n", 1, "T", True, at, at + 7, False), ("m", 1, "T", False, at, at + 7, False), ("l", 1, "T", False, at, at + 7, True), ("s", 1, "T", False, at + 7, at + 8, False), ("o", 1, "U", True, at, at + 7, False), ("z", 1, "T", True, -1, 3, False)], "key string, doc_id int, term string, excluded boolean, start_char int, end_char int, derived boolean")
    found = spark.createDataFrame([(k, "T") for k in "nmlo"], "key string, found string")
    closed = spark.createDataFrame([("T", "T"), ("U", "U")], "term string, ancestor string")
    v = qa.span_verdicts(ev, texts, found, closed)
    assert dict(rows(v.select("key", "verdict"))) == {"n": "supported", "m": "polarity_mismatch", "l": "supported", "s": "empty_span", "o": "term_not_in_span", "z": "offset_out_of_range"}
    assert {r["verdict"]: r["rate"] for r in qa.support_rates(v).collect()}["supported"] == 0.3333


def test_packets_keep_what_records_hold(spark):
    from caseweave.schema import CASE_RECORD

    packet = {
        "id": "p", "subject": {"id": "II-2", "sex": "FEMALE", "timeAtLastEncounter": {"age": {"iso8601duration": "P7Y"}}},
        "phenotypicFeatures": [{"type": {"id": "H:1", "label": "one"}, "onset": {"iso8601duration": "P32W"}}, {"type": {"id": "H:2"}, "excluded": True}, {"type": {}}],
        "interpretations": [{"progressStatus": "SOLVED", "diagnosis": {"disease": {"id": "OMIM:1"}, "genomicInterpretations": [{"variantInterpretation": {"geneContext": {"valueId": "G:1", "symbol": "S"}, "hgvsC": "c.1A>T"}}]}}],
        "diseases": [{"term": {"id": "OMIM:9"}}], "metaData": {"externalReferences": [{"id": "doi:1"}, {"id": "pmid:77", "description": "t"}]},
    }
    r = records.packet_records(spark.createDataFrame([(json.dumps(packet),), ("{}",)], "packet string")).collect()
    one = next(x for x in r if x["id"] == "p")
    assert one["source"]["pmid"] == "77" and one["subject"]["age_at_last_encounter"]["iso8601duration"] == "P7Y"
    assert [(p["term"]["id"], p["excluded"], p["onset"]["gestational_weeks"], p["evidence"][0]["source_id"]) for p in one["phenotypes"]] == [("H:1", False, 32, "PMID:77"), ("H:2", True, None, "PMID:77")]
    assert [(d["disease"]["id"], d["status"]) for d in one["diagnoses"]] == [("OMIM:1", "SOLVED")] and one["variants"][0]["hgvs_c"] == "c.1A>T"
    assert len(r) == 2 and CASE_RECORD


def test_genes_releases_and_corpus(spark, tmp_path):
    genes = spark.createDataFrame([("G:1", "ZFPM2", ["FOG2"], ["OLD"]), ("G:2", "FOG2X", [], [])], "gene string, symbol string, aliases array<string>, previous array<string>")
    spelt = {r["symbol"]: (r["gene"], r["approved"], r["names"]) for r in files.gene_spellings(genes).collect()}
    assert spelt["FOG2"] == ("G:1", "ZFPM2", ["ZFPM2", "FOG2", "OLD"]) and set(spelt) == {"ZFPM2", "FOG2", "OLD", "FOG2X"}
    by_gene, by_disease = files.gene_disease_sets(spark.createDataFrame([("g", "d"), ("g", "e"), ("h", "d")], "gene string, disease string"))
    assert rows(by_gene) == [("g", ["d", "e"]), ("h", ["d"])] and rows(by_disease) == [("d", ["g", "h"]), ("e", ["g"])]
    (tmp_path / "a.json").write_text('{"id": "1", "confidence": 0.1}\n{"id": "2"}\n')
    (tmp_path / "b.json").write_text('{"id": "1", "confidence": 0.9, "qa_flags": ["ERROR:x"], "source": {"pmcid": "P", "in_oa_subset": true, "license": "CC BY"}}\n')
    both = files.read_cases(spark, release=f"{tmp_path}/a.json", corpus=f"{tmp_path}/b.json")
    assert both.count() == 3
    cases = files.index_cases(both, "release", "corpus")
    assert rows(cases.select("id", "confidence", "origin")) == sorted([("1", 0.9, "corpus"), ("2", None, "release")], key=repr)
    m = json.loads(files.manifest(cases, "1", "today").first()[0])
    assert m["flags"] == {"ERROR:x": 1} and m["tiers"] == {"abstract_only": 1, "full_text_quotable": 1}
    assert "full_text_quotable: 1" in files.datasheet(json.dumps(m))
    p = spark.createDataFrame([(i, None, "CC BY", "text", None, 1, "error" if i == 0 else None, "error" if i == 1 else "ok") for i in range(5)], "paper_id int, pmid string, license string, abstract string, title string, n_gold_cases int, licence_status string, fetch_status string")
    r = reject_reasons(p, spark.createDataFrame([], "number string"))
    assert dict(rows(r.select("paper_id", "reason")))[0] == "licence_error" and dict(rows(r.select("paper_id", "reason")))[1] == "fetch_error"
    assert [x["paper_id"] for x in kept_papers(r, 2).collect()] == [2, 3]


def test_checksums_of_empty_files(spark, tmp_path):
    import hashlib

    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "a").write_bytes(b"x")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    assert [tuple(r) for r in files.checksums(spark, str(tmp_path)).collect()] == [(n, hashlib.sha256(c).hexdigest()) for n, c in (("a", b"x"), ("b", b""))]


def test_best_of_and_audit(spark):
    s = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5), ("q", "c", 0.1), ("q", "d", 0.9)], "g string, id string, f1 double")
    assert rows(metrics.best_of(s, "g", "id").select("g", "id")) == [("p", "a"), ("q", "d")]
    v = spark.createDataFrame([("a", "c", "ERROR")], "id string, code string, severity string")
    got = qa.audit(v, spark.createDataFrame([("k", "supported")], "key string, verdict string"), spark.createDataFrame([("a", None)], "id string, agrees boolean"), spark.createDataFrame([("a", "x"), ("b", None)], "id string, notice string"))
    assert {(r["part"], r["value"]): r["n"] for r in got.collect()} == {("violation", "ERROR:c"): 1, ("span", "supported"): 1, ("stated", "none stated"): 1, ("retraction", "noticed"): 1, ("retraction", "clear"): 1}


def test_shared_folder(spark):
    from types import SimpleNamespace as N

    unset = N(get=lambda *_: None)
    undefined = N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))
    cluster = N(conf=unset, sparkContext=N(master="spark://there:7077", getConf=lambda: unset, _jsc=undefined))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)
    df = session.cut(spark.range(3))
    assert df.count() == 3 and f"caseweave-{spark.sparkContext.applicationId}" in df._caseweave_path
    assert session.there(df)
    session.release(df)
    assert not session.there(df)
