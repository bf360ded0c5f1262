import json

from caseweave.functions.text import is_patient_heading
from caseweave.operators import records
from caseweave.schema import CASE_RECORD, problems
from caseweave.sources import files, jats, obo
from tests.conftest import rows

OBO = """format-version: 1.2

[Term]
id: X:1 ! root
name: root
def: "A \\"thing\\"." [src]

[Term]
id: X:2
name: child
alt_id: X:92
is_a: X:1 {source="s"} ! root
synonym: "kid" EXACT []
synonym: "small one" []
xref: OMIM:1 {source="X:equivalentTo"}

[Typedef]
id: part_of

[Term]
id: Y:1
name: foreign

[Term]
id: X:3
name: old
is_obsolete: true
replaced_by: X:2
"""


def test_obo(spark, tmp_path):
    (tmp_path / "a.obo").write_text(OBO)
    got = {r["term_id"]: r for r in obo.read_obo(spark, str(tmp_path / "a.obo"), "X:").collect()}
    assert set(got) == {"X:1", "X:2", "X:3"}
    two = got["X:2"]
    assert two["parents"] == ["X:1"] and two["alt_ids"] == ["X:92"] and two["xrefs"][0]["xref"] == "OMIM:1" and "equivalentTo" in two["xrefs"][0]["modifier"]
    assert [(s["syn"], s["scope_kind"]) for s in two["synonyms"]] == [("kid", "EXACT"), ("small one", "RELATED")]
    assert got["X:3"]["obsolete"] and got["X:3"]["replaced_by"] == "X:2"


def test_genes(spark, tmp_path):
    (tmp_path / "g.tsv").write_text('hgnc_id\tsymbol\tname\tstatus\tlocus_group\talias_symbol\tprev_symbol\tentrez_id\nG:1\tZFPM2\tz\tApproved\tp\t"FOG2|X1"\t\t5\nG:2\tX1\ty\tApproved\tp\t\tOLD\t6\n\tbad\t\t\t\t\t\t\n')
    (tmp_path / "d.tsv").write_text("ncbi_gene_id\tgene_symbol\tdisease_id\nNCBIGene:5\tq\tO:1\nNCBIGene:0\tOLD\tO:2\nNCBIGene:0\tnone\tO:3\n")
    genes = files.read_genes(spark, str(tmp_path / "g.tsv"))
    assert dict(rows(files.gene_symbols(genes))) == {"ZFPM2": "G:1", "FOG2": "G:1", "X1": "G:2", "OLD": "G:2"}
    assert rows(files.read_gene_diseases(spark, str(tmp_path / "d.tsv"), genes)) == [("G:1", "O:1"), ("G:2", "O:2")]
    assert files.read_gene_diseases(spark, str(tmp_path / "none.tsv"), genes).count() == 0


def test_annotations_and_retractions(spark, tmp_path):
    (tmp_path / "p.hpoa").write_text("#c\ndatabase_id\tqualifier\thpo_id\tfrequency\tsex\tonset\taspect\nO:1\tNOT\tX:1\t\t\t\tP\nO:2\t\t\t\t\t\tP\n")
    assert [(r["disease_id"], r["qualifier"]) for r in files.read_annotations(spark, str(tmp_path / "p.hpoa")).collect()] == [("O:1", "NOT")]
    (tmp_path / "r.csv").write_text('OriginalPaperPubMedID,OriginalPaperDOI,Reason,RetractionDate\n1,10.1/X,"+a;\nb",2020\n')
    assert [tuple(r) for r in files.read_retractions(spark, str(tmp_path / "r.csv")).collect()] == [("1", "10.1/X", "+a;\nb", "2020")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "v1").mkdir(), (tmp_path / "v2").mkdir()
    assert files.latest_version(spark, str(tmp_path)).endswith("v2")
    (tmp_path / "v2/a.json").write_text(json.dumps({"id": "p", "phenotypicFeatures": [{"type": {"id": "x:1"}}, {}], "metaData": {"externalReferences": [{"id": "pmid:7"}]}, "diseases": [{"term": {"id": "M:1"}}]}))
    (tmp_path / "v2/b.json").write_text("{broken")
    got = records.from_phenopacket(files.read_phenopackets(spark, str(tmp_path / "v2"))).collect()
    assert len(got) == 1 and got[0]["observed"] == ["X:1"] and got[0]["pmid"] == "7" and got[0]["diseases"] == ["M:1"]
    (tmp_path / "av.json").write_text(json.dumps({"summary": {}, "per_paper": {"1": {"pmcid": "P", "in_pmc": True, "license": "CC0"}}}))
    assert files.read_availability(spark, str(tmp_path / "av.json")).first()["license"] == "CC0"
    (tmp_path / "ex.json").write_text(json.dumps({"content": [{"type": "tool_use", "input": {"individuals": [{"label": "a"}]}}]}))
    assert "label" in files.read_extractions(spark, str(tmp_path / "ex.json")).first()["individuals"]


def test_release_roundtrip(spark, tmp_path):
    one = {"id": "c", "source": {"pmid": "1"}, "phenotypes": [{"term": {"id": "X:1"}, "excluded": False, "evidence": [{"source_id": "PMID:1", "section": "body", "start_char": 5, "end_char": 1}]}], "confidence": 2.0}
    cases = spark.createDataFrame([(json.dumps(one),)], "v string").selectExpr(f"from_json(v, '{CASE_RECORD}') AS r").select("r.*")
    files.write_release(cases, str(tmp_path))
    back = files.read_cases(spark, release=f"{tmp_path}/cases", corpus=f"{tmp_path}/cases")
    assert sorted(r["origin"] for r in back.collect()) == ["corpus", "release"]
    assert json.loads(files.manifest(cases, "1", "2026-01-01").first()["value"])["n_phenotypes"] == 1
    sums = files.checksums(spark, f"{tmp_path}/cases").collect()
    part = next(p for p in (tmp_path / "cases").iterdir() if p.name.startswith("part"))
    assert files.file_sha256(str(part)) in {r["sha256"] for r in sums}
    assert {r["problem"] for r in problems(cases).collect()} == {"confidence out of range", "bad evidence"}


XML = """<?xml version="1.0"?><!DOCTYPE article><article><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta>
<article-id pub-id-type="pmid">7</article-id><title-group><article-title>A <italic>rare</italic> case<xref>1</xref> here</article-title></title-group>
<pub-date><year>2020</year></pub-date><abstract><p>Short—text.</p></abstract></article-meta></front>
<body><p>Lead.</p><sec><title>Methods</title><p>One\n two.</p><sec><title>Sub</title><p>Deep.</p></sec></sec>
<sec><title>Case</title><table-wrap><caption><p>Cap</p></caption><table><tr><th>a</th><th>b</th></tr><tr><td></td><td></td></tr><tr><td>1</td><td>2</td></tr></table></table-wrap></sec></body></article>"""


def test_jats(spark):
    docs = {r["doc_id"]: r for r in jats.documents(spark.createDataFrame([("a", XML), ("b", "<article><x"), ("c", None), ("d", "<other/>")], "doc_id string, xml string")).collect()}
    a = docs["a"]
    assert a["title"] == "A rare case here" and a["pmid"] == "7" and a["pub_year"] == 2020 and a["has_body"]
    pieces = [(s["section"], a["text"][s["start"] : s["end"]], s["heading"]) for s in a["spans"]]
    assert pieces == [("title", "A rare case here", None), ("abstract", "Short-text.", None), ("body", "Lead.", None), ("body", "One two.", "Methods"), ("body", "Deep.", "Sub"), ("table", "Cap\na | b\n1 | 2", None)]
    assert docs["b"]["status"] == docs["c"]["status"] == "malformed" and docs["d"]["status"] == "no article"
    flat = spark.createDataFrame([("body", "Methods"), ("body", "Case"), ("title", "Methods"), ("body", None)], "section string, heading string")
    assert [r[0] for r in flat.select(is_patient_heading(flat.section, flat.heading)).collect()] == [False, True, True, True]


def test_stream(spark, tmp_path):
    from caseweave.streaming.mentions import stream_mentions

    spark.createDataFrame([(1, "A seizure was seen.")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    words = spark.createDataFrame([("seizure", "T:1")], "phrase string, term string")
    q = stream_mentions(spark, str(tmp_path / "in"), "doc_id int, text string", words, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["term"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["T:1"]
