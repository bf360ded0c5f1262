from datetime import datetime
from itertools import combinations

from caseweave.plans import case_queries
from tests.conftest import rows

TERMS = "term_id string, term_name string, parents array<string>, alt_ids array<string>, obsolete boolean, replaced_by string"


def test_distance_of_all_siblings(spark, tmp_path):
    parents = {"T:0": [], "T:1": ["T:0"], "T:2": ["T:0"], "T:3": ["T:0"], "T:4": ["T:1", "T:2"], "T:5": ["T:1"], "T:7": ["T:2", "T:4"], "T:8": ["T:4", "T:9"]}
    spark.createDataFrame([(t, t, p, [], False, None) for t, p in parents.items()], TERMS).write.parquet(f"{tmp_path}/terms.parquet")

    def depths(term):
        found, front = {term: 0}, [term]
        for k in range(1, 7):
            front = [p for t in front for p in parents[t] if p in parents and p not in found]
            found |= {p: k for p in front}
        return found

    up = {t: depths(t) for t in parents}
    pairs = {(t, p) for t in parents for p in parents[t] if p in parents}
    pairs |= {(a, b) for a, b in combinations(sorted(parents), 2) if set(parents[a]) & set(parents[b]) & set(parents)}
    want = [(a, b, min(up[a][c] + up[b][c] for c in up[a].keys() & up[b].keys())) for a, b in pairs]
    assert rows(case_queries.dag_path_distance(spark, str(tmp_path)).select("a", "b", "distance")) == sorted(want, key=repr)


def test_quotes_of_all_evidence(spark, tmp_path):
    spark.createDataFrame([("T:0", "all", [], [], False, None)], TERMS).write.parquet(f"{tmp_path}/terms.parquet")
    ev = "evidence array<struct<quote:string>>"
    lists = f"phenotypes array<struct<{ev.replace(' ', ':', 1)}>>, diagnoses array<struct<{ev.replace(' ', ':', 1)}>>, variants array<struct<{ev.replace(' ', ':', 1)}>>"
    rest = ", ".join(f"{c} string" for c in ("schema_version", "subject", "confidence", "qa_flags", "extractors"))
    quoted = lambda *q: [([(x,) for x in q],)]
    found = quoted("had fits", "never said", "  ", None) + [(None,)]
    record = ("r", datetime(2024, 1, 1), ("1",), found, quoted("iris\n atrophy"), quoted("\nc.5A>G\n", "had fits"), *[None] * 5)
    bare = ("s", datetime(2024, 1, 1), ("1",), None, None, [], *[None] * 5)
    spark.createDataFrame([record, bare], f"id string, ingested_at timestamp, source struct<pmid:string>, {lists}, {rest}").write.parquet(f"{tmp_path}/case_records.parquet")
    text = "She had fits, iris atrophy and c.5A>G."
    spark.createDataFrame([(1, "1", text), (2, "2", text), (3, "1", None)], "doc_id long, pmid string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(1, "had fits", text.index("had fits")), (1, "iris\n atrophy", text.index("iris")), (1, "\nc.5A>G\n", text.index("c.5"))]
    assert rows(case_queries.quote_locate(spark, str(tmp_path))) == sorted(want, key=repr)


def test_scores_of_all_fields(spark, tmp_path):
    terms = [("T:0", [], None, None), ("T:1", ["T:0"], None, None), ("T:2", ["T:0"], None, None), ("M:1", [], None, None), ("M:9", [], True, "M:1")]
    spark.createDataFrame([(t, t, p, [], o, n) for t, p, o, n in terms], TERMS).write.parquet(f"{tmp_path}/terms.parquet")
    spark.createDataFrame([(1, "D:1", "T:1", None, None, None, None)], "ann_id long, disease_id string, hpo_id string, qualifier string, frequency string, sex string, aspect string").write.parquet(f"{tmp_path}/disease_annotations.parquet")
    ref = "struct<id:string>"
    kinds = f"phenotypes array<struct<term:{ref},excluded:boolean>>, diagnoses array<struct<disease:{ref}>>, variants array<struct<gene:{ref}>>"
    rest = ", ".join(f"{c} string" for c in ("schema_version", "subject", "confidence", "qa_flags", "extractors"))
    one = lambda i, year, seen, out, illness, gene: (i, datetime(year, 1, 1), ("1",), [((t,), False) for t in seen] + [((t,), True) for t in out], [((x,),) for x in illness], [((x,),) for x in gene], *[None] * 5)
    cases = [one("a", 2020, ["T:1"], ["T:2"], ["M:9"], ["G:1", "G:2"]), one("a", 2021, ["T:1"], ["T:2", "T:0"], ["M:1"], ["G:2"]), one("b", 2020, [], [], [], [])]
    spark.createDataFrame(cases, f"id string, ingested_at timestamp, source struct<pmid:string>, {kinds}, {rest}").write.parquet(f"{tmp_path}/case_records.parquet")
    got = {(r["id"], r["field"]): (r["tp"], r["fp"], r["fn"]) for r in case_queries.case_scores(spark, str(tmp_path)).collect()}
    want = {"observed_exact": (1, 0, 0), "observed_graded": (1, 0, 0), "excluded_exact": (1, 0, 1), "gene_exact": (1, 1, 0), "disease_exact": (0, 1, 1), "disease_normalised": (1, 0, 0)}
    assert got == {("a", f): x for f, x in want.items()} | {("b", f): (0, 0, 0) for f in want}
    cube = {r["field"]: r["n"] for r in case_queries.field_cube(spark, str(tmp_path)).filter("track = 'all' AND split = 'all'").collect()}
    assert cube == dict.fromkeys(want, 2)
    assert {r["field"] for r in case_queries.bootstrap_ci(spark, str(tmp_path)).collect()} == set(want)


def test_quotes_against_brute_force(spark, monkeypatch):
    import random

    from caseweave.operators import quotes

    rng = random.Random(12)
    words = ["ab", "cde", "é", "🙂x", "the gait", "was", "normal", "in", "boys"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [None, "", "z" * 500]
    docs = [(i, rng.choice(["1", "1", "2", None]), t) for i, t in enumerate(texts)]
    docs += docs[:3]
    asked = [(rng.choice(["1", "2"]), q) for t in texts if t for q in (t[5 : 5 + rng.randrange(1, 90)], " " + t[:40].replace(" ", "  ", 1) + "\n", "nowhere at all in any of the texts here")] + [("1", None), ("1", "  "), (None, "ab")]
    want = set()
    for key, q in asked:
        forms = [q.strip(), " ".join(q.split())] if q and q.strip() else []
        for i, k, t in docs:
            at = next((t.find(f) for f in forms if f in t), None) if t and k == key and key else None
            want |= {(i, q, at)} if at is not None else set()
    frames = spark.createDataFrame(docs, "doc_id int, key string, text string"), spark.createDataFrame(asked, "key string, quote string")
    for bound in (quotes.MAX_SENT, 0):
        monkeypatch.setattr(quotes, "MAX_SENT", bound)
        got = rows(quotes.locate_quotes(*frames))
        assert len(got) == len(set(got)) and set(got) == want
