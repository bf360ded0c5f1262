"""Views of nested case records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.ids import clean_id, newest, newest_values


def current_records(records: DataFrame, *columns: str) -> DataFrame:
    """The current delivery of every record id: the one ingested last."""
    return newest(records, "id", "ingested_at", *columns)


def observed_ids(distinct: bool = True) -> Column:
    """Cleaned ids of the findings that are not marked excluded, as an expression over ``phenotypes``."""
    seen = F.filter("phenotypes", lambda p: ~F.coalesce(p["excluded"], F.lit(False)))
    ids = F.filter(F.transform(seen, lambda p: clean_id(p["term"]["id"])), lambda t: t.isNotNull())
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(ids)) if distinct else ids


def observed_terms(records: DataFrame, distinct: bool = True) -> DataFrame:
    """(id, terms): ids of the findings of each record that are not marked excluded, cleaned.

    A null list gives an empty one, null entries and null or blank ids are skipped, a null mark means observed.
    """
    return records.select("id", observed_ids(distinct).alias("terms"))


def current_observed(records: DataFrame, distinct: bool = True) -> DataFrame:
    """``observed_terms`` of the current delivery of every record; only the ids are shuffled."""
    return newest_values(records, "id", "ingested_at", ["phenotypes"], {"terms": observed_ids(distinct)}).select("id", "terms")


def excluded_terms(records: DataFrame) -> DataFrame:
    """(id, terms): cleaned distinct ids of the findings marked excluded."""
    out = F.filter("phenotypes", lambda p: F.coalesce(p["excluded"], F.lit(False)))
    ids = F.filter(F.transform(out, lambda p: clean_id(p["term"]["id"])), lambda t: t.isNotNull())
    return records.select("id", F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))).alias("terms"))


def diagnosis_ids(records: DataFrame) -> DataFrame:
    ids = F.filter(F.transform("diagnoses", lambda d: clean_id(d["disease"]["id"])), lambda t: t.isNotNull())
    return records.select("id", F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))).alias("diseases"))


def gene_ids(records: DataFrame) -> DataFrame:
    ids = F.filter(F.transform("variants", lambda v: clean_id(v["gene"]["id"])), lambda t: t.isNotNull())
    return records.select("id", F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))).alias("genes"))


def exploded_terms(sets: DataFrame, column: str = "terms", name: str = "term") -> DataFrame:
    return sets.select("id", F.explode(column).alias(name))


LISTS = (("phenotypes", "term"), ("diagnoses", "disease"), ("variants", "gene"))


def _bare(x):  # noqa: ANN001, ANN202
    return F.coalesce(F.size(x["evidence"]), F.lit(0)) <= 0


def unprovenanced(records: DataFrame) -> DataFrame:
    """(id, paths): assertions without evidence as list[position]=id."""
    def paths(name: str, about: str):  # noqa: ANN202
        path = lambda x, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]="), F.coalesce(x[about]["id"], F.lit("")))
        marked = F.transform(name, lambda x, i: F.when(_bare(x), path(x, i)))
        return F.coalesce(F.filter(marked, lambda x: x.isNotNull()), F.array().cast("array<string>"))

    parts = [paths(name, about) for name, about in LISTS]
    return records.select("id", F.concat(*parts).alias("paths"))


def enforce_provenance(records: DataFrame) -> DataFrame:
    """Records without the assertions that have no evidence; ``n_dropped`` counts those."""
    n = sum((F.coalesce(F.size(F.filter(name, _bare)), F.lit(0)) for name, _ in LISTS[1:]), F.coalesce(F.size(F.filter(LISTS[0][0], _bare)), F.lit(0)))
    out = records.withColumn("n_dropped", n)
    for name, _ in LISTS:
        out = out.withColumn(name, F.filter(name, lambda x: ~_bare(x)))
    return out


def assertions(records: DataFrame) -> DataFrame:
    """(id, kind, pos, about, label, excluded, n_evidence): all assertions as rows."""
    rows = None
    for name, about in LISTS:
        e = records.select("id", F.posexplode(name).alias("pos", "x"))
        one = e.select(
            "id", F.lit(name[:-1] if name != "diagnoses" else "diagnosis").alias("kind"), "pos", clean_id(F.col(f"x.{about}.id")).alias("about"), F.col(f"x.{about}.label").alias("label"),
            (F.coalesce(F.col("x.excluded"), F.lit(False)) if name == "phenotypes" else F.lit(False)).alias("excluded"), F.coalesce(F.size("x.evidence"), F.lit(0)).alias("n_evidence"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def union_by_paper(records: DataFrame) -> DataFrame:
    """(pmid, kind, about, excluded, first_id): findings, diagnoses and genes of all records of a paper, the first record's wins."""
    rows = assertions(records).join(records.select("id", F.col("source.pmid").alias("pmid")), "id").filter(F.col("pmid").isNotNull() & F.col("about").isNotNull())
    return rows.groupBy("pmid", "kind", "about", "excluded").agg(F.min("id").alias("first_id"))


def union_gold(records: DataFrame) -> DataFrame:
    """(pmid, kind, about, excluded, hgvs_c, first_id): what all records of a paper say together; variants by gene and coding change.

    Of several records that say the same the first by id is named.
    """
    def entries(name: str, about: str, kind: str) -> Column:
        return F.transform(name, lambda x: F.struct(
            F.lit(kind).alias("kind"), clean_id(x[about]["id"]).alias("about"), (F.coalesce(x["excluded"], F.lit(False)) if kind == "phenotype" else F.lit(False)).alias("excluded"),
            (x["hgvs_c"] if kind == "variant" else F.lit(None).cast("string")).alias("hgvs_c"),
        ))

    lists = [entries(name, about, kind) for (name, about), kind in zip(LISTS, ("phenotype", "diagnosis", "variant"))]
    said = F.concat(*[F.coalesce(x, F.array().cast("array<struct<kind:string,about:string,excluded:boolean,hgvs_c:string>>")) for x in lists])
    rows = records.filter("source.pmid IS NOT NULL").select(F.col("source.pmid").alias("pmid"), "id", F.explode(said).alias("s")).select("pmid", "id", "s.*")
    return rows.filter("about IS NOT NULL OR hgvs_c IS NOT NULL").groupBy("pmid", "kind", "about", "excluded", "hgvs_c").agg(F.min("id").alias("first_id"))


def track(records: DataFrame) -> DataFrame:
    """(pmid, n_records, track): single where a paper has exactly one record, else paper."""
    per = records.select(F.col("source.pmid").alias("pmid"), "id").filter(F.col("pmid").isNotNull()).groupBy("pmid").agg(F.count(F.lit(1)).alias("n_records"))
    return per.withColumn("track", F.when(F.col("n_records") == 1, "single").otherwise("paper"))


def summary(records: DataFrame, first: int = 8) -> DataFrame:
    """(id, first_terms, n_observed, n_excluded, n_diagnoses, n_variants, source)."""
    from caseweave.functions.text import curie

    seen = observed_terms(records).select("id", F.slice("terms", 1, first).alias("first_terms"), F.size("terms").alias("n_observed"))
    out = excluded_terms(records).select("id", F.size("terms").alias("n_excluded"))
    base = records.select(
        "id", F.coalesce(F.size("diagnoses"), F.lit(0)).alias("n_diagnoses"), F.coalesce(F.size("variants"), F.lit(0)).alias("n_variants"),
        curie(F.col("source.pmid"), F.col("source.pmcid"), F.col("source.doi")).alias("source"),
    )
    return base.join(seen, "id").join(out, "id")


def to_phenopacket(records: DataFrame) -> DataFrame:
    """(id, packet): records as phenopacket JSON. Variants hang under every diagnosis; without one they stay in a list of their own."""
    term = lambda t: F.struct(t["id"].alias("id"), t["label"].alias("label"))
    features = F.transform("phenotypes", lambda p: F.struct(term(p["term"]).alias("type"), F.coalesce(p["excluded"], F.lit(False)).alias("excluded"), F.struct(p["onset"]["iso8601duration"].alias("iso8601duration")).alias("onset")))
    genomic = F.transform("variants", lambda v: F.struct(F.struct(F.struct(v["gene"]["id"].alias("valueId"), v["gene"]["label"].alias("symbol")).alias("geneContext"), v["hgvs_c"].alias("hgvsC"), v["hgvs_p"].alias("hgvsP")).alias("variantInterpretation")))
    with_genes = F.col("variants")  # alias for readability in the lambda below
    interpretations = F.transform("diagnoses", lambda d: F.struct(d["status"].alias("progressStatus"), F.struct(term(d["disease"]).alias("disease"), F.when(with_genes.isNotNull(), genomic).alias("genomicInterpretations")).alias("diagnosis")))
    loose = F.when(F.coalesce(F.size("diagnoses"), F.lit(0)) <= 0, genomic)
    subject = F.struct(F.col("subject.id").alias("id"), F.col("subject.sex").alias("sex"), F.struct(F.col("subject.age_at_last_encounter").alias("age")).alias("timeAtLastEncounter"), F.struct(F.col("subject.vital_status").alias("status")).alias("vitalStatus"))
    reference = F.array(F.struct(F.concat(F.lit("PMID:"), F.col("source.pmid")).alias("id"), F.col("source.title").alias("description")))
    packet = F.struct(F.col("id"), subject.alias("subject"), features.alias("phenotypicFeatures"), interpretations.alias("interpretations"), loose.alias("unassignedVariants"), F.struct(F.col("schema_version").alias("schemaVersion"), reference.alias("externalReferences")).alias("metaData"))
    return records.select("id", F.to_json(packet).alias("packet"))


TERM = "struct<id:string,label:string>"
PACKET = (
    "id string, subject struct<id:string,sex:string,timeAtLastEncounter:struct<age:struct<iso8601duration:string>>,vitalStatus:struct<status:string>>, "
    f"phenotypicFeatures array<struct<type:{TERM},excluded:boolean,onset:struct<iso8601duration:string>>>, "
    f"interpretations array<struct<progressStatus:string,diagnosis:struct<disease:{TERM},genomicInterpretations:array<struct<variantInterpretation:struct<geneContext:struct<valueId:string,symbol:string>,hgvsC:string,hgvsP:string>>>>>>, "
    "unassignedVariants array<struct<variantInterpretation:struct<geneContext:struct<valueId:string,symbol:string>,hgvsC:string,hgvsP:string>>>, "
    f"diseases array<struct<term:{TERM}>>, metaData struct<schemaVersion:string,externalReferences:array<struct<id:string,description:string>>>"
)


def packet_records(packets: DataFrame, column: str = "packet", extractor: str = "curated") -> DataFrame:
    """Phenopacket JSON as case records (id, source, subject, phenotypes, diagnoses, variants, extractors).

    As in ``from_phenopacket``: the first PMID reference names the paper, features without an id are skipped, listed
    diseases count only where no interpretation names one, a packet without an id is named by its digest. Onsets of whole
    weeks are gestational. Every assertion gets the paper as its evidence, without a place in it.
    """
    p = packets.select(F.from_json(column, PACKET).alias("p"), F.col(column).alias("_raw")).filter(F.col("p").isNotNull())
    refs = F.filter("p.metaData.externalReferences", lambda r: F.upper(r["id"]).startswith("PMID:"))
    pmid = F.substring(F.get(refs, F.lit(0))["id"], 6, 20)
    p = p.select("p", "_raw", pmid.alias("pmid"), F.get(refs, F.lit(0))["description"].alias("title"))
    text = lambda v: F.lit(v).cast("string")
    place = F.struct(F.concat(F.lit("PMID:"), F.coalesce("pmid", F.lit("0"))).alias("source_id"), F.lit("unknown").alias("section"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"), text(None).alias("quote"), F.lit(extractor).alias("extractor"))
    evidence = F.array(place).alias("evidence")
    term = lambda t: F.struct(t["id"].alias("id"), t["label"].alias("label"))
    weeks = lambda d: F.regexp_extract(d, r"^P(\d+)W$", 1).try_cast("int")
    when = lambda d: F.struct(F.when(weeks(d).isNull(), d).alias("iso8601duration"), weeks(d).alias("gestational_weeks"))
    features = F.filter("p.phenotypicFeatures", lambda f: f["type"]["id"].isNotNull())
    phenotypes = F.transform(features, lambda f: F.struct(term(f["type"]).alias("term"), F.coalesce(f["excluded"], F.lit(False)).alias("excluded"), when(f["onset"]["iso8601duration"]).alias("onset"), text(None).alias("negation_cue"), evidence))
    disease = lambda d, status: F.struct(term(d).alias("disease"), status.alias("status"), F.lit(False).alias("stated_in_abstract"), evidence)
    named = F.transform(F.filter("p.interpretations", lambda i: i["diagnosis"]["disease"]["id"].isNotNull()), lambda i: disease(i["diagnosis"]["disease"], i["progressStatus"]))
    listed = F.transform(F.filter("p.diseases", lambda d: d["term"]["id"].isNotNull()), lambda d: disease(d["term"], text(None)))
    under = F.flatten(F.transform("p.interpretations", lambda i: F.coalesce(i["diagnosis"]["genomicInterpretations"], F.array())))
    genomic = F.array_distinct(F.concat(F.coalesce(under, F.array()), F.coalesce("p.unassignedVariants", F.array())))
    variant = lambda g: g["variantInterpretation"]
    variants = F.transform(genomic, lambda g: F.struct(F.struct(variant(g)["geneContext"]["valueId"].alias("id"), variant(g)["geneContext"]["symbol"].alias("label")).alias("gene"), variant(g)["hgvsC"].alias("hgvs_c"), variant(g)["hgvsP"].alias("hgvs_p"), evidence))
    return p.select(
        F.coalesce("p.id", F.substring(F.sha1(F.col("_raw")), 1, 12)).alias("id"), F.struct("pmid", "title").alias("source"),
        F.struct(F.col("p.subject.id").alias("id"), F.col("p.subject.sex").alias("sex"), F.col("p.subject.timeAtLastEncounter.age").alias("age_at_last_encounter"), F.col("p.subject.vitalStatus.status").alias("vital_status")).alias("subject"),
        phenotypes.alias("phenotypes"), F.when(F.size(named) > 0, named).otherwise(listed).alias("diagnoses"), variants.alias("variants"), F.array(F.lit(extractor)).alias("extractors"),
    )


def from_phenopacket(packets: DataFrame, column: str = "packet") -> DataFrame:
    """Flat views of phenopacket JSON: (id, pmid, sex, observed, excluded, diseases, genes).

    The paper is the first external reference that starts with PMID:, in any case; ``diseases`` count only where no
    interpretation names one; a packet without an id gets the first 12 digits of the SHA-1 of its JSON.
    """
    p = packets.select(F.from_json(column, PACKET).alias("p"), F.col(column).alias("_raw")).filter(F.col("p").isNotNull())
    feats = F.filter("p.phenotypicFeatures", lambda f: f["type"]["id"].isNotNull())
    pick = lambda flag: F.transform(F.filter(feats, lambda f: F.coalesce(f["excluded"], F.lit(False)) == flag), lambda f: clean_id(f["type"]["id"]))
    named = F.filter(F.transform("p.interpretations", lambda i: i["diagnosis"]["disease"]["id"]), lambda d: d.isNotNull())
    plain = F.filter(F.transform("p.diseases", lambda d: d["term"]["id"]), lambda d: d.isNotNull())
    genes = F.flatten(F.transform("p.interpretations", lambda i: F.transform(F.coalesce(i["diagnosis"]["genomicInterpretations"], F.array()), lambda g: g["variantInterpretation"]["geneContext"]["valueId"])))
    refs = F.filter("p.metaData.externalReferences", lambda r: F.upper(r["id"]).startswith("PMID:"))
    return p.select(
        F.coalesce("p.id", F.substring(F.sha1(F.col("_raw")), 1, 12)).alias("id"), F.substring(F.get(refs, F.lit(0))["id"], 6, 20).alias("pmid"), F.col("p.subject.sex").alias("sex"),
        F.array_distinct(pick(False)).alias("observed"), F.array_distinct(pick(True)).alias("excluded"),
        F.when(F.size(named) > 0, F.array_distinct(named)).otherwise(F.array_distinct(plain)).alias("diseases"), F.array_distinct(F.filter(genes, lambda g: g.isNotNull())).alias("genes"),
    )
