"""Record schemas, and the checks a closed record must pass, as column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0.0"
SECTIONS = ("title", "abstract", "body", "table", "figure_caption", "supplement", "unknown")
CLASS = "struct<id:string,label:string>"
EVIDENCE = "array<struct<source_id:string,section:string,start_char:int,end_char:int,quote:string,extractor:string>>"
SOURCE = "struct<pmid:string,pmcid:string,doi:string,title:string,journal:string,pub_year:int,license:string,in_oa_subset:boolean,quotes_permitted:boolean,retracted:boolean>"
SUBJECT = "struct<id:string,sex:string,age_at_last_encounter:struct<iso8601duration:string>,vital_status:string>"
PHENOTYPE = f"struct<term:{CLASS},excluded:boolean,onset:struct<iso8601duration:string,gestational_weeks:int>,negation_cue:string,evidence:{EVIDENCE}>"
DIAGNOSIS = f"struct<disease:{CLASS},status:string,stated_in_abstract:boolean,evidence:{EVIDENCE}>"
VARIANT = f"struct<gene:{CLASS},hgvs_c:string,hgvs_p:string,allelic_state:{CLASS},acmg:string,evidence:{EVIDENCE}>"
CASE_RECORD = (
    f"id string, schema_version string, source {SOURCE}, subject {SUBJECT}, phenotypes array<{PHENOTYPE}>, diagnoses array<{DIAGNOSIS}>, "
    f"variants array<{VARIANT}>, confidence double, qa_flags array<string>, extractors array<string>"
)
DOCUMENT = (
    "doc_id string, pmid string, pmcid string, doi string, journal string, pub_year int, title string, text string, has_body boolean, "
    "spans array<struct<section:string,start:int,end:int,heading:string>>, status string"
)


def valid_curie(c: Column) -> Column:
    return F.coalesce(F.trim(c).contains(":"), F.lit(False))


def problems(records: DataFrame) -> DataFrame:
    """(id, problem): breaches of the record's closed schema."""
    every = lambda name, ok: F.forall(F.coalesce(F.col(name), F.array().cast(records.schema[name].dataType)), ok)
    span_ok = lambda e: F.coalesce((e["end_char"] >= e["start_char"]) & (e["start_char"] >= 0), F.lit(True)) & F.coalesce(e["section"].isin(*SECTIONS), F.lit(True))
    evidence_ok = lambda x: F.coalesce(F.forall(x["evidence"], span_ok), F.lit(True))
    rules = {
        "missing id": F.col("id").isNotNull(),
        "finding without a curie": every("phenotypes", lambda p: valid_curie(p["term"]["id"])),
        "diagnosis without a curie": every("diagnoses", lambda d: valid_curie(d["disease"]["id"])),
        "confidence out of range": F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(True)),
        "bad evidence": every("phenotypes", evidence_ok) & every("diagnoses", evidence_ok) & every("variants", evidence_ok),
        "gestational weeks out of range": every("phenotypes", lambda p: F.coalesce(p["onset"]["gestational_weeks"].between(0, 50), F.lit(True))),
    }
    found = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return records.select("id", F.explode(found).alias("problem"))
