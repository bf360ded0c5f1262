"""Readers of the other file formats, and writers."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions.text import access_tier
from caseweave.operators.dag import normalise_diseases
from caseweave.operators.records import PACKET, to_phenopacket
from caseweave.schema import CASE_RECORD, SCHEMA_VERSION


def require(path: str, remedy: str) -> str:
    """The path, or an error that says what to do."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(f"{path} is missing: {remedy}")
    return path


def pick(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that the file has."""
    have = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _listed(name: str) -> Column:
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), '"', ""), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, symbol, gene_name, status, locus_group, aliases, previous, entrez_id) of a gene table (TSV); rows need id and symbol."""
    t = spark.read.csv(path, sep="\t", header=True, quote="")
    return t.filter(F.col("hgnc_id").isNotNull() & F.col("symbol").isNotNull()).select(
        F.col("hgnc_id").alias("gene"), "symbol", F.col("name").alias("gene_name"), "status", "locus_group", _listed("alias_symbol").alias("aliases"), _listed("prev_symbol").alias("previous"), "entrez_id"
    )


def gene_symbols(genes: DataFrame) -> DataFrame:
    """(symbol, gene): approved symbols first, then aliases and former symbols; among those the least gene id."""
    own = genes.select(F.upper(F.trim("symbol")).alias("symbol"), "gene", F.lit(0).alias("_p"))
    other = genes.select(F.explode(F.concat("aliases", "previous")).alias("symbol"), "gene").select(F.upper(F.trim("symbol")).alias("symbol"), "gene", F.lit(1).alias("_p"))
    return own.unionByName(other).groupBy("symbol").agg(F.min_by("gene", F.struct("_p", "gene")).alias("gene"))


def gene_spellings(genes: DataFrame) -> DataFrame:
    """(symbol, gene, approved, names): every spelling in upper case with today's symbol of its gene and all names of that."""
    names = genes.select("gene", F.col("symbol").alias("approved"), F.array_distinct(F.concat(F.array("symbol"), "aliases", "previous")).alias("names"))
    return gene_symbols(genes).join(names, "gene").select("symbol", "gene", "approved", "names")


def gene_disease_sets(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((gene, diseases), (disease, genes)) of (gene, disease)."""
    return pairs.groupBy("gene").agg(F.array_sort(F.collect_set("disease")).alias("diseases")), pairs.groupBy("disease").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(disease_id, hpo_id, qualifier, frequency, sex, onset, aspect) of an annotation file (TSV, # comments)."""
    t = spark.read.csv(path, sep="\t", header=True, comment="#", quote="")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t.select(blank("database_id").alias("disease_id"), blank("hpo_id").alias("hpo_id"), *[blank(c).alias(c) for c in ("qualifier", "frequency", "sex", "onset", "aspect")]).filter("disease_id IS NOT NULL AND hpo_id IS NOT NULL")


def read_gene_diseases(spark: SparkSession, path: str, genes: DataFrame, terms: DataFrame | None = None, alias: DataFrame | None = None) -> DataFrame:
    """(gene, disease): by Entrez id, else by symbol; an empty frame where the file is missing.

    With ``terms`` and ``alias`` diseases are live terms, and pairs whose disease has none are left out.
    """
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], "gene string, disease string")
    t = spark.read.csv(path, sep="\t", header=True, quote="")
    by_entrez = genes.filter("entrez_id IS NOT NULL").groupBy(F.col("entrez_id").alias("_e")).agg(F.max("gene").alias("_g1"))
    j = t.withColumn("_e", F.regexp_replace("ncbi_gene_id", "^NCBIGene:", "")).join(by_entrez, "_e", "left")
    j = j.withColumn("symbol", F.upper(F.trim("gene_symbol"))).join(gene_symbols(genes).withColumnRenamed("gene", "_g2"), "symbol", "left")
    pairs = j.select(F.coalesce("_g1", "_g2").alias("gene"), F.col("disease_id").alias("disease")).filter("gene IS NOT NULL AND disease IS NOT NULL").distinct()
    if terms is None or alias is None:
        return pairs
    return pairs.join(normalise_diseases(pairs, terms, alias), "disease").filter("term IS NOT NULL").select("gene", F.col("term").alias("disease")).distinct()


def latest_version(spark: SparkSession, root: str) -> str:
    """The greatest folder name below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    if not names:
        raise FileNotFoundError(f"no version below {root}")
    return f"{root.rstrip('/')}/{max(names)}"


def read_phenopackets(spark: SparkSession, root: str) -> DataFrame:
    """(path, packet): JSON texts below ``root``, undecodable ones left out."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(root)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("packet")).filter(F.from_json("packet", PACKET).isNotNull() & F.try_parse_json("packet").isNotNull())


def read_cases(spark: SparkSession, **origins: str) -> DataFrame:
    """Case records of JSON lines, tagged with the name they were passed under."""
    out = None
    for origin, path in origins.items():
        one = spark.read.schema(CASE_RECORD).json(path).withColumn("origin", F.lit(origin))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no case file")
    return out


def index_cases(cases: DataFrame, *origins: str) -> DataFrame:
    """``read_cases`` with one row per id: of a repeated one the row whose origin comes last in ``origins``, as in an index that is written in that order."""
    place = F.array_position(F.array(*[F.lit(o) for o in origins]), F.col("origin"))
    cols = [c for c in cases.columns if c != "id"]
    return cases.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*cols), F.struct(place, F.xxhash64(*cols))).alias("r")).select("id", "r.*")


def read_availability(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, pmcid, in_archive, in_oa_subset, license, retracted, quotes_permitted, n_cases, tier) of an availability report."""
    entry = "struct<pmcid:string,in_pmc:boolean,in_oa_subset:boolean,license:string,retracted:boolean,quotes_permitted:boolean,n_cases:int,tier:string>"
    t = spark.read.schema(f"per_paper map<string,{entry}>").option("multiLine", True).json(path)
    return t.select(F.explode("per_paper").alias("pmid", "e")).select("pmid", "e.pmcid", F.col("e.in_pmc").alias("in_archive"), "e.in_oa_subset", "e.license", "e.retracted", "e.quotes_permitted", "e.n_cases", "e.tier")


def read_retractions(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, doi, reason, at) of a retraction table (CSV), for ``qa.retraction_keys``."""
    t = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return t.select(pick(t, "OriginalPaperPubMedID", "PubMedID").alias("pmid"), pick(t, "OriginalPaperDOI", "DOI").alias("doi"), pick(t, "Reason").alias("reason"), pick(t, "RetractionDate").alias("at"))


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """(path, individuals): tool arguments, bare or within a message envelope, as JSON."""
    t = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path)
    bare = F.get_json_object("value", "$.individuals")
    wrapped = F.get_json_object("value", "$.content[0].input.individuals")
    return t.select(F.col("_metadata.file_path").alias("path"), F.coalesce(bare, wrapped).alias("individuals")).filter("individuals IS NOT NULL")


# writers
def write_release(records: DataFrame, to: str) -> None:
    """cases, phenopackets and sources as JSON lines; nulls are left out."""
    records.write.mode("overwrite").json(f"{to}/cases")
    to_phenopacket(records).select("packet").write.mode("overwrite").text(f"{to}/phenopackets")
    records.select("source.*").distinct().write.mode("overwrite").json(f"{to}/sources")


def manifest(records: DataFrame, version: str, released: str) -> DataFrame:
    """One JSON text: counts of a release."""
    size = lambda c: F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)))
    counts = records.agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_distinct("source.pmid").alias("n_papers"), size("phenotypes").alias("n_phenotypes"), size("diagnoses").alias("n_diagnoses"),
        size("variants").alias("n_variants"), F.count_if(F.exists(F.coalesce("qa_flags", F.array().cast("array<string>")), lambda f: f.startswith("ERROR"))).alias("n_flagged"),
    )
    flags = records.select(F.explode("qa_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    tier = access_tier(F.nullif(F.trim("source.pmcid"), F.lit("")).isNotNull(), F.coalesce("source.in_oa_subset", F.lit(False)), F.col("source.license"))
    tiers = records.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    listed = lambda t, c: t.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"{c}s")).withColumn("_k", F.lit(1))
    counts = counts.withColumn("_k", F.lit(1)).join(listed(flags, "flag"), "_k").join(listed(tiers, "tier"), "_k").drop("_k")  # a row each
    return counts.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(released).alias("released"), F.lit(SCHEMA_VERSION).alias("schema_version"), *counts.columns)).alias("value"))


def datasheet(manifest_json: str) -> str:
    """A manifest as a short text for readers."""
    m = json.loads(manifest_json)
    lines = [f"# Release {m['version']} ({m['released']})", "", f"{m['n_cases']} records of {m['n_papers']} papers: {m['n_phenotypes']} findings, {m['n_diagnoses']} diagnoses, {m['n_variants']} variants.", ""]
    for name in ("tiers", "flags"):
        lines += [f"## {name.capitalize()}", *(f"- {k}: {v}" for k, v in sorted((m.get(name) or {}).items())), ""]
    return "\n".join(lines)


def export_prompts(requests: DataFrame, to: str) -> None:
    """One JSON request a line, for extraction by hand, in folders by document."""
    requests.select("doc_id", F.col("request").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(to)


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """(file, sha256) of the files below ``root`` in name order; computed where the bytes are. Hidden files are left out.

    The reader passes over empty files, so those are listed by name.
    """
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, empty = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        one = found.next()
        if one.getLen() == 0 and not one.getPath().getName().startswith(("_", ".")):
            empty.append((one.getPath().getName(), hashlib.sha256().hexdigest()))
    sums = t.select(name, F.sha2("content", 256).alias("sha256"))
    return (sums.unionByName(spark.createDataFrame(empty, "file string, sha256 string")) if empty else sums).orderBy("file")


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def write_report(rows: DataFrame, to: str, environment: dict[str, str] | None = None) -> None:
    """A figure report (small) as JSON lines with the environment on each row."""
    rows.withColumn("environment", F.lit(json.dumps(environment or {}, sort_keys=True))).coalesce(1).write.mode("overwrite").json(to)


def text_summary(rows: DataFrame) -> DataFrame:
    """(line): fixed-width lines of (field, n, precision, recall, micro_f1, macro_f1)."""
    return rows.select(F.format_string("%-24s %8d %7.4f %7.4f %7.4f %7.4f", "field", "n", "precision", "recall", "micro_f1", "macro_f1").alias("line"))
