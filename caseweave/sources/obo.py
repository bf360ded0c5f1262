"""Scan of OBO ontology files into the ``terms`` layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_obo(spark: SparkSession, path: str, id_prefix: str = "") -> DataFrame:
    """(term_id, term_name, parents, alt_ids, xrefs, synonyms, obsolete, replaced_by, definition).

    The file is split into stanzas by the reader, so a large one is read in parallel; only [Term] stanzas whose id has
    the prefix are kept, and of a repeated id the last stanza in the file.
    """
    stanzas = spark.read.option("lineSep", "\n[").text(path).select(F.monotonically_increasing_id().alias("_at"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    terms = stanzas.filter(F.regexp_replace(F.col("lines")[0], r"^\[", "") == "Term]")

    def values(tag: str) -> Column:
        """Values of a tag without the comment behind `` ! ``."""
        rows = F.filter("lines", lambda x: x.startswith(f"{tag}: "))
        return F.transform(rows, lambda x: F.trim(F.split_part(F.substring(x, len(tag) + 3, 1 << 30), F.lit(" ! "), F.lit(1))))

    bare = lambda v: F.trim(F.regexp_replace(v, r"\s*\{[^}]*\}\s*$", ""))
    modifier = lambda v: F.nullif(F.regexp_extract(v, r"\{([^}]*)\}\s*$", 1), F.lit(""))
    first = lambda tag: F.get(F.transform(values(tag), bare), F.lit(0))
    raw = lambda tag: F.transform(F.filter("lines", lambda x: x.startswith(f"{tag}: ")), lambda x: F.substring(x, len(tag) + 3, 1 << 30))
    synonym = r'^"((?:[^"\\]|\\.)*)"\s*([A-Z]*)'
    out = terms.select(
        "_at", first("id").alias("term_id"), first("name").alias("term_name"), F.transform(values("is_a"), bare).alias("parents"), F.transform(values("alt_id"), bare).alias("alt_ids"),
        F.transform(values("xref"), lambda v: F.struct(F.split_part(bare(v), F.lit(" "), F.lit(1)).alias("xref"), modifier(v).alias("modifier"))).alias("xrefs"),
        F.transform(raw("synonym"), lambda v: F.struct(F.regexp_extract(v, synonym, 1).alias("syn"), F.coalesce(F.nullif(F.regexp_extract(v, synonym, 2), F.lit("")), F.lit("RELATED")).alias("scope_kind"))).alias("synonyms"),
        (F.coalesce(first("is_obsolete"), F.lit("false")) == "true").alias("obsolete"), first("replaced_by").alias("replaced_by"),
        F.nullif(F.regexp_extract(F.coalesce(F.get(raw("def"), F.lit(0)), F.lit("")), r'^"((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("definition"),
    )
    kept = out.filter(F.col("term_id").startswith(id_prefix))
    cols = [c for c in kept.columns if c not in ("_at", "term_id")]
    return kept.groupBy("term_id").agg(F.max_by(F.struct(*cols), "_at").alias("r")).select("term_id", "r.*")
