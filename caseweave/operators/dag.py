"""Term hierarchies as frames: aliases, closure, information content, semantic similarity.

Everything is materialised once and joined: ``alias`` (src, dst), ``edges`` (child, parent), ``closure`` (term,
ancestor, depth) with the shortest depth and the term itself at depth 0, ``ic`` (term, ic).

Terms come as the ``terms`` table: term_id, parents, alt_ids, obsolete, replaced_by, term_name, synonyms, xrefs. Ids are
cleaned (trimmed, upper-cased). Null lists are empty; parents that are no terms are dropped; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.ids import clean_id, newest
from caseweave.session import cut, release


def term_rows(terms: DataFrame) -> DataFrame:
    """(id, name, obsolete, next, parents, alts, added_at), one row per term id: the one modified last, settled by a hash."""
    empty = F.array().cast("array<string>")

    def cleaned(name: str) -> Column:
        ids = F.transform(F.coalesce(name, empty), clean_id)
        return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))

    time = lambda name: (F.col(name) if name in terms.columns else F.lit(None)).cast("timestamp").alias(name)
    rows = terms.select(
        clean_id(F.col("term_id")).alias("id"), (F.col("term_name") if "term_name" in terms.columns else F.lit(None).cast("string")).alias("name"), F.coalesce("obsolete", F.lit(False)).alias("obsolete"),
        clean_id(F.col("replaced_by")).alias("next"), cleaned("parents").alias("parents"), cleaned("alt_ids").alias("alts"), time("added_at"), time("modified_at"),
    )
    return newest(rows, "id", "modified_at", "name", "obsolete", "next", "parents", "alts", "added_at").drop("modified_at")


def alias_closure(rows: DataFrame) -> DataFrame:
    """(src, dst): every id a term can be called by, resolved to the end.

    An alternative id leads to its term, a withdrawn term with a successor to that; one without stays itself. Chains
    are followed by doubling: each round joins the pointers with themselves, so a chain of n steps takes log2(n)
    rounds. While a chain with an end is unresolved each round resolves some id, so a round that resolves none has
    only circles left; an id whose chain runs into a circle keeps its own term. Chains that leave the ontology give no row.
    """
    forward = rows.filter(F.col("obsolete") & F.col("next").isNotNull()).select(F.col("id").alias("src"), F.col("next").alias("dst"), F.col("id").alias("own"))
    alts = rows.select(F.explode("alts").alias("src"), F.col("id").alias("dst")).groupBy("src").agg(F.min("dst").alias("dst")).withColumn("own", F.col("dst"))
    hops = cut(forward.unionByName(alts.join(forward.select("src"), "src", "left_anti")).withColumn("open", F.lit(True)))
    left = -1
    while True:
        step = hops.select(F.col("src").alias("dst"), F.col("dst").alias("further"))
        before = hops
        hops = cut(hops.join(step, "dst", "left").select("src", F.coalesce("further", "dst").alias("dst"), "own", F.col("further").isNotNull().alias("open")))
        release(before)
        now = hops.filter("open").count()
        if now in (0, left):
            break
        left = now
    known = rows.select(F.col("id").alias("dst"))
    own = rows.select(F.col("id").alias("src"), F.col("id").alias("dst")).join(hops.select("src"), "src", "left_anti")
    ended = hops.select("src", F.when(F.col("open"), F.col("own")).otherwise(F.col("dst")).alias("dst"))
    return own.unionByName(ended.join(known, "dst", "left_semi").select("src", "dst"))


def edges(rows: DataFrame) -> DataFrame:
    """(child, parent) between known terms."""
    pairs = rows.select(F.col("id").alias("child"), F.explode("parents").alias("parent")).distinct()
    return pairs.join(rows.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent")


def closure(rows: DataFrame) -> DataFrame:
    """(term, ancestor, depth): reflexive closure with shortest depths.

    By squaring: a round joins the pairs found with themselves and keeps the shortest depth of each, so k rounds reach
    2**k levels; a round that adds no pair ends it. Diamonds are merged in every round and circles end.
    """
    own = rows.select(F.col("id").alias("term"), F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    found = cut(own.unionByName(edges(rows).filter("child <> parent").select(F.col("child").alias("term"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))))
    n = found.count()
    while True:
        upper = found.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        longer = found.join(upper, "ancestor").groupBy("term", F.col("top").alias("ancestor")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        before, found = found, cut(longer)
        release(before)
        before_n, n = n, found.count()
        if n == before_n:
            return found


def path_distance(pairs: DataFrame, closed: DataFrame, max_hops: int = 6) -> DataFrame:
    """``pairs`` (a, b) with ``distance``: least sum of depths to a common ancestor at most ``max_hops`` up on each side, or null."""
    near = closed.filter(F.col("depth") <= max_hops)
    up_a = near.select(F.col("term").alias("a"), "ancestor", F.col("depth").alias("da"))
    up_b = near.select(F.col("term").alias("b"), "ancestor", F.col("depth").alias("db"))
    best = pairs.select("a", "b").distinct().join(up_a, "a").join(up_b, ["b", "ancestor"]).groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("distance"))
    return pairs.join(best, ["a", "b"], "left")


def resolve(df: DataFrame, column: str, alias: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by the live id; null where unknown."""
    joined = df.join(alias.select(F.col("src").alias(column), F.col("dst").alias("_dst")), column, "left")
    return joined.withColumn(column, F.col("_dst")).drop("_dst").select(*df.columns)


def propagated_counts(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """(term, n): distinct owners annotated with the term or a descendant; ``annotations`` is (owner, term).

    Pairs are made distinct before and after they climb, so the shuffle carries each (ancestor, owner) once.
    """
    climbed = annotations.select("owner", "term").distinct().join(closed.select("term", "ancestor"), "term")
    return climbed.select("ancestor", "owner").distinct().groupBy(F.col("ancestor").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def information_content(rows: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    """(term, ic) of every term: -ln(n / total), ln(total) where nothing is annotated; ``total`` is one row ``total``."""
    n = total.first()[0]  # one number
    joined = rows.select(F.col("id").alias("term")).join(counts, "term", "left").withColumn("total", F.lit(float(n or 0.0)))
    share = F.when(F.col("n").isNull(), F.log("total")).otherwise(-F.log(F.col("n") / F.col("total")))
    return joined.select("term", F.when(F.col("total") > 0, share).otherwise(F.lit(0.0)).alias("ic"))


def pair_ic(left: DataFrame, right: DataFrame, closed: DataFrame, ic: DataFrame, positive: bool = False, with_mica: bool = True) -> DataFrame:
    """(a, b, mica, ic) for the terms of two frames with a column ``term`` that have a common ancestor.

    The most informative common ancestor, ties to the least id. Only terms that occur are joined, on the ancestor.
    ``positive`` leaves out ancestors without information before the join, which at the top of a hierarchy would bring
    every term together with every other; ``with_mica=False`` gives (a, b, ic) from a plain maximum.
    """
    worth = ic.select(F.col("term").alias("ancestor"), "ic")
    up = closed.select("term", "ancestor").join(worth.filter("ic > 0") if positive else worth, "ancestor")
    a = left.select("term").distinct().join(up, "term").select(F.col("term").alias("a"), "ancestor", "ic")
    b = right.select("term").distinct().join(closed.select("term", "ancestor"), "term").select(F.col("term").alias("b"), "ancestor")
    met = a.join(b, "ancestor").groupBy("a", "b")
    if not with_mica:
        return met.agg(F.max("ic").alias("ic"))
    return met.agg(F.max("ic").alias("ic"), F.min_by("ancestor", F.struct(-F.col("ic"), "ancestor")).alias("mica")).select("a", "b", "mica", "ic")


def lin(pairs: DataFrame, ic: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ic) with ``lin`` = 2 ic / (ic(a) + ic(b)), within 0 and 1; equal terms 1, no information 0."""
    one = pairs.join(ic.select(F.col("term").alias("a"), F.col("ic").alias("ia")), "a").join(ic.select(F.col("term").alias("b"), F.col("ic").alias("ib")), "b")
    ratio = F.coalesce(F.try_divide(2 * F.col("ic"), F.col("ia") + F.col("ib")), F.lit(0.0))
    value = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))
    return one.withColumn("lin", value).drop("ia", "ib")


def xref_index(terms: DataFrame, alias: DataFrame, prefixes: list[str], predicate: str | None = None) -> DataFrame:
    """(xref, term): external ids with one of the prefixes, to live terms; ``predicate`` must occur in the modifier."""
    x = terms.select(clean_id(F.col("term_id")).alias("term"), F.explode("xrefs").alias("x")).select("term", F.col("x.xref").alias("xref"), F.col("x.modifier").alias("modifier"))
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("xref").startswith(p)
    x = x.filter(keep & F.col("term").isNotNull())
    if predicate:
        x = x.filter(F.col("modifier").contains(predicate))
    return resolve(x.select("xref", "term"), "term", alias).filter(F.col("term").isNotNull()).distinct()


def first_xref(exact: DataFrame, loose: DataFrame) -> DataFrame:
    """(xref, term): one live term per external id; exact equivalences first, then the least term id."""
    ranked = exact.withColumn("_p", F.lit(0)).unionByName(loose.withColumn("_p", F.lit(1)))
    return ranked.groupBy("xref").agg(F.min_by("term", F.struct("_p", "term")).alias("term"))


def normalise_diseases(ids: DataFrame, terms: DataFrame, alias: DataFrame, prefixes: tuple[str, ...] = ("OMIM:", "ORPHANET:", "DECIPHER:"), own: str = "MONDO:", predicate: str = "equivalentTo") -> DataFrame:
    """(disease, term): live terms for ids (disease) of any vocabulary, null where there is none.

    An id with the prefix ``own`` goes through the aliases. Any other is looked up in the cross references, ORPHA: read as
    Orphanet: and letter case ignored; for each of them exact equivalences come first, then the least term id.
    """
    x = terms.withColumn("xrefs", F.transform("xrefs", lambda x: F.struct(F.regexp_replace(F.upper(F.trim(x["xref"])), "^ORPHA:", "ORPHANET:").alias("xref"), x["modifier"].alias("modifier"))))
    index = first_xref(xref_index(x, alias, list(prefixes), predicate), xref_index(x, alias, list(prefixes))).select(F.col("xref").alias("_key"), F.col("term").alias("_x"))
    asked = ids.select("disease").distinct().withColumn("_key", F.regexp_replace(F.coalesce(clean_id(F.col("disease")), F.lit("")), "^ORPHA:", "ORPHANET:"))
    j = asked.join(alias.select(F.col("src").alias("_key"), F.col("dst").alias("_a")), "_key", "left").join(index, "_key", "left")
    return j.select("disease", F.when(F.col("_key").startswith(own), F.col("_a")).otherwise(F.col("_x")).alias("term"))


def look_up(refs: DataFrame, rows: DataFrame, alias: DataFrame) -> DataFrame:
    """(ref, known, term, label) of references (ref): whether the ontology has them, the live term and its name."""
    j = refs.select("ref").distinct().join(alias.select(F.col("src").alias("ref"), F.col("dst").alias("term")), "ref", "left")
    return j.join(rows.select(F.col("id").alias("term"), F.col("name").alias("label")), "term", "left").select("ref", F.col("term").isNotNull().alias("known"), "term", "label")


def label_index(terms: DataFrame, scopes: tuple[str, ...] = ("EXACT", "NARROW"), names: bool = True) -> DataFrame:
    """(phrase, term): lower-cased names and synonyms of the scopes, withdrawn terms left out."""
    empty = F.array().cast(terms.schema["synonyms"].dataType)
    syn = F.transform(F.filter(F.coalesce("synonyms", empty), lambda s: s["scope_kind"].isin(*scopes)), lambda s: s["syn"])
    every = F.concat(F.array("term_name"), syn) if names else syn
    rows = terms.filter(~F.coalesce("obsolete", F.lit(False))).select(clean_id(F.col("term_id")).alias("term"), F.explode(every).alias("phrase"))
    return rows.select(F.lower(F.trim("phrase")).alias("phrase"), "term").filter((F.col("phrase") != "") & F.col("term").isNotNull()).distinct()
