"""Dictionary grounding of texts: phrases, genes and variant descriptions with offsets and negation.

Matching is greedy from left to right, longest phrase first, without overlaps. Greedy choice is sequential, so it runs
over Arrow batches: the tokens of a text walk once along a trie of the phrases, for several dictionaries at a time, and
only what was found leaves the walk, with the cue that negates it; the text itself does not.

Dictionaries of up to ``MAX_DICTIONARY`` phrases (checked) are broadcast. Beyond that the n-grams of every text are joined
with the phrases and each text's hits are reduced greedily (``ground_by_join``), to the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.functions.text import HGVS_C, HGVS_P, SYMBOL, cue_near

MAX_NGRAM, MIN_PHRASE = 8, 4
MAX_DICTIONARY = 2_000_000
#: Fixed value: a token.
TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9'\-]*|\d+(?:\.\d+)?")
#: Ordinary words that are also labels.
ORDINARY = frozenset("""
all and arm at back bad bar big birth body bridge cause cell chain change chest child class colour color complex cord count
cup cycle death deep delay difference disease disorder down duct ear early end event face fall family fat female few field
fine first flat fluid foot form front full gap general group growth hair hand head heart high hip history hole increase
index infection inflammation injury joint kidney knee large late leg length level life light limb line liver long loss low
lung male mass mean measure middle mild mode more mouth muscle nail neck nerve new normal nose number old one onset organ
pain pattern phenotype plate point position pressure problem process rate ratio reduced response rest result ring rise root
round sample scale sensation series set severe shape sharp short side sign size skin sleep small soft space speech spine
state stone stress study surface syndrome system tall test thick thin time tissue tone total type unit up value vessel view
voice volume wall water weight white wide width young
""".split())  # fmt: skip
#: Symbols that are more often something else.
AMBIGUOUS = frozenset("""
MET SET CAT CAN MAX REST AGO ACHE AIR ARM BAD CAMP CAR CARS COPE GAN IMPACT MICE MIR NHS PIGS RAN SDS SHE SON SPARC STAR
TANK TRIP WARS YES MARS LARS PET AS IS IT OR AND NOT ALL ANY APP AGE END FAT GAS HR ICE LAP MB NET OS PC PIP POP REG SI SIX
TEC TH TIA TOP TRA TYR LCA KS CDH DD ID ASD VSD CHD IUGR SGA ADHD ASD1 MR EEG MRI CT PCR WES WGS SNP CNV NGS CNS GI IQ BMI
OFC SD CI RR
""".split())  # fmt: skip


def dictionary(strict: DataFrame, loose: DataFrame | None = None, allowed: DataFrame | None = None, blocked: frozenset[str] = ORDINARY) -> DataFrame:
    """(phrase, term): one term per phrase, the least id; ``loose`` adds phrases of several words that ``strict`` lacks.

    ``allowed`` (term) restricts the terms, for instance to the descendants of a root; a phrase that ``strict`` has only
    for other terms is left out then, not taken from ``loose``.
    """
    rows = strict.select("phrase", "term").withColumn("_p", F.lit(0))
    if loose is not None:
        more = loose.select("phrase", "term").filter(F.col("phrase").contains(" ")).join(strict.select("phrase").distinct(), "phrase", "left_anti")
        rows = rows.unionByName(more.withColumn("_p", F.lit(1)))
    if allowed is not None:
        rows = rows.join(allowed.select("term").distinct(), "term", "left_semi")
    single = ~F.col("phrase").contains(" ") & F.rtrim("phrase", F.lit("s")).isin(*sorted(blocked)) if blocked else F.lit(False)
    kept = rows.filter((F.length("phrase") >= MIN_PHRASE) & ~F.col("phrase").isin(*sorted(blocked)) & ~single if blocked else F.length("phrase") >= MIN_PHRASE)
    return kept.groupBy("phrase").agg(F.min_by("term", F.struct("_p", "term")).alias("term"))


class PhraseTrie:
    """Phrases token by token; a node maps tokens to nodes, and None to the term of the phrase that ends there."""

    def __init__(self, phrases: Iterable[tuple[str, str]]):
        self.root: dict[Any, Any] = {}
        for phrase, term in phrases:
            node = self.root
            for token in phrase.split(" "):
                node = node.setdefault(token, {})
            node[None] = term

    def walk(self, tokens: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str]]:
        """(start, end, term) of the greedy matches of (lower-case token, start, end).

        The last token of a match may have an s too many, as in a plural; of two phrases equally long the one as written
        counts.
        """
        at, n = 0, len(tokens)
        while at < n:
            node, best, upto = self.root, None, at
            for k in range(at, min(n, at + MAX_NGRAM)):
                token = tokens[k][0]
                further = node.get(token)
                found = further.get(None) if further else None
                if found is None and token[-1] == "s" and (single := node.get(token.rstrip("s"))):
                    found = single.get(None)
                if found is not None:
                    best, upto = found, k
                if further is None:
                    break
                node = further
            if best is None:
                at += 1
            else:
                yield tokens[at][1], tokens[upto][2], best
                at = upto + 1


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in TOKEN.finditer(text)]


_tries: dict[int, dict[str, PhraseTrie]] = {}


def tries_of(shared: Any) -> dict[str, PhraseTrie]:
    """The tries of a broadcast of phrases, made once per Python worker."""
    phrases = shared.value
    if (key := id(phrases)) not in _tries:
        _tries.clear()
        _tries[key] = {name: PhraseTrie(rows) for name, rows in phrases.items()}
    return _tries[key]


def broadcast_phrases(df: DataFrame, dictionaries: dict[str, DataFrame]) -> Any:
    """A broadcast of the phrases of all dictionaries, or None if there are more than ``MAX_DICTIONARY``."""
    rows, left = {}, MAX_DICTIONARY
    for name, phrases in dictionaries.items():
        words = phrases.select("phrase", "term").limit(left + 1).toArrow()
        left -= words.num_rows
        if left < 0:
            return None
        rows[name] = list(zip(words["phrase"].to_pylist(), words["term"].to_pylist()))
    return df.sparkSession.sparkContext.broadcast(rows)


FOUND = "start_char int, end_char int, term string, phrase string, negation_cue string"


def _layout(df: DataFrame, keep: tuple[str, ...], more: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), more])


def _found_batch(batch: pa.RecordBatch, keep: tuple[str, ...], rows: list[int], out: list[tuple[Any, ...]], names: list[str]) -> pa.RecordBatch:
    kinds = {"start_char": pa.int32(), "end_char": pa.int32()}
    kept = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keep))]
    return pa.RecordBatch.from_arrays([*kept, *(pa.array([o[i] for o in out], kinds.get(n, pa.string())) for i, n in enumerate(names))], names=[*keep, *names])


def ground_many(df: DataFrame, dictionaries: dict[str, DataFrame], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, dictionary, start_char, end_char, term, phrase, negation_cue): matches of every dictionary, in one pass over the texts.

    Null and empty texts give none; repeated rows give repeated matches.
    """
    shared = broadcast_phrases(df, dictionaries)
    if shared is None:
        out = None
        for name, phrases in dictionaries.items():
            one = ground_by_join(df, phrases, text, keep).select(*keep, F.lit(name).alias("dictionary"), "start_char", "end_char", "term", "phrase", "negation_cue")
            out = one if out is None else out.unionByName(one)
        return out
    names = ["dictionary", "start_char", "end_char", "term", "phrase", "negation_cue"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = tries_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[int] = []
                out: list[tuple[Any, ...]] = []
                for i, value in enumerate(part.column(len(keep)).to_pylist()):
                    tokens = tokens_of(value) if value else []
                    for name, trie in tries.items():
                        for start, end, term in trie.walk(tokens):
                            rows.append(i)
                            out.append((name, start, end, term, value[start:end], cue_near(value, start, end)))
                yield _found_batch(part, keep, rows, out, names)

    return df.select(*keep, text).mapInArrow(run, _layout(df, keep, f"dictionary string, {FOUND}"))


def ground(df: DataFrame, phrases: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, start_char, end_char, term, phrase, negation_cue) of every match of ``text``."""
    return ground_many(df, {"": phrases}, text, keep).drop("dictionary")


def ground_by_join(df: DataFrame, phrases: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``ground`` for dictionaries of any size.

    A text is named by its kept columns and the hash of its text; rows alike in both have the same matches, which go to
    each of them. The n-grams are shuffled without the text; what is chosen comes back to it for the phrase and the cue.
    """
    mark = F.md5(F.encode(F.col(text), "utf-8"))
    named = df.select(*keep, F.col(text).alias("_text"), mark.alias("_mark")).filter(F.col("_text") != "")
    keys = [*keep, "_mark"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows: list[int] = []
                out: list[tuple[int, int, int, int, int, str]] = []
                for i, value in enumerate(part.column(len(keys)).to_pylist()):
                    tokens = tokens_of(value)
                    for a in range(len(tokens)):
                        for n in range(1, min(MAX_NGRAM, len(tokens) - a) + 1):
                            words = " ".join(t[0] for t in tokens[a : a + n])
                            for stripped, w in enumerate((words, words.rstrip("s"))):
                                if not stripped or w != words:
                                    rows.append(i)
                                    out.append((a, -n, stripped, tokens[a][1], tokens[a + n - 1][2], w))
                kept = [part.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keys))]
                more = [pa.array([o[k] for o in out], pa.string() if k == 5 else pa.int32()) for k in range(6)]
                yield pa.RecordBatch.from_arrays([*kept, *more], names=[*keys, "at", "n", "stripped", "start_char", "end_char", "phrase"])

    once = named.dropDuplicates(keys)
    made = once.select(*keys, "_text").mapInArrow(grams, _layout(named, tuple(keys), "at int, n int, stripped int, start_char int, end_char int, phrase string"))
    hits = made.join(phrases.select("phrase", "term"), "phrase")
    per = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "n", "stripped", "start_char", "end_char", "term"))).alias("h"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<start_char:int,end_char:int,term:string>>").alias("got"))
    chosen = F.aggregate(
        "h", start,
        lambda acc, x: F.when(x["at"] >= acc["free"], F.struct((x["at"] - x["n"]).alias("free"), F.concat(acc["got"], F.array(F.struct(x["start_char"], x["end_char"], x["term"]))).alias("got"))).otherwise(acc),
        lambda acc: acc["got"],
    )
    picked = per.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], chosen.alias("_got"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    back = named.join(picked, same).select(*keep, "_text", "_got")
    names = ["start_char", "end_char", "term", "phrase", "negation_cue"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[tuple[Any, ...]] = []
            for i, (value, got) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())):
                for m in got:
                    s, e = m["start_char"], m["end_char"]
                    rows.append(i)
                    out.append((s, e, m["term"], value[s:e], cue_near(value, s, e)))
            yield _found_batch(batch, keep, rows, out, names)

    return back.mapInArrow(describe, _layout(df, keep, FOUND))


def gene_mentions(df: DataFrame, symbols: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, symbol, gene, n): known symbols of a text, case kept; ``symbols`` is (symbol, gene)."""
    every = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({SYMBOL})"), F.lit(1))).alias("symbol")).filter(~F.col("symbol").isin(*sorted(AMBIGUOUS)))
    counted = every.groupBy(key, "symbol").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(symbols.select("symbol", "gene"), "symbol").select(key, "symbol", "gene", "n")


def variant_mentions(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, kind, variant, n): coding (hgvs.c) and protein (hgvs.p) changes of a text."""
    one = lambda kind, pattern: df.select(key, F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).alias("variant"))
    return one("hgvs.c", HGVS_C).unionByName(one("hgvs.p", HGVS_P)).groupBy(key, "kind", "variant").agg(F.count(F.lit(1)).alias("n"))


def pattern_offsets(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, kind, start_char, end_char, found): gene symbols (not ambiguous), coding and protein changes with offsets in code points."""
    patterns = {"gene": re.compile(SYMBOL), "hgvs.c": re.compile(HGVS_C), "hgvs.p": re.compile(HGVS_P)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for kind, pattern in patterns.items():
                    for m in pattern.finditer(value or ""):
                        if kind != "gene" or m.group() not in AMBIGUOUS:
                            rows.append(i)
                            out.append((kind, m.start(), m.end(), m.group()))
            yield _found_batch(batch, (key,), rows, out, ["kind", "start_char", "end_char", "found"])

    return df.select(key, text).mapInArrow(run, _layout(df, (key,), "kind string, start_char int, end_char int, found string"))
