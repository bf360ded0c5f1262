"""Nested JSON deliveries as flat, related tables.

Every payload is walked depth first. Each node of interest (record, assertion, evidence) gets a number when the walk
enters it and one when it leaves it; a node lies below another exactly if its interval lies inside the other's. The
walk gives one long table of nodes; tables per type are cut out of it, and a child finds its parents by interval
containment: in the order of entry, the parent of a kind is the last node of that kind whose interval is still open.

Defined cases:

* a null, empty or invalid payload (NaN and Infinity are not JSON) gives nothing; so does one that is no object;
* a record stands alone, under ``record``, or in a list under ``records`` (a lone object there is a list of one);
* a lone object stands for a list of one, a string holding a JSON list or object for that list or object; null or
  other entries are counted in the positions and give no node;
* missing keys are null; ids that are not text become their JSON text; foreign keys are ignored;
* a repeated ``raw_id`` counts once: the delivery received last, settled by a hash of the payload.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LISTS = {"phenotypes": "phenotype", "diagnoses": "diagnosis", "variants": "variant"}
NODES = "raw_id bigint, node string, pre bigint, post bigint, pos bigint, node_id string, label string, detail string"


def _refuse(name: str) -> Any:
    raise ValueError(name)


BLANKS = re.compile(r"[ \t\n\r]*")
NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def parse_any(text: str) -> Any:
    """The value of a JSON text of any depth, without recursion; integers beyond Python's limit of digits stay text. ValueError if invalid."""
    skip = lambda i: BLANKS.match(text, i).end()

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(i)
        name, i = scanstring(text, i + 1, True)
        if text[(i := skip(i)) : i + 1] != ":":
            raise ValueError(i)
        return name, skip(i + 1)

    open_: list[list[Any]] = []  # what is open, each with the key the next value goes to
    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("[", "{"):
            value: Any = [] if c == "[" else {}
            at = skip(at + 1)
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                name, at = key(at) if c == "{" else (None, at)
                open_.append([value, name])
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in WORDS and text.startswith(WORDS[c][0], at):
            value, at = WORDS[c][1], at + len(WORDS[c][0])
        elif m := NUMBER.match(text, at):
            at = m.end()
            try:
                value = float(m[0]) if m[2] or m[3] else int(m[0])
            except ValueError:
                value = m[0]
        else:
            raise ValueError(at)
        while True:
            at = skip(at)
            if not open_:
                if at < len(text):
                    raise ValueError(at)
                return value
            box, name = open_[-1]
            if isinstance(box, list):
                box.append(value)
            else:
                box[name] = value
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(box, dict):
                    open_[-1][1], at = key(at)
                break
            if c != ("]" if isinstance(box, list) else "}"):
                raise ValueError(at)
            open_.pop()
            value, at = box, at + 1


def parse(text: Any) -> Any:
    """The value of a JSON text; None if it is no valid JSON. What ``json`` gives up on, too deep or too many digits, is read by ``parse_any``."""
    try:
        return json.loads(text, parse_constant=_refuse) if isinstance(text, str) else None
    except json.JSONDecodeError:
        return None
    except (ValueError, RecursionError):
        try:
            return parse_any(text)
        except ValueError:
            return None


def entries(value: Any) -> list[Any]:
    if isinstance(value, str):
        value = parse(value)
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def as_text(value: Any) -> str | None:
    """Text as it is, other values as JSON; halves of surrogate pairs become question marks, too deep values null."""
    try:
        text = value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        return None
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


class Walk:
    """Depth-first numbering of one payload."""

    def __init__(self, raw_id: int, rows: list[list[Any]]):
        self.raw_id, self.rows, self.clock = raw_id, rows, 0

    def enter(self, node: str, pos: int, node_id: Any, label: Any, detail: Any) -> list[Any]:
        self.clock += 1
        row = [self.raw_id, node, self.clock, 0, pos, as_text(node_id), as_text(label), detail]
        self.rows.append(row)
        return row

    def leave(self, row: list[Any]) -> None:
        self.clock += 1
        row[3] = self.clock

    def record(self, rec: dict[str, Any], pos: int) -> None:
        me = self.enter("record", pos, rec.get("id"), None, None)
        for key, kind in LISTS.items():
            for i, item in enumerate(entries(rec.get(key))):
                if isinstance(item, dict):
                    self.assertion(kind, i, item)
        self.leave(me)

    def assertion(self, kind: str, pos: int, item: dict[str, Any]) -> None:
        about = item.get({"phenotype": "term", "diagnosis": "disease", "variant": "gene"}[kind])
        about = about if isinstance(about, dict) else {}
        rest = {k: v for k, v in item.items() if k not in ("evidence", "term", "disease", "gene")}
        me = self.enter(kind, pos, about.get("id"), about.get("label"), as_text(rest))
        for i, ev in enumerate(entries(item.get("evidence"))):
            if isinstance(ev, dict):
                rest = {k: v for k, v in ev.items() if k not in ("source_id", "section")}
                self.leave(self.enter("evidence", i, ev.get("source_id"), ev.get("section"), as_text(rest)))
        self.leave(me)


def walk_payload(raw_id: int, payload: Any, rows: list[list[Any]]) -> None:
    value = parse(payload)
    if not isinstance(value, dict):
        return
    w = Walk(raw_id, rows)
    found = [value["record"]] if "record" in value else value["records"] if "records" in value else [value]
    if not isinstance(found, list):
        found = [found]
    for pos, rec in enumerate(found):
        rec = parse(rec) if isinstance(rec, str) else rec
        for one in rec if isinstance(rec, list) else [rec]:
            if isinstance(one, dict):
                w.record(one, pos)


def nodes(raw: DataFrame) -> DataFrame:
    """(raw_id, node, pre, post, pos, node_id, label, detail): all nodes of all payloads, numbered per ``raw_id``."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                rows: list[list[Any]] = []
                for raw_id, payload in zip(pdf["raw_id"].iloc[at : at + 500], pdf["payload"].iloc[at : at + 500]):
                    walk_payload(int(raw_id), payload, rows)
                yield pd.DataFrame(rows, columns=names)

    last = raw.filter(F.col("raw_id").isNotNull()).groupBy("raw_id").agg(F.max_by("payload", F.struct("received_at", F.xxhash64("payload"))).alias("payload"))
    return last.mapInPandas(walk, NODES)


def with_parents(tree: DataFrame) -> DataFrame:
    """Each node with the record and the assertion whose intervals contain its own.

    Nodes of one ``raw_id`` are ordered by entry; since intervals nest, the last record (assertion) entered is the
    container if it ends after the node, and there is none if it ended before.
    """
    w = W.partitionBy("raw_id").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)

    def open_node(is_kind: Column, name: str) -> Column:
        return F.last(F.when(is_kind, F.struct("pre", "post", "node_id", "pos", "node")), ignorenulls=True).over(w).alias(name)

    t = tree.select("*", open_node(F.col("node") == "record", "_r"), open_node(F.col("node").isin(*LISTS.values()), "_a"))
    inside = lambda p: F.when(F.col(f"{p}.post") > F.col("post"), F.col(p))
    return t.withColumn("record", inside("_r")).withColumn("assertion", inside("_a")).drop("_r", "_a")


def record_table(tree: DataFrame) -> DataFrame:
    return tree.filter("node = 'record'").select("raw_id", F.col("pre").alias("record_pre"), F.col("pos").alias("record_pos"), F.col("node_id").alias("record_id"))


def assertion_table(linked: DataFrame) -> DataFrame:
    return linked.filter(F.col("node").isin(*LISTS.values())).select(
        "raw_id", F.col("record.pre").alias("record_pre"), F.col("record.node_id").alias("record_id"), F.col("pre").alias("item_pre"),
        F.col("node").alias("item_kind"), F.col("pos").alias("item_pos"), F.col("node_id").alias("about_id"), F.col("label").alias("about_label"), "detail",
    )


def evidence_table(linked: DataFrame) -> DataFrame:
    return linked.filter("node = 'evidence'").select(
        "raw_id", F.col("record.pre").alias("record_pre"), F.col("record.node_id").alias("record_id"), F.col("assertion.pre").alias("item_pre"),
        F.col("assertion.node").alias("item_kind"), F.col("assertion.pos").alias("item_pos"), F.col("pos").alias("evidence_pos"),
        F.col("node_id").alias("source_id"), F.col("label").alias("section"), "detail",
    )
