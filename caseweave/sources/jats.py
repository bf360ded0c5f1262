"""JATS articles as text with sections and stable offsets.

Order: title, abstract, paragraphs per section (heading = the section's title), tables (caption, then rows with cells
joined by `` | ``), figure captions; pieces are joined by a blank line and each is normalised before offsets are given,
so offsets hold. Paragraphs outside of any section come once. Articles that cannot be parsed give an empty text with
status ``malformed``.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from caseweave.schema import DOCUMENT

#: Elements whose content is not prose.
DROPPED = frozenset("""
ref-list back journal-meta article-id contrib-group aff author-notes history permissions funding-group
supplementary-material graphic inline-graphic xref label
""".split())
DASHES = str.maketrans("‐‑–—−‘’“”", "-----''\"\"")
_RUN = re.compile("[ \t   ]+")
_LINES = re.compile(r"\s*\n\s*")


def plain(text: str) -> str:
    return _RUN.sub(" ", text.translate(DASHES))


def prose(e: ET.Element | None, dropped: frozenset[str] = DROPPED) -> str:
    """Text of an element in reading order; of a dropped element only what follows it."""
    if e is None:
        return ""
    out = [e.text or ""]
    for child in e:
        if not isinstance(child.tag, str) or child.tag.rpartition("}")[2] not in dropped:
            out.append(prose(child, dropped))
        out.append(child.tail or "")
    return "".join(out)


def tidy(text: str) -> str:
    return _LINES.sub(" ", plain(text)).strip()


def parse_article(xml: str) -> dict[str, Any]:
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?>", "", xml))
    except (ET.ParseError, ValueError):
        return {"text": "", "spans": [], "has_body": False, "status": "malformed"}
    for e in root.iter():
        if isinstance(e.tag, str) and "}" in e.tag:
            e.tag = e.tag.rpartition("}")[2]
    article = root if root.tag == "article" else root.find(".//article")
    if article is None:
        return {"text": "", "spans": [], "has_body": False, "status": "no article"}
    ids = {e.get("pub-id-type"): (e.text or "").strip() for e in article.iterfind(".//article-meta/article-id")}
    pieces: list[tuple[str, str, str | None]] = []

    def add(section: str, text: str, heading: str | None = None) -> None:
        if text:
            pieces.append((section, text, heading))

    title = tidy(prose(article.find(".//article-title")))
    add("title", title)
    add("abstract", tidy(" ".join(prose(p) for p in article.iterfind(".//abstract"))))
    body = article.find("body")
    has_body = body is not None and any(True for _ in body.iter("p"))
    if body is not None:
        for p in body.iterfind("p"):
            add("body", tidy(prose(p)))
        for sec in body.iter("sec"):
            heading = tidy(prose(sec.find("title"))) or None
            for p in sec.iterfind("p"):
                add("body", tidy(prose(p)), heading)
    for wrap in article.iter("table-wrap"):
        rows = [tidy(prose(wrap.find("caption"), frozenset()))]
        rows += [" | ".join(tidy(prose(c, frozenset())) for c in tr if c.tag in ("td", "th")) for tr in wrap.iter("tr")]
        add("table", "\n".join(r for r in rows if r.strip(" |")))
    for fig in article.iter("fig"):
        add("figure_caption", tidy(prose(fig.find("caption"), frozenset())))
    text, spans = "", []
    for section, piece, heading in pieces:
        text += "\n\n" if text else ""
        spans.append({"section": section, "start": len(text), "end": len(text) + len(piece), "heading": heading})
        text += piece
    year = (article.findtext(".//pub-date/year") or "").strip()
    return {
        "pmid": ids.get("pmid"), "pmcid": ids.get("pmc") or ids.get("pmcid"), "doi": ids.get("doi"), "journal": tidy(article.findtext(".//journal-title") or "") or None,
        "pub_year": int(year) if year.isdigit() else None, "title": title, "text": text, "has_body": has_body, "spans": spans, "status": "ok",
    }


def documents(xml: DataFrame, key: str = "doc_id", column: str = "xml") -> DataFrame:
    """Parsed documents of (key, xml) rows."""
    span = pa.struct([("section", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("heading", pa.string())])
    text = [(n, pa.string()) for n in ("doc_id", "pmid", "pmcid", "doi", "journal")]
    layout = pa.schema([*text, ("pub_year", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("has_body", pa.bool_()), ("spans", pa.list_(span)), ("status", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": str(k), **parse_article(x or "")} for k, x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, schema=layout)

    return xml.select(key, column).mapInArrow(run, DOCUMENT)


def section_of(spans: Any, at: Any) -> Any:
    """The first span that holds an offset."""
    from pyspark.sql import functions as F

    return F.get(F.filter(spans, lambda s: (s["start"] <= at) & (at < s["end"])), F.lit(0))
