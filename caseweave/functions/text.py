"""Text expressions that stay in the JVM: clean-up, offsets, patterns, negation cues."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Cues before a finding, behind it, and words and marks that end a cue's reach, in order of precedence.
CUES_BEFORE = (
    "no evidence of", "no signs of", "no sign of", "no history of", "not have", "without evidence of", "with no",
    "negative for", "ruled out", "rule out", "free of", "absence of", "lack of", "lacked", "lacks", "denies", "denied",
    "without", "absent", "no", "not", "never", "neither", "nor", "excluded", "unremarkable for", "resolution of",
    "failed to show", "did not show", "did not have", "does not have", "was not", "were not",
)
CUES_BEHIND = (
    "was absent", "were absent", "is absent", "are absent", "was not present", "were not present", "not present",
    "not seen", "not observed", "not detected", "not identified", "not found", "was normal", "were normal", "ruled out",
    "was excluded", "were excluded", "were negative", "was negative",
)
REACH_ENDS = (
    "but", "however", "although", "though", "except", "aside from", "apart from", "other than", "whereas", "while",
    "nevertheless", ";", "despite", ".", "?", "!",
)
#: Patterns of variant descriptions and of gene symbols.
HGVS_C = r"(?i)\b(?:[NX][MR]_\d+(?:\.\d+)?:)?c\.[\d_+\-*]+(?:[ACGT]+>[ACGT]+|del[ACGT]*|dup[ACGT]*|ins[ACGT]+|delins[ACGT]+)"
HGVS_P = r"\b(?:[NX]P_\d+(?:\.\d+)?:)?p\.\(?[A-Z][a-z]{2}\d+(?:[A-Z][a-z]{2}|Ter|\*|fs|del|dup)\)?"
SYMBOL = r"\b[A-Z][A-Z0-9]{1,9}(?:-[A-Z0-9]{1,4})?\b"
#: Words that start headings of sections that are not about the patients, and of titles of reviews.
OTHER_HEADINGS = (
    "introduction", "background", "discussion", "conclusion", "conclusions", "review", "literature", "related work",
    "materials and methods", "methods", "material and methods", "statistical analysis", "funding", "acknowledg",
    "competing interests", "author contributions", "abbreviations", "references", "ethics", "consent",
    "availability of data",
)
REVIEW_TITLE = (
    r"(?i)\b(review|meta-analysis|systematic|scoping|narrative)\b|current (status|approaches|perspectives|concepts)"
    r"|\bstate of the art\b|\bupdate on\b|\badvances in\b|\boverview of\b|\bwhat we know\b"
)
QUOTABLE = ("CC0", "CC BY", "CC BY-SA")
WINDOW = 60


def normalised(c: Column) -> Column:
    """Dashes and curly quotes made plain, runs of blanks within a line made one space; line ends stay."""
    plain = F.translate(c, "‐‑–—−‘’“”", "-----''\"\"")
    return F.regexp_replace(plain, "[ \\t\\x{A0}\\x{2007}\\x{202F}]+", " ")


def words_pattern(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def is_patient_heading(section: Column, heading: Column) -> Column:
    """Titles, abstracts and tables always; other sections unless their heading holds one of the listed words."""
    return section.isin("title", "abstract", "table") | (F.coalesce(F.trim(heading), F.lit("")) == "") | ~F.lower(heading).rlike(words_pattern(OTHER_HEADINGS))


def _first_cue(reach: Column, cues: tuple[str, ...]) -> Column:
    out = None
    for cue in cues:
        hit = reach.rlike(rf"(?:^|[^a-z]){re.escape(cue)}(?:[^a-z]|$)")
        out = F.when(hit, F.lit(cue)) if out is None else out.when(hit, F.lit(cue))
    return out


def negation_cue(text: Column, start: Column, end: Column, window: int = WINDOW) -> Column:
    """The cue that negates ``text[start:end]`` (offsets from 0), or null.

    Left of the finding the last ``window`` characters behind the last ending of reach are searched, then right of it
    those before the first. The first cue in list order counts.
    """
    begin = F.greatest(start - window, F.lit(0))
    left = F.lower(F.substring(text, begin + 1, start - begin))
    # endings apply one after another, each to what the one before left over
    for stop in REACH_ENDS:
        left = F.substring_index(left, stop, -1)
    right = F.lower(F.substring(text, end + 1, F.lit(window)))
    for stop in REACH_ENDS:
        right = F.substring_index(right, stop, 1)
    return F.coalesce(_first_cue(left, CUES_BEFORE), _first_cue(right, CUES_BEHIND))


def _any_of(words: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)))


def _alone(words: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(f"(?<![a-z])(?:{_any_of(words).pattern})(?![a-z])")


_REACH, _BEFORE, _BEHIND = _any_of(REACH_ENDS), _alone(CUES_BEFORE), _alone(CUES_BEHIND)
_EACH = {cue: _alone((cue,)) for cue in (*CUES_BEFORE, *CUES_BEHIND)}


def cue_near(text: str, start: int, end: int, window: int = WINDOW) -> str | None:
    """``negation_cue`` of a text at hand, for functions that walk texts anyway."""
    left = text[max(0, start - window) : start].lower()
    left = left[max((m.end() for m in _REACH.finditer(left)), default=0) :]
    if _BEFORE.search(left):
        return next(c for c in CUES_BEFORE if _EACH[c].search(left))
    right = text[end : end + window].lower()
    stop = _REACH.search(right)
    right = right[: stop.start()] if stop else right
    return next((c for c in CUES_BEHIND if _EACH[c].search(right)), None) if _BEHIND.search(right) else None


def locate(text: Column, quote: Column) -> Column:
    """Offset of the first occurrence of the trimmed quote, else of the quote with its blanks squeezed; null if neither occurs."""
    q = F.trim(quote)
    return locate_either(text, q, squeezed(q))


def squeezed(quote: Column) -> Column:
    return F.regexp_replace(quote, r"\s+", " ")


def locate_either(text: Column, q: Column, squeezed: Column) -> Column:
    """``locate`` with the trimmed and the squeezed quote given, so that a join makes them once a quote and not once a pair."""
    at = F.coalesce(F.nullif(F.instr(text, q), F.lit(0)), F.when(squeezed != q, F.nullif(F.instr(text, squeezed), F.lit(0))))
    return F.when(q != "", at - 1)


def snippet(text: Column, start: Column, end: Column, pad: int) -> Column:
    begin = F.greatest(start - pad, F.lit(0))
    return F.substring(text, begin + 1, F.least(end + pad, F.length(text)) - begin)


def quotable(license: Column) -> Column:
    return F.coalesce(F.trim(license).isin(*QUOTABLE), F.lit(False))


def gated_quote(text: Column, license: Column) -> Column:
    """The text only where its licence lets it be quoted; offsets are kept elsewhere."""
    return F.when(quotable(license), text)


def access_tier(in_archive: Column, open_access: Column, license: Column) -> Column:
    has = F.coalesce(in_archive & open_access, F.lit(False))
    return F.when(~has, "abstract_only").when(quotable(license), "full_text_quotable").otherwise("full_text_facts_only")


def split_of(number: Column, salt: str, dev_share: float = 0.5) -> Column:
    """dev or test by a salted hash; pass the salt that existing splits were made with."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), number), 256), 1, 8), 16, 10).cast("long")
    return F.when((head % 10000) / 10000 < dev_share, "dev").otherwise("test")


def curie(pmid: Column, pmcid: Column, doi: Column) -> Column:
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    tag = lambda prefix, c: F.when(c.isNotNull(), F.concat(F.lit(prefix), c))
    pmc = given(pmcid)
    return F.coalesce(tag("PMID:", given(pmid)), tag("PMCID:", pmc), tag("DOI:", given(doi)), F.lit("UNKNOWN:0"))


def locator(ev: Column) -> Column:
    """source#section with [:start-end] where both offsets are known."""
    where = F.when(ev["start_char"].isNotNull() & ev["end_char"].isNotNull(), F.concat(F.lit(":"), ev["start_char"], F.lit("-"), ev["end_char"])).otherwise("")
    return F.concat(ev["source_id"], F.lit("#"), F.coalesce(ev["section"], F.lit("unknown")), where)
