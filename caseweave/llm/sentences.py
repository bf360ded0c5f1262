"""Sentence units of whole texts in any language, with offsets.

A text falls into blocks at blank lines; each line of a table (cells set off by `` | ``) is a block of its own. Over a
block runs a pushdown automaton whose input are the characters that can matter: stops, quotation marks, brackets, and
spaces between letters of scripts that end sentences with them. It keeps a stack of open quotations and brackets; an
opener that is never closed in its block counts as an ordinary character. Only outside of all quotations and brackets
may a sentence end:

* at a stop of a script that uses it for nothing else (``。！？।`` and so on), and at ``!`` and ``?``;
* at a full stop, unless it belongs to a number, an initial, a list number, a day or ordinal (after an article), or to
  an abbreviation found in a trie; abbreviations that may end a sentence do so if what follows looks like a beginning;
  list numbers are those at the start of a unit and, at the start of a line, those that go on with an open list or begin
  one (the levels of open lists are kept on a stack: 1., 2., then a., b. or 1.1. within, then 3.);
* at an ellipsis only before a beginning;
* behind a closing quotation mark or bracket that closes what began with the sentence, or a quotation, if a stop stands
  just inside and a beginning follows;
* in Thai, Lao, Khmer and Burmese at a space between two letters of the script.

A beginning is an upper-case letter, a digit, an opening mark, a letter without case, or a word like ``pH`` or
``c.12A>G`` that starts small but holds capitals or digits. A stop may lack the space behind it before a capital. The
language column is not used. The work is linear in the length of a text, whatever it holds: what lies ahead of a stop is
looked up once, an opener is pushed and popped once.

Defined cases: null, empty and blank texts give no unit; offsets count code points of the text as stored; units are
trimmed, do not overlap, and hold all that is not white space; repeated rows of a document are cut once per row unless
made distinct before; empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on.
INSIDE = """
cf i.e e.g viz max min ref refs fig figs p pp dr drs prof mr mrs ms st no nos nr chr v vs approx ca bldg rm pop suppl vol ed eds
tab sec ch eq dept univ inc a.m b.i.d t.i.d q.d
vgl abb tab s az z u d geb bzw mind ggf evtl bspw inkl z.b u.a d.h o.g sog st str
c.-à-d p.ex env n m mme mlle mm
núm aprox pág págs sr sra srta dra tabl ej izq dcha p.ej
पृ डॉ श्री
""".split()
#: Abbreviations that may end a sentence.
ENDING = "al etc usw p.m ff f yrs yr ltd co corp jr sr. u.s ph.d m.d j d.c b.c a.d resp".split()
#: Words before a German ordinal or day.
ARTICLES = frozenset("der die das dem den des im am vom zum zur beim ab bis ins jeder jedem jeden".split())
OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉"}
CLOSERS = {c: o for o, c in OPENERS.items()}
QUOTES = "\"“”„«»‹›＂"
STOPS = ".!?…。！？।॥｡．؟۔።"
#: Letters of Thai, Lao, Burmese and Khmer; their digits are numbers.
SPACED = "\u0e00-\u0e4f\u0e5a-\u0e7f\u0e80-\u0ecf\u0eda-\u0eff\u1000-\u103f\u104a-\u108f\u109a-\u109f\u1780-\u17df\u17ea-\u17ff"
LINE_ENDS = r"\r\n\x0b\x0c\x85\u2028\u2029"
LINE = rf"(?>\r\n|[{LINE_ENDS}])"
BLANK = re.compile(rf"[{LINE_ENDS}](?:(?<=\r)\n)?+(?:(?<= )\s*|[^\S{LINE_ENDS}]*(?:{LINE}\s*)+)")
LINES = re.compile(LINE)
CELL = re.compile(r"\s\|\s")
ANY_LINE_END = re.compile(f"[{LINE_ENDS}]")
#: The label of a list item at the start of a line: 3., 2.1. or b., and the stop behind it.
ITEM = re.compile(rf"(?:\A|(?<=[{LINE_ENDS}]))[^\S{LINE_ENDS}]*((?:\d{{1,3}}\.)*\d{{1,3}}|[a-z])\.(?=\s)")
MARKS = QUOTES + "".join(OPENERS) + "".join(CLOSERS)
#: One character a match, so that the search is over a single set; a full stop before a digit is part of a number.
EVENT = re.compile(rf"[{re.escape(STOPS + MARKS)}](?!(?<=\.)\d)")
SPACED_EVENT = re.compile(rf"[{re.escape(STOPS + MARKS)}](?!(?<=\.)\d)|(?<=[{SPACED}])\s+(?=[{SPACED}])")
HAS_SPACED = re.compile(f"[{SPACED}]")
_OPEN_MARKS = frozenset("\"“„«‹「『《〈([{（【〔¿¡‘")
_FINAL, _MARKS = frozenset(STOPS), frozenset(MARKS)
_CLAUSE = frozenset(",;:，；：、)]}）】〕」』》〉»›”")
_WRAP = frozenset("([{\"'“„«‹¿¡（")
#: What each mark may close; marks that never open if they close nothing.
_CLOSES = {**CLOSERS, '"': '"', "＂": "＂", "“": "„", "”": "“„”", "»": "«", "›": "‹", "«": "»", "‹": "›"}
_ONE_WAY = frozenset("".join(CLOSERS) + "”")


#: Second halves of abbreviations written apart.
_SECOND = {"h": "d.", "a": "u.", "b": "z.", "ä": "o.", "ex": "p.", "ej": "p."}


class Trie:
    def __init__(self, words: dict[str, str]):
        self.root: dict[str, Any] = {}
        for word, value in words.items():
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = value

    def get(self, word: str) -> str | None:
        node = self.root
        for ch in word:
            node = node.get(ch)
            if node is None:
                return None
        return node.get("")


ABBREVIATIONS = Trie({**dict.fromkeys(ENDING, "ending"), **dict.fromkeys(INSIDE, "inside")})
_LONGEST = max(map(len, (*ENDING, *INSIDE, *ARTICLES)))


class Ahead:
    """What lies ahead in ``text[first:end]``, each stretch scanned once however often it is asked for."""

    def __init__(self, text: str, end: int):
        self.text, self.end = text, end
        self._told = (0, -1, "")  # from, to, answer
        self._word = (0, -1, "")

    def begins(self, at: int) -> str:
        """What stands at ``at``: 'upper', 'digit', 'open', 'caseless', 'mixed' (a small start with capitals or digits), 'lower' or ''."""
        if self._told[0] <= at <= self._told[1]:
            return self._told[2]
        text, end, i, kind = self.text, self.end, at, ""
        while i < end:
            ch = text[i]
            if ch.isalpha():
                kind = "upper" if ch.isupper() or ch.istitle() else "caseless" if not ch.islower() else "mixed" if "α" <= ch <= "ω" else self.small(i)
                break
            if ch.isdigit():
                kind = "digit"
                break
            if ch in _OPEN_MARKS:
                kind = "open"
                break
            i += 1
        self._told = (at, i, kind)
        return kind

    def begins_at(self, at: int) -> str:
        """As ``begins``, of the one character at ``at``."""
        ch = self.text[at]
        if ch.isalpha():
            return "upper" if ch.isupper() or ch.istitle() else "caseless" if not ch.islower() else "mixed" if "α" <= ch <= "ω" else "lower"
        return "digit" if ch.isdigit() else "open" if ch in _OPEN_MARKS else ""

    def small(self, at: int) -> str:
        """Whether the word of a small letter holds capitals or digits: 'mixed' or 'lower'."""
        if self._word[0] <= at < self._word[1]:
            return self._word[2]
        text, end, i = self.text, self.end, at + 1
        while i < end and not text[i].isspace() and not (text[i].isupper() or text[i].isdigit()):
            i += 1
        kind = "mixed" if i < end and not text[i].isspace() else "lower"
        self._word = (at, i, kind)
        return kind


class Behind:
    """The words behind a place in ``text``, not before ``first``; letters passed on the way to one stop are not passed again for the next."""

    def __init__(self, text: str, first: int):
        self.text, self.first = text, first
        self._last = (-1, first)  # a place and the start of the word that ends there
        self._bare = (-1, -1)

    def word(self, at: int) -> int:
        """The start of the word that ends at ``at``; places must rise from call to call."""
        text, i, (known, start) = self.text, at, self._last
        while i > self.first and i != known and not text[i - 1].isspace():
            i -= 1
        if i == known and i > self.first:
            i = start
        self._last = (at, i)
        return i

    def bare(self, start: int, at: int) -> int:
        """The start of the word without opening marks."""
        if self._bare[0] != start:
            i = start
            while i < at and self.text[i] in _WRAP:
                i += 1
            self._bare = (start, i)
        return min(at, self._bare[1])

    def before(self, start: int, least: int) -> str:
        """The word before the one that begins at ``start``, '' if there is none behind ``least``; of a longer word than any listed one its end."""
        text, stop = self.text, start
        while stop > least and text[stop - 1].isspace():
            stop -= 1
        i = stop
        while i > least and stop - i <= _LONGEST and not text[i - 1].isspace():
            i -= 1
        return text[i:stop]


def _outermost(text: str, marks: list[int]) -> list[tuple[int, int]]:
    """The outermost matched pairs of marks, as positions; the stack of the automaton.

    A closer pops down to its opener; how many openers of each kind are open is counted, so one without any costs nothing.
    """
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    open_: Counter[str] = Counter()

    def push(ch: str, at: int) -> None:
        stack.append((ch, at))
        open_[ch] += 1

    def close(kinds: str, at: int) -> bool:
        if not any(open_[k] for k in kinds):
            return False
        while True:
            ch, begin = stack.pop()
            open_[ch] -= 1
            if ch in kinds:
                break
        while pairs and pairs[-1][0] > begin:
            pairs.pop()
        pairs.append((begin, at))
        return True

    for at in marks:
        ch = text[at]
        kinds = _CLOSES.get(ch)
        if kinds is None or not close(kinds, at) and ch not in _ONE_WAY:
            push(ch, at)
    return pairs


def list_labels(text: str, first: int, end: int) -> frozenset[int]:
    """Places of the full stops behind list labels within a block.

    The stack holds the last label of every open level. A label at the start of a line counts if it begins a level (1, a,
    or the one above with .1), or is next after the last one of an open level; what is open below that level is closed.
    """
    found: list[int] = []
    stack: list[tuple[int | str, ...]] = []  # the label that would be next, of every open level
    open_: dict[tuple[int | str, ...], list[int]] = {}  # its levels, by that label
    last: tuple[int | str, ...] = ()
    for m in ITEM.finditer(text, first, end):
        label = tuple(int(x) if x.isdigit() else x for x in m[1].split("."))
        if open_.get(label):
            depth = open_[label][-1]
            while len(stack) > depth:
                open_[stack.pop()].pop()
        elif not (label in ((1,), ("a",)) or stack and label == (*last, 1)):
            continue
        last = label
        open_.setdefault(_next_label(label), []).append(len(stack))
        stack.append(_next_label(label))
        found.append(m.end() - 1)
    return frozenset(found)


def _next_label(label: tuple[int | str, ...]) -> tuple[int | str, ...]:
    last = label[-1]
    return (*label[:-1], last + 1 if isinstance(last, int) else chr(ord(last) + 1))


def _full_stop_ends(text: str, first: int, at: int, nxt: int, ahead: Ahead, behind: Behind) -> bool:
    """Whether the full stop at ``at`` ends the unit that begins at ``first``; ``nxt`` is the next character that is no space."""
    gap = nxt > at + 1
    start = max(behind.word(at), first)
    bare = behind.bare(start, at)
    if bare >= at:
        return gap or text[nxt : nxt + 1].isupper()
    size = at - bare
    token = text[bare:at].lower() if size <= _LONGEST else ""  # a longer one is no abbreviation, number or initial
    kind = ABBREVIATIONS.get(token) if token else None
    if kind == "inside" or token == "a" or (token in _SECOND and behind.before(start, first).lower() == _SECOND[token]):
        return False
    if not gap:
        if not (text[nxt].isupper() or text[nxt] in "¿¡"):
            return False
        return size > 1 and text.rfind(".", max(bare, at - _LONGEST), at) < 0
    if kind == "ending":
        return token != "j" and ahead.begins(nxt) in ("upper", "digit", "open", "mixed")
    if size == 1 and token.isalpha() and text[at - 1].isupper():
        return False  # an initial
    if token.isdigit() and size <= 3:
        before = behind.before(start, first) if start > first else ""
        if not before and not text[first:start].strip():
            return False  # the number of a list item or heading
        if size <= 2 and before.lower() in ARTICLES:
            return False
    return True


def cut_block(text: str, first: int, end: int, out: list[tuple[int, int]], spaced: bool = False) -> None:
    """Appends the trimmed units of ``text[first:end]``."""

    def emit(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    ahead, behind = Ahead(text, end), Behind(text, first)
    labels = list_labels(text, first, end) if ANY_LINE_END.search(text, first, end) else frozenset()
    events = [m.start() for m in (SPACED_EVENT if spaced else EVENT).finditer(text, first, end)]
    marks = [at for at in events if text[at] in _MARKS]
    pairs = _outermost(text, marks) if marks else []
    k, unit, done = 0, first, first
    for at in events:
        if at < done:
            continue  # within a run of stops or spaces
        to = at + 1
        while k < len(pairs) and pairs[k][1] < at:
            k += 1
        if k < len(pairs) and pairs[k][0] <= at < pairs[k][1]:
            continue
        ch = text[at]
        if ch in _FINAL:
            while to < end and text[to] in _FINAL:
                to += 1
            done = to
        nxt = to
        while nxt < end and text[nxt].isspace():
            nxt += 1
        if nxt >= end:
            break
        gap = nxt > to
        if ch.isspace():
            ends = True
            to, done = at, nxt
        elif ch in _FINAL:
            follow = text[nxt]
            if not gap and follow in _CLAUSE or follow in ",;，；":
                continue
            run = text[at:to]
            if run.strip(".…") == "":
                if run == ".":
                    ends = at not in labels and _full_stop_ends(text, unit, at, nxt, ahead, behind)
                else:
                    ends = gap and ahead.begins(nxt) in ("upper", "open", "mixed", "digit")
            elif run[-1] in "!?" or run[-1] in "؟":
                ends = gap or follow in _OPEN_MARKS or ahead.begins_at(nxt) in ("upper", "caseless")
            else:
                ends = True
        elif k < len(pairs) and at == pairs[k][1]:
            opened = pairs[k][0]
            inner = at - 1
            while inner > opened and text[inner].isspace():
                inner -= 1
            if text[inner] not in _FINAL:
                continue
            whole = not text[unit:opened].strip(" \t\r\n\xa0¿¡")
            follow = text[nxt]
            if follow in _FINAL or follow in _CLAUSE:
                continue
            begin = ahead.begins(nxt) if gap else ahead.begins_at(nxt)
            if ch in CLOSERS and ch not in "」』》〉":
                ends = whole and (gap or begin in ("upper", "open"))
            elif whole:
                ends = begin in ("upper", "open") or gap and begin in ("digit", "mixed", "caseless")
            else:
                ends = gap and begin in ("upper", "open", "mixed")
        else:
            continue
        if ends:
            emit(unit, to)
            unit = to
    emit(unit, end)


def units(text: str) -> list[tuple[int, int]]:
    """Half-open offsets of the sentence units of ``text``."""
    out: list[tuple[int, int]] = []
    at = 0
    spaced = HAS_SPACED.search(text) is not None
    cells = "|" in text
    borders = [(m.start(), m.end()) for m in BLANK.finditer(text)]
    for stop, resume in [*borders, (len(text), len(text))]:
        if at < stop:
            if not cells or CELL.search(text, at, stop) is None:
                cut_block(text, at, stop, out, spaced)
            else:
                _cut_lines(text, at, stop, out, spaced)
        at = resume
    return out


def _cut_lines(text: str, first: int, end: int, out: list[tuple[int, int]], spaced: bool) -> None:
    """A block with table lines: each of them is a unit, the lines between are cut as usual."""
    begin, line = first, first
    for stop, resume in [*((m.start(), m.end()) for m in LINES.finditer(text, first, end)), (end, end)]:
        if CELL.search(text, line, stop):
            if begin < line:
                cut_block(text, begin, line, out, spaced)
            a, b = line, stop
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            begin = resume
        line = resume
    if begin < end:
        cut_block(text, begin, end, out, spaced)


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_char, end_char) of every unit of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[int] = []
                starts: list[int] = []
                ends: list[int] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if text:
                        found = units(text)
                        rows.extend([i] * len(found))
                        starts.extend(a for a, _ in found)
                        ends.extend(b for _, b in found)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[id_col, "start_char", "end_char"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, start_char bigint, end_char bigint")


def with_text(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``found`` with the text of every unit."""
    return found.join(df.select(id_col, text_col), id_col).select(*found.columns, F.substring(text_col, F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int")).alias("unit"))
