import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseweave.llm import sentences, spans, tokenise
from tests.conftest import rows

CASES = [
    ("Dr. Smith came at 7 a.m. with pain. He left.", ["Dr. Smith came at 7 a.m. with pain.", "He left."]),
    ("It was 3.5 mg, cf. 7.1 nM, etc. The end.", ["It was 3.5 mg, cf. 7.1 nM, etc.", "The end."]),
    ('The aunt said, "It began. Nobody believed us!" and left. "It hurts." He weighed 3 kg.', ['The aunt said, "It began. Nobody believed us!" and left.', '"It hurts."', "He weighed 3 kg."]),
    ("(See Table 8, p. 37.) Blood was drawn. [None of it.] Next.", ["(See Table 8, p. 37.)", "Blood was drawn.", "[None of it.]", "Next."]),
    ("Heading\n\nText goes\non here. More", ["Heading", "Text goes\non here.", "More"]),
    ("A | b | 1\nC | d | 2\r\n\r\nAfter.", ["A | b | 1", "C | d | 2", "After."]),
    ("One was seen.Two were not.", ["One was seen.", "Two were not."]),
    ("The change c.12A>G (p.Ile4Arg) was found. pH was 7.1. c.3A>T too.", ["The change c.12A>G (p.Ile4Arg) was found.", "pH was 7.1.", "c.3A>T too."]),
    ("„Es tut weh. Seit 30 Wochen!“, sagte sie. Der 39. Schub kam am 4. März, z. B. früh.", ["„Es tut weh. Seit 30 Wochen!“, sagte sie.", "Der 39. Schub kam am 4. März, z. B. früh."]),
    ("«\xa0La douleur revient. Elle dure.\xa0», disait-elle. Pourquoi\xa0? Bien.", ["«\xa0La douleur revient. Elle dure.\xa0», disait-elle.", "Pourquoi\xa0?", "Bien."]),
    ("母亲说：“30周前开始的。没有人相信！”随后出示了照片。步态……不稳。", ["母亲说：“30周前开始的。没有人相信！”随后出示了照片。", "步态……不稳。"]),
    ("“会扩散吗？”患者问道。为什么？", ["“会扩散吗？”患者问道。", "为什么？"]),
    ("यह हुआ। क्या असर? डॉ. Rao ने कहा।", ["यह हुआ।", "क्या असर?", "डॉ. Rao ने कहา।".replace("า", "ा")]),
    ("อาการปวด ค่า 5.2 mg สูง พบใน", ["อาการปวด", "ค่า 5.2 mg สูง", "พบใน"]),
    ("An open (bracket. And more. \"Quote.", ["An open (bracket.", "And more.", '"Quote.']),
    ("The gait was... uneven. Really?! Yes.", ["The gait was... uneven.", "Really?!", "Yes."]),
    ("อายุ ๕๒ ปี มีอาการ", ["อายุ ๕๒ ปี", "มีอาการ"]),
    ("Findings:\n1. Ptosis was seen.\n2. Fits.\na. Focal.\nb. Others.\n3. Ataxia.", ["Findings:\n1. Ptosis was seen.", "2. Fits.", "a. Focal.", "b. Others.", "3. Ataxia."]),
    ("He was in grade\n7. Then he left.", ["He was in grade\n7.", "Then he left."]),
    ("", []), ("  \n\t ", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_units(text, want):
    assert [text[a:b] for a, b in sentences.units(text)] == want


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab AB1.!?\"“”„«»()[]。「」\n\r|กข \xa0", max_size=60))
def test_units_cover(text):
    last = 0
    for a, b in sentences.units(text):
        assert text[last:a].strip() == "" and a < b and text[a:b] == text[a:b].strip()
        last = b
    assert text[last:].strip() == ""


@pytest.mark.parametrize("text", ["(" * 50_000 + "]" * 50_000, "(" * 8000 + ")" * 8000 + "»" * 8000, "… " * 50_000, "a." * 50_000, "fig.((((" * 15_000, "x" * 300_000 + "." + "y" * 300_000, "1.\n" * 30_000, "'\" " * 40_000])
def test_hostile_texts_take_linear_time(text):
    import time

    began = time.process_time()
    sentences.units(text)
    assert time.process_time() - began < 2


def test_sentences_frame(spark):
    df = spark.createDataFrame([(1, "One. Two.", "k"), (2, None, "k"), (3, "", "k"), (4, "x" * 100_000 + ". B.", "k")], "doc_id long, text string, start_char string")
    found = sentences.sentences(df)
    assert rows(found) == [(1, 0, 4), (1, 5, 9), (4, 0, 100_001), (4, 100_002, 100_004)]
    assert {r["unit"] for r in sentences.with_text(df.filter("doc_id = 1"), found).collect()} == {"One.", "Two."}
    assert sentences.sentences(df.filter("false")).count() == 0


needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenise.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    raw = open(tokenise.VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
    return tokenise.Bpe(raw), tiktoken.Encoding("t", pat_str=tokenise.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_bpe_matches(both, text):
    own, other = both
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text) and own.decode(ids) == text and own.count(text) == len(ids)


@needs_vocabulary
def test_bpe_long_and_repeated(both):
    own, other = both
    for text in ("a" * 5000, "ab" * 3000, "ย" * 500, "<|endoftext|> x", " \n\t  y" * 50):
        assert own.encode(text) == other.encode_ordinary(text)


@needs_vocabulary
def test_encode_frame(spark, both):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (1, "Hello world", 9)], "doc_id long, text string, ids int")
    assert rows(tokenise.encode(df)) == sorted([(1, both[1].encode_ordinary("Hello world"))] * 2 + [(2, []), (3, [])], key=repr)
    assert tokenise.encode(df.filter("false")).count() == 0
    assert rows(tokenise.token_counts(df, "doc_id", "text", "ids"))[-1] == (3, 9, 0)


def brute(texts, n):
    grams = {i: {t[k : k + n] for k in range(len(t) - n + 1)} for i, t in texts.items() if t}
    return {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}


def covered(i, texts, n):
    t = texts[i]
    others = {o[k : k + n] for j, o in texts.items() if j != i and o for k in range(len(o) - n + 1)}
    mark = [False] * len(t)
    for k in range(len(t) - n + 1):
        if t[k : k + n] in others:
            mark[k : k + n] = [True] * n
    return sum(mark)


@pytest.mark.parametrize("hot,at_once", [(spans.HOT, spans.AT_ONCE), (1, 1), (5, 3)])
def test_spans_against_brute_force(spark, monkeypatch, hot, at_once):
    """Ordinary anchors, hot ones by their windows, and both with blocks parsed a few at a time."""
    import random

    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "AT_ONCE", at_once)
    rng = random.Random(11)
    chars = "abc🙂é "
    pool = ["".join(rng.choice(chars) for _ in range(rng.randrange(15, 60))) for _ in range(12)]
    texts = {i: "".join(rng.choice([rng.choice(pool), "".join(rng.choice(chars) for _ in range(10))]) for _ in range(rng.randrange(1, 5))) for i in range(1, 60)}
    texts |= {60: None, 61: "", 62: "z" * 200, 63: "z" * 50, 64: texts[1], 65: texts[1]}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(1, texts[1], 0)], "doc_id long, text string, size int")
    for n in (20, 31):
        s = spans.SharedSpans(df, n)
        got = rows(s.pairs())
        assert len(got) == len(set(got)) and set(got) == brute(texts, n)
        shares = {r["doc_id"]: r["shared_chars"] for r in s.shares().collect()}
        assert shares == {i: c for i in texts if texts[i] and (c := covered(i, texts, n))}
    assert spans.SharedSpans(df.filter("false"), 20).pairs().count() == 0


def test_an_id_with_two_texts(spark):
    a, b = "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"
    df = spark.createDataFrame([(1, a), (1, b), (2, "--" + a), (3, "++" + b)], "doc_id long, text string")
    assert rows(spans.SharedSpans(df, 20).pairs()) == [(1, 2), (1, 3)]


def test_parsing_blocks():
    import numpy as np

    one, two, three = "xx" + "abcdefgh" + "yy", "-abcdefgh-", "12345678"
    p = spans.Parsed(np.array([5, 5, 5]), np.array([0, 1, 2]), [one, two, three], 8)
    assert sorted(p.factors) == [(0, 2, 8), (1, 1, 8)]
    assert [(a.tolist(), b.tolist()) for a, b in p.pairs()] == [([0], [1])]
    alone = spans.Parsed(np.array([5, 6]), np.array([0, 1]), [one, two], 8)  # other anchors
    assert alone.factors == [] and list(alone.pairs()) == []


def test_long_periodic_texts(spark):
    """Every place of a text that repeats itself is an anchor; equal blocks are kept once."""
    z, ab = "z" * 60_000, "ab" * 30_000
    texts = {1: z + "a", 2: "b" + z, 3: ab, 4: "x" + ab[: 299], 5: "q" * 299, 6: "q" * 400}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    s = spans.SharedSpans(df, 300)
    assert rows(s.pairs()) == [(1, 2)]
    assert {r["doc_id"]: r["shared_chars"] for r in s.shares().collect()} == {1: 60_000, 2: 60_000}
