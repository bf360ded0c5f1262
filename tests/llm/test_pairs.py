import random

from caseweave.llm import distinctive, setsim, splits
from tests.conftest import rows


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_calibration():
    n, checked, r = setsim.calibrate(0.75, 16, 0.999999)
    assert (1 - ((1.75 / 2) ** 16)) ** n <= 1e-6 and r < checked // 2
    assert setsim.calibrate(1.0, 16, 0.999999) == (1, 16, 0)
    assert setsim.calibrate(0.99, 16, 0.9)[1] < setsim.CHECK_BITS  # no more bits are checked than are cut into segments
    assert setsim.segment_width(0) == setsim.segment_width(60_000) == 16 and setsim.segment_width(10**9) == 30
    assert setsim.binomial_radius(10, 0.5, 0.5) == 5


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(5)
    data = {}
    for i in range(220):
        if i and rng.random() < 0.5:
            s = set(data[f"r{rng.randrange(i)}"])  # a changed copy
            for _ in range(rng.randrange(3)):
                (s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and s else s.add(f"t{rng.randrange(60)}"))
        else:
            s = {f"t{rng.randrange(60)}" for _ in range(rng.randrange(0, 12))}
        data[f"r{i}"] = s
    listed = [(k, [*v, *list(v)[:1], None], "x") for k, v in data.items()] + [("r0", sorted(data["r0"]), "x"), ("none", None, "x")]
    df = spark.createDataFrame(listed, "id string, terms array<string>, key string")
    for threshold, least in ((0.75, 4), (0.5, 1)):
        want = {(a, b) for a in data for b in data if a < b and len(data[a]) >= least and len(data[b]) >= least and jaccard(data[a], data[b]) >= threshold}
        got = [(r["id_a"], r["id_b"]) for r in setsim.similar_pairs(df, "id", "terms", threshold, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left, right = df.filter("id < 'r2'"), df.filter("id >= 'r2'")
    got = {(r["id_left"], r["id_right"]) for r in setsim.similar_pairs_between(left, right, "id", "terms").collect()}
    assert got == {(a, b) for a in data for b in data if a < "r2" <= b and min(len(data[a]), len(data[b])) >= 4 and jaccard(data[a], data[b]) >= 0.75}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, terms array<string>")
    assert setsim.similar_pairs(df, "id", "terms").count() == 0


def test_distinctive(spark):
    df = spark.createDataFrame([("a", ["x", "y", None]), ("b", ["x"]), ("c", ["x", "y", "y"]), ("d", None), ("e", ["z", "w"])], "id string, terms array<string>")
    counts = distinctive.term_counts(df)
    stats = distinctive.collection_statistics(counts, df.selectExpr("count(*)"))
    assert {r["term"]: r["df"] for r in stats.collect()} == {"x": 3, "y": 2, "z": 1, "w": 1}
    ordered = [r["df"] for r in stats.orderBy("ridf").collect()]
    assert ordered == sorted(ordered, reverse=True)  # the residual falls with df
    extra = distinctive.term_counts(spark.createDataFrame([("h", ["x", "new"])], "id string, terms array<string>"))
    best = distinctive.most_distinctive(distinctive.distinctiveness(counts.unionByName(extra), stats), "key")
    assert rows(best.select("key", "term")) == [("a", "y"), ("b", "x"), ("c", "y"), ("e", "w"), ("e", "z"), ("h", "new")]
    again = distinctive.collection_statistics(distinctive.term_counts(df, repeats=True), df.selectExpr("count(*)"))
    assert {r["term"]: (r["df"], r["cf"]) for r in again.collect()}["y"] == (2, 3)
    residual = {r["term"]: r["ridf"] for r in again.collect()}
    assert residual["y"] > {r["term"]: r["ridf"] for r in stats.collect()}["y"]  # piled up in a record
    none = df.filter("false")
    assert distinctive.collection_statistics(distinctive.term_counts(none), none.selectExpr("count(*)")).count() == 0


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(80):
        t = [rng.choice(words) for _ in range(rng.randrange(10, 60))]
        if texts and rng.random() < 0.6:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t)
    side = [rng.choice(["train", " Dev", "TEST ", None, "other"]) for _ in texts]
    pmid = [rng.choice([None, "", "0", "PMID: 007", "7", "12", "x"]) for _ in texts]
    from datetime import datetime as T

    data = [(i, pmid[i], side[i], "src", " ".join(t).upper(), T(2020, 1, 1), 1) for i, t in enumerate(texts)] + [(1000, None, "train", None, None, None, 1)]
    df = spark.createDataFrame(data + data[:5], "paper_id long, pmid string, split string, source string, abstract string, loaded_at timestamp, id int")
    grams = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} if len(t) >= 20 else None for t in texts]
    number = {"PMID: 007": 7, "7": 7, "12": 12}
    clean = [s.strip().lower() if s else None for s in side]
    want = set()
    for e in range(len(texts)):
        for t in range(len(texts)):
            if clean[e] in ("dev", "test") and clean[t] == "train":
                same = pmid[e] in number and number[pmid[e]] == number.get(pmid[t])
                near = grams[e] and grams[t] and jaccard(grams[e], grams[t]) >= 0.7
                if same or near:
                    want.add((e, t))
    found = splits.overlaps(df)
    got = [(r["eval_id"], r["train_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = splits.overlap_report(splits.latest(df), found).collect()
    assert sum(r["n_overlapping"] for r in report) == len({e for e, _ in want})
    assert splits.overlaps(df.filter("false")).count() == 0


def test_report_of_a_moved_paper(spark):
    from datetime import datetime as T

    text = " ".join(f"w{i}" for i in range(30))
    data = [(1, "5", "dev", "old", text, T(2020, 1, 1)), (1, "5", "test", "new", text, T(2021, 1, 1)), (2, None, "train", "s", text, T(2020, 1, 1)), (3, None, "dev", None, None, None)]
    df = spark.createDataFrame(data, "paper_id long, pmid string, split string, source string, abstract string, loaded_at timestamp")
    last = splits.latest(df)
    assert rows(splits.overlap_report(last, splits.overlaps_of(last))) == [("dev", "unknown", 1, 0), ("test", "new", 1, 1)]


def test_scan_with_few_counters(spark, monkeypatch):
    """All n-grams share two counters: nothing is lost."""
    rng = random.Random(9)
    monkeypatch.setattr(splits, "MIN_BITS", 1)
    monkeypatch.setattr(splits, "MAX_BITS", 1)
    base = [rng.choice("abcdefgh") * 2 + str(rng.randrange(50)) for _ in range(40)]
    texts = [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in range(6)] + [" ".join(rng.sample(base, 40)) for _ in range(6)]
    df = spark.createDataFrame([(i, "eval" if i % 2 else "train", t) for i, t in enumerate(texts)], "id long, side string, text string")
    grams = [{tuple(t.split()[k : k + 3]) for k in range(38)} for t in texts]
    want = {(e, t) for e in range(1, 12, 2) for t in range(0, 12, 2) if jaccard(grams[e], grams[t]) >= 0.7}
    assert {(r["eval_id"], r["train_id"]) for r in splits.text_overlaps(df).collect()} == want and want


def test_overlaps_in_passes(spark, monkeypatch):
    """Several passes, sets beyond what vectors tell apart, small slices and many repeated ids change nothing."""
    from datetime import datetime as T

    rng = random.Random(12)
    pool = [[rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(6)] for _ in range(40)]
    texts = []
    for _ in range(120):
        t = [w for _ in range(rng.randrange(3, 9)) for w in rng.choice(pool)]
        if texts and rng.random() < 0.5:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = "new"
        texts.append(t)
    data = [(i, None, rng.choice(["train", "dev"]), ", ".join(t), T(2021, 1, 1)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data + [(i, None, "test", " ".join(texts[0]), T(2020, 1, 1)) for i in range(0, 120, 3)], "paper_id long, pmid string, split string, abstract string, loaded_at timestamp")
    grams = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} if len(t) >= 20 else None for t in texts]
    want = {(e[0], t[0]) for e in data for t in data if (e[2], t[2]) == ("dev", "train") and grams[e[0]] and grams[t[0]] and jaccard(grams[e[0]], grams[t[0]]) >= 0.7}
    for name, value in (("PASS_ROWS", 1), ("PLAIN", 20), ("SLICE", 500), ("LISTED", 0)):
        monkeypatch.setattr(splits, name, value)
        assert {(r["eval_id"], r["train_id"]) for r in splits.overlaps(df).collect()} == want and want


def test_words():
    texts = [None, "", "A-b_c\x00d\x1ce\x85f\ng ΑΣ ΑΣΑ\nΣ", "İstanbul, ½ ² ٣٤ naïve éx 中文字", "ไทย – ß.x﻿y"]
    for more in ([], ["".join(map(chr, range(0x2000, 0x2400)))]):
        assert splits.words_of(texts + more) == [splits.WORD.findall(t.lower()) if t else [] for t in texts + more]


def test_disk_of_overlaps(spark, tmp_path):
    """Shuffle files and tables of a run stay below four times its input."""
    import threading
    from pathlib import Path

    from caseweave import session

    rng = random.Random(4)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(3000)]
    pool = [" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(20000)]
    data = [(i, None, rng.choice(["train", "train", "dev"]), " ".join(rng.choice(pool) for _ in range(8)), None) for i in range(20000)]
    path = str(tmp_path / "papers.parquet")
    spark.createDataFrame(data, "paper_id long, pmid string, split string, abstract string, loaded_at timestamp").coalesce(4).write.parquet(path)
    del data
    spark._jvm.System.gc()
    places = [session._tables_folder(spark).removeprefix("file:"), *spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def size() -> int:
        total = 0
        for p in (p for place in places for p in Path(place).rglob("*")):
            try:
                total += p.stat().st_size if p.is_file() else 0
            except OSError:
                pass
        return total

    before, most, over = size(), [0], threading.Event()

    def watch() -> None:
        while not over.wait(0.1):
            most[0] = max(most[0], size())

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        splits.overlaps(spark.read.parquet(path)).count()
    finally:
        over.set()
        thread.join()
    given = sum(p.stat().st_size for p in Path(path).glob("*.parquet"))
    assert max(most[0], size()) - before < 4 * given, ((most[0] - before) / given, given)
