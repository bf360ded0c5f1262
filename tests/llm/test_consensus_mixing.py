import os
import random
from collections import Counter
from datetime import datetime as T

import numpy as np
import pytest

from caseweave.llm import consensus, mixing, tokenise
from tests.conftest import rows

VOTES = "vote_id long, item_id long, extractor string, vote string, voted_at timestamp, y int"


def test_consensus_beats_majority(spark):
    rng = random.Random(2)
    truth = {i: rng.choice([0, 0, 0, 1, 1, 2]) for i in range(300)}
    quality = {f"good{i}": 0.9 for i in range(3)} | {f"poor{i}": 0.34 for i in range(4)} | {"swap": None}
    data = []
    for i, t in truth.items():
        for who in rng.sample(sorted(quality), 5):
            y = t if quality[who] is None or rng.random() < quality[who] else rng.choice([0, 1, 2])
            if quality[who] is None:
                y = {0: 1, 1: 0, 2: 2}[y]
            data.append((len(data), i, who, [" Present", "EXCLUDED ", "not_stated"][y], T(2024, 1, 1), 1))
    data.append((9999, 0, "good0", None, T(2025, 1, 1), 1))
    data.append((9998, 777, "good0", " ", T(2025, 1, 1), 1))
    c = consensus.Consensus(spark.createDataFrame(data, VOTES))
    got = {r["item_id"]: r for r in c.items.collect()}
    right = sum(got[i]["label"] == consensus.CLASSES[t] for i, t in truth.items())
    plain = 0
    for i, t in truth.items():
        n = Counter(r[3].strip().lower() for r in data if r[1] == i and r[3])
        plain += n.most_common(1)[0][0] == consensus.CLASSES[t]
    assert right > plain and right > 0.85 * len(truth)
    assert got[777]["label"] == "present" and got[777]["agreement"] is None and got[777]["n_votes"] == 0
    trust = {r["extractor"]: r["reliability"] for r in c.annotators.collect()}
    assert min(trust[f"good{i}"] for i in range(3)) > max(trust[f"poor{i}"] for i in range(4)) and trust["swap"] < min(trust[f"good{i}"] for i in range(3))
    assert c.converged and 1 < c.rounds < 100


def _random_votes(spark, n_items=60):
    rng = random.Random(8)
    data = [(n, n % n_items, f"a{rng.randrange(7)}", rng.choice(["present", "present", "excluded", "not_stated", None]), T(2024, 1, 1 + n % 20), 0) for n in range(n_items * 4)]
    return spark.createDataFrame(data + [(9000, 500, "a1", None, None, 0), (9001, 501, "lone", "present", None, 0)], VOTES)


def test_both_ways_agree(spark, monkeypatch):
    df = _random_votes(spark)
    packed = consensus.Consensus(df)
    monkeypatch.setattr(consensus, "MAX_ANNOTATORS", 2)
    wide = consensus.Consensus(df)
    assert (packed.rounds, packed.converged) == (wide.rounds, wide.converged)
    assert rows(packed.items) == rows(wide.items) and rows(packed.annotators) == rows(wide.annotators)
    assert {r["extractor"]: r["reliability"] for r in wide.annotators.collect()}["lone"] is None


def test_unfinished_rounds_are_told(spark):
    with pytest.warns(RuntimeWarning, match="still moved"):
        c = consensus.Consensus(_random_votes(spark), tolerance=1e-12, max_rounds=2)
    assert not c.converged and c.rounds == 2


def test_reliability_leaves_out_the_own_vote(spark):
    """One item, two annotators who contradict each other: neither is believed because of its own vote."""
    df = spark.createDataFrame([(1, 1, "a", "present", None, 0), (2, 1, "b", "excluded", None, 0)], VOTES)
    assert all(r["reliability"] < 0.6 for r in consensus.Consensus(df).annotators.collect())


def test_consensus_counting_votes(spark):
    data = [(1, 1, "a", "present", T(2024, 1, 1), 0), (2, 1, "a", "excluded", T(2024, 1, 2), 0), (3, 1, "a", None, T(2024, 1, 3), 0), (4, 1, None, "present", None, 0), (5, None, "a", "present", None, 0), (2, 1, "a", "excluded", T(2024, 1, 2), 0)]
    df = spark.createDataFrame(data, VOTES)
    assert rows(consensus.votes(df).filter("y IS NOT NULL")) == [(1, "a", 1)]
    assert rows(consensus.Consensus(df).items) == [(1, "excluded", 1.0, 1)]
    assert consensus.Consensus(df.filter("false")).items.count() == 0


def test_tree():
    quotas, rng = np.array([1700, 0, 5]), random.Random(1)
    draws = [(i, k) for i, q in enumerate(quotas) for k in range(q)]
    src, at = np.array(draws).T
    shard = mixing.shards_of(src, at, quotas, 13, 3)
    assert (np.bincount(shard) >= 130).all() and len(np.bincount(shard)) == 13
    assert (np.diff(shard[src == 0]) >= 0).all()  # a shard takes a run of the draws
    some = rng.sample(range(len(draws)), 40)
    assert (mixing.shards_of(src[some], at[some], quotas, 13, 3) == shard[some]).all()  # whatever else a task has


def test_places_permute():
    for n in (1, 2, 5, 64, 1000):
        one = [mixing.places(np.arange(n), np.full(n, c), np.zeros(n), np.full(n, n), 7) for c in (0, 1)]
        assert all(sorted(x) == list(range(n)) for x in one) and (n < 5 or (one[0] != one[1]).any())


def test_huge_nodes():
    got = mixing.split_node(np.array([3 * 10**9, 10**9]), 1, 4, np.random.default_rng(1))
    assert got.sum() == 10**9 and abs(got[0] - 7.5e8) < 1e6


@pytest.mark.skipif(not os.path.exists(tokenise.VOCABULARY), reason="no vocabulary")
def test_many_blocks_and_shards(spark):
    """Thousands of blocks a source, hundreds of shards: each shard has every source, near its share."""
    rng = random.Random(6)
    docs = [(i, rng.choice("abc"), " word" * rng.randrange(1, 9)) for i in range(30_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 4), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeat int")
    got = mixing.mix(df, targets, block_tokens=10, shard_tokens=3000).groupBy("shard", "source").agg({"n_tokens": "sum"}).collect()
    n_shards = len({r["shard"] for r in got})
    assert n_shards > 30 and len(got) == 3 * n_shards
    whole = {s: sum(r[2] for r in got if r["shard"] == s) for s in {r["shard"] for r in got}}
    assert all(r[2] / whole[r["shard"]] == pytest.approx(0.6, abs=0.2) for r in got if r["source"] == "a")


@pytest.mark.skipif(not os.path.exists(tokenise.VOCABULARY), reason="no vocabulary")
def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([" A", "a", "b", "C ", "zz", None]), " ".join(["word"] * rng.randrange(0, 30)), 1) for i in range(900)]
    df = spark.createDataFrame(docs + docs[:10] + [(5000, "b", None, 1)], "doc_id long, source string, text string, shard int")
    targets = spark.createDataFrame([("A", 0.5, 2), ("b ", 0.2, 1), ("c", 0.2, None), ("empty", 0.1, 3)], "source string, target_share double, max_repeat int")
    got = mixing.mix(df, targets, n_shards=5, block_tokens=100)
    a, b = rows(got), rows(mixing.mix(df.repartition(7), targets, n_shards=5, block_tokens=100))
    assert a == b and len({(r[2], r[4]) for r in a}) == len(a)
    for shard in range(5):
        assert sorted(r[1] for r in a if r[0] == shard) == list(range(sum(r[0] == shard for r in a)))
    report = {r["source"]: r for r in mixing.share_report(got, targets).collect()}
    for name, share, cap in (("a", 0.5, 2), ("b", 0.2, 1), ("c", 0.2, 1)):
        assert report[name]["actual_share"] == pytest.approx(share / 0.9, abs=0.01) and report[name]["most_repeats"] <= cap
    assert report["empty"]["n_tokens"] == 0
    assert mixing.mix(df.filter("false"), targets).count() == 0 and mixing.mix(df, targets.filter("false")).count() == 0
