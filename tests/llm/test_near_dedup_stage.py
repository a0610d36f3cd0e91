"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import collections
import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from strataq.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_survivors(rows):
    """Ids of the first row of each group; every pair with a common shingle is compared."""
    sets, holders = [], collections.defaultdict(list)
    for k, (_, text) in enumerate(rows):
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
        for s in sets[-1]:
            holders[s].append(k)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {p for held in holders.values() for p in itertools.combinations(held, 2)}:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)), key=lambda k: rows[k][0])
            up[b] = a
    return sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [256, 5])
def test_stage_on_edited_copies(spark, monkeypatch, block):
    rnd, made = random.Random(3), []
    monkeypatch.setattr(jaccard.links, "__defaults__", (block,))
    for _ in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(30, 300))]
        made += [edited(rnd, base, rnd.randint(0, max(1, len(base) // 30))) for _ in range(rnd.randint(1, 25))]
    made += ["", None, " \n", "one two three", "one  two three", "one two four"]
    rnd.shuffle(made)
    rows = list(enumerate(made))
    want = slow_survivors(rows)
    assert len(want) < len(rows) - 30
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, None).collect()) == want


def test_stage_on_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = slow_survivors([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, None).collect()) == want


def test_keys_meet_at_the_limit():
    assert jaccard.miss(0.8) < 1e-6
    rnd = np.random.default_rng(4)
    for _ in range(300):
        pool = rnd.integers(0, 2**64, 400, np.uint64)
        n = int(rnd.integers(5, 200))
        both, one = pool[: 4 * n // 5], pool[4 * n // 5 : n]
        assert set(jaccard.keys(np.unique(np.concatenate([both, one])))) & set(jaccard.keys(np.unique(both)))
