"""The pipeline's near-duplicate stage finds its candidates by SimHash and Golay keys, and loses none."""

import itertools
import random

import numpy as np
import pytest

from strataq.llm import golay, jaccard, scratch
from strataq.llm.components import components


def slow_keys(found):
    """Golay keys by the definitions: bits by counting, indices by the nearest of all codewords."""
    flips, factors, mix = [int(x) for x in jaccard.FLIPS], [int(x) for x in jaccard.FACTORS], int(jaccard.MIX)
    total = [0] * (64 * jaccard.LANES)
    for h in map(int, found):
        lanes = [h]
        for flip, factor in zip(flips, factors):
            x = (h ^ flip) * factor % 2**64
            x = (x ^ x >> 29) * mix % 2**64
            lanes.append(x ^ x >> 32)
        for k, lane in enumerate(lanes):
            for bit in range(64):
                total[64 * k + bit] += lane >> bit & 1
    codewords = []
    for index in range(1 << golay.K):
        rest = index << 11
        for bit in range(22, 10, -1):
            rest ^= (golay.GENERATOR << (bit - 11)) if rest >> bit & 1 else 0
        codewords.append(index << 11 | rest)
    codewords, out = np.array(codewords), set()
    for table in range(jaccard.TABLES):
        over = [2 * t - len(found) for t in total[23 * table : 23 * table + 23]]
        word = sum((x > 0) << k for k, x in enumerate(over))
        soft = sorted(range(23), key=lambda k: abs(over[k] - 0.5))[:3]
        for flipped in itertools.product((0, 1), repeat=3):
            near = np.bitwise_count(codewords ^ (word ^ sum(f << k for f, k in zip(flipped, soft))))
            out.add(table << 12 | int(codewords[near.argmin()]) >> 11)
    return out


@pytest.mark.parametrize("n", [1, 4, 61, 600])
def test_keys_are_golay_indices_of_simhash_words(n):
    found = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
    got = jaccard.keys(found)
    assert set(got.view(np.uint16).tolist()) == slow_keys(found) and len(got) == len(set(got.tolist()))


def test_small_sets_at_the_limit_share_keys_and_are_close():
    rnd = np.random.default_rng(5)
    for both, one, other in [(4, 0, 1), (5, 0, 1), (8, 1, 1), (8, 0, 2), (12, 0, 3), (40, 5, 5)] * 150:
        pool = rnd.integers(0, 2**64, both + one + other, np.uint64)
        a, b = (jaccard.excess(np.unique(x)) for x in (pool[: both + one], np.append(pool[:both], pool[both + one :])))
        prints, ends, flat = jaccard.sketches(np.stack([a, b]))
        assert set(flat[: ends[0]]) & set(flat[ends[0] :])
        assert np.bitwise_count((prints[0] ^ prints[1]).view(np.uint64)).sum() <= jaccard.MOST_BITS


def made_sets(seed, groups):
    """Sets in groups of near copies, one group large, with sizes on both sides of the classes' ends."""
    rnd, out = random.Random(seed), []
    for g in range(groups):
        base = [rnd.getrandbits(64) for _ in range(rnd.choice([5, 14, 15, 17, 62, 66, 70, 250, 258, 300]))]
        for _ in range(90 if g == 0 else rnd.randint(1, 6)):
            kept = list(base)
            for _ in range(rnd.randint(0, len(base) // 8)):
                kept[rnd.randrange(len(kept))] = rnd.getrandbits(64)
            out.append(np.unique(np.array(kept[: len(kept) - rnd.randint(0, len(base) // 12)], np.uint64)))
    return list({s.tobytes(): s for s in out}.values())


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_candidates_connect_all_similar_sets(spark, most):
    sets = made_sets(11, 60)
    prints, ends, flat = jaccard.sketches(np.stack([jaccard.excess(s) for s in sets]))
    lists = np.split(flat, ends[:-1])
    rows = [(7 * k, len(s), *p.tolist(), q.tolist()) for k, (s, p, q) in enumerate(zip(sets, prints, lists))]
    nodes = spark.createDataFrame(rows, f"_row long, size long, {', '.join(f'{f} long' for f in jaccard.PRINT)}, keys array<short>").repartition(3)
    found = scratch.materialize(jaccard.candidates(nodes, most), "test-links")
    assert found.count() < 4 * len(sets) or most == 40
    of = {r.node // 7: r.component for r in components(found).collect()}
    pairs = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            pairs += 1
            assert of[a] == of[b]
    assert pairs > 100


@pytest.mark.parametrize("most", [2048, 1])
def test_sweep_connects_what_close_pairs_connect(monkeypatch, most):
    monkeypatch.setattr(jaccard, "SWEEP", most)
    rnd = np.random.default_rng(8)
    sizes = np.sort(rnd.integers(20, 60, 400))
    prints = rnd.integers(0, 2**64, (4, 25), np.uint64)[:, rnd.integers(0, 25, 400)]
    for _ in range(21):
        prints ^= rnd.integers(0, 2, prints.shape, np.uint64) << rnd.integers(0, 64, prints.shape, np.uint64)
    near = np.bitwise_count(prints[:, :, None] ^ prints[:, None]).sum(0, dtype=np.int64) <= jaccard.MOST_BITS
    pairs = [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1))) if 5 * sizes[a] >= 4 * sizes[b]]
    found = jaccard.sweep(sizes, prints)
    assert 50 < len(pairs) and len(found) < 400
    assert (jaccard.least_linked(np.array(found), 400) == jaccard.least_linked(np.array(pairs), 400)).all()
