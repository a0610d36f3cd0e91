"""Operators over the whole corpus against brute force: near-duplicates, substrings, the language model, the pipeline."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataq.llm import bwt, golay, katz, queries, quality, simhash, substrings
from strataq.llm.components import components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


# near-duplicates


def test_golay_code():
    rnd = random.Random(0)
    words = np.array([rnd.getrandbits(23) for _ in range(500)])
    near = golay.nearby(words)
    assert near.shape == (500, 24) and near.max() < 4096
    for k, w in enumerate(words.tolist()):
        two = w ^ 1 << rnd.randrange(23) ^ 1 << rnd.randrange(23)
        assert set(near[k]) & set(golay.nearby(np.array([two]))[0])


def test_keys_lose_no_link():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 2000).astype(np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rnd.choice(64, rnd.integers(0, 5), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)

    def keys(x):
        out = collections.defaultdict(set)
        for row, key in zip(*simhash.segment_keys(x)):
            out[row].add(key)
        return out

    left, right = keys(a), keys(b)
    assert all(left[k] & right[k] for k in range(len(a)))


def slow_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicate_query(spark, rows):
    fps = {d: slow_fingerprint(t) for d, t in rows}
    sets, ids = Sets(), list(fps)
    values = np.array([fps[d] for d in ids], np.uint64)
    for k, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k:] ^ values[k]) <= 4):
            sets.join(d, ids[k + j])
    for r in queries.queries()["op6_simhash_near_dedup"](spark, DATA).collect():
        assert int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == sets.find(r.doc_id)


def wanted_groups(made):
    want, u = Sets(), np.array(made).view(np.uint64)
    for k in range(len(made)):
        for j in np.flatnonzero(np.bitwise_count(u[k:] ^ u[k]) <= 4):
            want.join(made[k], made[k + j])
    return want


def check_links(spark, made, block):
    want, got = wanted_groups(made), Sets()
    found = simhash.links(spark.createDataFrame([(x,) for x in made], "fp long"), block).collect()
    for r in found:
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4
        got.join(r.a, r.b)
    assert all(want.find(x) == got.find(x) for x in made)
    return len({want.find(x) for x in made})


@pytest.mark.parametrize("block", [4096, 7])
def test_links_in_blocks(spark, block):
    rnd, made = np.random.default_rng(0), set()
    for centre in rnd.integers(0, 2**63, 12).astype(np.uint64):
        for _ in range(40):
            x = centre
            for bit in rnd.choice(64, rnd.integers(0, 6), replace=False):
                x ^= np.uint64(1) << np.uint64(bit)
            made.add(int(np.uint64(x).view(np.int64)))
    check_links(spark, sorted(made), block)


def test_links_of_a_hot_key(spark):
    """Thousands of fingerprints under one key, far more than a block, in batches and levels."""
    rnd = np.random.default_rng(5)
    low = np.unique(rnd.integers(0, 2**22, 6000, np.uint64))  # segments two and three are one and the same
    tight = np.unique(rnd.integers(0, 2**13, 900, np.uint64)) | np.uint64(1 << 60)
    made = [int(x) for x in np.concatenate([low | np.uint64(0xABCDE << 22), tight, tight << np.uint64(20)])]
    assert 1 < check_links(spark, made, 500) < len(made)


def test_part_keys_lose_no_link():
    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 2**63, 1000).astype(np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rnd.choice(64, rnd.integers(0, 5), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    for parts, equal in simhash.LEVELS:
        left, right = (simhash.part_keys(x, parts, equal)[1].reshape(-1, len(a)) for x in (a, b))
        assert (left == right).any(0).all()


def test_hundred_thousand_fingerprints_of_one_key(spark):
    made = np.unique(np.random.default_rng(6).integers(0, 2**20, 130_000)) + (0xABC << 40)
    assert len(made) > 100_000 and len(set(simhash.segment_keys(made[:1].astype(np.uint64))[1]) & set(simhash.segment_keys(made[-1:].astype(np.uint64))[1]))
    import pandas as pd

    got = components(simhash.links(spark.createDataFrame(pd.DataFrame({"fp": made}))))
    assert got.count() == len(made) and got.select("component").distinct().count() == 1  # a tenth of all 20-bit words is connected


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(3000, 7000)] + [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (202, 201)]
    want = Sets()
    for a, b in links:
        want.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want.find(x) for x in got} and set(got) == {x for link in links for x in link}


# substrings


def test_merged_transforms():
    rnd = random.Random(2)
    for _ in range(100):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 12))]
        shards = [s for s in (strings[k::3] for k in range(3)) if s]
        depth, parts = rnd.randint(1, 6), [bwt.transform(s) for s in shards]
        rows_, ids = bwt.merge_classes(parts, depth)
        bases, got, want = np.cumsum([0, *map(len, parts)]), collections.defaultdict(list), collections.defaultdict(list)
        where = [bwt.places(p, np.array(list(map(len, s)))) for p, s in zip(parts, shards)]
        for row, c in zip(rows_.tolist(), ids.tolist()):
            k = int(np.searchsorted(bases, row, "right") - 1)
            got[c].append((k, int(where[k][0][row - bases[k]]), int(where[k][1][row - bases[k]])))
        for k, s in enumerate(shards):
            for i, x in enumerate(s):
                for o in range(len(x) - depth + 1):
                    want[x[o : o + depth]].append((k, i, o))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def slow_substrings(rows):
    first, last = {}, 2**63 - 1
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, last), last if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (last if d is None else d):
                gone[k : k + 50] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((-1 if d is None else d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def run_substrings(df, **options):
    out = substrings.deduplicate(df, digest=True, **options)
    return sorted(map(tuple, out.select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string")).collect()))


@pytest.mark.parametrize("hot", [64, 0])
def test_substrings_against_brute_force(spark, hot):
    rnd, made = random.Random(5), []
    base = ["".join(rnd.choice("abcdé ") for _ in range(300)) for _ in range(6)]
    for k in range(120):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, 200)
            parts.append(rnd.choice([rnd.choice(base)[at : at + rnd.randint(20, 120)], "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 60))), "ab" * rnd.randint(0, 60), "é" * rnd.randint(0, 60)]))
        made.append((rnd.choice([k, k, k, rnd.randint(0, 20), None]), "".join(parts)))
    made += made[:10] + [(500, made[3][1]), (501, None), (502, ""), (None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    assert run_substrings(df, hot_blocks=hot) == slow_substrings(made)


def test_substring_query(spark, rows):
    got = queries.queries()["op7_suffix_dedup"](spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == slow_substrings(rows)


# language model


def slow_katz(tokens, held, order):
    counts = [collections.Counter() for _ in range(order + 1)]
    for d, t in tokens.items():
        if not held[d]:
            padded = [None] * (order - 1) + t
            for n in range(1, order + 1):
                counts[n].update(tuple(padded[k - n + 1 : k + 1]) for k in range(order - 1, len(padded)))
    total, words = sum(counts[1].values()), len(counts[1])
    star = {n: katz.discounts([sum(c == r for c in counts[n].values()) for r in range(1, katz.CUT + 2)]) for n in range(2, order + 1)}
    history = {n: collections.Counter() for n in range(2, order + 1)}
    for n in history:
        for g, c in counts[n].items():
            history[n][g[:-1]] += c
    less = lambda n, c: star[n][c] if c <= katz.CUT else c - (katz.CUT - star[n][katz.CUT])

    def p(g):
        n = len(g)
        if n == 1:
            return (counts[1][g] + 1) / (total + words + 1)
        if counts[n][g]:
            return less(n, counts[n][g]) / history[n][g[:-1]]
        return alpha(g[:-1]) * p(g[1:])

    followers = {n: collections.defaultdict(list) for n in history}
    for n in history:
        for g in counts[n]:
            followers[n][g[:-1]].append(g)
    known: dict = {}

    def alpha(h):
        if h not in known:
            n = len(h) + 1
            after = followers[n].get(h)
            known[h] = 1.0 if not after else (1 - sum(less(n, counts[n][g]) for g in after) / history[n][h]) / (1 - sum(p(g[1:]) for g in after))
        return known[h]

    return p, counts[1], total


@pytest.mark.parametrize("order", [2, 3])
def test_katz_scores_against_brute_force(spark, rows, order):
    tokens = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    p, unigrams, total = slow_katz(tokens, held, order)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    got = queries.queries()["op1_katz_scores"](spark, DATA) if order == 2 else katz.fit_and_score(docs, order)
    gain = 0.0
    for r in got.collect():
        t = tokens[r.doc_id]
        padded = [None] * (order - 1) + t
        base = sum(math.log10(p((w,))) for w in t)
        score = sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(t)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum((w,) in unigrams for w in t), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-7)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0  # held-out texts are likelier than under the base
    for h in [g[:-1] for g in list(followed(tokens, held, order))[:5]]:
        assert math.isclose(sum(p((*h, w)) for (w,) in unigrams) + p((*h, b"never seen")), 1, rel_tol=1e-9)


def followed(tokens, held, order):
    for d, t in tokens.items():
        if not held[d]:
            padded = [None] * (order - 1) + t
            yield tuple(padded[:order])


def test_discounts():
    star = katz.discounts([100000, 30000, 15000, 9000, 6000, 4300])
    assert np.all(np.diff(star) > 0) and np.all(star[1:] < np.arange(1, katz.CUT + 1))
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 1, 9, 1, 9], [10, 5, 0, 0, 1, 0]):
        star = katz.discounts(odd)
        assert np.all(star[1:] > 0) and np.all(star[1:] < np.arange(1, katz.CUT + 1))


# pipeline


def test_pipeline_against_its_operators(spark, rows):
    """Ids against brute force: Jaccard groups of five-word shingles among the kept, then the leaks; texts against the
    redaction of what is left, through the pieces' token ids."""
    from strataq.llm import bpe, pii
    from test_near_dedup_stage import slow_survivors

    got = corpus_pipeline.run(spark, DATA).collect()
    kept = {r.doc_id for r in quality.op8_quality_rules(spark, DATA).collect() if r.kept}
    left = set(slow_survivors([(d, t) for d, t in sorted(rows) if d in kept]))
    leaked = {r.doc_id for r in queries.queries()["op3_decontamination"](spark, DATA).collect()}
    assert {r.doc_id for r in got} == left - leaked and left & leaked
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.col("doc_id").isin(sorted(left - leaked)))
    lib = bpe.WordEncoder().lib
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 0] for r in pii.redact(docs).collect()}
    fill: dict = {}
    for r in got:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(map(len, want.values()))
