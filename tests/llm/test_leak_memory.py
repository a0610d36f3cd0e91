"""What decontamination holds besides texts and index is bounded, whatever matches; the results don't depend on the bounds."""

import random
import tracemalloc

import numpy as np

from strataq.llm import decontaminate

rnd = random.Random(11)
word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9)))
prose = lambda n: " ".join(word() for _ in range(n))


def peak_mb(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_repeating_items_and_texts():
    line = f"{prose(3)} "
    matcher = decontaminate.Matcher([decontaminate.normal(x) for x in (line * 20, "-" * 300, prose(40))])
    texts = [line * 1500, "-" * 40_000, prose(100), f"{prose(30)} {line * 22}"]
    found, mb = peak_mb(lambda: matcher.find(texts))
    assert found == [(0, 0, 0), (1, 1, 0), (3, 0, 0)]
    assert mb < 100


def test_a_long_stretch_beside_short_ones():
    patterns = [prose(60)[:250].encode() for _ in range(40)]
    texts = [(prose(4) + patterns[k % 40].decode()[: 250 - k % 7] + prose(4)).encode() for k in range(4000)]
    texts.append((prose(20_000) + patterns[0].decode() + prose(100)).encode())
    which = np.append(np.arange(4000) % 40, 0)
    got, mb = peak_mb(lambda: decontaminate.substring_distances(patterns, which, texts).tolist())
    assert got[-1] == 0 and all(got[k] == decontaminate.substring_distance(patterns[which[k]], texts[k]) for k in range(0, 4000, 97))
    assert mb < 100


def test_a_passage_that_many_items_share(monkeypatch):
    passage = prose(40)
    items = [decontaminate.normal(f"{passage} {prose(3)}") for _ in range(30)] + [b"q" + b"x" * k for k in range(1, 9)]
    matcher = decontaminate.Matcher(items)
    texts = [f"{prose(20)} {passage} {prose(20)}" if k % 3 else prose(30) for k in range(30)] + ["qxx " * 50]
    want = matcher.find(texts)
    assert {(t, i) for t, i, _ in want if i < 30} >= {(t, i) for t in range(30) if t % 3 for i in range(30)}
    monkeypatch.setattr(decontaminate, "MOST_PLACES", 300)
    monkeypatch.setattr(decontaminate, "MOST_CELLS", 5000)
    parts = list(matcher.matches(texts))
    assert sorted(x for part in parts for x in part) == want
    assert max(map(len, parts)) < 400 and len(want) >= 600
