"""Benchmark items of more than one piece are leaked as a whole or not at all."""

import random

import numpy as np
import pytest

from strataq.llm import decontaminate


def prose(rnd, n):
    out = ""
    while len(out) < n:
        out += "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) + " "
    return out[: n - 1] + "z"


def edit(rnd, text, rate):
    x = list(text)
    for _ in range(int(rate * len(x))):
        at, kind = rnd.randrange(len(x)), rnd.randrange(3)
        if kind == 0:
            x[at] = rnd.choice("abcdefgh")
        elif kind == 1:
            del x[at]
        else:
            x.insert(at, rnd.choice("abcdefgh"))
    return "".join(x)


@pytest.mark.parametrize("size", [513, 545, 600, 1024, 1300, 3100])
def test_whole_items(size):
    rnd = random.Random(size)
    items = [prose(rnd, size) for _ in range(4)]
    matcher = decontaminate.Matcher([decontaminate.normal(x) for x in items])
    around = lambda x: f"{prose(rnd, 900)} {x} {prose(rnd, 700)}"
    texts = [around(x) for x in items] + [around(edit(rnd, x, 0.1)) for x in items] + [items[0]]
    # only a closing, opening or inner passage is shared
    parts = [x[-33:] for x in items] + [x[: size // 2] for x in items] + [x[size // 4 : 3 * size // 4] for x in items]
    found = {(row, item): d for row, item, d in matcher.find(texts + [around(x) for x in parts])}
    assert set(found) == {(k, k % 4) for k in range(9)}
    for (row, item), d in found.items():
        whole = decontaminate.substring_distances([decontaminate.normal(items[item])], np.array([0]), [decontaminate.normal(texts[row])])[0]
        assert d == whole and (row not in (0, 1, 2, 3, 8) or d == 0)
