"""Benchmark decontamination by CGK embedding (operator 3).

A document leaks an item if some stretch of it is within MAX_RATE * length edits of the item, whatever the item's length
(lower-cased A-Z, white space as single spaces; NUL bytes count as spaces).

1. The Chakraborty-Goldenberg-Koucky random walk embeds the text's windows, one for every STRIDE bytes, and the item's, one
   for every byte: one shared random bit for each step and byte decides whether to advance, so that few edits stay a small
   Hamming distance. A walk has WALK steps, over half as many bytes: an item of any length is met by several windows.
2. Bit-sampling LSH over the embeddings, repeated: each table samples SAMPLED of SPAN neighbouring steps. The number of tables
   is found by running this search on copies of the items with edits at MAX_RATE, until the recall reaches RECALL; a warning
   says so if MOST_TABLES don't reach it. Of DRAWS random draws the one that needs the fewest tables is taken.
3. A key that window and item share says where in the text the item may lie. There the whole item is verified by exact edit
   distance (bit-parallel, substring of the text).

Items of less than WALK bytes are too short for walks; cut into one part more than they may have edits, one part at least
is intact, so an Aho-Corasick automaton over the parts proposes every place, and the verification is the same.

Only the items' texts travel to the tasks, in blocks of about BYTES_PER_PASS bytes, one pass over the documents for each
block; a task's worker builds the block's index once. Texts are read once per pass and nothing is shuffled. What a worker holds
besides the texts and the index doesn't grow with what matches: places are compared MOST_PLACES at a time, and of a key's
places in one item only the first and the last are kept, as the stretches of those between lie within theirs.

Defined results: null texts and items are empty, and an empty item never matches; a text of any length is searched whole; a
passage that many items share is verified against each of them; null ids and repeated documents keep their rows; of repeated
items each distinct id reports once; extra columns are ignored (`leaks`) or kept (`remove_leaked`); an empty table of
documents gives an empty result, and one of items leaves all documents.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import warnings
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches
from .components import attach
from .scratch import materialize, ship

MAX_RATE, RECALL, BYTES_PER_PASS = 0.2, 0.95, 500_000
WALK, STRIDE, SAMPLED, SPAN, MOST_TABLES, TRIALS, DRAWS = 64, 8, 24, 40, 64, 200, 4
FEW = 200  # pairs that are compared one by one rather than side by side
MOST_PLACES, MOST_CELLS = 1 << 18, 1 << 23  # places that are held at once, bytes of text that are laid side by side
MIX, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
TEXT_END, ITEM_END = b"\0" * WALK, b"\xff" * WALK  # neither is in a normal text, so ends of texts and of items don't meet


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().replace(b"\0", b" ").split())


def substring_distance(pattern: bytes, text: bytes) -> int:
    """Least edit distance of pattern to any substring of text: bit-parallel over one long integer."""
    match: dict[int, int] = {}
    for i, c in enumerate(pattern):
        match[c] = match.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, best = full, 0, len(pattern)
    score = best
    for c in text:
        eq = match.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | full & ~(across | plus), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        eq |= minus
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | full & ~(eq | up), up & eq
    return best


def _side_by_side(blocks: np.ndarray, lengths: np.ndarray):
    """(blocks of the patterns, rows) of pairs with equally many blocks and similar texts, that fill MOST_CELLS at most."""
    for n_blocks in np.unique(blocks).tolist():
        rows = np.flatnonzero(blocks == n_blocks)
        rows = rows[np.argsort(-lengths[rows], kind="stable")]
        while len(rows):
            n = max(1, MOST_CELLS // max(int(lengths[rows[0]]), 64 * n_blocks))
            yield n_blocks, rows[:n]
            rows = rows[n:]


def substring_distances(patterns: list[bytes], which: np.ndarray, texts: list[bytes] | list[memoryview]) -> np.ndarray:
    """Least edit distance of patterns[which[k]] to any substring of texts[k]: bit-parallel, many pairs at once.

    Patterns lie in blocks of 64 bits; a block hands the change at its upper end to the next one.
    """
    out = np.empty(len(texts), np.int64)
    blocks = -(-np.array([len(patterns[p]) for p in which], np.int64) // 64)
    for n_blocks, rows in _side_by_side(blocks, np.array(list(map(len, texts)), np.int64)):
        if len(rows) < FEW:
            out[rows] = [substring_distance(patterns[which[r]], texts[r]) for r in rows.tolist()]
            continue
        used, mine = np.unique(which[rows], return_inverse=True)
        match = np.zeros((n_blocks, len(used), 256), np.uint64)
        for k, p in enumerate(used.tolist()):
            for i, c in enumerate(patterns[p]):
                match[i // 64, k, c] |= np.uint64(1 << i % 64)
        sizes = np.array([len(patterns[p]) for p in used], np.int64)[mine]
        top = ((sizes - 1) % 64).astype(np.uint64)
        longest = max(len(texts[r]) for r in rows.tolist())
        text = np.zeros((longest, len(rows)), np.uint8)  # no pattern holds a zero byte, so padding never helps
        for k, r in enumerate(rows.tolist()):
            text[: len(texts[r]), k] = np.frombuffer(texts[r], np.uint8)
        one, full, high = np.uint64(1), np.uint64(2**64 - 1), np.uint64(63)
        plus = np.full((n_blocks, len(rows)), full)
        minus = np.zeros_like(plus)
        score = sizes.copy()
        best = sizes.copy()
        for c in text:
            up = down = np.zeros(len(rows), np.uint64)
            for b in range(n_blocks):
                eq, pv, mv = match[b, mine, c], plus[b], minus[b]
                xv = eq | mv
                eq |= down
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                if b == n_blocks - 1:
                    score += (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64)
                ph_out, mh_out = ph >> high, mh >> high
                ph, mh = ph << one | up, mh << one | down
                plus[b], minus[b] = mh | ~(xv | ph), ph & xv
                up, down = ph_out, mh_out
            np.minimum(best, score, out=best)
        out[rows] = best
    return out


class Search:
    """The walks and tables: shared random bits and places, and how many tables are needed."""

    def __init__(self, items: list[bytes], rate: float = MAX_RATE, recall: float = RECALL, seed: int = 7):
        self.items, self.rate = items, rate
        # of some draws the one that needs the fewest tables
        drawn = [self._draw(recall, seed + k) for k in range(DRAWS if any(len(x) >= WALK for x in items) else 1)]
        self.steps, self.masks, reached = min(drawn, key=lambda x: (x[2] < recall, len(x[1])))
        if reached < recall:
            warnings.warn(f"{MOST_TABLES} tables reach a recall of {reached:.3f}, not {recall}", stacklevel=2)

    def _draw(self, recall: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Random bits of the walk, as many tables as are needed, each a mask over the walk's bytes, and the recall."""
        rng = np.random.default_rng(seed)
        self.steps, masks = (rng.random((WALK, 256)) < 0.5).astype(np.int64), np.zeros((MOST_TABLES, WALK), np.uint8)
        for row in masks:
            row[rng.integers(0, WALK - SPAN + 1) + rng.choice(SPAN, SAMPLED, replace=False)] = 255
        self.masks = masks.view(np.uint64)
        n, reached = self._tables(recall, seed)
        return self.steps, self.masks[:n], reached

    @functools.cached_property
    def name(self) -> str:
        """Tells one block's index from another's in a worker."""
        return hashlib.sha256(repr((self.items, self.rate, self.steps.tobytes(), self.masks.tobytes())).encode()).hexdigest()

    def most(self, item: int) -> int:
        """The edits that an item may have."""
        return int(self.rate * len(self.items[item]))

    def keys(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(table, window) keys of the walks from each start; data has WALK bytes behind the last start."""
        at, walk, step = starts.copy(), np.empty((WALK, len(starts)), np.uint8), np.empty(len(starts), np.int64)
        for bits, row in zip(self.steps, walk):
            np.take(data, at, out=row)
            at += np.take(bits, row, out=step)
        words = np.ascontiguousarray(walk.T).view(np.uint64).T.copy()
        out, part = np.empty((len(self.masks), len(starts)), np.uint64), np.empty(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for t, (mask, key) in enumerate(zip(self.masks, out)):
                key[:] = t + 1
                for word, places in zip(words, mask):
                    if places:
                        np.bitwise_xor(key, np.bitwise_and(word, places, out=part), out=key)
                        np.multiply(key, MIX, out=key)
                        np.bitwise_xor(key, np.right_shift(key, SHIFT, out=part), out=key)
        return out

    def _tables(self, recall: float, seed: int) -> tuple[int, float]:
        """How many tables find copies of the items, edited at the full rate, with the wanted recall, and what they reach."""
        long, rnd = [x for x in self.items if len(x) >= WALK], random.Random(seed)
        if not long:
            return 1, 1.0
        found = np.zeros((TRIALS, len(self.masks)), bool)
        for k in range(TRIALS):
            item = rnd.choice(long)
            text = bytearray(item)
            for _ in range(int(self.rate * len(item))):
                at, kind = rnd.randrange(len(text)), rnd.randrange(3)
                if kind == 0:
                    text[at] = rnd.choice(item)
                elif kind == 1:
                    del text[at]
                else:
                    text.insert(at, rnd.choice(item))
            text = bytes(text)
            # the text lies anywhere between windows, with other bytes behind it
            there = np.arange(rnd.randrange(STRIDE), len(text), STRIDE)
            left = self.keys(np.frombuffer(text + rnd.randbytes(WALK + 1), np.uint8), there)
            here = np.arange(len(item))
            right = self.keys(np.frombuffer(item + ITEM_END + b"\xff", np.uint8), here)
            near = np.abs(there[:, None] - here[None, :]) <= int(self.rate * len(item))
            found[k] = [(a[:, None] == b[None, :])[near].any() for a, b in zip(left, right)]
        reached = np.logical_or.accumulate(found, axis=1).mean(0)
        n = int(np.argmax(reached >= recall)) + 1 if reached[-1] >= recall else MOST_TABLES
        return n, float(reached[n - 1])


def _joined(rows: np.ndarray) -> np.ndarray:
    """Rows of (text, item, begin, end) in order; stretches of one text and item that meet are one."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    above = np.cumsum(new) << 40  # no end is as large, so a pair's ends stay above the pairs' before it
    end = np.maximum.accumulate(rows[:, 3] + above) - above
    new[1:] |= rows[1:, 2] > end[:-1]
    cuts = np.flatnonzero(new)
    return np.column_stack([rows[cuts, :3], end[np.append(cuts[1:], len(rows)) - 1 if len(cuts) else cuts]])


class Matcher:
    """find(texts) -> (row, item number, distance) of each leak; matches(texts) hands them on as they are found."""

    def __init__(self, items: Search | list[bytes]):
        import ahocorasick

        self.search = search = items if isinstance(items, Search) else Search(items)
        items = search.items
        self.sizes = np.array(list(map(len, items)), np.int64)
        self.most = (search.rate * self.sizes).astype(np.int64)
        long = [k for k, x in enumerate(items) if len(x) >= WALK]
        flat = np.frombuffer(b"".join(items[k] + ITEM_END for k in long) + b"\xff", np.uint8)
        sizes = np.array([len(items[k]) for k in long], np.int64)
        owners = np.repeat(np.array(long, np.int64), sizes)
        offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = search.keys(flat, np.repeat(np.cumsum(sizes + WALK) - sizes - WALK, sizes) + offsets)
        # a key's first and last place in each item that has it
        names, who, least, most = [], [], [], []
        for row in keys:
            order = np.argsort(row, kind="stable")
            key, owner, at = row[order], owners[order], offsets[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            names.append(key[new])
            who.append(owner[new].astype(np.int32))
            least.append(at[new].astype(np.int32))
            most.append(at[np.append(new[1:], True)[: len(at)]].astype(np.int32))
        names = np.concatenate(names)
        order = np.argsort(names, kind="stable")
        self.key, self.item, self.first, self.last = (np.concatenate(x)[order] for x in ([names], who, least, most))
        self.seen = np.zeros(1 << 24, bool)
        self.seen[(self.key >> np.uint64(40)).astype(np.int64)] = True
        # short items: one part more than edits
        parts: dict[str, list[tuple[int, int]]] = {}
        for k, x in enumerate(items):
            if 0 < len(x) < WALK:
                n = search.most(k) + 1
                cuts = [len(x) * j // n for j in range(n + 1)]
                for a, b in zip(cuts, cuts[1:]):
                    parts.setdefault(x[a:b].decode("latin-1"), []).append((k, a))
        self.parts = ahocorasick.Automaton() if parts else None
        for part, places in parts.items():
            self.parts.add_word(part, (len(part), places))
        if parts:
            self.parts.make_automaton()

    def places(self, docs: list[bytes], at_once: int = 12_000):
        """Rows of (text, item, begin, end) of the stretches where long items may lie, every shared key's, by text."""
        sizes = np.array(list(map(len, docs)), np.int64)
        data = np.frombuffer(TEXT_END.join(docs) + TEXT_END + b"\0", np.uint8)
        begins = np.cumsum(sizes + WALK) - sizes - WALK
        for a in range(0, (len(data) - WALK - 1) if len(self.key) else 0, at_once * STRIDE):
            starts = np.arange(a, min(a + at_once * STRIDE, len(data) - WALK - 1), STRIDE)
            keys = self.search.keys(data, starts).ravel()
            hit = np.flatnonzero(self.seen[(keys >> np.uint64(40)).astype(np.int64)])
            low = np.searchsorted(self.key, keys[hit], "left")
            n = np.searchsorted(self.key, keys[hit], "right") - low
            window = hit % len(starts)
            order = np.argsort(window, kind="stable")
            total = np.cumsum(n[order])
            if not len(total) or not total[-1]:
                continue
            # window by window, so that all tables' places of a text come together
            for part in np.split(order, np.unique(np.searchsorted(total, np.arange(MOST_PLACES, total[-1], MOST_PLACES)))):
                many = n[part]
                pick = np.repeat(low[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                if not len(pick):
                    continue
                at = np.repeat(starts[window[part]], many)
                text, item = np.searchsorted(begins, at, "right") - 1, self.item[pick]
                at -= begins[text]
                yield _joined(np.column_stack([text, item, at - self.last[pick] - self.most[item], at - self.first[pick] + self.sizes[item] + self.most[item]]))

    def short_places(self, docs: list[bytes]):
        """The same for items of less than WALK bytes, by their parts."""
        rows = array("q")

        def stretches() -> np.ndarray:
            text, item, at = np.array(rows, np.int64).reshape(-1, 3).T
            return _joined(np.column_stack([text, item, at - self.most[item], at + self.sizes[item] + self.most[item]]))

        for text, doc in enumerate(docs if self.parts is not None else []):
            for last, (size, places) in self.parts.iter(doc.decode("latin-1")):
                for k, a in places:
                    rows.extend((text, k, last - size + 1 - a))
                if len(rows) > 3 * MOST_PLACES:
                    yield stretches()
                    rows = array("q")
        if rows:
            yield stretches()

    def matches(self, texts: list[str | None]):
        """Lists of (row, item number, distance) of the leaks, each leak once, of bounded size unless one text has more."""
        docs = [normal(t) for t in texts]
        for places in (self.places(docs), self.short_places(docs)):  # no item is in both
            held, out = [], {}
            for rows in places:
                held.append(rows)
                if sum(map(len, held)) > MOST_PLACES:
                    self._compare(docs, held, out)
                    last = int(rows[-1, 0])  # the rows to come are of this text or later ones
                    yield [(t, i, d) for (t, i), d in out.items() if t < last]
                    held, out = [], {(t, i): d for (t, i), d in out.items() if t >= last}
            if held:
                self._compare(docs, held, out)
            yield [(t, i, d) for (t, i), d in out.items()]

    def _compare(self, docs: list[bytes], held: list[np.ndarray], out: dict[tuple[int, int], int]) -> None:
        """Adds to out the least distance of each (text, item) with a stretch close enough."""
        rows = _joined(np.concatenate(held))
        rows = rows[np.argsort(self.sizes[rows[:, 1]], kind="stable")]  # pairs of one size are compared side by side
        for k in range(0, len(rows), 5000):
            some = rows[k : k + 5000].tolist()
            stretch = [memoryview(docs[t])[max(a, 0) : max(b, 0)] for t, _, a, b in some]
            for (t, i, _, _), d in zip(some, substring_distances(self.search.items, rows[k : k + 5000, 1], stretch).tolist()):
                if d <= self.most[i]:
                    out[t, i] = min(d, out.get((t, i), d))

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        return sorted(x for part in self.matches(texts) for x in part)


_matchers: dict[str, Matcher] = {}


def matcher_of(search: Search) -> Matcher:
    """The worker's index of a block; one block's at a time."""
    if search.name not in _matchers:
        _matchers.clear()
        _matchers[search.name] = Matcher(search)
    return _matchers[search.name]


def searches(items: DataFrame, per_pass: int = BYTES_PER_PASS):
    """(Search, keys of its items): the distinct texts of items in blocks of bounded size."""
    texts = materialize(items.select(F.col("text").alias("item_text")).filter("item_text <> ''").distinct(), "items")
    blocks = max(1, math.ceil((texts.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) / per_pass))
    for k in range(blocks):
        block = texts.filter(F.pmod(F.xxhash64("item_text"), F.lit(blocks)) == k) if blocks > 1 else texts
        rows = sorted((normal(r.item_text), r.item_key) for r in block.select("item_text", F.sha2("item_text", 256).alias("item_key")).collect())
        yield Search([x for x, _ in rows]), [key for _, key in rows]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance): one row for each row of docs and item that it leaks."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for search, keys in searches(items):

        def found(batches, search=search, keys=keys):
            import pyarrow as pa

            for batch in text_batches(batches, most_bytes=8_000_000):
                for hits in matcher_of(search).matches(batch.column("text").to_pylist()):
                    rows = batch.column("doc_id").take(pa.array([r for r, _, _ in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([rows, pa.array([keys[i] for _, i, _ in hits], pa.string()), pa.array([d for *_, d in hits], pa.int64())], ["doc_id", "item_key", "distance"])

        part = docs.mapInArrow(found, "doc_id long, item_key string, distance long")
        out = part if out is None else out.unionByName(part)
    ids = materialize(items.select(F.col("item_id").cast("long"), F.sha2("text", 256).alias("item_key")).filter("item_key IS NOT NULL").distinct(), "item-ids")
    return attach(out, ids, "item_key").select("doc_id", "item_id", "distance")


def remove_leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that leak an item; rows stay where they are, nothing is shuffled."""
    ship(docs.sparkSession)
    for search, _ in searches(items):

        def clean(batches, search=search):
            import pyarrow as pa

            for batch in text_batches(batches, most_bytes=8_000_000):
                keep = np.ones(batch.num_rows, bool)
                for hits in matcher_of(search).matches(batch.column("text").to_pylist()):
                    keep[[r for r, _, _ in hits]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op3_decontamination(spark, sf_dir):
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
