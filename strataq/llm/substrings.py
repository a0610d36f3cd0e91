"""Exact substring deduplication by merged Burrows-Wheeler transforms (operator 7).

Every byte covered by a LENGTH-byte string that also starts in a document of a smaller id goes; strings are judged on
the input. The texts are far too many for one suffix order, so equal strings are first brought together:

1. Documents are cut into blocks (a table bucketed by block, so later steps move no text). Blocks ask the owners of text
   hashes (128 bits) for the smallest id with the same whole text; later copies need no more work.
2. Every LENGTH-byte window has an anchor: the leftmost of its GRAM-byte strings with the least hash. Equal windows have
   equal anchors at equal places, and about one position in fourteen is an anchor. Blocks ask which of their anchors
   (packed sorted hashes) also occur in other documents. Windows with a private anchor can't repeat.
3. What surrounds the other anchors, the stretch of all windows of one anchor, is a string. Equal strings are
   pre-aggregated: a first exchange of 128-bit hashes gives each its smallest id and one block that stands for it, and
   tells which anchors have a single stretch everywhere, so that nothing else can match there.
4. The other strings form the block's shard for the bucket of the anchor's hash. The block builds the shard's
   Burrows-Wheeler transform and sends that. A bucket merges the transforms of all its shards by interleave refinement
   to depth LENGTH, without sorting suffixes again; suffixes left in one class share LENGTH bytes. Each class's smallest
   id goes back to all blocks that have the string.
5. Blocks mark the windows with a smaller id elsewhere and drop the bytes they cover.

Skew: a block sends each distinct anchor and string once, so a bucket gets at most one copy from each block whatever the
number of copies. An anchor found in more than HOT_BLOCKS blocks doesn't gather around its own hash: its windows are sent
one by one to buckets by the hash of the whole window, which spreads them.

Defined results: a null text is empty; null ids count as larger than any id and never erase each other; rows of one id
never erase each other; a text of any length is one document of one block; extra columns are ignored; an empty table gives
an empty result. Whole texts count as equal by 128-bit hashes, without a look at their bytes (for n distinct texts an error
of about n^2 / 2^129).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partition import estimated_bytes
from . import bwt
from .bpe import text_batches
from .packed import brief_shuffles, bucket_of, bucketed, columns_of, framed, narrow, pack_sorted, release, requests, squeeze, store, swell, to_table, unpack_sorted
from .scratch import ship

LENGTH, GRAM, BLOCK_BYTES, HOT_BLOCKS, BUCKET_BYTES = 50, 24, 5_000_000, 64, 32_000_000
LAST = np.iinfo(np.int64).max
BLOCK = "block long, doc_ids array<long>, sizes binary, data binary"
REQUEST = "kind string, bucket long, block long, keys binary, counts binary"
CHUNK = 1 << 15  # positions worked on at once; their numbers stay in the processor's cache
ALONE, MINE, OTHERS = range(3)


def make_blocks(batches):
    from pyspark import TaskContext

    serial = 0

    def block(ids, parts):
        nonlocal serial
        serial += 1
        sizes = np.array(list(map(len, parts)), np.int64)
        return to_table([{"block": (TaskContext.get().partitionId() << 24) + serial, "doc_ids": ids, "sizes": squeeze(narrow(sizes)), "data": b"".join(parts)}], BLOCK).to_batches()[0]

    ids, parts, size = [], [], 0
    for batch in text_batches(batches):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            parts.append((text or "").encode("utf-8", "surrogatepass"))
            ids.append(doc)
            size += len(parts[-1])
            if size >= BLOCK_BYTES:
                yield block(ids, parts)
                ids, parts, size = [], [], 0
    if ids:
        yield block(ids, parts)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM (16 to 32) bytes from each position."""
    # the eight bytes from each position as one number
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    n = len(data) - GRAM + 1
    x = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in dict.fromkeys((0, 8, max(GRAM - 16, 0), GRAM - 8)):
            x ^= eight[at : at + n]
            x *= np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, behind the last window, anchor's hash) of the runs of windows of data with one anchor."""
    width = length - GRAM + 1
    first, stop, hashes = [], [], []
    places = np.arange(CHUNK + length, dtype=np.uint64)
    for a in range(0, len(data) - length + 1, CHUNK):
        part = data[a : a + CHUNK + length - 1]
        # the hash above, the place below: the least value is the leftmost of the least hashes
        grams = gram_hashes(part)
        best = grams & ~np.uint64((1 << 18) - 1)
        best |= places[: len(grams)]
        covered = 1
        while covered < width:
            step = min(covered, width - covered)
            best = np.minimum(best[:-step], best[step:])
            covered += step
        best &= np.uint64((1 << 18) - 1)
        at = best.view(np.int64)
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        first.append(cuts + a)
        stop.append(np.append(cuts[1:], len(at)) + a)
        hashes.append(grams[at[cuts]])
    if not first:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    return np.concatenate(first), np.concatenate(stop), np.concatenate(hashes)


class Block:
    """A block row at work."""

    def __init__(self, row: dict):
        self.id, self.doc_ids = row["block"], row["doc_ids"]
        self.ids = np.array([LAST if d is None else d for d in row["doc_ids"]], np.int64)
        self.sizes = swell(row["sizes"]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = row["data"]
        self.data = np.frombuffer(self.bytes, np.uint8)

    def text(self, k: int) -> bytes:
        return self.bytes[self.starts[k] : self.starts[k] + self.sizes[k]]

    def hashes(self) -> np.ndarray:
        """128-bit hashes of the texts as two columns."""
        from xxhash import xxh3_128_digest

        return np.frombuffer(b"".join(xxh3_128_digest(self.text(k)) for k in range(len(self.sizes))), "<u8").reshape(-1, 2)

    def text_groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, each document's group, smallest id of each group)."""
        every, group = np.unique(self.hashes(), axis=0, return_inverse=True)
        least = np.full(len(every), LAST)
        np.minimum.at(least, group.ravel(), self.ids)
        return every, group.ravel(), least

    def stretches(self, skip: np.ndarray):
        """(document, first window, behind the last, anchor hash) of the anchors of documents not in skip, by position."""
        docs = np.flatnonzero(~skip & (self.sizes >= LENGTH))
        out = []
        # neighbouring documents are laid out together; windows across their borders are cut off afterwards
        for group in np.array_split(docs, max(1, int(self.sizes[docs].sum() // 1_000_000))):
            if not len(group):
                continue
            data = np.concatenate([self.data[self.starts[k] : self.starts[k] + self.sizes[k]] for k in group])
            base = np.cumsum(self.sizes[group]) - self.sizes[group]
            first, stop, grams = anchors(data)
            who = np.searchsorted(base, first, "right") - 1
            last = np.searchsorted(base, stop - 1, "right") - 1
            # a run over a border is cut into its documents' parts
            many = last - who + 1
            pick = np.repeat(np.arange(len(first)), many)
            who = np.repeat(who - (np.cumsum(many) - many), many) + np.arange(many.sum())
            lo = np.maximum(first[pick], base[who])
            hi = np.minimum(stop[pick], base[who] + self.sizes[group][who] - LENGTH + 1)
            good = hi > lo
            who, lo, hi, pick = who[good], lo[good], hi[good], pick[good]
            # anchors have the least hashes of their windows; mixed again they spread evenly over the buckets
            with np.errstate(over="ignore"):
                hashes = grams[pick] * np.uint64(0xD1B54A32D192ED03)
                hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0x8CB92BA72F3D8DD7)
            shift = self.starts[group][who] - base[who]
            out.append((group[who], lo + shift, hi + shift, hashes))
        if not out:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        return tuple(np.concatenate(x) for x in zip(*out))


def answered(answers: list[dict], kind: str) -> dict[int, dict]:
    """The answers of a kind by bucket, in order."""
    return {r["bucket"]: r for r in sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["bucket"])}


# 1. whole texts


def text_requests(blocks: DataFrame, buckets: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                every, _, least = block.text_groups()
                rows = requests(block.id, every[:, 0].copy(), [every[:, 1], least], buckets)
                yield from to_table([r | {"kind": "text"} for r in rows], REQUEST).to_batches()

    return blocks.mapInArrow(ask, REQUEST)


def text_answers(asked: DataFrame) -> DataFrame:
    """For each asked text the smallest id that has it."""

    def add(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        heads = [unpack_sorted(r["keys"]) for r in rows]
        tails, least = zip(*(columns_of(r["counts"], 2) for r in rows))
        keys = np.stack([np.concatenate(heads), np.concatenate(tails)], axis=1)
        ids = np.concatenate(least)
        every, place = np.unique(keys, axis=0, return_inverse=True)
        best = np.full(len(every), LAST)
        np.minimum.at(best, place.ravel(), ids)
        out, at = [], 0
        for r, k in zip(rows, heads):
            out.append({"kind": "text", "bucket": r["bucket"], "block": r["block"], "counts": squeeze(best[place.ravel()[at : at + len(k)]])})
            at += len(k)
        return to_table(out, REQUEST)

    return asked.groupBy("bucket").applyInArrow(add, REQUEST)


class Texts:
    """A block's documents after the first answers: copies of a smaller id's text, and the rows to look into."""

    def __init__(self, block: Block, answers: list[dict]):
        _, self.group, _ = block.text_groups()
        first_id = np.concatenate([swell(r["counts"]) for r in answered(answers, "text").values()])[self.group]
        self.copy = block.ids > first_id
        # of rows with one text and the smallest id, a block looks into its first
        mine = np.flatnonzero(~self.copy)
        self.skip = np.ones(len(self.group), bool)
        self.skip[mine[np.unique(self.group[mine], return_index=True)[1]]] = False


# 2. anchors


def anchor_requests(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def ask(left, right):
        block = Block(left.to_pylist()[0])
        docs, _, _, hashes = block.stretches(Texts(block, right.to_pylist()).skip)
        keys, place = np.unique(hashes, return_inverse=True)
        low, high = np.full(len(keys), LAST), np.full(len(keys), -1)
        np.minimum.at(low, place, docs)
        np.maximum.at(high, place, docs)
        rows = requests(block.id, keys, [(low < high).astype(np.uint8)], buckets)
        return to_table([r | {"kind": "anchor"} for r in rows], REQUEST)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, REQUEST)


def anchor_answers(asked: DataFrame, hot_blocks: int) -> DataFrame:
    """0: private to one document, 1: shared, 2: shared by more than hot_blocks blocks."""

    def add(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [unpack_sorted(r["keys"]) for r in rows]
        within = np.concatenate([columns_of(r["counts"], 1)[0] for r in rows])
        every, place, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        several = np.bincount(place, weights=within, minlength=len(every)) > 0
        state = ((n > 1) | several).astype(np.uint8) + (n > hot_blocks)
        out, at = [], 0
        for r, k in zip(rows, keys):
            out.append({"kind": "anchor", "bucket": r["bucket"], "block": r["block"], "counts": squeeze(state[place[at : at + len(k)]])})
            at += len(k)
        return to_table(out, REQUEST)

    return asked.groupBy("bucket").applyInArrow(add, REQUEST)


# 3. and 4. strings, shards and their merge


class Units:
    """A block's distinct strings around shared anchors, each with its occurrences (document, first window).

    Every step builds them again from the block: that costs less than carrying them through the exchanges.
    """

    def __init__(self, block: Block, answers: list[dict], buckets: int):
        from xxhash import xxh64_intdigest

        docs, first, stop, hashes = block.stretches(Texts(block, answers).skip)
        keys, place = np.unique(hashes, return_inverse=True)
        parts = [swell(r["counts"]) for r in answered(answers, "anchor").values()]
        state = (np.concatenate(parts) if parts else np.empty(0, np.uint8))[place] if len(keys) else np.empty(0, np.uint8)
        docs, first, stop, hashes, hot = docs[state > 0], first[state > 0], stop[state > 0], hashes[state > 0], state[state > 0] == 2
        if hot.any():  # one string for each window
            many = np.where(hot, stop - first, 1)
            pick = np.repeat(np.arange(len(docs)), many)
            lo = first[pick] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            stop = np.where(hot[pick], lo + 1, stop[pick])
            docs, hashes, hot, first = docs[pick], hashes[pick], hot[pick], lo
        raw = block.bytes
        table: dict[bytes, int] = {}
        of = np.empty(len(docs), np.int64)
        for k, (a, b) in enumerate(zip(first.tolist(), (stop + LENGTH - 1).tolist())):
            of[k] = table.setdefault(raw[a:b], len(table))
        if hot.any():
            strings, hashes = list(table), hashes.copy()
            for k in np.flatnonzero(hot).tolist():
                hashes[k] = xxh64_intdigest(strings[of[k]], 7)
        self.strings, self.docs, self.first, self.of = list(table), docs, first, of
        self.windows = np.array(list(map(len, table)), np.int64) - LENGTH + 1
        self.least = np.full(len(table), LAST)
        np.minimum.at(self.least, of, block.ids[docs])
        self.key = np.zeros(len(table), np.uint64)
        self.key[of] = hashes
        self.name = np.array([xxh64_intdigest(x, 11) for x in table], np.uint64)
        self.order = np.lexsort((self.name, self.key))
        self.bucket = bucket_of(self.key, buckets)
        if parts := [columns_of(r["counts"], 2) for r in answered(answers, "unit").values()]:
            self.state = np.empty(len(table), np.uint8)
            self.state[self.order] = np.concatenate([p[0] for p in parts])
            self.least[self.order] = np.concatenate([p[1] for p in parts])

    def of_bucket(self) -> dict[int, np.ndarray]:
        """Open units by bucket: first those that this block stands for, then those that another one does."""
        order = self.order[self.state[self.order] > ALONE] if len(self.order) else self.order
        order = order[np.lexsort((self.state[order], self.bucket[order]))] if len(order) else order
        cuts = np.flatnonzero(np.diff(self.bucket[order], prepend=-1)).tolist()
        return {int(self.bucket[order[a]]): order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])}


def unit_requests(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def ask(left, right):
        block = Block(left.to_pylist()[0])
        units = Units(block, right.to_pylist(), buckets)
        rows = requests(block.id, units.key[units.order], [units.name[units.order], units.least[units.order]], buckets)
        out = to_table([r | {"kind": "unit"} for r in rows], REQUEST)
        del block, units, rows
        release()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, REQUEST)


def unit_answers(asked: DataFrame) -> DataFrame:
    """For each asked string its state (ALONE at its anchor, MINE to send, or OTHERS) and its smallest id."""

    def add(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [unpack_sorted(r["keys"]) for r in rows]
        names, ids = zip(*(columns_of(r["counts"], 2) for r in rows))
        both = np.stack([np.concatenate(keys), np.concatenate(names)], axis=1)
        order = np.lexsort((both[:, 1], both[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (both[order[1:]] != both[order[:-1]]).any(1)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        heads = both[order[new], 0]
        least = np.full(len(heads), LAST)
        np.minimum.at(least, place, np.concatenate(ids))
        alone = np.ones(len(heads), bool)
        alone[1:] &= heads[1:] != heads[:-1]
        alone[:-1] &= heads[1:] != heads[:-1]
        state = np.where(alone[place], ALONE, OTHERS).astype(np.uint8)
        first = np.unique(place, return_index=True)[1]
        state[first[~alone]] = MINE
        out, at = [], 0
        for r, k in zip(rows, keys):
            part = slice(at, at + len(k))
            at += len(k)
            out.append({"kind": "unit", "bucket": r["bucket"], "block": r["block"], "counts": framed([squeeze(state[part]), squeeze(least[place[part]])])})
        return to_table(out, REQUEST)

    return asked.groupBy("bucket").applyInArrow(add, REQUEST)


def shard_requests(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def ask(left, right):
        block = Block(left.to_pylist()[0])
        units, out = Units(block, right.to_pylist(), buckets), []
        for bucket, who in units.of_bucket().items():
            mine, others = who[units.state[who] == MINE], who[units.state[who] == OTHERS]
            strings = [units.strings[k] for k in mine.tolist()]
            parts = [bwt.transform(strings), narrow(np.array(list(map(len, strings)), np.int64)), units.least[mine], units.name[mine], units.name[others]]
            out.append({"kind": "shard", "bucket": bucket, "block": block.id, "counts": framed(list(map(squeeze, parts)))})
        out = to_table(out, REQUEST)
        del block, units
        release()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, REQUEST)


def shard_answers(asked: DataFrame) -> DataFrame:
    """For each asked string the windows (string, offset) that occur in another string too, with their smallest id."""

    def add(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        shards = [columns_of(r["counts"], 5) for r in rows]
        full = [s for s in shards if len(s[0])]
        at, ids = bwt.merge_classes([s[0] for s in full], LENGTH) if full else (np.empty(0, np.int64),) * 2
        where = [bwt.places(s[0], s[1]) for s in full]
        bases = np.cumsum([0, *(len(s[1]) for s in full)])
        string = np.concatenate([np.empty(0, np.int32), *(w[0] + base for w, base in zip(where, bases.astype(np.int32)))])[at]
        offset = np.concatenate([np.empty(0, np.int32), *(w[1] for w in where)])[at]
        least = np.concatenate([np.empty(0, np.int64), *(s[2] for s in full)])
        best = np.full(int(ids.max(initial=0)) + 1, LAST)
        np.minimum.at(best, ids, least[string])
        smallest = best[ids]
        useful = smallest < least[string]  # the string's own smallest id is known to all that have it
        string, offset, smallest = string[useful], offset[useful], smallest[useful]
        order = np.argsort(string, kind="stable")
        string, offset, smallest = string[order], offset[order], smallest[order]
        names = np.concatenate([np.empty(0, np.uint64), *(s[3] for s in full)])
        by_name = np.argsort(names, kind="stable")
        out = []
        for r, s in zip(rows, shards):
            asked_names = np.concatenate([s[3], s[4]])
            wanted = by_name[np.searchsorted(names[by_name], asked_names)]
            low, high = np.searchsorted(string, wanted, "left"), np.searchsorted(string, wanted, "right")
            n = high - low
            pick = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            parts = [narrow(np.repeat(np.arange(len(wanted)), n)), narrow(offset[pick]), smallest[pick]]
            out.append({"kind": "shard", "bucket": r["bucket"], "block": r["block"], "counts": framed(list(map(squeeze, parts)))})
        out = to_table(out, REQUEST)
        del rows, shards, full, at, ids, where, string, offset, least, best, smallest
        release()
        return out

    return asked.groupBy("bucket").applyInArrow(add, REQUEST)


# 5. what is left


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def kept_texts(blocks: DataFrame, answers: DataFrame, buckets: int, digest: bool) -> DataFrame:
    """RESULT rows; kept is the remaining bytes, or their SHA-256 in hexadecimal if digest."""

    def cut(left, right):
        block, right = Block(left.to_pylist()[0]), right.to_pylist()
        texts, units = Texts(block, right), Units(block, right, buckets)
        # smallest id of each window of each string: the block's own occurrences, and what the buckets answered
        sizes = units.windows
        base = np.cumsum(sizes) - sizes
        smallest = np.repeat(units.least, sizes)  # over all blocks
        who = units.of_bucket()
        for bucket, r in answered(right, "shard").items():
            string, offset, best = columns_of(r["counts"], 3)
            at = base[who[bucket][string.astype(np.int64)]] + offset.astype(np.int64)
            smallest[at] = np.minimum(smallest[at], best)
        # windows of each occurrence that a smaller id has: +1 where one begins, -1 LENGTH bytes on
        cover = np.zeros(len(block.data) + LENGTH + 1, np.int32)
        n = sizes[units.of] if len(units.of) else np.empty(0, np.int64)
        pick = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = smallest[base[units.of[pick]] + step] < block.ids[units.docs[pick]] if len(pick) else np.zeros(0, bool)
        where = units.first[pick[hit]] + step[hit]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + LENGTH, -1)
        gone = np.cumsum(cover)[: len(block.data)] > 0
        out = []
        result_of: dict[int, tuple] = {}
        for k in range(len(block.sizes)):
            a, b = int(block.starts[k]), int(block.starts[k] + block.sizes[k])
            size = b - a
            if texts.copy[k] and size >= LENGTH:
                out.append((k, size, size, 1, b""))
            elif size < LENGTH:
                out.append((k, size, 0, 0, block.bytes[a:b]))
            elif not texts.skip[k]:
                mask = gone[a:b]
                runs = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
                row = (k, size, int(mask.sum()), runs, block.data[a:b][~mask].tobytes())
                result_of[int(texts.group[k])] = row[1:]
                out.append(row)
            else:  # the same id and text again
                out.append((k, *result_of[int(texts.group[k])]))
        rows = [{"doc_id": block.doc_ids[k], "n_bytes": s, "n_removed": r, "n_spans": n, "kept": hashlib.sha256(x).hexdigest().encode() if digest else x} for k, s, r, n, x in out]
        out = to_table(rows, RESULT)
        del block, right, texts, units, smallest, cover, gone, pick, step, hit, where, rows, result_of
        release()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, RESULT)


def deduplicate(docs: DataFrame, digest: bool = False, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """RESULT rows for all rows of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    # the exchanges of all steps are larger than the input; each step's go before the next one's are written
    with brief_shuffles(spark):
        blocks = bucketed(docs.mapInArrow(make_blocks, BLOCK), "bwt_blocks", "block", estimated_bytes(docs))
        size = blocks.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
        answers = store(text_answers(text_requests(blocks, buckets)), "bwt_texts")
        answers = answers.unionByName(store(anchor_answers(anchor_requests(blocks, answers, buckets), hot_blocks), "bwt_anchors"))
        answers = answers.unionByName(store(unit_answers(unit_requests(blocks, answers, buckets)), "bwt_units"))
        answers = answers.unionByName(store(shard_answers(shard_requests(blocks, answers, buckets)), "bwt_shards"))
    return kept_texts(blocks, answers, buckets, digest)


def op7_suffix_dedup(spark, sf_dir):
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
