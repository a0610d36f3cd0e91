"""SimHash near-duplicates through a Golay-code fuzzy hash (operator 6).

Fingerprints: every text's 4-word shingles (lower-cased A-Z) are hashed with XXH64, seed 42, and a bit is set where more
than half of the hashes have it. Equal fingerprints collapse to one row first, so groups of exact copies cost one row.

Links at MOST_BITS = 4 or fewer differing bits: 64 bits are cut into segments of 22, 21 and 21 bits. Two segments within
two bits of each other share one of the Golay codeword indices next to them or to their one-bit changes. By pigeonhole,

* either some segment is equal, and of the other two one has at most two errors: keys (segment i, near(segment j));
* or every segment has an error: two have just one, so each of them has an equal half, and the third at most two: keys
  (half of i, half of j, near(segment k)).

So no link is lost, with about a hundred keys of 34 bits for a fingerprint; unrelated fingerprints hardly ever share one.
Fingerprints that share a key meet in one shuffle and are compared exactly in numpy; only a spanning forest of their links
comes out, never all pairs. Where more than BLOCK fingerprints share a key, they are handed on instead as a stream, each
fingerprint once, to the next of LEVELS: within four bits of each other they agree on two of six parts, and if that is still
crowded on four of eight, and meet by these parts. So a hot key costs at most 15 and 70 rows for each of its fingerprints,
whatever their number. Fingerprints that agree even on 32 bits are swept in one task, at 8 bytes each; the sweep's time is
at worst the square of their number, but short where most of them are near each other.

Components are found by star steps over the link table in Spark.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer than four words are one
shingle; a text of any length is hashed whole; null ids stay rows, take part in linking and are never a component's id
unless the whole component has none; repeated ids and rows keep their rows; extra columns are ignored by `near_duplicates`
and carried by `keep_one`; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay, jaccard
from .bpe import text_batches
from .components import attach, components
from .scratch import materialize, ship

SHINGLE, MOST_BITS, BLOCK, LEAST_HOT, HOT = 4, 4, 4096, 1000, 10
#: (parts of 64 bits, parts that two fingerprints within four bits have in common)
LEVELS = ((6, 2), (8, 4))
#: (low bit, width) of the segments
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of one text."""
    from xxhash import xxh64_intdigest

    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(data)]
    if len(starts) > size:
        hashes = [xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends[size - 1 :])]
    else:
        hashes = [xxh64_intdigest(data, 42)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.array(hashes[k : k + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (without its text column) with fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]

    def hashed(batches):
        import pyarrow as pa

        for batch in text_batches(batches, "_text"):
            fps = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps.view(np.int64))], [*rest, "fp"])

    plain = docs.select(*rest, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "_text")
    return plain.mapInArrow(hashed, f"{kinds}, fp long")


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of distinct keys for each fingerprint (unsigned 64-bit)."""
    parts = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    halves = [(x & 0x7FF, x >> 11) for x in parts]
    near = []
    for x, (_, width) in zip(parts, SEGMENTS):
        index = np.sort(golay.nearby(x, width), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(new)
        near.append((row, index[row, column]))
    rows, keys, tag = [], [], 0
    for k, (row, index) in enumerate(near):
        i, j = (x for x in range(3) if x != k)
        heads = [parts[i], parts[j]] + [x << 11 | y for x in halves[i] for y in halves[j]]
        for head in heads:
            rows.append(row)
            keys.append(tag << 34 | head[row] << 12 | index)
            tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def part_keys(fps: np.ndarray, parts: int, equal: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys): a hash for each choice of `equal` of the `parts` of each fingerprint."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    values = [(fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in itertools.pairwise(cuts)]
    keys = []
    with np.errstate(over="ignore"):
        for tag, chosen in enumerate(itertools.combinations(range(parts), equal)):
            key = np.full(len(fps), tag + 1, np.uint64)
            for k in chosen:
                key = (key ^ values[k]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys.append(key)
    return np.tile(np.arange(len(fps)), len(keys)), np.concatenate(keys).view(np.int64)


def forest(every: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links that connect whatever links of at most `most` bits connect among distinct fingerprints.

    A breadth-first sweep: each fingerprint is compared with those not reached yet, so at most len - 1 links come out.
    """
    rest, out = every, []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            here = todo.pop()
            near = np.bitwise_count(rest ^ here) <= most
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(int(here), int(x)) for x in found]
                todo += list(found)
    return out


def meetings(fps: DataFrame, keys_of, block: int | None) -> DataFrame:
    """(a, b): links among fingerprints fp that share a key; (a, null): those of keys with more than `block` fingerprints."""

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(every), 20_000):
                rows, keys = keys_of(every[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(every[k : k + 20_000][rows].view(np.int64))], ["key", "fp"])

    def compare(batches):
        """Rows come sorted by key. At most `block` fingerprints of a key that goes on are held."""
        import pyarrow as pa

        rest, hot = np.empty((2, 0), np.int64), None

        def linked(rows, late):
            """Links of whole keys laid end to end, and the fingerprints that are handed on."""
            starts = np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] - 1 if rows.shape[1] else 0))
            sizes = np.diff(np.append(starts, rows.shape[1]))
            pairs = []
            for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                if block is not None and n > block:
                    late = np.concatenate([late, rows[1, a : a + n]])
                else:
                    pairs += forest(np.unique(rows[1, a : a + n].view(np.uint64)))
            pairs = np.unique(np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64), axis=0)
            late = np.unique(late)
            left, right = np.concatenate([pairs[:, 0], late]), np.concatenate([pairs[:, 1], late])
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right, mask=np.arange(len(right)) >= len(pairs))], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "fp")])
            late = np.empty(0, np.int64)
            if hot is not None and rows.shape[1]:  # more of a key whose first fingerprints are handed on
                more = int(np.searchsorted(rows[0], hot, "right"))
                late, rows = rows[1, :more], rows[:, more:]
                hot = hot if not rows.shape[1] else None
            rows = np.concatenate([rest, rows], axis=1)
            # the last key may go on in the next batch
            whole = int(np.searchsorted(rows[0], rows[0, -1], "left")) if rows.shape[1] else 0
            rows, rest = rows[:, :whole], rows[:, whole:].copy()
            if block is not None and rest.shape[1] > block:
                hot, late, rest = int(rest[0, 0]), np.concatenate([late, rest[1]]), rest[:, :0]
            yield linked(rows, late)
        if rest.shape[1]:
            yield linked(rest, np.empty(0, np.int64))

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return keys.mapInArrow(compare, "a long, b long").distinct()


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints fp."""
    ship(distinct.sparkSession)
    levels = [segment_keys, *(functools.partial(part_keys, parts=p, equal=e) for p, e in LEVELS)]
    found, todo = None, distinct
    for k, keys_of in enumerate(levels):
        met = materialize(meetings(todo, keys_of, block if k < len(LEVELS) else None), "simhash-links")
        mine = met.filter("b IS NOT NULL")
        found = mine if found is None else found.unionByName(mine)
        todo = met.filter("b IS NULL").select(F.col("a").alias("fp"))
        if todo.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    spark = docs.sparkSession
    rows = materialize(with_fingerprints(docs.select(F.col("doc_id").cast("long"), "text")), "fingerprints")
    of = materialize(component_of(rows), "component-ids")
    # fingerprints of very many rows (there can't be more than HOT for each partition) go to the rows, the others meet them
    most = max(LEAST_HOT, rows.count() // (HOT * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(of.filter(F.col("n") > most).drop("n"))
    rest = rows.join(hot.select("fp"), "fp", "left_anti").join(of.filter(F.col("n") <= most).drop("n"), "fp")
    return rows.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def component_of(rows: DataFrame) -> DataFrame:
    """(fp, component_id, n): one row for each distinct fingerprint, n its rows. Only fingerprints that have links meet by
    component."""
    first = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fps")
    of = components(links(first)).withColumnRenamed("node", "fp")
    of = materialize(of.join(first, "fp"), "fp-components")
    least = materialize(of.groupBy("component").agg(F.min("first_id").alias("component_id")), "least-ids")
    linked = attach(of.select("fp", "component"), least, "component").select("fp", F.col("component_id").alias("_id"))
    return first.join(linked, "fp", "left").select("fp", F.coalesce("_id", "first_id").alias("component_id"), "n")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of near-duplicates (the one of the smallest id; among repeated rows any one).

    Groups are those of jaccard.py: SimHash and Golay keys over five-word shingles, similarity 0.8 or more. The four words and four
    bits bind only op6.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(whole, "numbered")
    texts = rows.select("_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.text").alias("text"))
    first = jaccard.survivors(texts)
    return rows.join(first, "_row", "left_semi").select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op6_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
