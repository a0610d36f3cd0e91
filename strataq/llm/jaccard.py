"""Near-duplicates by exact Jaccard similarity of five-word shingles (the near-duplicate stage of the pipeline).

A text's set holds the 64-bit hashes of its SHINGLE-word windows (lower-cased A-Z); texts of fewer words are one shingle.
Equal sets collapse to one row first. Two sets are linked if their Jaccard similarity is SIMILAR or more; sets of fewer than
LEAST shingles have no such partner. The method is operator 6's, SimHash and the Golay code, with a radius that fits:

1. SimHash of 64 * LANES bits: a bit is one if more than half of the set's hashes have it. Lane 0 is the hash itself, the
   others are mixed from it. At similarity 0.8 two sets differ in 12 to 19 % of the bits, unrelated ones in about half.
2. Golay keys: the bits are cut into TABLES words of 23. A word is decoded as it is and with every choice of its SOFT least
   certain bits flipped, those whose count is nearest to half; each codeword index is a key. Two sets at similarity 0.8 share
   a key of one word in about 3 of 4 cases, and none at all with a probability under 1e-8 (`miss`), from simulated counts
   1e-6 for sets of four and five shingles, the smallest there are.
3. Fingerprints that share a key meet in one shuffle, dealt by word and size class; those that differ in MOST_BITS or fewer
   of 64 * CARRIED bits, and whose sizes allow the similarity, are linked to coarse groups by a spanning forest, so that no
   list of pairs is ever written.
4. Within each coarse group the texts are read again and compared exactly; only a spanning forest of the links comes out. A
   group of more than BLOCK sets is dealt into blocks, and every two blocks meet in a cell of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .bpe import text_batches
from .components import attach, components
from .scratch import materialize, ship

SHINGLE, SIMILAR, BLOCK, MAX_BROADCAST_ROWS = 5, (4, 5), 256, 100_000
LANES, CARRIED, TABLES, SOFT, MOST_BITS, LEAST, SWEEP, CELL = 6, 4, 16, 3, 80, 4, 2048, 2_000_000
_rng = np.random.default_rng(42)
FLIPS = _rng.integers(0, 2**64, LANES - 1, np.uint64)
FACTORS = _rng.integers(0, 2**64, LANES - 1, np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
PRINT = [f"f{k}" for k in range(CARRIED)]


def miss(similarity: float, trials: int = 20_000) -> float:
    """The probability that two sets of this similarity share no key, from simulated bit counts of two sets of 400."""
    rng, cosine = np.random.default_rng(7), 2 * similarity / (1 + similarity)
    one, other = rng.normal(0, 20, (2, trials, 1, golay.N))
    left, right = (golay_indices(x)[:, 0] for x in (one, cosine * one + np.sqrt(1 - cosine**2) * other))
    return float(1 - (left[:, :, None] == right[:, None, :]).any((1, 2)).mean()) ** TABLES


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text without words has one."""
    from xxhash import xxh64_intdigest

    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)]
    if len(starts) <= size:
        return np.array([xxh64_intdigest(data, 42)], np.uint64)
    return np.unique(np.array([xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends[size - 1 :])], np.uint64))


def excess(found: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint how far the set's hashes that have it exceed one half: positive where the bit is one."""
    lanes = np.empty((len(found), LANES), "<u8")
    lanes[:, 0] = found
    with np.errstate(over="ignore"):
        mixed = (found[:, None] ^ FLIPS) * FACTORS
        mixed = (mixed ^ mixed >> np.uint64(29)) * MIX
    lanes[:, 1:] = mixed ^ mixed >> np.uint64(32)
    total = np.zeros(64 * LANES, np.int64)
    for k in range(0, len(found), 255):  # so many ones fit a byte
        bits = np.unpackbits(lanes[k : k + 255].view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.uint8)
    return 2 * total - len(found)


def golay_indices(over: np.ndarray) -> np.ndarray:
    """The codeword indices (last axis, 2**SOFT of them) of words given by their bits' excesses (last axis)."""
    words = (over > 0) @ (1 << np.arange(golay.N, dtype=np.int64))
    # of bits as near to half, ones go first, so that two sets choose alike
    least = 1 << np.argsort(np.abs(2 * over - 1), axis=-1, kind="stable")[..., :SOFT].astype(np.int64)
    chosen = (np.arange(1 << SOFT)[:, None] >> np.arange(SOFT)) & 1
    return golay.decode(words[..., None] ^ least @ chosen.T)


def sketches(over: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints of CARRIED longs, ends of each row's keys, distinct keys of 16 bits) of rows of excesses."""
    prints = np.packbits(over[:, : 64 * CARRIED] > 0, axis=1, bitorder="little").view("<i8")
    index = golay_indices(over[:, : golay.N * TABLES].reshape(-1, TABLES, golay.N))
    every = np.sort((index + (np.arange(TABLES)[:, None] << golay.K)).reshape(len(over), -1), axis=1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    return prints, np.cumsum(new.sum(1)), every[new].astype(np.uint16).view(np.int16)


def keys(found: np.ndarray) -> np.ndarray:
    """The Golay keys of a set."""
    return sketches(excess(found)[None])[2]


def with_sets(texts: DataFrame) -> DataFrame:
    """(_row, doc_id, digest, size, f0.., keys) of (_row, doc_id, text): digest is 128 bits that tell a set from all others."""
    ship(texts.sparkSession)
    names = ["_row", "doc_id", "digest", "size", *PRINT, "keys"]

    def hashed(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for whole in text_batches(batches):
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                over, sizes, digests = np.empty((batch.num_rows, 64 * LANES), np.int64), [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    found = shingles(text)
                    over[row] = excess(found)
                    sizes.append(len(found))
                    digests.append(xxh3_128_digest(found.tobytes()))
                prints, ends, flat = sketches(over)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
                columns = [pa.array(sizes, pa.int64()), *(pa.array(x.copy()) for x in prints.T), lists]
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(digests, pa.binary()), *columns], names)

    kinds = ", ".join(f"{f} long" for f in PRINT)
    return texts.select("_row", "doc_id", "text").mapInArrow(hashed, f"_row long, doc_id long, digest binary, size long, {kinds}, keys array<short>")


def close(sizes: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Places of the fingerprints that have another within MOST_BITS, of a size that allows the similarity; sizes ascend."""
    near, ends = np.zeros(len(sizes), bool), np.searchsorted(sizes * SIMILAR[0], sizes * SIMILAR[1], "right")
    for a in range(0, len(sizes), 64):
        b = min(a + 64, len(sizes))
        bits = sum(np.bitwise_count(x[a:b, None] ^ x[None, a : ends[b - 1]]).astype(np.uint16) for x in prints)
        row, column = np.nonzero(np.triu(bits <= MOST_BITS, 1))
        fits = column + a < ends[row + a]
        near[row[fits] + a] = near[column[fits] + a] = True
    return np.flatnonzero(near)


def sweep(sizes: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
    """Links, by place, that connect whatever `close` pairs connect; sizes ascend, prints has one row for each long.

    A breadth-first sweep: a fingerprint is compared with those of a fitting size that are not reached yet, so at most
    len - 1 links come out, and a large group of near copies takes few passes.
    """
    at = close(sizes, prints) if len(sizes) <= SWEEP else np.arange(len(sizes))
    rest, size, left, out = at, sizes[at], prints[:, at], []
    while len(rest) > 1:
        todo = [(rest[0], size[0], left[:, 0])]
        rest, size, left = rest[1:], size[1:], left[:, 1:]
        while todo and len(rest):
            here, n, mine = todo.pop()
            a, b = np.searchsorted(size, [-(-n * SIMILAR[0] // SIMILAR[1]), n * SIMILAR[1] // SIMILAR[0] + 1])
            near = a + np.flatnonzero(np.bitwise_count(left[:, a:b] ^ mine[:, None]).sum(0, dtype=np.uint16) <= MOST_BITS)
            if len(near):
                out += [(here, x) for x in rest[near]]
                todo += zip(rest[near], size[near], left[:, near].T)
                stay = np.ones(len(rest), bool)
                stay[near] = False
                rest, size, left = rest[stay], size[stay], left[:, stay]
    return out


def least_linked(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the least place that the pairs (a row each) connect it with."""
    least = np.arange(n)
    while len(pairs):
        before = least.copy()
        here = least[pairs].min(1)
        for side in pairs.T:
            np.minimum.at(least, least[side], here)
            np.minimum.at(least, side, here)
        least = least[least]
        if (least == before).all():
            break
    return least


def deal(nodes: DataFrame, ranges: int) -> DataFrame:
    """(cell, _row, size, f0.., keys): sets dealt by the word of their keys, one of `ranges` of its indices, and size class.

    A size class ends at a power of four; a set that similar ones of the next class may exceed goes there too.
    """

    def dealt(batches):
        import pyarrow as pa

        ends, per = 4 ** np.arange(1, 31, dtype=np.int64), 1 << golay.K
        for batch in batches:
            held = batch.column("keys")
            rows, flat = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy())), held.flatten().to_numpy().view(np.uint16).astype(np.int64)
            part = (flat >> golay.K) * ranges + flat % per * ranges // per
            starts = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
            at, size = rows[starts], batch.column("size").to_numpy()[rows[starts]]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), held.flatten())
            rest = [batch.column(c).take(pa.array(at)) for c in ("_row", "size", *PRINT)]
            own, above = np.searchsorted(ends, size, "right"), np.searchsorted(ends, size * SIMILAR[1] // SIMILAR[0], "right")
            for level, some in ((own, None), (above, above > own)):
                cells = pa.array(level * (TABLES * ranges) + part[starts])
                out = pa.RecordBatch.from_arrays([cells, *rest, lists], ["cell", "_row", "size", *PRINT, "keys"])
                yield out if some is None else out.filter(pa.array(some))

    kinds = ", ".join(f"{f} long" for f in PRINT)
    plain = nodes.filter(F.col("size") >= LEAST).select("_row", "size", *PRINT, "keys")
    return plain.mapInArrow(dealt, f"cell long, _row long, size long, {kinds}, keys array<short>")


def candidates(nodes: DataFrame, most: int = CELL) -> DataFrame:
    """(a, b): links that connect the distinct sets (_row, size, f0.., keys) that share a Golay key and are `close`.

    Each cell links its sets to the least of their group, so that cells that find the same group give the same links. Beyond
    `most` sets the cells' number grows with that of the sets.
    """

    def compare(batches):
        """Rows come sorted by cell and size; one cell's rows are held."""
        import pyarrow as pa

        def linked(parts):
            rows, flat, counts = (np.concatenate(x, axis=-1) for x in zip(*parts))
            order = np.argsort(flat, kind="stable")
            at, flat = np.repeat(np.arange(len(counts)), counts)[order], flat[order]
            sizes, prints, pairs = rows[2], rows[3:].view(np.uint64), [np.empty((0, 2), np.int64)]
            for group in np.split(at, np.flatnonzero(np.diff(flat)) + 1):
                if len(group) > 1 and (found := sweep(sizes[group], prints[:, group])):
                    pairs.append(group[np.array(found)])
            least = least_linked(np.concatenate(pairs), len(counts))
            more = np.flatnonzero(least != np.arange(len(counts)))
            return pa.RecordBatch.from_arrays([pa.array(rows[1][more]), pa.array(rows[1][least[more]])], ["a", "b"])

        held, cell = [], None
        for batch in batches:
            every = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
            cuts = [0, *(np.flatnonzero(np.diff(every[0])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and every[0, a] != cell:
                    yield linked(held)
                    held = []
                cell, lists = every[0, a], batch.columns[-1].slice(a, b - a)
                held.append((every[:, a:b], lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())))
        if held:
            yield linked(held)

    n, ranges = nodes.count(), 1
    while ranges * most < n and ranges < 1 << golay.K:
        ranges *= 2
    dealt = deal(nodes, ranges).repartition("cell").sortWithinPartitions("cell", "size", "_row")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect whatever pairs of similarity SIMILAR or more connect, by place in the list.

    A breadth-first sweep; one pass over all hashes counts what a set shares with every other.
    """
    sizes = np.array(list(map(len, sets)), np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts, marked = np.cumsum(sizes) - sizes, np.zeros(len(names), bool)
    left, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo and left.any():
            here = todo.pop()
            mine = flat[starts[here] : starts[here] + sizes[here]]
            marked[mine] = True
            both = np.add.reduceat(marked[flat], starts, dtype=np.int64)
            marked[mine] = False
            found = np.flatnonzero(left & (both * SIMILAR[1] >= (sizes + sizes[here] - both) * SIMILAR[0]))
            left[found] = False
            out += [(here, x) for x in found.tolist()]
            todo += found.tolist()
    return out


def links(rows: DataFrame, coarse: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning set of the links within coarse groups (node, component); rows holds the texts of nodes by _row."""
    coarse = materialize(coarse, "coarse")
    sizes = materialize(coarse.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "group-sizes")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = materialize(attach(coarse, sizes, "component").select(F.col("node").alias("_row"), "component", "blocks", mine.alias("_mine")), "members")
    members = F.broadcast(members) if members.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else members
    meet = F.expr("IF(blocks = 1, array(0), transform(sequence(0, blocks - 1), o -> least(o, _mine) * blocks + greatest(o, _mine)))")
    dealt = rows.join(members, "_row").select("_row", "text", "component", F.explode(meet).alias("cell"))
    dealt = dealt.withColumn("deal", F.xxhash64("component", "cell")).repartition("deal").sortWithinPartitions("component", "cell")

    def compare(batches):
        """Rows come sorted by (component, cell); a cell has at most about two blocks of texts."""
        import pyarrow as pa

        def linked(nodes, sets):
            pairs = np.array([(nodes[a], nodes[b]) for a, b in forest(sets)], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        cell, nodes, sets = None, [], []
        for batch in text_batches(batches):
            for at, node, text in zip(zip(*(batch.column(c).to_pylist() for c in ("component", "cell"))), batch.column("_row").to_pylist(), batch.column("text").to_pylist()):
                if at != cell and nodes:
                    yield linked(nodes, sets)
                    nodes, sets = [], []
                cell = at
                nodes.append(node)
                sets.append(shingles(text))
        if nodes:
            yield linked(nodes, sets)

    return dealt.select("component", "cell", "_row", "text").mapInArrow(compare, "a long, b long").distinct()


def survivors(rows: DataFrame) -> DataFrame:
    """(_row): one row of (_row, doc_id, text) for each group of near-duplicates, the one of the smallest id."""
    sets = materialize(with_sets(rows), "shingle-sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row", "size", *PRINT, "keys")).alias("least")
    nodes = materialize(sets.groupBy("digest").agg(least).select("least.*"), "distinct-sets")
    coarse = components(candidates(nodes))
    of = components(links(rows, coarse)).withColumnRenamed("node", "_row")
    of = nodes.select("no_id", "doc_id", "_row").join(of, "_row", "left").withColumn("component", F.coalesce("component", "_row"))
    return of.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "_row")).alias("best")).select("best._row")
