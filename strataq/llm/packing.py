"""Best-fit packing with swap-based local search (operator 9).

Documents become pieces of at most CAPACITY tokens: only longer documents are cut, the first piece taking the remainder
(1 to CAPACITY tokens) and the others being full. Full pieces are sequences by themselves. All others are dealt at
random (by hash) into shards of about SHARD pieces, so every shard sees the corpus's mix of lengths and packs on its own:

1. best-fit decreasing: each piece goes to the fullest sequence with room for it;
2. local search over the underfull sequences: move a piece, exchange one for one, or exchange two for one, always so that
   the sum of squared fills grows. Fill gathers in some sequences until others run empty and vanish.

The search looks at every underfull sequence, every single piece and pair in it and every fuller sequence (their sizes are
sets of bits, so one shift compares all), and goes on until no step is left, the lower bound is met, or EFFORT shifts are
spent (a fixed amount of work, ten to fifteen seconds a shard, so that results don't depend on the machine). A shard can waste at
most what its last sequences leave open, a few parts in ten thousand at SHARD pieces; its memory doesn't depend on the
corpus. Only lengths travel, never token ids.

Defined results: a null or empty text is the end id alone (one token); a text of any length is cut whole; null ids, repeated
ids and repeated rows each get their own pieces; extra columns are ignored; an empty table gives an empty result. A piece's
shard follows from its id, place and ids alone, whatever the layout of the files; only pieces that repeat all three are told
apart by a row number, so that copies don't gather in one shard.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import shared_encoder, text_batches, with_end
from .scratch import materialize, ship

CAPACITY, SHARD, EFFORT, MAX_BROADCAST_KEYS = 2048, 40_000, 30_000_000, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_rows(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        import pyarrow as pa

        encoder = shared_encoder(vocab)
        for batch in text_batches(batches):
            ids, n = with_end(*encoder.encode([x or "" for x in batch.column("text").to_pylist()]))
            data = memoryview(ids.astype("<u4").tobytes())
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = n - (pieces - 1) * capacity
            start = np.where(k == 0, 0, first[doc] + (k - 1) * capacity)
            length = np.where(k == 0, first[doc], capacity)
            at = (np.cumsum(n) - n)[doc] + start
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class Bins:
    """Sequences under construction: for each open room, the sequences that have it and the sizes of their pieces."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # in the order they came
        self.mask = 0  # bit r: by_room[r] isn't empty
        self.sizes: dict[int, int] = {}  # room: bits of the sizes of pieces there, gathered when asked for
        self.effort = 0

    def _put(self, b: int, room: int) -> None:
        self.room[b] = room
        self.by_room[room][b] = None
        self.mask |= 1 << room
        self.sizes.pop(room, None)

    def _take(self, b: int) -> None:
        r = self.room[b]
        del self.by_room[r][b]
        if not self.by_room[r]:
            self.mask &= ~(1 << r)
        self.sizes.pop(r, None)

    def tightest(self, need: int) -> int:
        """The least room of at least `need` that a sequence has, or -1."""
        rest = self.mask >> need
        return need + (rest & -rest).bit_length() - 1 if rest else -1

    def best_fit(self, item: int) -> None:
        need = self.lengths[item]
        r = self.tightest(need)
        if r < 0:
            self.items.append([item])
            self.room.append(0)
            self._put(len(self.items) - 1, self.capacity - need)
            return
        b = next(iter(self.by_room[r]))
        self._take(b)
        self.items[b].append(item)
        self._put(b, r - need)

    def improve(self, most: int) -> bool:
        """One round of moves and exchanges over underfull sequences, emptiest first; True if the squared fill grew."""
        grew, size = False, self.lengths
        order = sorted((b for b in range(len(self.items)) if self.items[b] and self.room[b]), key=lambda b: -self.room[b])
        for b in order:
            if not self.items[b] or not self.room[b]:
                continue
            if self.effort > most:
                return False
            self._take(b)
            again = True
            while again and self.items[b]:
                again = False
                # moves out of b: every piece that fits into a sequence at least as full as b without it
                for i in sorted(self.items[b], key=lambda i: -size[i]):
                    r = self.tightest(size[i])
                    self.effort += 1
                    if 0 <= r < self.room[b] + size[i]:
                        to = next(iter(self.by_room[r]))
                        self._take(to)
                        self.items[to].append(i)
                        self._put(to, r - size[i])
                        self.items[b].remove(i)
                        self.room[b] += size[i]
                        grew = True
                if self.items[b] and self._exchange(b):
                    again = grew = True
            if self.items[b]:
                self._put(b, self.room[b])
            else:
                self.room[b] = self.capacity
        return grew

    def _sizes(self, room: int) -> int:
        """Bits of the sizes of all pieces in sequences with this room."""
        if room not in self.sizes:
            bits = 0
            for b in self.by_room[room]:
                for i in self.items[b]:
                    bits |= 1 << self.lengths[i]
            self.sizes[room] = bits
        return self.sizes[room]

    def _exchange(self, b: int) -> bool:
        """Gives one piece or two of b for a smaller piece of a fuller sequence, so that this one's room closes as far as it can.

        Of all such exchanges the one that leaves the least room open is made.
        """
        size = self.lengths
        mine = {size[i]: i for i in self.items[b]}  # pieces of one size are as good as each other
        twice = {s for s in mine if sum(size[i] == s for i in self.items[b]) > 1}
        ones = sum(1 << s for s in mine)
        both = 0  # sums of two pieces
        for s in mine:
            both |= (ones if s in twice else ones & ~(1 << s)) << s
        totals = (ones | both) & ((1 << (self.capacity + 1)) - 1)
        rest = self.mask & ((1 << (self.room[b] + 1)) - 1) & ~1  # sequences at least as full that still have room
        best = None
        while rest:
            r = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            there = self._sizes(r)
            for left in range(r if best is None else min(r, best[0])):
                self.effort += 1
                if meet := there << (r - left) & totals:
                    best = left, r, (meet & -meet).bit_length() - 1
                    break
            if best and best[0] == 0:
                break
        if best is None:
            return False
        left, r, total = best
        gain = r - left
        to, j = next((c, j) for c in self.by_room[r] for j in self.items[c] if size[j] == total - gain)
        if total in mine:
            give = [mine[total]]
        else:
            s = next(s for s in mine if total - s in mine and (total - s != s or s in twice))
            give = [mine[s], next(i for i in self.items[b] if size[i] == total - s and i != mine[s])]
        self._take(to)
        for i in give:
            self.items[b].remove(i)
            self.items[to].append(i)
        self.items[to].remove(j)
        self.items[b].append(j)
        self.room[b] += gain
        self._put(to, left)
        return True


def pack(lengths: list[int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[list[int]]:
    """Groups of positions in `lengths`, each of at most `capacity` in sum, as few as the search finds."""
    bins = Bins(lengths, capacity)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bins.best_fit(item)
    least = -(-sum(lengths) // capacity)
    while effort and sum(map(bool, bins.items)) > least and bins.improve(effort):
        pass
    return [x for x in bins.items if x]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = materialize(pieces, "pieces")  # counted and packed from one tokenization
    shards = max(1, round(pieces.filter(F.col("length") < capacity).count() / shard))
    # full pieces need no search; the others go by what they are, and only those that repeat by a row number too
    name = F.xxhash64("doc_id", "piece", "ids_crc32")
    rest = pieces.filter(F.col("length") < capacity).withColumn("_name", name)
    repeated = rest.groupBy("_name").agg(F.count("*").alias("_n")).filter("_n > 1").select("_name", F.lit(True).alias("_repeated"))
    if shards > 1:
        repeated = materialize(repeated, "repeated")
        repeated = F.broadcast(repeated) if repeated.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS else repeated
        rest = rest.withColumn("_row", F.monotonically_increasing_id()).join(repeated, "_name", "left")
        salt = F.when(F.col("_repeated"), F.xxhash64("_row")).otherwise(F.col("_name"))
        dealt = rest.withColumn("_shard", F.pmod(salt, F.lit(shards))).drop("_row", "_repeated", "_name")
    else:
        dealt = rest.withColumn("_shard", F.lit(0).cast("long")).drop("_name")
    full = pieces.filter(F.col("length") >= capacity)
    full = full.withColumns({"sequence_id": F.shiftleft(F.lit(1).cast("long"), 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})

    def fill(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_pylist()
        base = pc.max(table.column("_shard")).as_py() << 32
        order, ids, offsets = [], [], []
        for k, group in enumerate(pack(lengths, capacity)):
            at = 0
            for i in group:
                order.append(i)
                ids.append(base + k)
                offsets.append(at)
                at += lengths[i]
        return table.drop_columns(["_shard"]).take(pa.array(order, pa.int64())).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    packed = dealt.groupBy("_shard").applyInArrow(fill, f"{PIECES}, sequence_id long, offset long")
    return packed.unionByName(full)


def op9_best_fit_packing(spark, sf_dir):
    return pack_pieces(piece_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
