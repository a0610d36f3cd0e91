"""Katz backoff language model: counting, normalising and scoring without moving a text twice (operator 1).

The model. Lowest order: p(w) = (c(w) + 1) / (N + V + 1), which sums to one with one unseen word. Order n over a history h:

    p(w | h) = c*(h w) / c(h)             if c(h w) > 0
             = alpha(h) p(w | shorter h)  otherwise, alpha(h) = (1 - sum c* / c(h)) / (1 - sum p(w | shorter h))

with both sums over the words seen after h, so each history sums to one; c* is the Good-Turing count with Katz's
correction for c <= CUT, and c minus the discount of CUT above, so that some mass is always left. Histories begin with a
start mark, texts end with an end token; histories never seen leave everything to the shorter one.

The flow. Documents are cut into blocks of about BLOCK_BYTES of text. A block turns its text into word numbers once, and
these blocks are written as a table bucketed by block. All counting is request and answer: a block asks for its distinct
n-grams (64-bit hashes, sorted, packed) at the bucket that owns their range of hashes, the bucket adds up what all blocks
have, writes its part of the model table, and answers each block in the block's own order. A frequent n-gram costs a block
one entry whatever its count, so no key is hot. The first block that asks for an n-gram owns it and contributes to the
sums of its history, which are added up and answered the same way. With all answers at hand, a block evaluates the
recursion for each distinct n-gram and adds up per document. The model lives in tables partitioned by kind (`count` and
`alpha` parts by bucket); only totals and counts of counts (a few numbers for each bucket) reach the driver.

Hash collisions: n-grams are compared by 64 bits, so counts of n distinct n-grams are exact but for about n^2 / 2^65 pairs.

Defined results: a null or empty text is the end token alone; a null id counts as the text '' for the split; repeated ids
and rows are scored and counted each; a long text stays in one block; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partition import estimated_bytes
from .bpe import text_batches
from .packed import bucketed, columns_of, narrow, pack_sorted, requests, squeeze, store, swell, to_table, unpack_sorted
from .scratch import ship

CUT, BLOCK_BYTES, BUCKET_KEYS = 5, 15_000_000, 1_000_000
START, END = 0x5851F42D4C957F2D, b"\n"
BLOCK = "block long, doc_ids array<long>, held array<boolean>, n_tokens binary, vocab binary, tokens binary"
REQUEST = "bucket long, block long, keys binary, counts binary"
ANSWER = "kind string, bucket long, block long, keys binary, counts binary, totals array<long>"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xA0761D6478BD642F)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xE7037ED1A0B428DB)
        return x ^ x >> np.uint64(29)


class Words(dict):
    """Words of a block to their numbers."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def make_blocks(batches):
    """Arrow batches of (doc_id, held, text) to block rows."""
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    serial = 0

    def block(docs):
        nonlocal serial
        words, parts, sizes = Words({END: 0}), [], []
        for _, _, text in docs:
            found = (text or "").encode("utf-8", "surrogatepass").lower().split()
            parts.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            parts.append(np.zeros(1, np.uint32))
            sizes.append(len(found) + 1)
        tokens = np.concatenate(parts)
        # frequent words get small numbers, which compress well
        order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        vocab = np.array([xxh64_intdigest(w, 42) for w in words], np.uint64)[order]
        serial += 1
        row = {"block": (TaskContext.get().partitionId() << 24) + serial, "doc_ids": [d for d, _, _ in docs], "held": [h for _, h, _ in docs]}
        return to_table([row | {"n_tokens": squeeze(narrow(np.array(sizes, np.int64))), "vocab": squeeze(vocab), "tokens": squeeze(narrow(rank[tokens]))}], BLOCK).to_batches()[0]

    held, size = [], 0
    for batch in text_batches(batches):
        for doc in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text"))):
            held.append(doc)
            size += len(doc[2] or "")
            if size >= BLOCK_BYTES:
                yield block(held)
                held, size = [], 0
    if held:
        yield block(held)


class Block:
    """A block row at work: its tokens, histories and n-grams."""

    def __init__(self, row: dict, order: int):
        self.id, self.doc_ids, self.held_docs = row["block"], row["doc_ids"], np.array(row["held"], bool)
        self.sizes = swell(row["n_tokens"]).astype(np.int64)
        self.vocab, self.tokens = swell(row["vocab"]), swell(row["tokens"])
        self.held = np.repeat(self.held_docs, self.sizes)
        self.begin = np.zeros(len(self.tokens), bool)
        self.begin[np.cumsum(self.sizes) - self.sizes] = True
        self.order = order

    def history(self, n: int) -> np.ndarray:
        """Hash of the n - 1 tokens before each token, start marks in front."""
        out = np.full(len(self.tokens), np.uint64(START))
        word = self.vocab[self.tokens]
        for back in range(n - 1, 0, -1):
            # token `back` places before: a start mark where the text begins later than that
            before = np.full(len(word), np.uint64(START))
            before[back:] = word[:-back]
            near = self.begin.copy()
            for k in range(1, back):
                near[k:] |= self.begin[:-k]
            before[near] = np.uint64(START)
            out = before if back == n - 1 else mix(out, before)
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct keys of order n, each token's place among them, training counts)."""
        word = self.vocab[self.tokens]
        keys, place = np.unique(word if n == 1 else mix(self.history(n), word), return_inverse=True)
        return keys, place, np.bincount(place, weights=~self.held, minlength=len(keys)).astype(np.int64)


def count_requests(blocks: DataFrame, n: int, order: int, buckets: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                keys, _, counts = block.grams(n)
                yield from to_table(requests(block.id, keys, [narrow(counts)], buckets), REQUEST).to_batches()

    return blocks.mapInArrow(ask, REQUEST)


def count_answers(asked: DataFrame, n: int) -> DataFrame:
    """Adds up each bucket; rows of kind model (the bucket's part), answer (one for each block) and totals."""

    def add(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [unpack_sorted(r["keys"]) for r in rows]
        counts = [columns_of(r["counts"], 1)[0].astype(np.int64) for r in rows]
        flat = np.concatenate(keys)
        every, first, place = np.unique(flat, return_index=True, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
        owned = np.zeros(len(flat), bool)
        owned[first] = total > 0
        bucket, seen = rows[0]["bucket"], total > 0
        out = [{"kind": f"count{n}", "bucket": bucket, "keys": pack_sorted(every[seen]), "counts": squeeze(narrow(total[seen]))}]
        of_counts = np.bincount(np.minimum(total[seen], CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()
        out.append({"kind": f"totals{n}", "bucket": bucket, "totals": [int(total.sum()), int(seen.sum()), *of_counts]})
        at = 0
        for r, k in zip(rows, keys):
            mine = slice(at, at + len(k))
            # the lowest bit tells the owner
            out.append({"kind": f"answer{n}", "bucket": bucket, "block": r["block"], "counts": squeeze(narrow(total[place[mine]] * 2 + owned[mine]))})
            at += len(k)
        return to_table(out, ANSWER)

    return asked.groupBy("bucket").applyInArrow(add, ANSWER)


def discounts(n_r: list[int]) -> np.ndarray:
    """c* for c = 0 .. CUT from the counts of counts 1 .. CUT + 1: Good-Turing with Katz's correction.

    Uneven counts of counts are smoothed to a straight line in logarithms; where that fails too (tiny corpora), absolute
    discounting by n1 / (n1 + 2 n2) takes its place.
    """
    r = np.arange(1, CUT + 1)
    n = np.array(n_r, float)
    smooth = n
    if np.count_nonzero(n) > 1:
        x = np.flatnonzero(n) + 1
        slope, level = np.polyfit(np.log(x), np.log(n[x - 1]), 1)
        smooth = np.exp(level + slope * np.log(np.arange(1, CUT + 2)))
    for n in (n, smooth):
        if np.all(n > 0):
            common = (CUT + 1) * n[CUT] / n[0]
            star = r * (((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)) if common < 1 else np.zeros(CUT)
            if np.all(star > 0) and np.all(star < r) and np.all(np.diff(star) > 0):
                return np.concatenate([[0.0], star])
    cut = n_r[0] / (n_r[0] + 2 * n_r[1]) if n_r[0] and n_r[1] else 0.5
    return np.concatenate([[0.0], r - cut])


def discounted(counts: np.ndarray, star: np.ndarray) -> np.ndarray:
    """c* of counts."""
    return np.where(counts <= CUT, star[np.minimum(counts, CUT)], counts - (CUT - star[CUT]))


class Scored:
    """A block with its answers: the recursion over orders for every token."""

    def __init__(self, block: Block, answers: dict[str, list[bytes]], model: dict):
        self.block, self.model = block, model
        self.counts = {}
        self.alphas = {}
        for n in range(1, block.order + 1):
            if f"answer{n}" in answers:
                both = np.concatenate([swell(x) for x in answers[f"answer{n}"]]).astype(np.int64)
                self.counts[n] = both >> 1, (both & 1).astype(bool)
            if f"alpha{n}" in answers:
                self.alphas[n] = np.concatenate([swell(x) for x in answers[f"alpha{n}"]])
        self.at = {n: block.grams(n)[:2] for n in self.counts}

    def token_counts(self, n: int) -> np.ndarray:
        return self.counts[n][0][self.at[n][1]]

    def history_counts(self, n: int) -> np.ndarray:
        """c(h) of each token's history of order n: what the order below counts for it; start marks count training texts."""
        below, block = self.token_counts(n - 1), self.block
        out = np.empty(len(below), np.int64)
        out[1:] = below[:-1]
        out[block.begin] = self.model["texts"]
        return out

    def base(self) -> np.ndarray:
        return (self.token_counts(1) + 1.0) / (self.model["N"] + self.model["V"] + 1.0)

    def needs(self, n: int) -> np.ndarray:
        """Tokens whose history has a weight to ask for: seen history, unseen n-gram."""
        return (self.token_counts(n) == 0) & (self.history_counts(n) > 0)

    def log_p(self, n: int) -> np.ndarray:
        """log10 p(token | history) up to order n, for every token."""
        out = np.log10(self.base())
        for k in range(2, n + 1):
            count, below = self.token_counts(k), self.history_counts(k)
            seen = count > 0
            out[seen] = np.log10(discounted(count[seen], self.model["star"][k])) - np.log10(below[seen])
            needs = self.needs(k)
            keys, place = np.unique(self.block.history(k)[needs], return_inverse=True)
            out[needs] += np.log10(self.alphas[k])[place] if len(keys) else 0
        return out


def _answers(table) -> dict[str, list[bytes]]:
    out: dict[str, list] = {}
    for r in sorted(table.select(["kind", "bucket", "counts"]).to_pylist(), key=lambda r: (r["kind"], r["bucket"])):
        out.setdefault(r["kind"], []).append(r["counts"])
    return out


def weight_requests(blocks: DataFrame, answers: DataFrame, n: int, order: int, model: dict, buckets: int) -> DataFrame:
    """Each block's share of its histories' sums, and the histories whose weight it needs."""

    def ask(left, right):
        block = Block(left.to_pylist()[0], order)
        scored = Scored(block, _answers(right), model)
        history = block.history(n)
        # one token stands for each owned n-gram
        place, (count, owned) = scored.at[n][1], scored.counts[n]
        one = np.zeros(len(count), np.int64)
        one[place] = np.arange(len(place))
        one = one[owned]
        needs = scored.needs(n)
        keys, at = np.unique(np.concatenate([history[one], history[needs]]), return_inverse=True)
        mine = at[: len(one)]
        lower = 10 ** scored.log_p(n - 1)[one] if n > 2 else scored.base()[one]
        total = lambda w: np.bincount(mine, weights=w, minlength=len(keys))
        wanted = np.zeros(len(keys), np.uint8)
        wanted[at[len(one) :]] = 1
        columns = [narrow(total(count[owned]).astype(np.int64)), total(discounted(count[owned], model["star"][n])), total(lower), wanted]
        return to_table(requests(block.id, keys, columns, buckets), REQUEST)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, REQUEST)


def weight_answers(asked: DataFrame, n: int) -> DataFrame:
    def add(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [unpack_sorted(r["keys"]) for r in rows]
        columns = [columns_of(r["counts"], 4) for r in rows]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        count, star, lower = (np.bincount(place, weights=np.concatenate([c[k].astype(float) for c in columns]), minlength=len(every)) for k in range(3))
        with np.errstate(invalid="ignore", divide="ignore"):
            alpha = (1 - star / count) / (1 - lower)
        # 1 - lower is zero only if every known and the unknown word were seen after the history
        alpha = np.where(count > 0, np.clip(np.nan_to_num(alpha, nan=1.0, posinf=1.0), 1e-12, None), 1.0)
        bucket, known = rows[0]["bucket"], count > 0
        out, at = [{"kind": f"weights{n}", "bucket": bucket, "keys": pack_sorted(every[known]), "counts": squeeze(alpha[known])}], 0
        for r, k, c in zip(rows, keys, columns):
            out.append({"kind": f"alpha{n}", "bucket": bucket, "block": r["block"], "counts": squeeze(alpha[place[at : at + len(k)]][c[3] > 0])})
            at += len(k)
        return to_table(out, ANSWER)

    return asked.groupBy("bucket").applyInArrow(add, ANSWER)


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(blocks: DataFrame, answers: DataFrame, order: int, model: dict) -> DataFrame:
    def evaluate(left, right):
        import pyarrow as pa

        block = Block(left.to_pylist()[0], order)
        scored = Scored(block, _answers(right), model)
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        total = lambda w: np.bincount(doc, weights=w, minlength=len(block.sizes))
        known = total(scored.token_counts(1) > 0).astype(np.int64)
        columns = [block.doc_ids, block.held_docs, block.sizes, known, np.full(len(known), model["N"]), total(np.log10(scored.base())), total(scored.log_p(order))]
        return pa.table([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(columns)], names=[f.split(" ")[0] for f in SCORE.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(evaluate, SCORE)


def fit_and_score(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of all rows of docs (doc_id, text, held boolean) by the model of those that aren't held out."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "held", "text")
    blocks = bucketed(texts.mapInArrow(make_blocks, BLOCK), "katz_blocks", "block", estimated_bytes(texts))
    # entries bound the number of buckets: a block has no more n-grams than tokens, of which there are at most bytes / 2
    rows = blocks.select(F.size("doc_ids").cast("long").alias("d"), F.octet_length("tokens").alias("b")).agg(F.sum("d"), F.sum("b")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((rows[1] or 0) / BUCKET_KEYS) + 1)
    model: dict = {"star": {}, "N": 0, "V": 0, "texts": docs.filter("NOT held").count()}
    tables, answers = [], None
    for n in range(1, order + 1):
        table = store(count_answers(count_requests(blocks, n, order, buckets), n), f"katz_count{n}")
        totals = table.filter(F.col("kind") == f"totals{n}").select(*[F.sum(F.col("totals")[k]) for k in range(CUT + 3)]).first()
        totals = [int(x or 0) for x in totals]
        if n == 1:
            model["N"], model["V"] = totals[:2]
        model["star"][n] = discounts(totals[2:])
        tables.append(table.filter(F.col("kind") == f"answer{n}"))
        answers = tables[0]
        for t in tables[1:]:
            answers = answers.unionByName(t)
        if n > 1:
            table = store(weight_answers(weight_requests(blocks, answers, n, order, dict(model), buckets), n), f"katz_alpha{n}")
            tables.append(table.filter(F.col("kind") == f"alpha{n}"))
            answers = answers.unionByName(tables[-1])
    return score_blocks(blocks, answers, order, dict(model))


def op1_katz_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return fit_and_score(docs.withColumn("held", held))
