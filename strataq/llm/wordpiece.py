"""Token counts by a linear longest-match automaton (operator 5).

Greedy longest-match-first word pieces of a word are counted without building them. The vocabulary is a trie in which a
marker edge leads from word-initial pieces to continuing ones. Every node has a failure link: where no edge goes on, the
pieces that longest match would pop are known beforehand, so only their number and the node that holds the rest of the
text are stored. Each character is read once; a word costs time linear in its length whatever the vocabulary.

The vocabulary here comes from a public byte-level one: pieces with a leading space start a word, all others continue one.
The space is a piece itself: a word that no longer piece starts is the space's piece and continuing ones.
Words that can't be cut into pieces count as one unknown piece.

Defined results: a null text is empty (no words, no pieces); repeated ids and rows keep their rows; extra columns are
ignored; an empty table gives an empty result. Words are runs of characters other than ASCII white space.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches, vocab_path
from .scratch import ship

CACHE_WORDS = 500_000


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def has_space(path: str | None = None) -> bool:
    """True if the vocabulary has the space alone as a piece."""
    with open(path or vocab_path(), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return any(byte_letters().get(piece) == 32 for piece in vocab)


def load_pieces(path: str | None = None) -> tuple[set[bytes], set[bytes]]:
    """(word-initial pieces, continuing pieces) as bytes."""
    with open(path or vocab_path(), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    pieces = [bytes(letters[c] for c in piece) for piece in vocab if all(c in letters for c in piece)]
    first = {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1}
    return first, {p for p in pieces if p[:1] != b" "}


class Counter:
    """count(word) -> number of greedy pieces, or 1 if some part of the word is in no piece.

    With `space`, a word may also start with the piece of the space alone, which holds none of its bytes.
    """

    def __init__(self, first: set[bytes], more: set[bytes], space: bool = False):
        # nodes 0 and 1 are the roots of word-initial and of continuing pieces
        edges: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, first), (1, more)):
            for piece in pieces:
                node = root
                for byte in piece:
                    nxt = edges[node].get(byte)
                    if nxt is None:
                        nxt = edges[node][byte] = len(edges)
                        edges.append({})
                        final.append(False)
                    node = nxt
                final[node] = True
        n = len(edges)
        fail, pops = [-1] * n, [0] * n
        if space:
            fail[0], pops[0] = 1, 1
        queue = [0, 1]
        for parent in queue:
            for byte, node in edges[parent].items():
                if final[node]:
                    fail[node], pops[node] = 1, 1
                else:
                    # the node's string isn't a piece: pop what its parent would pop, go on from there with this byte
                    z, k = fail[parent], pops[parent]
                    while z >= 0 and byte not in edges[z]:
                        k += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[node], pops[node] = edges[z][byte], k
                queue.append(node)
        self.edges, self.fail, self.pops = edges, fail, pops

    def count(self, word: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        node, n = 0, 0
        for byte in word:
            while (nxt := edges[node].get(byte)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        # the end of the word: pop all that is held until only the continuing root is left
        while node != 1:
            if node <= 0 and fail[node] < 0:
                return 1
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


@functools.lru_cache(2)
def shared_counter(path: str | None = None) -> Counter:
    return Counter(*load_pieces(path), has_space(path))


class Table(dict):
    """Words to counts, filled as words come."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.counter.count(word)
        return n


@functools.lru_cache(2)
def shared_table(path: str | None = None) -> Table:
    return Table(shared_counter(path))


def token_counts(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_pieces) for every row."""
    ship(docs.sparkSession)

    def counted(batches):
        import pyarrow as pa

        table = shared_table(vocab)
        for batch in text_batches(batches):
            if len(table) > CACHE_WORDS:
                table.clear()
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            n = [sum(map(table.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, words)), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_words", "n_pieces"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "doc_id long, n_words long, n_pieces long")


def op5_token_counts(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
