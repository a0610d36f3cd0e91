"""Byte-level BPE encoding through the tokenizers library, one library call for each distinct word."""

from __future__ import annotations

import functools
import re

import numpy as np

VOCAB = "byte_bpe_50k.json"
CACHE_WORDS, RUN = 800_000, 256
#: Two white-space characters in a row: only there can a split at single spaces differ from the library's own split.
ODD = re.compile(r"\s\s")


def vocab_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """encode(texts) -> (ids of all texts, number of ids of each text), equal to the library's encode of each text.

    The vocabulary's splitting pattern always splits before a single space between two visible characters, so a text's
    ids are those of its space-led words one after another. Words are encoded once and looked up afterwards; a full table
    (CACHE_WORDS) takes no more words, and starts anew when it no longer knows half of a batch's words. Texts with two white-space characters in a row go to the library whole.
    """

    def __init__(self, path: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path or vocab_path())
        self.lib.encode_special_tokens = True
        vocab = self.lib.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, bool)  # ids whose piece starts with a space
        self.leads[[i for piece, i in vocab.items() if piece[0] == "\u0120"]] = True
        self.clear()

    def clear(self):
        class Table(dict):
            """Words to row numbers; unseen words get the next number and wait."""

            def __init__(table):
                table.rows, table.words = [], []

            def __missing__(table, word):
                table[word] = row = self.rows
                self.rows += 1
                table.rows.append(row)
                table.words.append(word)
                return row

        self.rows, self.flat = 0, [np.empty(0, np.uint32)]
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.led, self.first = Table(), Table()  # words behind a space, and words that begin a text

    def _add(self, rows: list[int], words: list[str], lead: str) -> None:
        """Encodes words that wait: space-led ones many in one call, told apart by their leading spaces."""
        ids = np.array(self.lib.encode(lead + lead.join(words), add_special_tokens=False).ids, np.uint32)
        starts = np.flatnonzero(self.leads[ids]) if len(words) > 1 else np.zeros(1, np.int64)
        if len(starts) != len(words):
            half = len(words) // 2
            self._add(rows[:half], words[:half], lead)
            self._add(rows[half:], words[half:], lead)
            return
        self.start[rows] = self.filled + starts
        self.size[rows] = np.diff(np.append(starts, len(ids)))
        self.flat.append(ids)
        self.filled += len(ids)

    def _settle(self) -> np.ndarray:
        if more := self.rows - len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.start, self.size))
            self.filled = len(self.flat[0])
            for table, lead, run in ((self.led, " ", RUN), (self.first, "", 1)):
                for k in range(0, len(table.rows), run):
                    self._add(table.rows[k : k + run], table.words[k : k + run], lead)
            self.flat = [np.concatenate(self.flat)]
        return self.flat[0]

    def _forget(self, rows: int, filled: int, looked_up: int) -> None:
        """Drops this batch's new words, or all of them if most words of the batch were new."""
        if 2 * (self.rows - rows) > looked_up:
            self.clear()
            return
        for table in (self.led, self.first):
            for word in table.words:
                del table[word]
        self.rows, self.start, self.size, self.flat = rows, self.start[:rows].copy(), self.size[:rows].copy(), [self.flat[0][:filled].copy()]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        before = self.rows, len(self.flat[0])
        words: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        whole = {}
        for k, text in enumerate(texts):
            if not text:
                continue
            if ODD.search(text):
                whole[k] = np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            first, *rest = text.split(" ")
            had = len(words)
            if first:
                words.append(self.first[first])
            words.extend(map(self.led.__getitem__, rest))
            counts[k] = len(words) - had
        flat = self._settle()
        rows = np.array(words, np.int64)
        sizes = self.size[rows]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = flat[np.repeat(self.start[rows] - upto[:-1], sizes) + np.arange(upto[-1])]
        last = np.cumsum(counts)
        n = upto[last] - upto[last - counts]
        if self.rows > CACHE_WORDS:
            self._forget(*before, len(words))
        for table in (self.led, self.first):
            table.rows, table.words = [], []
        if not whole:
            return ids, n
        parts, at = [], np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        for k in range(len(texts)):
            parts.append(whole[k] if k in whole else ids[at[k] : at[k + 1]])
            n[k] = len(parts[-1])
        return np.concatenate(parts) if parts else ids, n


@functools.lru_cache(1)
def shared_encoder(path: str | None = None) -> WordEncoder:
    """One encoder for each Python worker, so later tasks find the words of earlier ones."""
    return WordEncoder(path)


def with_end(ids: np.ndarray, n: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """ids with the end id after each text's, and the larger counts."""
    out = np.full(len(ids) + len(n), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, n + 1


def text_batches(batches, column: str = "text", most_bytes: int = 2_000_000):
    """Arrow batches cut to about most_bytes of text each (a single longer text stays whole)."""
    for batch in batches:
        sizes = np.cumsum(np.array([0] + [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + most_bytes, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
