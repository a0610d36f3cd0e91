"""Words whose first byte starts no word-initial piece begin with the piece of the space alone."""

import random

from strataq.llm import wordpiece


def slow_count(word, first, more):
    n, at, pieces = 0, 0, first
    while at < len(word) or pieces is first:
        stop = next((k for k in range(len(word), at - (pieces is first), -1) if word[at:k] in pieces), None)
        if stop is None:
            return 1
        n, at, pieces = n + 1, stop, more
    return n


def test_space_starts_a_word():
    rnd = random.Random(6)
    for _ in range(3000):
        piece = lambda: bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 4)))
        first, more = {piece() for _ in range(rnd.randint(0, 5))}, {piece() for _ in range(rnd.randint(0, 8))}
        counter = wordpiece.Counter(first, more, space=True)
        for word in (piece() + piece() for _ in range(5)):
            assert counter.count(word) == slow_count(word, first | {b""}, more), (word, first, more)


def test_words_of_many_scripts(spark):
    first, more = wordpiece.load_pieces()
    assert wordpiece.has_space()
    words = ["работа", "специальность", "上海自来水来自海上" * 20, "중국어", "丁一丂七", "한국", "tokens", "übung", "été"]
    found = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    for r in wordpiece.token_counts(found).collect():
        assert (r.n_words, r.n_pieces) == (1, slow_count(words[r.doc_id].encode(), first | {b""}, more))
    assert wordpiece.shared_counter().count(words[2].encode()) > 20
