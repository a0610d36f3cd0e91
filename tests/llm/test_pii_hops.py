"""Bootstrapping that reaches a context only through instances that another context made known."""

from strataq.llm import pii


def test_pattern_without_seeds_is_induced(spark):
    ids = [f"ab-k{k:05d}" for k in range(6)]
    texts = [f"please call me +49301234{k:04d} today" for k in range(20)] + [f"please call me {x} today" for x in ids]
    hop = [f"the account no {x} is open" for x in [*ids, "zz-999999"]]
    far = [f"the locker no zz-99{k:04d} is shut" for k in range(7)]  # nothing ever makes these known
    df = spark.createDataFrame(list(enumerate(texts + hop + far)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.more] for r in pii.find(df, ["doc_id"]).collect()}
    for k, text in enumerate(hop, len(texts)):
        at = text.index("no ") + 3
        assert found[k] == [(at, at + 9)]
    assert all(found[k] == [] for k in range(len(texts) + len(hop), len(found)))
