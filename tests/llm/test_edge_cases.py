"""Every operator on nulls in any column, empty and long texts, repeated rows and ids, empty tables, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataq.llm import decontaminate, katz, packing, pii, quality, secrets, simhash, substrings, tokenfile, wordpiece
from strataq.llm.scratch import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog and runs away from all of them " * 3000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 10), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 10),
    (2, None, "en", "a", None), (3, "", None, None, 0), (None, "word " * 20, "fr", None, 5), (None, None, None, None, None), (4, LONG, "de", "b", len(LONG)), (5, LONG + "x", "de", "b", 1),
    (6, " \t\n ", "de", "b", 4), (6, "a different text under the same id with mail joe@example.com and 10.1.2.3", "en", "c", 1), (7, "é\U0001f600 ß" * 40, "fr", "c", 3), (8, "x" * 100_000, "en", "c", 9),
]
#: names that the operators use inside, as extra columns of the input
CLASH = ["_doc", "_new", "_lang", "_source", "_text", "_whole", "_name", "_n", "_free", "cand", "ctx", "more", "component", "item_key", "_tie", "held", "a", "fp", "key", "n_words", "kept", "piece", "_t", "base", "block", "_shard", "_row", "start", "held_out"]


def docs(spark, rows=ROWS, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in CLASH}) if clash else df


def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (None, "short")], "item_id long, text string")


OPERATORS = {
    "katz": lambda s, d: katz.fit_and_score(d.withColumn("held", F.coalesce(F.col("doc_id") == 5, F.lit(False)))),
    "secrets": lambda s, d: secrets.scan(d),
    "leaks": lambda s, d: decontaminate.leaks(d, items(s)),
    "tokens": lambda s, d: tokenfile.read(tokenfile.write(d, fresh_path(s, "t"))),
    "pieces": lambda s, d: wordpiece.token_counts(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "substrings": lambda s, d: substrings.deduplicate(d),
    "quality": lambda s, d: quality.score(d),
    "packing": lambda s, d: packing.pack_pieces(packing.piece_rows(d)),
    "pii": lambda s, d: pii.find(d, ["doc_id"]),
}
ONE_EACH = set(OPERATORS) - {"leaks", "packing"}


def none_first(x):
    return (x[0] is not None, *map(str, x))


def by_row(rows, *columns):
    """The named columns of each row, in an order that has a place for null ids."""
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in rows), key=none_first)


def wanted(f):
    return sorted(((d, *f(d, t or "")) for d, t, *_ in ROWS), key=none_first)


def check_katz(out):
    assert by_row(out, "n_tokens", "held_out") == wanted(lambda d, t: (len(t.split()) + 1, d == 5))
    train = sum(len((t or "").split()) + 1 for d, t, *_ in ROWS if d != 5)
    assert all(r.train_tokens == train and r.score <= 0 and r.base_score < 0 and r.n_known <= r.n_tokens for r in out)
    assert len({(r.score, r.base_score) for r in out if r.doc_id == 1}) == 1  # repeated rows score alike


def check_secrets(out):
    assert by_row(out, "n_assign", "n_access", "n_hex", "spans") == wanted(lambda d, t: (0, 0, 0, ""))


def check_leaks(out):
    # "short" may have one edit; nothing here is within it
    assert [(r.doc_id, r.item_id, r.distance) for r in out] == [(1, 1, 0), (1, 1, 0)]


def check_tokens(out):
    from strataq.llm import bpe

    lib = bpe.WordEncoder().lib
    assert by_row(out, "n_tokens") == wanted(lambda d, t: (len(lib.encode(t, add_special_tokens=False).ids) + 1,))
    at = 0
    for r in sorted(out, key=lambda r: r.start):  # gapless, null ids first
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def check_pieces(out):
    assert by_row(out, "n_words") == wanted(lambda d, t: (len(t.split()),))


def check_simhash(out):
    blank = {r.component_id for r in out if r.fp == 0}
    assert blank == {2} and sum(r.fp == 0 for r in out) == 4  # null, empty and blank texts, with and without an id
    groups = {r.fp: r.component_id for r in out}
    assert {r.component_id for r in out if r.doc_id == 1} == {1} and {r.component_id for r in out if r.doc_id in (4, 5)} == {4}
    assert all(groups[r.fp] == r.component_id for r in out) and [r.component_id for r in out if r.doc_id is None and r.fp] == [None]


def check_substrings(out):
    size = lambda t: len(t.encode())
    assert by_row(out, "n_bytes") == wanted(lambda d, t: (size(t),))
    gone = {r.doc_id: (r.n_removed, r.n_spans) for r in out}
    assert gone[5] == (len(LONG), 1) and all(gone[d] == (0, 0) for d in (1, 2, 3, 4, 6, 7, 8, None))


def check_quality(out):
    assert by_row(out, "n_words", "word_chars") == wanted(lambda d, t: (len(t.split()), sum(map(len, t.split()))))
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 10)


def check_packing(out):
    from strataq.llm import bpe

    lib, total, fill = bpe.WordEncoder().lib, {}, {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want: dict = {}
    for d, t, *_ in ROWS:
        want[d] = want.get(d, 0) + len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    assert total == want
    for pieces in fill.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048


def check_pii(out):
    kinds = {r.doc_id: [(s.kind, s.start) for s in r.base] for r in out if r.base}
    text = ROWS[9][1]
    assert kinds == {6: [(0, text.index("joe@")), (1, text.index("10.1"))]} and all(r.more == [] for r in out)


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("clash", [False, True])
def test_hard_rows(spark, name, clash):
    out = OPERATORS[name](spark, docs(spark, clash=clash)).collect()
    if name in ONE_EACH:
        assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out) == sorted(r[0] if r[0] is not None else -1 for r in ROWS)
    globals()[f"check_{name}"](out)
    if clash and name == "quality":
        assert all(r._lang == "extra" and r.a == "extra" for r in out)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize("clash", [False, True])
def test_stages_keep_columns_and_survive_hard_rows(spark, tmp_path, clash):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    df = docs(spark, clash=clash)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
        out.collect()
    corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()


def test_stages_on_an_empty_table(spark, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), str(tmp_path)).collect() == []


def test_repeated_rows_leave_one(spark):
    kept = simhash.keep_one(docs(spark)).collect()
    assert sum(r.doc_id == 1 for r in kept) == 1
    assert len([r for r in kept if not (r.text or "").split()]) == 1  # null, empty and blank texts are one group
