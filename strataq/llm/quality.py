"""Quality rules with adaptive thresholds (operator 8), DataFrame and SQL functions only.

Every document gets whole-text measures. Each measure is summarised per language and source in a mergeable quantile
sketch: a log-linear histogram (values keep their five leading bits below the top one, so a quantile is off by at most
1/32), which is a plain map-side combined count and merges by adding counts. No cut-off is given in absolute terms; each
follows from the quantiles of its group:

    high = tail + spread * (tail - median)        low = (100 - tail)% quantile - spread * (median - that quantile)

`tail` is the quantile that still counts as normal (LEVELS: 90 % for symbols and word lengths, 99 % for repetition, which is
rarer) and `spread` says how far beyond it a document must lie. Quantiles and documents are compared as cells of the sketch. Small groups are shrunk towards what is known of larger
ones: quantiles are taken from the group's sketch with the sketch of its language and that of the whole corpus added, each
scaled to PRIOR documents. The verdicts come from a join with the thresholds.

Symbols are counted less two standard errors of their count, so that a handful of them in a short text is no rate.

Defined results: a null text counts as empty (no words, base_failed); a text of any length is measured whole; null language
or source is a group of its own; null ids, repeated rows and repeated ids each keep their row; extra columns pass through
`score` untouched, whatever their names, unless they clash with a measure's name or `kept`, in which case the result's wins;
an empty table gives an empty result. Documents of equal measures and group get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

PRIOR, MAX_BROADCAST_GROUPS = 25, 100_000
#: measure: (SQL of an integer, its level)
MEASURES = {
    "symbol_permille": ("greatest(n_symbols - CAST(ceil(2 * sqrt(n_symbols)) AS BIGINT), 0) * 1000 div greatest(word_chars, 1)", "bulk"),
    "dup_line_permille": ("n_dup_lines * 1000 div greatest(n_words, 1)", "rare"),
    "repeat_permille": ("n_repeat_words * 1000 div greatest(n_words, 1)", "rare"),
    "word_len_percent": ("word_chars * 100 div greatest(n_words, 1)", "both"),
}
#: level: (tail in percent, twice the spread, has a low fence)
LEVELS = {"bulk": (90, 8, False), "rare": (99, 1, False), "both": (90, 8, True)}
SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"
_COVER = """
transform(array(sort_array(transform(h, (x, i) -> struct(x, i)))), s ->
  transform(array(sort_array(filter(transform(s, (e, k) ->
      IF(coalesce(get(s, k - 1).x = e.x, false) OR coalesce(get(s, k + 1).x = e.x, false), e.i, -1)), p -> p >= 0))), p ->
    aggregate(transform(p, (q, k) -> least(5, coalesce(get(p, k + 1) - q, 5))), 0L, (a, b) -> a + b))[0])[0]
"""
_FIVE = ", ".join(f"g[i + {k}]" for k in range(5))
_REPEATS = f"""
transform(array(transform(_w, w -> xxhash64(w))), g ->
  transform(array(IF(size(g) >= 5, transform(sequence(0, greatest(size(g) - 5, 0)), i -> xxhash64({_FIVE})), array())), h ->
    CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {_COVER} END)[0])[0]
"""
_LINES = "filter(split(coalesce(text, ''), '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measure(docs: DataFrame) -> DataFrame:
    """docs with the base counts and the integer measures. Five-word windows are compared by 64-bit hashes of their words'
    hashes within one text."""
    names = {"_w", "_l", *BASE, *MEASURES}
    df = docs.drop(*[c for c in docs.columns if c.lower() in names])
    df = df.withColumn("_w", F.expr(f"array_remove(split(coalesce(text, ''), '{SPACE}'), '')")).withColumn("_l", F.expr(_LINES))
    df = df.withColumns(
        {
            "n_words": F.expr("CAST(size(_w) AS BIGINT)"),
            "word_chars": F.expr("CAST(length(array_join(_w, '')) AS BIGINT)"),
            "n_symbols": F.expr("CAST(regexp_count(coalesce(text, ''), '[#*$%&|<>]') AS BIGINT)"),
            "n_dup_lines": F.expr("CAST(size(_l) - size(array_distinct(_l)) AS BIGINT)"),
            "n_repeat_words": F.expr(_REPEATS),
        }
    ).drop("_w", "_l")
    df = df.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    return df.withColumns({name: F.expr(sql) for name, (sql, *_) in MEASURES.items()})


def _floor(v: str) -> str:
    """The smallest value of v's histogram cell."""
    return f"shiftleft(shiftright({v}, greatest(length(bin({v})) - 6, 0)), greatest(length(bin({v})) - 6, 0))"


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, cell, n): one mergeable histogram per language, source and measure."""
    pairs = ", ".join(f"struct('{m}' AS measure, {_floor(m)} AS cell)" for m in MEASURES)
    flat = measured.filter("NOT base_failed").select("lang", "source", F.expr(f"inline(array({pairs}))"))
    return flat.groupBy("lang", "source", "measure", "cell").agg(F.count("*").alias("n"))


def _by_level(pick) -> str:
    """SQL that gives each measure a number of its level."""
    return "CASE measure " + " ".join(f"WHEN '{m}' THEN {pick(LEVELS[level])}" for m, (_, level) in MEASURES.items()) + " END"


def thresholds(cells: DataFrame) -> DataFrame:
    """(_lang, _source, <measure>_low, <measure>_high) for every group of the sketch."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total = lambda *key: cells.groupBy("measure", *key).agg(F.sum("n").alias("total"))
    groups = cells.select("measure", "lang", "source").distinct()
    own = cells.select("measure", "lang", "source", "cell", exact("n").alias("own"))
    # the sketches of language and corpus are merges of the groups' and have at most a few hundred cells a measure
    lang = cells.groupBy("measure", "lang", "cell").agg(F.sum("n").alias("n"))
    corpus = cells.groupBy("measure", "cell").agg(F.sum("n").alias("n"))

    def meet(a, b, *key):
        """a joined with b by measure and key, where nulls are equal."""
        b = b.select(*[F.col(c).alias(f"_b_{c}") if c in ("measure", "lang") else F.col(c) for c in b.columns])
        return a.join(b, [F.col("measure") == F.col("_b_measure"), *(F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in key)])

    def spread_out(sketch, *key):
        """A sketch's cells for each group below it."""
        return meet(groups, sketch, *key).select("measure", "lang", "source", "cell", exact("n").alias("more"))

    none = F.lit(0).cast("decimal(38,0)")
    every = own.withColumns({"more_l": none, "more_c": none})
    every = every.unionByName(spread_out(lang, "lang").withColumnRenamed("more", "more_l").withColumns({"own": none, "more_c": none}))
    every = every.unionByName(spread_out(corpus).withColumnRenamed("more", "more_c").withColumns({"own": none, "more_l": none}))
    merged = every.groupBy("measure", "lang", "source", "cell").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("own", "more_l", "more_c")])
    merged = meet(merged, total("lang").withColumnRenamed("total", "_tl"), "lang").drop("_b_measure", "_b_lang")
    merged = meet(merged, total().withColumnRenamed("total", "_tc"))
    # own + PRIOR * more_l / _tl + PRIOR * more_c / _tc, in whole numbers
    weight = F.expr(f"CAST(own * _tl * _tc + {PRIOR} * more_l * _tc + {PRIOR} * more_c * _tl AS DECIMAL(38,0))")
    weighed = merged.select("measure", "lang", "source", "cell", weight.alias("weight"))
    cells_of = F.expr("sort_array(collect_list(struct(cell, weight)))")
    at = lambda p: F.expr(f"aggregate(_c, struct(CAST(0 AS DECIMAL(38,0)) AS seen, CAST(NULL AS BIGINT) AS v), (a, c) -> struct(CAST(a.seen + c.weight AS DECIMAL(38,0)) AS seen, IF(a.v IS NULL AND 100 * (a.seen + c.weight) >= ({p}) * _whole, c.cell, a.v) AS v), a -> a.v)")
    tail = _by_level(lambda x: x[0])
    found = weighed.groupBy("measure", "lang", "source").agg(F.sum("weight").cast("decimal(38,0)").alias("_whole"), cells_of.alias("_c"))
    found = found.select("measure", "lang", "source", at(tail).alias("tail"), at("50").alias("mid"), at(f"100 - {tail}").alias("foot"))
    twice = _by_level(lambda x: x[1])
    found = found.withColumns({"high": F.expr(f"tail + ({twice}) * (tail - mid) div 2"), "low": F.expr(f"foot - ({twice}) * (mid - foot) div 2")})
    wide = [F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in MEASURES for c in ("high", "low")]
    return found.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*wide)


def score(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """docs (or only its `carry` columns) with the measures and `kept`.

    The measured rows are written once, so texts are scanned a single time.
    """
    given = docs.columns if carry is None else carry
    # the input's columns travel as one, so that none of their names can meet a working column
    keep = [c for c in given if c.lower() not in {*BASE, *MEASURES, "kept"}]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), "text", "lang", "source")
    measured = materialize(measure(whole).drop("text"), "quality")
    fences = materialize(thresholds(sketch(measured)), "fences")
    # groups are languages times sources; broadcast them only while their number is small, else let the join shuffle
    if fences.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    bad = F.lit(False)
    for m, (_, level) in MEASURES.items():
        cell = F.expr(_floor(m))  # as the sketch sees it
        bad = bad | (cell > F.col(f"{m}_high"))
        bad = bad | (cell < F.col(f"{m}_low")) if LEVELS[level][2] else bad
    kept = ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))
    return joined.select(*[F.col(f"_doc.`{c}`").alias(c) for c in keep], *BASE, *MEASURES, kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rejected ones, columns unchanged."""
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), "text", "lang", "source")
    return score(work, ["_whole"]).filter("kept").select(*[F.col(f"_whole.`{c}`").alias(c) for c in docs.columns])


_MEASURE_SQL = ", ".join(f"{sql.replace(' div ', ' // ')} AS {name}" for name, (sql, *_) in MEASURES.items())
_CELL = "(({0} >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0))"
ORACLE = f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM w)
       WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
b AS (
  SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid LEFT JOIN ln ON ln.rid = w.rid),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_MEASURE_SQL} FROM b),
cells AS ({" UNION ALL ".join(f"SELECT lang, source, '{x}' AS measure, {_CELL.format(x)}::BIGINT AS cell FROM m WHERE NOT base_failed" for x in MEASURES)}),
sk AS (SELECT lang, source, measure, cell, count(*) AS n FROM cells GROUP BY ALL),
gr AS (SELECT DISTINCT measure, lang, source FROM sk),
ls AS (SELECT measure, lang, cell, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY measure, lang) AS total FROM sk GROUP BY measure, lang, cell),
cs AS (SELECT measure, cell, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY measure) AS total FROM sk GROUP BY measure, cell),
tl AS (SELECT DISTINCT measure, lang, total FROM ls),
tc AS (SELECT DISTINCT measure, total FROM cs),
ev AS (SELECT measure, lang, source, cell, n AS own, 0 AS ml, 0 AS mc FROM sk
       UNION ALL SELECT gr.measure, gr.lang, gr.source, cell, 0, n, 0 FROM gr JOIN ls ON gr.measure = ls.measure AND gr.lang IS NOT DISTINCT FROM ls.lang
       UNION ALL SELECT gr.measure, gr.lang, gr.source, cell, 0, 0, n FROM gr JOIN cs ON gr.measure = cs.measure),
me AS (SELECT ev.measure, ev.lang, ev.source, cell,
         sum(own)::HUGEINT * any_value(tl.total)::HUGEINT * any_value(tc.total)::HUGEINT + {PRIOR} * sum(ml)::HUGEINT * any_value(tc.total)::HUGEINT + {PRIOR} * sum(mc)::HUGEINT * any_value(tl.total)::HUGEINT AS weight
       FROM ev JOIN tl ON tl.measure = ev.measure AND tl.lang IS NOT DISTINCT FROM ev.lang JOIN tc ON tc.measure = ev.measure GROUP BY ev.measure, ev.lang, ev.source, cell),
cu AS (SELECT *, sum(weight) OVER (PARTITION BY measure, lang, source ORDER BY cell) AS seen, sum(weight) OVER (PARTITION BY measure, lang, source) AS total,
       {_by_level(lambda x: x[0])} AS tail FROM me),
q AS (SELECT measure, lang, source, min(cell) FILTER (100 * seen >= tail * total) AS tail, min(cell) FILTER (100 * seen >= 50 * total) AS mid,
      min(cell) FILTER (100 * seen >= (100 - tail) * total) AS foot FROM cu GROUP BY measure, lang, source),
g AS (SELECT measure, lang, source, tail + ({_by_level(lambda x: x[1])}) * (tail - mid) // 2 AS high, foot - ({_by_level(lambda x: x[1])}) * (mid - foot) // 2 AS low FROM q)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed,
  NOT m.base_failed AND NOT coalesce({" OR ".join(f"({_CELL.format(x)} > {x}_f.high" + (f" OR {_CELL.format(x)} < {x}_f.low" if LEVELS[level][2] else "") + ")" for x, (_, level) in MEASURES.items())}, false) AS kept
FROM m {" ".join(f"LEFT JOIN g {x}_f ON {x}_f.measure = '{x}' AND {x}_f.lang IS NOT DISTINCT FROM m.lang AND {x}_f.source IS NOT DISTINCT FROM m.source" for x in MEASURES)}
"""


def op8_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return score(docs, ["doc_id"]).select("doc_id", *BASE, "kept")
