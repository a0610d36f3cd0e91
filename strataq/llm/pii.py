"""Personal data by bootstrapped contextual extraction (operator 10), DataFrame and SQL functions only.

Base kinds (email, ip, card, phone) are found by anchored regular expressions on the JVM. The offsets of a regular
expression's matches are running sums of the lengths of matches and of the gaps that splitting by it leaves. Beyond them,
bootstrapping looks for identifiers the base patterns don't know:

1. candidates: tokens of 6 or more letters, digits and hyphens with four digits or more, and the base matches themselves;
2. lexical pattern of a candidate: the two words before it, lower-cased, digits as 0; a match of the same expression before it
   counts as one word, its kind in angle brackets;
3. the graph of (pattern, instance) pairs over the whole corpus is scored in ROUNDS rounds: a pattern's score is the mean
   score of its distinct instances if at least SUPPORT of them are known entities, an instance's score is that of its
   best pattern (seeds keep 1);
4. candidates behind a pattern of score MIN_SCORE or more become spans of kind `ctx`, unless they overlap a base span.

The scan of the texts happens once, into a table of spans and candidates; the graph holds distinct pairs only, so neither
a hot pattern nor copies of a document enlarge it. All steps over a text's matches are running sums, maxima and minima,
taken in chunks, so a text's time grows in proportion to its length, but for 1 / CHUNK of the square of its matches.

Defined results: a null text is empty; a text of any length is scanned whole; null ids, repeated ids and rows keep their
rows; of spans that begin at one place the kind listed first comes first; equal scores are both trusted; extra columns are
ignored (`find`) or carried, whatever their names (`redact`); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

ROUNDS, SUPPORT, MIN_SCORE, CHUNK, MAX_INLINE = 3, 5, 0.7, 64, 10_000
KINDS = ("email", "ip", "card", "phone", "ctx")
# A match can't start inside a run of its own first class unless the last match ended there (\G), which keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
# only maximal runs of 12 to 19 digits; shorter and longer ones would fail the length test anyway
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9-])(?=[A-Za-z-]*+[0-9])[A-Za-z0-9-]{6,}+(?!@)"
DIGITS = "length(regexp_replace(m, '[^0-9]', ''))"
SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"
_LUHN = """pmod(aggregate(transform(sequence(1, length(d)), k ->
  transform(array(CAST(substr(d, length(d) - k + 1, 1) AS INT)), v -> IF(k % 2 = 1, v, IF(v > 4, 2 * v - 9, 2 * v)))[0]), 0, (a, b) -> a + b), 10) = 0"""
#: kind: (regular expression, cheap test of the text, test of the match m)
RULES = {
    "email": (EMAIL, "contains(_t, '@')", "true"),
    "ip": (IP, "_t RLIKE '[0-9]\\\\.[0-9]'", "forall(split(m, '\\\\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS INT), 0) <= 255)"),
    "card": (CARD, "_t RLIKE '[0-9][\\\\x20-]?[0-9]'", f"transform(array(regexp_replace(m, '[^0-9]', '')), d -> {_LUHN})[0]"),
    "phone": (PHONE, "contains(_t, '+')", f"{DIGITS} BETWEEN 9 AND 15"),
    "ctx": (TOKEN, "_t RLIKE '[0-9]'", f"{DIGITS} >= 4"),
}


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "array<struct<start:int,kind:int,end:int,m:string,ctx:string>>"


def let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(a: str, step) -> str:
    """SQL of the running results of step(x, y), which is associative, over an array of integers.

    An array can only grow by being copied; so runs of CHUNK values are taken apart, and what they begin with is added.
    """
    grow = lambda x, first: f"aggregate({x}, CAST(array() AS array<int>), (o, y) -> concat(o, array(IF(size(o) = 0, {first}, {step('element_at(o, -1)', 'y')}))))"
    runs = f"transform(sequence(0, (size(_a) - 1) div {CHUNK}), c -> {grow(f'slice(_a, c * {CHUNK} + 1, {CHUNK})', 'y')})"
    ends = grow("transform(_r, r -> element_at(r, -1))", "y")
    joined = f"flatten(transform(_r, (r, c) -> IF(c = 0, r, transform(r, x -> {step('_e[c - 1]', 'x')}))))"
    return let("_a", a, f"IF(size(_a) = 0, CAST(array() AS array<int>), {let('_r', runs, let('_e', ends, joined))})")


_sum = lambda x, y: f"{x} + {y}"
_max = lambda x, y: f"greatest({x}, {y})"
_min = lambda x, y: f"least({x}, {y})"


def matches(kind: str) -> str:
    """SQL of the spans of a kind in _t, in code points, with the matched text and the pattern before it."""
    pattern, cheap, valid = RULES[kind]
    p = _quote(pattern)
    # match k ends behind k + 1 gaps and matches
    ends = running("transform(_ms, (m, k) -> length(m) + length(_gs[k]))", _sum)
    words = f"filter(concat(IF(k > 0, array('<{kind}>'), array()), split(_gs[k], '{SPACE}')), w -> w <> '')"
    before = let("_w", words, "IF(size(_w) < 2, '', regexp_replace(lower(concat(_w[size(_w) - 2], ' ', _w[size(_w) - 1])), '[0-9]', '0'))")
    numbered = f"filter(transform(_ms, (m, k) -> IF({valid}, k, -1)), k -> k >= 0)"
    span = f"transform({numbered}, k -> struct(_es[k] - length(_ms[k]) AS start, {KINDS.index(kind)} AS kind, _es[k] AS end, _ms[k] AS m, {before} AS ctx))"
    found = let("_ms", f"regexp_extract_all(_t, {p}, 0)", let("_gs", f"split(_t, {p})", let("_es", ends, span)))
    return f"CAST(IF({cheap} AND _t RLIKE {p}, {found}, array()) AS {SPAN})"


def free_candidates() -> str:
    """SQL of the spans in _ctx that overlap none in base: in order of their starts, no base span begun so far reaches into
    them and the next one begins behind them."""
    both = "sort_array(concat(transform(base, s -> struct(s.start AS at, 0 AS cand, s.end AS to, s)), transform(_ctx, s -> struct(s.start AS at, 1 AS cand, s.end AS to, s))))"
    reach = running("transform(_v, e -> IF(e.cand = 0, e.to, 0))", _max)
    follow = f"reverse({running('reverse(transform(_v, e -> IF(e.cand = 0, e.at, 2147483647)))', _min)})"
    free = "transform(filter(sequence(0, size(_v) - 1), k -> _v[k].cand = 1 AND _x[k] <= _v[k].at AND _y[k] >= _v[k].to), k -> _v[k].s)"
    return f"CASE WHEN size(base) = 0 OR size(_ctx) = 0 THEN _ctx ELSE {let('_v', both, let('_x', reach, let('_y', follow, free)))} END"


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, base (sorted spans) and cand (spans that have two words before them): one pass over the texts."""
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    df = df.withColumns({f"_{k}": F.expr(matches(k)) for k in KINDS})
    df = df.withColumn("base", F.expr("sort_array(concat(_email, _ip, _card, _phone))")).withColumn("_free", F.expr(free_candidates()))
    cand = "filter(transform(concat(base, _free), s -> struct(s.start AS start, s.kind AS kind, s.end AS end, lower(s.m) AS inst, s.ctx AS ctx)), c -> c.ctx <> '')"
    return df.select(*keep, F.expr("transform(base, s -> struct(s.start, s.kind, s.end))").alias("base"), F.expr(cand).alias("cand"))


def trusted_patterns(scanned: DataFrame) -> DataFrame:
    """(ctx, score) of the patterns that bootstrapping trusts."""
    edges = scanned.select(F.explode("cand").alias("c")).select("c.ctx", "c.inst", (F.col("c.kind") < KINDS.index("ctx")).alias("seed"))
    # pairs are made distinct with map-side combining before they meet by pattern or by instance
    edges = materialize(edges.groupBy("ctx", "inst").agg(F.max("seed").alias("seed")), "pii-edges")
    # a pattern needs SUPPORT known instances in the end, so patterns with fewer instances can't matter; one without a seed
    # can, as other patterns may make its instances known
    wide = edges.groupBy("ctx").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).select("ctx")
    edges = materialize(edges.join(wide, "ctx", "left_semi").withColumn("s", F.col("seed").cast("double")), "pii-graph")
    patterns = None
    for _ in range(ROUNDS):
        patterns = edges.groupBy("ctx").agg(F.avg("s").alias("score"), F.sum((F.col("s") >= MIN_SCORE).cast("int")).alias("known"))
        patterns = materialize(patterns.filter(f"known >= {SUPPORT}").select("ctx", "score"), "pii-patterns")
        best = edges.join(patterns, "ctx").groupBy("inst").agg(F.max("score").alias("best"))
        edges = edges.join(best, "inst", "left").select("ctx", "inst", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("s"))
        edges = materialize(edges, "pii-graph")
    return patterns.filter(F.col("score") >= MIN_SCORE).select("ctx", "score")


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, base (array of spans) and more (array of ctx spans)."""
    scanned = materialize(scan(docs, keep).withColumn("_row", F.monotonically_increasing_id()), "pii-scan")
    good = materialize(trusted_patterns(scanned).select("ctx"), "pii-trusted")
    mine = f"c.kind = {KINDS.index('ctx')}"
    if good.limit(MAX_INLINE + 1).count() <= MAX_INLINE:
        # few patterns: each row keeps its own candidates, and nothing moves
        known = [r.ctx for r in good.collect()]
        more = F.filter("cand", lambda c: (c["kind"] == KINDS.index("ctx")) & (c["ctx"].isin(known) if known else F.lit(False)))
        out = scanned.withColumn("_more", more).withColumn("more", F.expr("sort_array(transform(_more, c -> struct(c.start, c.kind, c.end)))"))
        return out.drop("_row", "cand", "_more")
    cand = scanned.select("_row", F.explode("cand").alias("c")).filter(mine).withColumn("ctx", F.col("c.ctx")).join(good, "ctx", "left_semi")
    more = cand.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("c.start", "c.kind", "c.end"))).alias("more"))  # of one text
    out = scanned.drop("cand").join(more, "_row", "left")
    return out.withColumn("more", F.coalesce("more", F.expr("filter(base, s -> false)"))).drop("_row")


def _text_of(spans: str) -> str:
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.kind + 1)"
    return f"array_join(transform({spans}, s -> concat({names}, ':', s.start, ':', s.end)), ',')"


def redacted(text: str) -> str:
    """SQL of text with the spans in base and more replaced. Spans of two kinds can overlap: text is taken from the furthest
    end so far. A place in a text is found by counting from its beginning, so CHUNK spans share a part cut out once."""
    names = "element_at(array(" + ", ".join(f"'<{k}>'" for k in KINDS) + "), _s[k].kind + 1)"
    reach = running("transform(_s, s -> s.end)", _max)
    behind = "IF(k = 0, 0, _x[k - 1])"
    first = f"IF(c = 0, 0, _x[c * {CHUNK} - 1])"
    last = f"least((c + 1) * {CHUNK}, size(_s)) - 1"
    part = f"substr({text}, {first} + 1, _x[{last}] - {first})"
    piece = f"IF(_s[k].start >= {behind}, concat(substr(_p, {behind} - {first} + 1, _s[k].start - {behind}), {names}), '')"
    chunk = let("_p", part, f"array_join(transform(sequence(c * {CHUNK}, {last}), k -> {piece}), '')")
    whole = f"concat(array_join(transform(sequence(0, (size(_s) - 1) div {CHUNK}), c -> {chunk}), ''), substr({text}, element_at(_x, -1) + 1))"
    return f"IF(size(base) + size(more) = 0, {text}, {let('_s', 'sort_array(concat(base, more))', let('_x', reach, whole))})"


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; n_chars, where there is one, follows the text."""
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    out = find(work, ["_doc"]).withColumn("_new", F.expr(redacted("_doc.text")))
    columns = []
    for c in docs.columns:
        column = F.col(f"_doc.`{c}`")
        if c == "text":
            column = F.col("_new")
        elif c == "n_chars":
            column = F.when(F.col("_new").isNull() | column.isNull(), column).otherwise(F.length("_new").cast(docs.schema[c].dataType))
        columns.append(column.alias(c))
    return out.select(*columns)


def op10_pii_bootstrap(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    count = lambda k: F.expr(f"CAST(size(filter(base, s -> s.kind = {KINDS.index(k)})) AS BIGINT)").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(F.expr(_text_of("base")), 256).alias("base_sha256"), F.expr(_text_of("sort_array(concat(base, more))")).alias("spans"))
