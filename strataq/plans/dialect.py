"""Rewrites of SQL text where a function's meaning differs from Spark's. Quoted text and comments stay as they are."""

from __future__ import annotations

import re
from collections.abc import Callable

TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z_0-9]*|\s+|.""", re.DOTALL)


def tokens(sql: str) -> list[str]:
    return TOKEN.findall(sql)


def _substring(a: list[str]) -> str:
    s, start = a[:2]
    rest = a[2] if len(a) > 2 else f"length({s})"
    return f"substring({s}, greatest({start}, 1), {rest})"


def _date_part(a: list[str]) -> str:
    part, d = a[0].strip().strip("'").lower(), a[1]
    when = f"to_timestamp({d})"
    return {"dow": f"(dayofweek({when}) - 1)", "dayofweek": f"(dayofweek({when}) - 1)", "second": f"second({when})", "doy": f"dayofyear({when})", "dayofyear": f"dayofyear({when})"}.get(part, f"date_part('{part}', {when})")


def _extract(a: list[str]) -> str:
    part, _, d = a[0].strip().partition(" ")
    return _date_part([part, re.sub(r"^\s*from\s+", "", d, flags=re.IGNORECASE)])


_both = lambda op: lambda a: f"(CAST({a[0]} AS DOUBLE) {op} CAST({a[1]} AS DOUBLE))"
#: function: text of the call from the texts of its arguments
CALLS: dict[str, Callable[[list[str]], str]] = {
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    "substring": _substring,
    "substr": _substring,
    "trim": lambda a: f"regexp_replace({a[0]}, '^\\\\s+|\\\\s+$', '')" if " from " not in a[0].lower() else f"trim({a[0]})",
    "btrim": lambda a: f"regexp_replace({a[0]}, '^\\\\s+|\\\\s+$', '')",
    "ltrim": lambda a: f"regexp_replace({a[0]}, '^\\\\s+', '')",
    "rtrim": lambda a: f"regexp_replace({a[0]}, '\\\\s+$', '')",
    "now": lambda a: "date_format(now(), 'yyyy-MM-dd HH:mm:ss')",
    "date_part": _date_part,
    "extract": _extract,
    "add": _both("+"),
    "subtract": _both("-"),
    "multiply": _both("*"),
    "divide": lambda a: f"try_divide(CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE))",
    "modulo": lambda a: f"try_mod(CAST({a[0]} AS BIGINT), CAST({a[1]} AS BIGINT))",
}


def _call(parts: list[str], k: int, calls: dict) -> tuple[str, int]:
    """The rewritten call whose name is parts[k], and where the rest begins."""
    at = k + 1
    while parts[at].isspace():
        at += 1
    depth, args, here = 0, [], []
    while at < len(parts):
        t = parts[at]
        depth += (t == "(") - (t == ")")
        if depth == 0:
            break
        if t == "," and depth == 1:
            args.append(here)
            here = []
        elif not (t == "(" and depth == 1):
            here.append(t)
        at += 1
    args.append(here)
    texts = [rewrite("".join(a), calls).strip() for a in args]
    return calls[parts[k].lower()]([x for x in texts if x]), at + 1


def rewrite(sql: str, calls: dict | None = None) -> str:
    calls = CALLS if calls is None else calls
    parts, out, k = tokens(sql), [], 0
    while k < len(parts):
        name, after = parts[k].lower(), next((t for t in parts[k + 1 :] if not t.isspace()), "")
        if name in calls and after == "(" and (k == 0 or parts[k - 1] != "."):
            text, k = _call(parts, k, calls)
            out.append(text)
        else:
            out.append(parts[k])
            k += 1
    return "".join(out)


AGGREGATES = {"count", "sum", "avg", "min", "max"}
ENDS = {"null", "true", "false", "end"}


def _automatic(item: list[str]) -> str | None:
    """The name of an unnamed select item; None for those that keep Spark's (columns, stars, constants) or have one."""
    low = [t.lower() for t in item]
    word = re.compile(r"[A-Za-z_]\w*|`[^`]*`|\"[^\"]*\"")
    if not item or all(word.fullmatch(t) or t in ".*" for t in item) and (len(item) == 1 or "." in item):
        return None
    if len(item) > 1 and word.fullmatch(item[-1]) and low[-1] not in ENDS and (low[-2] == "as" or item[-2] in ")']" or word.fullmatch(item[-2]) or item[-2][0] in "'0123456789"):
        return None  # named, with AS or without
    if all(re.fullmatch(r"[\d.+-]|'.*'", t, re.DOTALL) for t in item):
        return None  # constants
    if low[0] == "case":
        return "case_expr"
    if low[0] == "(" and len(low) > 1 and low[1] == "select" and item[-1] == ")":
        return "subquery"
    depth, closed = 0, None
    for k, t in enumerate(item):
        depth += (t == "(") - (t == ")")
        if t == ")" and depth == 0:
            closed = k
            break
    if len(item) > 2 and word.fullmatch(item[0]) and item[1] == "(" and closed is not None and (closed == len(item) - 1 or low[closed + 1] == "over"):
        argument = item[2:closed]
        if low[0] in AGGREGATES and argument != ["*"] and all(word.fullmatch(t) or t == "." for t in argument):
            return f"{low[0]}_{argument[-1].strip('`')}"
        return low[0]
    return "expr"


def named(sql: str) -> str:
    """Gives the unnamed items of the outermost select list names: count, sum_<column>, a function's name, case_expr,
    subquery or expr. An aggregate's name that comes again gets _2, _3 and so on."""
    parts, depth, k = tokens(sql), 0, 0
    while k < len(parts) and not (depth == 0 and parts[k].lower() == "select"):
        depth += (parts[k] == "(") - (parts[k] == ")")
        k += 1
    if k == len(parts):
        return sql
    start, items, here, at = k + 1, [], [], k + 1
    rest = [t.lower() for t in parts[start:] if t.strip()]
    if rest[:1] and rest[0] in ("distinct", "all"):
        start = at = next(j for j in range(start, len(parts)) if parts[j].lower() == rest[0]) + 1
    while at < len(parts):
        t = parts[at]
        depth += (t == "(") - (t == ")")
        if depth < 0 or depth == 0 and t.lower() in ("from", "union", "intersect", "except", "where", "order", "limit", "group", "having", ";"):
            break
        if depth == 0 and t == ",":
            items.append(here)
            here = []
        else:
            here.append(t)
        at += 1
    items.append(here)
    out, seen = [], {}
    for item in items:
        name = _automatic([t for t in item if t.strip() and not t.startswith(("--", "/*"))])
        text = "".join(item)
        if name is not None:
            seen[name] = seen.get(name, 0) + 1
            name += f"_{seen[name]}" if seen[name] > 1 else ""
            body = text.rstrip()
            text = f"{body} AS `{name}`{text[len(body):]}"
        out.append(text)
    return "".join(parts[:start]) + ",".join(out) + "".join(parts[at:])


#: column types of CREATE TABLE: PostgreSQL spelling to Spark's
TYPES = {
    "int2": "smallint", "int4": "int", "int8": "bigint", "integer": "int", "serial": "int", "bigserial": "bigint", "float4": "float", "float8": "double", "double precision": "double", "real": "float",
    "text": "string", "varchar": "string", "character varying": "string", "bpchar": "string", "char": "string", "bool": "boolean", "bytea": "binary", "numeric": "decimal(38,18)", "timestamptz": "timestamp", "timestamp": "timestamp_ntz",
}


def column_ddl(columns: str) -> str:
    """The column list of a CREATE TABLE in Spark's DDL."""
    out = []
    for piece in re.split(r",(?![^(]*\))", columns):
        m = re.fullmatch(r"\s*([`\"]?\w+[`\"]?)\s+([A-Za-z_.][\w. ]*?(?:\([\d, ]+\))?)(\s+NOT\s+NULL|\s+NULL|\s+PRIMARY\s+KEY)?\s*", piece, re.IGNORECASE)
        if not m:
            raise ValueError(f"not a column: {piece.strip()}")
        name, kind, rule = m[1].strip("`\""), m[2].lower().removeprefix("pg_catalog."), (m[3] or "").upper().split()
        base = kind.partition("(")[0].strip()
        kind = TYPES.get(base, kind) if base != "numeric" or "(" not in kind else kind.replace("numeric", "decimal")
        out.append(f"`{name}` {kind}" + (" NOT NULL" if rule[:1] in (["NOT"], ["PRIMARY"]) else ""))
    return ", ".join(out)
