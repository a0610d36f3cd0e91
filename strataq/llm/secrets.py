"""Secret scan (operator 2): Aho-Corasick prefilter, anchored regular expressions near hits, embedded checksums.

One automaton over the ASCII-lower-cased text finds every keyword in a single pass; only at its hits are the anchored
expressions tried, left to right, skipping hits inside an earlier match (or a failed run) of the same kind, so the scan is
linear in the text whatever it holds. Runs of hexadecimal digits and base58check keys have no keyword (any digit may begin
them), so each is found by one expression over the text that never looks back. Beyond the base kinds (assign, access, hex) the scan reports tokens
that prove themselves:

* `vcs` and `registry`: prefixed 36-character tokens whose last six characters are the base-62 CRC-32 of the first thirty;
* `jwt`: three base64url parts whose first two decode to JSON objects, the first with an `alg`;
* `pem`: a private-key block whose base64 body decodes to a DER sequence of the stated length;
* `wif`: base58check private keys (version 0x80) with their four-byte double SHA-256.

Defined results: a null text is empty and has no spans; a text of any length is scanned whole; a null id stays a null id;
repeated ids and rows keep their rows; extra columns are ignored; an empty table gives an empty result. Spans that begin at
one place are listed in the order of KINDS. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches
from .scratch import ship

KINDS = ("assign", "access", "hex", "vcs", "registry", "jwt", "pem", "wif")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_letters = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join(map(_letters, ("password", "passwd", "secret", "token"))) + "|" + _letters("api") + "_?" + _letters("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
VCS = re.compile("gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
REGISTRY = re.compile("npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
JWT_HEAD = re.compile("eyJ[A-Za-z0-9_-]++")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----\s++([A-Za-z0-9+/=\s]++)-----END (?:[A-Z]+ )?PRIVATE KEY-----")
WIF = re.compile("(?<![0-9A-Za-z])[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![0-9A-Za-z])")


def base62_crc(body: str) -> str:
    """Six base-62 digits of the CRC-32 of body."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _crc_token(m: re.Match) -> bool:
    body = m.group().partition("_")[2]
    return base62_crc(body[:30]) == body[30:]


def _jwt(m: re.Match) -> bool:
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))) for part in m.group(1, 2))
    except (ValueError, RecursionError):  # not JSON, or nested deeper than any token's header
        return False
    return isinstance(head, dict) and isinstance(body, dict) and "alg" in head


def _pem(m: re.Match) -> bool:
    try:
        der = base64.b64decode("".join(m.group(1).split()), validate=True)
    except ValueError:
        return False
    if len(der) < 3 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return der[1] == len(der) - 2
    n = der[1] & 0x7F
    return int.from_bytes(der[2 : 2 + n], "big") == len(der) - 2 - n


def _wif(m: re.Match) -> bool:
    n = 0
    for c in m.group():
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(38, "big").lstrip(b"\0")
    return len(raw) in (37, 38) and raw[0] == 0x80 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: kind: (lower-case keywords, expression anchored at a hit, test)
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, lambda m: len(m.group(2)) >= 6),
    "access": (("akia",), ACCESS, lambda m: m.end() - m.start() >= 20),
    "vcs": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), VCS, _crc_token),
    "registry": (("npm_",), REGISTRY, _crc_token),
    "jwt": (("eyj",), JWT, _jwt),
    "pem": (("-----begin ",), PEM, _pem),
}


@functools.lru_cache(1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, (words, *_) in RULES.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every secret, sorted."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: offsets stay
    hits: dict[str, list[int]] = {}
    for last, (kind, size) in automaton().iter(lower):
        hits.setdefault(kind, []).append(last - size + 1)
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        _, pattern, valid = RULES[kind]
        behind = 0
        for at in sorted(starts):
            if at < behind:
                continue
            if m := pattern.match(text, at):
                behind = m.end()
                if valid(m):
                    spans.append((at, KINDS.index(kind), behind))
            elif kind == "jwt" and (head := JWT_HEAD.match(text, at)):
                behind = head.end()  # what follows this run decides for all hits in it
    spans += [(m.start(), KINDS.index("wif"), m.end()) for m in WIF.finditer(text) if _wif(m)]
    return sorted(spans)


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    ship(docs.sparkSession)

    def found(batches):
        import pyarrow as pa

        for batch in text_batches(batches):
            rows = [find(t) if t else [] for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in r) for r in rows], pa.int64()) for kind in range(3)]
            digests = [hashlib.sha256(_said(s for s in r if s[1] < 3).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(_said, rows), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op2_secret_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
