"""Secret scans: keyword automaton, anchored expressions at its hits, checksums inside tokens.

One Aho-Corasick automaton over the ASCII-lower-cased text finds every place
where a kind can start; that kind's expression is then matched only there, and
kinds with a checksum keep a match only when it is right. Runs of hexadecimal
digits have no keyword; one expression finds them.

Base kinds (leftmost, non-overlapping for each kind): assign, access, hex. Kinds
that are added: hosting and package tokens with a CRC-32 in base 62, chat
tokens, payment keys, signed web tokens whose header decodes, private-key
blocks. A run of token characters can hold one signed token, which begins at its first
keyword.

Defined results: null texts count as empty and give no spans; texts of every length
are scanned whole, in time that grows with their length; a base match that fails its
test still takes its place; spans that begin together go by kind as listed; repeated rows
give the same spans each; an empty table gives an empty one. find_secrets()
reads the id and the text alone, redact() keeps all columns whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped_by_place, record_batch, sliced

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("hosting", "package", "chat", "payment", "signed", "private")
KINDS = BASE_KINDS + ADDED_KINDS
ORDER = {kind: n for n, kind in enumerate(KINDS)}

_RUN = re.compile("[A-Za-z0-9_-]*")
_HEX = re.compile("[0-9a-f]{24,}")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = _DIGITS[digit] + out
    return out.rjust(width, "0")


def _checksum_right(match: re.Match) -> bool:
    """The last six characters of the body are the CRC-32 of those before, in base 62."""
    body = match[1]
    return base62(binascii.crc32(body[:-6].encode()), 6) == body[-6:]


def _header_right(match: re.Match) -> bool:
    head = match[1]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


#: kind -> (keywords, expression, test of a match)
_RULES = {
    "assign": (
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        lambda m: len(m[2]) >= 6,
    ),
    "access": (("akia",), re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hosting": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checksum_right),
    "package": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checksum_right),
    "chat": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"xox[bpars]-[0-9]{8,}-[A-Za-z0-9-]{10,}"), None),
    "payment": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{20,}"), None),
    "signed": (("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), _header_right),
    "private": (("-----begin ",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"), None),
}


def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for kind, (keywords, _, _) in _RULES.items():
        for word in keywords:
            words.add_word(word, (kind, len(word)))
    words.make_automaton()
    return words


_WORDS = _automaton()


def _lower(text: str) -> str:
    """A-Z in lower case; every other character stays, so positions do too."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    found = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    free: dict[str, int] = {}
    for last, (kind, length) in _WORDS.iter(_lower(text)):
        start = last - length + 1
        if start < free.get(kind, 0):
            continue
        _, expression, right = _RULES[kind]
        if match := expression.match(text, start):
            if right is None or right(match):
                found.append((kind, start, match.end()))
                free[kind] = match.end()
            elif kind in BASE_KINDS:  # a base match that fails still takes its place
                free[kind] = match.end()
        if kind == "signed" and start >= free.get(kind, 0):  # what failed is not looked at again from within its run
            free[kind] = _RUN.match(text, start).end()
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of every row."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in batch.column(1).to_pylist()]
            yield record_batch({"doc_id": (batch.column(0), None), "spans": (spans, span)})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with secrets in its text replaced by [secret], and the length column to match; other columns stay."""
    schema = df.schema
    at, n_at = df.columns.index(text_col), df.columns.index(length_col) if length_col in df.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            changed = [t if t is None or not (s := scan(t)) else redacted(t, s) for t in texts]
            columns = batch.columns
            columns[at] = pa.array(changed, pa.string())
            if n_at is not None:
                old = columns[n_at].to_pylist()
                columns[n_at] = pa.array([n if a is b else len(b) for n, a, b in zip(old, texts, changed)], batch.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return mapped_by_place(df, run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans as text, from find_secrets()."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
