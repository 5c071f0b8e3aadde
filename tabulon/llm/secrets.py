"""Secrets in text: patterns, and encoded candidates that are reported only when their structure holds."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Kinds in the order in which spans with the same start are listed; the first three are plain patterns.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh", "encoded")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# Runs of token letters with dots between; a token is three of them.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
TOKEN_START = re.compile(r"e[yw](?=[A-Za-z0-9_-])")
PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
PEM_END = re.compile(r"-----END ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
# What can't be in a key's body: all but base64, headers, white space and escaped white space.
NO_BODY = re.compile(r"(?<!\\)\\++(?![nrt/])|[^A-Za-z0-9+/=\s:,.\\-]")
ENCRYPTED = re.compile(r"\s*Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,\s*[0-9A-Fa-f]+\s")
# The shortest secret in a text is 'token=' and 8 characters: 14 bytes, 28 digits or, without padding, 19 base64 characters.
HEX_CANDIDATE = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){14,}(?![0-9A-Fa-f])")
BASE64_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
SHORTEST = 19
# What wraps a candidate: a line end, also written as backslash and letter, and the indentation after it.
BREAK = re.compile(r"(?:\r?\n|\r)[\x20\t]*|(?<!\\)(?:\\++r)?\\++n[\x20\t]*")
BASE64_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
HEX_DIGITS = re.compile(r"[0-9A-Fa-f]+")
PIECE_AFTER = re.compile(r"[A-Za-z0-9+/_-]+")
PADDING = re.compile(r"={0,2}")
ESCAPES = re.compile(r"(?<!\\)\\++([nrt/])")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the contents of the DER element at `at`; None if its length doesn't fit."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at:at + size], "big"), at + size
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end] exactly."""
    out = []
    while at < end:
        x = _der(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def is_private_der(data: bytes) -> bool:
    """A SEQUENCE that fills the data and holds an RSA, DSA, elliptic curve or PKCS#8 key, or an encrypted PKCS#8 key."""
    top = _der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _elements(data, top[1], top[2])
    if not parts:
        return False
    tags = [x[0] for x in parts]
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:  # algorithm, then encrypted bytes
        inner = _elements(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[0] != 0x02:
        return False
    version = int.from_bytes(data[parts[0][1]:parts[0][2]], "big")
    if tags[1:3] == [0x30, 0x04] and version in (0, 1):
        inner = _elements(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if version == 1 and len(tags) >= 2 and tags[1] == 0x04:
        return 16 <= parts[1][2] - parts[1][1] <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return version in (0, 1) and len(tags) in (6, 9, 10) and all(t == 0x02 for t in tags[:9])


def is_openssh(data: bytes) -> bool:
    """The magic, then cipher, key derivation, its options, a count, as many public keys and one private block, by length."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, strings = len(magic), 3
    while strings:
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            return False
        at, strings = at + 4 + n, strings - 1
    count, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return False
    for _ in range(count + 1):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at:at + 4], "big")
        if n == 0 or at + 4 + n > len(data):
            return False
        at += 4 + n
    return True


def is_jwt(token: str) -> bool:
    """The header decodes to a JSON object that names an algorithm, the payload to a JSON object."""
    header, payload, _ = token.split(".")
    try:
        head, body = (json.loads(_unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans of three runs of token letters, dots between, from an `ey` or `ew` in the first; without overlap."""
    for m in DOTTED.finditer(text):
        edges, at = [], m.start()
        for run in m[0].split("."):
            edges.append((at, at + len(run)))
            at += len(run) + 1
        k = 0
        while k + 2 < len(edges):
            first = TOKEN_START.search(text, edges[k][0], edges[k][1]) if edges[k + 1][0] < edges[k + 1][1] else None
            if first:
                yield first.start(), edges[k + 2][1]
            k += 3 if first else 1


def _keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Span and body of the blocks from BEGIN to the next END of the same label, if all between can be a key's body."""
    ends: dict[str, list[int]] = {}
    after: dict[int, int] = {}
    for m in PEM_END.finditer(text):
        ends.setdefault(m[1], []).append(m.start())
        after[m.start()] = m.end()
    wrong, done = -1, 0
    for m in PEM_BEGIN.finditer(text):
        own = ends.get(m[1], [])
        k = bisect_left(own, m.end())
        if m.start() < done or k == len(own):
            continue
        if wrong < m.end():
            bad = NO_BODY.search(text, m.end())
            wrong = bad.start() if bad else len(text)
        if own[k] <= wrong:
            done = after[own[k]]
            yield m.start(), done, text[m.end():own[k]]


class _Taken:
    """Disjoint spans in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def _plain(text: str) -> list[tuple[int, int, int]]:
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(a, 0, b) for a, b in _assigned(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _decoded_kind(data: bytes) -> int | None:
    if is_private_der(data):
        return 5
    if is_openssh(data):
        return 6
    try:
        inner = data.decode()
    except UnicodeDecodeError:
        return None
    if ("AKIA" in inner and any(len(m[0]) >= 16 for m in ACCESS.finditer(inner))) or next(_assigned(inner), None) or next(_keys(inner), None):
        return 7
    return None


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Spans of the pieces of candidates that are wrapped, the pieces of one candidate together."""
    run: list[tuple[int, int]] = []
    for m in BREAK.finditer(text):
        a, b = m.span()
        after = PIECE_AFTER.match(text, b)
        if run and run[-1][1] == a:
            if after:
                run.append(after.span())
            continue
        if len(run) > 1:
            yield run
        run = []
        if not after:
            continue
        start = a
        while start and text[start - 1] in BASE64_LETTERS:
            start -= 1
        if start < a:
            run = [(start, a), after.span()]
    if len(run) > 1:
        yield run


def _wrapped(text: str) -> Iterator[tuple[int, int, int]]:
    """Kind, start and end of confirmed candidates that go on over line ends.

    Wrapped lines are equally long, except for the first (after other words) and the last; the longest of the possible
    candidates that holds is taken, each block of equal lines with and without the shorter line before and after it.
    """
    for run in _runs(text):
        sizes = [b - a for a, b in run]
        if sum(sizes) < SHORTEST:
            continue
        tried, at, n = {(0, len(run))}, 0, len(run)
        while at < n:
            end = at + 1
            while end < n and sizes[end] == sizes[at]:
                end += 1
            before = at - 1 if at and sizes[at - 1] < sizes[at] else at
            after = end + 1 if end < n and sizes[end] < sizes[at] else end
            tried |= {(x, y) for x in (before, at) for y in (after, end)}
            at = end
        done = 0
        for x, y in sorted(tried, key=lambda p: (p[0], -p[1])):
            size = sum(sizes[x:y])
            if x < done or y - x < 2 or size < SHORTEST:
                continue
            joined = "".join(text[a:b] for a, b in run[x:y])
            end = PADDING.match(text, run[y - 1][1]).end()
            is_hex = size % 2 == 0 and HEX_DIGITS.fullmatch(joined)
            for data, stop in ((bytes.fromhex(joined) if is_hex else None, run[y - 1][1]), (_unbase64(joined + text[run[y - 1][1]:end]), end)):
                kind = _decoded_kind(data) if data else None
                if kind is not None and (kind != KINDS.index("encoded") or _is_text(data)):
                    yield kind, run[x][0], stop
                    done = y
                    break


def _is_text(data: bytes) -> bool:
    return all(c.isprintable() or c in "\t\r\n" for c in data.decode())


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted. Confirmed spans of one kind don't overlap."""
    found = _plain(text)
    inside = []
    if "PRIVATE KEY-----" in text:
        for a, b, body in _keys(text):
            inside.append((a, b))
            body = ESCAPES.sub(lambda e: "/" if e[1] == "/" else "\n", body)
            locked = ENCRYPTED.match(body)
            data = _unbase64("".join(re.sub(r"^[A-Za-z0-9-]+:.*$", "", body, flags=re.M).split()))
            # An encrypted body is whole blocks of its cipher, of 8 bytes or twice that.
            if data and (is_private_der(data) or is_openssh(data) or locked and len(data) % 8 == 0):
                found.append((a, 4, b))
    tokens = []
    if "ey" in text or "ew" in text:
        tokens = [(a, b) for a, b in _tokens(text) if is_jwt(text[a:b])]
        found += [(a, 3, b) for a, b in tokens]
    taken = _Taken(inside + tokens)
    for kind, a, b in _wrapped(text):
        if not taken.meets(a, b):
            taken.add(a, b)
            found.append((a, kind, b))
    for pattern, decode in ((HEX_CANDIDATE, bytes.fromhex), (BASE64_CANDIDATE, _unbase64)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if taken.meets(a, b):
                continue
            data = decode(m[0])
            kind = _decoded_kind(data) if data else None
            if kind is not None:
                taken.add(a, b)
                found.append((a, kind, b))
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t or "")] for t in batch.column(at).to_pylist()]
        kept = [k for k in range(batch.num_columns) if k != at]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(found, kind)], names=[*(batch.schema.names[k] for k in kept), "found"])


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: Column | None = None) -> DataFrame:
    """One row per document: id, `found` and, if given, `carried`; `found` lists kind, start and end (code points, end
    exclusive) by start, then kind.

    `assign`, `access` and `hex` are plain patterns, leftmost and without overlap within a kind. The others are added
    only when the candidate decodes and its structure holds: `jwt`, a signed token whose header names an algorithm;
    `pem`, `der` and `openssh`, private keys whose nested lengths add up; `encoded`, base64 or hex of text that itself
    holds a secret. Candidates and key bodies may go on over line ends, also escaped ones. Null and empty texts have no spans; each row is on its own, so repeated rows and null ids are kept
    as they are; other columns are ignored. No shuffle.
    """
    rows = docs.select(F.col(id_column), *([carry.alias("carried")] if carry is not None else []), F.col(text_column).alias("_text"))
    return rows.mapInArrow(_scan, T.StructType([*rows.drop("_text").schema.fields, T.StructField("found", SPANS)]))


def joined_spans(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end, comma-joined, of the spans of these kinds."""
    return F.array_join(F.transform(F.filter(found, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
