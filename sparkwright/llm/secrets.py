"""Secret scans with multipart credential linking.

Base kinds (assign, access, hex) are single patterns with a least length. Beyond
them, three weak kinds of candidate - an access identifier (user, login, client
or account id), an endpoint (URL or host) and a secret-like value - are reported
only together: an interval join inside scopes of each text keeps an identifier and
a secret that lie in each other's scope. A login and a value without a label need
an endpoint in scope too; an access key, or a label that names the secret, does not.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import arrow_map, slices

#: Fixed patterns of the base kinds, in the order of kinds, with the least length
#: of the group named.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that reach 16
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Parts of multipart credentials.
LOGIN = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:name)?|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
KEY_ID = re.compile(r"""(?<![A-Za-z0-9_])(?:aws_)?access[_\x20-]?key[_\x20-]?id["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:(?:https?|ftp|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|(?:host|server|endpoint)\x20*[:=]\x20*[A-Za-z0-9.-]{4,})", re.I | re.A)
VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
#: A value of any length that its label names a secret; group 1, 2 or 3 is the value.
LABELLED = re.compile(r"""(?:password|passwd|secret(?:[_\x20-]?access)?(?:[_\x20-]?key)?|token|api_?key)["']?\x20*[:=]\x20*(?:"([^"\n]+)|'([^'\n]+)|([^\s"'<>,;&]+))""", re.I | re.A)
#: User and password of a connection string.
USERINFO = re.compile(r"://([^\s\"'<>/?#:@]*):([^\s\"'<>/?#]+)@")
#: Code points around a candidate within which its complements must lie.
SCOPE = 200
#: Bits a character that a value must reach, with digits and letters in it.
LEAST_ENTROPY = 3.5

KINDS = ("assign", "access", "hex", "login", "endpoint", "value")
_RANK = {k: i for i, k in enumerate(KINDS)}
_WORDS = re.compile(r"passw|secret|token|api", re.I | re.A)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, code points, leftmost without overlap in each kind."""
    found: list[tuple[int, int, str]] = []
    if _WORDS.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _secret_like(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and _entropy(value) >= LEAST_ENTROPY


def _outside(found: list[tuple[int, int, str]], spans: list) -> list[tuple[int, int, str]]:
    """Those of ``found`` that lie within none of ``spans``."""
    starts, tops = [], []
    for s in sorted(s[:2] for s in spans):
        starts.append(s[0])
        tops.append(max(s[1], tops[-1]) if tops else s[1])
    return [f for f in found if not (k := bisect.bisect_right(starts, f[0])) or tops[k - 1] < f[1]]


class _Part:
    """Spans of one part; running maxima of ends make the overlap test one binary search."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        spans = sorted(spans)
        self.starts = [s[0] for s in spans]
        self.tops = list(itertools.accumulate((s[1] for s in spans), max))

    def meets(self, span: tuple, scope: int = SCOPE) -> bool:
        """Whether one of the spans begins before ``scope`` after this one's end and ends after ``scope`` before its start."""
        k = bisect.bisect_left(self.starts, span[1] + scope)
        return k > 0 and self.tops[k - 1] > span[0] - scope


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates that are linked. Base spans serve as parts too: access keys as
    identifiers, assignments and runs of hex as secrets. Secrets are secret-like
    values, labelled values of any length, and passwords in connection strings.

    An identifier and a secret in scope of each other are linked if the identifier
    is an access key, the secret has a label (or is a connection string's), or an
    endpoint is in scope; an endpoint is linked with both in scope. A connection
    string's password is linked by the string itself."""
    strings = list(USERINFO.finditer(text)) if "://" in text else []
    keys = [s for s in base if s[2] == "access"] + [(m.start(), m.end(), "login") for m in KEY_ID.finditer(text)]
    logins = [(m.start(), m.end(), "login") for m in LOGIN.finditer(text)]
    logins += _outside([(*m.span(1), "login") for m in strings if m[1]], base)
    if not keys and not logins and not strings:
        return []
    inline = _outside([(*m.span(2), "value") for m in strings], base)
    named = list(inline)
    if _WORDS.search(text):
        # A label inside a connection string's user and password is none.
        found = {m.start(): m.end() for m in LABELLED.finditer(text)}
        found = [(a, found[a], "value") for a, _ in _outside([(a, a + 1) for a in found], [(m.start(1), m.end(2)) for m in strings])]
        named += _outside(found, base)
    covered = _Part(base + named)
    bare = [(*m.span(), "value") for m in VALUE.finditer(text) if not covered.meets(m.span(), 0) and _secret_like(m.group())]
    labels = named + [s for s in base if s[2] == "assign"]
    values = labels + bare + [s for s in base if s[2] == "hex"]
    if not values:
        return []
    ends = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    key, who, end, label, value = (_Part(p) for p in (keys, keys + logins, ends, labels, values))
    out = {s for s in keys if s[2] == "login" and value.meets(s)}
    out |= {s for s in logins if label.meets(s) or (value.meets(s) and end.meets(s))}
    out |= {s for s in named if who.meets(s)} | set(inline)
    out |= {s for s in bare if key.meets(s) or (who.meets(s) and end.meets(s))}
    out |= {s for s in ends if who.meets(s) and value.meets(s)}
    return sorted(out)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], _RANK[s[2]], s[1])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_assign, n_access, n_hex, base_spans and spans, both
    ``kind:start:end`` by start and kind, comma-joined, code points, end exclusive.

    A null or empty text has no spans; a text of any length is scanned whole. Ids are
    passed through, null or repeated; other columns are not looked at. An empty table
    gives an empty result."""

    def rows(batch: pa.RecordBatch):
        out = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            kinds = Counter(s[2] for s in base)
            out.append((kinds["assign"], kinds["access"], kinds["hex"], _joined(base), _joined(base + linked_spans(text, base))))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    schema = "id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, schema).withColumnRenamed("id", id_col)


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every span replaced; spans that overlap or touch become one mark."""
    base = base_spans(text)
    spans = sorted(base + [s for s in linked_spans(text, base) if s[2] == "value" or s[2] == "login"])
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end = spans[k][:2]
        while k + 1 < len(spans) and spans[k + 1][0] <= end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], mark]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, with secrets in the text replaced and,
    where ``length_col`` is present, the code points of the text counted anew for
    texts that changed. A null text stays null; rows that repeat stay as many; an
    empty table stays empty."""
    names = docs.columns
    at = names.index(text_col)
    count = names.index(length_col) if length_col in names else None

    def rows(batch: pa.RecordBatch):
        texts = batch.column(at).to_pylist()
        new = [t if t is None else redacted(t) for t in texts]
        columns = list(batch.columns)
        columns[at] = pa.array(new, batch.schema.field(at).type)
        if count is not None:
            old = batch.column(count).to_pylist()
            columns[count] = pa.array([o if a == b else len(b) for o, a, b in zip(old, texts, new, strict=True)], batch.schema.field(count).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lambda batches: (x for b in batches for part in slices(b, at) for x in rows(part)), docs.schema)
