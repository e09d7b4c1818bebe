"""Secret scans with multipart credential linking.

Strong finds stand by themselves: assignments to secret-like names, access identifiers and long hexadecimal strings. Weak
candidates (user names, mixed 40-character strings, endpoints) are everyday text on their own, so they are reported only
where complementary parts co-occur: an interval join within the document links each candidate to the parts of other roles
that lie within `reach` code points of it, by binary search in the sorted spans, so it takes n log n steps for n spans.

Roles: access identifiers and user names identify; assignments, hexadecimal strings and mixed strings are secrets;
addresses are endpoints. A mixed string needs an identifier in reach, a user name needs a secret, and an endpoint needs
both an identifier and a secret.

Defined cases: null and empty texts have no spans; whole texts are scanned, in code points; spans of one kind never
overlap, those of different kinds may; repeated rows are scanned alike; an empty table gives an empty table; other
columns are kept, and columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from safespan.llm.arrays import per_batch

KINDS = ("assign", "access", "hex", "user", "mixed", "endpoint")
REACH = 400


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = re.compile(
    "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
USER = re.compile("(?:" + "|".join(map(_either_case, ("username", "user", "login", "client_id", "account"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""")
USER_HINTS = ("user", "login", "client_id", "account")
MIXED = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|s3)://[^\s\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong finds, leftmost and non-overlapping within each kind."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def within(candidates: list, parts: list, reach: int) -> list[int]:
    """For each candidate the index of a part that overlaps it when widened by reach, or -1. Parts are sorted by start;
    their running greatest ends are used, so that they may overlap."""
    starts = [p[0] for p in parts]
    best, reachable = [], -1
    for i, p in enumerate(parts):
        if reachable < 0 or p[2] > parts[reachable][2]:
            reachable = i
        best.append(reachable)
    out = []
    for c in candidates:
        n = bisect_left(starts, c[2] + reach + 1)
        out.append(best[n - 1] if n and parts[best[n - 1]][2] >= c[0] - reach else -1)
    return out


def scan(text: str, reach: int = REACH) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the part it is linked to or -1) of all spans, by start, then kind."""
    base = base_spans(text)
    low = text.lower()
    users = [(m.start(), 3, m.end()) for m in USER.finditer(text)] if any(h in low for h in USER_HINTS) else []
    identifiers = sorted([s for s in base if s[1] == 1] + users)
    mixed = [(m.start(), 4, m.end()) for m in MIXED.finditer(text)] if identifiers else []
    secrets = sorted([s for s in base if s[1] in (0, 2)] + mixed)
    out = [(*s, -1) for s in base]
    if identifiers and secrets:
        ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
        out += [(*c, secrets[p][0]) for c, p in zip(users, within(users, secrets, reach), strict=True) if p >= 0]
        out += [(*c, identifiers[p][0]) for c, p in zip(mixed, within(mixed, identifiers, reach), strict=True) if p >= 0]
        near = zip(ends, within(ends, identifiers, reach), within(ends, secrets, reach), strict=True)
        out += [(*c, identifiers[p][0]) for c, p, q in near if p >= 0 and q >= 0]
    return sorted(out)


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("linked", T.LongType()),
]))


def find_secrets(df: DataFrame, text: str = "text", name: str = "secrets", reach: int = REACH) -> DataFrame:
    """df with all spans of each text: array<struct<kind, start, end, linked>> by start, then kind; linked is the start
    of the complementary part, null for strong finds."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, SPANS)])

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [scan(x or "", reach) for x in batch.column(text).to_pylist()]
        flat = [s for spans in found for s in spans]
        at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        columns = [
            pa.array([KINDS[s[1]] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()),
            pa.array([s[2] for s in flat], pa.int64()), pa.array([s[3] if s[3] >= 0 else None for s in flat], pa.int64()),
        ]
        made = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, ["kind", "start", "end", "linked"]))
        keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != name}
        yield pa.RecordBatch.from_arrays([*keep.values(), made], [*keep, name])

    return df.mapInArrow(per_batch(make), schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """df with each found span of the text, overlapping ones joined, replaced by the mark. Null stays null."""

    def clean(x: str | None) -> str | None:
        if not x:
            return x
        out, at = [], 0
        for start, _, end, _ in scan(x, reach):
            if start >= at:
                out += [x[at:start], mark]
            at = max(at, end)
        return "".join(out) + x[at:] if out else x

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = pa.array([clean(x) for x in batch.column(text).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([made if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return df.mapInArrow(per_batch(make), df.schema)


def joined(spans: str, kinds: tuple[str, ...]) -> F.Column:
    """The spans of the given kinds as kind:start:end, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
