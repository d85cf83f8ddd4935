"""Secret scans: keyword automaton, anchored expressions at its hits, then checks embedded in the secret.

One Aho-Corasick pass per text finds the rules' keywords; an expression is only tried, anchored, where a
keyword of its rule begins. A match then has to pass its rule's own check (length, checksum, decodable
structure). The hex rule has no keyword: the positions of its hits come from a vectorised run-length pass
over the bytes, and the expression is tried where a run of 16 begins.

Matches of one rule don't overlap; as in a left-to-right scan, a match that fails its check still uses up
its text. Defined results: null or empty text -> no spans; one output row per input row, in any order;
positions are code points, the end exclusive; spans are sorted by start, then by the rules' order.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import spans_of, text_bytes, text_slices

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def checksum_ok(token: str) -> bool:
    """The last six characters are the CRC-32 of the 30 before, in base 62 (published format of prefixed tokens)."""
    payload = token[-36:]
    value, digits = zlib.crc32(payload[:30].encode()), []
    for _ in range(6):
        value, r = divmod(value, 62)
        digits.append(BASE62[r])
    return payload[30:] == "".join(reversed(digits))


def header_ok(token: str) -> bool:
    """The first part decodes to a JSON object that names its algorithm."""
    part = token.split(".", 1)[0]
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


def der_ok(block: str) -> bool:
    """The body decodes to one DER sequence of just the length that its header states."""
    body = re.sub(r"\s+", "", re.sub(r"-----[^-]*-----", "", block))
    try:
        raw = base64.b64decode(body, validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return raw[1] + 2 == len(raw)
    n = raw[1] & 0x7F
    return 1 <= n <= 4 and int.from_bytes(raw[2 : 2 + n], "big") + 2 + n == len(raw)


@dataclass(frozen=True)
class Rule:
    kind: str
    keywords: tuple[str, ...]  # lower case; none: the hex run pass finds the hits
    pattern: str
    check: Callable[[re.Match], bool]
    run: str = ""  # what follows the keyword up to where every match from within it must go on alike


BASE_RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    Rule("access", ("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    Rule("hex", (), r"[0-9a-f]{16,}", lambda m: True),
)
CHECKED_RULES = (
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: checksum_ok(m[0])),
    Rule("npm", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: checksum_ok(m[0])),
    Rule("jwt", ("eyj",), r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: header_ok(m[0]), r"eyJ[A-Za-z0-9_-]+"),
    Rule("pem", ("-----begin ",), r"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END \1PRIVATE KEY-----", lambda m: der_ok(m[0])),
)
RULES = (*BASE_RULES, *CHECKED_RULES)

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        import ahocorasick

        self.rules = rules
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.stretches = [re.compile(r.run, re.ASCII) if r.run else None for r in rules]
        self.runs = [k for k, r in enumerate(rules) if not r.keywords]
        self.automaton = ahocorasick.Automaton()
        for k, rule in enumerate(rules):
            for word in rule.keywords:
                self.automaton.add_word(word, (len(word) - 1, k))
        self.automaton.make_automaton()

    def spans(self, text: str, run_starts: list[int]) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches that pass."""
        low = text.lower()
        if len(low) != len(text):  # some characters grow; positions must stay
            low = text.translate(_ASCII_LOWER)
        hits = [(end - back, k) for end, (back, k) in self.automaton.iter(low)]
        hits += [(at, k) for at in run_starts for k in self.runs]
        if not hits:
            return []
        hits.sort()
        out, used = [], [0] * len(self.rules)
        for at, k in hits:
            if at < used[k]:
                continue
            if m := self.patterns[k].match(text, at):
                used[k] = m.end()
                if self.rules[k].check(m):
                    out.append((at, k, m.end()))
            elif self.stretches[k] and (run := self.stretches[k].match(text, at)):
                used[k] = run.end()  # hits within the run would fail as this one did, each at the run's end
        return out


def hex_run_starts(buf: np.ndarray, offsets: np.ndarray, least: int = 16) -> dict[int, list[int]]:
    """Text number -> code-point positions where runs of ``least`` or more hex digits begin."""
    starts, ends = spans_of(_HEX[buf], offsets)
    starts = starts[ends - starts >= least]
    if not starts.size:
        return {}
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    row = np.searchsorted(offsets, starts, "right") - 1
    found: dict[int, list[int]] = {}
    for r, p in zip(row.tolist(), (points[starts] - points[offsets[row]]).tolist()):
        found.setdefault(r, []).append(p)
    return found


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (kind, start, end) of the secrets in ``text``."""

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            for part in text_slices(batch, "text"):
                runs = hex_run_starts(*text_bytes(part.column("text"))) if scanner.runs else {}
                rows = [
                    [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in scanner.spans(text, runs.get(i, []))] if text else []
                    for i, text in enumerate(part.column("text").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def span_digest(found: DataFrame, base_kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans as text."""

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(column, kind):
        return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    tagged = "base" in found.schema["spans"].dataType.elementType.names
    base = F.filter("spans", lambda s: s["base"] if tagged else s["kind"].isin(*base_kinds))
    return found.select("doc_id", *(counted(base, k) for k in base_kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
