"""Personal data: rule spans, and more spans from a semi-Markov conditional random field.

The rules (e-mail, IP, card, phone) give the base spans, matched from the left without overlap per kind.
The model looks at stretches of text around digits and ``@``: every candidate segment of up to
``MAX_TOKENS`` tokens is scored as a whole for each kind (digit count, grouping, separators, checksum,
neighbours), and a dynamic programme over segments chooses boundaries and kinds jointly. Base spans are
fixed; what the programme labels elsewhere, with a clear gain over plain text, is added.

Weights are learned here by conditional log-likelihood (forward-backward over segmentations) from a bounded
sample: the base spans of at most ``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters serve as
labels, with features dropped at random so that the model does not lean on the rules' own cues. Without
any base span in the sample it adds nothing. The sample follows a hash of the text, so reruns agree.

Defined results: null or empty text -> no spans; positions are code points, the end exclusive; one output
row per input row; spans sorted by start, then kind.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import text_bytes, text_slices

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20
SAMPLE_DOCS = 256
SAMPLE_CHARS = 20_000
SAMPLE_STRETCHES = 400

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the leftmost matches of local part, @, dotted domain: found from each @, in linear time."""
    out, used, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            used = m.end()
        at = text.find("@", max(at + 1, used))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn_ok(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- stretches, tokens, candidate segments ---------------------------------------------------------

_WORD = re.compile(r"\S+")
_HIT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_DIGITISH = re.compile(r"[+(]?[0-9(][0-9 ().+-]*\Z")
_SOLID = re.compile(r"\S+\Z")


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of words with a digit or @, one plain word between them at most."""
    out: list[tuple[int, int]] = []
    start = end = -1
    plain = 0
    for m in _WORD.finditer(text):
        if _HIT.search(m[0]):
            start, end, plain = m.start() if start < 0 else start, m.end(), 0
        elif start >= 0:
            plain += 1
            if plain > 1:
                out.append((start, end))
                start = -1
    if start >= 0:
        out.append((start, end))
    return out


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) token numbers of the segments that could be an entity."""
    out = []
    for i, (a, _) in enumerate(tokens):
        first = text[a]
        if not (first.isalnum() or first in "+("):
            continue
        digits = False
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            p, q = tokens[j]
            if j > i and p - tokens[j - 1][1] > 1:
                break
            digits |= text[p].isdigit()
            solid = q - a == sum(y - x for x, y in tokens[i : j + 1])
            span = text[a:q]
            if not solid and not _DIGITISH.match(span):
                break
            if text[p].isalnum() and q - a >= 5 and (digits or "@" in span):
                out.append((i, j))
    return out


FEATURES = (
    "bias", "digits<5", "digits5-8", "digits9-11", "digits12-15", "digits16-19", "digits20+", "one@", "many@", "dot_after@", "letters",
    "plus", "paren", "groups1", "groups2", "groups3", "groups4", "groups5+", "four_dotted", "small_parts", "luhn", "space", "dash", "dot",
    "left_alnum", "right_alnum", "left_joined", "right_joined",
)
_AT = {name: i for i, name in enumerate(FEATURES)}
#: Cues that the rules themselves use; training drops them often.
RULE_CUES = tuple(_AT[x] for x in ("plus", "luhn", "small_parts"))


def span_features(text: str, a: int, b: int) -> list[int]:
    """Numbers of the features that hold for the whole span."""
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    on = ["bias", "digits<5" if n < 5 else "digits5-8" if n < 9 else "digits9-11" if n < 12 else "digits12-15" if n < 16 else "digits16-19" if n < 20 else "digits20+"]
    at = s.count("@")
    if at:
        on.append("one@" if at == 1 else "many@")
        if at == 1 and re.fullmatch(r"[^@]+@[^@.]+(\.[^@.]+)+", s):
            on.append("dot_after@")
    if any(c.isalpha() for c in s):
        on.append("letters")
    if s[0] == "+":
        on.append("plus")
    if "(" in s:
        on.append("paren")
    on.append(f"groups{len(groups)}" if 1 <= len(groups) <= 4 else "groups5+")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s):
        on.append("four_dotted")
        if all(map(_small, groups)):
            on.append("small_parts")
    if 12 <= n <= 19 and luhn_ok("".join(groups)):
        on.append("luhn")
    on += [name for name, c in (("space", " "), ("dash", "-"), ("dot", ".")) if c in s]
    left, right = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    on += [x for x, c in (("left_alnum", left), ("right_alnum", right)) if c.isalnum()]
    on += [x for x, c, more in (("left_joined", left, text[a - 2 : a - 1]), ("right_joined", right, text[b + 1 : b + 2])) if c in "-.+(@_%" and more.isalnum()]
    return [_AT[x] for x in on]


class Cover:
    """Spans (start, kind, end) by their start, and the furthest end up to each: what overlaps one is found by bisection."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        ordered = sorted(spans)
        self.starts = [s for s, _, _ in ordered]
        self.ends = list(accumulate((e for _, _, e in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


class Lattice:
    """Segmentations of one stretch: single plain tokens, and candidate segments of each kind.

    State 0 is plain text, state k + 1 kind k. ``by_end[j]``: (start, candidate number) of the candidates
    that end after token j - 1.
    """

    def __init__(self, text: str, start: int, end: int, fixed: Cover | None = None):
        self.tokens = tokens_of(text, start, end)
        free = candidates(text, self.tokens)
        if fixed is not None:
            free = [(i, j) for i, j in free if not fixed.meets(self.tokens[i][0], self.tokens[j][1])]
        self.segments = free
        self.features = [span_features(text, self.tokens[i][0], self.tokens[j][1]) for i, j in free]
        self.by_end: list[list[tuple[int, int]]] = [[] for _ in range(len(self.tokens) + 1)]
        for c, (i, j) in enumerate(free):
            self.by_end[j + 1].append((i, c))

    def scores(self, weights: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """candidates x kinds."""
        w = weights if keep is None else weights * keep
        return np.array([w[:, f].sum(axis=1) for f in self.features]).reshape(len(self.features), len(KINDS))

    def best(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """(candidate, kind, gain over plain) of the best segmentation."""
        n, value, back = len(self.tokens), [0.0], [None]
        for j in range(1, n + 1):
            top, choice = value[j - 1], None
            for i, c in self.by_end[j]:
                k = int(scores[c].argmax())
                if value[i] + scores[c, k] > top:
                    top, choice = value[i] + scores[c, k], (i, c, k)
            value.append(top)
            back.append(choice)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, c, k = back[j]
                out.append((c, k, float(scores[c, k])))
                j = i
        return out[::-1]

    def expected(self, scores: np.ndarray) -> tuple[float, np.ndarray]:
        """Log of the sum over segmentations, and each candidate's probability per kind."""
        n = len(self.tokens)
        ahead, total = [0.0] * (n + 1), [math.log(x) for x in np.exp(scores).sum(axis=1)] if len(scores) else []
        for j in range(1, n + 1):
            terms = [ahead[j - 1], *(ahead[i] + total[c] for i, c in self.by_end[j])]
            m = max(terms)
            ahead[j] = m + math.log(sum(math.exp(t - m) for t in terms))
        behind: list[list[float]] = [[] for _ in range(n + 1)]
        behind[n] = [0.0]
        prob = np.zeros_like(scores)
        for j in range(n, -1, -1):
            m = max(behind[j])
            b = m + math.log(sum(math.exp(t - m) for t in behind[j]))
            if j:
                behind[j - 1].append(b)
                for i, c in self.by_end[j]:
                    behind[i].append(b + total[c])
                    prob[c] = np.exp(scores[c] + (ahead[i] + b - ahead[n]))
        return ahead[n], prob


def fit(texts: list[str], rounds: int = 8, rate: float = 0.3, decay: float = 0.002, seed: int = 11) -> np.ndarray:
    """kinds x features weights from the rule spans of the texts, by AdaGrad on the log-likelihood."""
    shape = (len(KINDS), len(FEATURES))
    weights, seen = np.zeros(shape), []
    weights[:, 0] = -1.0
    for text in texts:
        spans = rule_spans(text)
        for a, b in stretches(text):
            gold, lattice = {(s, e): k for s, k, e in spans}, Lattice(text, a, b)
            labels = [(c, gold[at]) for c, (i, j) in enumerate(lattice.segments) if (at := (lattice.tokens[i][0], lattice.tokens[j][1])) in gold]
            if lattice.segments:
                seen.append((lattice, labels))
            if len(seen) >= SAMPLE_STRETCHES:
                break
        if len(seen) >= SAMPLE_STRETCHES:
            break
    if not any(labels for _, labels in seen):
        return np.full(shape, -1.0) * (np.arange(len(FEATURES)) == 0)
    rng, square = np.random.default_rng(seed), np.full(shape, 1e-6)
    chance = np.full(len(FEATURES), 0.1)
    chance[list(RULE_CUES)] = 0.5
    chance[0] = 0.0
    for _ in range(rounds):
        for n in rng.permutation(len(seen)).tolist():
            lattice, labels = seen[n]
            keep = (rng.random(len(FEATURES)) >= chance).astype(float)
            _, prob = lattice.expected(lattice.scores(weights, keep))
            for c, k in labels:
                prob[c, k] -= 1.0
            grad = decay * weights
            for c, f in enumerate(lattice.features):
                grad[:, f] += prob[c][:, None] * keep[f]
            square += grad**2
            weights = weights - rate * grad / np.sqrt(square)
    return weights


def find_in(text: str, weights: np.ndarray, min_gain: float) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all spans, sorted."""
    base = rule_spans(text)
    out = [(a, k, b, True) for a, k, b in base]
    cover = Cover(base)
    for a, b in stretches(text):
        lattice = Lattice(text, a, b, cover)
        if lattice.segments:
            for c, k, gain in lattice.best(lattice.scores(weights)):
                if gain >= min_gain:
                    i, j = lattice.segments[c]
                    out.append((lattice.tokens[i][0], k, lattice.tokens[j][1], False))
    return sorted(out)


def train(docs: DataFrame) -> np.ndarray:
    """Fit on a bounded sample (see the module's text): documents with a digit, half of them with an @, by hash."""
    short = docs.select("text").where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9]"))
    by_hash = [F.xxhash64("text"), F.col("text")]
    half = SAMPLE_DOCS // 2
    rows = short.where(F.contains("text", F.lit("@"))).orderBy(*by_hash).limit(half).union(short.where(~F.contains("text", F.lit("@"))).orderBy(*by_hash).limit(half)).collect()
    return fit(sorted({r.text for r in rows}, key=lambda t: hashlib.md5(t.encode()).digest()))


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def _marked(part: pa.RecordBatch) -> np.ndarray:
    """Which texts hold a digit or an @."""
    buf, offsets = text_bytes(part.column("text"))
    hits = np.flatnonzero(((buf >= 48) & (buf <= 57)) | (buf == 64))
    return np.diff(np.searchsorted(hits, offsets)) > 0


def find(docs: DataFrame, weights: np.ndarray | None = None, min_gain: float = 2.0) -> DataFrame:
    """doc_id, spans (kind, start, end, base). ``weights`` None: learned from these documents first."""
    w = train(docs) if weights is None else weights

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts, rows = part.column("text"), []
                for i, look in enumerate(_marked(part).tolist()):
                    found = find_in(texts[i].as_py(), w, min_gain) if look else []
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def mask_text(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Every span replaced by its kind in angle brackets; overlapping spans are replaced together."""
    out, at = [], 0
    for a, k, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: np.ndarray | None = None, min_gain: float = 2.0) -> DataFrame:
    """The same rows and columns, the text with every span replaced by its kind."""
    w = train(docs) if weights is None else weights

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                at, texts = part.schema.get_field_index("text"), part.column("text").to_pylist()
                for i in np.flatnonzero(_marked(part)).tolist():
                    texts[i] = mask_text(texts[i], find_in(texts[i], w, min_gain))
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
