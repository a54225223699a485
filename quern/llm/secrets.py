"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Beside the fixed patterns, every long run of key characters is a candidate. A window slides over it; counts
of its characters are kept up step by step, and so is the window's Shannon entropy. A window is judged by its
character class (hexadecimal or mixed, of letters of both cases or with digits), each class with a threshold of its
own; windows of letters of one case never count, as words of prose would, nor do windows made of common pairs of letters, as identifiers are. A
hit is extended to its whole candidate.
Where base spans cover a part of a candidate, what they leave is scanned part by part. Candidates on the allow-list
are passed over.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import _base

#: The kinds of spans in their order.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a window of each class needs; a window of 20 has 4.32 at most.
THRESHOLDS = {"hex": 3.0, "mixed": 3.6}
#: Candidates that are no secrets: identifiers of fixed form, well-known examples and digests of nothing.
ALLOWED = (
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i).*(example|placeholder|changeme|your[_-]?(api[_-]?)?key|xxxxxxxx|0123456789).*",
    r"(sha(1|256|384|512)-).*",
    r"da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    r"[0-9+/_=-]+",
    r"(?=.*/)[a-z0-9_-]*(/[a-z0-9_-]*)+",
)
#: Pairs of letters that are frequent in words; a window of random characters has about two of them, and is taken for words from ``WORDLIKE`` on.
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ri ro ic io ne me co ce li la el ma ch us om ec ss ct ee ll il ut ac na ns em di lo nc ta tr ho un pr po am cl ad ab bl".split()
)
WORDLIKE = 7
#: With so many pairs, a window is taken for words as well if kinds of characters (digit, lower, upper, other) change in it no more often than this.
FEWER, CHANGES = 4, 7
_GAIN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 2)]  # a character is counted in before another one is counted out
_KIND_OF = str.maketrans({c: "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in map(chr, range(128))})
_HEXITS = frozenset("0123456789abcdefABCDEF")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind; places are code points, ends exclusive."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def entropy_windows(s: str, window: int = WINDOW) -> Iterator[tuple[int, str, float]]:
    """(start, class, bits) of each window of ``s``; counts and entropy change by one character in, one out, and nothing else is kept."""
    counts: dict[str, int] = {}
    total = 0.0  # of count * log2(count)
    digits = lower = upper = hexits = pairs = changes = 0
    low, kinds = s.lower(), s.translate(_KIND_OF)
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _GAIN[n + 1] - _GAIN[n]
        digits, lower, upper, hexits, pairs = digits + c.isdigit(), lower + c.islower(), upper + c.isupper(), hexits + (c in _HEXITS), pairs + (i > 0 and low[i - 1 : i + 1] in PAIRS)
        changes += i > 0 and kinds[i - 1] != kinds[i]
        if i >= window:
            d = s[i - window]
            n = counts[d]
            counts[d] = n - 1
            total += _GAIN[n - 1] - _GAIN[n]
            digits, lower, upper, hexits, pairs = digits - d.isdigit(), lower - d.islower(), upper - d.isupper(), hexits - (d in _HEXITS), pairs - (low[i - window : i - window + 2] in PAIRS)
            changes -= kinds[i - window] != kinds[i - window + 1]
        if i >= window - 1:
            kind = "hex" if hexits == window and digits and (lower or upper) else "mixed" if pairs < WORDLIKE and (pairs < FEWER or changes > CHANGES) and lower + upper >= 4 and (digits or lower and upper) else "plain"
            yield i - window + 1, kind, math.log2(window) - total / window


class Scanner:
    """Finds all spans of a text; ``allowed`` are patterns that a whole candidate may match."""

    def __init__(self, allowed: tuple[str, ...] = ALLOWED, thresholds: dict[str, float] | None = None):
        self.allowed = [re.compile(p) for p in allowed]
        self.thresholds = {"plain": math.inf} | (thresholds or THRESHOLDS)

    @staticmethod
    def _left(a: int, b: int, base: list[Span]) -> list[tuple[int, int]]:
        """The parts of ``a`` to ``b`` that no base span covers."""
        out = []
        for x, _, y in base:
            if x < b and a < y:
                out.append((a, x))
                a = y
        return [*out, (a, b)]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, base and entropy spans), both by start, then kind. An entropy span overlaps no base span."""
        base = base_spans(text)
        more: list[Span] = []
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            if any(p.fullmatch(m.group()) for p in self.allowed):
                continue
            for x, y in self._left(a, b, base):
                part = text[x:y]
                if y - x < WINDOW or any(p.fullmatch(part) for p in self.allowed):
                    continue
                kind = 0
                for _, name, bits in entropy_windows(part):
                    if bits >= self.thresholds[name]:
                        kind = 3 if name == "hex" else 4
                        if kind == 4:  # no further window changes it
                            break
                if kind:
                    more.append((x, kind, y))
        return base, sorted(base + more)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each secret (overlapping spans as one) replaced by a mark."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def scan(docs: DataFrame, *, allowed: tuple[str, ...] = ALLOWED, into: str = "secrets", redacted: bool = False) -> DataFrame:
    """``docs`` with an array ``into`` of (kind, start, end, base); with ``redacted``, secrets in ``text`` are replaced.

    Null texts are scanned as empty and stay null. A text of any length is scanned whole, and memory doesn't grow with a candidate's length beyond the
    text itself; an empty table gives an empty one. Repeated rows are scanned alike. A column already named
    ``into`` is replaced. ``n_chars``, where there is one, follows a redacted text.
    """
    docs = docs.drop(into)
    schema = _base.with_fields(docs, **{into: FOUND})

    def make():
        scanner = Scanner(allowed)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found, out = [], []
            for t in texts:
                base, spans = scanner.spans(t or "")
                held = set(base)
                found.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in held} for a, k, b in spans])
                out.append(redact(t, spans) if redacted and spans else t)
            if redacted:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            return batch.append_column(into, pa.array(found, pa.list_(_FOUND)))

        return step

    out = _base.map_rows(docs, make, schema)
    if redacted and "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(into) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_base.read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(F.filter("secrets", lambda s: s["base"])), 256).alias("base_sha256"),
        line(F.col("secrets")).alias("spans"),
    )


