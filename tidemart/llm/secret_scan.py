"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Patterns find assignments (``assign``), access keys (``access``) and long hex runs (``hex``). What they
leave is searched for random-looking strings: maximal runs of a character class are candidates, a window
slides over each, and its Shannon entropy is kept up by adding and removing one character at a time.
Windows above the class's threshold are joined to spans, unless an allow-list pattern explains the run.

A run is first cut where something else explains a part of it: at spans of the patterns, at placeholder words, and
within an address (a word with ``://`` or ``@`` before the run) at slashes and equals signs. So hosts and wordy paths
stay below the window, while a random path part or query value is found, and so is what lies beside a pattern's span.

Defined results: null and empty texts have no spans. Texts are read whole, in linear time and one at a
time. Repeated rows give repeated results. Ties of a start go by the order of :data:`KINDS`. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemart.llm.common import by_position, pick, slices

#: Order of spans that begin at the same place.
KINDS = ("assign", "access", "hex", "entropy_base64", "entropy_hex")

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``run``; a window of ``window`` characters with at least ``bits`` of entropy is suspect."""

    kind: str
    run: str
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}", 24, 3.9),
    CharacterClass("entropy_hex", r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_=-])", 24, 3.0),
)

#: Runs that look random but are none: ids, dates, paths, words joined by hyphens, plain letters or digits.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[A-Za-z]+",
    r"[0-9_+/=-]+",
    r"(?:[A-Za-z]+|[0-9]+)(?:[-_/+=]+(?:[A-Za-z]+|[0-9]+))*[-_/+=]*",
    r"[-_/+=]+(?:[A-Za-z]+|[0-9]+)(?:[-_/+=]+(?:[A-Za-z]+|[0-9]+))*[-_/+=]*",
)
#: Words that stand for a secret, and signs between the parts of an address.
PLACEHOLDER = re.compile(r"(?i)example|dummy|placeholder|x{4,}")
ADDRESS_MARK, ADDRESS_CUT = re.compile(r"://|@"), re.compile(r"[/=]")
_BLANK = re.compile(r"\s")
_ALLOWED = re.compile("|".join(f"(?:{p})" for p in ALLOWED))
_CLASSES = tuple((c, re.compile(c.run)) for c in CLASSES)
#: Entropy of a window of n with counts c is log2(n) - sum(c log2 c) / n.
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, 256)]


def random_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` with an entropy of at least ``bits``, by incremental counts."""
    most = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for end, ch in enumerate(run, 1):
        c = counts.get(ch, 0)
        total += _C_LOG_C[c + 1] - _C_LOG_C[c]
        counts[ch] = c + 1
        if end > window:
            old = run[end - window - 1]
            c = counts[old]
            total += _C_LOG_C[c - 1] - _C_LOG_C[c]
            counts[old] = c - 1
        if end >= window and total <= most:
            if spans and end - window <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - window, end))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the three patterns, by start and then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return _ordered(found)


def addresses(text: str) -> list[tuple[int, int]]:
    """Stretches from an address mark to the end of its word, in order."""
    found: list[tuple[int, int]] = []
    for m in ADDRESS_MARK.finditer(text):
        if not found or m.start() >= found[-1][1]:
            end = _BLANK.search(text, m.end())
            found.append((m.start(), end.start() if end else len(text)))
    return found


def pieces(run: str, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a run without some stretches, given in order."""
    left, at = [], 0
    for start, end in cuts:
        if start > at:
            left.append((at, start))
        at = max(at, end)
    return [*left, (at, len(run))] if at < len(run) else left


def entropy_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Random-looking spans that meet none of the spans in ``taken`` (ordered by start)."""
    found: list[tuple[int, int, str]] = []
    starts: list[int] = []  # of the taken spans, made disjoint, so that starts and ends ascend
    ends: list[int] = []
    for start, end, _ in taken:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    inside = addresses(text)
    address_starts = [a for a, _ in inside]
    for cls, pattern in _CLASSES:
        for m in pattern.finditer(text):
            run, at = m[0], m.start()
            if not any(ch.isdigit() for ch in run) or _ALLOWED.fullmatch(run):
                continue
            cuts = [w.span() for w in PLACEHOLDER.finditer(run)]
            k = bisect_right(ends, at)
            while k < len(starts) and starts[k] < m.end():
                cuts.append((max(0, starts[k] - at), ends[k] - at))
                k += 1
            k = bisect_right(address_starts, at) - 1
            if k >= 0 and at < inside[k][1]:
                cuts += [c.span() for c in ADDRESS_CUT.finditer(run)]
            for a, b in pieces(run, sorted(cuts)):
                part = run[a:b]
                if len(part) < cls.window or not any(ch.isdigit() for ch in part) or _ALLOWED.fullmatch(part):
                    continue
                found += [(at + a + x, at + a + y, cls.kind) for x, y in random_windows(part, cls.window, cls.bits)]
    kept: list[tuple[int, int, str]] = []
    for s in _ordered(found):
        if not (kept and s[0] < kept[-1][1]):
            kept.append(s)
    return kept


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text: the patterns' and those that the entropy scan adds, ordered."""
    if not text:
        return []
    base = base_spans(text)
    return _ordered(base + entropy_spans(text, base))


def redact(text: str | None) -> str | None:
    """The text with each secret replaced by its kind in brackets; overlapping spans become one."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at, until = [], 0, 0
    for start, end, kind in spans:
        if start >= until:
            out += [text[at:start], f"[{kind}]"]
        until = at = max(until, end)
    return "".join(out) + text[at:]


def _ordered(spans):
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and ``found``, an array of (start, end, kind)."""

    def run(batches):
        for batch in slices(batches):
            found = [find_secrets(t) for t in batch.column(1).to_pylist()]
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, found array<struct<start: bigint, end: bigint, kind: string>>"
    )


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of the patterns, a hash of their spans, and all spans as a string."""

    def run(batches):
        for batch in slices(batches):
            out = {"doc_id": batch.column(0), "n_assign": [], "n_access": [], "n_hex": [], "n_entropy": []}
            hashes, spans = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = entropy_spans(text, base) if text else []
                kinds = [s[2] for s in base]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(kinds.count(kind))
                out["n_entropy"].append(len(more))
                hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(_ordered(base + more)))
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in out.values()]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                [*out, "base_sha256", "spans"],
            )

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        run,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string",
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; ``n_chars``, where there is one, follows the new text.

    Columns, types and all other values stay as they are.
    """

    def change(rows: DataFrame, places: dict[str, int]) -> DataFrame:
        at, count_at = places["text"], places.get("n_chars")

        def run(batches):
            for batch in slices(batches):
                old = batch.column(at).to_pylist()
                new = [redact(t) for t in old]
                columns = list(batch.columns)
                columns[at] = pa.array(new, columns[at].type)
                if count_at is not None:
                    kept = columns[count_at].to_pylist()
                    counts = [n if a == b else len(b) for a, b, n in zip(old, new, kept, strict=True)]
                    columns[count_at] = pa.array(counts, columns[count_at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return rows.mapInArrow(run, rows.schema)

    return by_position(docs, change)
