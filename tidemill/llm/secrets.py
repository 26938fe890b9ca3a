"""Secret scans (operator 3): known shapes, and sliding-window entropy over candidate strings.

Known shapes are assignments, access keys and long hex runs. Candidates are runs of key letters; for each class of
characters (hex digits, base-64 letters) the Shannon entropy of a window that slides over the candidate is kept by
incremental counts, windows at or above the class's threshold are joined into spans, and spans that an allow list
explains (words, names and paths, repeated or counting characters) are dropped; placeholders are taken out of a run.

Defined results: a null text is empty and has no span; spans count code points, end exclusive; rows that repeat are
scanned each; an empty table gives no row; a column of the output's name is replaced and all others stay. Each row is
scanned on its own in time that grows with its length, so nothing is shuffled and no text stalls a task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.llm.common import free_name, text_or_empty

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: The known shapes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
#: For each class: its runs, the window's length and the least entropy in bits, 2.5 deviations below that of random strings.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.1),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), 20, 3.65),
}
PLACEHOLDER = re.compile(r"example|placeholder|dummy|changeme|your[-_]|xxxx|lorem", re.IGNORECASE)
PARTS = re.compile(r"[^/_.=+-]+")
WORDLIKE = re.compile(r"[A-Za-z]++[0-9]{0,4}|[0-9]{1,8}")
SYLLABLES = re.compile(r"[A-Z]?[a-z]++|[A-Z]++")
LEAST_WORD = 3.5


def window_spans(run: str, width: int, least: float) -> list[tuple[int, int]]:
    """The joined windows of `width` characters whose entropy is at least `least` bits.

    With counts n_c in a window, the entropy is log2(width) - sum(n_c log2 n_c) / width; a step changes two counts.
    """
    if len(run) < width:
        return []
    weigh = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    limit = (math.log2(width) - least) * width + 1e-9
    found: list[list[int]] = []
    for i, c in enumerate(run):
        if i >= width:
            old = run[i - width]
            n = counts[old]
            total += weigh[n - 1] - weigh[n]
            counts[old] = n - 1
        n = counts.get(c, 0)
        total += weigh[n + 1] - weigh[n]
        counts[c] = n + 1
        if i >= width - 1 and total <= limit:
            start = i - width + 1
            if found and start <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([start, i + 1])
    return [(a, b) for a, b in found]


def counting(value: str) -> bool:
    """Whether most neighbours are equal or one apart, as in aaaa, abcdef and 98765."""
    steps = [ord(b) - ord(a) for a, b in zip(value, value[1:])]
    return max((steps.count(k) for k in (0, 1, -1)), default=0) > 0.6 * len(steps)


def allowed(value: str) -> bool:
    """Whether the allow list explains a string of high entropy: counting, or words in paths and names.

    Its parts between separators must be letters with up to four digits at the end, or short numbers, and the letters,
    parted where the case changes as in names, must come in runs of LEAST_WORD on average. Random letters do not.
    Time grows with the length alone: no pattern can be matched in two ways.
    """
    if counting(value):
        return True
    parts = PARTS.findall(value)
    if not all(WORDLIKE.fullmatch(p) for p in parts):
        return False
    runs = SYLLABLES.findall(value)
    return sum(map(len, runs)) >= LEAST_WORD * len(runs)


def entropy_spans(run: str, width: int, least: float) -> list[tuple[int, int]]:
    """Spans of high entropy that the allow list does not explain; placeholders part a run and are no part of a span."""
    if allowed(run):
        return []
    found, at = [], 0
    for start, end in [*(m.span() for m in PLACEHOLDER.finditer(run)), (len(run), len(run))]:
        for a, b in window_spans(run[at:start], width, least):
            if not allowed(run[at + a : at + b]):
                found.append((at + a, at + b))
        at = end
    return found


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        for kind, (runs, width, least) in CLASSES.items():
            for run in runs.finditer(m[0]):
                at = m.start() + run.start()
                found += [(at + a, at + b, kind) for a, b in entropy_spans(run[0], width, least)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add the array column `out` of (start, end, kind) to df."""
    held = free_name(df, "scanned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(x)] for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(spans, ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], out])

    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, SPANS)])
    return kept.withColumn(held, text_or_empty(text)).mapInArrow(run, schema)


def secret_digest(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, counts of the known shapes, the digest of their spans, and all spans as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                shown = [(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in spans]
                base = [s for k, s in shown if k in KINDS[:3]]
                n = [sum(k == kind for k, _ in shown) for kind in KINDS[:3]]
                rows.append((*n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(s for _, s in shown)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = find_secrets(df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text"))).select("doc_id", "secrets")
    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
