"""Secrets in texts: three fixed kinds of patterns, and stretches whose characters are too evenly spread to be words.

For each character class, maximal runs of its characters are candidates. A window slides over a candidate; character counts, and with
them the Shannon entropy, are updated for the character that leaves and the one that comes. Windows whose entropy reaches the limit of the
class are merged into one span. The limit is what 95% of random windows of the class reach. Two allow-lists suppress windows, not whole runs:
words (a window that touches an occurrence of one is off) and shapes (a window that has the shape as a whole is off). A span that lies inside one of a fixed
kind, or inside one of a narrower class, is left out.

Defined results: null is the empty text; an empty text has no spans; positions are code points, ends exclusive; spans that begin together come in the
order of KINDS; rows that repeat an id or a text get a row each; an empty table gives an empty table; a text of any length is scanned whole, in time
that grows with its length (and a logarithm of its fixed spans); other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.llm.common import slices, texts_of

#: The patterns of the contract and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these is in every text that has an assignment.
ASSIGN_HINTS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_lower", "entropy_upper", "entropy_base64")
WINDOW = 16


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    run: re.Pattern
    window: int
    bits: float


#: Narrow classes first. The limits, in bits, that 95% of random windows of 16 characters of the class reach.
CLASSES = (
    CharacterClass("entropy_hex", re.compile(r"[0-9A-Fa-f]{16,}"), WINDOW, 2.85),
    CharacterClass("entropy_lower", re.compile(r"[0-9a-z]{16,}"), WINDOW, 3.32),
    CharacterClass("entropy_upper", re.compile(r"[0-9A-Z]{16,}"), WINDOW, 3.32),
    CharacterClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_-]{16,}"), WINDOW, 3.5),
)
#: What is harmless wherever it stands in a run: UUIDs, running alphabets, placeholders.
ALLOWED_WORDS = re.compile(
    r"(?i)(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])"
    r"|0123456789|1234567890|abcdefghij|qwertyuiop|example|placeholder|changeme|dummy|sample|x{6,}"
)
#: What a whole window may look like, as names, paths and numbers do: between joining marks, letters with up to four digits behind them, or digits.
ALLOWED_SHAPES = (re.compile(r"(?:(?:[A-Za-z]*[0-9]{0,4}|[0-9]*)[-_/+])*(?:[A-Za-z]*[0-9]{0,4}|[0-9]*)"),)
DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class SecretScan:
    classes: tuple[CharacterClass, ...] = CLASSES
    words: re.Pattern = ALLOWED_WORDS
    shapes: tuple[re.Pattern, ...] = ALLOWED_SHAPES
    steps: dict[int, list[float]] = field(default_factory=dict, compare=False)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end), by start and then in the order of KINDS."""
        fixed = [("hex", *m.span()) for m in HEX.finditer(text)]
        if "AKIA" in text:
            fixed += [("access", *m.span()) for m in ACCESS.finditer(text)]
        lower = text.lower()
        if any(hint in lower for hint in ASSIGN_HINTS):
            fixed += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
        spans = fixed
        for kind in self.classes:
            found = [(kind.kind, *stretch) for run in kind.run.finditer(text) for stretch in self.even_stretches(run[0], run.start(), kind)]
            if found:
                covered = _Cover(spans)
                spans = spans + [span for span in found if not covered.holds(span[1], span[2])]
        return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))

    def even_stretches(self, run: str, offset: int, kind: CharacterClass) -> Iterator[tuple[int, int]]:
        """The merged windows of ``run`` whose entropy reaches that of the class and that no allow-list suppresses."""
        if not DIGIT.search(run):  # such a run has the shape of a name in every window
            return
        size = kind.window
        cost = self.steps.get(size)
        if cost is None:  # what a count adds to the sum of c * log2(c) when it becomes c
            cost = self.steps[size] = [0.0] + [c * math.log2(c) - ((c - 1) * math.log2(c - 1) if c > 1 else 0.0) for c in range(1, size + 2)]
        most = size * (math.log2(size) - kind.bits) + 1e-9
        words = self.words.finditer(run)
        word = next(words, None)
        counts: dict[str, int] = {}
        weight, first, last = 0.0, -1, -1
        for place, char in enumerate(run):
            counts[char] = counts.get(char, 0) + 1
            weight += cost[counts[char]]
            start = place - size + 1
            if start < 0:
                continue
            if start:
                gone = run[start - 1]
                weight -= cost[counts[gone]]
                counts[gone] -= 1
            while word and word.end() <= start:
                word = next(words, None)
            if weight > most or (word and word.start() <= place) or any(shape.fullmatch(run, start, place + 1) for shape in self.shapes):
                continue
            if first >= 0 and start > last:
                yield offset + first, offset + last
                first = -1
            if first < 0:
                first = start
            last = place + 1
        if first >= 0:
            yield offset + first, offset + last


class _Cover:
    """Whether one of many spans holds a stretch: the furthest end among the spans that begin no later."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        ordered = sorted((start, end) for _, start, end in spans)
        self.starts = [start for start, _ in ordered]
        self.ends = list(accumulate((end for _, end in ordered), max))

    def holds(self, start: int, end: int) -> bool:
        place = bisect_right(self.starts, start)
        return place > 0 and self.ends[place - 1] >= end


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: SecretScan = SecretScan()) -> DataFrame:
    """(id, spans): one row per document; a span has kind, start, end and the text found."""
    id_type = docs.schema[id_col].dataType
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
    schema = T.StructType([T.StructField("id", id_type), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans = [[{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in scan.spans(text)] for text in texts_of(part).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, arrow)], ["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan_batches, schema)
