"""Text functions: markup stripping, normalization, hashing, redaction, truncation."""

import hashlib
import html
import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from articleflow.functions import ColumnOrName, as_column
from articleflow.schemas import string_struct

# Everything str.strip() removes, as one character set for Spark's btrim.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# The markup patterns that decide what counts as a block, a line break and a tag.
SCRIPT_OR_STYLE = r"(?is)<(script|style)\b.*?</\1>"
LINE_BREAK_TAG = r"(?i)<(br\s*/?|/p|/div|/li|/h[1-6])>"
ANY_TAG = r"(?s)<[^>]+>"
# Characters that collapse into one space.
SPACE_RUN = "[ \\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\u200b\ufeff]+"

_block_re, _break_re, _tag_re = re.compile(SCRIPT_OR_STYLE), re.compile(LINE_BREAK_TAG), re.compile(ANY_TAG)
_space_re = re.compile(SPACE_RUN)


def strip(col: ColumnOrName) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.btrim(as_column(col), F.lit(BLANKS))


def is_blank(col: ColumnOrName) -> Column:
    """NULL, empty or white space only. Trimming from the left alone stops at the first character of a text."""
    return F.coalesce(F.ltrim(as_column(col), F.lit(BLANKS)), F.lit("")) == ""


def filled(col: ColumnOrName) -> Column:
    """The value, or NULL where it is an empty string."""
    return F.nullif(as_column(col), F.lit(""))


def strip_html(col: ColumnOrName) -> Column:
    """Drop script and style blocks, turn closing block tags into newlines and other tags into spaces."""
    text = F.coalesce(as_column(col), F.lit(""))
    for pattern, replacement in ((SCRIPT_OR_STYLE, " "), (LINE_BREAK_TAG, "\n"), (ANY_TAG, " ")):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _tidy_line(line: str) -> str:
    """One line without invisible characters and with single spaces.

    A printable line holds no white space but U+0020, which settles most lines without looking at characters.
    """
    if not line.isprintable():
        other = {ord(c): None for c in set(line) if c != "\t" and unicodedata.category(c)[0] == "C"}
        line = _space_re.sub(" ", line.translate(other))
    elif "  " in line:
        line = _space_re.sub(" ", line)
    return line.strip()


def plain_text(value: str | None) -> str:
    """One text, decoded and laid out: no markup, NFKC, single spaces, at most one blank line in a row."""
    if not value:
        return ""
    text = html.unescape(value)
    if "<" in text:
        text = _tag_re.sub(" ", _break_re.sub("\n", _block_re.sub(" ", text)))
    text = unicodedata.normalize("NFKC", html.unescape(text))

    lines: list[str] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = _tidy_line(line)
        if line or (lines and lines[-1]):
            lines.append(line)
    return "\n".join(lines).strip()


def fingerprint(title: str, body: str | None) -> str:
    """SHA-256 over the case-folded words of title and body."""
    words = f"{plain_text(title)}\n{plain_text(body)}".casefold().split()
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


@arrow_udf(T.StringType())
def normalize_text(texts: pa.Array) -> pa.Array:
    return pa.array([plain_text(text) for text in texts.to_pylist()], pa.string())


@arrow_udf(T.StringType())
def content_hash(titles: pa.Array, bodies: pa.Array) -> pa.Array:
    pairs = zip(titles.to_pylist(), bodies.to_pylist())
    return pa.array([fingerprint(title, body) for title, body in pairs], pa.string())


@arrow_udf(string_struct("title", "body", "content_hash"))
def normalize_article(titles: pa.Array, bodies: pa.Array) -> pa.Array:
    """Normalized title and body with their hash, so that a body crosses into Python once."""
    out_titles = [plain_text(title) for title in titles.to_pylist()]
    out_bodies = [plain_text(body) for body in bodies.to_pylist()]
    hashes = [fingerprint(title, body) for title, body in zip(out_titles, out_bodies)]
    return pa.StructArray.from_arrays(
        [pa.array(values, pa.string()) for values in (out_titles, out_bodies, hashes)],
        ["title", "body", "content_hash"],
    )


# Secret patterns, applied in this order, with their replacements.
REDACTIONS = (
    (r"(?i)\b(authorization)\s*[:=]\s*\S+", "$1: [REDACTED]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._\-]+", "Bearer [REDACTED]"),
    (r"\bsk-[A-Za-z0-9._\-]{8,}", "[REDACTED_API_KEY]"),
    (r"(?i)\b(api[_-]?key|ai_api_key|token|secret)\s*[:=]\s*\S+", "$1=[REDACTED]"),
)
SECRET_MASK = "[REDACTED_API_KEY]"
MIN_SECRET_LENGTH = 6


# One of these words is part of every text the patterns change; U+017F is an s to a case-blind pattern.
_SECRET_WORDS = ("authorization", "bearer", "sk-", "key", "token", "secret", "\u017f")


def redact(col: ColumnOrName, *known_secrets: str) -> Column:
    """Mask whatever looks like a credential, then every known secret of six characters or more.

    ``(?U)`` gives the Java classes ``\\s``, ``\\S`` and ``\\b`` their Unicode meaning. Texts without any of the
    words that credentials come with skip the patterns.
    """
    text = as_column(col)
    masked = text
    for pattern, replacement in REDACTIONS:
        masked = F.regexp_replace(masked, "(?U)" + pattern, replacement)
    mentions = lambda lowered: reduce(lambda seen, word: seen | F.contains(lowered, F.lit(word)), _SECRET_WORDS, F.lit(False))
    result = F.when(F.exists(F.array(F.lower(text)), mentions), masked).otherwise(text)
    for secret in known_secrets:
        if len(secret) >= MIN_SECRET_LENGTH:
            result = F.replace(result, F.lit(secret), F.lit(SECRET_MASK))
    return result


def shorten(col: ColumnOrName, limit: int, suffix: str) -> Column:
    """Cut to ``limit`` characters and mark the cut."""
    text = as_column(col)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def http_error(status: ColumnOrName, url: ColumnOrName, body: ColumnOrName) -> Column:
    """Message for a failed request: code, URL and the first 200 characters of the white-space-collapsed body."""
    snippet = F.substring(F.regexp_replace(strip(F.coalesce(as_column(body), F.lit(""))), r"(?U)[\s\x1c-\x1f]+", " "), 1, 200)
    head = F.format_string("HTTP %d 응답: %s", as_column(status), as_column(url))
    return F.when(snippet == "", head).otherwise(F.concat(head, F.lit(" | 응답: "), snippet))
