"""Recognised string formats, each as a Python test and as a column expression.

Formats stand from the most to the least specific; of several that fit all strings of a
place, the first names it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names and patterns of the formats. \A and \Z hold at the ends only.
HEX = "[0-9a-fA-F]"
#: White space as JavaScript's \s has it.
JS_SPACE = "\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
PATTERNS = {
    "VscodeCallId": "call_[A-Za-z0-9]+__vscode-[0-9]+",
    "Uuid": f"{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}",
    "Sha256": f"{HEX}{{64}}",
    "Sha1": f"{HEX}{{40}}",
    "Semver": r"v?[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?",
    "Email": f"[^{JS_SPACE}@]+@[^{JS_SPACE}@]+\\.[^{JS_SPACE}@]+",
    "IsoDate": r"[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?",
    "Url": r"[a-zA-Z][a-zA-Z0-9+.-]*://.*",
    "Hex": f"({HEX}{HEX}){{4,}}",
}
#: A text of which even the shortest is longer than this is a Blob.
BLOB_OVER = 50
# The families that model ids begin with.
MODEL_FAMILIES = "claude codestral deepseek devstral gemini glm gpt grok kimi llama mistral o qwen".split()


def utf16_length(s: str) -> int:
    return len(s) + sum(c > "\uffff" for c in s)


def utf16_key(s: str) -> bytes:
    """Sorts strings as JavaScript does."""
    return s.encode("utf-16-be", "surrogatepass")


@dataclass(frozen=True)
class Format:
    """A named kind of string. evidence: one string at least must meet it too."""

    name: str
    test: Callable[[str], bool]
    evidence: Callable[[str], bool] | None = None
    column: Callable[[Column], Column] | None = None
    evidence_column: Callable[[Column], Column] | None = None


def _by_pattern(name: str) -> Format:
    whole = re.compile(PATTERNS[name], re.S)
    java = f"(?s)\\A(?:{PATTERNS[name]})\\z"
    return Format(name, lambda s: whole.fullmatch(s) is not None, column=lambda c: F.coalesce(c.rlike(java), F.lit(False)))


_BASE64 = re.compile("[A-Za-z0-9+/]+=*")


def _is_base64(s: str) -> bool:
    return len(s) >= 24 and len(s) % 4 == 0 and _BASE64.fullmatch(s) is not None


def is_path_key(key: str) -> bool:
    """Keys that make an object look like a map of paths."""
    return "/" in key or "\\" in key or key.startswith("~")


def path_key_column(c: Column) -> Column:
    return F.contains(c, F.lit("/")) | F.contains(c, F.lit("\\")) | F.startswith(c, F.lit("~"))


def is_model_id(s: str) -> bool:
    low = s.lower()
    family = any(low == f or low.startswith((f + "-", f + ".")) for f in MODEL_FAMILIES)
    return family and re.fullmatch("[A-Za-z0-9][A-Za-z0-9._:-]*", s) is not None and re.search("[0-9]", s) is not None


def model_id_column(c: Column) -> Column:
    shape = f"(?i)\\A({'|'.join(MODEL_FAMILIES)})(\\z|[-.])"
    return c.rlike("\\A[A-Za-z0-9][A-Za-z0-9._:-]*\\z") & c.rlike(shape) & c.rlike("[0-9]")


MODEL_ID = Format("ModelId", is_model_id, column=model_id_column)
_PATH = Format("Path", lambda s: "/" in s or "\\" in s, column=lambda c: F.contains(c, F.lit("/")) | F.contains(c, F.lit("\\")))
_B64 = Format(
    "Base64", _is_base64, lambda s: s.endswith("="),
    lambda c: (F.length(c) >= 24) & (F.length(c) % 4 == 0) & c.rlike("\\A[A-Za-z0-9+/]+=*\\z"), lambda c: F.endswith(c, F.lit("=")),
)
FORMATS: tuple[Format, ...] = (*(_by_pattern(n) for n in PATTERNS if n != "Hex"), _PATH, _by_pattern("Hex"), _B64)


def common_format(strings: Iterable[str], formats: Iterable[Format] = FORMATS) -> str:
    """The first format that all strings have, or "string"."""
    strings = list(strings)
    for f in formats:
        if all(map(f.test, strings)) and (f.evidence is None or any(map(f.evidence, strings))):
            return f.name
    return "string"


def format_of(c: Column, formats: Iterable[Format] = FORMATS) -> Column:
    """Each value's own first format, or "string"."""
    out = F.lit("string")
    for f in reversed(list(formats)):
        fits = f.column(c) if f.evidence_column is None else f.column(c) & f.evidence_column(c)
        out = F.when(fits, F.lit(f.name)).otherwise(out)
    return out


def common_format_agg(c: Column, formats: Iterable[Format] = FORMATS) -> Column:
    """An aggregate: the first format that all non-null values have; "Blob" for long ones without, else "string"."""
    out = F.when(F.min(F.length(c)) > BLOB_OVER, F.lit("Blob")).otherwise(F.lit("string"))
    for f in reversed(list(formats)):
        fits = F.bool_and(f.column(c))
        if f.evidence_column is not None:
            fits = fits & F.bool_or(f.evidence_column(c))
        out = F.when(fits, F.lit(f.name)).otherwise(out)
    return out
