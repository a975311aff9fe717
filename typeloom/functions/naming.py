"""Names of declarations: pure string rules, and their column forms."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def pascal(text: str) -> str:
    """Runs of ASCII letters and digits, each with a capital first letter, put together."""
    return "".join(w[0].upper() + w[1:] for w in re.findall("[A-Za-z0-9]+", text)) or "Variant"


def pascal_column(c: Column) -> Column:
    words = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")
    return F.when(joined == "", F.lit("Variant")).otherwise(joined)


def is_identifier(key: str) -> bool:
    return re.fullmatch("[A-Za-z_$][A-Za-z0-9_$]*", key) is not None


def identifier_column(c: Column) -> Column:
    return c.rlike("\\A[A-Za-z_$][A-Za-z0-9_$]*\\z")


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:8]


def short_hash_column(c: Column) -> Column:
    return F.substr(F.sha2(c, 256), F.lit(1), F.lit(8))


def not_a_digit(name: str) -> str:
    return f"${name}" if name[:1].isdigit() and name[:1].isascii() else name


def quoted(text: str) -> str:
    """A string as JSON has it; lone surrogates are escaped."""
    out = json.dumps(text, ensure_ascii=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", out)


def number_text(x: float | int) -> str:
    """A number as JavaScript prints it."""
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = f"{x!r}".partition("e")
    if exponent:
        e = int(exponent)
        if -7 < e < 21:
            sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
            plain = digits.replace(".", "")
            return f"{sign}0.{'0' * (-e - 1)}{plain}"
        return f"{digits.removesuffix('.0')}e{e:+d}"
    return digits


@dataclass(frozen=True)
class Place:
    """Where a node stands: chain (for hashes), shown (for readers), field (the last property)."""

    chain: str = ""
    shown: str = ""
    field: str = ""

    def _below(self, segment: str, shown: str, **more) -> Place:
        return replace(self, chain=f"{self.chain}_{segment}" if self.chain else segment, shown=shown, **more)

    def property(self, key: str) -> Place:
        return self._below(pascal(key), f"{self.shown}.{key}" if self.shown else key, field=key)

    def item(self) -> Place:
        return self._below("Item", f"{self.shown}[]")

    def value(self) -> Place:
        return self._below("Value", f"{self.shown}{{}}")

    def option(self, tag: str | None) -> Place:
        label = "Variant" if tag is None else tag
        return self._below("Variant" if tag is None else pascal(tag), f"{self.shown} -> {label}" if self.shown else label)

    def option_name(self, tag: str | None) -> str:
        leaf = "Variant" if tag is None else tag
        mark = short_hash(f"{self.chain}_{leaf}" if self.chain else leaf)
        parts = [pascal(self.field)] if self.field else []
        return not_a_digit("_".join([*parts, pascal(leaf), mark]))
