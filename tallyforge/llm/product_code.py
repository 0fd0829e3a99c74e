"""Model codes in titles and model fields: series letters, a number, a variant suffix."""

from __future__ import annotations

import re

# Suffixes that name a variant.
SUFFIXES = ("XL", "II", "L", "S", "PLUS")
_CODE = re.compile(r"(?<![^\W_])([A-Z]{2,3})[\s.–—_-]{0,3}(\d{3,6})(?:[\s./–—_-]{0,3}(XL|II|L|S|PLUS)(?![^\W_])|\s?(\+)(?![^\W_]))?(?![^\W_])")
_FILLER = re.compile(r"(?:\s+(?:[*!+-]+|top|ok|used|cnc|neu|new))+\s*$", re.I)


def parse(text: str | None) -> tuple[str, str, str] | None:
    """(letters, number, suffix) of the first code in a text."""
    if not text:
        return None
    m = _CODE.search(" ".join(text.upper().split()))
    return (m[1], m[2], m[3] or ("PLUS" if m[4] else "")) if m else None


def is_title(line: str) -> bool:
    """A title names the machine; a sentence about it, or about another one, ends with a point or is long."""
    s = _FILLER.sub("", line.strip())
    return bool(s) and s[-1] not in ".:" and len(s.split("(")[0].split()) <= 14 and ":" not in s


def title_code(main_lines: list[str], strict: bool = True) -> str:
    """The code of the first title among main-body lines, as one word; empty where none has one."""
    for line in main_lines:
        if (not strict or is_title(line)) and (got := parse(line)):
            return "".join(got)
    return ""
