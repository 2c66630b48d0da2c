"""Text primitives shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata

#: Words: maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")

#: Characters without a glyph or an advance of their own (fixed values, Unicode
#: Default_Ignorable_Code_Point in the ranges that occur in prose).
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻"
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_ALL = frozenset(chr(c) for c in range(0x10000) if _INVISIBLE.match(chr(c)))


def strip_invisible(text: str) -> str:
    if text.isascii() or _ALL.isdisjoint(text):
        return text
    return _INVISIBLE.sub("", text)


def plain(text: str) -> str:
    """Compatibility-composed, without invisible characters, lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", strip_invisible(text))
    return text.lower()


def words(text: str | None) -> list[str]:
    """Words of ``plain(text)``; none for null."""
    return WORD.findall(plain(text)) if text else []


def visible(text: str | None) -> bool:
    """Whether anything in the text leaves a mark on the page."""
    return bool(text) and bool(strip_invisible(text).strip())
