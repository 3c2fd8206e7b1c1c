"""Folding of texts to plain words: case, accents, markup and invisible characters don't matter."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import regex

#: Letters that look like Latin ones, fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ſ": "s", "æ": "ae", "œ": "oe",
}

_TAG = regex.compile(r"</?[A-Za-z][^<>]*>")
_ENTITY = regex.compile(r"&(#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}ᅟᅠㅤﾠ͏]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def _without_comments(text: str) -> str:
    """text without <!-- -->; linear, as an open comment ends the search."""
    parts, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        parts.append(text[at:start])
        at = end + 3
    return "".join([*parts, text[at:]])


def plain(text: str) -> str:
    """text without markup of any length, invisible characters, accents and case."""
    if "<" in text:
        text = _TAG.sub("", _without_comments(text))
    if "&" in text:
        import html

        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    return text.casefold()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the plain text; none of a null text."""
    return _WORD.findall(plain(text)) if text else []


def fold_letters(text: str, table: dict[int, str] = str.maketrans(HOMOGLYPHS)) -> str:  # noqa: B008
    """plain text with look-alike letters as Latin ones."""
    return text if text.isascii() else text.translate(table)


def join(parts: Sequence[str]) -> str:
    return " ".join(parts)
