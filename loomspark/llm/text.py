"""Reading texts as words, whatever their markup, case, accents and letter forms."""

from __future__ import annotations

import html
import unicodedata

import regex

_BREAK = regex.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|pre|section|article)\b[^<>]{0,1000}>", regex.I)
_TAG = regex.compile(r"<[a-zA-Z/!?][^<>]{0,1000}>")
_UNSEEN = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def folded(text: str) -> str:
    """The text without markup, invisible characters and accents, in lower case and compatibility letter forms."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if text.isascii():
        return text.lower()
    return _UNSEEN.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()))


def words(text: str | None) -> list[str]:
    """The words of a text; none of a null or empty one."""
    return _WORD.findall(folded(text)) if text else []
