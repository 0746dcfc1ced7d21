"""Words of a text, the same whatever its case, markup, escapes and invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtbf])")
#: Soft hyphen, zero-width and direction marks, joiners, byte order mark, variation selectors.
_INVISIBLE = re.compile("[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\ufe00-\\ufe0f\\ufeff]")
#: UTF-8 read as Latin-1 or Windows-1252: a lead byte's character and continuation bytes' characters.
_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_MOJIBAKE = re.compile("[\\u00c2-\\u00f4][\\u0080-\\u00bf%s]{1,3}" % "".join(_CP1252))


def _redecode(m: re.Match) -> str:
    try:
        return bytes(_CP1252.get(c, ord(c) & 0xFF if ord(c) < 256 else 0x3F) for c in m[0]).decode()
    except UnicodeDecodeError:
        return m[0]


def visible(text: str) -> str:
    """The text as a reader would see it: decoded, without markup and invisible characters."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", _MOJIBAKE.sub(_redecode, text))
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return text


def canonical_words(text: str) -> list[str]:
    return WORD.findall(visible(text).casefold())
