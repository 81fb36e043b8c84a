"""Text as a reader sees it: without markup, encoding damage, invisible characters, accents and case."""

from __future__ import annotations

import html
import re
import unicodedata

#: A tag, a declaration or an instruction, of any length. "<" before anything but a name is text.
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9:-]*|[!?][a-zA-Z\[]+)(?:[\s/\[][^<>]*)?>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
#: UTF-8 bytes that were read as a one-byte encoding: a lead byte and its continuation bytes.
_BYTES = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_UNSEEN = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿︀-️]")

# fixed values: letters of other scripts that look like Latin ones
_LIKE = str.maketrans(
    "абвгеёіјкмнопрстухѕԁһӏ" + "αβεικνορτυχ",
    "a6breeijkmhonpctyxsdhl" + "abeiknoptux",
)


def _undamage(m: re.Match[str]) -> str:
    for code in ("latin-1", "cp1252"):
        try:
            return m.group().encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return m.group()


# fixed values: elements that stand inside a word or a line, so that their tags separate nothing
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split()
)
# fixed values: what a reader never sees, from its beginning to its end, and what remains in its place
_HIDDEN = (("<!--", "-->", ""), ("<script", "</script>", " "), ("<style", "</style>", " "))


def _without(text: str, begin: str, end: str, instead: str) -> str:
    """``text`` without all from ``begin`` to the next ``end``, however long, in any case; a part that never ends stays."""
    low = text.lower()
    if len(low) != len(text):
        # a few letters change their length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    parts, at = [], 0
    while (start := low.find(begin, at)) >= 0 and (stop := low.find(end, start + len(begin))) >= 0:
        parts += [text[at:start], instead]
        at = stop + len(end)
    return "".join([*parts, text[at:]]) if parts else text


def _untag(m: re.Match[str]) -> str:
    return "" if m.group(1).lower().lstrip("/") in _INLINE else " "


def visible(text: str) -> str:
    """``text`` without tags, comments, scripts, entities, wrongly decoded bytes and invisible characters.

    Tags of inline elements vanish, all others leave a space. Nothing of it depends on a length.
    """
    if "<" in text:
        for hidden in _HIDDEN:
            text = _without(text, *hidden)
        text = _TAG.sub(_untag, text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if not text.isascii():
        text = _BYTES.sub(_undamage, text)
        text = _UNSEEN.sub("", text)
    return text


def folded(text: str) -> str:
    """:func:`visible` text in lower case, ligatures taken apart, without accents, look-alike letters as Latin ones."""
    text = visible(text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_LIKE)
