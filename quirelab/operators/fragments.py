"""The fragment of a text that shows a search best.

Cases: a null or empty text has the empty fragment. Without a match the text's beginning is shown. Words are looked for as they
are, in any case of letters; empty words nowhere. Of equally good fragments the first is shown. A single match that is longer
than the fragment is cut. Texts of any length are searched whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a fragment, characters of one without a match, characters of the whole with its marks.
FRAGMENT, PLAIN, CLIP = 300, 300, 500
OPEN, CLOSE, CUT = "<mark>", "</mark>", "…"


def best_span(text: str, matches: list[tuple[int, int]], size: int = FRAGMENT) -> tuple[int, int]:
    """The stretch of at most `size` bytes that holds the most whole matches, with equal context on both sides."""
    length = lambda a, b: len(text[a:b].encode("utf-8", "replace"))
    best, left, used, wide = (0, 0, 0), 0, 0, 0
    # Bytes between the first and the last match of the window, moved along with it.
    for k, (a, b) in enumerate(matches):
        used = length(a, b) if k == left else used + length(matches[k - 1][1], b)
        while left < k and used > size:
            used -= length(matches[left][0], matches[left + 1][0])
            left += 1
        if k - left + 1 > best[0]:
            best, wide = (k - left + 1, left, k), used
    a, b = matches[best[1]][0], matches[best[2]][1]
    room = size - wide
    if room <= 0:
        return a, a + len(text[a:b].encode("utf-8", "replace")[:size].decode("utf-8", "ignore"))
    # Half of what is left before, and what that leaves after.
    before = text[max(0, a - room) : a].encode("utf-8", "replace")
    lead = len(before[max(0, len(before) - room // 2) :].decode("utf-8", "ignore"))
    room -= length(a - lead, a)
    tail = len(text[b : b + room].encode("utf-8", "replace")[:room].decode("utf-8", "ignore"))
    return a - lead, b + tail


def clipped(marked: str, size: int = CLIP) -> str:
    """Cut to `size` characters, with no tag or character reference cut in two and an open mark closed."""
    if len(marked) <= size:
        return marked
    cut = re.sub(r"(<[^>]*|&[a-z0-9#]*)$", "", marked[: size - 1])
    return cut + (CLOSE if cut.count(OPEN) > cut.count(CLOSE) else "") + CUT


def fragment(text: str | None, words: Sequence[str]) -> str:
    if not text:
        return ""
    pattern = re.compile("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True) if w) or "(?!)", re.I)
    matches = [m.span() for m in pattern.finditer(text)]
    if not matches:
        return clipped(CUT + html.escape(text[:PLAIN], quote=True) + CUT)
    start, end = best_span(text, matches)
    out, at = [], start
    for a, b in matches:
        if a >= start and b <= end or a == start:
            out += [html.escape(text[at:a]), OPEN, html.escape(text[a : min(b, end)]), CLOSE]
            at = min(b, end)
    return clipped(CUT + "".join(out) + html.escape(text[at:end]) + CUT)


def best_fragment(text: Column, words: Sequence[str]) -> Column:
    """The best fragment, escaped, its words marked, with an ellipsis on both sides."""
    given = list(words)

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fragment(t, given))

    return shown(text)
