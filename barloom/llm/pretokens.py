"""Pre-tokens of whole columns of texts, in numpy, by the pattern of the byte-level vocabularies:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Code points are classed by a table; runs of a class are pre-tokens, with the one space before them if there is one, and
of a run of blanks all but the last. The three exceptions of the pattern move starts, they need no scan.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for low in range(0, 0x110000, 0x10000):
            if low == 0xD0000:
                continue
            text = "".join(map(chr, range(low, low + 0x10000)))
            for m in regex.finditer(pattern, text):
                table[low + m.start() : low + m.end()] = kind
    return table


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all pre-tokens of valid UTF-8, and each text's first one's number (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    lead = (data & 0xC0) != 0x80
    if lead.all():
        points, at, cut = data, None, off
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero(lead), len(data))
        cut = np.searchsorted(at, off)
    kind = _classes()[points]
    n = len(points)
    edge = np.empty(n + 1, bool)  # a class ends, or a text
    edge[0] = edge[n] = True
    edge[1:n] = kind[1:] != kind[:-1]
    edge[cut] = True
    start = edge[:n].copy()
    runs = np.flatnonzero(edge)
    a, b = runs[:-1], runs[1:]
    k = kind[a]
    ends_text = np.zeros(n + 1, bool)
    ends_text[cut] = True
    inner = (k == BLANK) & ~ends_text[b]  # blanks with something behind
    last = b[inner] - 1
    start[last] = True  # the last blank leaves its run
    spaced = last[points[last] == 0x20] + 1
    start[spaced] = False  # and, if a space, joins what follows
    # 's 't 'm 'd 're 've 'll: a lone apostrophe that begins a pre-token and its letters
    q = a[(k == OTHER) & (b - a == 1)]
    q = q[(points[q] == 0x27) & start[q] & ~ends_text[np.minimum(q + 1, n)] & (q + 1 < n)]
    if len(q):
        one = points[q + 1]
        two = np.where(~ends_text[q + 2] if n + 1 > (q + 2).max() else False, points[np.minimum(q + 2, n - 1)], 0) if len(q) else one
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for which, length in ((short, 1), (long, 2)):
            s = q[which]
            start[s + 1] = False
            then = s + 1 + length
            then = then[then < n]
            start[then[kind[then] == LETTER]] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    first = np.searchsorted(begin, cut)
    if at is not None:
        begin, end = at[begin], at[end]
    return begin, end, first
