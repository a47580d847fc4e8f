"""Vectorised splitting of texts into words, for a whole Arrow slice at a time.

All functions work on the UTF-8 bytes of many documents at once and never let a word cross a document's end.
"""

from __future__ import annotations

import numpy as np

from tributary.llm.runtime import Texts, kept

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


def _classes() -> np.ndarray:
    """The class of every code point, by Unicode properties L, N and White_Space; UNKNOWN where this Python knows none."""
    import unicodedata

    known = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in known:
            out[c] = known[kind[0]]
        elif kind == "Cn":
            out[c] = UNKNOWN
    out[[*range(9, 14), 0x85]] = SPACE
    return out


def classes() -> np.ndarray:
    return kept("classes", _classes)


def class_of(cps: np.ndarray) -> np.ndarray:
    """Classes of code points. The tokenizers library may know a newer Unicode than Python: it is asked about what Python doesn't know."""
    table = classes()
    cls = table[cps]
    if (cls == UNKNOWN).any():
        from tokenizers import pre_tokenizers

        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in np.unique(cps[cls == UNKNOWN]):
            alone = [len(split(x + chr(c))) == 1 for x in "a1!"]
            table[c] = alone.index(True) if True in alone else SPACE
        cls = table[cps]
    return cls


def code_points(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte where each begins (and the end), and for each document the index of its first."""
    data = t.data
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(t.n + 1, np.int64)
    if data.max() < 128:
        at = np.arange(len(data) + 1)
        return data.astype(np.uint32), at, t.offsets
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.append(lead, len(data))
    return cps, at, np.searchsorted(lead, t.offsets)


def byte_level_words(t: Texts, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Words of the byte-level pattern ('s|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces).

    Returns the byte offsets of all words (one more than words) and the number of words of each document.
    A special string is a word of its own and ends what stands before it.
    """
    cps, at, first = code_points(t)
    n = len(cps)
    if not n:
        return np.zeros(1, np.int64), np.zeros(t.n, np.int64)
    cls = class_of(cps)
    breaks = np.zeros(n + 1, bool)
    breaks[first] = True
    breaks[n] = True
    inner = []
    if special:
        for p in _places(t, special):
            i = int(np.searchsorted(at, p))
            breaks[i] = breaks[i + len(special)] = True
            inner.append((i + 1, i + len(special)))
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = (cls[1:] != cls[:-1]) | breaks[1:n]
    space = cls == SPACE
    blank = cps == 32
    joined = np.zeros(n, bool)  # a blank stands before, in the same document
    joined[1:] = blank[:-1] & ~breaks[1:n]
    start = run & (space | ~joined)
    # the last character of spaces that something follows
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~breaks[1:n]
    start |= last
    quote = np.flatnonzero((cps[:-1] == 39) & run[:-1] & ~joined[:-1] & run[1:] & (cls[1:] == LETTER) & ~breaks[1:n])
    if len(quote):
        _contractions(cps, breaks, start, quote)
    for a, b in inner:
        start[a:b] = False
    begin = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(begin, first))
    return np.append(at[begin], len(t.data)), counts


def _places(t: Texts, special: bytes) -> list[int]:
    data = t.data.tobytes()
    out, p = [], data.find(special)
    while p >= 0:
        d = int(np.searchsorted(t.offsets, p, side="right")) - 1
        if p + len(special) <= t.offsets[d + 1]:
            out.append(p)
            p = data.find(special, p + len(special))
        else:
            p = data.find(special, p + 1)
    return out


def _contractions(cps: np.ndarray, breaks: np.ndarray, start: np.ndarray, quote: np.ndarray) -> None:
    n = len(cps)
    one = cps[quote + 1]
    two = np.zeros(len(quote), np.uint32)
    ok = (quote + 2 < n) & ~breaks[np.minimum(quote + 2, n)]
    two[ok] = cps[quote[ok] + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    letters = classes()
    for hit, size in ((quote[short], 2), (quote[long], 3)):
        start[hit + 1] = False
        end = hit + size
        end = end[end < n]
        end = end[letters[cps[end]] == LETTER]
        start[end] = True


def blank_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D: begins, ends, and the number for each document."""
    data = t.data
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(t.n, np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    begin = np.empty(n, bool)
    begin[0] = word[0]
    begin[1:] = word[1:] & (~word[:-1] | edge[1:n])
    end = np.empty(n, bool)
    end[-1] = word[-1]
    end[:-1] = word[:-1] & (~word[1:] | edge[1:n])
    b = np.flatnonzero(begin)
    return b, np.flatnonzero(end) + 1, np.diff(np.searchsorted(b, t.offsets))


M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the public splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial in an odd base, then mixed with the length."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    powers = _powers(base, int(length.max()) + 1)
    where = np.repeat(begin, length)
    at = np.repeat(np.cumsum(length) - length, length)
    k = np.arange(len(where)) - at
    value = (data[where + k].astype(np.uint64) + np.uint64(1)) * powers[k]
    total = np.add.reduceat(value, np.cumsum(length) - length)
    return mix(total + length.astype(np.uint64) * M1)


def gram_hashes(words: np.ndarray, k: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """The hash of the k words from each place on; the last k-1 places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    b = np.uint64(base)
    for i in range(1, k):
        out *= b
        out += words[i : i + n]
    return mix(out)
