"""Least-gram runs: the first digit shared by the two exact repeat finders.

A text is a row of units (bytes, or words).  A window is ``size`` consecutive
units.  Every window is keyed by the least hash among the grams of ``gram``
units inside it, so two equal windows always carry equal keys, and consecutive
windows mostly share theirs.  Consecutive windows with one key form a *run*, of
at most ``size - gram + 1`` windows: about two runs for each ``size`` units
leave the map side in place of one row for each unit.  Nothing is lost: windows
can only be equal inside one key.

A key only brings together what is compared later; that two runs have one
wording is decided by 128 bits of XXH3 over the bytes that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest

#: Odd, so that powers can be undone modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Texts are joined to pieces of about so many bytes, which fit a core's cache.
CHUNK = 1 << 18
#: Bytes of the grams by which byte windows are keyed.
GRAM = 16

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the next call up to the size of a piece."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for x in (BASE, UNDO):
        steps = np.full(max(n, 2 * CHUNK), x, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    for k, x in enumerate(made):
        _powers[k] = x[: 2 * CHUNK].copy()
    return made[0][:n], made[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of x counts."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Polynomial hashes of short spans of a row of well mixed 64-bit unit values.

    Only for spans of few units: over a thousand and more there are pairs of
    spans that no multiplier tells apart.
    """

    def __init__(self, units: np.ndarray):
        up, self.down = powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def eights(b: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each place on (and from the end) as one number, zeros after the last; big: the first byte highest."""
    x = np.zeros(len(b) + 8, np.uint64)
    x[: len(b)] = b
    for k in (1, 2, 4):
        s = np.uint64(8 * k)
        x = x[:-k] << s | x[k:] if big else x[:-k] | x[k:] << s
    return x


def byte_grams(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    x = eights(b)
    return mixed(x[: max(0, len(b) - GRAM + 1)] ^ mixed(x[8 : max(8, len(b) - GRAM + 9)] + BASE))


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def joined(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last + 1, bytes, offsets) for pieces of about CHUNK bytes of whole texts."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK or i == len(texts) - 1:
            part = texts[first : i + 1]
            yield first, i + 1, b"".join(part), np.cumsum([0, *map(len, part)])
            first, held = i + 1, 0


def runs_of(grams: np.ndarray, covered: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> dict[str, np.ndarray] | None:
    """The runs of several texts that lie end to end; text d has the units bounds[d]:bounds[d + 1].

    grams: the hash of the ``gram`` units from each unit on.  covered: what the
    units are compared by, one value each.

    Returns for each run: doc (index of its text), lo (first window's start in
    the text), n (windows; negative if the least gram comes twice, so that
    windows of this one run may equal each other), key (least gram) and body
    and rest (128 bits for all units that its windows cover).
    """
    if len(covered) < size:
        return None
    keys = least(grams, size - gram + 1)
    last = bounds[1:] - size  # last window of each text
    doc = np.repeat(np.arange(len(last)), np.diff(bounds))[: len(keys)]
    valid = np.arange(len(keys)) <= last[doc]
    if not valid.any():
        return None
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & valid[:-1] & valid[1:] & (doc[1:] == doc[:-1])
    starts = np.flatnonzero(valid & ~same)
    ends = np.flatnonzero(valid & ~np.append(same[1:], False))
    if (most := size - gram + 1) < (ends - starts + 1).max(initial=0):  # periodic text: cut to runs of one gram's reach
        at = np.arange(len(keys))
        place = at - starts[np.maximum(np.searchsorted(starts, at, side="right") - 1, 0)]
        same &= place % most != 0
        starts = np.flatnonzero(valid & ~same)
        ends = np.flatnonzero(valid & ~np.append(same[1:], False))
    again = np.zeros(len(keys), np.int64)  # a window starts with its least gram and the next one finds it again
    again[:-1] = (grams[: len(keys) - 1] == keys[:-1]) & same[1:]
    twice = np.add.reduceat(again, starts) > 0
    n = ends - starts + 1
    raw, wide = memoryview(np.ascontiguousarray(covered)).cast("B"), covered.itemsize
    whole = b"".join([xxh3_128_digest(raw[a:z]) for a, z in zip((starts * wide).tolist(), ((ends + size) * wide).tolist(), strict=True)])
    body = np.frombuffer(whole, np.int64).reshape(-1, 2)
    return {
        "doc": doc[starts], "lo": starts - bounds[doc[starts]], "n": np.where(twice, -n, n),
        "key": keys[starts].view(np.int64), "body": body[:, 0], "rest": body[:, 1],
    }


#: Bytes of a word: all but white space, or letters and digits.
SPACED = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
LETTERS = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def word_spans(text: bytes, bounds: np.ndarray, within: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of several texts end to end; a word never crosses from one text to the next."""
    b = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(b) + 1, bool)
    inside[:-1] = within[b]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cut = bounds[(bounds > 0) & (bounds < len(b))]
    opens[cut] = inside[cut]
    start = np.flatnonzero(opens)
    closes = inside[:-1] & (~inside[1:] | opens[1:])
    return start, np.flatnonzero(closes) + 1


def word_keys(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each word: its own bytes and length up to 15 bytes, else 120 bits of XXH3."""
    x, n = eights(np.frombuffer(text, np.uint8)), end - start
    one = x[start] & _FIRST[np.minimum(n, 8)]
    two = x[np.minimum(start + 8, len(text))] & _FIRST[np.clip(n - 8, 0, 7)] | np.minimum(n, 255).astype(np.uint64) << np.uint64(56)
    if len(long := np.flatnonzero(n > 15)):
        whole = np.frombuffer(b"".join([xxh3_128_digest(text[a:z]) for a, z in zip(start[long].tolist(), end[long].tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        one[long], two[long] = whole[:, 0], whole[:, 1] | np.uint64(0xFF << 56)
    return one, two


def word_value(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A word's key as one well mixed 64-bit value."""
    return mixed(one ^ mixed(two + BASE))


def word_units_at(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return word_value(*word_keys(text, start, end))


def word_units(text: bytes, bounds: np.ndarray, within: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """A value for each word of several texts end to end, and the texts' bounds in words."""
    start, end = word_spans(text, bounds, within)
    return word_units_at(text, start, end), np.searchsorted(start, bounds)


def text_hash(text: bytes) -> int:
    """64 bits as a signed number, to tell texts under one doc_id apart."""
    h = xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h
