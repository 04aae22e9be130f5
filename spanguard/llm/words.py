"""Vectorized lower-casing, word splitting and word hashing over UTF-8 buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and the base of the polynomial word hash.
BYTE_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and every byte of a multi-byte character.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the two-byte capitals U+00C0 to U+00DE."""
    out = _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if lead.size:
        at = lead + 1
        second = raw[at]
        capital = at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
        out[capital] += 32
    return out


def word_mask(raw: np.ndarray) -> np.ndarray:
    """True where a byte belongs to a word; common multi-byte punctuation and spaces separate words."""
    mask = _WORD[raw]
    if raw.size and raw.max() >= 0x80:
        lead = np.flatnonzero(raw[:-1] == 0xC2)
        if lead.size:
            second = raw[lead + 1]
            lead = lead[(second != 0xAA) & (second != 0xB5) & (second != 0xBA)]
            mask[lead] = mask[lead + 1] = False
        lead = np.flatnonzero(raw[:-2] == 0xE2)
        if lead.size:
            second, third = raw[lead + 1], raw[lead + 2]
            lead = lead[(second == 0x80) | (second == 0x81) & (third != 0xB1) & (third != 0xBF)]  # not the letters U+2071, U+207F
            mask[lead] = mask[lead + 1] = mask[lead + 2] = False
    return mask


@dataclass
class Words:
    """The words of a run of texts, in order: byte spans, row of each, polynomial hash of each."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def first_of_row(self, rows: int) -> np.ndarray:
        """Index of the first word of each row, and one more entry: the number of words."""
        return np.searchsorted(self.row, np.arange(rows + 1))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def split_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts that raw holds; a word never crosses from one text into the next."""
    low = lower_bytes(raw) if lower else raw
    mask = word_mask(raw)
    edge = np.zeros(raw.size + 1, dtype=bool)
    edge[:-1] = mask
    edge[1:] ^= mask  # now true where the mask changes
    edge[0] = mask[0] if raw.size else False
    inner = np.unique(offsets[1:-1])  # empty texts repeat an offset
    inner = inner[(inner > 0) & (inner < raw.size)]
    cuts = inner[mask[inner] & mask[inner - 1]] if inner.size else inner
    at = np.flatnonzero(edge)
    if cuts.size:  # a text ends inside a run of word bytes
        at = np.sort(np.concatenate([at, cuts, cuts]))
    start, end = at[0::2], at[1::2]
    if not start.size:
        empty = np.zeros(0, dtype=np.int64)
        return Words(low, empty, empty, empty, np.zeros(0, dtype=np.uint64))
    size = end - start
    longest = int(size.max())
    power = powers(longest)
    chars = np.flatnonzero(mask)
    first = np.cumsum(size) - size
    place = np.arange(chars.size, dtype=np.int64) - np.repeat(first, size)
    value = BYTE_VALUE[low[chars]] * power[place]
    hashed = mix(np.add.reduceat(value, first))
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(low, start, end, row, hashed)
