"""Words as 64-bit hashes, and tables of values by such keys that tasks hold in part."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_threshold

#: A filter of keys has 2 ** SLOT_BITS numbers of 64 bits at most: when it fills up, more keys are looked up in vain, with the same result.
SLOT_BITS = 21
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_END = np.uint64(0x5851F42D4C957F2D)


def byte_values(separators: bytes = b"\t\n\v\f\r ", folded: bool = True) -> np.ndarray:
    """A random number for each byte: capital letters as small ones if ``folded``, and 0 for what separates words."""
    out = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)
    if folded:
        out[65:91] = out[97:123]
    out[list(separators)] = 0
    return out


WHITE_SPACE = byte_values()


def mixed(*parts: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of 64-bit numbers."""
    h = np.full(len(parts[0]), _STEP)
    for part in parts:
        h ^= part.view(np.uint64)
        h *= _SPREAD
        h ^= h >> np.uint64(32)
        h *= _STEP
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as planes of bytes, so that small numbers cost little."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), 1)


def unpacked(data: Iterable[bytes], columns: int) -> list[np.ndarray]:
    """The columns of all ``data``, one after the other."""
    planes = np.concatenate([np.zeros((columns, 8, 0), np.uint8), *[np.frombuffer(zstandard.decompress(x), np.uint8).reshape(columns, 8, -1) for x in data]], axis=2)
    return [np.ascontiguousarray(p.T).reshape(-1).view(np.int64) for p in planes]


def edges(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def dealt(key: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, packed columns) by the first bits of the keys, which are in order, unsigned; ``parts`` is a power of two over 1."""
    part = key.view(np.uint64) >> np.uint64(65 - parts.bit_length())
    for a, b in pairwise([*edges(part).tolist(), len(part)]):
        yield int(part[a]), packed(*(c[a:b] for c in columns))


#: Bytes that are hashed at once; a longer word makes it more.
WINDOW = 1 << 20
_BASE = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_and_down(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64, made once in a task."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers


def _hashes(data: np.ndarray, values: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash; ``data`` ends with a separator."""
    starts, found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        size, value = window, None
        while value is None:
            value = values[data[at : at + size]]
            if at + size < len(data):
                gaps = np.flatnonzero(value == 0)
                value = value[: gaps[-1] + 1] if len(gaps) else None
                size *= 2
        word = np.concatenate([[False], value != 0])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, stop = edge[::2], edge[1::2]
        up, down = _up_and_down(len(value))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(value)], dtype=np.uint64)])
        starts.append(start + at)
        found.append(mixed((sums[stop] - sums[start]) * down[start]))
        at += len(value)
    return np.concatenate(starts), np.concatenate(found)


def word_hashes(texts: list[bytes], values: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, words and one end each, one after the other, and the number of tokens of each; a hash is over 2 ** 60."""
    start, found = _hashes(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), values)
    text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    seq = np.full(len(start) + len(texts), _END)
    seq[np.arange(len(start)) + text_of] = found.view(np.uint64)
    return (seq >> np.uint64(2) | np.uint64(1 << 61)).view(np.int64), np.bincount(text_of, minlength=len(texts)) + 1


def plain_hashes(texts: list[bytes], values: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the number of words of each."""
    start, found = _hashes(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), values, window)
    text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    return found, np.bincount(text_of, minlength=len(texts))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each place at which ``size`` words in a row begin, from the words' hashes."""
    if len(words) < size:
        return np.zeros(0, np.int64)
    up, down = _up_and_down(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.view(np.uint64) * up[: len(words)], dtype=np.uint64)])
    return mixed((sums[size:] - sums[:-size]) * down[: len(words) - size + 1])


def first_hashes(words: list[bytes]) -> np.ndarray:
    h, n = word_hashes(words)
    return h[np.cumsum(n) - n]


@dataclass
class Filter:
    """Says of 64-bit keys that they aren't in a set, or may be: each key sets two bits of one number."""

    bits: np.ndarray

    @staticmethod
    def of(keys: DataFrame) -> Filter:
        """From the column ``key``; at most 2 ** SLOT_BITS rows come to the driver."""
        size = min(SLOT_BITS, max(4, int(keys.count()).bit_length() - 2))
        rows = keys.groupBy(F.shiftrightunsigned("key", 64 - size).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 AS int)) | shiftleft(1L, cast(shiftright(key, 6) & 63 AS int)))").alias("bits")).toArrow()
        bits = np.zeros(1 << size, np.uint64)
        bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return Filter(bits)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        slot = self.bits[k >> np.uint64(65 - len(self.bits).bit_length())]
        return (slot >> (k & np.uint64(63)) & (slot >> (k >> np.uint64(6) & np.uint64(63))) & np.uint64(1)).astype(bool)


@dataclass
class Index:
    """Places in a sorted array of 64-bit hashes: few share their first bits, and each key is sought among those only."""

    keys: np.ndarray
    _first: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "_first": None}

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or -1."""
        shift = np.uint64(65 - max(2, len(self.keys).bit_length()))
        if self._first is None:
            slots = np.arange(1 << (64 - int(shift)), dtype=np.uint64) << shift
            self._first = np.append(np.searchsorted(self.keys.view(np.uint64), slots), len(self.keys)).astype(np.int32)
        out = np.full(len(keys), -1, np.int32)
        slot = (keys.view(np.uint64) >> shift).astype(np.int64)
        here, stop = self._first[slot], self._first[slot + 1]
        left = np.flatnonzero(here < stop)
        while len(left):
            at = here[left]
            same = self.keys[at] == keys[left]
            out[left[same]] = at[same]
            left = left[~same]
            here[left] += 1
            left = left[here[left] < stop[left]]
        return out


@dataclass
class Sent:
    """The part of a table of values that tasks hold: the most used keys with their values, and a filter of all keys."""

    index: Index
    values: np.ndarray
    filter: Filter

    def add(self, keys: np.ndarray, at: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add the values of keys to the places ``at`` of ``into``; the places and keys that aren't held here but may have values."""
        there = self.filter.may_have(keys)
        keys, at = keys[there], at[there]
        place = self.index.places(keys)
        there = place >= 0
        into[at[there]] += self.values[place[there]]
        return at[~there], keys[~there]


@dataclass
class Values:
    """Values by key: ``sent`` goes to all tasks, ``rest`` (key, value) has all others, which a join has to find, unless ``whole``."""

    sent: Sent
    rest: DataFrame
    whole: bool

    @staticmethod
    def of(table: DataFrame, most: int, least: int = 1) -> Values:
        """From (key, value, n), a row a key: those of at least ``least`` uses ``n`` are sent, or of more if they were over ``most``."""
        enough = count_threshold(table, "n", most, least)
        hot = table.filter(F.col("n") >= enough).select("key", "value").toArrow()  # at most ``most``
        key, value = (hot[x].to_numpy() for x in ("key", "value"))
        order = np.argsort(key.view(np.uint64))
        rest = table.filter(F.col("n") < enough).select("key", "value")
        return Values(Sent(Index(key[order]), value[order], Filter.of(table)), rest, rest.isEmpty())
