"""Words and hashes of whole Arrow string columns as numpy arrays.

Words are found on the UTF-8 bytes. Every byte class used here keeps bytes of
0x80 and above on one side, so no code point is cut. All hashes are 64-bit and
depend on nothing but the words, so they agree between tasks, runs and hosts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are laid out as arrays at once; only one longer text exceeds it.
CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words that blanks separate.
BLANK_WORDS = ~SPACE
#: Letters and digits: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, after A-Z became a-z.
LETTER_WORDS = np.ones(256, bool)
LETTER_WORDS[0x00:0x30] = LETTER_WORDS[0x3A:0x61] = LETTER_WORDS[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE_VALUES = np.random.default_rng(20_11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    held = _POWERS.get(int(base))
    if held is None or len(held[0]) <= n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        held = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64)))) for b in (base, inverse))
        if n <= 2 * CHUNK_BYTES:
            _POWERS[int(base)] = held
    return held


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of values[start:end] for many spans, by prefix sums of a polynomial."""
    up, down = _powers(base, len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of a slice of texts. `bounds[i]:bounds[i+1]` are the words of text i."""

    data: np.ndarray  # bytes, lower-cased where asked for
    raw: np.ndarray  # bytes as given
    offsets: np.ndarray  # byte offsets of the texts
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return spans_hash(_BYTE_VALUES[self.data], self.starts, self.ends)

    def beginnings(self, most: int) -> np.ndarray:
        """Hashes of the first bytes of every word."""
        return spans_hash(_BYTE_VALUES[self.data], self.starts, np.minimum(self.starts + most, self.ends))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


def words(texts: pa.Array, kind: np.ndarray = BLANK_WORDS, lower: bool = False) -> Words:
    """Words of every text; null texts have none."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = LOWER[raw] if lower else raw
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(data, raw, offsets, starts, ends, np.searchsorted(starts, offsets))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about `most` bytes of text."""
    lengths = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
    total, begin = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += n
    if begin < len(lengths):
        yield batch.slice(begin)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of `width` words inside one text."""
    first = window_starts(bounds, width)
    return first, spans_hash(mix(hashes ^ _STEP_2) if second else hashes, first, first + width, _STEP_2 if second else _STEP)


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """First words of all windows, text by text."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    return np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())


def shingle_sets(found: Words, width: int, hashes: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle hashes; a text of fewer words is one shingle as a whole."""
    hashes = found.hashes() if hashes is None else hashes
    first, value = windows(hashes, found.bounds, width)
    counts = found.counts
    ends = np.cumsum(np.maximum(counts - width + 1, 0))
    begin = 0
    for i, end in enumerate(ends):
        if end > begin:
            yield np.unique(value[begin:end])
        elif counts[i]:
            at = found.bounds[i : i + 2]
            yield spans_hash(hashes, at[:1], at[1:], _STEP)
        else:
            yield np.zeros(0, np.uint64)
        begin = end
