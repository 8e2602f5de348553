"""Word splitting on UTF-8 bytes, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_LOWER = bytes(range(65, 91))
_UPPER_TO_LOWER = bytes(c + 32 if c in _LOWER else c for c in range(256))
#: Everything in ASCII that is neither a digit nor a letter becomes a space.
_ALNUM = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in _UPPER_TO_LOWER
)
#: bytes.split() also ends words at \x09-\x0D and \x20 only.


def alnum_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of text with A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of text with A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).split() if text else []


def lots(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """texts, cut where about `most` bytes are together; one text may have more."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for low, high in zip(edges, edges[1:]):
        if low < high:
            yield texts.slice(low, high - low)


def space_words_together(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What space_words gives for each of the texts: all words one after the other, as bytes, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    there = pc.binary_length(words).to_numpy() > 0  # white space at either end gives an empty one
    upto = np.append(0, np.cumsum(there))
    return words.filter(pa.array(there)).cast(pa.binary()), np.diff(upto[offsets])


class WordHash(dict):
    """64-bit hash of a word, remembered for up to `most` words at a time."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h
