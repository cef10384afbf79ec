"""Words of many texts at once as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: every other ASCII character than 0-9 and a-z.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A-Z lower-cased and the separators of `[^\x20\x09-\x0D]+` made spaces.
SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit (splitmix64's)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes; null as empty) in runs of about `most_bytes`, so that memory is bounded."""
    first, run, held = 0, [], 0
    for i, x in enumerate(texts.cast(pa.large_binary())):
        b = x.as_py() or b""
        if run and held + len(b) > most_bytes:
            yield first, run
            first, run, held = i, [], 0
        run.append(b)
        held += len(b)
    if run:
        yield first, run


def word_hashes(texts: list[bytes], alphabet: bytes = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of its text, its first byte, its end byte within the joined buffer)."""
    joined = b" ".join(texts).translate(alphabet) + b" "
    buf = np.frombuffer(joined, dtype=np.uint8)
    space = np.flatnonzero(buf == 32)
    before = np.concatenate(([-1], space[:-1]))
    keep = space - before > 1
    starts, ends = before[keep] + 1, space[keep]
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    table = powers(_P, int((ends - starts).max()))
    with np.errstate(over="ignore"):
        inside = buf != 32
        chars = buf[inside]
        lens = ends - starts
        firsts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        place = np.arange(len(chars)) - np.repeat(firsts, lens)
        h = np.add.reduceat(_BYTE[chars] * table[place], firsts)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return mixed(h), np.searchsorted(bounds, starts, side="right") - 1, starts, ends


def grams(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram that begins at each word, True where it stays in one text)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    q = powers(_Q, n + 1)
    with np.errstate(over="ignore"):
        h = sum(words[i : i + count] * q[i + 1] for i in range(n))
    return mixed(h), text[:count] == text[n - 1 :]
