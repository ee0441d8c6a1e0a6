"""Text columns as one buffer of UTF-8 bytes, for work on whole batches with arrays.

Null texts count as empty. An empty batch gives an empty buffer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

PAD = 16
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
WORD = np.array([i not in b" \t\n\x0b\x0c\r" for i in range(256)], np.uint8)
#: Bytes of terms: ASCII digits and letters, and all beyond ASCII.
TERM = np.array([i >= 128 or chr(i).isalnum() for i in range(256)], np.uint8)
#: Words beyond LONG bytes are hashed one by one.
STEP, LONG = np.uint64(0x9E3779B97F4A7C15), 64
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, followed by ``PAD`` zeros, and where each text begins and the last ends."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    cuts = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if places and len(column) else np.zeros(1, np.int64)
    out = np.zeros(int(cuts[-1] - cuts[0]) + PAD, np.uint8)
    if data:
        out[:-PAD] = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]
    return out, cuts - cuts[0]


def stretches(kinds: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of one kind other than 0; none crosses from one text to the next."""
    same = np.zeros(len(kinds) + 1, bool)
    np.equal(kinds[1:], kinds[:-1], out=same[1:-1])
    same[cuts[:-1]] = False
    starts = np.flatnonzero((kinds != 0) & ~same[:-1])
    same[cuts[1:]] = False
    return starts, np.flatnonzero((kinds != 0) & ~same[1:]) + 1


def eight(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first ``sizes`` (clipped to 0 to 8) bytes at each place as one integer; ``data`` is padded."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return view[at] & MASKS[np.clip(sizes, 0, 8)]


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's last steps."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_counts(column: pa.Array, kind: np.ndarray = WORD) -> np.ndarray:
    """The number of words of each text."""
    data, cuts = flat(column)
    return np.diff(np.searchsorted(stretches(kind[data[:-PAD]], cuts)[0], cuts))


def word_hashes(column: pa.Array, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes of a kind, up to ASCII white space by default; A-Z lower-cased), and where each text's begin and the last's end."""
    data, cuts = flat(column)
    data = LOWER[data]
    starts, ends = stretches(kind[data[:-PAD]], cuts)
    sizes = ends - starts
    with np.errstate(over="ignore"):
        out = mixed(sizes.astype(np.uint64) * STEP + eight(data, starts, sizes))
        for at in range(8, LONG, 8):
            more = np.flatnonzero(sizes > at)
            if not len(more):
                break
            out[more] = mixed(out[more] * STEP + eight(data, starts[more] + at, sizes[more] - at))
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out, np.searchsorted(starts, cuts)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``n`` words (of all its words, if they are fewer), and where each set begins and the last ends."""
    ids, words = word_hashes(column)
    counts = np.diff(words)
    width = np.minimum(counts, n)
    sizes = np.where(counts > 0, counts - width + 1, 0)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(cuts[-1]) + np.repeat(words[:-1] - cuts[:-1], sizes)
    every = np.full(max(len(ids) - n + 1, 0), n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):  # windows that cross into the next text are left out below
            every = mixed(every * STEP + ids[i : len(every) + i])
        few = np.flatnonzero((counts > 0) & (counts < n))
        first, size = words[few], counts[few]
        short = size.astype(np.uint64)
        for i in range(n - 1):
            more = np.flatnonzero(size > i)
            short[more] = mixed(short[more] * STEP + ids[first[more] + i])
    out = np.zeros(len(place), np.uint64)
    long = np.repeat(counts >= n, sizes)
    out[long] = every[place[long]]
    out[cuts[:-1][few]] = short
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[cuts[:-1][sizes > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]
