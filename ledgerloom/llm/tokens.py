"""Token ids of whole texts, by a public tokenizer of the ``tokenizers`` library.

The tokenizers used lower-case, drop white space and never let a token span it, so a text's ids are those
of its chunks between spaces and line feeds. A chunk of Latin-1 letters and ASCII marks falls into runs of letters
and runs of marks, which those tokenizers take apart too. A batch of texts is cut into runs with arrays, and each distinct
run that the worker doesn't remember goes to the library: letters to its BPE model, marks and all
other chunks to the whole tokenizer. That gives the ids that the library gives for the whole text
(tests compare them) at a fraction of its time, as texts repeat their words. A tokenizer that doesn't work so
(probes tell) gets whole texts.

A worker remembers runs in arrays of a fixed size, ``Memory.nbytes`` for each tokenizer file, whatever the texts.
Null and empty texts have no ids. An empty batch gives nothing.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402

from .textbytes import LOWER, PAD, eight, flat, mixed, stretches  # noqa: E402

#: Sets of two runs each that a worker remembers, and the most bytes and ids of such a run.
SETS, LONGEST, MOST = 1 << 18, 16, 6
SPACE, LETTER, MARK, OTHER = 0, 1, 2, 3
PROBES = ("word", "Éclair", "ÿßñ", "straße", "zzxqj", "The", "a-b", "$$word.", "x=(y)", "Well,then;")


def _kinds() -> np.ndarray:
    """The kind of each byte: < may begin a special token, apostrophes contractions."""
    out = np.full(256, OTHER, np.uint8)
    out[[32, 10]] = SPACE
    for i in range(33, 127):
        if chr(i).isalpha():
            out[i] = LETTER
        elif not chr(i).isdigit() and chr(i) not in "'<":
            out[i] = MARK
    return out


KINDS = _kinds()


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letters: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(other)}


LETTERS = _byte_letters()


def word_vocabulary() -> str:
    """Path of the tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_type(vocabulary: int) -> str:
    """The integers that hold the ids of a vocabulary."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Memory:
    """Runs of at most ``LONGEST`` bytes and their ids: sets of two, the older of which is forgotten for a new one."""

    def __init__(self, dtype: np.dtype, sets: int = SETS):
        self.shift = np.uint64(64 - (sets.bit_length() - 1))
        self.low, self.high = np.zeros((2, sets), np.uint64), np.zeros((2, sets), np.uint64)
        self.ids, self.sizes = np.zeros((2, sets, MOST), dtype), np.zeros((2, sets), np.uint8)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.low, self.high, self.ids, self.sizes))

    def _sets(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(low * np.uint64(0x9E3779B97F4A7C15) + high) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Fills in the ids and their number of the runs that are remembered; no run is empty."""
        at = self._sets(low, high)
        for way in (0, 1):
            hit = np.flatnonzero((self.low[way, at] == low) & (self.high[way, at] == high))
            ids[hit], sizes[hit] = self.ids[way, at[hit]], self.sizes[way, at[hit]]

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, last = np.unique(self._sets(low, high)[::-1], return_index=True)
        last = len(low) - 1 - last
        for x, new in ((self.low, low), (self.high, high), (self.ids, ids), (self.sizes, sizes)):
            x[1, at] = x[0, at]
            x[0, at] = new[last]


class ChunkIds:
    """Ids of batches of texts, as the smallest integers that hold the vocabulary."""

    def __init__(self, path: str, sets: int = SETS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype(id_type(self.tokenizer.get_vocab_size()))
        self.memory = Memory(self.dtype, sets)
        self.plain = all(self._by_runs([p])[0].tolist() == self._whole(p) for p in PROBES)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, run: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(run.decode("ascii") if run.isascii() else run.decode("latin-1").translate(LETTERS))]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of the column, and where each text's begin and the last's end."""
        if self.plain:
            return self._by_runs(column)
        each = [np.array(self._whole(t or ""), self.dtype) for t in column.to_pylist()]
        return np.concatenate([np.zeros(0, self.dtype), *each]), np.cumsum([0, *map(len, each)])

    def _by_runs(self, column: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, cuts = flat(column if isinstance(column, pa.Array) else pa.array(column, pa.string()))
        raw, text = data, data[:-PAD]
        kinds = KINDS[text]
        data = LOWER[data]
        # Latin-1 letters beyond ASCII are two bytes, the first 0xC3; 0x97 and 0xB7 are signs.
        latin = np.flatnonzero(text == 0xC3)
        latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        kinds[latin] = kinds[latin + 1] = LETTER
        upper = latin[data[latin + 1] < 0x9F]
        data[upper + 1] += 32
        # A chunk with any other byte is one run.
        starts, ends = stretches((kinds != SPACE).view(np.uint8), cuts)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(cuts), np.int64)
        hard = np.maximum.reduceat(kinds, starts) == OTHER
        if hard.any():
            step = np.zeros(len(kinds) + 1, np.int8)
            step[starts[hard]] += 1
            step[ends[hard]] -= 1
            kinds[np.cumsum(step[:-1], dtype=np.int8) > 0] = OTHER
        starts, ends = stretches(kinds, cuts)
        kind, long = kinds[starts], ends - starts
        ids, sizes, loose = np.zeros((len(starts), MOST), self.dtype), np.zeros(len(starts), np.int64), {}
        fit = np.flatnonzero((kind != OTHER) & (long <= LONGEST))
        low, high = eight(data, starts[fit], long[fit]), eight(data, starts[fit] + 8, long[fit] - 8)
        got, n = np.zeros((len(fit), MOST), self.dtype), np.zeros(len(fit), np.uint8)
        self.memory.find(low, high, got, n)
        miss = np.flatnonzero(n == 0)
        if len(miss):
            order = miss[np.lexsort((low[miss], high[miss]))]
            new = np.r_[True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])]
            firsts, which = order[new], np.cumsum(new) - 1
            found = [self._run(data, int(kind[fit[k]]), int(starts[fit[k]]), int(ends[fit[k]])) for k in firsts.tolist()]
            count = np.fromiter(map(len, found), np.int64, len(found))
            short = count <= MOST
            table = np.zeros((len(found), MOST), self.dtype)
            table[np.arange(MOST) < np.where(short, count, 0)[:, None]] = [i for f in found if len(f) <= MOST for i in f]
            self.memory.add(low[firsts[short]], high[firsts[short]], table[short], count[short].astype(np.uint8))
            got[order], n[order] = table[which], np.where(short, count, 0)[which]
            for k in np.flatnonzero(~short[which]).tolist():
                loose[int(fit[order[k]])] = found[which[k]]
        ids[fit], sizes[fit] = got, n
        seen: dict[tuple[int, bytes], list[int]] = {}
        for k in np.flatnonzero((kind == OTHER) | (long > LONGEST)).tolist():
            a, b, own = int(starts[k]), int(ends[k]), int(kind[k])
            what = own, (raw if own == OTHER else data)[a:b].tobytes()
            if what not in seen:
                seen[what] = self._run(raw if own == OTHER else data, own, a, b)
            loose[k] = seen[what]
        for k, own in loose.items():
            sizes[k] = len(own)
        total = np.concatenate([[0], np.cumsum(sizes)])
        out, at = np.zeros(int(total[-1]), self.dtype), total[:-1]
        if loose:
            sizes[list(loose)] = 0
        for j in range(MOST):
            more = np.flatnonzero(sizes > j)
            out[at[more] + j] = ids[more, j]
        for k, own in loose.items():
            out[at[k] : at[k] + len(own)] = own
        return out, total[np.searchsorted(starts, cuts)]

    def _run(self, data: np.ndarray, kind: int, start: int, end: int) -> list[int]:
        run = data[start:end].tobytes()
        return self._word(run) if kind == LETTER else self._whole(run.decode("utf-8", "surrogatepass"))


def with_end(ids: np.ndarray, cuts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by ``end_id``, and where each begins and the last ends."""
    return np.insert(ids, cuts[1:], end_id), cuts + np.arange(len(cuts))


_LOADED: dict[str, ChunkIds] = {}


def encoder(path: str) -> ChunkIds:
    """The worker's encoder for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]
