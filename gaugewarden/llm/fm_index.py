"""FM-index over sequences of numbers: suffix order, wavelet matrix, ranks, sampled places.

A helper for one shard inside a task. Everything works on whole arrays of
patterns or rows at once, so that a step costs a few numpy calls.
"""

import numpy as np

#: Every so many places of a sequence, and its first one, the index knows where a row lies.
SAMPLE_EVERY = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order. The last symbol and every symbol that ends a sequence occur once.

    Suffixes are ordered by as many symbols as fit 63 bits, then only those
    still tied by twice as many, and so on. A tie cannot reach beyond the end
    of a sequence, as its symbol is unique.
    """
    n, bits = len(text), max(1, int(text.max()).bit_length())
    known = max(1, 63 // bits)
    key = text.astype(np.int64)
    for i in range(1, min(known, n)):
        key <<= bits
        key[:n - i] |= text[i:]
    order = np.argsort(key)
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    tied = np.arange(n)
    while True:
        first = tied[fresh]
        rank[order[tied]] = np.repeat(first, np.diff(np.append(np.flatnonzero(fresh), len(tied))))
        still = ~fresh
        still[:-1] |= still[1:]  # the first of a group of several
        tied = tied[still]
        if not len(tied):
            return order
        rows = order[tied]
        key = rank[rows] << 32 | rank[rows + known]
        by = np.argsort(key)
        order[tied], key = rows[by], key[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        known *= 2


class _Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Ranks of symbols in a sequence: one row of bits per binary digit of the symbols, highest digit first."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            one = (symbols >> shift & 1).astype(bool)
            self.levels.append(_Bits(one))
            below = symbols[~one]
            self.zeros.append(len(below))
            symbols = np.concatenate([below, symbols[one]])
        first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        #: Where each symbol's run starts after the last level.
        self.run = np.zeros(largest + 1, np.int64)
        self.run[symbols[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        run = self.run[symbol]
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.rank(at)
            at = np.where(symbol >> (len(self.levels) - 1 - k) & 1, zeros + ones, at - ones)
        return at - run

    def get_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places ``at`` and how often each occurs before its place."""
        symbol = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            one, ones = level.get(at), level.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol, at - self.run[symbol]


class FMIndex:
    """Index of ``sequences`` of symbols ``1..largest``; 0 stands before the first symbol of each."""

    def __init__(self, sequences: list[np.ndarray], largest: int, sample_every: int = SAMPLE_EVERY):
        many = len(sequences)
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        text = np.empty(int(sizes.sum()) + many, np.int64)
        for i, (at, s) in enumerate(zip(self.starts, sequences)):
            text[at:at + len(s)] = s
            text[at:at + len(s)] += many - 1
            text[at + len(s)] = i
        order = suffix_order(text)
        offset = np.arange(len(text)) - np.repeat(self.starts, sizes + 1)
        before = np.maximum(text[order - 1] - (many - 1), 0).astype(np.int32)
        before[offset[order] == 0] = 0
        counts = np.bincount(np.maximum(text - (many - 1), 0), minlength=largest + 1)
        self.count = counts
        #: First row of the suffixes that begin with a symbol; rows of ends of sequences come first.
        self.first = np.cumsum(counts) - counts
        self.matrix = WaveletMatrix(before, largest)
        known = offset[order] % sample_every == 0
        self.known, self.places = _Bits(known), order[known].astype(np.int32 if len(text) < 2 ** 31 else np.int64)

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows of equal length): first row and row after the last of the suffixes that begin with each."""
        low = self.first[patterns[:, -1]]
        high = low + self.count[patterns[:, -1]]
        for k in range(patterns.shape[1] - 2, -1, -1):
            alive = np.flatnonzero(low < high)
            if not len(alive):
                break
            symbol = patterns[alive, k]
            ranks = self.matrix.rank(np.tile(symbol, 2), np.concatenate([low[alive], high[alive]]))
            low[alive] = self.first[symbol] + ranks[:len(alive)]
            high[alive] = self.first[symbol] + ranks[len(alive):]
        return low, high

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the suffixes at ``rows``: walk back until a sampled place."""
        found, waiting, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(waiting):
            here = self.known.get(rows)
            found[waiting[here]] = self.places[self.known.rank(rows[here])] + steps
            waiting, rows = waiting[~here], rows[~here]
            symbol, rank = self.matrix.get_and_rank(rows)
            rows, steps = self.first[symbol] + rank, steps + 1
        sequence = np.searchsorted(self.starts, found, side="right") - 1
        return sequence, found - self.starts[sequence]
