"""Weighted acyclic automata that count word sequences.

A path is one to ``depth`` words, or as many as there are up to the end of a
piece; its weight says how often it was read. The weight of a phrase is
the sum over the range of paths it is a prefix of, so one automaton holds the
counts of all phrases of up to ``depth`` words. Helper for the tasks of one job.
"""

import bisect
from itertools import repeat
import struct

import numpy as np
import zstandard

END = 0  # label of the end of a piece; words are numbered from 1 in byte order


def ordered(cols: list[np.ndarray], weights: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``cols`` in ascending order with their summed weights (None: one each)."""
    n = len(cols[0])
    if not n:
        return cols, np.zeros(0, np.int64)
    bits = max(1, *(int(c.max()).bit_length() for c in cols))
    per_key = max(1, 63 // bits)
    keys = []
    for at in range(0, len(cols), per_key):
        key = cols[at].astype(np.int64)
        for c in cols[at + 1:at + per_key]:
            key = key << bits | c
        keys.append(key)
    if len(keys) == 1 and weights is None:
        key = np.sort(keys[0])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, counts = key[first], np.diff(np.append(first, n))
        return [(key >> bits * i & (1 << bits) - 1).astype(np.int32) for i in range(len(cols) - 1, -1, -1)], counts
    by = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    fresh = np.append(True, np.zeros(n - 1, bool))
    for key in keys:
        key = key[by]
        fresh[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    weights = np.ones(n, np.int64) if weights is None else weights[by]
    return [c[by[first]] for c in cols], np.add.reduceat(weights, first)


def _pack(a: np.ndarray) -> bytes:
    """An array of non-negative integers in the narrowest type."""
    kind = next(k for k in "BHIQ" if not len(a) or int(a.max()) < 1 << 8 * struct.calcsize(k))
    return struct.pack("<BQ", "BHIQ".index(kind), len(a)) + a.astype(f"<u{struct.calcsize(kind)}").tobytes()


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def array(self) -> np.ndarray:
        kind, n = struct.unpack_from("<BQ", self.data, self.at)
        width = 1 << kind
        out = np.frombuffer(self.data, f"<u{width}", n, self.at + 9)
        self.at += 9 + n * width
        return out.astype(np.int64)


def _shared_states(start: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each last state (arcs ``start[i]:start[i + 1]``) the first state with the same arcs, and which states come first."""
    sizes = np.diff(start)
    mixed = (labels.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ counts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    digest = np.add.reduceat(mixed ^ mixed >> np.uint64(32), start[:-1])
    _, first, which = np.unique(digest, return_index=True, return_inverse=True)
    like = first[which]
    # equal digests are a guess only: all arcs are compared
    same = sizes == sizes[like]
    arc = np.arange(len(labels)) - np.repeat(start[:-1], sizes)
    other = np.where(np.repeat(same, sizes), np.repeat(start[:-1][like], sizes) + arc, 0)
    differs = (labels != labels[other]) | (counts != counts[other])
    same &= np.add.reduceat(differs, start[:-1]) == 0
    like = np.where(same, like, np.arange(len(like)))
    return like, like == np.arange(len(like))


class CountAutomaton:
    """``words`` in byte order, paths as columns of labels in ascending order, and their weights."""

    def __init__(self, words: list[bytes], cols: list[np.ndarray], counts: np.ndarray):
        self.words, self.cols, self.counts = words, cols, counts

    @classmethod
    def of(cls, words: list[bytes], cols: list[np.ndarray], weights: np.ndarray | None = None) -> "CountAutomaton":
        """From paths in any order over words in any order (labels from 1)."""
        by = sorted(range(len(words)), key=words.__getitem__)
        label = np.zeros(len(words) + 1, np.int32)
        label[np.array(by, np.int64) + 1] = np.arange(1, len(words) + 1)
        return cls([words[i] for i in by], *ordered([label[c] for c in cols], weights))

    def __len__(self) -> int:
        return len(self.counts)

    def runs(self, depth: int) -> np.ndarray:
        """First path of each distinct prefix of ``depth`` words; shorter paths are left out where ``depth`` goes beyond their end."""
        fresh = np.zeros(len(self), bool)
        fresh[:1] = True
        for c in self.cols[:depth]:
            fresh[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(fresh)

    def phrases(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(first path, weight) of all phrases of ``depth`` words: sums over their prefix ranges."""
        first = self.runs(depth)
        weight = np.add.reduceat(self.counts, first) if len(first) else self.counts
        whole = self.cols[depth - 1][first] != END
        return first[whole], weight[whole]

    def text(self, path: int, depth: int) -> str:
        return b" ".join(self.words[int(c[path]) - 1] for c in self.cols[:depth]).decode()

    def before(self, cut: tuple[bytes, ...]) -> int:
        """Number of paths below ``cut`` (words, empty ones for the end)."""
        low, high = 0, len(self)
        for c, word in zip(self.cols, cut):
            if not word:
                return low
            label = bisect.bisect_left(self.words, word) + 1
            low, found = low + int(np.searchsorted(c[low:high], label)), label <= len(self.words) and self.words[label - 1] == word
            if not found:
                return low
            high = low + int(np.searchsorted(c[low:high], label, side="right"))
        return low

    def part(self, low: int, high: int) -> "CountAutomaton":
        """The automaton of the paths ``low`` to ``high`` with the words these use."""
        cols = [c[low:high] for c in self.cols]
        used = np.unique(np.concatenate(cols))
        used = used[used != END]
        label = np.zeros(len(self.words) + 1, np.int32)
        label[used] = np.arange(1, len(used) + 1)
        return CountAutomaton([self.words[i - 1] for i in used.tolist()], [label[c] for c in cols], self.counts[low:high])

    def to_bytes(self) -> bytes:
        """Words, then the arcs layer by layer; last states with the same arcs and weights are written once."""
        depth, out = len(self.cols), [b" ".join(self.words)]
        starts = [np.append(self.runs(d), len(self)) for d in range(1, depth)]
        layers = []
        for d, start in enumerate(starts):
            layers.append(self.cols[d][start[:-1]])
            if d + 1 < len(starts):
                layers.append(np.diff(np.searchsorted(starts[d + 1], start)))
        like, first = _shared_states(starts[-1], self.cols[-1], self.counts)
        layers.append((np.cumsum(first) - 1)[like])
        sizes = np.diff(starts[-1])
        arcs = np.repeat(first, sizes)
        layers += [sizes[first], self.cols[-1][arcs], self.counts[arcs]]
        body = struct.pack("<BQ", depth, len(out[0])) + out[0] + b"".join(map(_pack, layers))
        return zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> "CountAutomaton":
        body = zstandard.ZstdDecompressor().decompress(data)
        depth, size = struct.unpack_from("<BQ", body)
        words, reader = body[9:9 + size], _Reader(body)
        reader.at = 9 + size
        labels, fans = [], []
        for d in range(depth - 1):
            labels.append(reader.array())
            if d + 2 < depth:
                fans.append(reader.array())
        state, sizes, last, counts = (reader.array() for _ in range(4))
        start = np.cumsum(sizes) - sizes
        many = sizes[state]
        arc = np.repeat(start[state] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        cols = [last[arc]]
        for d in range(depth - 2, -1, -1):
            cols.append(np.repeat(labels[d], many))
            if d:
                many = np.add.reduceat(many, np.cumsum(fans[d - 1]) - fans[d - 1])
        return cls(words.split(b" ") if words else [], [c.astype(np.int32) for c in cols[::-1]], counts[arc])


def union(parts, fold_paths: int = 4_000_000) -> CountAutomaton:
    """One automaton with the summed weights of ``parts`` (an iterable), folded whenever ``fold_paths`` paths wait."""
    whole, waiting, size = None, [], 0

    def fold():
        numbers: dict[bytes, int] = {}
        cols, counts = [], []
        for a in waiting:
            label = np.zeros(len(a.words) + 1, np.int32)
            for w in a.words:
                numbers.setdefault(w, len(numbers) + 1)
            label[1:] = np.fromiter(map(numbers.__getitem__, a.words), np.int32, len(a.words))
            cols.append([label[c] for c in a.cols])
            counts.append(a.counts)
        return CountAutomaton.of(list(numbers), [np.concatenate(c) for c in zip(*cols)], np.concatenate(counts))

    for a in parts:
        waiting.append(a)
        size += len(a)
        if size >= fold_paths and len(waiting) > 1:
            whole = fold()
            # what is left may be as large as before; then twice as many wait
            waiting, size, fold_paths = [whole], 0, max(fold_paths, len(whole))
    return waiting[0] if len(waiting) == 1 else fold()


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class PathReader:
    """Collects the paths of texts, group by group, until there are enough for an automaton."""

    def __init__(self, depth: int, split: bytes):
        # one table folds A-Z and turns what ends a piece into a sign that no word can hold
        self.sign, self.depth = split[:1], depth
        self.table = bytes(split[0] if c in split else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
        self.clear()

    def clear(self) -> None:
        self.numbers, self.groups, self.size = _Numbers({self.sign: END}), {}, 0

    def add(self, group: str, text: str, most: int):
        """Adds a text; yields whenever ``most`` words are reached, for the caller to take and clear."""
        tokens = text.encode().translate(self.table).replace(self.sign, b" " + self.sign + b" ").split()
        at = 0
        while at < len(tokens):
            take = min(len(tokens), at + max(1, most - self.size))
            # the words after the last start belong to its path and start none themselves
            part = tokens[at:take + self.depth - 1]
            ids = np.fromiter(map(self.numbers.__getitem__, part), np.int32, len(part))
            self.groups.setdefault(group, []).append((ids, take - at))
            self.size += take - at
            at = take
            if self.size >= most:
                yield

    def automata(self):
        """(group, automaton) of what was collected."""
        words = list(self.numbers)[1:]
        by = sorted(range(len(words)), key=words.__getitem__)
        label = np.zeros(len(words) + 1, np.int32)
        label[np.array(by, np.int64) + 1] = np.arange(1, len(words) + 1)
        words = [words[i] for i in by]
        for group, parts in self.groups.items():
            gap = np.zeros(self.depth, np.int32)
            read = label[np.concatenate([x for ids, _ in parts for x in (ids, gap)])]
            starts = np.concatenate([np.arange(len(ids) + self.depth) < n for ids, n in parts])
            first = np.flatnonzero(starts & (read != END))
            if not len(first):
                continue
            cols, open_ = [], np.ones(len(first), bool)
            for d in range(self.depth):
                here = np.where(open_, read[first + d], END)
                open_ &= here != END
                cols.append(here)
            yield group, CountAutomaton(words, *ordered(cols, None))


def sampled_paths(text: str, reader: PathReader, every: int) -> list[tuple[bytes, ...]]:
    """Every so-manieth path of a text."""
    tokens = text.encode().translate(reader.table).replace(reader.sign, b" " + reader.sign + b" ").split()
    out = []
    for i in range(0, len(tokens), every):
        own = tokens[i:i + reader.depth]
        own = own[:own.index(reader.sign)] if reader.sign in own else own
        if own:
            out.append((*own, *repeat(b"", reader.depth - len(own))))
    return out
