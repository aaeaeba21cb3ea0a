"""Token counts by rank-synchronous merging of ragged symbol arrays."""

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .words import CACHE_ENTRIES, LONG_CHUNK, ChunkCache, Recent, load, pretokens, text_blocks

#: Pre-tokens merged together in one set of arrays.
BATCH = 50_000
#: Symbols from which on a pre-token is merged with places in buckets by rank.
MANY_SYMBOLS = 200


class MergeTable:
    """Merges of a vocabulary file as sorted arrays: pairs of symbols, their rank and the symbol they become."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab, self.width = vocab, max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.none = len(merges)
        self.left, self.right, self.becomes = left, right, made
        born = np.full(self.width, -1, np.int64)
        born[made] = np.arange(len(merges))
        if (born[left] >= np.arange(len(merges))).any() or (born[right] >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that a later merge makes: simultaneous merging would differ")

    def symbols(self, pretoken: str) -> list[int]:
        """One symbol per letter; the last carries the end-of-word mark. Letters outside the vocabulary vanish."""
        v = self.vocab
        out = [v.get(c, -1) for c in pretoken[:-1]] + [v.get(pretoken[-1] + self.suffix, -1)]
        return [s for s in out if s >= 0] if -1 in out else out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), self.none - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], self.none), at

    def surviving(self, pretoken_list: list[str]) -> np.ndarray:
        """Symbols left of each pre-token once no merge applies."""
        lists = [self.symbols(p) for p in pretoken_list]
        long = np.array([len(x) > MANY_SYMBOLS for x in lists], bool)
        out = np.zeros(len(lists), np.int64)
        out[~long] = self._merged_in_rounds([x for x, far in zip(lists, long) if not far])
        if long.any():
            out[long] = self._merged_in_buckets([x for x, far in zip(lists, long) if far])
        return out

    def _merged_in_buckets(self, lists: list[list[int]]) -> np.ndarray:
        """The same for long sequences: pair places wait in buckets by rank, and a round touches the lowest bucket of all and its neighbours.

        A merge makes no pair of its own or a lower rank (checked when the table
        is built), so going up the ranks of all sequences together applies each sequence's lowest pair first.
        """
        counts = np.array([len(x) for x in lists], np.int64)
        sym, owner = np.concatenate([np.array(x, np.int64) for x in lists]), np.repeat(np.arange(len(lists)), counts)
        out, n = counts.copy(), len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(counts)
        after[ends - 1], before[ends - counts] = -1, -1
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(places: np.ndarray) -> None:
            rank, _ = self.look_up(sym[places], sym[after[places]])
            known = rank < self.none
            places, rank = places[known], rank[known]
            by = np.argsort(rank, kind="stable")
            places, rank = places[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(places, cuts), rank[np.append(0, cuts)].tolist() if len(rank) else ()):
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(part)

        put(np.flatnonzero(after >= 0))
        while ranks:
            r = heapq.heappop(ranks)
            place = np.unique(np.concatenate(waiting.pop(r)))
            second = after[place]
            # a symbol that has gone is -1 and so is what follows the last one
            there = (sym[place] == self.left[r]) & (second >= 0) & (sym[second] == self.right[r])
            place, second = place[there], second[there]
            if self.left[r] == self.right[r] and len(place) > 1:
                run = np.flatnonzero(np.append(True, second[:-1] != place[1:]))  # in a row like "aaa" every second place counts
                nth = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
                place, second = place[nth % 2 == 0], second[nth % 2 == 0]
            third = after[second]
            sym[place], sym[second], after[place] = self.becomes[r], -1, third
            before[third[third >= 0]] = place[third >= 0]
            np.subtract.at(out, owner[place], 1)
            put(np.unique(np.concatenate([place[third >= 0], before[place][before[place] >= 0]])))
        return out

    def _merged_in_rounds(self, lists: list[list[int]]) -> np.ndarray:
        """Symbols left of each sequence.

        All sequences lie behind one another in one flat array. Each round
        finds the lowest rank of every sequence and applies that merge at all
        its places at once; a sequence without a merge leaves the arrays.
        """
        counts = np.array([len(x) for x in lists], np.int64)
        out = counts.copy()
        sym = np.array([s for x in lists for s in x], np.int64)
        owner = np.repeat(np.arange(len(lists)), counts)
        while len(sym) > 1:
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            rank, at = self.look_up(sym[pair], sym[pair + 1])
            best = np.full(len(lists), self.none, np.int64)
            np.minimum.at(best, owner[pair], rank)
            pick = (rank < self.none) & (rank == best[owner[pair]])
            if not pick.any():
                break
            place, merged = pair[pick], at[pick]
            run = np.flatnonzero(np.r_[True, np.diff(place) != 1])  # in a row like "aaa" every second place counts
            nth = np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))
            place, merged = place[nth % 2 == 0], merged[nth % 2 == 0]
            sym[place] = self.made[merged]
            stay = np.ones(len(sym), bool)
            stay[place + 1] = False
            np.subtract.at(out, owner[place], 1)
            stay &= best[owner] < self.none
            sym, owner = sym[stay], owner[stay]
        return out


class Counter:
    """Tokens of whole texts."""

    def __init__(self, path: str):
        self.tokenizer, self.table = load(path), MergeTable(path)
        self.cache = ChunkCache(self._work_out, 0)
        self.known = Recent(CACHE_ENTRIES // 2)

    def _work_out(self, fresh: list[str]) -> list[int]:
        self.known.turn()
        parts = [pretokens(c, self.tokenizer) for c in fresh]
        known = self.known
        new = list({p: None for ps in parts for p in ps if p is not None and known[p] is None})
        found: dict[str, int] = {}
        for i in range(0, len(new), BATCH):
            found.update(zip(new[i:i + BATCH], self.table.surviving(new[i:i + BATCH]).tolist(), strict=True))
        values = [sum([1 if p is None else found[p] if p in found else known[p] for p in ps]) for ps in parts]
        known.update((p, n) for p, n in found.items() if len(p) <= LONG_CHUNK)
        return values

    def count(self, texts: list[str]) -> list[int]:
        return [sum(v) for v in self.cache.of_texts(texts)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, the tokens of each whole text without added special tokens.

    The file is a BPE vocabulary with an end-of-word mark, as the tokenizers
    library reads it; its special strings inside a text count as one token
    each. A null or empty text has no tokens; other columns stay as they are,
    whatever their names, but an ``n_tokens`` of the input is replaced.
    """

    @F.pandas_udf("long")
    def tokens(batches: pd.Series) -> pd.Series:
        count = counter(vocabulary).count
        return pd.Series([n for block in text_blocks(batches) for n in count(block)], dtype="int64")

    return docs.withColumn("n_tokens", tokens(F.coalesce(F.col(text), F.lit(""))))
