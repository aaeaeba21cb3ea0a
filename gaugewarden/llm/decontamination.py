"""Passages of benchmark items in documents, found through an FM-index per shard of documents.

A task turns its documents into word numbers, shard by shard, and indexes each
shard (``fm_index``). All windows of the benchmark are searched backward at
once, their occurrences are located through the sampled places and merged into
removal spans per document. A document longer than a shard is indexed in
overlapping parts, so memory is bounded by the shard and not by the text.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .fm_index import FMIndex

WINDOW = 10
#: Words in one index.
SHARD_WORDS = 1_000_000
#: Benchmark text that is sent to all tasks at once; a larger benchmark is searched in several passes.
BLOCK_BYTES = 4 << 20
#: Most words of one row of benchmark text.
PIECE_WORDS = 4_096
#: Rows of the index located at once.
LOCATE_ROWS = 1 << 18

#: Copies of what was found in a text, where several passes meet.
SALTS = 16

FOUND = "n_words long, items array<string>, hits array<struct<first:int,last:int,start:int,end:int>>"

_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _WORD[b] else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case: digits, letters and everything beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split()


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in code points."""
    data = np.frombuffer(text.encode(), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[edges]
    return points[::2], points[1::2]


class Phrases:
    """All windows of a block of items, by length, each with the items that hold it."""

    def __init__(self, items: list[str | None], texts: list[str], window: int):
        self.items = np.array(items, object)
        self.vocabulary: dict[bytes, int] = {}
        numbers = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t.encode().split()], np.int32) for t in texts]
        rows: dict[int, list] = {}
        for i, n in enumerate(numbers):
            if len(n):
                m = min(window, len(n))
                rows.setdefault(m, []).append((i, np.lib.stride_tricks.sliding_window_view(n, m)))
        #: Per length: distinct windows, and for each the slice ``owners[ends[i]:ends[i + 1]]`` of its items.
        self.by_length = {}
        for m, parts in rows.items():
            distinct, which = np.unique(np.concatenate([w for _, w in parts]), axis=0, return_inverse=True)
            owner = np.repeat([i for i, _ in parts], [len(w) for _, w in parts])
            by = np.argsort(which, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(distinct)))])
            self.by_length[m] = distinct, owner[by], ends

    def named(self, rows: np.ndarray) -> list[str]:
        """Distinct ids of the items ``rows`` in ascending order; items without an id have no name."""
        return sorted({i for i in self.items[np.unique(rows)] if i is not None})


class _Shard:
    """Sequences of word numbers of documents or parts of them; equal sequences are indexed once."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.sequences, self.uses, self.same, self.size = [], [], {}, 0

    def add(self, doc: int, offset: int, part: list[bytes]) -> None:
        numbers = self.numbers
        ids = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in part), np.int32, len(part))
        at = self.same.setdefault(ids.tobytes(), len(self.sequences))
        if at == len(self.sequences):
            self.sequences.append(ids)
            self.uses.append([])
            self.size += len(ids)
        self.uses[at].append((doc, offset))

    def hits(self, phrases: Phrases) -> Iterator[tuple]:
        """(document, first word, last word, item row) arrays of each sequence's occurrences, per document that has it."""
        index = FMIndex(self.sequences, len(self.numbers))
        known = np.zeros(len(phrases.vocabulary), np.int64)
        for w, i in phrases.vocabulary.items():
            known[i] = self.numbers.get(w, 0)
        for m, (windows, owners, ends) in phrases.by_length.items():
            patterns = known[windows]
            there = np.flatnonzero((patterns > 0).all(axis=1))
            if not len(there):
                continue
            low, high = index.find(patterns[there])
            met = np.flatnonzero(low < high)
            if not len(met):
                continue
            there, low, many = there[met], low[met], (high - low)[met]
            ends_of = np.cumsum(many)
            for start in range(0, int(ends_of[-1]), LOCATE_ROWS):
                at = np.arange(start, min(start + LOCATE_ROWS, int(ends_of[-1])))
                window = np.searchsorted(ends_of, at, side="right")
                sequence, offset = index.locate(low[window] + at - (ends_of - many)[window])
                by = np.argsort(sequence, kind="stable")
                cuts = np.flatnonzero(np.diff(sequence[by])) + 1
                for rows in np.split(by, cuts):
                    own = np.unique(there[window[rows]])
                    items = np.unique(np.concatenate([owners[ends[w]:ends[w + 1]] for w in own]))
                    for doc, shift in self.uses[sequence[rows[0]]]:
                        yield doc, offset[rows] + shift, m, items


def search_texts(texts: list[str | None], phrases: Phrases, window: int, shard_words: int) -> pd.DataFrame:
    """One row per text with its number of words, items found and merged hits (``FOUND``)."""
    counts, found = np.zeros(len(texts), np.int64), {}

    def flush(shard: _Shard) -> None:
        if shard.size:
            for doc, first, m, items in shard.hits(phrases):
                found.setdefault(doc, []).append((first, m, items))

    shard, step = _Shard(), max(shard_words, 2 * window)
    for doc, text in enumerate(texts):
        own = words(text)
        counts[doc] = len(own)
        for at in range(0, len(own), step - window + 1):
            if at and at + window - 1 >= len(own):
                break  # the part before holds all windows up to the end
            part = own[at:at + step]
            if shard.size and shard.size + len(part) > step:
                flush(shard)
                shard = _Shard()
            shard.add(doc, at, part)
    flush(shard)
    items, hits = [[] for _ in texts], [[] for _ in texts]
    for doc, met in found.items():
        change = np.zeros(counts[doc] + 1, np.int64)
        for first, m, _ in met:
            change += np.bincount(first, minlength=len(change)) - np.bincount(first + m, minlength=len(change))
        covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        first, last = edges[::2], edges[1::2] - 1
        starts, ends = word_places(texts[doc])
        hits[doc] = [dict(zip(("first", "last", "start", "end"), map(int, h))) for h in zip(first, last, starts[first], ends[last])]
        items[doc] = phrases.named(np.concatenate([i for *_, i in met]))
    return pd.DataFrame({"n_words": counts, "items": items, "hits": hits})


def item_pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Rows (item, words) of at most ``PIECE_WORDS`` words, a long item in overlapping pieces; items without words are left out."""

    def cut(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch["item"], batch["text"]):
                own, size = words(t), max(PIECE_WORDS, 2 * window)
                rows += [(i, b" ".join(own[at:at + size]).decode()) for at in range(0, len(own), size - window + 1)
                         if not at or at + window - 1 < len(own)]
            yield pd.DataFrame(rows, columns=["item", "words"])

    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInPandas(
        cut, "item string, words string")


def _merged(hits: pd.Series) -> pd.Series:
    """Hits of several passes as one list of disjoint spans."""
    out = []
    for found in hits:
        spans = []
        for h in sorted(found, key=lambda h: (h["first"], h["last"])):
            if spans and h["first"] <= spans[-1]["last"] + 1:
                if h["last"] > spans[-1]["last"]:
                    spans[-1] |= {"last": h["last"], "end": h["end"]}
            else:
                spans.append(dict(h))
        out.append(spans)
    return pd.Series(out)


def find_benchmark_text(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                        window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds to every row of ``docs`` what it shares with the benchmark.

    ``n_words`` (long): words of the text. ``items``: ids of the items with a
    window in it, as strings in ascending order. ``hits``: merged spans of
    words inside any occurrence, as word numbers (``first`` to ``last``) and code
    points (``start``, ``end`` exclusive). A window is ``window`` words in a
    row; an item of fewer words is one window. Columns of ``docs`` with these
    names are replaced.

    The benchmark reaches the tasks in blocks of about ``block_bytes``; one
    block is one pass without a shuffle. More blocks are one pass each, and the
    results of equal texts meet by the SHA-256 of the text.

    Null and empty texts have no words and no hits. Null or empty items find
    nothing; an item whose id is null counts for hits and has no name. Repeated
    items count once by id, repeated documents each get their row. Without any
    items, or without documents, nothing is found.
    """
    spark = docs.sparkSession
    pieces = item_pieces(benchmark, item, item_text, window).distinct()
    total = pieces.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out = [c for c in docs.columns if c not in ("n_words", "items", "hits")]

    def block(i: int) -> Broadcast:
        own = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i) if blocks > 1 else pieces
        return spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # about block_bytes

    def searched(sent: Broadcast):
        @F.pandas_udf(FOUND)
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            phrases = Phrases([i for i, _ in sent.value], [w for _, w in sent.value], window)
            for batch in batches:
                yield search_texts(batch.tolist(), phrases, window, shard_words)

        return found(F.col(text))

    if blocks == 1:
        return docs.select(*out, searched(block(0)).alias("__found")).select(*out, "__found.*")
    key = F.sha2(F.col(text), 256)
    passes = None
    for i in range(blocks):
        one = docs.select(key.alias("__key"), searched(block(i)).alias("f")).where(F.size("f.hits") > 0).groupBy("__key").agg(
            F.first("f").alias("f"))
        passes = one if passes is None else passes.unionByName(one)
    joined = F.pandas_udf(_merged, FOUND.split("hits ")[1])
    met = passes.groupBy("__key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"),
        joined(F.flatten(F.collect_list("f.hits"))).alias("hits")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = F.pandas_udf(lambda texts: texts.map(lambda t: len(words(t))), "long")
    # equal texts may be a third of all rows, so each of their rows meets one of several copies of what was found
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("__salt")
    rows = docs.select(*out, counted(F.col(text)).alias("n_words"), key.alias("__key"), salt).join(met, ["__key", "__salt"], "left")
    return rows.select(*out, "n_words", *[
        F.coalesce(c, F.array().cast(met.schema[c].dataType)).alias(c) for c in ("items", "hits")])


def remove_benchmark_text(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the spans that are part of the benchmark cut out of their texts; other texts, nulls included, stay as they are."""
    found = find_benchmark_text(docs, benchmark, text, **options)
    start = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at("hits", i)["end"])
    end = lambda i: F.when(i == F.size("hits"), F.char_length(text)).otherwise(F.col("hits")[i]["start"])
    parts = F.transform(F.sequence(F.lit(0), F.size("hits")), lambda i: F.col(text).substr(start(i) + 1, end(i) - start(i)))
    cut = F.when(F.size("hits") > 0, F.array_join(parts, "")).otherwise(F.col(text))
    return found.withColumn(text, cut).select(*docs.columns)
