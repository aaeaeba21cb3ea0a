"""Benchmark text in documents: index, search and removal against plain loops."""

import re

import numpy as np
import pytest

from gaugewarden.llm import decontamination
from gaugewarden.llm.fm_index import FMIndex

from ..conftest import rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return [w.group().translate({c: c + 32 for c in range(65, 91)}) for w in WORD.finditer(text or "")]


def plain(text, items, window):
    """Number of words, ids of the items found, set of hit words."""
    own, named, hit = low(text), set(), set()
    for k, t in items:
        w = low(t)
        m = min(window, len(w))
        windows = {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(own) - m + 1):
            if tuple(own[i:i + m]) in windows:
                hit |= set(range(i, i + m))
                if k is not None:
                    named.add(str(k))
    return len(own), sorted(named), hit


@pytest.mark.parametrize("sample_every", [1, 3, 16])
def test_index_finds_and_locates_all(sample_every):
    rng = np.random.default_rng(sample_every)
    for trial in range(25):
        largest = int(rng.integers(1, 6))
        sequences = [rng.integers(1, largest + 1, rng.integers(0, 40)) for _ in range(rng.integers(1, 6))] + [np.ones(70, int)] * (trial % 3)
        index = FMIndex(sequences, largest, sample_every)
        for m in (1, 2, 5):
            patterns = rng.integers(1, largest + 1, (15, m))
            for p, a, b in zip(patterns, *index.find(patterns)):
                wanted = {(i, j) for i, s in enumerate(sequences) for j in range(len(s) - m + 1) if (s[j:j + m] == p).all()}
                assert max(0, b - a) == len(wanted)
                if wanted:
                    assert set(zip(*(x.tolist() for x in index.locate(np.arange(a, b))))) == wanted


def corpus():
    rng = np.random.default_rng(4)
    vocabulary = ["Alpha", "beta", "Gámma", "delta9", "ÉTÉ", "x"]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(1, draw(14)), (2, draw(12)), (2, draw(12)), (3, "delta9 x, x"), (10, None), (11, ""), (12, " .;"), (None, draw(11)), (13, "Gámma")]
    items.append((20, items[0][1]))
    texts = [None, "", "...", "x", draw(400), draw(30) + "\n" + items[0][1].upper() + "--" + draw(5), items[1][1], items[7][1].replace(" ", "  "),
             "DELTA9/x\tX", "été ÉTÉ", draw(3000), "beta " * 50]
    return [(i, t, "own") for i, t in enumerate(texts + [texts[5]] * 40 + [None] * 20)], items


@pytest.mark.parametrize("shard_words,block_bytes", [(1_000_000, 1 << 20), (25, 1 << 20), (1_000, 150)])
def test_hits_agree_with_plain_search(spark, shard_words, block_bytes):
    texts, items = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_benchmark_text(docs, bench, shard_words=shard_words, block_bytes=block_bytes).collect()
    assert len(found) == len(texts)
    for r in found:
        n, named, hit = plain(r.text, items, 10)
        assert (r.n_words, r["items"]) == (n, sorted(named))
        got = [i for h in r.hits for i in range(h["first"], h["last"] + 1)]
        assert got == sorted(hit)
        for h in r.hits:
            assert low(r.text[h["start"]:h["end"]]) == low(r.text)[h["first"]:h["last"] + 1]


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two three! and that", 0), (2, "nothing here", 0), (3, None, 0)], "doc_id long, text string, hits int")
    bench = spark.createDataFrame([("a", "one TWO three")], "item_id string, text string")
    cut = decontamination.remove_benchmark_text(docs, bench)
    assert cut.columns == docs.columns[:2] + ["hits"]
    assert rows(cut.select("doc_id", "text")) == [(1, "Keep this. ! and that"), (2, "nothing here"), (3, None)]
    assert [r.hits for r in decontamination.find_benchmark_text(docs, bench.limit(0)).collect()] == [[], [], []]
    assert decontamination.find_benchmark_text(docs.limit(0), bench).collect() == []
