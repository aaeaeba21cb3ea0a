"""Phrase mining and its automata against plain counters."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugewarden.llm import collocations
from gaugewarden.llm.count_automata import CountAutomaton, PathReader, union

LOWER = {c: c + 32 for c in range(65, 91)}


def counts(rows, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    return f, n


def plain(rows, most, least, top):
    out = []
    f, n = counts(rows, most)
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i:i + size]] = max(around[p[i:i + size]], a)
        kept = []
        for p, a in candidates.items():
            s, k = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not (around[p] and 100 * around[p] >= 50 * a):
                kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["a", "B", "be", "ça", "\x01x", "d\x01", "été", "Ünd", "x.y", "end.", "q,", "z\n", "w\t\tv", "..", "'s"])
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=rng.dirichlet(np.ones(len(vocabulary)) * 0.5)))
    rows = [(["en", "de", None, "und"][rng.integers(4)], draw(int(rng.integers(0, 60)))) for _ in range(120)]
    rows += [("en", rows[3][1])] * 60 + [("hot", "to be or not to be")] * 90 + [("en", None), (None, ""), ("none", " . "), ("long", draw(5_000))]
    return rows


def test_automata_keep_paths_and_weights():
    rng = np.random.default_rng(2)
    for depth in (2, 3, 4):
        whole, parts = Counter(), []
        for _ in range(4):
            reader = PathReader(depth, b".")
            for _ in range(20):
                text = " ".join(rng.choice(["a", "b", "c", ".", "é"], int(rng.integers(0, 30))))
                for _ in reader.add("g", text, 10 ** 9):
                    raise AssertionError
                for piece in text.split("."):
                    w = piece.encode().split()
                    whole.update(tuple(w[i:i + size]) for size in range(1, depth + 1) for i in range(len(w) - size + 1))
            for _, a in reader.automata():
                b = CountAutomaton.from_bytes(a.to_bytes())
                assert b.words == a.words and (b.counts == a.counts).all() and all((x == y).all() for x, y in zip(a.cols, b.cols))
                cut = a.before((b"b", b"c", b"", b"")[:depth])
                parts += [CountAutomaton.from_bytes(p.to_bytes()) for p in (a.part(0, cut), a.part(cut, len(a))) if len(p)]
        for fold in (1, 50, 10 ** 9):
            a = union(iter(parts), fold)
            found = {tuple(a.text(p, d).encode().split()): w for d in range(1, depth + 1) for p, w in zip(*(x.tolist() for x in a.phrases(d)))}
            assert found == whole


@pytest.mark.parametrize("most,least,options", [
    (3, 10, {}), (3, 10, {"range_bytes": 600, "shard_words": 97}), (2, 3, {"range_bytes": 300, "shard_words": 1}), (4, 5, {"range_bytes": 2_000})])
def test_phrases_agree_with_plain_counters(spark, most, least, options):
    rows = corpus(most)
    df = spark.createDataFrame([(g, t, 1, "x") for g, t in rows], "lang string, text string, rank int, phrase string").repartition(4)
    found = collocations.collocations(df, max_words=most, min_count=least, top=40, **options)
    assert sorted(map(tuple, found.collect())) == plain(rows, most, least, 40)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []


def test_scores_beyond_64_bits(spark):
    n = 10 ** 14 + 7
    weights = spark.createDataFrame([("en", 0, "", 5 * n), ("en", 1, "a", n), ("en", 1, "b", 3 * n + 1), ("en", 2, "a b", n - 3), ("en", 1, "c", n - 3),
                                     ("en", 2, "a c", n - 3)], "lang string, size int, phrase string, f long")
    got = {r.phrase: r.score for r in collocations.best_phrases(weights, 2).collect()}
    assert got == {"a b": 10 ** 6 * (n - 3) ** 2 // (n * (3 * n + 1)), "a c": 10 ** 6 * (n - 3) ** 2 // (n * (n - 3))}
