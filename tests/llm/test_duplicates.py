"""Exact and SimHash duplicates, and components, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugewarden.llm import components, exact_dedup, simhash

SCHEMA = "doc_id long, text string, digest string, keep string, norm int, row int, fp string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "clash", None, 1, 2, "clash") for k, t in rows], SCHEMA)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    links += [(2000, 2000 + i) for i in range(1, 300)] + [(7, 7)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    want = roots({n for pair in links for n in pair}, links)
    assert {r.node: r.root for r in components.connected_components(df).collect()} == {n: r for n, r in want.items() if n != r}
    assert components.connected_components(df.limit(0)).count() == 0


TEXTS = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (4, None), (3, ""), (8, "ab"), (None, "a\nb"), (2, "a\tb"), (6, " "), (7, " "),
         (10, "\r\n"), (11, "z" * 100_000), (12, "z" * 100_000)]


def normalised(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("options", [
    {}, {"files_per_batch": 1}, {"digest": lambda: F.substring(F.sha2(exact_dedup.normalised(), 256), 1, 1)},
    {"digest": lambda: F.lit("all collide"), "files_per_batch": 2}])
def test_exact_duplicates(spark, tmp_path, options):
    path = str(tmp_path / "docs")
    docs(spark, TEXTS).repartition(5).write.parquet(path)
    if "digest" in options:
        options = options | {"digest": options["digest"]()}
    rows = exact_dedup.exact_duplicates(spark, path, **options).collect()
    groups = {}
    for k, t in TEXTS:
        groups.setdefault(normalised(t), []).append(k)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    assert len(rows) == len(TEXTS)
    for r in rows:
        own = by_hash[r.text_sha256]
        assert r.keep_id == min(k for k in own if k is not None) and r.group_size == len(own)
    for digest, own in by_hash.items():  # one row stays, with the smallest key
        assert [r.doc_id for r in rows if r.kept and r.text_sha256 == digest] == [min(k for k in own if k is not None)]


def test_state_is_kept_between_runs(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    digest = F.sha2(exact_dedup.normalised(), 256)
    for rows, size in (([(5, "a b"), (6, "c")], 1), ([(2, "a  b")], 2), ([(9, "a\tb"), (10, "d")], 3)):
        df = docs(spark, rows)
        df.coalesce(1).write.mode("append").parquet(path)
        found = exact_dedup.update_state(spark, path, df.schema, digest, state)
        entry = found.where(F.col("digest") == hashlib.sha256(b"a b").hexdigest()).first()
        assert (entry["n"], entry["keep"]["id"]) == (size, 2 if size > 1 else 5)


def test_first_copies_keep_all_columns(spark):
    df = docs(spark, TEXTS)
    kept = exact_dedup.keep_first_copies(df)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted({2, 3, 7, 8, 6, 11})
    assert exact_dedup.keep_first_copies(df.limit(0)).count() == 0


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["One", "two ", "ÀÉ", "\t", "\n ", "x", " a ", "漢 "]) for _ in range(rng.randrange(30)))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0


def test_anchors_cover_all_near_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 1_500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1_500, dtype=np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    row, home = simhash.anchors(base, 0)
    assert (row == np.arange(len(base))).all()
    at, visited = simhash.anchors(near, 2)
    met = {(r, a) for r, a in zip(at.tolist(), visited.tolist())}
    assert all((i, home[i]) in met for i in range(len(base)))
    assert 40 < len(at) / len(base) < 110 and len(met) == len(at)


def test_near_duplicates_with_crowded_groups(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = [rng.choice(words) for _ in range(600)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 160):  # near copies of one text
        own = base[:]
        own[rng.randrange(600)] = "changed"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(rng.choice(words) for _ in range(50))) for i in range(160, 260)]
    rows += [(300, None), (301, ""), (302, "\t"), (None, " "), (303, "one"), (303, "one"), (304, "x " * 60_000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = {t: plain_fingerprint(t) if len(t or "") < 50_000 else simhash.fingerprint(t) for _, t in rows}
    v = sorted(set(prints.values()))
    links = [(a, b) for a in v for b in v if a < b and (a ^ b).bit_count() <= 2]
    root = roots(v, links)
    smallest = {}
    for k, t in rows:
        if k is not None:
            r = root[prints[t]]
            smallest[r] = min(k, smallest.get(r, k))
    want = sorted((k is None, k or 0, f"{prints[t]:016x}", smallest[root[prints[t]]]) for k, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == want
    df = docs(spark, rows)
    stay = simhash.first_of_groups(df)
    assert stay.schema == df.schema and sorted(r.doc_id for r in stay.collect()) == sorted(smallest.values())
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.first_of_groups(df.limit(0)).count() == 0


def test_rows_of_a_written_table_are_named_by_file_and_position(spark, tmp_path):
    rows = [(i % 50 if i % 3 else None, f"some words {i % 17} here and there {i % 17} and more of {i % 17}") for i in range(300)]
    path = str(tmp_path / "docs")
    docs(spark, rows).repartition(5).write.parquet(path)
    table = spark.read.parquet(path)
    stay = simhash.first_of_groups(table, written=True)
    assert stay.schema == table.schema
    assert sorted(map(str, stay.collect())) == sorted(map(str, simhash.first_of_groups(table).collect()))
