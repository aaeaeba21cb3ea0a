"""The registered queries against SQL or brute force on whole tables, and the pipeline stage by stage."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from gaugewarden.llm import mixing, queries, words

from .test_duplicates import normalised, plain_fingerprint, roots

PATH = public_tokenizers.path(queries.VOCABULARY)
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})")
    assert {d[0]: str(d[1]) for d in wanted.description} == {c: TYPES[t] for c, t in df.dtypes}
    assert sorted(map(tuple, df.collect()), key=str) == sorted(wanted.fetchall(), key=str)


def encoded(docs, end):
    ids = words.load(PATH).encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    return [(k, np.array([*e.ids, end], "<u4")) for (k, _), e in zip(docs, ids)]


def pieces_of(docs):
    out = Counter()
    for k, ids in encoded(docs, 1):
        for i in range(0, len(ids), 4096):
            out[k, i // 4096, i, len(ids[i:i + 4096]), zlib.crc32(ids[i:i + 4096].tobytes())] += 1
    return out


def whole_sequences(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in groups.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(groups)


def test_token_queries(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    ids = dict(encoded(docs, 2))
    counted = queries.QUERIES["op2_token_counts"](spark, sf_dir).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counted} == {
        (k, len((t or "").encode()), len(ids[k]) - 1, len(ids[k]) > 2049) for k, t in docs}
    at, want = 0, set()
    for k in sorted(ids):
        want.add((k, at, len(ids[k]), zlib.crc32(ids[k].tobytes())))
        at += len(ids[k])
    assert {tuple(r) for r in queries.QUERIES["op9_token_files"](spark, sf_dir).collect()} == want
    packed = queries.QUERIES["op8_packed_sequences"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces_of(docs)
    total = sum(len(v) for v in ids.values())
    assert whole_sequences(packed) <= -(-total // 4096) + 1


def smallest_of_groups(rows):
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    points = sorted(set(prints.values()))
    root = roots(points, [(a, b) for i, a in enumerate(points) for b in points[i + 1:] if (a ^ b).bit_count() <= 2])
    first = {}
    for k in sorted(prints):
        first.setdefault(root[prints[k]], k)
    return sorted(first.values())


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def run(name, df):
        out = stages[name](spark, df, sf_dir)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        return spark.read.parquet(path)

    strange = spark.createDataFrame([(9001, "12 34 %"), (9002, None), (9003, "蜀道之难难于上青天" * 60)], "doc_id long, text string")
    known = run("language ID", docs.unionByName(strange, allowMissingColumns=True))
    assert known.schema == docs.schema and sorted(map(str, known.collect())) == sorted(map(str, docs.collect()))
    single = run("exact dedup", known)
    first = {}
    for r in sorted(known.collect(), key=lambda r: r.doc_id):
        first.setdefault(normalised(r.text), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values()) and single.schema == docs.schema
    apart = run("SimHash near-dedup", single)
    assert sorted(r.doc_id for r in apart.collect()) == smallest_of_groups(single.collect()) and apart.schema == docs.schema
    mixed = run("mixing to target weights", apart)
    copies = {r.doc_id: r.copies for r in mixing.mixture(apart, queries.domain_labels(spark, sf_dir)).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n}) and mixed.schema == docs.schema
    packed = run("best-fit packing", mixed).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces_of(
        [(r.doc_id, r.text) for r in mixed.collect()])
    whole_sequences(packed)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)
