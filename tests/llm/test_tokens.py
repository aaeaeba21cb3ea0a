"""Token counts, pieces and token files against the tokenizers library on whole texts."""

import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gaugewarden.llm import encode, token_counts, token_files, words

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aAbBtThHeE 's're'LL0129²½ßÉéÀİΣσς\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​!?.,#$%&@<|>|🙂漢字̧́Åﬁ\x00\x7f�_-"
TEXTS = st.lists(st.one_of(st.sampled_from(LETTERS), st.sampled_from([*words.SPECIALS, "aaaa", "thethe", "  "]), st.characters(
    exclude_categories=["Cs"])), max_size=40).map("".join)
SCHEMA = "doc_id long, text string, n_tokens string, ids int, piece string, item double"


def library(text):
    return words.load(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_and_ids_are_the_library_s(text):
    want = library(text)
    assert token_counts.counter(PATH).count([text]) == [len(want)]
    assert np.frombuffer(words.library_encoder(PATH).encode([text])[0], "<u4").tolist() == want


def test_simultaneous_merging_of_runs():
    table = token_counts.counter(PATH).table
    for word in ("aaaaaaa", "ababab", "a", "thethethe", "zzzzzzzzzzzzzzz"):
        assert table.surviving([word])[0] == len(library(word))


def test_long_pretokens_by_buckets_of_ranks():
    rng, count = random.Random(3), token_counts.counter(PATH).count
    texts = ["".join(rng.choice(["the", "inter", "nation", "al", "of", "a", "zz", "q"]) for _ in range(rng.randrange(60, 900))) for _ in range(40)]
    texts += ["a" * n for n in (199, 200, 201, 202, 777, 30_000)] + ["ab" * 500, "a" * 300 + " " + "thethe" * 80]
    assert count(texts) == [len(library(t)) for t in texts]
    table = token_counts.counter(PATH).table
    lists = [table.symbols(t) for t in texts if " " not in t]
    assert (table._merged_in_buckets(lists) == table._merged_in_rounds(lists)).all()


def test_a_million_letters_take_seconds():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    start = time.process_time()
    n = token_counts.counter(PATH).count([text])[0]
    assert time.process_time() - start < 10 and n == len(library(text))


@pytest.fixture(scope="module")
def odd_docs(spark):
    long = "The quick brown fox. " * 30_000
    rows = [(3, "Hello world, it's 2024"), (1, None), (2, ""), (5, long), (7, "same"), (7, "same"), (None, "no key"), (9, "x" * 5_000),
            (8, "<|endoftext|>a <|startoftext|>")]
    return spark.createDataFrame([(k, t, "clash", 1, "clash", 0.5) for k, t in rows], SCHEMA)


def test_counts_of_odd_rows(odd_docs):
    got = token_counts.count_tokens(odd_docs, PATH)
    assert got.columns == odd_docs.columns
    assert all(r.n_tokens == len(library(r.text)) and r.item == 0.5 for r in got.collect())


def test_counts_of_an_empty_table(odd_docs):
    assert token_counts.count_tokens(odd_docs.limit(0), PATH).count() == 0


def test_pieces_cover_every_text(odd_docs):
    rows = encode.encode_pieces(odd_docs, PATH, end_id=1, piece_tokens=64).collect()
    texts = {}
    for r in odd_docs.select("doc_id", "text").distinct().collect():
        texts[r.doc_id] = [*library(r.text), 1]
    assert len([r for r in rows if r.doc_id == 7]) == 2
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == texts[r.doc_id][r.start:r.start + r.length] and r.start == 64 * r.piece and len(ids) == r.length
    assert {k: sum(r.length for r in rows if r.doc_id == k) for k in texts if k != 7} == {
        k: len(v) for k, v in texts.items() if k != 7}


def test_token_files_round_trip(spark, odd_docs, tmp_path):
    folder = str(tmp_path / "tokens")
    index = token_files.write_token_files(odd_docs, folder, PATH, end_id=2, rows_per_shard=3)
    rows = sorted(token_files.read_token_files(spark, folder, index).collect(), key=lambda r: r.start)
    order = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    assert [r.doc_id for r in rows] == [r.doc_id for r in order]
    for r, o in zip(rows, order):
        assert np.frombuffer(r.ids, "<u4").tolist() == [*library(o.text), 2] and r.start == at
        at += r.n_tokens
    e = index.where("doc_id = 5").first()
    assert token_files.read_document(folder, e["shard"], e["place"], e["bytes"]).tolist() == [
        *library(order[[o.doc_id for o in order].index(5)].text), 2]
    assert index.select("shard").distinct().count() >= 3 and not [f for f in os.listdir(folder) if "temporary" in f]


def test_token_files_do_not_depend_on_partitions(spark, odd_docs, tmp_path):
    docs = odd_docs.where("doc_id IS NOT NULL")
    contents = []
    for name, df in (("a", docs.coalesce(1)), ("b", docs.orderBy(F.rand(3)).repartition(7))):
        token_files.write_token_files(df, str(tmp_path / name), PATH, end_id=2, rows_per_shard=2)
        contents.append({f: zlib.crc32((tmp_path / name / f).read_bytes()) for f in os.listdir(tmp_path / name)})
    assert contents[0] == contents[1]


def test_token_files_of_an_empty_table(spark, odd_docs, tmp_path):
    folder = str(tmp_path / "none")
    index = token_files.write_token_files(odd_docs.limit(0), folder, PATH, end_id=2)
    assert token_files.read_token_files(spark, folder, index).count() == 0
