"""Token-id files: every document compressed by itself with one shared zstandard dictionary.

A file holds the compressed documents of a shard one behind the other; its
index, a Parquet table, has their places. The dictionary is trained on
serialised id arrays and lies beside the files; each file begins with its hash,
so a document is read with one seek and the right dictionary or not at all.
"""

import hashlib
import json
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage_table
from .files import committed, file_system, write_bytes
from .ranges import in_shards, shard_starts
from .words import library_encoder, text_blocks

#: File head: this mark, then the 32 bytes of the dictionary's SHA-256.
MAGIC = b"TOKIDS01"
HEAD = len(MAGIC) + 32
INDEX = "doc_id long, shard int, position long, place long, bytes int, n_tokens long, start_in_shard long"
LEVEL = 3


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str, sample_docs: int, sample_ids: int,
                     dictionary_bytes: int) -> bytes:
    """A dictionary from at most ``sample_docs`` documents of ``sample_ids`` ids each, chosen by the hash of the key.

    The bounds touch the size of the files only; what they hold is whole. Too
    few or too short documents give an empty dictionary.
    """
    keys = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k")).distinct().orderBy(
        F.xxhash64(F.col("k").cast("string")), "k").limit(sample_docs)
    chosen = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(keys), "k", "left_semi").groupBy("k").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")).select("text")  # one text of a key that many rows share

    def serialised(batches):
        for batch in batches:
            for block in text_blocks(batch["text"]):
                encoded = library_encoder(tokenizer).encode(block)
                yield pd.DataFrame({"ids": [ids[:4 * sample_ids] + np.uint32(end_id).tobytes() for ids in encoded]})

    samples = [bytes(r.ids) for r in chosen.mapInPandas(serialised, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(dictionary_bytes, sorted(samples), level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


@lru_cache(maxsize=4)
def _codec(dictionary: bytes):
    d = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, **d), zstandard.ZstdDecompressor(**d)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
                      rows_per_shard: int = 8_000, max_shards: int = 10_000, sample_docs: int = 2_000, sample_ids: int = 2_000,
                      dictionary_bytes: int = 64_000) -> DataFrame:
    """Encode ``docs`` in ascending key order into files below ``folder``; return the index, staged and thus done.

    Null keys come first, repeated rows keep a place each (ordered by text), a
    null text is the end id alone. Shards follow from the keys alone. Other
    columns are not read.
    """
    dictionary = train_dictionary(docs, tokenizer, end_id, key, text, sample_docs, sample_ids, dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()
    write_bytes(f"{folder}/dictionary-{digest.hex()}.zdict", dictionary)
    end = np.uint32(end_id).tobytes()
    starts = shard_starts(docs, key, rows_per_shard, max_shards)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = in_shards(rows, "doc_id", starts, "text").select("shard", F.col("doc_id").cast("string"), "text")

    def write(batches):
        shard, context, out, index = None, None, None, []
        compress = _codec(dictionary)[0].compress
        encode = library_encoder(tokenizer).encode

        def finish():
            context.__exit__(None, None, None)
            table = pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])
            table["doc_id"] = pd.array([None if k is None else int(k) for k in table["doc_id"]], "Int64")
            return table

        for batch in batches:
            done = 0
            for block in text_blocks(batch["text"]):
                for ids in encode(block):
                    number, k = int(batch["shard"].iat[done]), batch["doc_id"].iat[done]
                    done += 1
                    if number != shard:
                        if context is not None:
                            yield finish()
                        shard, index, tokens, place = number, [], 0, HEAD
                        context = committed(f"{folder}/tokens-{shard:06d}.bin")
                        out = context.__enter__()
                        out.write(MAGIC + digest)
                    data = compress(ids + end)
                    out.write(data)
                    index.append((k, shard, len(index), place, len(data), len(ids) // 4 + 1, tokens))
                    tokens, place = tokens + len(ids) // 4 + 1, place + len(data)
        if context is not None:
            yield finish()

    index = stage_table(rows.mapInPandas(write, INDEX), f"token-index-{uuid.uuid4().hex[:8]}")
    totals = index.agg(F.count("*"), F.sum("n_tokens")).first()
    write_bytes(f"{folder}/MANIFEST.json", json.dumps({"documents": totals[0], "tokens": totals[1] or 0, "shards": len(starts) + 1,
                                                       "dictionary_sha256": digest.hex(), "end_id": end_id}).encode())
    return index


def _dictionary(system, folder: str, digest: bytes) -> bytes:
    with system.open_input_stream(f"{folder}/dictionary-{digest.hex()}.zdict", compression=None) as f:
        data = f.read()
    if hashlib.sha256(data).digest() != digest:
        raise ValueError("the dictionary does not match its hash")
    return data


def read_document(folder: str, shard: int, place: int, size: int) -> np.ndarray:
    """Ids of one document, by the place its index row gives."""
    system, root = file_system(folder)
    with system.open_input_file(f"{root}/tokens-{shard:06d}.bin") as f:
        head = f.read(HEAD)
        if head[:len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        f.seek(place)
        data = f.read(size)
    return np.frombuffer(_codec(_dictionary(system, root, head[len(MAGIC):]))[1].decompress(data), "<u4")


def read_token_files(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all documents, decoded from the files.

    ``start`` counts the ids of all documents before: one row per shard is
    summed up on the driver, at most ``max_shards``.
    """
    totals = sorted((r.shard, r.n) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before, offset = 0, {}
    for shard, n in totals:
        offset[shard] = before
        before += n
    schema = "doc_id long, start long, n_tokens long, ids binary"
    entries = index.select(F.col("doc_id").cast("string"), "shard", "position", "place", "bytes", "n_tokens", "start_in_shard")
    entries = entries.repartition(max(1, len(totals)), "shard").sortWithinPartitions("shard", "position")

    def read(batches):
        at, stream, unpack = None, None, None
        for batch in batches:
            rows, size = [], 0
            for r in batch.itertuples(index=False):
                if r.shard != at:
                    system, root = file_system(folder)
                    if stream is not None:
                        stream.close()
                    stream = system.open_input_stream(f"{root}/tokens-{r.shard:06d}.bin", compression=None)
                    head, at = stream.read(HEAD), r.shard
                    if head[:len(MAGIC)] != MAGIC:
                        raise ValueError("not a token file")
                    unpack = _codec(_dictionary(system, root, head[len(MAGIC):]))[1].decompress
                ids = unpack(stream.read(r.bytes))
                if len(ids) != 4 * r.n_tokens:
                    raise ValueError(f"document {r.doc_id} does not match its index row")
                rows.append((r.doc_id, offset[at] + r.start_in_shard, r.n_tokens, ids))
                size += len(ids)
                if size > 16_000_000:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)

    def table(rows):
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
        out["doc_id"] = pd.array([None if k is None else int(k) for k in out["doc_id"]], "Int64")
        return out

    return entries.mapInPandas(read, schema)
