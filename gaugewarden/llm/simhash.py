"""SimHash near-duplicates by covering anchor points.

A covering code has a codeword, an anchor, within its radius of every
fingerprint. The 64 bits are split into blocks with a perfect code each: two
Golay codes of 23 bits (radius 3) and two repetition codes of 9 bits (radius
4), which makes 2^26 anchors. A fingerprint's home is the anchor within all
radii. If two fingerprints differ in at most ``t`` bits, each lies within
radius plus its share of ``t`` of the other's home in every block, so a
fingerprint that visits all anchors of that reach meets all its partners. A
pair is compared at the home of the smaller one only, hence once.
"""

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import stage_table
from .components import connected_components

GOLAY, GOLAY_RADIUS, REPEAT, REPEAT_RADIUS = 23, 3, 9, 4
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value).
GENERATOR = 0b101011100011
SHINGLES_AT_ONCE = 200_000
#: Most buckets of dropped rows that are sent to all tasks, as one number each.
BUCKETS = 1 << 20


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[i:i + SHINGLES_AT_ONCE], last[i:i + SHINGLES_AT_ONCE],
                                                                  strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndromes of byte positions, and for each excess bound the error patterns of every syndrome.

    Codewords near ``v`` are ``v ^ e`` for all error patterns ``e`` with the
    syndrome of ``v``; their excess is how far the weight of ``e`` lies over the radius.
    """
    def remainder(v: int) -> int:
        for bit in range(GOLAY - 1, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    unit = [remainder(1 << i) for i in range(GOLAY)]
    table = np.zeros((3, 256), np.int64)
    for k in range(3):
        for byte in range(256):
            for j in range(8):
                if byte >> j & 1 and 8 * k + j < GOLAY:
                    table[k, byte] ^= unit[8 * k + j]
    found: list[tuple[int, int, int]] = []
    for weight in range(GOLAY_RADIUS + 3):
        for bits in combinations(range(GOLAY), weight):
            syndrome = error = 0
            for i in bits:
                syndrome ^= unit[i]
                error |= 1 << i
            found.append((syndrome, max(0, weight - GOLAY_RADIUS), error))
    s, excess, error = np.array(sorted(found), np.int64).T
    options = {}
    for reach in range(3):
        keep = excess <= reach
        options[reach] = (np.searchsorted(s[keep], np.arange(2049)), excess[keep], error[keep])
    return table, options


def _golay_options(part: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, codeword, excess) of all codewords whose excess is at most ``left`` of their row."""
    table, options = _golay()
    syndrome = table[0, part & 255] ^ table[1, part >> 8 & 255] ^ table[2, part >> 16 & 255]
    rows, words, over = [], [], []
    for reach, (start, excess, error) in options.items():
        at = np.flatnonzero(left == reach)
        n = start[syndrome[at] + 1] - start[syndrome[at]]
        row = np.repeat(at, n)
        k = np.repeat(start[syndrome[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows.append(row)
        words.append(part[row] ^ error[k])
        over.append(excess[k])
    return np.concatenate(rows), np.concatenate(words), np.concatenate(over)


def _repeat_options(part: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the two words, all zeros and all ones, of a repetition code."""
    ones = np.bitwise_count(part).astype(np.int64)
    rows, words, over = [], [], []
    for bit, distance in ((0, ones), (1, REPEAT - ones)):
        excess = np.maximum(0, distance - REPEAT_RADIUS)
        at = np.flatnonzero(excess <= left)
        rows.append(at)
        words.append(np.full(len(at), bit, np.int64))
        over.append(excess[at])
    return np.concatenate(rows), np.concatenate(words), np.concatenate(over)


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within covering radius plus ``threshold``; with 0, each row's home alone, in the order of the rows."""
    if not 0 <= threshold <= 2:
        raise ValueError("the error patterns are listed for a threshold of at most 2 bits")
    v = prints.view(np.uint64) if prints.dtype == np.int64 else prints.astype(np.uint64)
    row, anchor, left = np.arange(len(v)), np.zeros(len(v), np.int64), np.full(len(v), threshold, np.int64)
    shift = 0
    for width, options in ((GOLAY, _golay_options), (GOLAY, _golay_options), (REPEAT, _repeat_options), (REPEAT, _repeat_options)):
        part = (v[row] >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        at, word, excess = options(part, left)
        bits = width if width == GOLAY else 1
        row, anchor, left = row[at], anchor[at] << bits | word, left[at] - excess
        shift += width
    if threshold == 0:  # the two words of a repetition code come one after the other
        anchor = anchor[np.argsort(row, kind="stable")]
        row = np.arange(len(v))
    return row, anchor


def _with_anchors(prints: DataFrame, threshold: int, at_once: int = 5_000) -> DataFrame:
    def reach(batches):
        for batch in batches:
            for i in range(0, len(batch), at_once):
                v = batch["fp"].to_numpy()[i:i + at_once]
                row, anchor = anchors(v, threshold)
                yield pd.DataFrame({"anchor": anchor, "fp": v[row]})

    return prints.select("fp").mapInPandas(reach, "anchor long, fp long")


def fingerprint_links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that differ in at most ``threshold`` bits, each once."""
    homes = _with_anchors(prints, 0).withColumnRenamed("fp", "a")
    visits = _with_anchors(prints, threshold).withColumnRenamed("fp", "b")
    near = F.expr(f"a < b AND bit_count(a ^ b) <= {threshold}")
    return homes.hint("merge").join(visits, "anchor").where(near).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = 2, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Equal fingerprints are one point, so groups of copies never meet as
    pairs. The component is the smallest ``key`` reachable by links. A null
    text counts as empty; texts without words share fingerprint 0 and are
    linked like any others. Null keys keep their row but name no component
    unless all keys of it are null. Repeated rows stay repeated; other columns
    are not read, whatever their names.
    """
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    marked = docs.select(F.col(key).alias("id"), fingerprints(F.coalesce(F.col(text), F.lit(""))).alias("fp"))
    marked = stage_table(marked, "fingerprints")
    prints = stage_table(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    links = stage_table(fingerprint_links(prints, threshold), "fingerprint-links")
    roots = connected_components(links)
    grouped = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    grouped = stage_table(grouped, "fingerprint-roots")
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage_table(grouped.join(smallest, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(named, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, threshold: int = 2, width: int = 3, text: str = "text", key: str = "doc_id",
                    written: bool = False) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of linked texts the smallest ``key`` stays.

    Null keys come last; of rows that repeat a key the first written one stays.
    ``written`` says that ``docs`` is one folder of Parquet files as it was read: then file and
    position name the rows. Otherwise they are written first, as rows need names that a second look finds again.
    """
    if written:
        row = F.struct(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), F.col("_metadata.row_index").alias("at"))
    else:
        row = F.struct(F.monotonically_increasing_id().alias("at"))
    place = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), row.alias("row"))
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"), F.col(text).alias("__text"), place.alias("__place"))
    rows = rows if written else stage_table(rows, "near-duplicate-input")
    gone = near_duplicates(rows, threshold, width, "__text", "__place").where("__place != component_id").select("__place.row")
    bucket = F.pmod(F.xxhash64("row"), F.lit(BUCKETS))
    gone = stage_table(gone.withColumn("bucket", bucket), "near-duplicate-rows")
    # only rows in a bucket with a dropped one are shuffled; there are BUCKETS numbers at most to send to all tasks
    buckets = F.broadcast(gone.select("bucket").distinct())
    marked = rows.select("__row", F.col("__place.row").alias("row")).withColumn("__bucket", bucket)
    met = F.col("__bucket") == F.col("bucket")
    alone = marked.join(buckets, met, "left_anti")
    kept = marked.join(buckets, met, "left_semi").join(gone.select("row"), "row", "left_anti")
    return alone.select("__row").unionByName(kept.select("__row")).select("__row.*")
