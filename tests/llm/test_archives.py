"""WARC archives: whole round trips, equal payloads, and files that depend on the rows alone."""

import base64
import gzip
import hashlib
import json
import os

from pyspark.sql import functions as F

from gaugewarden.llm import warc

PAGES = [(4, "http://a/4", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", None), (8, "http://a/8", ""),
         (5, None, "é漢"), (7, "http://a/7\r\nX: y", "<p>same</p>"), (6, "http://a/6", "x" * 300_000), (None, "http://a/n", "é漢"),
         (3, "http://a/3", "own"), (3, "http://a/3", "own"), (11, "u", "a\r\n\r\nb")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows],
                                 "page_id long, url string, html string, shard int, payload string, digest string")


def written(spark, folder, df, **options):
    manifest = warc.write_archives(df, folder, rows_per_shard=3, **options)
    return manifest, warc.read_archives(spark, folder, manifest).collect()


def test_round_trip(spark, tmp_path):
    _, rows = written(spark, str(tmp_path / "w"), pages(spark))
    assert len(rows) == len(PAGES)
    first = {"<p>same</p>": 2, "": 8, "é漢": 5, "own": 3}
    for k, _, html in PAGES:
        payload = (html or "").encode()
        same = [r for r in rows if r.page_id == k]
        assert all((r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
                   for r in same)
        if k == 3:
            assert sorted((r.record_type, r.refers_to) for r in same) == [("response", None), ("revisit", 3)]
        elif first.get(html or "", k) == k:
            assert [(r.record_type, bytes(r.payload)) for r in same] == [("response", payload)]
        else:
            assert [(r.record_type, r.refers_to, r.payload) for r in same] == [("revisit", first[html or ""], None)]
    ids = {r.record_id for r in rows}
    assert len(ids) == len(rows) and all(r.refers_to_record in ids for r in rows if r.record_type == "revisit")


def test_least_size_of_revisits(spark, tmp_path):
    _, rows = written(spark, str(tmp_path / "w"), pages(spark), min_bytes=4)
    assert {r.page_id for r in rows if r.record_type == "revisit"} == {4, 7, None}


def test_same_bytes_however_partitioned(spark, tmp_path):
    found = []
    for name, df in (("a", pages(spark).coalesce(1)), ("b", pages(spark).orderBy(F.rand(1)).repartition(6))):
        manifest, _ = written(spark, str(tmp_path / name), df, file_bytes=600)
        files = tmp_path / name / "archives"
        found.append({f: (files / f).read_bytes() for f in os.listdir(files)})
        for r in manifest.collect():
            assert hashlib.sha256(found[-1][r.file]).hexdigest() == r.sha256 and len(found[-1][r.file]) == r.compressed_bytes
        assert json.loads((tmp_path / name / "MANIFEST.json").read_text())["records"] == len(PAGES)
    assert found[0] == found[1] and len(found[0]) > 4
    first = gzip.decompress(found[0]["pages-000000-0000.warc.gz"])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_written_again_over_itself(spark, tmp_path):
    """A second attempt, as after a lost executor, leaves the same files."""
    folder = str(tmp_path / "w")
    _, before = written(spark, folder, pages(spark))
    _, after = written(spark, folder, pages(spark))
    assert sorted(map(str, before)) == sorted(map(str, after))


def test_no_pages(spark, tmp_path):
    _, rows = written(spark, str(tmp_path / "w"), pages(spark).limit(0))
    assert rows == []
