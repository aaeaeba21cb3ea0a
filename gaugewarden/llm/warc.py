"""WARC archives written in deterministic shards, and read back.

Pages are dealt to shards of consecutive page ids and sorted, so the same rows
give the same files byte for byte, however Spark has split them. Every task
rolls over to a new file once the compressed size reaches the limit, writes
under temporary names and renames; a shard counts once its manifest is there.
"""

import base64
import gzip
import hashlib
import json
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage_table
from .files import committed, file_system, write_bytes
from .ranges import in_shards, shard_starts

#: Fixed capture time, as the pages have none and archives must not depend on the clock.
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, records long, compressed_bytes long, sha256 string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: object) -> str:
    """A name-based identifier: the same record has the same one in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join([kind, *map(str, parts)]))}>"


def _member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=6, mtime=0)


def _header(kind: str, rid: str, extra: dict[str, object], block: bytes) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": CAPTURED, **extra,
              "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _one_line(value: str | None) -> str:
    return "".join(" " if c < " " or c == "\x7f" else c for c in value or "")


def page_record(page_id: str | None, url: str | None, payload: bytes, digest: str, nth: int,
                original: tuple[str | None, str | None] | None) -> bytes:
    """A response, or a revisit if ``original`` names id and address of the page with the response; ``nth`` counts repeated rows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    extra: dict[str, object] = {"WARC-Target-URI": _one_line(url) or "about:blank", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
                                "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        extra["X-Page-ID"] = page_id
    if original is None:
        return _header("response", record_id("response", page_id, url, digest, nth), extra, http + payload)
    extra |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id("response", *original, digest, 0)}
    if original[0] is not None:
        extra["X-Refers-To-Page-ID"] = original[0]
    return _header("revisit", record_id("revisit", page_id, url, digest, nth), extra, http)


def _with_originals(pages: DataFrame, key: str, html: str, url: str, min_bytes: int) -> DataFrame:
    """Adds to each page the first page of its payload. Only digests are grouped; single payloads drop out first."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    page = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    counted = page.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    counted = stage_table(counted, "repeated-payloads")
    return page.join(counted, "digest", "left")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", html: str = "html", url: str = "url", min_bytes: int = 0,
                   file_bytes: int = 64_000_000, rows_per_shard: int = 1_000, max_shards: int = 10_000) -> DataFrame:
    """Write ``pages`` below ``folder``; return the manifest, one row per file, staged and thus done.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest id (then address; null ids last) is a response and the others
    are revisits of it; of rows that repeat both, one is the response. A null
    html is an empty payload. Further columns are ignored.
    """
    starts = shard_starts(pages, key, rows_per_shard, max_shards)
    rows = in_shards(_with_originals(pages, key, html, url, min_bytes), "page_id", starts, "url", "digest").select(
        "shard", F.col("page_id").cast("string"), "url", "payload", "digest", F.col("first").isNotNull().alias("repeated"),
        F.col("first.page_id").cast("string").alias("first_id"), F.col("first.url").alias("first_url"))

    def write(batches):
        shard = _Shard(folder, file_bytes)
        for batch in batches:
            for r in batch.itertuples(index=False):
                if shard.number is not None and r.shard != shard.number:
                    yield shard.close()
                shard.add(r)
        if shard.number is not None:
            yield shard.close()

    manifest = stage_table(rows.mapInPandas(write, MANIFEST), "warc-manifest")
    totals = manifest.agg(F.count("*"), F.sum("records"), F.sum("compressed_bytes")).first()
    write_bytes(f"{folder}/MANIFEST.json", json.dumps({"files": totals[0], "records": totals[1] or 0, "bytes": totals[2] or 0,
                                                       "shards": len(starts) + 1}).encode())
    return manifest


class _Shard:
    """Writes the pages of one shard after another into files of limited compressed size."""

    def __init__(self, folder: str, file_bytes: int):
        self.folder, self.file_bytes = folder, file_bytes
        self.number, self.files = None, []
        self.row, self.nth = None, 0
        self._context = self.out = None

    def add(self, r) -> None:
        self.number = int(r.shard)
        row = (r.page_id, r.url, r.digest)
        self.nth, self.row = (self.nth + 1 if row == self.row else 0), row  # rows that repeat all three are neighbours
        original = (r.first_id, r.first_url) if r.repeated else None
        if original == row[:2] and self.nth == 0:
            original = None
        if self.out is None:
            self._open()
        data = _member(page_record(r.page_id, r.url, r.payload, r.digest, self.nth, original))
        self.out.write(data)
        self.hash.update(data)
        self.size, self.records = self.size + len(data), self.records + 1
        if self.size >= self.file_bytes:
            self._roll()

    def _open(self) -> None:
        self.name = f"pages-{self.number:06d}-{len(self.files):04d}.warc.gz"
        self._context = committed(f"{self.folder}/archives/{self.name}")
        self.out, self.size, self.records, self.hash = self._context.__enter__(), 0, 0, hashlib.sha256()
        info = b"software: page archive writer\r\nformat: WARC File Format 1.1\r\n"
        data = _member(_header("warcinfo", record_id("warcinfo", self.name), {
            "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, info))
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def _roll(self) -> None:
        self._context.__exit__(None, None, None)
        self.files.append((self.number, self.name, self.records, self.size, self.hash.hexdigest()))
        self.out = None

    def close(self) -> pd.DataFrame:
        if self.out is not None:
            self._roll()
        table = pd.DataFrame(self.files, columns=["shard", "file", "records", "compressed_bytes", "sha256"])
        write_bytes(f"{self.folder}/manifests/shard-{self.number:06d}.json", table.to_json(orient="records").encode())
        self.number, self.files = None, []
        return table


def members(stream, chunk: int = 1 << 20):
    """Contents of the gzip members of a stream, one at a time."""
    rest = b""
    while rest or (rest := stream.read(chunk)):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("a gzip member ends early")
            parts.append(unzip.decompress(rest))
            rest = unzip.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its header")
    return fields, block


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per response or revisit in the files of ``manifest``, with checked lengths and digests."""
    schema = """page_id long, url string, record_type string, record_id string, refers_to_record string, refers_to long,
        payload_digest string, payload_bytes long, payload binary"""

    def read(batches):
        for batch in batches:
            for file in batch["file"]:
                system, name = file_system(f"{folder}/archives/{file}")
                with system.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for member in members(stream):
                        fields, block = parse_record(member)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                            raise ValueError(f"a block digest in {file} does not match")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload), sha1_base32(payload)) != (length, digest):
                            raise ValueError(f"a payload in {file} does not match its header")
                        rows.append((fields.get("X-Page-ID"), fields["WARC-Target-URI"], fields["WARC-Type"], fields["WARC-Record-ID"],
                                     fields.get("WARC-Refers-To"), fields.get("X-Refers-To-Page-ID"), digest, length,
                                     payload if fields["WARC-Type"] == "response" else None))
                        size += len(payload)
                        if size > 8_000_000:
                            yield _table(rows)
                            rows, size = [], 0
                    yield _table(rows)

    def _table(rows):
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.replace("\n", " ").split(", ")])
        for c in ("page_id", "refers_to"):
            out[c] = pd.array([None if v is None else int(v) for v in out[c]], "Int64")
        return out

    return manifest.select("file").repartition(max(1, min(manifest.count(), 10_000))).mapInPandas(read, schema)
