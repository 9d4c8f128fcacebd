"""WARC records in ZIP packages: written, then read by byte ranges without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the ZIP format (APPNOTE 6.3): signatures and layouts.
EOCD, EOCD_SIG = struct.Struct("<4s4H2LH"), b"PK\x05\x06"
EOCD64, EOCD64_SIG = struct.Struct("<4sQ2H2L4Q"), b"PK\x06\x06"
LOCATOR, LOCATOR_SIG = struct.Struct("<4sLQL"), b"PK\x06\x07"
ENTRY, ENTRY_SIG = struct.Struct("<4s6H3L5H2L"), b"PK\x01\x02"
LOCAL, LOCAL_SIG = struct.Struct("<4s5H3L2H"), b"PK\x03\x04"


class ZipDirectory:
    """Members of a ZIP file, found through its end record, ZIP64 records and central directory alone.

    ``file`` needs ``seek``, ``tell`` and ``read``; no member is extracted. Raises ``ValueError`` for what isn't a ZIP file.
    """

    def __init__(self, file: BinaryIO):
        self.file = file
        length = file.seek(0, 2) or file.tell()
        tail_at = max(0, length - EOCD.size - 65535)
        tail = self._range(tail_at, length - tail_at)
        at = tail.rfind(EOCD_SIG)
        while at >= 0 and at + EOCD.size + int.from_bytes(tail[at + 20 : at + 22], "little") > len(tail):
            at = tail.rfind(EOCD_SIG, 0, at)
        if at < 0 or len(tail) < at + EOCD.size:
            raise ValueError("no end of central directory")
        _, _, _, _, entries, size, start, _ = EOCD.unpack_from(tail, at)
        place = tail_at + at - LOCATOR.size
        if place >= 0 and (head := self._range(place, LOCATOR.size))[:4] == LOCATOR_SIG:
            record = self._range(LOCATOR.unpack(head)[2], EOCD64.size)
            if record[:4] != EOCD64_SIG:
                raise ValueError("bad ZIP64 end of central directory")
            entries, size, start = EOCD64.unpack(record)[7:10]
        self.members = dict(self._entries(self._range(start, size), entries))

    def _range(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    @staticmethod
    def _entries(raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(count):
            e = ENTRY.unpack_from(raw, at)
            if e[0] != ENTRY_SIG:
                raise ValueError("bad central directory entry")
            flags, method, packed, whole, name_n, extra_n, note_n, offset = e[3], e[4], e[8], e[9], e[10], e[11], e[12], e[16]
            at += ENTRY.size
            name = raw[at : at + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + name_n : at + name_n + extra_n]
            at += name_n + extra_n + note_n
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<2H", extra)
                if kind == 1:  # only the fields that are full in the entry follow, in this order
                    wide = io.BytesIO(extra[4 : 4 + n])
                    whole, packed, offset = (int.from_bytes(wide.read(8), "little") if x == 0xFFFFFFFF else x for x in (whole, packed, offset))
                extra = extra[4 + n :]
            yield name, (method, offset, packed)

    def data_range(self, name: str) -> tuple[int, int]:
        """Start and length of a stored member's bytes in the file."""
        method, offset, packed = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed, not stored")
        head = LOCAL.unpack(self._range(offset, LOCAL.size))
        if head[0] != LOCAL_SIG:
            raise ValueError("bad local header")
        return offset + LOCAL.size + head[9] + head[10], packed

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        at, most = self.data_range(name)
        return self._range(at + start, min(most - start, most if length is None else length))


def _file(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def record(page_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record, its own gzip member. A revisit has HTTP headers only; Content-Length there is the full payload's."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of one gzipped record; checks the digest of a response."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    names = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(names["Content-Length"])].partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(names["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if names["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {names['WARC-Record-ID']} doesn't match its digest")
    own = lambda k: names[k][len("<urn:page:") : -1] if k in names else None
    return {"page_id": own("WARC-Record-ID"), "url": names["WARC-Target-URI"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": names["WARC-Type"], "refers_to": own("WARC-Refers-To")}


def _clean(url: str | None) -> str:
    return " ".join((url or "").split())


class _Package:
    """A package that is being written: records go to its archive as they come, the index follows at the end."""

    def __init__(self, folder: str):
        files, top = _file(folder)
        files.create_dir(top, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.wacz"
        self.path, self.lines, self.at = f"{folder}/{name}", [], 0
        self.out = files.open_output_stream(f"{top}/{name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, url: str, raw: bytes) -> None:
        self.data.write(raw)
        self.lines.append(f"{url} 20000101000000 " + json.dumps({"offset": self.at, "length": len(raw)}))
        self.at += len(raw)

    def close(self) -> pd.DataFrame:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.out.close()
        return pd.DataFrame({"path": [self.path], "records": [len(self.lines)]})


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, most_bytes: int = 512 << 20, most_records: int = 100_000) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as ZIP packages into ``folder``; returns their ``(path, records)``.

    Null html is an empty payload; null urls are empty and white space in urls becomes one space. Of payloads of at least
    ``least_bytes`` bytes with the same SHA-1 the record with the largest page_id (null counts as smallest) is a response, the others are
    revisits that refer to it; wholly equal page_ids are all responses. Null page_ids are kept, written as an empty id.

    Winners are aggregated with map-side combining and only those of repeated payloads are written out and joined, so a payload that
    many pages share is split by the adaptive skew join. Each task streams its records into packages, stored and ZIP64-capable, a new one
    once a package has ``most_bytes`` of records or ``most_records``, which bounds the index that a reader loads; names are new for each attempt,
    and only the paths of attempts that ended come back. An empty table writes nothing.
    """
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    large = F.octet_length("html") >= least_bytes
    winners = p.where(large).groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n")
    winners = written(winners, "winners")
    j = p.join(winners, "sha1", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    j = j.select("page_id", "url", "html", refers.alias("refers_to"))

    own = lambda x: "" if pd.isna(x) else str(int(x))

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package = None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                package = package or _Package(folder)
                package.add(_clean(url), record(own(page_id), _clean(url), html.encode(), None if pd.isna(refers_to) else own(refers_to)))
                if package.at >= most_bytes or len(package.lines) >= most_records:
                    yield package.close()
                    package = None
        if package is not None:
            yield package.close()

    return j.mapInPandas(store, "path string, records long")


def read_archives(paths: DataFrame, batch: int = 200, span: int = 4 << 20) -> DataFrame:
    """Records of the packages named in ``paths(path, ...)``: their headers, payload and digest, read by ranges of at most about ``span`` bytes.

    A record longer than that is a range of its own. Empty ids come back as null; no paths give no records; a file that isn't a package or a
    payload that doesn't match its digest is an error, not a lost row.
    """
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path in frame["path"]:
                files, at = _file(path)
                with files.open_input_file(at) as f:
                    package = ZipDirectory(f)
                    start, _ = package.data_range(DATA)
                    spots = [json.loads(x[x.rindex("{") :]) for x in package.read(INDEX).decode().split("\n") if x]
                    k = 0
                    while k < len(spots):
                        stop = k + 1
                        while stop < min(len(spots), k + batch) and spots[stop]["offset"] + spots[stop]["length"] - spots[k]["offset"] <= span:
                            stop += 1
                        f.seek(start + spots[k]["offset"])
                        raw = f.read(spots[stop - 1]["offset"] + spots[stop - 1]["length"] - spots[k]["offset"])
                        rows = [parse_record(raw[(a := s["offset"] - spots[k]["offset"]) : a + s["length"]]) for s in spots[k:stop]]
                        out = pd.DataFrame(rows, columns=columns)
                        for c in ("page_id", "refers_to"):
                            out[c] = pd.array([int(x) if x else None for x in out[c]], "Int64")
                        yield out
                        k = stop

    return paths.select("path").mapInPandas(load, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages to packages, reads them back and returns what ``op4`` asks for."""
    spark = pages.sparkSession
    paths = written(write_archives(pages, folder or new_path(spark, "warc")), "packages")
    paths = paths.repartition(max(1, spark.sparkContext.defaultParallelism * 2), F.xxhash64("path"))
    return read_archives(paths).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
