"""Deterministic sharded WARC writer, and its reader.

Records are sorted by id, then by a hash of the payload, and cut into shards where the payload bytes before a record pass
a multiple of ``shard_bytes``; so shards are even however ids lie, and an id that a third of all records share is cut too.
The sums come from a table of ids and sizes alone. A shard is written as gzip members in order; a file is rolled when its
compressed size passes ``roll_bytes``. All headers and digests are made anew from the payload. A task writes under a
temporary name that no other attempt uses and renames when the file is whole; only files that the manifest lists count,
so a task that is run again, or twice at once, changes nothing, and what is left of broken attempts is removed when the
manifest is there. Neither the number of partitions nor their order shows in the files.

Of records with equal payloads of at least ``min_revisit_bytes``, that with the least id (then url) is the response and
the others revisit it. Equal payloads are found by aggregating digests, which are written before they are joined: a
join of two plain shuffles can be split, so a payload that a third of all pages share costs no task more than its share.

Nulls: a null payload or url is empty; rows with a null id come before all others, and no record revisits them (they may
revisit others). Of repeated rows the first is the response and the others revisit it. Control characters of a url are
percent-encoded in its header, and the url itself is kept beside it. An empty table gives no files and an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.common import byte_cuts, cut_number, new_path, read, saved

_DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string"


class Store:
    """Files below a folder that Spark names by a path or URI."""

    def __init__(self, folder: str):
        self.local = folder.startswith("/") or folder.startswith("file:")
        if self.local:
            self.root = folder.removeprefix("file://").removeprefix("file:")
            os.makedirs(self.root, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)
            self.fs.create_dir(self.root, recursive=True)

    def create(self, name: str):
        return open(f"{self.root}/{name}", "wb") if self.local else self.fs.open_output_stream(f"{self.root}/{name}")

    def open(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.local else self.fs.open_input_stream(f"{self.root}/{name}")

    def commit(self, temporary: str, name: str) -> None:
        if self.local:
            os.replace(f"{self.root}/{temporary}", f"{self.root}/{name}")
        else:
            self.fs.move(f"{self.root}/{temporary}", f"{self.root}/{name}")


    def sweep(self) -> None:
        """Removes the temporary files of attempts that ended before their rename."""
        if self.local:
            names = [n for n in os.listdir(self.root) if n.endswith(".tmp")]
        else:
            from pyarrow import fs

            names = [f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.root)) if f.base_name.endswith(".tmp")]
        for n in names:
            os.remove(f"{self.root}/{n}") if self.local else self.fs.delete_file(f"{self.root}/{n}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key} {url}')}>"


def _uri(name: str, url: str) -> list[str]:
    """A url as a header; where it has characters that a header cannot hold, the url itself follows in base64."""
    if not _CONTROL.search(url):
        return [f"{name}: {url}"]
    shown = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    return [f"{name}: {shown}", f"X-{name}-Base64: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}"]


def record(key: int | None, url: str, payload: bytes | None, digest: str, size: int, refers: tuple[int, str] | None) -> bytes:
    """One WARC/1.1 record; refers: id and url of the response that a revisit refers to (its payload is not kept)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers else http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(key, url)}",
        f"WARC-Date: {_DATE}",
        *_uri("WARC-Target-URI", url),
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(*refers)}",
            *_uri("WARC-Refers-To-Target-URI", refers[1]),
            f"WARC-Refers-To-Date: {_DATE}",
            f"X-Refers-To-Key: {refers[0]}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Payload-Length: {size}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Shard:
    """The open file of one shard, rolled by size."""

    def __init__(self, store: Store, shard: int, roll_bytes: int, level: int):
        self.store, self.shard, self.roll, self.level, self.number, self.file, self.done = store, shard, roll_bytes, level, 0, None, []

    def add(self, data: bytes) -> None:
        if self.file is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f".{self.name}.{uuid.uuid4().hex}.tmp"
            self.file, self.sha, self.bytes, self.records = self.store.create(self.temporary), hashlib.sha256(), 0, 0
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.file.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.file is None:
            return
        self.file.close()
        self.store.commit(self.temporary, self.name)
        self.done.append((self.shard, self.name, self.records, self.bytes, self.sha.hexdigest()))
        self.file, self.number = None, self.number + 1


def _mark() -> Column:
    """The first 15 digits of the payload's hash as a number: the order of records of one id."""
    return F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")


def write(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0,
    shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, level: int = 6,
) -> DataFrame:
    """Writes pages as WARC files below folder and returns the manifest, which is itself written to folder/manifest."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"),
        F.octet_length(body).cast("long").alias("size"), F.sha1(body).alias("sha"),
    )
    ids = saved(rows.select("key", "url", "sha", "size"), "warc-ids")
    cuts = byte_cuts(ids.select("key", _mark().alias("mark"), "size"), shard_bytes)
    first = F.min(F.struct("key", "url"))
    firsts = ids.where((F.col("size") >= min_revisit_bytes) & F.col("key").isNotNull()).groupBy("sha", "size").agg(first.alias("first"))
    refers = ids.distinct().join(saved(firsts, "warc-firsts"), ["sha", "size"])
    none = F.lit(None)
    refers = refers.select(
        cut_number(cuts, F.col("key"), _mark()).alias("shard"), "key", "url", F.lit(0).alias("what"), "sha", "size", none.cast("binary").alias("body"),
        F.col("first.key").alias("r_key"), F.col("first.url").alias("r_url"),
    )
    bodies = rows.select(cut_number(cuts, F.col("key"), _mark()).alias("shard"), "key", "url", F.lit(1).alias("what"), "sha", "size", "body", none.cast("long").alias("r_key"), none.cast("string").alias("r_url"))
    ready = refers.unionByName(bodies).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "sha", "url", "what")

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, at, refer, out = Store(folder), None, None, []
        for whole in batches:
            for batch in (whole.slice(i, 16) for i in range(0, whole.num_rows, 16)):
                for r in batch.to_pylist():
                    own = r["key"], r["url"], r["sha"]
                    if r["what"] == 0:
                        # the first of repeated rows is the response itself, if they are the least
                        refer, again = (own, (r["r_key"], r["r_url"])), own[:2] != (r["r_key"], r["r_url"])
                        continue
                    if at is None or at.shard != r["shard"]:
                        if at:
                            at.close()
                            out += at.done
                        at = _Shard(store, r["shard"], roll_bytes, level)
                    known = refer is not None and refer[0] == own
                    digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                    at.add(record(r["key"], r["url"], r["body"], digest, r["size"], refer[1] if known and again else None))
                    again = True
        if at:
            at.close()
            out += at.done
        cols = list(zip(*out)) or [()] * 5
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["shard", "file", "records", "bytes", "sha256"])

    manifest = ready.mapInArrow(run, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    Store(folder).sweep()
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    rest, unpacker, out = b"", None, []
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            if unpacker is not None:
                raise ValueError("the archive ends within a record")
            return
        if unpacker is None:
            unpacker, out = zlib.decompressobj(31), []
        out.append(unpacker.decompress(data))
        if unpacker.eof:
            rest, unpacker = unpacker.unused_data, None
            yield b"".join(out)


def parse(data: bytes) -> dict:
    """Headers and payload of one record; digests are checked against the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    own, url = fields["WARC-Type"] == "response", fields["WARC-Target-URI"]
    if "X-WARC-Target-URI-Base64" in fields:
        url = base64.b64decode(fields["X-WARC-Target-URI-Base64"]).decode("utf-8", "surrogatepass")
    payload = block.partition(b"\r\n\r\n")[2] if own else None
    digest = base32_sha1(payload) if own else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if own and f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Key"), "url": url, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Key"),
        "payload_bytes": len(payload) if own else number("X-Payload-Length"), "payload_digest": digest, "payload": payload,
    }


def read_back(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of the files that a manifest lists; each file is one task's stream and is never held whole."""
    schema = RECORDS if payload else RECORDS.replace("payload binary, ", "")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[x.split(" ")[1]] for x in schema.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for name, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, seen = [], 0, hashlib.sha256()
                with store.open(name) as stream:
                    for data in members(_Hashed(stream, seen)):
                        rows.append(parse(data) | {"file": name})
                        size += len(data) if payload else 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names)
                            rows, size = [], 0
                if seen.hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest entry")
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names)

    files = manifest.select("file", "sha256")
    tasks = max(1, min(files.count(), 10_000))
    return files.repartition(tasks, F.xxhash64("file")).mapInArrow(run, schema)


class _Hashed(io.RawIOBase):
    def __init__(self, stream, sha):
        self.stream, self.sha = stream, sha

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(n)
        self.sha.update(data)
        return data


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = write(read(spark, sf_dir, "pages"), folder)
    return read_back(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
