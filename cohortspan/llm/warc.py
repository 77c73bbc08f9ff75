"""WARC archives: writing with revisits, an index of byte ranges, and reading selected records by that index.

``write`` puts a record per page into archives of gzip members (one member per record) and returns the index: file,
offset, length, URL, digest and type of each record. An archive belongs to one attempt of one task and has a name of
its own; only archives that the stored index names count, so a lost executor or a second attempt does no harm. ``read``
sorts the selected index rows by file and offset, joins ranges that nearly touch into one read, and parses the records.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest identifier is a response,
the others revisit it. Equality is by SHA-1, SHA-256 and length together. Groups are summed up before they are shuffled,
and only digests are grouped.

Defined results: a null payload counts as empty, a null URL as an empty one; a null identifier sorts before every other
one and stays null; rows that share an identifier each get a record, judged by their own payload: a response if no row with
that payload has a larger identifier; an empty table gives an empty index; other columns of the input are not read. Paths are
opened with pyarrow's file systems, so the folder must be one that every executor reaches (``spark.checkpoint.dir`` by default).
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import NO_ID, given_id, materialize, slices
from cohortspan.session import scratch_path

REVISIT_BYTES = 1000
#: An archive is closed at this size; ranges at most GAP bytes apart are read together, up to READ_BYTES at once.
ARCHIVE_BYTES, GAP, READ_BYTES = 1 << 30, 64 << 10, 8 << 20
INDEX = (
    "id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, "
    "record_type string, refers_to long"
)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would use, so that archives and index lie in one store."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(made).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _open_folder(path: str):
    return fs.FileSystem.from_uri(path)


def _record(kind: str, page: int, place: str, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A record; its name holds page, digest and place, so pages that share an identifier differ, and equal rows, too."""
    digest = hashlib.sha1(payload).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}:{digest}:{place}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    body = payload
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
        body = b""
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(name: str) -> int:
    """The page of a record's name."""
    return int(name.split(":")[2])


def _clean(url: str) -> str:
    """A URL on one header line."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = REVISIT_BYTES) -> DataFrame:
    """``_id``, ``_url``, ``_payload`` and ``_refers`` (identifier of the response for revisits, else null)."""
    rows = pages.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("_url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary")).alias("_payload"),
    )
    key = [F.sha1("_payload").alias("_sha1"), F.sha2("_payload", 256).alias("_sha2"), F.octet_length("_payload").alias("_n")]
    keyed = rows.select("_id", *key).filter(F.col("_n") >= least)
    groups = keyed.groupBy("_sha1", "_sha2", "_n").agg(F.max("_id").alias("_keep"), F.min("_id").alias("_least")).filter("_keep > _least").drop("_least")
    refers = keyed.join(groups, ["_sha1", "_sha2", "_n"]).filter(F.col("_id") < F.col("_keep")).distinct()
    # joined by identifier and payload: groups of copies do not skew it, and rows that share an identifier stay apart
    return rows.withColumns({"_sha1": key[0], "_sha2": key[1], "_n": key[2]}).join(refers, ["_id", "_sha1", "_sha2", "_n"], "left").select(
        "_id", "_url", "_payload", F.col("_keep").alias("_refers"))


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives and return their index (columns ``INDEX``), stored beside them."""
    folder = _qualified(pages.sparkSession, folder or scratch_path(pages.sparkSession, "warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open_folder(folder)
        out, at, name = None, 0, ""
        for batch in slices(batches, "_payload"):
            rows = []
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                kind = "response" if refers is None else "revisit"
                data = gzip.compress(_record(kind, page, f"{name[5:37]}-{at}", _clean(url), payload, refers), 6, mtime=0)
                out.write(data)
                rows.append((page, url, name, at, len(data), hashlib.sha1(payload).hexdigest(), len(payload), kind, refers))
                at += len(data)
                if at >= archive_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), INDEX_TYPES)], names=[c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()

    return materialize(revisits(pages, id_col, url_col, payload_col).mapInArrow(run, INDEX), "warc-index").withColumn("folder", F.lit(folder))


INDEX_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def read(index: DataFrame, parts: int | None = None, gap: int = GAP, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records of the index rows: ``id``, ``url``, ``record_type``, ``refers_to``, ``payload_digest`` and
    ``payload_bytes`` as the record's header states them, and ``payload`` (empty for a revisit).

    Ranges lie in order inside a partition; a file's ranges are cut into stretches, so one large archive is read by
    many tasks.
    """
    parts = parts or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = index.select("folder", "file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / (4 * read_bytes)))
    wanted = wanted.repartition(parts, "folder", "file", "stretch").sortWithinPartitions("folder", "file", "offset").drop("stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[str, str, int, int]] = []

        def records(rows):
            store, top = _open_folder(rows[0][0])
            first, last = rows[0][2], max(r[2] + r[3] for r in rows)
            with store.open_input_file(f"{top}/{rows[0][1]}") as f:
                data = f.read_at(last - first, first)
            found = []
            for _, _, offset, length in rows:
                fields, payload = _parse(gzip.decompress(data[offset - first : offset - first + length]))
                kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"damaged record in {rows[0][1]} at {offset}")
                found.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, refers and _page(refers), digest, size, payload))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), RECORD_TYPES)], names=RECORD_NAMES)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and (row[:2] != group[-1][:2] or row[2] > group[-1][2] + group[-1][3] + gap or row[2] + row[3] - group[0][2] > read_bytes):
                    yield records(group)
                    group = []
                group.append(row)
        if group:
            yield records(group)

    out = wanted.mapInArrow(run, "id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
    return out.withColumn("id", given_id("id")).withColumn("refers_to", given_id("refers_to"))


RECORD_NAMES = ["id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
