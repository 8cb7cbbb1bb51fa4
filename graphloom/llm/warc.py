"""WARC archives, written and read back by an index.

Writing gives an index row (file, offset, length, URL, digest) for each record. Reading starts from index rows: those of one
file are sorted by offset and near ones become one byte-range read. Every record is a gzip member of its own. Files are
opened through pyarrow's file systems, so the folder can be any store that they reach.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.storage import delete_at_exit

from .common import new_folder, sized, table

INDEX = "page_id long, row_id long, url string, record_type string, digest string, path string, offset long, length long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:record:{}:{}>"


def record(page_id: int | None, row_id: int, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record, compressed: a response, or, if refers_to is another record's id, a revisit, which keeps the HTTP head
    with the payload's length but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_ID.format('' if page_id is None else page_id, row_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """A record's fields: page_id, row_id, url, record_type, refers_to (a page_id), payload_bytes, payload_digest, payload."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])

    def ids(field: str) -> list[int | None]:
        return [int(x) if x else None for x in fields[field].strip("<>").split(":")[2:]]

    page_id, row_id = ids("WARC-Record-ID")
    out = {"page_id": page_id, "row_id": row_id, "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": None, "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": None}
    if fields["WARC-Type"] == "revisit":
        out["refers_to"] = ids("WARC-Refers-To")[0]
    else:
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
        out["payload"] = payload
    return out


def _writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.itertuples(index=False):
                    if out is None or at >= file_bytes:
                        if out:
                            out.close()
                        # A task that runs again writes other files; only the files of the task that ends well are in the index.
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        path, out = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}", compression=None)
                    page_id = None if pd.isna(r.page_id) else int(r.page_id)
                    refers = None if pd.isna(r.refers_row) else _ID.format("" if pd.isna(r.refers_to) else int(r.refers_to), int(r.refers_row))
                    member = record(page_id, r.row_id, r.url, (r.html or "").encode(), r.digest, refers, date)
                    out.write(member)
                    rows.append((page_id, r.row_id, r.url, "revisit" if refers else "response", r.digest, path, at, len(member)))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["page_id", "row_id", "url", "record_type", "digest", "path", "offset", "length"]).astype({"page_id": "Int64"})
        finally:
            if out:
                out.close()

    return run


def write(pages: DataFrame, folder: str | None = None, *, least: int = 100, file_bytes: int = 128 << 20, hot_share: float = 0.001) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the index, written to the shared folder.

    The payload is html in UTF-8; null is empty. Of records with equal payloads of at least `least` bytes the one with the
    smallest page_id (null last; of repeated ids any one) is a response, the others revisit it; smaller ones are responses.
    An empty table gives an empty index; columns other than the three are not read. Without a folder the archives go to the
    shared one and are deleted when the driver's JVM ends.
    """
    spark = pages.sparkSession
    own = folder is None
    store, root = fs.FileSystem.from_uri(folder := new_folder(spark, "warc") if own else folder)
    store.create_dir(root, recursive=True)
    if own:
        delete_at_exit(spark, folder)
    html = F.col("html").cast("string")
    data = F.coalesce(html, F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(data, 256).alias("digest"), F.octet_length(data).alias("size"))
    rows = table(rows, "op4-rows")
    least_of = F.min(F.struct(F.col("page_id").isNull(), "page_id", "row_id")).alias("low")
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(least_of, F.count("*").alias("n")).filter("n > 1").select("digest", "n", F.col("low.page_id").alias("refers_to"), F.col("low.row_id").alias("refers_row"))
    # A payload that a large part of all rows share is looked up by a broadcast: there can be at most 1 / hot_share of them.
    groups, keys = table(groups, "op4-groups"), rows.filter(F.col("size") >= least).select("row_id", "digest")
    often = F.broadcast(groups.filter(F.col("n") > hot_share * rows.count()).drop("n"))
    rest = keys.join(often, "digest", "left_anti").join(groups.drop("n"), "digest")
    marked = keys.join(often, "digest").unionByName(rest).filter("row_id != refers_row").select("row_id", "refers_to", "refers_row")
    planned = rows.join(sized(marked, "op4-revisits"), "row_id", "left").select("row_id", "page_id", "url", "html", "digest", "refers_to", "refers_row")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return table(planned.mapInPandas(_writer(folder, date, file_bytes), INDEX), "op4-index")


def _reader(gap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, records in zip(batch["path"], batch["records"], strict=True):
                store, file = fs.FileSystem.from_uri(path)
                spans: list[list[tuple[int, int]]] = []
                for at, n in sorted((r["offset"], r["length"]) for r in records):
                    if spans and at - sum(spans[-1][-1]) <= gap:
                        spans[-1].append((at, n))
                    else:
                        spans.append([(at, n)])
                with store.open_input_file(file) as data:
                    for span in spans:
                        start = span[0][0]
                        read = data.read_at(sum(span[-1]) - start, start)
                        yield pd.DataFrame([parse(read[at - start : at - start + n]) for at, n in span]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


#: Tasks that read an archive.
MOST_TASKS = 50_000


def tasks_for(total: int, range_bytes: int) -> tuple[int, int]:
    """The size of a range and the number of tasks for reading `total` bytes."""
    size = max(range_bytes, -(-total // MOST_TASKS))
    return size, max(1, -(-total // size))


def read(index: DataFrame, *, range_bytes: int = 1 << 20, gap: int = 1 << 16) -> DataFrame:
    """The records that the index rows name: page_id, row_id, url, record_type, refers_to, payload_bytes, payload_digest and
    payload (null for revisits). A task reads about range_bytes of the records named, or more where that would take more than MOST_TASKS tasks; records up to
    `gap` bytes apart share a read."""
    size, tasks = tasks_for(index.agg(F.sum("length").alias("n")).first()["n"] or 0, range_bytes)
    ranges = index.groupBy("path", F.expr(f"offset div {size}").alias("range")).agg(F.collect_list(F.struct("offset", "length")).alias("records"))
    # As many tasks as there is to read: by the rows of the index alone, which are short, Spark would plan too few.
    ranges = ranges.repartition(tasks, "path", "range")
    return ranges.select("path", "records").mapInPandas(_reader(gap), "page_id long, row_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, strlen(html) AS size, min(page_id) OVER (PARTITION BY html) AS low FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN size >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id <> low THEN low END AS refers_to
FROM g
"""
