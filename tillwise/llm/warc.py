"""WARC archives written and read back with Spark's text files, and verified as chains of records.

Writing: one uncompressed record per page; pages whose payload an earlier page has become revisit records.
Reading: a record may start wherever the version line stands, but payloads may hold that line too. Tasks cut the
files at it and emit, for each cut that carries a plausible header, its offset and the offset where its record says the
next one starts. Pointer jumping from the start of each file then doubles the reach of the known records round by
round; candidates that no chain reaches are text inside payloads and are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillwise.session import shared_folder, staged

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of a file per cell when pieces inside a payload look for their record.
CELL = 1 << 20


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hex digits, without padding: every five hex digits make four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(8):
        value = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(letters), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def write_archive(pages: DataFrame, path: str, minimum: int = 0) -> None:
    """Write one record per row of (page_id, url, html) as WARC files under ``path``.

    Of records with equal payloads of at least ``minimum`` bytes the one with the smallest page_id is a response and the others
    revisit it; smaller payloads are all responses. A null html is an empty payload. Line breaks in a url become spaces. Rows
    without page_id are numbered by nothing and left out; of repeated page_ids with one payload, each row is written.

    Only (page_id, digest) pairs are grouped, combined before the shuffle; the pages themselves are not shuffled
    unless the table of revisits is too large for Spark to broadcast.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html")
    )
    marked = rows.select("page_id", F.octet_length("html").alias("size"), F.sha2("html", 256).alias("digest"))
    firsts = (
        marked.where(F.col("size") >= minimum)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    # A page_id that occurs twice with different payloads keeps its digest beside it.
    revisits = marked.join(firsts, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct()
    revisits = staged(revisits, "revisits")
    joined = rows.withColumn("digest", F.sha2("html", 256)).join(revisits, ["page_id", "digest"], "left")
    size = F.octet_length("html")
    revisit = F.col("first").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1("html")))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first"), F.lit(">"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                # An extension field: a revisit record has no block of its own to measure.
                line("X-Payload-Length", size.cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    joined.select(record.alias("value")).write.option("lineSep", END).text(path)


HEADER = re.compile(rb"((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
CANDIDATE = (
    "file string, block long, place long, inside long, size long, successor long, page_id long, record_type string, "
    "refers_to long, digest string, length long, header long, content long, found string"
)


def header_of(piece: bytes) -> dict[str, str] | None:
    """Fields of the header that the piece starts with, if it has one that a record needs."""
    match = HEADER.match(piece)
    if match is None:
        return None
    fields = {}
    for row in match[1].split(b"\r\n")[:-1]:
        name, _, value = row.partition(b":")
        fields[name.strip().lower().decode("ascii")] = value.strip().decode("utf-8", "replace")
    needed = {"warc-type", "warc-record-id", "content-length"}
    if not needed <= set(fields) or not re.fullmatch(r"[0-9]{1,15}", fields["content-length"]):
        return None
    fields[""] = str(match.end())
    return fields


def urn(value: str | None) -> int | None:
    match = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", value or "")
    return int(match[1]) if match else None


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece: where it lies in its split, and, if it has a header, what its record claims.

    The text reader gives the pieces of one split in order; ``place`` numbers them, ``inside`` is their byte offset from
    the first piece of the split. A piece that holds its record whole is digested at once.
    """
    version = len(VERSION)
    names = [part.strip().split(" ")[0] for part in CANDIDATE.split(",")]
    types = [{"long": pa.int64(), "string": pa.string()}[part.strip().split(" ")[1]] for part in CANDIDATE.split(",")]
    split, place, inside = None, 0, 0
    for batch in batches:
        out = [[] for _ in names]
        for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            piece = value.as_buffer().to_pybytes() if value.is_valid else b""
            if split != (file, block):
                split, place, inside = (file, block), 0, 0
            fields = header_of(piece)
            row = [file, block, place, inside, len(piece), None, None, None, None, None, None, None, None, None]
            if fields is not None:
                header, content = int(fields[""]), int(fields["content-length"])
                claimed = fields.get("x-payload-length", fields["content-length"])
                length = int(claimed) if re.fullmatch(r"[0-9]{1,15}", claimed) else None
                payload = piece[header : header + content]
                digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:")
                whole = len(piece) >= header + content
                row[5:] = [
                    version + header + content + len(END), urn(fields["warc-record-id"]), fields["warc-type"],
                    urn(fields.get("warc-refers-to")), digest, length, header, content, sha1_base32(payload) if whole else None,
                ]
            for column, cell in zip(out, row):
                column.append(cell)
            place += 1
            inside += len(piece) + version
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every version line: text, file and the start of the split it was read in."""
    read = spark.read.option("lineSep", VERSION).text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def located(spark: SparkSession, path: str) -> DataFrame:
    """All pieces with ``offset``, the byte where their version line starts, written once."""
    rows = staged(pieces_of(spark, path).mapInArrow(_candidates, CANDIDATE), "pieces")
    splits = rows.groupBy("file", "block").agg(F.sum(F.col("size") + len(VERSION)).alias("bytes"))
    before = F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    splits = staged(splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("base")), "splits")
    # Each file begins with a version line, so the first piece is empty and the next one starts at 0.
    offset = F.col("base") + F.col("inside") - len(VERSION)
    return rows.join(splits, ["file", "block"]).withColumn("offset", offset).withColumn("successor", offset + F.col("successor"))


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the records on the chain from offset 0 of each file.

    Round by round every known record marks the one its jump leads to, and jumps double; after n rounds the first 2**n records
    of a file are known. Jumps past the end become null, so rounds grow with the logarithm of the records in a file.
    """
    starts = candidates.select("file", F.col("offset").alias("to"), F.lit(True).alias("valid"))
    first = candidates.select("file", "offset", F.col("successor").alias("to")).join(starts.hint("merge"), ["file", "to"], "left")
    jumps = staged(first.select("file", "offset", F.when(F.col("valid"), F.col("to")).alias("to")), "jumps")
    known = staged(jumps.where("offset = 0").select("file", "offset"), "known")
    while True:
        live = jumps.where("to is not null")
        if live.isEmpty():
            return known
        # Merge joins: these tables grow with the records, and compress too well for their file size to bound them.
        reached = known.join(live.hint("merge"), ["file", "offset"]).select("file", F.col("to").alias("offset"))
        known = staged(known.unionAll(reached).distinct(), "known")
        further = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("after"))
        jumps = staged(live.join(further.hint("merge"), ["file", "to"]).select("file", "offset", F.col("after").alias("to")), "jumps")


def _joined_payload(table: pa.Table) -> pa.Table:
    """Digest of one record whose payload holds version lines: its own piece and those inside it, in order."""
    order = sorted(range(table.num_rows), key=table.column("offset").to_pylist().__getitem__)
    version = VERSION.encode()
    pieces = [table.column("value")[i].as_buffer().to_pybytes() for i in order]
    header, content = table.column("header")[order[0]].as_py(), table.column("content")[order[0]].as_py()
    payload = version.join(pieces)[header : header + content]
    found = sha1_base32(payload) if len(payload) == content else None
    return pa.table({"file": [table.column("file")[0].as_py()], "record": [table.column("record")[0].as_py()], "joined": pa.array([found], pa.string())})


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record on the chains: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    ``verified`` tells whether a response's payload has the digest that its header names (for a revisit: whether it names one).
    Text inside payloads that looks like a record is never reported. The record in which a file breaks off has no digest and
    is not verified. An archive without records gives no rows.
    """
    pieces = staged(located(spark, path).where("offset >= 0"), "located")
    known = reachable(pieces.where("successor is not null"))
    records = pieces.where("successor is not null").join(known.hint("merge"), ["file", "offset"])
    records = staged(records, "records")
    broken = records.where("found is null")
    if broken.isEmpty():
        result = records.withColumn("joined", F.lit(None).cast("string"))
    else:
        # Records with version lines inside: their pieces are found by cells of the file and read again.
        cell = lambda c: F.floor(c / F.lit(CELL))
        spans = broken.select("file", F.col("offset").alias("record"), "successor", "header", "content")
        spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("record")), cell(F.col("successor")))))
        inner = pieces.select("file", "offset", "block", "place", cell(F.col("offset")).alias("cell"))
        own = inner.join(spans, ["file", "cell"]).where("offset >= record and offset < successor").drop("cell")
        numbered = pieces_of(spark, path).mapInArrow(_numbered, "value string, file string, block long, place long")
        texts = numbered.join(own, ["file", "block", "place"])
        joined = texts.groupBy("file", "record").applyInArrow(_joined_payload, "file string, record long, joined string")
        result = records.join(joined.withColumnRenamed("record", "offset"), ["file", "offset"], "left")
    digest = F.coalesce("found", "joined")
    revisit = F.col("record_type") == "revisit"
    return result.select(
        "page_id",
        F.col("length").alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(digest).alias("payload_digest"),
        "record_type",
        "refers_to",
        F.when(revisit, F.col("digest") != "").otherwise(digest.eqNullSafe(F.col("digest"))).alias("verified"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, place = None, 0
    for batch in batches:
        places = []
        for file, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if split != (file, block):
                split, place = (file, block), 0
            places.append(place)
            place += 1
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["value", "file", "block", "place"])


def archive_round_trip(pages: DataFrame, path: str | None = None, minimum: int = 0) -> DataFrame:
    """Write the pages as archives (in the shared folder, if no path is given) and read them back."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"
    write_archive(pages, path, minimum)
    return read_archive(spark, path)
