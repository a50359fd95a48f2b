"""Legacy ARC archives to WARC: parse, convert, deduplicate, write and read back."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.llm.common import join_groups, stored

#: The fields of a record's header line, by the archive's version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_DATE = "20000101000000"
PAGE_HEADER = "X-Page-Id"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20  # about so much payload goes into one ARC block or WARC file

ARC_RECORD = (
    "page_id long, url string, ip string, arc_date string, mime string, version int, kind string, http_head binary, payload binary"
)
WARC_TYPES = {"http": "response", "other": "resource", "filedesc": "warcinfo"}
WARC_RECORD = (
    "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, url string"
)

# ---------------------------------------------------------------- ARC


def arc_header(version: int, url: str, ip: str, date: str, mime: str, length: int, offset: int = 0, status: int = 200) -> bytes:
    url = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    fields = [url, ip, date, mime] + ([str(status), "-", "-", str(offset), "pages.arc"] if version == 2 else []) + [str(length)]
    return " ".join(fields).encode() + b"\n"


def arc_start(version: int) -> bytes:
    """The version block that every ARC file begins with."""
    body = f"{version} 0 votelens\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(1, "filedesc://pages.arc", "0.0.0.0", ARC_DATE, "text/plain", len(body)) + body + b"\n"


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes, offset: int = 0) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    head += f"{PAGE_HEADER}: {page_id}\r\n" if page_id is not None else ""
    content = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    return arc_header(version, url or "", "0.0.0.0", ARC_DATE, "text/html", len(content), offset) + content + b"\n"


def _arc_fields(line: bytes, version: int) -> dict[str, bytes] | None:
    """A header line's fields, taken from the right, so that an URL may hold spaces; None of a line that is none."""
    names = ARC_FIELDS[version].split()
    parts = line.rsplit(b" ", len(names) - 1)
    fields = dict(zip(names, parts))  # noqa: B905  (a short line fails the next test)
    if len(parts) < len(names) or not parts[-1].isdigit() or not re.fullmatch(rb"\d{8,14}", fields["Archive-date"]):
        return None
    return fields


def read_arc_stream(stream: BinaryIO) -> Iterator[dict]:
    """Records of one or several ARC files in a row.

    A `filedesc:` record's body names the version, which says how many fields the lines that follow have; the declared length
    says where the next line is.  A line that is no header is damage: what follows is passed over up to the next line that
    is one, and all of it is a record of the kind `damaged`; a record that ends before its length is one too.  Other kinds
    are `http`, `other` (what is no HTTP response, such as a DNS answer) and `filedesc`.
    """
    version, lost = 1, bytearray()

    def record(kind: str, payload: bytes, fields: dict[str, bytes] | None = None, head: bytes = b"") -> dict:
        told = {k: v.decode("utf-8", "replace") for k, v in (fields or {}).items()}
        page = re.search(rb"(?im)^" + PAGE_HEADER.encode() + rb":\s*(-?\d+)", head)
        return {
            "page_id": int(page[1]) if page else None, "url": told.get("URL"), "ip": told.get("IP-address"), "arc_date": told.get("Archive-date", ARC_DATE),
            "mime": told.get("Content-type"), "version": version, "kind": kind, "http_head": head, "payload": payload,
        }

    while line := stream.readline():
        bare = line.rstrip(b"\r\n")
        if not bare and not lost:
            continue
        # the version block's own line has version 1's fields, or so many more of version 2's
        fields = _arc_fields(bare, 1 if bare.startswith(b"filedesc:") else version)
        if fields is None:
            lost += line
            continue
        if lost:
            yield record("damaged", bytes(lost))
            lost.clear()
        length = int(fields["Archive-length"])
        content = stream.read(length)
        if len(content) < length:
            yield record("damaged", content, fields)
        elif bare.startswith(b"filedesc:"):
            named = content.split(b" ", 1)[0]
            version = int(named) if named in (b"1", b"2") else version
            yield record("filedesc", content, fields)
        else:
            head, gap, payload = content.partition(b"\r\n\r\n")
            if content.startswith(b"HTTP/") and gap:
                yield record("http", payload, fields, head + gap)
            else:
                yield record("other", content, fields)
    if lost:
        yield record("damaged", bytes(lost))


def _frames(rows: Iterator[dict], columns: list[str], size: str | None) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded bytes."""
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += len(row[size]) if size else 400
        if held_bytes >= 8 << 20:
            yield pd.DataFrame(held, columns=columns).astype({"page_id": "Int64"})
            held, held_bytes = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns).astype({"page_id": "Int64"})


def to_arc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """ARC archives of the pages, one in each row of `content`; versions 1 and 2 take turns.  A null page is empty."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        version, out = 1, bytearray(arc_start(1))
        for frame in frames:
            for page, address, text in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                out += arc_record(version, address, None if pd.isna(page) else int(page), bytes(text or b""), len(out))
                if len(out) >= 4 << 20:
                    yield pd.DataFrame({"content": [bytes(out)]})
                    version = 3 - version
                    out = bytearray(arc_start(version))
        yield pd.DataFrame({"content": [bytes(out)]})

    return pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html")
    ).mapInPandas(work, "content binary")


def parse_arc(archives: DataFrame) -> DataFrame:
    """The records of ARC archives in the column `content`, plain or gzipped."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ARC_RECORD.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                stream = io.BytesIO(content)
                opened = gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream
                yield from _frames(read_arc_stream(opened), columns, "payload")

    return archives.select("content").mapInPandas(work, ARC_RECORD)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files under a path."""
    return parse_arc(spark.read.format("binaryFile").load(path))


# ---------------------------------------------------------------- conversion


def converted(records: DataFrame) -> DataFrame:
    """ARC records with what WARC asks for besides: record_id, record_type, warc_date, payload_bytes, payload_digest.

    An HTTP response is a `response`, anything else that was fetched a `resource` of its own content type, and an archive's
    version block a `warcinfo` that tells the archive's name and version.  Damaged records are left out; see `damage`.
    """
    records = records.where("kind <> 'damaged'")
    info = F.concat(F.lit("filename: "), F.regexp_replace("url", "^filedesc://", ""), F.lit("\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version "), F.col("version").cast("string"), F.lit("\r\n"))
    records = records.withColumn("payload", F.when(F.col("kind") == "filedesc", info.cast("binary")).otherwise(F.col("payload")))
    kind = F.coalesce(*[F.when(F.col("kind") == k, t) for k, t in WARC_TYPES.items()])
    name = F.sha1(F.concat_ws("|", F.lit("arc"), "url", "arc_date", F.col("page_id").cast("string"), "payload_digest"))
    parts = [F.substring("_n", 1, 8), F.substring("_n", 9, 4), F.concat(F.lit("5"), F.substring("_n", 14, 3)),
             F.concat(F.lit("8"), F.substring("_n", 18, 3)), F.substring("_n", 21, 12)]
    date = F.regexp_replace(F.rpad("arc_date", 14, "0"), r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*$", "$1-$2-$3T$4:$5:$6Z")
    return (
        records.withColumn("payload_digest", F.sha1("payload"))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("_n", name).withColumn("record_id", F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts)))
        .withColumn("warc_date", date).withColumn("record_type", kind).drop("_n")
    )


def damage(records: DataFrame) -> DataFrame:
    """What could not be read: url (null of bytes that belong to no header), lost_bytes, and a digest of these."""
    lost = records.where("kind = 'damaged'")
    return lost.select("url", F.octet_length("payload").cast("long").alias("lost_bytes"), F.sha1("payload").alias("lost_digest"))


def revisits(records: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, payload_digest and the record it revisits: refers_to_id, refers_to_url, refers_to_date.

    Of equal payloads of at least `least_bytes` the one with the largest page_id is the response.  `records` is a stored
    table of ids and digests: no payload moves, and copies of one payload never gather in one task.
    """
    ids = records.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    kept = ids.groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "record_id", "url", "warc_date")).alias("kept"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    copies = join_groups(ids.select("page_id", "payload_digest"), stored(kept, "payloads"), "payload_digest", "n", ids.count())
    return copies.where("page_id < kept.page_id").select(
        "page_id", "payload_digest", F.col("kept.record_id").alias("refers_to_id"), F.col("kept.url").alias("refers_to_url"),
        F.col("kept.warc_date").alias("refers_to_date"),
    ).distinct()


def warc_bytes() -> Column:
    """A record of the converted columns as WARC 1.1, without the two line ends that close it."""
    again = F.col("refers_to_id").isNotNull()
    body = F.when(again, F.col("http_head")).otherwise(F.concat("http_head", "payload"))
    http, info = F.col("record_type") == "response", F.col("record_type") == "warcinfo"
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise(F.col("record_type"))),
        F.concat(F.lit("WARC-Record-ID: <"), "record_id", F.lit(">")),
        F.concat(F.lit("WARC-Date: "), "warc_date"),
        F.when(info, F.concat(F.lit("WARC-Filename: "), F.regexp_replace("url", "^filedesc://", ""))).otherwise(F.concat(F.lit("WARC-Target-URI: "), "url")),
        F.when(~info, F.concat(F.lit("WARC-IP-Address: "), "ip")),
        F.when(~info, F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest")),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), F.sha1(body)),
        F.when(again, F.lit("WARC-Profile: " + REVISIT_PROFILE)),
        F.concat(F.lit("WARC-Refers-To: <"), "refers_to_id", F.lit(">")),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), "refers_to_url"),
        F.concat(F.lit("WARC-Refers-To-Date: "), "refers_to_date"),
        F.concat(F.lit("Content-Type: "), F.when(http, "application/http;msgtype=response").when(info, "application/warc-fields").otherwise(F.coalesce("mime", F.lit("application/octet-stream")))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    head = F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"))  # concat_ws passes over null lines
    return F.concat(head.cast("binary"), body)


def write_warc(records: DataFrame, path: str) -> None:
    """Writes converted records, with what they revisit, as WARC files, one per partition; each record is a gzip member.

    The files are written by Spark's text sink: a record is a line.  Its separator, which can't be empty, is a gzip member
    without content, which readers pass over.
    """

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"value": [gzip.compress(bytes(record) + b"\r\n\r\n", 6, mtime=0) for record in frame["record"]]})

    rows = records.select(warc_bytes().alias("record")).mapInPandas(members, "value binary").select(F.col("value").cast("string"))
    separator = gzip.compress(b"", mtime=0).decode("latin-1")
    rows.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def read_warc_stream(stream: BinaryIO) -> Iterator[dict]:
    """The records of a WARC file; lengths and digests of responses come from the bytes that are there."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not block.startswith(b"HTTP/"):
            head, payload = b"", block
        expected = fields.get("warc-block-digest", "").partition(":")[2]
        if expected and expected != hashlib.sha1(block).hexdigest():
            raise ValueError(f"record {fields.get('warc-record-id')} is damaged: its block has another digest")
        page = re.search(rb"(?im)^" + PAGE_HEADER.encode() + rb":\s*(-?\d+)", head)
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        again = fields["warc-type"] == "revisit"
        yield {
            "page_id": int(page[1]) if page else None, "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"],
            "payload_bytes": int(length[1]) if again and length else len(payload),
            "payload_digest": fields["warc-payload-digest"].partition(":")[2] if again else hashlib.sha1(payload).hexdigest(),
            "refers_to_id": fields.get("warc-refers-to", "").strip("<>") or None, "url": fields.get("warc-target-uri"),
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under a path.  A file is streamed; Spark hands one task files of a bounded size."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in WARC_RECORD.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                stream = io.BytesIO(content)
                opened = gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream
                yield from _frames(read_warc_stream(io.BufferedReader(opened)), columns, None)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, WARC_RECORD)


def convert_archives(records: DataFrame, path: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """ARC records to WARC files under `path`, and what these say when read back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to (the page_id of the response, else null).
    These are the pages' records; the archives hold the others too (`converted`), which `read_warc` gives.
    Payloads shuffle once, by page_id and digest, so copies of one payload spread over all tasks.  Records without a page_id
    are never revisits, and spread by their place; of records that repeat a page_id, each payload counts by itself.  An
    empty table gives no record.
    """
    spark = records.sparkSession
    full = converted(records)
    # what deduplication needs to know, without payloads: the archives are parsed once for it and once to be written
    facts = stored(full.select("page_id", "record_id", "record_type", "url", "warc_date", "payload_digest", "payload_bytes"), "records")
    total = facts.agg(F.sum("payload_bytes")).first()[0] or 0
    archives = max(-(-total // ARCHIVE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.when(F.col("page_id").isNull(), F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("page_id").cast("string"))
    again = revisits(facts, least_bytes).withColumn("place", F.col("page_id").cast("string")).drop("page_id")
    spread = full.withColumn("place", place).repartition(archives, "place", "payload_digest")
    write_warc(spread.join(again, ["place", "payload_digest"], "left"), path)
    back = stored(read_warc(spark, path).where("record_type in ('response', 'revisit')"), "archived")
    one = back.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    two = back.where("refers_to_id is not null")
    response = back.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    named = two.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n")).join(response, "refers_to_id")
    copies = join_groups(two, stored(named, "responses"), "refers_to_id", "n", two.count())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return one.select(*columns).union(copies.select(*columns))
