"""WARC archives with revisit records.

Every page is a record whose payload is its html. Headers (page, digest, length) are
shuffled by payload digest; where equal payloads of REVISIT_FROM bytes or more meet, the
smallest page_id's record stays a response and the others become revisits that refer to it.
The archives are written deduplicated, with fresh headers, and read back record by record.

Archives are gzipped text files of Spark's own writer, whose line separator is the blank
line that ends a WARC record, so any file system that Spark knows will do; a gzipped file
isn't split, so the reader gets each archive's lines in order and follows Content-Length.

Payloads stay where they are: what is shuffled by digest are headers. Verdicts come back by
a broadcast while they are few; beyond that a bitmap of the repeated digests is broadcast,
and only pages whose digest is marked there (copies, and one in 16 others) are joined by a
shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored, table

REVISIT_FROM = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"
#: repeated digests (about 100 bytes each) that are broadcast
BROADCAST_ROWS = 200_000
#: bits of the bitmap of repeated digests: so many each, a power of two between these; and of one row of it
BITS_EACH, FEWEST_BITS, MOST_BITS, ROW_BITS = 16, 1 << 15, 1 << 29, 1 << 15


def page_urn(page_id: Column) -> Column:
    """A record's name by its page's id of any type, percent-encoded; without an id it is empty."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def _slot(digest: Column, bits: int) -> Column:
    """A digest's place in a bitmap of that many bits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % bits


def _marked(headed: DataFrame, repeats: DataFrame, count: int) -> DataFrame:
    """headed with ``maybe``: may the digest be one of the repeated ones? (never false for one of them)"""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_EACH * count - 1).bit_length()))
    slots = repeats.select(_slot(F.col("payload_digest"), bits).alias("slot"))
    rows = slots.groupBy(F.floor(F.col("slot") / ROW_BITS).alias("bits_row")).agg(F.bitmap_construct_agg(F.col("slot") % ROW_BITS).alias("bits"))
    # at most MOST_BITS
    placed = headed.withColumn("slot", _slot(F.col("payload_digest"), bits)).withColumn("row", F.floor(F.col("slot") / ROW_BITS))
    joined = placed.join(F.broadcast(rows), F.col("row") == F.col("bits_row"), "left")
    at = F.col("slot") % ROW_BITS
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    bit = F.expr("shiftright({b}, cast(slot % 8 as int))".format(b="byte"))
    maybe = F.coalesce(bit.bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.withColumn("byte", byte).withColumn("maybe", maybe).drop("slot", "row", "bits_row", "bits", "byte")


def resolved(pages: DataFrame) -> DataFrame:
    """pages with ``payload``, ``payload_bytes``, ``payload_digest`` and ``refers_to`` (null: a response).

    Only digests that occur twice or more are written out and come back as verdicts; no
    payload of a page without copies is shuffled for them but by chance of the bitmap.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    headed = pages.select("page_id", "url", payload.alias("payload"), F.length(payload.cast("binary")).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    groups = headed.filter(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("original")).filter("n > 1")
    repeats = stored(groups.select("payload_digest", "original"), "repeats")
    count = repeats.count()
    if count <= BROADCAST_ROWS:
        joined = headed.join(F.broadcast(repeats), "payload_digest", "left")
    else:
        flagged = _marked(headed, repeats, count)
        alone = flagged.filter(~F.col("maybe")).withColumn("original", F.lit(None).cast(repeats.schema["original"].dataType))
        joined = flagged.filter("maybe").join(repeats, "payload_digest", "left").unionByName(alone).drop("maybe")
    return joined.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("original")), F.col("original"))).drop("original")


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(record): a WARC record each, without the blank lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    # control characters can't stand in a header
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x1f\\x7f]", "")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))

    head = F.concat(
        F.lit("WARC/1.1" + BREAK),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", page_urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", page_urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(BREAK),
    )
    return pages.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the deduplicated archives, one for each partition, to a new folder."""
    records(resolved(pages)).write.option("lineSep", BREAK * 2).option("compression", "gzip").text(path)


class _Reader:
    """Follows records through the lines of one archive."""

    def __init__(self):
        self.head: dict[str, str] | None = None
        self.left = -1
        self.body = hashlib.sha256()
        self.size = 0

    def take(self, line: bytes) -> tuple | None:
        """One line, without its newline; a finished record, if it ends one."""
        if self.left >= 0:
            # a payload's last line runs into the break that follows it
            part = (line + b"\n")[: self.left]
            self.body.update(part)
            self.left -= len(part)
            return None if self.left else self._end()
        text = line.removesuffix(b"\r")
        if self.head is None:
            if text == b"WARC/1.1":
                self.head = {}
            elif text:
                raise ValueError(f"no record begins with {text[:40]!r}")
            return None
        if text:
            name, _, value = text.decode().partition(": ")
            self.head[name.lower()] = value
            return None
        self.size = self.left = int(self.head["content-length"])
        self.body = hashlib.sha256()
        return None if self.left else self._end()

    def _end(self) -> tuple:
        head, self.head, self.left = self.head, None, -1
        stated = head["warc-payload-digest"].removeprefix("sha256:")
        kind = head["warc-type"]
        if kind == "response" and self.body.hexdigest() != stated:
            raise ValueError(f"{head['warc-record-id']}: its payload doesn't have the digest that its header states")
        return _id(head["warc-record-id"]), head["warc-target-uri"], kind, stated, self.size, _id(head.get("warc-refers-to", ""))


def _id(urn: str) -> str | None:
    return unquote_plus(urn.removeprefix("<urn:page:").removesuffix(">")) or None


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, url, record_type, payload_digest, block_bytes, refers_to) of every record, ids of a type.

    Payload digests of responses are computed anew and must be as stated.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, _Reader()
        for batch in batches:
            out = []
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != at:
                    at, reader = file, _Reader()
                if found := reader.take(line):
                    out.append(found)
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "url", "record_type", "payload_digest", "block_bytes", "refers_to"])

    read = lines.mapInArrow(run, "page_id string, url string, record_type string, payload_digest string, block_bytes long, refers_to string")
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as archives and read them back: (page_id, url, record_type,
    payload_digest, payload_bytes, refers_to), a row per page.

    Revisits are joined to the responses they refer to, whose payload length is theirs. A
    null html is an empty payload; payloads under REVISIT_FROM bytes are always responses.
    Rows that repeat an id with equal payloads are all responses if theirs is the smallest
    id; if no page of a group has an id, all stay responses. A null url reads empty. Ids may
    be of any type; an empty string reads as null. Other columns, whatever their names, don't
    take part.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archives")
    write_archives(pages, path)
    headers = stored(read_archives(spark, path, pages.schema["page_id"].dataType.simpleString()), "headers")
    revisits = headers.filter("record_type = 'revisit'")
    originals = headers.filter((F.col("record_type") == "response") & (F.col("block_bytes") >= REVISIT_FROM))
    originals = originals.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.max("block_bytes").alias("payload_bytes"))
    full = revisits.join(originals, "payload_digest", "left").select("page_id", "url", "record_type", "payload_digest", "payload_bytes", F.col("original").alias("refers_to"))
    return headers.filter("record_type = 'response'").select("page_id", "url", "record_type", "payload_digest", F.col("block_bytes").alias("payload_bytes"), "refers_to").union(full)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with payloads as (
  select page_id, encode(coalesce(html, '')) as p from pages
), headed as (
  select page_id, octet_length(p)::bigint as payload_bytes, sha256(p) as payload_digest from payloads
), grouped as (
  select *, min(page_id) over (partition by payload_digest) as original from headed
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> original then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> original then original end as refers_to
from grouped
"""

QUERIES = {"op8_warc": query}
ORACLES = {"op8_warc": SQL}
