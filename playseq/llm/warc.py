"""Content-addressed web archive.

An archive is a folder of two tables. ``payloads`` keeps the bytes of each distinct payload once under its SHA-256.
``headers`` keeps, for every record, its exact header bytes and the digest of its payload. Joining the two on the digest
restores each original record byte for byte.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playseq.operators.storage import shared_dir, written

#: Payloads below this many bytes are repeated rather than referred to.
LEAST = 100
CRLF = "\r\n"


def _line(name: str, value) -> object:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def records(pages: DataFrame, least: int = LEAST, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to and header (the WARC header and,
    in a response, the HTTP header; as text, UTF-8).

    Of records with equal payloads of ``least`` bytes or more, those with the smallest page_id are responses and the
    others revisits of it. Null html is an empty payload; a null url leaves out its header line; line breaks in a url
    are escaped. A null page_id is never referred to. Repeated rows of the smallest page_id are all responses.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digests = written(pages.select("page_id", "url", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")), "digests")
    first = digests.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Only digests of several records are joined, one row each; a hot digest's records are split by adaptive execution.
    known = digests.join(first.where("n > 1").drop("n"), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    known = known.withColumn("refers_to", F.when(again, F.col("first"))).withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    name = lambda column: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", name("page_id")),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(again, F.concat(_line("WARC-Refers-To", name("refers_to")), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", (F.length(http) + F.when(again, 0).otherwise(F.col("payload_bytes"))).cast("string")),
        F.lit(CRLF),
        http,
    )
    return known.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", header.alias("header"))


def write_archive(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Write the archive of ``pages``. Copies of a payload collapse before they are shuffled."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    payloads = pages.select(F.sha2(payload, 256).alias("payload_digest"), payload.alias("payload"))
    payloads.dropDuplicates(["payload_digest"]).write.mode("overwrite").parquet(f"{folder}/payloads")
    records(pages, least).write.mode("overwrite").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records of an archive with ``payload``. Each stored payload is hashed again; a damaged or missing one ends the job."""
    payloads = spark.read.parquet(f"{folder}/payloads")
    checked = payloads.select("payload_digest", "payload", (F.sha2("payload", 256) == F.col("payload_digest")).alias("_ok"), F.octet_length("payload").cast("long").alias("_bytes"))
    joined = spark.read.parquet(f"{folder}/headers").join(checked, "payload_digest", "left")
    sound = F.coalesce(F.col("_ok") & (F.col("_bytes") == F.col("payload_bytes")), F.lit(False))
    size = F.when(sound, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged or missing payload "), F.col("payload_digest"))).cast("long"))
    return joined.withColumn("payload_bytes", size).drop("_ok", "_bytes")


def record_bytes(archive: DataFrame) -> DataFrame:
    """page_id and ``record``: the exact bytes of each WARC record (a revisit has no payload of its own)."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return archive.select("page_id", F.concat(F.col("header").cast("binary"), body, F.lit((CRLF * 2).encode())).alias("record"))


def restored(archive: DataFrame) -> DataFrame:
    """The archive's records rebuilt, and what they say of themselves: ``archive`` with ``record_bytes`` (length) and
    ``record_sha256`` of the exact record, and record_type and refers_to as its header has them."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    whole = archive.withColumn("_record", F.concat(F.col("header").cast("binary"), body, F.lit((CRLF * 2).encode())))
    line = lambda name: F.regexp_extract("header", rf"(?m)^{name}: (.*)$", 1)
    referred = F.regexp_extract(line("WARC-Refers-To"), "^<urn:page:(.*)>$", 1)
    return whole.withColumns(
        {
            "record_bytes": F.octet_length("_record").cast("long"),
            "record_sha256": F.sha2("_record", 256),
            "record_type": line("WARC-Type"),
            "refers_to": F.when(F.contains("header", F.lit("WARC-Refers-To: ")), referred).cast(dict(archive.dtypes)["refers_to"]),
        }
    ).drop("_record")


def export_warc(archive: DataFrame, folder: str, per_file: int = 10_000) -> None:
    """Write the records as gzip text files, which any WARC reader takes."""
    body = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise("")
    lines = archive.select(F.concat("header", body, F.lit(CRLF)).alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", CRLF).option("maxRecordsPerFile", per_file).text(folder)


def import_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of gzip or plain WARC files: warc (header text), http (header text), payload. One task reads a file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                stream = io.BytesIO(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
                rows = []
                while line := stream.readline():
                    if not line.startswith(b"WARC/"):
                        continue
                    head = [line]
                    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                        head.append(line)
                    size = next(int(x.split(b":", 1)[1]) for x in head if x.lower().startswith(b"content-length:"))
                    http, cut, payload = stream.read(size).partition(b"\r\n\r\n")
                    rows.append((b"".join(head).decode() + CRLF, (http + cut).decode(), payload))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["warc", "http", "payload"])

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(parse, "warc string, http string, payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder, read the archive back, and return the verified and restored records."""
    from uuid import uuid4

    folder = f"{shared_dir(pages.sparkSession)}/playseq/archive-{uuid4().hex}"
    write_archive(pages, folder)
    return restored(read_archive(pages.sparkSession, folder))
