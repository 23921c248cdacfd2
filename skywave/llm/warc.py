"""A content-addressed WARC archive.

Payloads are stored once each, under their SHA-256 digest, in a table of payloads; the exact header bytes of every record
lie in a table of headers that names the digest. Reading joins the two: it checks every payload against its digest and
gives back the records byte for byte. Everything runs on built-in functions; payloads are dealt by digest once for
writing and once for reading, and equal ones are combined before they are dealt.

Of records with equal payloads of at least REVISIT_BYTES, that with the smallest id is the response and the others are
revisits that name it (their records carry headers and an empty block). Smaller payloads are all responses.

Defined cases: null html is an empty payload; null url gives an empty target; rows that share an id get a record each; a
null id is written as empty and is never the response that others refer to, unless all have null ids; rows that share the
smallest id of a payload are all responses; CR and LF are left out of targets (no header field may hold them), other line
separators stay; extra columns are ignored; an empty table makes an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

REVISIT_BYTES = 100
#: Every record carries this date: the pages have none of their own, and reruns must agree.
DATE = "1970-01-01T00:00:00Z"
_LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _header(revisit: Column) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{_LINE}WARC-Refers-To: "), _record_id(F.col("owner")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws(_LINE, *lines), F.lit(_LINE + _LINE))


def write_archive(pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write the archive's two tables under path (by default a new one in the shared folder) and return the path."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    records = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # equal payloads are combined in the task that reads them, before they are dealt by digest
    payloads = records.groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    names = records.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    owners = names.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1").withColumnRenamed("digest", "od")
    heads = names.join(owners, names.digest == owners.od, "left")
    revisit = F.coalesce((F.col("bytes") >= REVISIT_BYTES) & (F.coalesce(F.col("page_id"), F.lit(-(1 << 62))) != F.col("owner")), F.lit(False))
    heads.select("digest", F.encode(_header(revisit), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_digest, record) for each record.

    record holds the record's exact bytes. A payload that does not match its digest, or a record without one, fails the job.
    """
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = payloads.select(F.col("digest").alias("pd"), F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest")))).alias("payload"))
    records = headers.join(checked, headers.digest == checked.pd, "left").withColumn("head", F.decode("header", "UTF-8"))
    # only CR LF ends a line: a target may hold any other separator
    field = lambda name: F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select(
        F.regexp_extract(field("WARC-Record-ID"), r"^<urn:page:(-?\d*)>$", 1).try_cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"),
        F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload for "), F.col("digest")))).alias("payload"),
        F.regexp_extract(field("WARC-Payload-Digest"), r"^sha256:(\w+)$", 1).alias("payload_digest"),
        F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")).alias("record"),
    )
