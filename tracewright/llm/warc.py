"""WARC records in a content-addressed archive.

An archive is two tables below one folder: ``payloads`` (digest, payload), each distinct payload once under its SHA-256
digest, and ``headers`` (record_id, digest, head), the exact bytes of each record before its payload. A record is rebuilt by
joining the two: head + payload + CRLF CRLF. Of records with equal payloads the one with the smallest page_id (null last,
then smallest url) is a response, the others are revisits that refer to it and hold no payload. Payloads are compared by
digest and checked by length and a second hash when written, and by digest again when read.

Definitions: null html is the empty payload. Equal payloads shorter than ``least_bytes`` are all responses. Repeated
rows are records of their own: the first copy counts as smaller. A null url has no target header; CR and LF in urls are
percent-encoded. Other columns are not stored. Empty tables make an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_salted, map_arrow, materialize, maybe_broadcast, new_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record_head(kind: str, record_id: str, page_id, url: str | None, sha1: str, n: int, refers_to: str | None, date: str) -> bytes:
    """Everything of a record before its payload: WARC header, blank line, HTTP header."""
    http = http_head(n)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1}"))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (n if kind == "response" else 0)))]
    return VERSION + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF + http


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields (names in lower case), HTTP header and payload of one record."""
    end = record.index(CRLF + CRLF)
    version, *lines = record[:end].split(CRLF)
    if not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    n = int(fields["content-length"])
    block = record[end + 4 : end + 4 + n]
    if len(block) != n or record[end + 4 + n :] != CRLF + CRLF:
        raise ValueError("a record's length is not its Content-Length")
    http, _, payload = block.partition(CRLF + CRLF)
    return fields, http + CRLF + CRLF, payload


def _payload() -> F.Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = DATE) -> str:
    """Write an archive of ``pages`` (page_id, url, html) and give its path.

    Who is the response is decided on digests alone. Payloads move only if the rows that are not stored are too many to
    be broadcast; a group of equal payloads, however large, is one digest with a count from each task.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = pages.select("page_id", "url", _payload().alias("payload")).withColumn("digest", F.sha2("payload", 256))
    described = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"), F.xxhash64("payload").alias("check"))
    copies = materialize(described.groupBy("page_id", "url", "digest", "sha1", "n", "check").agg(F.count("*").alias("copies")), "page-digests")
    rank = F.struct(F.col("page_id").isNull().alias("x"), F.col("page_id").alias("page_id"), F.col("url").isNull().alias("y"), F.col("url").alias("url"))
    firsts = copies.groupBy("digest").agg(F.min(rank).alias("first"), (F.count_distinct("n", "check", "sha1") == 1).alias("one"))
    firsts = firsts.select("digest", F.when(F.col("one"), F.col("first")).otherwise(F.raise_error(F.lit("different payloads have one SHA-256 digest"))).alias("first"))
    told = materialize(join_salted(copies, firsts, ["digest"], ["page_id", "url"]).withColumn("is_first", rank == F.col("first")), "first-pages")

    more = told.where("not is_first").select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("digest").alias("d"))
    same = F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("digest") == F.col("d"))
    stored = rows.join(maybe_broadcast(more, 400), same, "left_anti").select("digest", "payload")
    if not told.where("is_first and copies > 1").isEmpty():
        stored = stored.dropDuplicates(["digest"])
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")

    def key(page_id, url, copy) -> F.Column:  # a name for each record, the same on every run
        return F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(F.base64(url.cast("binary")), F.lit("-")), "digest", copy.cast("string")))

    records = told.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    records = records.withColumns(
        {
            "response": (F.col("is_first") & (F.col("copy") == 0)) | (F.col("n") < least_bytes),
            "id": key(F.col("page_id"), F.col("url"), F.col("copy")),
            "to": key(F.col("first")["page_id"], F.col("first")["url"], F.lit(0)),
        }
    )

    def heads(batch: pa.RecordBatch):
        out, ids = [], []
        columns = ("page_id", "url", "sha1", "n", "response", "id", "to")
        for page_id, url, sha1, n, response, own, to in zip(*(batch.column(c).to_pylist() for c in columns)):
            own, to = str(uuid.UUID(own)), str(uuid.UUID(to))
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            out.append(record_head("response" if response else "revisit", own, page_id, url, digest, n, to, date))
            ids.append(own)
        named = pa.array([d if r else None for d, r in zip(batch.column("digest").to_pylist(), batch.column("response").to_pylist())], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), named, pa.array(out, pa.binary())], ["record_id", "digest", "head"])

    wanted = records.select("page_id", "url", "sha1", "n", "response", "id", "to", "digest")
    map_arrow(wanted, heads, "record_id string, digest string, head binary").write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record): each record's bytes, rebuilt; a response whose payload is missing fails the job."""
    heads, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    responses = join_salted(heads.where("digest is not null"), payloads, ["digest"], ["record_id"], "left")
    payload = F.coalesce("payload", F.raise_error(F.lit("a record's payload is not stored")).cast("binary"))
    end = F.lit(CRLF + CRLF)
    return responses.select("record_id", F.concat("head", payload, end).alias("record")).union(
        heads.where("digest is null").select("record_id", F.concat("head", end).alias("record"))
    )


def parse_records(records: DataFrame) -> DataFrame:
    """Parse WARC records (column record): one row each; a payload that does not match its digest fails the job."""

    def parse(batch: pa.RecordBatch):
        out = []
        for record in batch.column("record").to_pylist():
            f, _, payload = parse_record(record)
            digest = f["warc-payload-digest"].removeprefix("sha1:")
            response = f["warc-type"] == "response"
            if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"the payload of {f['warc-record-id']} does not match its digest")
            plain = lambda x: x and x[len("<urn:uuid:") : -1]
            out.append((plain(f["warc-record-id"]), f["warc-type"], f.get("x-page-id"), f.get("warc-target-uri"), len(payload) if response else None, digest, plain(f.get("warc-refers-to"))))
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string()]
        cols = list(zip(*out)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["record_id", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to_id"])

    return map_arrow(records.select("record"), parse, "record_id string, record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to_id string")


def summarize(spark: SparkSession, path: str, page_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; revisits take the size of the
    payload from the response they name."""
    parsed = materialize(parse_records(read_records(spark, path)), "parsed")
    named = parsed.where("record_type = 'response'").select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("sha"))
    revisits = join_salted(parsed.where("record_type = 'revisit'").withColumnRenamed("refers_to_id", "to"), named, ["to"], ["record_id"], "left")
    fine = F.when(F.col("sha") == F.col("payload_digest"), F.col("n")).otherwise(F.raise_error(F.lit("a revisit does not match the record it refers to")))
    revisits = revisits.select("page_id", fine.alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast(page_type).alias("refers_to"))
    responses = parsed.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(page_type).alias("refers_to"))
    return responses.union(revisits).withColumn("page_id", F.col("page_id").cast(page_type))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: archive all pages, read the archive back."""
    return summarize(spark, write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


_B32 = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * j + 1}, 5))::bigint >> {s}) & 31) + 1)::bigint, 1)" for j in range(8) for s in (15, 10, 5, 0))
ORACLE_SQL = {
    "op3_warc": f"""
with p as (select page_id, coalesce(html, '') as t, row_number() over (partition by coalesce(html, '') order by page_id nulls last, url nulls last) as i,
        first(page_id) over (partition by coalesce(html, '') order by page_id nulls last, url nulls last) as f, sha1(coalesce(html, '')) as h from pages)
select page_id, strlen(t)::bigint as payload_bytes, {_B32} as payload_digest, case when i = 1 then 'response' else 'revisit' end as record_type,
  case when i > 1 then f end as refers_to from p"""
}
