"""Raw messages → the ``emails`` table.

Only MIME decoding needs Python, in Arrow batches; ids, domains, truncation, hop counts
and labels are native expressions around it.
"""

from __future__ import annotations

import email
import sys
from collections.abc import Iterator
from datetime import timezone
from email.utils import parseaddr, parsedate_to_datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structure
from ..session import bounded_batches

# The decoder travels to the executors by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADERS = {
    "subject": "Subject",
    "sender_raw": "From",
    "x_mailer": "X-Mailer",
    "return_path": "Return-Path",
    "message_id": "Message-ID",
    "x_spam_status": "X-Spam-Status",
    "x_spam_score": "X-Spam-Score",
}
_DECODED = (
    "path string, content binary, subject string, sender_raw string, x_mailer string, return_path string, "
    "message_id string, x_spam_status string, x_spam_score string, sender_email string, recipient string, "
    "date timestamp, text string, html string, content_type string, hops array<string>, _error string"
)


def _decode(part) -> str | None:
    payload = part.get_payload(decode=True)
    if not payload:
        return None
    try:
        return payload.decode(part.get_content_charset() or "utf-8", errors="replace")
    except (LookupError, ValueError):  # unknown or malformed charset name
        return payload.decode("utf-8", errors="replace")


def _bodies(msg) -> tuple[str, str | None]:
    """All plain parts concatenated, the last HTML part; a single part is text as it is."""
    if not msg.is_multipart():
        return _decode(msg) or "", None
    plain, html = [], None
    for part in msg.walk():
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html"):
            body = _decode(part)
            if body is not None:
                if kind == "text/plain":
                    plain.append(body)
                else:
                    html = body
    return "".join(plain), html


def _utc(header: str):
    try:
        when = parsedate_to_datetime(header)
    except (TypeError, ValueError):
        return None
    return when.astimezone(timezone.utc) if when.tzinfo else when.replace(tzinfo=timezone.utc)


def _row(content: bytes | None) -> dict:
    if content is None:
        return {"_error": "no content"}
    try:
        msg = email.message_from_bytes(bytes(content))
        row = {col: str(msg.get(name, "")) for col, name in HEADERS.items()}
        row["sender_email"] = parseaddr(row["sender_raw"])[1]
        row["recipient"] = parseaddr(str(msg.get("To", "")))[1]
        row["date"] = _utc(str(msg.get("Date", "")))
        row["text"], row["html"] = _bodies(msg)
        row["content_type"] = msg.get_content_type()
        row["hops"] = [str(h) for h in msg.get_all("Received", [])]
        row["_error"] = None
        return row
    except Exception as e:  # a bad message must not stop the job; it is quarantined
        return {"_error": f"{type(e).__name__}: {e}"}


def _slices(part: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The messages of a batch in runs of at most ``limit`` bytes; a longer message is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(part.column("content")), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield part.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < part.num_rows:
        yield part.slice(start)


def _decoder(limit: int):
    texts = [c.split()[0] for c in _DECODED.split(", ") if c.endswith(" string") and c != "path string"]
    kinds = {**dict.fromkeys(texts, pa.string()), "date": pa.timestamp("us", tz="UTC"), "hops": pa.list_(pa.string())}
    columns = [c.split()[0] for c in _DECODED.split(", ")][2:]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in _slices(whole, limit):
                rows = [_row(c.as_py()) for c in part.column("content")]
                cells = [pa.array([r.get(c) for r in rows], kinds[c]) for c in columns]
                yield pa.record_batch([part.column("path"), part.column("content"), *cells], names=["path", "content", *columns])

    return run


def scan_messages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file under ``path``; hidden and empty files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(~file_name(F.col("path")).startswith(".")).select("path", "content")


def write_messages(messages: DataFrame, root: str) -> DataFrame:
    """(corpus, path, bytes): every message written to ``root`` as a file of its own, in the folder of its corpus.

    Tasks write through a file system that pyarrow opens on the executors (file, hdfs, s3, gs, abfs). A repeated task writes the
    same files again. The result is lazy; running it writes.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = root if "://" in root else "file://" + root.removeprefix("file:")
        system, base = fs.FileSystem.from_uri(uri)
        for part in parts:
            paths = [f"{base.rstrip('/')}/{c}/{n}" for c, n in zip(part.column("corpus").to_pylist(), part.column("name").to_pylist())]
            for folder in {p.rsplit("/", 1)[0] for p in paths}:
                system.create_dir(folder, recursive=True)
            for path, content in zip(paths, part.column("content").to_pylist()):
                with system.open_output_stream(path) as out:
                    out.write(content)
            sizes = pc.cast(pc.binary_length(part.column("content")), pa.int64())
            yield pa.record_batch([part.column("corpus"), pa.array(paths, pa.string()), sizes], names=["corpus", "path", "bytes"])

    rows = messages.where(F.col("content").isNotNull()).select(
        corpus_name(F.col("path")).alias("corpus"), file_name(F.col("path")).alias("name"), "content"
    )
    return rows.mapInArrow(write, "corpus string, path string, bytes long")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def corpus_name(path: Column) -> Column:
    """Directory holding the file."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def label_of(corpus: Column) -> Column:
    return F.when(F.lower(corpus).contains("spam"), "spam").otherwise("ham")


def decode_messages(messages: DataFrame) -> DataFrame:
    """(path, content) → decoded headers and bodies, one row per message, plus ``_error``.

    A worker holds one batch of raw messages and decodes about a megabyte of it at a time, whatever the size of its partition.
    """
    bounded_batches(messages.sparkSession)
    return messages.select("path", "content").mapInArrow(_decoder(1 << 20), _DECODED)


def to_emails(decoded: DataFrame, filename: Column | None = None, label: Column | None = None) -> DataFrame:
    """Decoded messages → ``emails`` columns (failed rows excluded)."""
    corpus = corpus_name(F.col("path"))
    filename = filename if filename is not None else F.concat_ws("_", corpus, file_name(F.col("path")))
    label = label if label is not None else label_of(corpus)
    hops = F.coalesce("hops", F.array().cast("array<string>"))
    return decoded.where(F.col("_error").isNull()).select(
        structure.content_id("content").alias("email_id"),
        filename.alias("filename"),
        label.alias("label"),
        "subject",
        "sender_raw",
        "sender_email",
        structure.domain_of("sender_email").alias("sender_domain"),
        "recipient",
        "date",
        structure.clip_body("text").alias("body_text"),
        structure.clip_html("html").alias("body_html"),
        "content_type",
        "x_mailer",
        F.size(hops).alias("received_hop_count"),
        F.slice(hops, 1, 10).alias("received_hops"),
        "return_path",
        "message_id",
        "x_spam_status",
        "x_spam_score",
    )


def quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("_error").isNotNull()).select("path", F.col("_error").alias("error"))


def joined_hops(emails: DataFrame) -> DataFrame:
    """Hops as one ``|||``-separated text column."""
    return emails.withColumn("received_hops", F.concat_ws("|||", "received_hops"))


def parse_summary(emails: DataFrame) -> DataFrame:
    return emails.agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.count_if(F.col("label") == "spam").alias("spam_count"),
        F.count_if(F.col("label") == "ham").alias("ham_count"),
    )


def ingest_summary(decoded: DataFrame) -> DataFrame:
    """Stored and failed files per corpus."""
    return decoded.groupBy(corpus_name(F.col("path")).alias("corpus")).agg(
        F.count_if(F.col("_error").isNull()).alias("files_stored"),
        F.count_if(F.col("_error").isNotNull()).alias("errors"),
    )
