"""Raw messages written from the documents table, scanned and parsed back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import structure
from ..session import scratch_folder
from ..sources import mail, tables
from .views import EMAILS_SQL, content_emails, emails, moment, table, with_views

BOUNDARY = "=_part_9f2"


def raw_messages(spark, sf: str) -> DataFrame:
    """Every document as a raw message; one in three is multipart with an HTML part."""
    d = F.col("doc_id")
    when = moment("2024-01-01 00:00:00") + d * F.lit(timedelta(minutes=37))
    date = F.when(d % 7 == 0, "no date").otherwise(
        F.concat(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    )
    hop = F.transform(
        F.when(d % 13 > 0, F.sequence(F.lit(1).cast("long"), d % 13)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.concat(F.lit("Received: from hop"), i.cast("string"), F.lit("\n")),
    )
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text")
    html = F.concat(
        F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n<p>"), "text", F.lit("</p>")
    )
    multi = F.concat(
        F.lit(f'Content-Type: multipart/alternative; boundary="{BOUNDARY}"\n\n--{BOUNDARY}\n'), plain,
        F.lit(f"\n--{BOUNDARY}\n"), html, F.lit(f"\n--{BOUNDARY}--\n"),
    )
    domain = F.when(d % 41 == 0, "").otherwise(F.concat(F.lit("@"), "source", F.lit(".example")))
    head = F.concat(
        F.array_join(hop, ""),
        F.lit("From: Sender "), d.cast("string"), F.lit(" <user"), d.cast("string"), domain, F.lit(">\n"),
        F.lit("To: Reader <reader@"), "lang", F.lit(".example>\n"),
        F.lit("Subject: Mail "), d.cast("string"), F.lit("\n"),
        F.lit("Date: "), date, F.lit("\n"),
        F.when(d % 5 >= 3, "X-Mailer: client\n").otherwise(""),
        F.lit("MIME-Version: 1.0\n"),
    )
    corpus = F.when(d % 4 == 0, "spam_2").when(d % 4 == 1, "hard_ham").otherwise("easy_ham")
    path = F.concat(F.lit("/raw/"), corpus, F.lit("/"), F.when(d % 19 == 0, ".").otherwise("m"), d.cast("string"))
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return tables.spread(docs, "doc_id").select(
        path.alias("path"),
        F.concat(head, F.when(d % 3 == 0, multi).otherwise(plain)).cast("binary").alias("content"),
    )


_CORPUS_SQL = "CASE doc_id % 4 WHEN 0 THEN 'spam_2' WHEN 1 THEN 'hard_ham' ELSE 'easy_ham' END"
_NAME_SQL = "CASE WHEN doc_id % 19 = 0 THEN '.' ELSE 'm' END || CAST(doc_id AS VARCHAR)"


def _subject_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.substring_index("subject", " ", -1).cast("long"))


def _decoded(spark, sf):
    return _subject_id(mail.decode_messages(raw_messages(spark, sf)))


def _parsed(spark, sf):
    return _subject_id(mail.to_emails(mail.decode_messages(raw_messages(spark, sf))))


def _labels(spark, sf):
    path = F.col("path")
    rows = raw_messages(spark, sf).select("path").where(~mail.file_name(path).startswith("."))
    corpus = mail.corpus_name(path)
    return rows.select(F.concat_ws("_", corpus, mail.file_name(path)).alias("filename"), mail.label_of(corpus).alias("label"))


def _headers(spark, sf):
    return _decoded(spark, sf).select(
        "doc_id", "sender_raw", "sender_email", "recipient", "x_mailer", "content_type", "message_id"
    )


def _domains(spark, sf):
    return _parsed(spark, sf).select("doc_id", "sender_domain")


def _dates(spark, sf):
    return _decoded(spark, sf).select("doc_id", F.coalesce(F.unix_seconds("date"), F.lit(-1)).alias("epoch"))


def _clip(spark, sf):
    df = table(spark, sf, "documents")
    return df.select(
        "doc_id",
        structure.clip_body("text").alias("body_text"),
        structure.clip_html(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("")).alias("body_html"),
    )


def _hops(spark, sf):
    return mail.joined_hops(_parsed(spark, sf)).select(
        "doc_id", F.col("received_hop_count").cast("long").alias("received_hop_count"), "received_hops"
    )


def _broken(spark, sf):
    lost = F.col("path").endswith("7")
    return raw_messages(spark, sf).withColumn("content", F.when(~lost, F.col("content")))


def _quarantine(spark, sf):
    return mail.quarantine(mail.decode_messages(_broken(spark, sf)))


def _ingest(spark, sf):
    return mail.ingest_summary(mail.decode_messages(_broken(spark, sf)))


def _raw_scan(spark, sf):
    """All messages as files of the shared folder, scanned again by label directory; totals come from the write itself."""
    root = scratch_folder(spark, "raw")
    seen = Observation()
    written = mail.write_messages(raw_messages(spark, sf), root).observe(seen, F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    written.write.format("noop").mode("overwrite").save()
    found = mail.scan_messages(spark, root)
    corpus = mail.corpus_name(F.col("path"))
    size = F.length("content")
    rows = found.select(corpus.alias("corpus"), mail.label_of(corpus).alias("label"), size.alias("size"), F.regexp_extract(F.col("content").cast("string"), r"(?m)^Subject: (.*)$", 1).alias("subject"))
    return rows.groupBy("corpus", "label").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("subject").alias("subjects"), F.lit(seen.get["files"]).cast("long").alias("files_written"),
        (F.sum("size") <= F.lit(seen.get["bytes"])).alias("within_written"),
    )


QUERIES = {
    "a01_raw_scan": (
        _raw_scan,
        f"""SELECT {_CORPUS_SQL} AS corpus, CASE WHEN doc_id % 4 = 0 THEN 'spam' ELSE 'ham' END AS label, count(*) AS files,
              count(DISTINCT doc_id) AS subjects, (SELECT count(*) FROM documents) AS files_written, TRUE AS within_written
            FROM documents WHERE doc_id % 19 <> 0 GROUP BY 1, 2""",
    ),
    "a02_labels_from_path": (
        _labels,
        f"""SELECT {_CORPUS_SQL} || '_m' || CAST(doc_id AS VARCHAR) AS filename,
              CASE WHEN doc_id % 4 = 0 THEN 'spam' ELSE 'ham' END AS label
            FROM documents WHERE doc_id % 19 <> 0""",
    ),
    "a03_projected_scan": (
        lambda spark, sf: tables.read_columns(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"]),
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    ),
    "a13_ingest_summary": (
        _ingest,
        f"""SELECT {_CORPUS_SQL} AS corpus, count(*) FILTER (doc_id % 10 <> 7) AS files_stored,
              count(*) FILTER (doc_id % 10 = 7) AS errors FROM documents GROUP BY 1""",
    ),
    "b01_content_id": (
        lambda spark, sf: content_emails(spark, sf).select("doc_id", "email_id"),
        "SELECT doc_id, substr(sha256(text), 1, 16) AS email_id FROM documents",
    ),
    "b02_bodies": (
        lambda spark, sf: _decoded(spark, sf).select("doc_id", "text", "html"),
        "SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '<p>' || text || '</p>' END AS html FROM documents",
    ),
    "b03_headers": (
        _headers,
        """SELECT doc_id,
             'Sender ' || doc_id || ' <user' || doc_id || CASE WHEN doc_id % 41 = 0 THEN '' ELSE '@' || source || '.example' END || '>' AS sender_raw,
             'user' || doc_id || CASE WHEN doc_id % 41 = 0 THEN '' ELSE '@' || source || '.example' END AS sender_email,
             'reader@' || lang || '.example' AS recipient,
             CASE WHEN doc_id % 5 >= 3 THEN 'client' ELSE '' END AS x_mailer,
             CASE WHEN doc_id % 3 = 0 THEN 'multipart/alternative' ELSE 'text/plain' END AS content_type,
             '' AS message_id
           FROM documents""",
    ),
    "b04_sender_domain": (
        _domains,
        "SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN '' ELSE source || '.example' END AS sender_domain FROM documents",
    ),
    "b05_dates": (
        _dates,
        """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN
             CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) + doc_id * 37 * 60 - 7200 ELSE -1 END AS epoch FROM documents""",
    ),
    "b06_clipped_bodies": (
        _clip,
        """SELECT doc_id, left(text, 50000) AS body_text,
             CASE WHEN doc_id % 2 = 0 THEN nullif(left(text, 50000), '') END AS body_html FROM documents""",
    ),
    "b07_received_hops": (
        _hops,
        """SELECT doc_id, doc_id % 13 AS received_hop_count,
             coalesce(array_to_string(list_transform(range(1, least(doc_id % 13, 10) + 1), lambda i: 'from hop' || i), '|||'), '') AS received_hops
           FROM documents""",
    ),
    "b08_quarantine": (
        _quarantine,
        f"""SELECT '/raw/' || {_CORPUS_SQL} || '/' || {_NAME_SQL} AS path, 'no content' AS error
            FROM documents WHERE doc_id % 10 = 7""",
    ),
    "b09_parse_summary": (
        lambda spark, sf: mail.parse_summary(emails(spark, sf, html=False)),
        with_views(
            EMAILS_SQL,
            body="""SELECT count(*) AS total_emails, count(*) FILTER (label = 'spam') AS spam_count,
                      count(*) FILTER (label = 'ham') AS ham_count FROM emails""",
        ),
    ),
    "u01_parsed_messages": (
        lambda spark, sf: _parsed(spark, sf).select(
            "doc_id", "filename", "label", "sender_email", F.length("body_text").cast("long").alias("text_length"),
            F.length(F.coalesce("body_html", F.lit(""))).cast("long").alias("html_length"),
        ),
        f"""SELECT doc_id, {_CORPUS_SQL} || '_' || {_NAME_SQL} AS filename,
              CASE WHEN doc_id % 4 = 0 THEN 'spam' ELSE 'ham' END AS label,
              'user' || doc_id || CASE WHEN doc_id % 41 = 0 THEN '' ELSE '@' || source || '.example' END AS sender_email,
              CAST(least(length(text), 50000) AS BIGINT) AS text_length,
              CAST(CASE WHEN doc_id % 3 = 0 THEN least(length(text) + 7, 50000) ELSE 0 END AS BIGINT) AS html_length
            FROM documents""",
    ),
}
