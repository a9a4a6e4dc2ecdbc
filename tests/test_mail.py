from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

import pyarrow as pa

from mailwatch.sources import mail

MULTI = (
    b"From: Ann <ann1@Shop.example>\nTo: bob@x.example\nSubject: Hi\nDate: Mon, 01 Jan 2024 10:00:00 +0200\n"
    b"X-Mailer: m\n" + b"".join(b"Received: hop%d\n" % i for i in range(12))
    + b'MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="B"\n\n'
    b"--B\nContent-Type: text/plain\n\none\n--B\nContent-Type: text/html\n\n<p>1</p>\n"
    b"--B\nContent-Type: text/plain\n\ntwo\n--B\nContent-Type: text/html\n\n<p>2</p>\n--B--\n"
)
CHARSET = b"From: c\nContent-Type: text/plain; charset=no-such\nDate: never\n\nh\xc3\xa9llo \xff"
BARE = b"\njust text"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("mail")
    for corpus, name, content in [
        ("spam_2", "m1", MULTI), ("easy_ham", "m2", CHARSET), ("hard_ham", "m3", BARE), ("easy_ham", ".hidden", BARE),
        ("easy_ham", "m4", BARE),
    ]:
        (root / corpus).mkdir(exist_ok=True)
        (root / corpus / name).write_bytes(content)
    return str(root)


@pytest.fixture(scope="module")
def parsed(spark, raw):
    rows = mail.to_emails(mail.decode_messages(mail.scan_messages(spark, raw))).collect()
    return {r["filename"]: r for r in rows}


def test_scan_skips_hidden_and_labels_by_corpus(parsed):
    assert set(parsed) == {"spam_2_m1", "easy_ham_m2", "hard_ham_m3", "easy_ham_m4"}
    assert parsed["spam_2_m1"]["label"] == "spam" and parsed["hard_ham_m3"]["label"] == "ham"


def test_multipart(parsed):
    m = parsed["spam_2_m1"]
    assert m["body_text"] == "onetwo" and m["body_html"] == "<p>2</p>"
    assert (m["sender_email"], m["sender_domain"], m["recipient"]) == ("ann1@Shop.example", "Shop.example", "bob@x.example")
    assert m["received_hop_count"] == 12 and len(m["received_hops"]) == 10
    assert m["content_type"] == "multipart/mixed" and m["x_mailer"] == "m"


def test_dates_in_utc(spark, raw):
    df = mail.to_emails(mail.decode_messages(mail.scan_messages(spark, raw)))
    hours = {r["filename"]: r["h"] for r in df.select("filename", F.hour("date").alias("h")).collect()}
    assert hours["spam_2_m1"] == 8 and hours["easy_ham_m2"] is None


def test_unknown_charset_and_missing_headers(parsed):
    c, b = parsed["easy_ham_m2"], parsed["hard_ham_m3"]
    assert c["body_text"] == "héllo �" and c["body_html"] is None
    assert b["body_text"] == "just text" and b["subject"] == b["sender_email"] == b["sender_domain"] == b["message_id"] == ""
    assert b["email_id"] == parsed["easy_ham_m4"]["email_id"] != c["email_id"] and len(b["email_id"]) == 16


def test_quarantine_and_summary(spark):
    rows = [("/r/spam_1/a", bytearray(MULTI)), ("/r/spam_1/b", None), ("/r/ham_1/c", bytearray(BARE))]
    decoded = mail.decode_messages(spark.createDataFrame(rows, "path string, content binary"))
    assert [r["path"] for r in mail.quarantine(decoded).collect()] == ["/r/spam_1/b"]
    summary = {r["corpus"]: (r["files_stored"], r["errors"]) for r in mail.ingest_summary(decoded).collect()}
    assert summary == {"spam_1": (1, 1), "ham_1": (1, 0)}
    assert tuple(mail.parse_summary(mail.to_emails(decoded)).first()) == (2, 1, 1)


def test_long_body_is_stored_clipped(spark):
    msg = EmailMessage()
    msg.set_content("x" * 60_000)
    df = spark.createDataFrame([("/r/ham/a", bytearray(msg.as_bytes()))], "path string, content binary")
    row = mail.joined_hops(mail.to_emails(mail.decode_messages(df))).first()
    assert len(row["body_text"]) == 50_000 and row["received_hops"] == ""


def test_messages_reach_python_in_small_batches(spark):
    """In a session with Spark's own settings, too; and a batch is decoded a few messages at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = [(f"/raw/ham/m{i}", bytearray(b"Subject: s\n\n" + b"x" * i)) for i in range(1200)]
        decoded = mail.decode_messages(spark.createDataFrame(rows, "path string, content binary").coalesce(1))
        assert spark.conf.get(key) == "500"
        assert decoded.selectExpr("sum(length(text))", "count(date)").first() == (sum(range(1200)), 0)
    finally:
        spark.conf.set(key, had)
    batch = pa.record_batch([pa.array(["a", "b", "c", "d"]), pa.array([b"123", b"45", None, b"6789"], pa.binary())], names=["path", "content"])
    assert [p.num_rows for p in mail._slices(batch, 4)] == [1, 2, 1]
    assert [p.num_rows for out in (mail._decoder(4)([batch]),) for p in out] == [1, 2, 1]
