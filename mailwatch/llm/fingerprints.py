"""Document fingerprints as a homomorphic multiset hash of paragraphs.

A paragraph hashes to a wide vector, and a text is the sum of its paragraphs' vectors. Sums do not
depend on order, and inserting or deleting a paragraph adds or subtracts its vector. The vector has two
parts: 1,024 lanes modulo 2^16 of an extendable hash of the paragraph, which decide equality, and 128
lanes modulo 2^32 that sum signs of its byte runs, whose angle tells how alike two texts are. No text
has room for the 2^31 runs with which such a lane would wrap.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_batches import few_rows, small
from .hashing import batches, byte_run_hashes, word_hashes

EQUAL, LIKE, RUN = 1024, 128, 8
#: A vector is held in 16-bit numbers, two (the low one first) for each lane of likeness.
WIDTH = EQUAL + 2 * LIKE
_FIRST = -(1 << 63)


def paragraphs(text: bytes | None) -> list[bytes]:
    """What stands between line feeds; a null or empty text has none."""
    return text.split(b"\n") if text else []


def states(texts: Sequence[Sequence[bytes]]) -> np.ndarray:
    """The vectors (texts, WIDTH) of texts given as lists of paragraphs."""
    out = np.zeros((len(texts), WIDTH), np.uint16)
    for i, text in enumerate(texts):
        # A very long text is summed in stretches.
        for at in range(0, len(text), 2048):
            drawn = b"".join(hashlib.shake_128(p).digest(2 * EQUAL) for p in text[at : at + 2048])
            out[i, :EQUAL] += np.frombuffer(drawn, "<u2").reshape(-1, EQUAL).sum(axis=0, dtype=np.uint16)
    joined = [b"\n".join(t) for t in texts]
    for start, end in batches(joined):
        hashes, owner = byte_run_hashes(joined[start:end], RUN, b"\n")
        small = [(i - start, p) for i in range(start, end) for p in texts[i] if 0 < len(p) < RUN]
        if small:
            more, _ = word_hashes([p for _, p in small], b"\n", lower=False)
            hashes = np.concatenate([hashes, more])
            owner = np.concatenate([owner, np.fromiter((i for i, _ in small), np.int64, len(small))])
        place = owner * LIKE + (hashes % np.uint64(LIKE)).astype(np.int64)
        sign = 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(np.float64)
        sums = np.bincount(place, weights=sign, minlength=(end - start) * LIKE)
        out[start:end, EQUAL:] = sums.astype("<i4").reshape(-1, LIKE).view("<u2")
    return out


def _lanes(state: np.ndarray) -> np.ndarray:
    """The lanes of likeness."""
    return np.ascontiguousarray(state[..., EQUAL:], "<u2").view("<i4")


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The vectors of a and b together."""
    return np.concatenate([a[..., :EQUAL] + b[..., :EQUAL], (_lanes(a) + _lanes(b)).view("<u2")], axis=-1)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The vectors of a without b."""
    return np.concatenate([a[..., :EQUAL] - b[..., :EQUAL], (_lanes(a) - _lanes(b)).view("<u2")], axis=-1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, how alike two texts are (0 to 1): 1 for equal vectors, else the cosine of their signed lanes."""
    x, y = (_lanes(v).astype(np.float64) if len(v) else np.zeros((0, LIKE)) for v in (a, b))
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = (x * y).sum(axis=1) / np.where(size > 0, size, 1)
    return np.where((a == b).all(axis=1), 1.0, np.clip(cosine, 0, 1))


def printed(state: np.ndarray) -> str:
    """A fingerprint as text: a digest of the equality lanes and the signed lanes themselves."""
    equal = hashlib.blake2b(state[:EQUAL].astype("<u2").tobytes(), digest_size=16).hexdigest()
    return equal + ":" + base64.b64encode(state[EQUAL:].astype("<u2").tobytes()).decode()


def fingerprinted(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, state, fingerprint) of every row; state is the vector as bytes, to be combined later. Null is an empty text."""
    given = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(parts, "_text"):
            found = states([paragraphs(t) for t in part.column("_text").cast(pa.binary()).to_pylist()])
            yield pa.record_batch(
                {
                    "_id": part.column("_id"), "state": pa.array([s.astype("<u2").tobytes() for s in found], pa.binary()),
                    "fingerprint": pa.array([printed(s) for s in found], pa.string()),
                }
            )

    kind = given.schema["_id"].dataType.simpleString()
    return given.mapInArrow(run, f"_id {kind}, state binary, fingerprint string").withColumnRenamed("_id", id)


def inserted(state: bytes, text: bytes) -> bytes:
    """The state with the paragraphs of text added."""
    return plus(np.frombuffer(state, "<u2"), states([paragraphs(text)])[0]).astype("<u2").tobytes()


def deleted(state: bytes, text: bytes) -> bytes:
    """The state with the paragraphs of text taken out."""
    return minus(np.frombuffer(state, "<u2"), states([paragraphs(text)])[0]).astype("<u2").tobytes()


def _neighbours(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(part, guest, key, id, text): ranges of ascending id, each followed by the rows that open the next range.

    The ranges start at ids that occur, so the row after the last one of a range is known: it is sent
    to both. The last range is followed by the rows of the smallest id. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id).cast("long"), F.lit(_FIRST)).alias("key"), F.col(id).alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    low, cuts = rows.agg(F.min("key"), F.percentile_approx("key", shares, max(10_000, 100 * parts))).first()
    starts = np.array(sorted({c for c in cuts or () if c > low}), np.int64)

    @F.pandas_udf("long")
    def place(key):
        """Twice the range of a key, and one more if the key opens it."""
        values = key.to_numpy()
        part = np.searchsorted(starts, values, side="right")
        opens = (part > 0) & (starts[np.maximum(part, 1) - 1] == values) if len(starts) else np.zeros(len(values), bool)
        return key.__class__(2 * part + opens)

    last = len(starts)
    rows = rows.withColumn("place", place("key"))
    part = F.shiftright("place", 1)
    targets = F.array(
        F.struct(part.alias("part"), F.lit(False).alias("guest")),
        F.when(F.col("place") % 2 == 1, F.struct((part - 1).alias("part"), F.lit(True).alias("guest"))),
        F.when(F.col("key") == F.lit(low), F.struct(F.lit(last).cast("long").alias("part"), F.lit(True).alias("guest"))),
    )
    sent = rows.select("key", "id", "text", F.explode(targets).alias("to")).where(F.col("to").isNotNull())
    sent = sent.select("to.part", "to.guest", "key", "id", "text")
    return sent.repartitionById(last + 1, F.col("part").cast("int")).sortWithinPartitions("part", "guest", "key", "text")


def edited_fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike neighbours in order of id are.

    The edited form has its last quarter (rounded down) replaced by the beginning of the next text; after
    the last comes the first. Its vector is that of the text less the paragraphs that go, plus those that
    come. Null is an empty text; rows without an id come first; rows that share an id are taken in order
    of text, and the next of the last such row is the smallest of the next id. Other columns are ignored.
    """
    ordered = _neighbours(docs, id, text)
    kind = ordered.schema["id"].dataType.simpleString()

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (part, guest, id, text, state) of the row before
        for batch in small(batches_, "text"):
            texts = [t.as_py() for t in batch.column("text")]
            own = states([paragraphs(t.encode()) for t in texts])
            places, guests = batch.column("part").to_pylist(), batch.column("guest").to_pylist()
            ids = batch.column("id")
            rows, nexts = [], []
            for i in range(len(texts)):
                now = (places[i], guests[i], ids[i], texts[i], own[i])
                if held is not None and not held[1] and held[0] == now[0]:
                    rows.append(held)
                    nexts.append(now)
                held = now
            if rows:
                yield _edited(rows, nexts)

    def _edited(rows: list, nexts: list) -> pa.RecordBatch:
        before = np.stack([r[4] for r in rows])
        after = np.stack([r[4] for r in nexts])
        texts, digests, gone, come = [], [], [], []
        for (_, _, _, t, _), (_, _, _, n, _) in zip(rows, nexts):
            q = len(t) // 4
            new = t[: len(t) - q] + n[:q]
            texts.append(t)
            digests.append(hashlib.sha256(new.encode()).hexdigest())
            # Paragraphs before the first changed one are the same in both.
            same = t.rfind("\n", 0, len(t) - q) + 1 if q else len(t)
            gone.append(t[same:].encode().split(b"\n") if t else [])
            come.append(new[same:].encode().split(b"\n") if t else [])
        edited = plus(minus(before, states(gone)), states(come))
        return pa.record_batch(
            {
                "id": pa.array([r[2].as_py() for r in rows], _arrow[kind] if kind in _arrow else None),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array(digests, pa.string()),
                "fingerprint": pa.array([printed(s) for s in before], pa.string()),
                "edited_fingerprint": pa.array([printed(s) for s in edited], pa.string()),
                "near_edited": pa.array(likeness(before, edited), pa.float64()),
                "near_next": pa.array(likeness(before, after), pa.float64()),
            }
        )

    _arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows(spark)
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
