"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on windows of a bounded sample
of labelled rows. It reads a text from both ends of each piece of fixed length and labels every byte;
the probabilities of all bytes of the whole text are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow_batches import few_rows, small

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageConfig:
    """per_language bounds the labelled rows used for the fit: about so many of each language, chosen by a
    hash of the id, each with one window of window characters at a place that the hash decides. hidden is
    the state size of either direction, piece the bytes read at once, steps and rate those of the training.
    """

    per_language: int = 1000
    window: int = 256
    hidden: int = 8
    piece: int = 128
    lanes: int = 2048
    steps: int = 500
    batch: int = 192
    unroll: int = 64
    rate: float = 0.02
    seed: int = 7


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _fold()
Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    np.add(x, 0.5, out=x)
    return x


def _run(w: Weights, side: str, xs: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction over xs (T, B), in the order in which it reads."""
    table, inner, bias = w[f"x{side}"], w[f"u{side}"], w[f"b{side}"]
    steps, lanes = xs.shape
    hidden = inner.shape[1]
    out = np.empty((steps, hidden, lanes), np.float32)
    h = np.zeros((hidden, lanes), np.float32)
    x = np.empty((3 * hidden, lanes), np.float32)
    u = np.empty((3 * hidden, lanes), np.float32)
    for t in range(steps):
        np.take(table, xs[t], axis=1, out=x, mode="clip")
        np.dot(inner, h, out=u)
        u += bias
        gates = _sigmoid(x[: 2 * hidden] + u[: 2 * hidden])
        z, r = gates[:hidden], gates[hidden:]
        n = np.tanh(x[2 * hidden :] + r * u[2 * hidden :])
        if keep is not None:
            keep.append((h, z, r, n, u[2 * hidden :].copy()))
        h = np.add(n, z * (h - n), out=out[t])
    return out


def _probabilities(w: Weights, xs: np.ndarray) -> np.ndarray:
    """Language probabilities (T, C, B) of every byte of xs (T, B)."""
    forward = _run(w, "f", xs)
    backward = _run(w, "b", xs[::-1])[::-1]
    logits = np.matmul(w["of"], forward)
    logits += np.matmul(w["ob"], backward)
    logits += w["o"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _start(classes: int, c: LanguageConfig) -> Weights:
    rng = np.random.default_rng(c.seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    w: Weights = {"o": np.zeros((classes, 1), np.float32)}
    for s in "fb":
        w[f"x{s}"] = draw(3 * c.hidden, 256, scale=0.5)
        w[f"u{s}"] = draw(3 * c.hidden, c.hidden, scale=c.hidden**-0.5)
        w[f"b{s}"] = np.zeros((3 * c.hidden, 1), np.float32)
        w[f"b{s}"][: c.hidden] = 1.0
        w[f"o{s}"] = draw(classes, c.hidden, scale=c.hidden**-0.5)
    return w


def _back(w: Weights, side: str, xs: np.ndarray, kept: list, grad: np.ndarray) -> Weights:
    """Gradients of one direction, from those of its states (T, H, B), by backpropagation through time."""
    inner = w[f"u{side}"]
    hidden = inner.shape[1]
    steps, lanes = xs.shape
    d_inner, d_bias = np.zeros_like(inner), np.zeros_like(w[f"b{side}"])
    d_in = np.empty((steps, 3 * hidden, lanes), np.float32)
    carry = np.zeros((hidden, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, u = kept[t]
        d = grad[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        a = np.concatenate([dz, dr, dn * r])
        d_inner += a @ h.T
        d_bias += a.sum(axis=1, keepdims=True)
        carry = d * z + inner.T @ a
        d_in[t] = np.concatenate([dz, dr, dn])
    flat, rows = xs.ravel(), d_in.transpose(1, 0, 2).reshape(3 * hidden, -1)
    d_table = np.stack([np.bincount(flat, weights=row, minlength=256) for row in rows]).astype(np.float32)
    return {f"x{side}": d_table, f"u{side}": d_inner, f"b{side}": d_bias}


def train(texts: Sequence[bytes], labels: Sequence[int], classes: int, c: LanguageConfig = LanguageConfig()) -> Weights:
    """Weights fitted to texts with labels 0 … classes - 1; each language is drawn equally often."""
    w = _start(classes, c)
    rng = np.random.default_rng(c.seed + 1)
    by = [[i for i, y in enumerate(labels) if y == k] for k in range(classes)]
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    spread = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, c.steps + 1):
        wanted = rng.integers(classes, size=c.batch)
        # Every third window is cut short, as the last piece of a text is; zeros fill it up and do not count.
        xs = np.zeros((c.batch, c.unroll), np.uint8)
        sizes = np.where(rng.random(c.batch) < 1 / 3, rng.integers(4, c.unroll, c.batch), c.unroll)
        for row, k in enumerate(wanted):
            text = texts[by[k][rng.integers(len(by[k]))]]
            at = rng.integers(max(1, len(text) - c.unroll + 1))
            part = np.frombuffer(text[at : at + sizes[row]], np.uint8)
            xs[row, : len(part)] = part
        xs = np.ascontiguousarray(_LOWER[xs].T)
        kept_f: list = []
        kept_b: list = []
        forward = _run(w, "f", xs, kept_f)
        backward = _run(w, "b", xs[::-1], kept_b)
        logits = np.matmul(w["of"], forward) + np.matmul(w["ob"], backward[::-1]) + w["o"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[:, wanted, np.arange(c.batch)] -= 1
        # Each window counts alike, however short.
        p *= (xs != 0)[:, None, :]
        p /= np.maximum((xs != 0).sum(axis=0), 1) * c.batch
        grads: Weights = {"o": p.sum(axis=(0, 2))[:, None]}
        grads["of"] = np.einsum("tcb,thb->ch", p, forward, optimize=True)
        grads["ob"] = np.einsum("tcb,thb->ch", p, backward[::-1], optimize=True)
        grads |= _back(w, "f", xs, kept_f, np.matmul(w["of"].T, p))
        grads |= _back(w, "b", np.ascontiguousarray(xs[::-1]), kept_b, np.matmul(w["ob"].T, p)[::-1])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / max(size, 1e-9))
        rate = c.rate * min(1.0, step / 20) * (1 - 0.9 * step / c.steps)
        for k, g in grads.items():
            g = g * scale
            mean[k] = 0.9 * mean[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            w[k] = (
                w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)
            ).astype(np.float32)
    return w


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: Weights
    config: LanguageConfig

    def pooled(self, texts: Sequence[bytes | None]) -> np.ndarray:
        """Mean language probabilities (texts, languages) over all bytes of each text; zeros without bytes."""
        c = self.config
        sums = np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        waiting = 0

        def flush() -> None:
            rows, owner = np.concatenate(held), np.concatenate(owners)
            for i in range(0, len(rows), c.lanes):
                part, own = rows[i : i + c.lanes], owner[i : i + c.lanes]
                p = _probabilities(self.weights, np.ascontiguousarray(part.T))
                p *= (part.T != 0)[:, None, :]
                totals = p.sum(axis=0)
                for k in range(len(self.languages)):
                    sums[:, k] += np.bincount(own, weights=totals[k], minlength=len(texts))
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            n = -(-len(text) // c.piece)
            rows = np.zeros(n * c.piece, np.uint8)
            rows[: len(text)] = _LOWER[np.frombuffer(text, np.uint8)]
            held.append(rows.reshape(n, c.piece))
            owners.append(np.full(n, i))
            waiting += n
            if waiting >= c.lanes:
                flush()
                waiting = 0
        if held:
            flush()
        total = sums.sum(axis=1, keepdims=True)
        return sums / np.where(total > 0, total, 1)


def sample(labelled: DataFrame, id: str, text: str, lang: str, c: LanguageConfig = LanguageConfig()) -> DataFrame:
    """(lang, id, text): the windows that the fit sees, at most ``per_language`` of each language.

    Rows are ordered by a hash of id and text, and the first ones of each language are taken; rows that agree in both (with a null
    id, in the text) count once, so neither repeated rows nor a repeated id can fill the sample or exceed it.
    """
    rows = labelled.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("id", "text", F.lit(c.seed)))
    # Only what may be among the first is shuffled: about four times as many rows, which is short of none.
    sizes = rows.groupBy("lang").agg(F.least(F.lit(1.0), 4.0 * c.per_language / F.approx_count_distinct("h")).alias("share"))
    draw = F.shiftrightunsigned("h", 11) * F.lit(2.0**-53)
    room = F.greatest(F.length("text") - c.window, F.lit(0)) + 1
    at = F.pmod(F.xxhash64("h", F.lit(c.seed + 1)), room.cast("long")) + 1
    # One row a language.
    drawn = rows.join(F.broadcast(sizes), "lang").where(draw < F.col("share"))
    cut = drawn.select("lang", "id", "h", F.col("text").substr(at.cast("int"), F.lit(c.window)).alias("text"))
    once = cut.groupBy("lang", "h").agg(F.min(F.struct("id", "text")).alias("x")).select("lang", "h", "x.id", "x.text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h"))
    return once.withColumn("place", place).where(F.col("place") <= c.per_language).select("lang", "id", "text")


def fit(labelled: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Train on a bounded sample of the rows that have a language and a letter; ties do not matter."""
    rows = sorted((r["lang"], r["id"] or "", r["text"]) for r in sample(labelled, id, text, lang, config).collect())
    languages = tuple(sorted({r[0] for r in rows}))
    place = {name: k for k, name in enumerate(languages)}
    if not languages:
        return LanguageModel((), {}, config)
    weights = train([r[2].encode() for r in rows], [place[r[0]] for r in rows], len(languages), config)
    return LanguageModel(languages, weights, config)


def identified(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in keep with lang_pred and score (the pooled probability of that language).

    A text that is null or has no letter is `und` with score 0, and so is every text when no language
    was learned. Whole texts are read, in pieces; no row is dropped. Other columns are left behind.
    """
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("keep names a column that the result adds")
    letters = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_text")
    given = docs.select(*[F.col(k) for k in keep], letters)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text")
    names = np.array([*model.languages, UNDETERMINED])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(parts, "_text"):
            texts = part.column("_text").cast(pa.binary()).to_pylist()
            if model.languages:
                p = model.pooled(texts)
                best = p.argmax(axis=1)
                score = p[np.arange(len(p)), best] if len(p) else np.zeros(0)
                best = np.where(score > 0, best, len(model.languages))
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            columns = {k: part.column(k) for k in keep}
            columns["lang_pred"] = pa.array(names[best].tolist(), pa.string())
            columns["score"] = pa.array(np.clip(score, 0, 1), pa.float64())
            yield pa.record_batch(columns)

    return given.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id: Column | str) -> Column:
    """Whether a document is kept from the training: crc32 of its id as text, modulo 4, is 2."""
    id = F.col(id) if isinstance(id, str) else id
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id")))
    found = identified(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
