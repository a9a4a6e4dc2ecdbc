"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of a text brought to a plain form: words with A-Z lower-cased, a space after each,
and one end symbol. Contexts are up to depth bytes long. The counts of all runs of depth + 1 bytes of
the whole training corpus are summed in Spark; from them every context that occurs often enough is
compared with the one a byte shorter, and kept where its next-symbol distribution diverges. A text is
scored by the longest kept suffix at each byte, whose distribution is smoothed with that of its own
suffixes. The unigram base of words is computed beside it.

States and their cells stay tables, which grow with the input. Frequent runs go to all tasks with their
log probability; the others are gathered by groups of partitions of texts, looked up by joins, and laid
into one file a group in the shared folder, from which the texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_batches import few_rows, small
from .binary_files import make_folder, opened, whole_file
from .hashing import BLANKS, batches, word_hashes
from .scratch import drop, new_folder, stored

_END_BYTE = 10
#: Stands for the end token among the hashes of words.
_END_WORD = -(1 << 63) + 1
_FULL = (1 << 64) - 1
#: Bytes of text that a task works on at once; numpy holds some 60 bytes for each.
_SLICE = 1 << 20
#: Runs in one row of a partition's runs, the bits of a row number below its partition, and training symbols for each group.
_HELD, _ROW_BITS, _GROUP = 10_000, 33, 1 << 24
_FILED = np.dtype([("key", "<i8"), ("log", "<f4")])


@dataclass(frozen=True)
class SuffixConfig:
    """depth: bytes of the longest context (7 at most). share: a run or word with less than this share of
    all occurrences is looked up by a join, not in the tables that go to all tasks, which bounds each of
    these by 1 / share rows; counts, states and scores do not depend on it. least: occurrences that a
    context needs. gain: nats by which a kept context must shorten the training text against its suffix.
    """

    depth: int = 5
    share: float = 2e-6
    least: int = 16
    gain: float = 12.0


def plain(texts: Sequence[bytes | None], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The plain forms one after another, depth end bytes before each; places of scored bytes; edges of texts among these."""
    pad = bytes([_END_BYTE]) * depth
    joined = b"".join([pad, *(x for t in texts for x in (t or b"", b" ", pad))])
    buffer = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter((len(t or b"") + 1 + depth for t in texts), np.int64, len(texts))
    ends = depth + np.cumsum(sizes)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    gap = blank[buffer]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    out = lower[buffer]
    out[gap] = 32
    for k in range(depth):
        at = ends - depth + k
        keep[at], out[at] = True, _END_BYTE
    keep[:depth], out[:depth] = True, _END_BYTE
    scored = keep.copy()
    scored[:depth] = False
    for k in range(1, depth):
        scored[ends - depth + k] = False
    place = np.cumsum(keep) - 1
    edges = np.concatenate([[0], np.cumsum(scored)[ends - 1]]) if len(texts) else np.zeros(1, np.int64)
    return out[keep], place[scored], edges


def runs(form: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The byte at each place (lowest) with the depth bytes before it, nearest first, as one number."""
    wide = form.astype(np.uint64)
    keys = np.zeros(len(places), np.uint64)
    for k in range(depth + 1):
        keys |= wide[places - k] << np.uint64(8 * k)
    return keys


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class _Sum:
    """Counts by key, merged whenever they have grown."""

    def __init__(self) -> None:
        self.keys, self.counts, self.more, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.more.append((found, n))
        self.waiting += len(found)
        if self.waiting > max(500_000, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([self.keys, *(k for k, _ in self.more)])
        counts = np.concatenate([self.counts, *(n for _, n in self.more)])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.more, self.waiting = [], 0
        return self.keys, self.counts


def _gathered(config: SuffixConfig):
    """(kind, key, n): counts of byte runs (kind 0) and of words with the end token (kind 1) of one task's texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (_Sum(), _Sum())
        docs = 0
        for part in small(parts, "text"):
            texts = _bytes(part.column("text"))
            docs += len(texts)
            for a, b in batches(texts, _SLICE):
                form, places, _ = plain(texts[a:b], config.depth)
                sums[0].add(runs(form, places, config.depth).view(np.int64))
                sums[1].add(word_hashes(texts[a:b])[0].view(np.int64))
        for kind, s in enumerate(sums):
            keys, counts = s.merge()
            if kind and docs:
                keys, counts = np.append(keys, _END_WORD), np.append(counts, docs)
            for i in range(0, len(keys), 100_000):
                k, n = keys[i : i + 100_000], counts[i : i + 100_000]
                yield pa.record_batch({"kind": pa.array(np.full(len(k), kind, np.int32)), "key": pa.array(k), "n": pa.array(n)})

    return run


def _low(key: Column, symbols: Column | int) -> Column:
    """The lowest bytes of a key."""
    bits = (symbols if isinstance(symbols, Column) else F.lit(symbols)) * 8
    return key.bitwiseAND(F.when(bits >= 64, F.lit(-1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1))


def states(counts: DataFrame, config: SuffixConfig) -> tuple[DataFrame, DataFrame]:
    """The kept states (d, context, rest) and their cells (d, key, part) from counts (key, n) of byte runs.

    A state gives its next symbol rest times the probability of the state a byte shorter, plus part if
    the symbol was seen after it (interpolation by the number of different symbols).
    """
    # Counts of shorter runs are sums of those one byte longer, so the long runs are read once.
    level, levels = counts.select("key", "n"), []
    for d in range(config.depth, -1, -1):
        if d < config.depth:
            level = level.groupBy(_low(F.col("key"), d + 1).alias("key")).agg(F.sum("n").alias("n"))
        # A context has at most 256 next symbols.
        nodes = level.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(
            F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), F.collect_list(F.struct("key", "n")).alias("seen")
        )
        levels.append(nodes.where(F.col("all") >= (config.least if d else 0)).select(F.lit(d).alias("d"), "*"))
    # As many files as a shuffle has partitions, not as many for each depth.
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contexts, folder = stored(reduce(DataFrame.unionByName, levels).coalesce(parts), "contexts")
    own = contexts.select("d", "context", "all", F.inline("seen"))
    above = own.select(
        (F.col("d") + 1).alias("d"), F.col("key").alias("near"), F.col("n").alias("n_above"), F.col("all").alias("all_above")
    )
    ratio = F.col("n") * F.log(F.col("n") * F.col("all_above") / (F.col("all") * F.col("n_above")))
    gains = (
        own.where("d > 0").withColumn("near", _low(F.col("key"), F.col("d"))).join(above, ["d", "near"])
        .groupBy("d", "context").agg(F.sum(ratio).alias("gain"))
    )
    diverging = gains.where(F.col("gain") >= config.gain).select("d", "context")
    # Suffixes of a kept context are states too, and the empty context always is.
    closed = diverging.select(F.explode(F.sequence(F.lit(1), F.col("d"))).alias("to"), "context").select(
        F.col("to").alias("d"), _low(F.col("context"), F.col("to")).alias("context")
    )
    root = contexts.where("d = 0").select("d", "context")
    weight = F.col("all") + F.col("kinds")
    kept, _ = stored(closed.unionByName(root).distinct().join(contexts, ["d", "context"]), "states")
    cells = kept.withColumn("weight", weight).select("d", "weight", F.inline("seen"))
    cells, _ = stored(cells.select("d", "key", (F.col("n") / F.col("weight")).alias("part")), "cells")
    drop(counts.sparkSession, folder)
    return kept.select("d", "context", (F.col("kinds") / weight).alias("rest")), cells


def logs(given: DataFrame, kept: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """(key, log) of the distinct runs of given (key): log10 probability of the last byte after the others."""
    found = None
    for d in range(depth + 1):
        here = given.select(_low(F.col("key"), d + 1).alias("key")).distinct()
        here = here.join(cells.where(F.col("d") == d).select("key", "part"), "key", "left")
        here = here.withColumn("context", F.shiftrightunsigned("key", 8))
        here = here.join(kept.where(F.col("d") == d).select("context", "rest"), "context", "left")
        if found is None:
            here = here.withColumn("before", F.lit(1 / 256))
        else:
            above = found.select(F.col("key").alias("near"), F.col("p").alias("before"))
            here = here.withColumn("near", _low(F.col("key"), d)).join(above, "near")
        own = F.col("rest") * F.col("before") + F.coalesce("part", F.lit(0.0))
        found = here.select("key", F.when(F.col("rest").isNull(), F.col("before")).otherwise(own).alias("p"))
    return found.select("key", F.log10("p").alias("log"))


class _Table:
    """Values by key for the most frequent keys: two direct-mapped tables; what they miss is told."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 4):
        bits = max(10, int(room * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.parts = []
        left = np.arange(len(keys))
        for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            k, v = np.full(1 << bits, _FULL, np.uint64), np.zeros(1 << bits, np.float32)
            at = self._at(keys[left], factor)
            k[at], v[at] = keys[left], values[left]
            self.parts.append((factor, k, v))
            left = left[k[at] != keys[left]]

    def _at(self, keys: np.ndarray, factor: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(factor)) >> self.shift

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, missed = np.zeros(len(keys)), np.arange(len(keys))
        for factor, k, v in self.parts:
            at = self._at(keys[missed], factor)
            hit = k[at] == keys[missed]
            out[missed[hit]] = v[at[hit]]
            missed = missed[~hit]
        return out, missed


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys).clip(0, len(table) - 1)
    return at, table[at] == keys


def _lists(values: np.ndarray, chosen: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The chosen values of each text, whose edges among all values are ends."""
    left = np.concatenate([[0], np.cumsum(chosen)])[ends]
    return pa.ListArray.from_arrays(pa.array(left - left[0], pa.int32()), pa.array(values[chosen]))


@dataclass(frozen=True)
class _Hot:
    """What goes to all tasks: frequent runs with their log10 probabilities, and frequent words with their counts."""

    depth: int
    runs: np.ndarray
    logs: np.ndarray
    words: np.ndarray
    counts: np.ndarray


@dataclass(frozen=True)
class SuffixModel:
    """A fitted tree as tables of states (d, context, rest) and cells (d, key, part), with its frequent part."""

    states: DataFrame
    cells: DataFrame
    hot: _Hot
    tokens: int
    kinds: int
    symbols: int

    def logs(self, given: DataFrame) -> DataFrame:
        return logs(given, self.states, self.cells, self.hot.depth)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each run after the others, for a few runs."""
        given = self.states.sparkSession.createDataFrame([(k,) for k in keys.view(np.int64).tolist()], "key long")
        found = dict(self.logs(given).collect())
        return np.array([found[k] for k in keys.view(np.int64).tolist()])


def fit(docs: DataFrame, *, text: str = "text", config: SuffixConfig = SuffixConfig()) -> tuple[SuffixModel, DataFrame]:
    """The model of all texts of docs, and the counts (key, n) of all their words; null counts as an empty text."""
    given = docs.select(F.col(text).cast("string").alias("text"))
    found = given.mapInArrow(_gathered(config), "kind int, key long, n long")
    counts, _ = stored(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    sizes = {r["kind"]: (r["rows"], r["n"]) for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    grams, words = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    (_, symbols), (kinds, tokens) = sizes.get(0, (0, 0)), sizes.get(1, (0, 0))
    kept, cells = states(grams, config)
    # Of frequent runs and words there are at most 1 / share.
    often = logs(grams.where(F.col("n") >= config.share * symbols).select("key"), kept, cells, config.depth).toArrow()
    hot = words.where(F.col("n") >= config.share * tokens).toArrow()
    hot_words, hot_counts = hot.column("key").to_numpy(), hot.column("n").to_numpy()
    order = np.argsort(hot_words)
    table = _Hot(
        config.depth, often.column("key").to_numpy().view(np.uint64), often.column("log").to_numpy(), hot_words[order], hot_counts[order]
    )
    return SuffixModel(kept, cells, table, int(tokens), int(kinds), int(symbols)), words


def _missed(sent, groups: int):
    """(chunk, keys): the distinct runs of a partition of texts that the frequent ones leave out, some in each row; chunk is its group."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        table, sums, chunk = _Table(hot.runs, hot.logs), _Sum(), 0
        for part in small(parts, "text"):
            texts = _bytes(part.column("text"))
            chunk = (part.column("row")[0].as_py() >> _ROW_BITS) % groups
            for a, b in batches(texts, _SLICE):
                form, places, _ = plain(texts[a:b], hot.depth)
                keys = runs(form, places, hot.depth)
                sums.add(keys[table.find(keys)[1]].view(np.int64))
        keys, _ = sums.merge()
        for i in range(0, len(keys), _HELD):
            held = keys[i : i + _HELD]
            yield pa.record_batch(
                {"chunk": pa.array([chunk], pa.int32()), "keys": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(held))}
            )

    return run


def _filed(folder: str):
    """Writes rows (chunk, key, log), in order of chunk and key, to one file a chunk; (chunk, n) tells what was written."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def put() -> pa.RecordBatch:
            rows = np.concatenate(held)
            with whole_file(f"{folder}/{at}") as out:
                out.write(rows.tobytes())
            return pa.record_batch({"chunk": pa.array([at], pa.int32()), "n": pa.array([len(rows)], pa.int64())})

        for part in parts:
            chunks = part.column("chunk").to_numpy()
            rows = np.empty(len(chunks), _FILED)
            rows["key"], rows["log"] = part.column("key").to_numpy(), part.column("log").to_numpy()
            for chunk in np.unique(chunks).tolist():
                if at is not None and chunk != at:
                    yield put()
                    held = []
                at = chunk
                held.append(rows[chunks == chunk])
        if held:
            yield put()

    return run


def _chunk(folder: str, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of a group with their logs; none where it has no file."""
    system, path = opened(f"{folder}/{chunk}")
    if not system.get_file_info(path).is_file:
        return np.empty(0, np.int64), np.empty(0)
    with system.open_input_file(path) as f:
        rows = np.frombuffer(f.read(), _FILED)
    return np.ascontiguousarray(rows["key"]), rows["log"].astype(np.float64)


def scored(docs: DataFrame, model: SuffixModel, words: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, base_score, score.

    Tokens are the words and one end. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))); score is the log10
    probability of the text under the tree. A null or empty text is the end alone. Rows that share an
    id are scored apart. Other columns are ignored. Texts are read twice; what the first reading did
    not see in the same group of partitions is looked up apart.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.hot)
    scale = model.tokens + 0.5 * (model.kinds + 1)
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()

    folder = new_folder(spark, "runs")
    make_folder(folder)
    groups = max(1, model.symbols // _GROUP)
    missed = given.mapInArrow(_missed(sent, groups), "chunk int, keys array<long>")
    each = missed.select("chunk", F.explode("keys").alias("key")).groupBy("key").agg(F.collect_set("chunk").alias("chunks"))
    each, seldom_runs = stored(each, "seldom")
    laid = each.join(model.logs(each), "key").select(F.explode("chunks").alias("chunk"), "key", F.col("log").cast("float").alias("log"))
    laid.repartition("chunk").sortWithinPartitions("chunk", "key").mapInArrow(_filed(folder), "chunk int, n long").count()
    drop(spark, seldom_runs)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        table, chunk, seldom, seldom_logs, near = _Table(hot.runs, hot.logs), None, None, None, None
        for part in small(parts, "text"):
            texts = _bytes(part.column("text"))
            now = (part.column("row")[0].as_py() >> _ROW_BITS) % groups
            if now != chunk:
                chunk, (seldom, seldom_logs) = now, _chunk(folder, now)
                near = _Table(seldom.view(np.uint64), seldom_logs, 2)
            n_tokens, known, base, score, rare, other = [], [], [], [], [], []
            for a, b in batches(texts, _SLICE):
                form, places, edges = plain(texts[a:b], hot.depth)
                keys = runs(form, places, hot.depth)
                logs, missed = table.find(keys)
                logs[missed], left = near.find(keys[missed])
                missed = missed[left]
                at, met = _find(seldom, keys[missed].view(np.int64))
                logs[missed[met]] = seldom_logs[at[met]]
                strange = np.zeros(len(keys), bool)
                strange[missed[~met]] = True
                other.append(_lists(keys.view(np.int64), strange, edges))
                score.append(np.add.reduceat(logs, edges[:-1]) if len(logs) else np.zeros(b - a))
                hashes, ends = word_hashes(texts[a:b])
                # The end token comes after the words of its text.
                hashes = np.insert(hashes.view(np.int64), ends[1:], _END_WORD)
                ends = ends + np.arange(len(ends))
                at, often = _find(hot.words, hashes)
                c = hot.counts[at] if len(hot.counts) else np.zeros(len(at))
                value = np.where(often, np.log10((np.where(often, c, 0) + 0.5) / scale), 0.0)
                n_tokens.append(np.diff(ends))
                known.append(np.add.reduceat(often.astype(np.int64), ends[:-1]))
                base.append(np.add.reduceat(value, ends[:-1]))
                rare.append(_lists(hashes, ~often, ends))
            join = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
            yield pa.record_batch(
                {
                    "row": part.column("row"), "id": part.column("id"), "n_tokens": join(n_tokens, pa.int64()),
                    "known": join(known, pa.int64()), "base": join(base, pa.float64()), "score": join(score, pa.float64()),
                    "rare": pa.concat_arrays(rare), "other": pa.concat_arrays(other),
                }
            )

    schema = f"row long, id {kind}, n_tokens long, known long, base double, score double, rare array<long>, other array<long>"
    rows, _ = stored(given.mapInArrow(run, schema), "scores")
    seen = words.select(F.col("key").alias("word"), "n")
    value = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(scale))
    rest = (
        rows.select("row", F.explode("rare").alias("word"))
        .join(seen, "word", "left")
        .groupBy("row")
        .agg(F.sum(value).alias("rare_base"), F.count("n").alias("rare_known"))
    )
    # None, where both readings of docs were partitioned alike.
    apart = rows.select("row", F.explode("other").alias("key"))
    if not apart.isEmpty():
        apart = apart.join(model.logs(apart.select("key")), "key")
        rows = rows.join(apart.groupBy("row").agg(F.sum("log").alias("more")), "row", "left")
        rows = rows.withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return rows.drop("rare", "other").join(rest, "row", "left").select(
        F.col("id").alias(id), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )


def held_out(id: Column | str) -> Column:
    """Whether a document is kept from the training: crc32 of its id as text, modulo 5, is 1."""
    id = F.col(id) if isinstance(id, str) else id
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, words = fit(docs.where(~held_out("doc_id")))
    found = scored(docs, model, words)
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
