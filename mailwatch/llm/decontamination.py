"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame functions only.

Every benchmark window is a set of word shingles that a contaminated text must hold in full, so its
rarest shingle alone is a necessary prefix. One pass over the texts keeps the places of shingles that
occur in the benchmark at all (a bit set of bounded size tells most others at once) with the words
around them. Their counts over the whole corpus order the shingles of each window by rarity; only
places of a window's rarest shingle are joined, bounded by position and length, and compared word by
word with the window. Texts are read once and never shuffled. Long texts are cut into overlapping segments,
so what is kept around the places of one row is bounded however much of a text is hit.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import pinned

#: What separates words, once A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHINGLE = 3
_MOST_BITS = 1 << 24
_SENT = 100_000
#: Words of a segment; the next one begins a window less a word before its end.
_SEGMENT = 4096


def words(text: Column | str) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, GAPS), "")


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + F.lit(j)) for j in range(size)])


def windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct windows (words, items): size consecutive words, or all words of a shorter item; items names those with an id."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    every = items.select("item", "w", F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    cut = every.select("item", F.slice("w", F.col("at") + 1, length).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def _probes(value: Column, size: int) -> list[Column]:
    """Three places of a hash in a bit set; bits of the hash that hardly overlap decide them."""
    return [F.shiftrightunsigned(value, n).bitwiseAND(F.lit(size - 1)) for n in (0, 20, 40)]


@dataclass(frozen=True)
class _Bits:
    """A bit set over hashes, held in plans as one literal of at most 2 MB; it errs on the safe side only."""

    size: int
    words: tuple[int, ...]

    def test(self, value: Column) -> Column:
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        tests = [
            F.getbit(F.element_at(bits, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63))) == 1
            for p in _probes(value, self.size)
        ]
        return tests[0] & tests[1] & tests[2]


def _bits(shingles: DataFrame) -> _Bits:
    distinct = shingles.select("h").distinct()
    size = min(_MOST_BITS, 1 << max(12, (64 * distinct.count()).bit_length()))
    rows = (
        distinct.select(F.explode(F.array(*_probes(F.col("h"), size))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits"))
        .collect()
    )
    table = [0] * (size // 64)
    for r in rows:
        table[r["at"]] = r["bits"]
    return _Bits(size, tuple(table))


def _places(w: Column, size: int, around: int, bits: _Bits) -> Column:
    """Places in a word list where a shingle of the benchmark seems to stand, with the words around them."""
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        F.filter(starts, lambda i: bits.test(_hash(w, i, size))),
        lambda i: F.struct(
            i.alias("p"), _hash(w, i, size).alias("h"), F.least(i, F.lit(around)).alias("back"),
            F.slice(w, F.greatest(i - around, F.lit(0)) + 1, F.lit(2 * around + 1)).alias("near"),
        ),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 13,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit (words inside an occurring window), spans, items.

    spans are the (start, end) word ranges of occurring windows, sorted; items the ids of their
    benchmark items, as sorted strings. A null or empty text has no words; items without words match
    nothing, those without an id are marked but not named; an empty benchmark marks nothing. Rows that share an id are judged
    apart. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    targets = pinned(windows(benchmark, item, item_text, window))
    windows_found = targets.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    size = F.least(F.size("words"), F.lit(_SHINGLE))
    places = targets.withColumn("k", size).select(
        "words", "items", "k", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))).alias("j")
    )
    by_size = F.coalesce(*[F.when(F.col("k") == s, _hash(F.col("words"), F.col("j"), s)) for s in range(1, _SHINGLE + 1)])
    shingles = places.withColumn("h", by_size)
    sizes = sorted(r["k"] for r in targets.select(size.alias("k")).distinct().collect())

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), words(text).alias("w"))
    n = F.size("w")
    step = _SEGMENT - (window - 1)
    starts = F.when(n > _SEGMENT, F.sequence(F.lit(0), n - window, F.lit(step))).otherwise(F.array(F.lit(0)))
    pieces = F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("w", i + 1, _SEGMENT).alias("w")))
    texts = texts.select("row", "id", n.alias("total"), F.explode(pieces).alias("z"))
    texts = texts.select("row", "id", "total", "z.at", "z.w", F.size("z.w").alias("n_words"))
    found = [_places(F.col("w"), s, window - 1, _bits(shingles.where(F.col("k") == s))) for s in sizes]
    shape = "array<struct<p:int,h:bigint,back:int,near:array<string>>>"
    seen = F.concat(*found) if found else F.array().cast(shape)
    marked = pinned(texts.select("row", "id", "total", "at", "n_words", seen.cast(shape).alias("seen")))
    occurrences = marked.select("row", "at", "n_words", F.inline("seen"))

    # Rarity over the whole corpus; a window whose rarest shingle never occurs cannot occur either.
    counts = occurrences.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        shingles.join(counts, "h", "left")
        .groupBy("words", "items")
        .agg(F.min_by(F.struct("h", "j"), F.struct(F.coalesce("n", F.lit(0)), F.col("h"), F.col("j"))).alias("x"))
    )
    prefixes = rarest.groupBy(F.col("x.h").alias("h")).agg(
        F.collect_list(F.struct(F.col("x.j").alias("j"), "words", "items")).alias("candidates")
    )
    # The windows are counted above; so many of them (tens of MB) go to all tasks, more are joined by a shuffle.
    if windows_found <= _SENT:
        prefixes = F.broadcast(prefixes)
    joined = occurrences.join(prefixes, "h")
    fits = F.filter(
        "candidates",
        lambda c: (F.col("p") - c["j"] >= 0)
        & (F.col("p") - c["j"] + F.size(c["words"]) <= F.col("n_words"))
        & (F.slice("near", F.greatest(F.col("back") - c["j"], F.lit(0)) + 1, F.size(c["words"])) == c["words"]),
    )
    spans = F.transform(
        fits,
        lambda c: F.struct(
            (F.col("at") + F.col("p") - c["j"]).alias("start"), (F.col("at") + F.col("p") - c["j"] + F.size(c["words"])).alias("end"),
            c["items"].alias("items"),
        ),
    )
    # Overlaps of segments are met twice; equal spans become one before they are gathered.
    verified = joined.select("row", F.inline(spans))
    ranges = verified.groupBy("row", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = verified.select("row", F.explode("items").alias("item")).distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per_row = ranges.join(named, "row", "left")
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], x["end"]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = marked.where(F.col("at") == 0).select("row", "id", F.col("total").cast("long").alias("n_words"))
    return whole.join(per_row, "row", "left").select(
        F.col("id").alias(id), "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def judged(found: DataFrame) -> DataFrame:
    """Adds contaminated: at least a twentieth of the words is hit, and at least one."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(
        contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
win AS (
  SELECT DISTINCT item, l, w[i : i + l - 1] AS ws
  FROM (SELECT item, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
),
pos AS (
  SELECT doc_id, l, i, w[i : i + l - 1] AS ws
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)
),
occ AS (SELECT doc_id, i, l, item FROM pos JOIN win USING (l, ws)),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM occ) GROUP BY doc_id
),
its AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""
