"""Spelling variants of a corpus' words: near words by full-text indexes, then the usual form of each.

Two words one error apart agree in the first or in the last half of either. So every word asks twice:
with its first half exact and one error behind it, and with its last half exact and one error before it.
Words are filed under the halves that a near word could ask with, and a task indexes what is filed in its
share: the words backwards for first halves (read left to right), forwards for last halves (read right to
left). A half that very many words share is cut into parts, each with an index of its own that the
words of this half pass by as a stream. Only counts by half and the pairs found are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fm_index import WordIndex, with_one_error
from .scratch import pinned

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SpellingConfig:
    """Words of at least ``shortest`` code points and ``least`` occurrences take part; a form is ``times`` as frequent as
    the word. ``share`` is about the number of symbols that one task indexes at once."""

    shortest: int = 7
    least: int = 2
    times: int = 10
    share: int = 1 << 17


def vocabulary(df: DataFrame, id: str = "doc_id", text: str = "text", config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n): words of Latin letters with their occurrences over whole texts.

    A run of letters A-Z, a-z, U+00C0 to U+00FF is lower-cased in A-Z. Where the crc32 of "id:run" is divisible by 31, the code
    point at crc32 modulo length is left out, as a typing error would. A null id is written as nothing, a null text has no word.
    """
    letters = f"[A-Za-zÀ-ÿ]{{{config.shortest},}}"  # shorter runs cannot become words
    runs = df.select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(letters), F.lit(0))).alias("run")
    )
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run")).withColumn("h", F.expr("crc32(encode(concat(id, ':', run), 'UTF-8'))"))
    gone = (F.col("h") % F.length("run")).cast("int")
    words = runs.select(
        F.when(F.col("h") % 31 != 0, F.col("run"))
        .otherwise(F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))).alias("word")
    )
    counted = words.where(F.length("word") >= config.shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= config.least)


def _filed(words: DataFrame, config: SpellingConfig) -> DataFrame:
    """(place, kind, head, key, word, n): words filed under halves (kind 0) and asking with their own (kind 1), in places of about one share.

    The key tells halves and their parts apart."""
    n = F.length("word")
    first, last = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    #: Halves of words one shorter, equally long and one longer; the shortest words are asked for by none shorter.
    heads = F.array_distinct(F.array(F.floor((n - 1) / 2).cast("int"), first, F.floor((n + 1) / 2).cast("int")))
    tails = F.array_distinct(F.array(F.ceil((n - 1) / 2).cast("int"), last, F.ceil((n + 1) / 2).cast("int")))

    def half(size, head: bool):
        part = F.left("word", size) if head else F.right("word", size)
        return F.struct(F.concat(F.lit("<" if head else ">"), part).alias("half"), F.lit(head).alias("head"))

    entries = words.select("word", "n", F.explode(F.concat(F.transform(heads, lambda s: half(s, True)), F.transform(tails, lambda s: half(s, False)))).alias("z"))
    entries = entries.select("word", "n", "z.half", "z.head")
    asks = words.select("word", "n", F.explode(F.array(half(first, True), half(last, False))).alias("z")).select("word", "n", "z.half", "z.head")
    symbols = F.sum(F.length("word") + 1)
    total = words.agg(F.coalesce(symbols, F.lit(0))).first()[0]
    places = max(1, -(-4 * total // config.share))
    hot = entries.groupBy("half").agg(F.ceil(2 * symbols / config.share).cast("int").alias("parts")).where(F.col("parts") > 1)
    hot = pinned(hot)
    filed = entries.join(hot, "half", "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    asking = asks.join(hot, "half", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    both = filed.withColumn("kind", F.lit(0)).unionByName(asking.withColumn("kind", F.lit(1)))
    key = F.xxhash64("half", "part")
    place = F.pmod(key, F.lit(places)).cast("int") * 2 + F.col("head").cast("int")
    # A place is one index; equal entries under several halves of a place are one.
    return both.select(place.alias("place"), "kind", "head", key.alias("key"), "word", "n")


def _pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, near, near_n): reads the places of one task in order, first what a place files, then who asks there."""
    place, held, counts, under, index = None, [], {}, set(), None
    for part in parts:
        places, kinds = np.asarray(part.column("place")), np.asarray(part.column("kind"))
        cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, part.num_rows]):
            rows = part.slice(a, b - a)
            if places[a] != place:
                place, counts, under, index = places[a], {}, set(), None
            if kinds[a] == 0:
                filed = rows.column("word").to_pylist()
                counts.update(zip(filed, rows.column("n").to_pylist()))
                under.update(zip(filed, rows.column("key").to_pylist()))
                continue
            if not counts:
                continue
            head = rows.column("head")[0].as_py()
            if index is None:
                held = sorted(counts)
                index = WordIndex([w.encode("latin-1") for w in held], backwards=head)
            for first in range(0, len(rows), 4096):
                yield from _answers(rows.slice(first, 4096), index, held, counts, under, head)


def _answers(
    rows: pa.RecordBatch, index: WordIndex, held: list[str], counts: dict[str, int], under: set[tuple[str, int]], head: bool
) -> Iterator[pa.RecordBatch]:
    words, n, keys = (rows.column(c).to_pylist() for c in ("word", "n", "key"))
    exact = [len(w) // 2 if head else len(w) - len(w) // 2 for w in words]
    at, met = with_one_error(index, [w.encode("latin-1") for w in words], exact)
    # What shares the first half is found from there.
    pairs = [(i, held[k]) for i, k in zip(at.tolist(), met.tolist()) if head or not held[k].startswith(words[i][: len(words[i]) // 2])]
    # Who asks in all parts of a half meets words that other halves or parts brought here; each counts where its own part is.
    pairs = [(i, w) for i, w in pairs if (w, keys[i]) in under]
    if pairs:
        yield pa.record_batch(
            {
                "word": pa.array([words[i] for i, _ in pairs]), "n": pa.array([n[i] for i, _ in pairs], pa.int64()),
                "near": pa.array([w for _, w in pairs]), "near_n": pa.array([counts[w] for _, w in pairs], pa.int64()),
            }
        )


def near_words(words: DataFrame, config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of distinct words that one inserted, deleted or replaced code point tells apart.

    ``words`` has distinct words of code points below 256 without U+0000, at least 4 each, and their counts n.
    """
    filed = _filed(words, config).repartition("place").sortWithinPartitions("place", "kind")
    return filed.mapInArrow(_pairs, "word string, n long, near string, near_n long")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last, twice as far in each round."""
    at = pinned(links.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        at = pinned(joined)
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def spelling_forms(df: DataFrame, id: str = "doc_id", text: str = "text", config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    A word's form is its most frequent near word (ties: the first in code-point order) if that is at least ``times`` as frequent;
    forms grow more frequent, so following them ends, at the root. Repeated rows count again, an empty table has no words, and
    other columns are not read.
    """
    words = pinned(vocabulary(df, id, text, config))
    usual = F.when(F.col("near_n") >= config.times * F.col("n"), F.struct((-F.col("near_n")).alias("behind"), "near"))
    near = pinned(near_words(words, config).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(usual).alias("best")))
    links = near.where("best is not null").select("word", F.col("best.near").alias("form"), (-F.col("best.behind")).alias("form_n"))
    out = words.join(near.select("word", "n_near"), "word", "left").join(links, "word", "left").join(_roots(links), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    return spelling_forms(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE bits(b, c, k) AS (
    SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
    UNION ALL
    SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
    SELECT doc_id, run, count(*) AS n
    FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents
    )
    WHERE length(run) >= 7
    GROUP BY ALL
),
hashed AS (
    SELECT run, n, length(run) AS size, xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + CAST(unicode(x) AS BIGINT) // 64, 128 + unicode(x) % 64] END))),
        lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), CAST(4294967295 AS BIGINT)) AS h
    FROM runs, crc
),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 31 <> 0 THEN run ELSE left(run, h % size) || substr(run, CAST(h % size AS BIGINT) + 2) END AS word, n FROM hashed)
    WHERE length(word) >= 7
    GROUP BY 1 HAVING sum(n) >= 2
),
cut AS (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
    SELECT DISTINCT * FROM (
        SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
        UNION ALL
        SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
        UNION ALL
        SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
    )
),
best AS (
    SELECT word, count(*) AS n_near,
           first(near ORDER BY near_n DESC, encode(near)) AS form,
           max(near_n) AS top
    FROM near GROUP BY word
),
formed AS (
    SELECT w.word, CASE WHEN b.top >= 10 * w.n THEN b.form END AS form, w.n, coalesce(b.n_near, 0) AS n_near,
           CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n
    FROM words w LEFT JOIN best b USING (word)
),
chain AS (
    SELECT word, word AS at, form AS next FROM formed
    UNION ALL
    SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON f.word = c.next WHERE c.next IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
