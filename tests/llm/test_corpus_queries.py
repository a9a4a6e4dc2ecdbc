"""The registered corpus queries, against their SQL or a brute-force version, on whole small tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from mailwatch.llm import fingerprints, language, materialise
from mailwatch.llm.packing import plan
from tests.llm import brute
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def rows(spark, name):
    return entry.queries()[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", ["op1_decontamination", "op4_near_duplicates", "op8_chat_formatting", "op9_url_filters"])
def test_same_as_sql(spark, name):
    assert compare(rows(spark, name), connect(SF).execute(entry.oracle_sql()[name]).fetchdf()) is None


def packed(got, texts, tokenizer, most=1024):
    """Checks a packing row by row: pieces are right, whole and gapless in their sequences."""
    places: dict = {}
    pieces: dict = {}
    for r in got.itertuples():
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = [pieces[doc][k] for k in range(len(pieces[doc]))]
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) == len(ids)
        assert all(r.length == most for r in own[1:]) and len(own) == -(-len(ids) // most)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= most
    return len(places)


def test_packing(spark, docs, tokenizer):
    got = rows(spark, "op2_best_fit_packing")
    sequences = packed(got, dict(docs), tokenizer)
    assert sequences <= 1.02 * -(-got["length"].sum() // 1024) + 1


def test_token_counts(spark, docs, tokenizer):
    tokenizer.encode_special_tokens = True
    got = rows(spark, "op3_token_counts").set_index("doc_id")
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in docs}
    tokenizer.encode_special_tokens = False
    assert got["n_tokens"].to_dict() == want and got["closed"].all()


def test_language(spark, docs):
    got = rows(spark, "op5_language_id").set_index("doc_id")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got.index) == set(truth)
    held = got[got["held_out"]]
    assert {d for d in held.index} == {d for d, _ in docs if brute.crc(d) % 4 == 2}
    assert np.mean([truth[d] == p for d, p in held["lang_pred"].items()]) >= 0.9
    assert got["score"].between(0, 1).all() and set(got["lang_pred"]) <= {*truth.values(), "und"}


def test_training_order(spark, docs, tokenizer):
    tokenizer.encode_special_tokens = True
    got = rows(spark, "op6_training_order")
    assert sorted(got["position"]) == list(range(len(got)))
    seen: dict = {}
    for r in got.itertuples():
        seen.setdefault(r.doc_id, {})[r.piece] = r
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, materialise.END], "<u4")
        assert len(seen[doc]) == -(-len(ids) // 512)
        for k, r in seen[doc].items():
            assert r.start == 512 * k and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    tokenizer.encode_special_tokens = False
    order = got.sort_values(["doc_id", "piece"])["position"].to_numpy()
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.2


def test_fingerprints(spark, docs):
    got = rows(spark, "op7_document_fingerprints").set_index("doc_id")
    edits = brute.edited(docs)
    for i, (doc, text) in enumerate(docs):
        own, new, follow = fingerprints.states(
            [fingerprints.paragraphs(t.encode()) for t in (text or "", edits[doc], docs[(i + 1) % len(docs)][1] or "")]
        )
        r = got.loc[doc]
        assert r["n_chars"] == len(text or "") and r["edited_sha256"] == brute.sha(edits[doc])
        assert r["fingerprint"] == fingerprints.printed(own) and r["edited_fingerprint"] == fingerprints.printed(new)
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(own[None], new[None])[0])
        assert r["near_next"] == pytest.approx(fingerprints.likeness(own[None], follow[None])[0])
    by_text: dict = {}
    for doc, text in docs:
        by_text.setdefault(text, set()).add(got.loc[doc, "fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_language_model(spark, docs):
    got = rows(spark, "op10_lm_scoring").set_index("doc_id")
    want, n = brute.base_scores(docs)
    assert (got["train_tokens"] == n).all()
    for doc, (size, known, base) in want.items():
        r = got.loc[doc]
        assert (r["n_tokens"], r["n_known"]) == (size, known) and r["base_score"] == pytest.approx(base)
        assert r["held_out"] == (brute.crc(doc) % 5 == 1) and r["score"] < 0


def test_pipeline(spark, docs, tokenizer, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    truth = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(truth.where(~language.held_out("doc_id")))
    probability = model.pooled([(t or "").encode() for _, t in docs])
    kept = [(d, t) for (d, t), p in zip(docs, probability) if any(c.isalpha() for c in t or "") and p.max() > 0]
    assert len(kept) > 0.9 * len(docs)
    groups = brute.near_groups(kept)
    kept = [(d, t) for d, t in kept if groups[d][1] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination(kept, items)
    kept = [(d, t) for d, t in kept if not (found[d][1] and 20 * found[d][1] >= found[d][0])]
    packed(rows(spark, "pipeline"), dict(kept), tokenizer)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "packing"]


def test_stages_keep_the_columns_of_documents(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, given, SF).columns) == sorted(given.columns), name


def test_stages_judge_rows_without_or_with_shared_ids(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = [" ".join(f"word{k}x{i}" for i in range(30)) for k in range(8)]
    near = " ".join(plain[0].split()[:-1])
    schema = "doc_id long, text string, lang string"

    def after(stage, rows):
        given = spark.createDataFrame([(d, t, "en") for d, t in rows], schema).repartition(3)
        got = [(r["doc_id"], r["text"]) for r in stage(spark, given, str(tmp_path)).collect()]
        return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))

    # A null id, a shared id and repeated rows: each row goes or stays by its own text.
    rows = [(1, passage), (1, plain[1]), (2, plain[2]), (None, passage), (None, plain[3]), (4, plain[4]), (4, plain[4])]
    assert after(corpus_pipeline.keep_uncontaminated, rows) == [(1, plain[1]), (2, plain[2]), (4, plain[4]), (4, plain[4]), (None, plain[3])]
    # One row of each group, of the smallest id: copies, near copies, repeated rows and rows without an id.
    rows = [(5, plain[0]), (3, near), (3, plain[1]), (None, plain[0]), (2, plain[2]), (2, plain[2]), (2, plain[5]), (9, plain[5])]
    rows += [(None, plain[3])] * 5 + [(7, plain[4])] * 4 + [(None, plain[4]), (8, " "), (8, " "), (None, None)]
    want = [(2, plain[2]), (2, plain[5]), (3, near), (3, plain[1]), (7, plain[4]), (8, " "), (8, " "), (None, None), (None, plain[3])]
    assert after(corpus_pipeline.keep_one_of_each_group, rows) == want
    # Texts without a letter have no language.
    rows = [(1, "123"), (1, plain[1]), (None, "456"), (None, plain[2]), (3, plain[3]), (3, plain[3]), (4, "")]
    assert after(corpus_pipeline.keep_identified, rows) == [(1, plain[1]), (3, plain[3]), (3, plain[3]), (None, plain[2])]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 9, 65) * (rng.random(65) < rng.random())
    counts[0] = 0
    used = np.zeros(65, int)
    for parts, times in plan(counts, 64):
        assert times > 0 and sum(parts) <= 64
        for n in parts:
            used[n] += times
    assert (used == counts).all()


def test_plan_takes_exact_complements_first():
    counts = np.zeros(11, int)
    counts[[7, 6, 5, 3, 2, 1]] = [2, 1, 2, 1, 2, 1]
    made = plan(counts, 10)
    assert ([7, 3], 1) in made and ([7, 2, 1], 1) in made and ([5, 5], 1) in made


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:3]], ids=[n for n, _ in corpus_pipeline.STAGES[:3]])
def test_stages_keep_odd_rows(spark, stage):
    """Nulls, repeated and very long rows, a column of the key's name; and no row at all."""
    long = " ".join(f"wort{i}" for i in range(60_000))
    texts = [(1, "eine kleine Zeile Text hier"), (None, "noch eine ganz andere Zeile"), (2, long), (3, "one more short line of words"), (3, "and a second one of that id")]
    schema = "doc_id long, text string, lang string, _text_key string, _text_key_ int"
    frame = spark.createDataFrame([(*t, "de", "mine", 5) for t in texts], schema).repartition(2)
    got = stage(spark, frame, SF)
    assert got.columns == frame.columns
    assert sorted(got.collect(), key=str) == sorted(frame.collect(), key=str)
    assert stage(spark, frame.limit(0), SF).count() == 0
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert stage(spark, unlabelled, SF).count() == len(texts)
