"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mailwatch.llm import (
    chat, components, decontamination, filtering, fingerprints, hashing, language, materialise, near_duplicates, packing, scratch, suffix_tree,
    token_counts, urls,
)
from tests.llm import brute

WORDS = [f"w{i:04d}" for i in range(4000)]
LONG = " ".join(WORDS * 8)
NEAR = " ".join(WORDS[:200])
TEXTS = [
    (0, NEAR), (1, NEAR), (2, NEAR.replace("w0100", "other").upper()), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "ONE\x0btwo"),
    (8, LONG), (9, LONG + " tail"), (10, "é" * 50), (11, "123 !? 456"), (12, "\n".join(["a line that repeats"] * 30)), (None, "no id here at all"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with an extra column for every name that the operators use inside."""
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    names = "id row n key words h p seen component node rep band lang_pred score length piece w state part kind _id _text".split()
    return frame.withColumns({c: F.lit("x") for c in names}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_contamination(spark, docs, none):
    bench = spark.createDataFrame(
        [(1, " ".join(WORDS[50:70])), (2, "two"), (3, None), (4, "..."), (5, "Two"), (None, "one two"), (6, " ".join(WORDS[60:75]))],
        "item_id long, text string",
    ).withColumn("items", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, bench).collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert got == brute.contamination(TEXTS, items)
    assert decontamination.contamination(none, bench).count() == 0
    clean = decontamination.judged(decontamination.contamination(docs, bench.limit(0))).collect()
    assert len(clean) == len(TEXTS) and not any(r["contaminated"] or r["n_hit"] for r in clean)
    twice = decontamination.contamination(docs.unionByName(docs), bench)
    assert twice.count() == 2 * len(TEXTS) and twice.distinct().count() == len(TEXTS)


def test_contamination_of_a_long_text(spark):
    """A text that is hit throughout, over many segments, and windows that lie across their borders."""
    passage = " ".join(WORDS[:40])
    clean = [f"x{i}" for i in range(9000)]
    across = clean[:4080] + WORDS[100:130] + clean[4080:8150] + WORDS[200:213] + clean[8150:]
    texts = [(1, " ".join([passage] * 5000)), (2, " ".join(across)), (3, " ".join(clean)), (4, " ".join(WORDS[100:130] * 137))]
    items = [(1, passage), (2, " ".join(WORDS[100:130])), (None, " ".join(WORDS[200:213]))]
    frames = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(*frames).collect()}
    assert got == brute.contamination(texts, items)
    assert got[1][:2] == (200_000, 200_000) and got[2][1] == 43


def test_near_duplicates(docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(docs).collect()}
    want = brute.near_groups([t for t in TEXTS if t[0] is not None])
    assert got.pop(None) == (1, None, True)
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}
    assert got[2][1] == 0 and got[7][1] == 6 and got[9][1] == 8
    assert near_duplicates.near_duplicates(none).count() == 0


def test_near_duplicates_in_one_hot_group(spark):
    """Many versions of one text, on both sides of the threshold, with blocks smaller than the group."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        words = WORDS[:120].copy()
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    config = near_duplicates.NearConfig(block=32)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(frame, config=config).collect()}
    assert got == {d: c for d, (_, c) in brute.near_groups(rows).items()}
    assert len(set(got.values())) > 3


def test_comparison_keeps_what_may_be_similar():
    config = near_duplicates.NearConfig()
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (3000, config.lanes)).astype(np.uint8)
    for similarity, low, high in ((0.85, 1.0, 1.0), (0.7, 0.0, 0.01), (0.3, 0.0, 0.0)):
        b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
        assert low <= len(near_duplicates.survivors(a, b, config)) / len(a) <= high


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 9), (10, 11), (11, 10)] + [(100 + i, 101 + i) for i in range(60)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 10: 10, 11: 10} | {100 + i: 100 for i in range(61)} | {500 + i: 500 for i in range(60)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)] + [(None, 1), (4000, 4000)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(16)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in settings}
    found, tasks, tracker = [], [], spark.sparkContext.statusTracker()
    try:
        for c, value in settings.items():
            spark.conf.set(c, value)
        for most in (components._SMALL, 0):
            monkeypatch.setattr(components, "_SMALL", most)
            spark.sparkContext.setJobGroup(f"components of at most {most}", "")
            found.append(sorted(map(tuple, components.components(frame, "a", "b").collect())))
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"components of at most {most}")]
            stages = [tracker.getStageInfo(x) for j in jobs for x in j.stageIds]
            tasks.append(sum(x.numCompletedTasks for x in stages if x))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for c, value in before.items():
            spark.conf.set(c, value)
    assert found[0] == found[1]
    least = {n: n for e in edges for n in e if e[0] is not None and e[0] != e[1]}
    while any(least[a] != least[b] for a, b in edges if a in least and b in least):
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    assert dict(found[0]) == least
    assert 0 < 3 * tasks[0] < tasks[1]


def test_rows_are_not_read_to_leave_nothing_out(spark, docs):
    nothing = docs.where("doc_id < 0").select("doc_id")
    kept = filtering.without(docs, nothing, "doc_id")
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count() == len(TEXTS)
    alike = filtering._met(docs, nothing, ("doc_id",), "left_semi")
    assert "LocalRelation <empty>" in alike._jdf.queryExecution().optimizedPlan().toString()
    assert alike.columns == docs.columns and alike.count() == 0
    assert filtering.without(docs, docs.where("doc_id < 3").select("doc_id"), "doc_id").count() == len(TEXTS) - 3


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_pinned_leaves_no_shuffle_files(spark):
    settings = {c: spark.conf.get(c, None) for c in (scratch._CLEANUP, scratch._EXCLUDED)}
    before = _shuffle_files(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    empty = counts.where("k < 0").select("k").distinct()
    both, none = scratch.pinned(counts), scratch.pinned(counts.join(empty, "k"))
    kept = scratch.pinned(counts.join(empty, "k", "left_anti"))
    assert both.agg(F.sum("count")).first()[0] == 1000
    assert none.count() == 0 and kept.count() == 7
    late = _shuffle_files(spark)
    shuffled = counts.join(empty, "k", "left")
    scratch.pinned(shuffled)
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before - late):
            break
        time.sleep(0.2)
    assert not left
    with pytest.raises(Exception, match="no such number"):
        scratch.pinned(spark.range(3).select(F.raise_error(F.lit("no such number"))))
    assert settings == {c: spark.conf.get(c, None) for c in settings}


def test_hashes_tell_words_and_shingles_apart():
    texts = [b"Ab c  d\te", b"", None, b"ab c d", b" x ", b"c ab"]
    words, edges = hashing.word_hashes(texts)
    assert list(np.diff(edges)) == [4, 0, 0, 3, 1, 2]
    assert words[0] == words[4] == words[9] and words[1] == words[5] and len(set(words.tolist())) == 5
    hashes, ends = hashing.shingle_hashes(words, edges, 3)
    assert list(np.diff(ends)) == [2, 0, 0, 1, 1, 1] and hashes[0] == hashes[2]


def test_language(spark, docs, none):
    rows = [(i, t * 20, k) for i, (t, k) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de")] * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), config=language.LanguageConfig(steps=60))
    got = {r["doc_id"]: r for r in language.identified(docs, model).collect()}
    assert len(got) == len(TEXTS)
    for d in (3, 4, 5, 11):
        assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
    assert {got[d]["lang_pred"] for d in (0, 8, 10)} <= {"en", "de"} and all(0 <= r["score"] <= 1 for r in got.values())
    seen = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, keep=("lang",)).collect()
    assert all(r["lang"] == r["lang_pred"] for r in seen)
    unlearned = language.fit(none)
    assert {r["lang_pred"] for r in language.identified(docs, unlearned).collect()} == {"und"}
    assert language.identified(none, model).count() == 0
    with pytest.raises(ValueError):
        language.identified(docs, model, keep=("score",))


def test_gradients_match_differences():
    """Backpropagation through time against finite differences of the loss."""
    c = language.LanguageConfig(hidden=3)
    w = {k: v.astype(np.float32) for k, v in language._start(2, c).items()}
    xs = np.random.default_rng(1).integers(97, 101, (5, 4)).astype(np.uint8)
    target = np.array([0, 1, 1, 0])

    def loss(w):
        p = language._probabilities(w, xs)
        return -np.log(p[:, target, np.arange(4)]).mean()

    kept: list = []
    language._run(w, "f", xs, kept)
    p = language._probabilities(w, xs)
    p[:, target, np.arange(4)] -= 1
    p /= p.shape[0] * p.shape[2]
    grad = language._back(w, "f", xs, kept, np.matmul(w["of"].T, p))
    for name, at in (("uf", (1, 2)), ("uf", (7, 0)), ("bf", (4, 0)), ("xf", (2, 98)), ("xf", (8, 99))):
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert grad[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, abs=2e-4)


def test_packing(docs, none):
    got = packing.packed_documents(docs).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in TEXTS}
    assert [r["length"] for r in got if r["doc_id"] == 3] == [1]
    assert packing.packed_documents(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs.select("doc_id", F.lit(2000).cast("long").alias("length"), F.lit(0).alias("piece")))


def test_flat_files_of_any_block_size(spark, docs, none):
    folder = scratch.new_folder(spark, "flat")
    order = {(r["file"], r["ordinal"]): r["doc_id"] for r in token_counts.write_flat(docs, folder).collect()}
    whole = {(r["file"], r["ordinal"]): (r["start"], r["n_tokens"]) for r in token_counts.token_counts(spark, folder).collect()}
    assert set(whole) == set(order)
    assert {order[k]: n for k, (_, n) in whole.items()}[3] == 0
    for block in (2, 6, 64, 1000):
        parts = token_counts.token_counts(spark, folder, block=block)
        assert {(r["file"], r["ordinal"]): (r["start"], r["n_tokens"]) for r in parts.collect()} == whole
    empty = scratch.new_folder(spark, "flat")
    assert token_counts.write_flat(none, empty).count() == 0


def test_flat_files_from_elsewhere(spark, tmp_path):
    def counts(ids):
        (tmp_path / "x.bin").write_bytes(np.array(ids, "<u2").tobytes())
        return [(r["n_tokens"], r["closed"]) for r in token_counts.token_counts(spark, f"file://{tmp_path}", end=9, block=4).orderBy("ordinal").collect()]

    assert counts([1, 2, 3, 9, 9, 4]) == [(3, True), (0, True), (1, False)]
    assert counts([1, 2, 3, 4, 5]) == [(5, False)]
    assert counts([9]) == [(0, True)]
    assert counts([]) == []
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        token_counts.token_counts(spark, f"file://{tmp_path}")


def test_permutation_and_resumed_reads(spark, docs, none):
    for size in (1, 2, 3, 100, 4097):
        assert sorted(materialise.permuted(np.arange(size), size, 5)) == list(range(size))
    assert (materialise.permuted(np.arange(100), 100, 5) != materialise.permuted(np.arange(100), 100, 6)).any()
    config = materialise.OrderConfig(length=64, shard=50)

    def written(frame):
        folder = scratch.new_folder(spark, "order")
        manifest = scratch.pinned(materialise.materialised(frame, folder, config=config))
        return lambda start=0: [tuple(r) for r in materialise.read_shards(spark, folder, manifest, config, start).orderBy("position").collect()]

    path = scratch.new_folder(spark, "docs")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    read = written(docs)
    every = read()
    assert [r[0] for r in every] == list(range(len(every))) and len(every) > 100
    assert read(77) == every[77:] and read(len(every)) == []
    assert written(docs)() == every
    folder = scratch.new_folder(spark, "order")
    assert materialise.materialised(none, folder).count() == 0


def test_fingerprints_are_homomorphic(docs, none):
    one, two = b"first\nsecond\nthird", b"third\nfirst\nsecond"
    state = lambda t: fingerprints.states([fingerprints.paragraphs(t)])[0].astype("<u2").tobytes()
    assert state(one) == state(two) != state(b"first\nsecond\nsecond\nthird")
    assert fingerprints.inserted(state(b"first\nsecond"), b"third") == state(one)
    assert fingerprints.deleted(state(one), b"second\nfirst") == state(b"third")
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    rows = [TEXTS[-1], *TEXTS[:-1]]
    edits = brute.edited(rows)
    assert {d: (r["n_chars"], r["edited_sha256"]) for d, r in got.items()} == {d: (len(t or ""), brute.sha(edits[d])) for d, t in rows}
    for d, e in edits.items():
        assert got[d]["edited_fingerprint"] == fingerprints.printed(fingerprints.states([fingerprints.paragraphs(e.encode())])[0])
    assert got[0]["near_next"] == 1.0 and got[3]["near_edited"] == 1.0 and got[3]["fingerprint"] == got[4]["fingerprint"]
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert len({r["fingerprint"] for r in fingerprints.fingerprinted(docs).collect()}) == len({t or "" for _, t in TEXTS})
    twice = fingerprints.edited_fingerprints(docs.unionByName(docs))
    assert twice.count() == 2 * len(TEXTS)


def test_likeness_of_long_repeats(spark):
    """100,000 equal runs in one text, counted in full, also after paragraphs come and go."""
    own, less, line = (fingerprints.states([fingerprints.paragraphs(t)]) for t in (b"-" * 100_007, b"-" * 75_007, b"one more line here"))
    assert fingerprints.likeness(own, less)[0] == pytest.approx(1) and np.abs(fingerprints._lanes(own)).max() == 100_000
    assert (fingerprints.minus(fingerprints.plus(own, line), line) == own).all()
    lines = fingerprints.states([[b"the same line again"] * 70_000, [b"the same line again"] * 50_000])
    assert fingerprints.likeness(lines[:1], lines[1:])[0] == pytest.approx(1)
    rows = spark.createDataFrame([(1, "-" * 40_000), (2, "="), (3, "-" * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(rows).collect()}
    assert got[1]["near_edited"] > 0.9 and got[3]["near_next"] == pytest.approx(1)


def test_chat_folds_events_and_reads_back(spark):
    events = [
        (1, 1, "delta", "a", "user", "hel"), (1, 2, "delta", "a", None, "lo"), (1, 3, "delta", "b", "assistant", "old "), (1, 4, "delta", "b", None, "draft"),
        (1, 5, "regenerate", "b", None, None), (1, 6, "delta", "b", None, "new <|im_end|>\\"), (1, 7, "edit", "a", None, "hello <|"), (1, 300, "delta", "a", None, "x"),
        (2, None, "delta", "m", None, None), (2, 1, "other", "n", "as\\n<|\nsist", "\\| \\"), (None, 1, "delta", "q", "assistant", "orphan"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, message string, role string, text string").withColumn("place", F.lit(1))
    chats = chat.rendered(chat.folded(log))
    got = {
        r["conv_id"]: ([tuple(t) for t in r["turns"]], r["learned"], r["formatted"])
        for r in chats.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    }
    assert got[1][:2] == ([("user", "hello <|x"), ("assistant", "new <|im_end|>\\")], "new <|im_end|>\\")
    assert got[2][:2] == ([("", ""), ("as\\n<|\nsist", "\\| \\")], "")
    assert got[None][1] == "orphan"
    assert got[1][2].count("<|im_start|>") == got[1][2].count("<|im_end|>") == 2
    assert chat.folded(log.limit(0)).count() == 0 == chat.rendered(chat.folded(log.limit(0))).count()


def test_chat_digests_of_ties(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    chats = chat.rendered(chat.folded(chat.as_events(rows)))
    turns = chats.select(F.explode(chat.parsed(F.col("formatted"))).alias("t")).select("t.*").collect()
    assert [tuple(t) for t in turns] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]


def test_urls(spark):
    page = "<html><head><LINK href='http://b.org/x' rel=canonical></head>"
    pages = [
        (1, "http://WWW.Example.com:80/en/?q#f", None), (2, "http://www.example.com/en/a", ""), (3, "http://a.example.com/en/", ""), (4, "https://x.net/fr/1", ""),
        (5, "https://x.net/fr", ""), (6, None, page), (7, "no scheme", page), (8, "", ""), (9, "http://a.org/p", page), (10, "http://b.org/x/?utm_source=1#z", ""),
        (11, "http://c.org/y", "<meta http-equiv='refresh' content='0; url=https://x.net/es/blocked'>"), (12, "http://d.com/y", ""), (13, "http://e.org/", "<link rel='canonical' href='/home'>"), (13, "http://e.org/", None),
        (14, "http://notexample.com/en/", ""), (15, "ftp://y.net/es/://z", ""),
    ]
    redirects = [("http://d.com/y", "http://c.org/y"), ("http://a.org/p", "https://x.net/fr/1"), ("http://e.org/home", "http://a.org/p"), (None, "http://a.org/p"), ("http://a.org/p", "relative")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit(0)).withColumn("row", F.lit(0))
    got = {}
    for r in urls.judged_urls(frame, urls.rule_table(spark), spark.createDataFrame(redirects, "url string, target string")).collect():
        assert got.setdefault(r["page_id"], r) == r
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("www.example.com:80", "/en/", None)
    assert (got[2]["rule"], got[2]["verdict"]) == ("www.example.com/en/", "allow")
    assert (got[3]["rule"], got[3]["verdict"]) == ("example.com/en/", "block")
    assert (got[4]["rule"], got[4]["verdict"]) == ("net/fr/", "block") and (got[5]["rule"], got[5]["verdict"]) == (None, "allow")
    assert all((got[i]["host"], got[i]["path"], got[i]["verdict"]) == ("", "", "allow") for i in (6, 7, 8))
    # a.org, b.org and e.org are aliases of a blocked page; c.org too, but d.com is allowed by a rule.
    assert [got[i]["verdict"] for i in (9, 10, 13, 11, 12)] == ["block", "block", "block", "allow", "allow"]
    assert got[14]["rule"] == "com/" and got[15]["rule"] == "net/es/"
    assert urls.judged_urls(frame.limit(0), urls.rule_table(spark)).count() == 0
    assert urls.judged_urls(frame, urls.rule_table(spark).limit(0)).where("verdict = 'block'").count() == 0


def test_page_links(spark):
    pages = [
        ("http://good.org/login", "<link rel=canonical href='/login?next=http://x.net/es/b'>", ["http://good.org/login?next=http://x.net/es/b"]),
        ("http://a.org/d/e/p.html?k=1", "<link rel=canonical href=q.html>", ["http://a.org/d/e/q.html"]),
        ("http://a.org/d/e/p.html", "<link href='../q/./r/..' rel='alternate Canonical'>", ["http://a.org/d/q/"]),
        ("http://a.org/d/p", '<link rel="canonical" href="?id=3&amp;s=4#x">', ["http://a.org/d/p?id=3&s=4#x"]),
        ("http://a.org", "<link rel=canonical href=../../b><LINK HREF='//c.org/y' REL='nofollow\ncanonical'>", ["http://a.org/b", "http://c.org/y"]),
        ("https://a.org/z", "<meta http-equiv=Refresh content='5;URL=w'><meta content=\"0; url='https://v.org/1 2'\" http-equiv='refresh'>", ["https://a.org/w", "https://v.org/1 2"]),
        ("http://a.org/n", "<link rel=canonical href=mailto:x@y><link rel=canonical href='#top'><link rel=canonicals href=/a><a rel=canonical href=/b><link data-rel=canonical href=/c>", []),
        ("nohost", "<link rel=canonical href=/a><link rel=canonical href='ftp://b.org/c'>", ["ftp://b.org/c"]),
    ]
    frame = spark.createDataFrame([(u, h) for u, h, _ in pages], "url string, html string")
    found: dict = {}
    for r in urls.page_links(frame).collect():
        found.setdefault(r["url"], []).append(r["target"])
    assert found == {u: t for u, _, t in pages if t}
    # The SQL reads the same links.
    sql = urls.SQL[: urls.SQL.index("urls AS (SELECT url FROM seen")].rstrip().removesuffix(",") + " SELECT url, target FROM links WHERE target IS NOT NULL"
    con = duckdb.connect()
    con.register("pages", frame.selectExpr("1 AS page_id", "*").toPandas())
    assert sorted(con.execute(sql).fetchall()) == sorted((u, t) for u, _, targets in pages for t in targets)
    bad = spark.createDataFrame([(1, "http://good.org/login", pages[0][1]), (2, "http://a.org/p#f?k=1", "<link rel=canonical href='https://x.net/es/'>"), (3, "http://a.org/p", "")], "page_id long, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judged_urls(bad, urls.rule_table(spark)).collect()}
    assert verdicts == {1: "allow", 2: "block", 3: "block"}


def test_language_sample_is_bounded(spark):
    c = language.LanguageConfig(per_language=100)
    rows = [("en", None if i % 2 else 7, f"text number {i} of many") for i in range(6000)] + [("en", 7, "one that stands very often")] * 4000
    rows += [("de", i, f"satz {i}") for i in range(40)] + [("fr", 1, None), (None, 2, "keine"), ("fr", 3, "123")]
    found = language.sample(spark.createDataFrame(rows, "lang string, doc_id long, text string").repartition(5), "doc_id", "text", "lang", c).collect()
    assert sum(r["lang"] == "en" for r in found) == 100 and len({r["text"] for r in found if r["lang"] == "en"}) == 100
    assert sum(r["lang"] == "de" for r in found) == 40 and not any(r["lang"] == "fr" for r in found)


def test_suffix_tree(spark, docs, none):
    config = suffix_tree.SuffixConfig(least=2, gain=0.5)
    model, words = suffix_tree.fit(docs, config=config)
    got = {r["doc_id"]: r for r in suffix_tree.scored(docs, model, words).collect()}
    assert {d: r["n_tokens"] for d, r in got.items()} == {d: len(brute.tokens(t)) + 1 for d, t in TEXTS}
    assert all(r["n_known"] == r["n_tokens"] and r["score"] <= 0 for r in got.values())
    assert got[3]["score"] == got[4]["score"] == got[5]["score"] and got[6]["score"] == got[7]["score"]
    # Next-symbol probabilities of any context sum to one.
    for context in (b"\n\n\n\n\n", b"w0100", b"zzzzz", b"e w00"):
        high = sum(int(c) << 8 * (k + 1) for k, c in enumerate(reversed(context)))
        assert (10 ** model.log10(np.array([high + s for s in range(256)], np.uint64))).sum() == pytest.approx(1)
    fresh, counted = suffix_tree.fit(none)
    assert suffix_tree.scored(docs, fresh, counted).where("n_known > 0").count() == 0
    assert suffix_tree.scored(none, model, words).count() == 0


@pytest.mark.parametrize("config", [suffix_tree.SuffixConfig(depth=3, least=4, gain=2.0), suffix_tree.SuffixConfig(share=0.002, least=3, gain=1.0)])
def test_suffix_tree_scores_are_those_of_plain_counts(spark, config):
    texts = [" ".join(WORDS[i * 7 % 60 : i * 7 % 60 + 12]) + " Über naïve\tcafé " * (i % 3) + "the cat sat " * (i % 5) for i in range(50)] + [None, "", "THE CAT"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model, words = suffix_tree.fit(frame.where("doc_id % 4 > 0"), config=config)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.scored(frame, model, words).collect()}
    want = brute.tree_scores([t for i, t in enumerate(texts) if i % 4], texts, config.depth, config.least, config.gain)
    assert all(got[i] == pytest.approx(w, rel=1e-5) for i, w in enumerate(want))


def test_suffix_tree_keeps_contexts_of_a_small_source(spark):
    """A context of fixed count stays when unrelated text is added, and share only moves lookups."""
    small_source = [(i, "qxa zxb " * 6) for i in range(10)]
    other = [(100 + i, " ".join(WORDS[i * 20 : i * 20 + 200])) for i in range(150)]
    run = np.array([int.from_bytes(b"xb qxa", "big")], np.uint64)
    for rows in (small_source, small_source + other):
        model, _ = suffix_tree.fit(spark.createDataFrame(rows, "doc_id long, text string"), config=suffix_tree.SuffixConfig(share=0.01))
        assert 10 ** model.log10(run)[0] > 0.9
    frame = spark.createDataFrame(small_source + other, "doc_id long, text string").repartition(3)
    got = []
    for share in (2e-6, 0.001, 2.0):
        model, words = suffix_tree.fit(frame.where("doc_id % 3 > 0"), config=suffix_tree.SuffixConfig(share=share))
        got.append({r["doc_id"]: r for r in suffix_tree.scored(frame, model, words).collect()})
        assert len(model.hot.runs) == 0 or share < 1
    for doc, r in got[0].items():
        for x in got[1:]:
            assert x[doc]["score"] == pytest.approx(r["score"], rel=1e-5) and x[doc]["base_score"] == pytest.approx(r["base_score"])


def test_plain_forms():
    form, places, edges = suffix_tree.plain([b" A\t\nbC ", None, b"x"], 2)
    assert bytes(form) == b"\n\na bc \n\n\n\nx \n\n"
    assert bytes(form[places]) == b"a bc \n\nx \n" and list(edges) == [0, 6, 7, 10]


def test_sha_of_nothing_is_the_digest_of_the_empty_string(spark):
    assert spark.range(1).select(F.sha2(F.concat_ws(",", F.array().cast("array<string>")), 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_parts_of_texts_have_the_ids_of_the_tokenizer():
    """Texts are cut before pieces are looked for, and a piece goes to the model alone; the ids stay those of the whole text."""
    from mailwatch.llm.tokens import _parts, encoder

    assert _parts("The end. So, all of it") == ["The", " end", ".", " So", ",", " all", " of", " it"]
    draw = random.Random(3)
    some = ["a", "B", "é", "1", "٣", "!", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "😀", "漢字", "\0", "the", "don't",
            ".", ",", ").", "_.", "12,", "..", " .", "<|", "endoftext", "|>", "<|endoftext|>", "\u0301"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(30))) for _ in range(5000)]
    used = encoder("byte_bpe_50k.json")
    assert all(ids.tolist() == used.tokenizer.encode(t, add_special_tokens=False).ids for t, ids in zip(texts, used.ids(texts), strict=True))


def test_a_part_of_several_pieces_is_split_once():
    from mailwatch.llm.tokens import Encoder, _path

    used, asked = Encoder(_path("byte_bpe_50k.json")), []
    split = used.known.split
    used.known.split = lambda part: asked.append(part) or split(part)
    texts = ["the THE!! end" + " THE!!" * 50, None, "", "a\0b THE!!", "THE!! THE!!  x", "<|endoftext|> THE!!"] * 3
    expected = [used.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in used.ids(texts)] == expected and asked.count(" THE!!") == 1


def test_forgotten_parts_are_found_again(monkeypatch):
    from mailwatch.llm import tokens

    monkeypatch.setattr(tokens, "_REMEMBERED", 3)
    used, texts = tokens.Encoder(tokens._path("byte_bpe_50k.json")), ["one two three four", "two five, six", "one two", "seven one. two"]
    for t in texts * 3:
        assert used.ids([t])[0].tolist() == used.tokenizer.encode(t, add_special_tokens=False).ids
    assert " two" in used.known or " two" in used.known.before
    assert len(used.known) + len(used.known.before) < 15
