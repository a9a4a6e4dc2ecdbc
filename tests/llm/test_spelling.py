"""Spelling variants against SQL and brute force; the index against a comparison of all pairs."""

import random
import zlib

import pytest

import __spark_entry__ as entry
from mailwatch.llm.fm_index import WordIndex, one_apart, with_one_error
from mailwatch.llm.spelling import SpellingConfig, near_words, spelling_forms, vocabulary
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts):
    counts = {}
    for i, text in texts:
        run = ""
        for ch in (text or "") + "\0":
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] = counts.get(word, 0) + 1
            run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in counts if differ_by_one(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w], -1)) for w, n in counts.items())


def got(df, config=SpellingConfig()):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or -1) for r in spelling_forms(df, config=config).collect())


def test_same_as_sql(spark):
    rows = entry.queries()["op12_spelling"](spark, SF).toPandas().fillna({"form_n": -1})
    want = connect(SF).execute(entry.oracle_sql()["op12_spelling"]).fetchdf().fillna({"form_n": -1})
    assert compare(rows.astype({"form_n": "int64"}), want.astype({"form_n": "int64"})) is None


def texts(seed=1):
    draw = random.Random(seed)
    stems = ["receive", "received", "separate", "accommodate", "Éternité", "mississippi", "bookkeeper", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa"]
    out = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = draw.choice(stems)
            if draw.random() < 0.2:
                k = draw.randrange(len(w))
                w = w[:k] + draw.choice(["", "x", "é", w[k] * 2]) + w[k + 1 :]
            words.append(w.upper() if draw.random() < 0.1 else w)
        out.append((i % 250 if i % 9 else None, draw.choice([" ", "-", "1", "ß ", "Ā", "×"]).join(words)))
    return out + [(1, None), (2, ""), (3, "short words only"), (4, "z" * 400 + " " + "z" * 401 + " y" + "z" * 400), (4, "z" * 400 + " " + "z" * 401 + " y" + "z" * 400)]


@pytest.mark.parametrize("share", [1 << 17, 600])
def test_brute_force(spark, share):
    rows = texts()
    names = "word string, n string, near string, half string, head string, place string, kind string, root string"
    df = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], f"doc_id long, text string, {names}").repartition(4)
    assert got(df, SpellingConfig(share=share)) == brute(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    assert got(spark.createDataFrame([(1, "single longword"), (2, None)], "doc_id long, text string")) == []


def test_forms_are_followed(spark):
    rows = [(i, "wonderful " * 200) for i in range(20)] + [(100 + i, "wonderfull " * 4) for i in range(30)] + [(i, "wonderfulll") for i in (1000, 1001, 1002)]
    found = {r[0]: r for r in got(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert found["wonderfulll"][1:3] == ("wonderfull", "wonderful")
    assert list(found.values()) == brute(rows)


def test_a_half_that_all_words_share(spark):
    draw = random.Random(4)
    words = sorted({"constant" + "".join(draw.choice("abcd") for _ in range(6)) for _ in range(1500)})
    df = spark.createDataFrame([(w, 2 + i % 5) for i, w in enumerate(words)], "word string, n long")
    pairs = {(r["word"], r["near"]) for r in near_words(df, SpellingConfig(share=2000)).collect()}
    known = set(words)
    want = set()
    for w in words:
        for i in range(len(w)):
            want |= {(w, v) for v in (w[:i] + c + w[i + 1 :] for c in "abcdconstant") if v in known and v != w}
    assert pairs == want
    assert near_words(df, SpellingConfig(share=2000)).count() == len(want)


@pytest.mark.parametrize("backwards", [True, False])
@pytest.mark.parametrize("longest", [11, 90])
def test_index(backwards, longest):
    draw = random.Random(longest)
    for letters in (b"a", b"ab", b"ab\xe9"):
        words = sorted({bytes(draw.choice(letters) for _ in range(draw.randint(7, longest))) for _ in range(150)})
        exact = [len(w) // 2 if backwards else len(w) - len(w) // 2 for w in words]
        at, met = with_one_error(WordIndex(words, backwards), words, exact)
        pairs = list(zip(at.tolist(), met.tolist()))
        want = {
            (i, j) for i, a in enumerate(words) for j, b in enumerate(words)
            if differ_by_one(a, b) and (b[: exact[i]] == a[: exact[i]] if backwards else b[-exact[i] :] == a[-exact[i] :])
        }
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
        assert all(one_apart(a, b) == differ_by_one(a, b) for a in words[:40] for b in words[:40])


def test_vocabulary_of_a_null_id(spark):
    df = spark.createDataFrame([(None, "Abcdefgh"), (None, "ABCDEFGH abcdefg1")], "doc_id long, text string")
    assert [tuple(r) for r in vocabulary(df).collect()] == [("abcdefgh", 2)] or zlib.crc32(b":abcdefgh") % 31 == 0
