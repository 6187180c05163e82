import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import awkward, frame, prose, words
from pyspark.sql import functions as F

from orebed.llm import langid, quality, queries


def base(text):
    text = text or ""
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, t in enumerate(tri) for j in range(3) if tri.count(t) > 1} if len(tri) < 400 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, hit


def test_base_counts_as_brute_force():
    for text in [t for _, t, *_ in awkward()] + ["a a a a", "a b c a b c d", "x y z\n x y z\nx y z", "|| ## \n\n|| ## \n", "w\x1cw\x85w\xa0w w w"]:
        n, chars, symbols, dup, hit = base(text)
        got = quality.base_counts(text or "")
        assert got[:4] == (n, chars, symbols, dup) and (hit is None or got[4] == len(hit))


def test_lines_and_verdict(spark):
    good = prose(1, 120)
    menu = "Home | News | Sport | Login | Search | Help"
    rows = [(1, good, "en", "s", 1), (2, "\n".join([menu] * 9 + [prose(2, 55)]), "en", "s", 1), (3, good + "\nPlease enable JavaScript to continue.\n" + menu, "en", "s", 1), (4, "too short.", "en", "s", 1)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert got[1].kept and got[1].cleaned_text == good
    assert not got[2].kept and got[2].navigation_lines == 9
    assert got[3].kept and got[3].cleaned_text == good + "\n" * 0 and got[3].boilerplate_lines == 1
    assert got[4].base_failed and not got[4].kept
    kept = {r.doc_id: r.n_chars for r in quality.cleaned(frame(spark, rows)).collect()}
    assert kept == {1: len(good), 3: len(good)}


def test_awkward_rows(spark):
    got = quality.judge(frame(spark, awkward(), clashes=True), texts=False).collect()
    assert len(got) == len(awkward()) and all(r.base_failed and r.n_words == 0 for r in got if r.doc_id in (1, 2, 3))
    assert quality.judge(frame(spark, [])).count() == 0 and quality.cleaned(frame(spark, [])).count() == 0


def test_language_of_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    lang = dict(rows)
    got = queries.op5_language(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in got} == set(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    got = {r.doc_id: r for r in langid.identify(frame(spark, awkward(), clashes=True)).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} >= {1, 2, 3, 12} and got[1].score == 0
    assert langid.identify(frame(spark, [])).count() == 0
    nobody = langid.identify(frame(spark, [(1, "some words", None, "s", 1)])).collect()
    assert nobody[0].lang_pred == "und"


def test_pieces_of_long_texts_add_up():
    import numpy as np

    text = "Ab, çd! 12 xyz " * 300
    space = langid.Space(256, 3)
    whole = space.sums([text])[0]
    langid.RUN_CHARS, kept = 97, langid.RUN_CHARS
    try:
        assert np.array_equal(space.sums([text])[0], whole)
    finally:
        langid.RUN_CHARS = kept
    grams = {}
    letters = "".join(c.lower() if c.isalpha() else " " for c in f" {text} ")
    letters = " ".join(letters.split())
    letters = f" {letters} "
    for i in range(len(letters) - 2):
        grams[letters[i : i + 3]] = grams.get(letters[i : i + 3], 0) + 1
    number = {p: i for i, p in enumerate(space.points)}
    want = sum(n * space._gram(tuple(number[0 if c == " " else ord(c)] for c in g)).astype(float) for g, n in grams.items())
    assert np.array_equal(want, whole)


def plain_vector(text, dims):
    """The sum of a text's letter trigrams, one by one."""
    letters = ""
    for c in f" {text} ":
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or not letters.endswith(" "):
            letters += c
    signs = lambda c: np.random.default_rng(0 if c == " " else ord(c)).integers(0, 2, dims) * 2 - 1
    out = np.zeros(dims)
    for gram, n in Counter(zip(letters, letters[1:], letters[2:])).items():
        out += n * np.roll(signs(gram[0]), 2) * np.roll(signs(gram[1]), 1) * signs(gram[2])
    return out


def test_predictions_as_brute_force(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 4000]
    rows = [tuple(r) for r in rows][:70] + [r for r in awkward() if len(r[1] or "") < 40_000]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    dims = langid.Settings().dims
    made = [plain_vector(r[1] or "", dims) if any(c.isalpha() for c in r[1] or "") else np.zeros(dims) for r in rows]
    sums = defaultdict(lambda: np.zeros(dims))
    for r, v in zip(rows, made):
        if r[0] is not None and not held(r[0]) and r[2] is not None and r[1] is not None:
            sums[r[2]] += v
    names = sorted(n for n, v in sums.items() if v.any())
    want = []
    for r, v in zip(rows, made):
        cosines = [v @ sums[n] / np.linalg.norm(v) / np.linalg.norm(sums[n]) for n in names] if v.any() else [0.0]
        best = int(np.argmax(cosines))
        want.append((str(r[0]), held(r[0]), names[best] if v.any() else "und", round(max(0.0, cosines[best]), 9)))
    got = langid.identify(frame(spark, rows, clashes=True)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == sorted(want)


def test_nine_hundred_languages(spark):
    rows = [(i, f"text of number {'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10 % 10] * 4} {'uvwxyzabcd'[i // 100] * 5}", f"l{i:03d}", "s", 1) for i in range(900)]
    settings = langid.Settings(dims=64)
    names, _ = langid.train(frame(spark, rows), settings)
    assert len(names) == 900
    model = langid.train(frame(spark, rows[:50]), settings)
    df = frame(spark, rows[:50]).withColumn("score", F.lit("x")).withColumn("Lang_Pred", F.lit("y"))
    tagged = langid.tag(df, model, settings)
    assert tagged.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    assert all(r.lang_pred == r.lang for r in tagged.select("lang", "lang_pred").collect())
