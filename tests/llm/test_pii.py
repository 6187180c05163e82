import hashlib
import random
import re
import time
from collections import defaultdict
from math import log2

import regex
from helpers import SCHEMA, awkward, base_spans, frame, prose
from pyspark.sql import functions as F

from orebed.llm import pii, queries

PARTS = ["a", "b.c", "@", "x@y.z", ".", "1", "12", "255", "256", "1.2.3.4", "+1", " ", "-", "(", "555)", "4465758382889437", "é", "😀", "_", "%", "\n", "+1 (743) 555-3824", "4111 1111 1111 1111"]


def told(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_base_spans_as_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 30))), None, None, None) for i in range(1500)] + awkward()
    rows += [(-1, "1" * 100_000, None, None, None), (-2, "1.2.3.4 " * 2000, None, None, None), (-3, "+" + "1 " * 50_000, None, None, None), (-4, "a@" + "b." * 30_000 + "c", None, None, None)]
    got = pii.find(frame(spark, rows, clashes=True)).select("doc_id", pii.told(F.col("base"))).collect()
    assert sorted(map(str, ((r[0], r[1]) for r in got))) == sorted(map(str, ((r[0], told(base_spans(r[1]))) for r in rows)))


def terms_by_brute_force(rows, rule):
    """Row number -> (start, end, kind, disclosure, label) of the telling terms, by the definitions."""
    words = lambda t: [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{N}]{3,}", t)]
    shapes = lambda t: (t, t[:3] + "*", "[NUMBER]" if regex.fullmatch(r"\p{N}+", t) else "[WORD]")
    near, entities, held = [], defaultdict(set), defaultdict(set)
    for row, given in enumerate(rows):
        text = given[1] or ""
        base = base_spans(text)
        runs = [m.span() for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
        for _, _, w in words(text):
            for name in shapes(w):
                held[name].add(row)
        for s, _, e, kind in base:
            value = text[s:e].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[s:e])
            entities[kind, value].add(row)
            for low, high in ((max(0, s - rule.window), s), (e, min(len(text), e + rule.window))):
                cut_low = low > 0 and low != e
                cut_high = high != s and high - low == rule.window
                for a, b, w in words(text[low:high]):
                    a, b = a + low, b + low
                    if (cut_low and a == low) or (cut_high and b == high) or any(x < b and a < y for x, _, y, _ in base):
                        continue
                    # within the text the word may be part of a longer one that a base span cuts
                    if any(x <= a and b <= y and any(p < y and x < q for p, _, q, _ in base) for x, y in runs):
                        continue
                    near.append((row, (kind, value), a, b, w))
    both = defaultdict(set)
    for row, entity, _, _, w in near:
        for name in shapes(w):
            both[entity, name].add(row)
    total = len(rows)

    def disclosure(entity, name):
        share = len(entities[entity]) / total
        chance = (len(both[entity, name]) + rule.prior * share) / (len(held[name]) + rule.prior)
        return log2(chance / share) / log2(1 / share)

    out = defaultdict(dict)
    for row, entity, a, b, w in near:
        if len(entities[entity]) == total or (d := disclosure(entity, w)) < rule.generalise:
            continue
        levels = [disclosure(entity, name) < rule.generalise for name in shapes(w)[1:]]
        level = 2 if d >= rule.remove or not any(levels) else levels.index(True)
        was = out[row].get((a, b), (0, 0))
        out[row][a, b] = (max(was[0], d), max(was[1], level))
    label = lambda text, level: "" if level == 2 else f"[{text[:3]}*]" if level == 0 else shapes(text)[2]
    return {
        row: sorted((a, b, "removed" if level == 2 else "generalised", round(d, 9), label((rows[row][1])[a:b].lower(), level)) for (a, b), (d, level) in spans.items())
        for row, spans in out.items()
    }


def planted():
    """Names that come with an address, in few and in many documents, among prose; and awkward texts."""
    rows = [(i, f"{prose(i, 30)} agent zorblatt writes to zed@corp.example today. {prose(i + 50, 30)}", "en", "s", 1) for i in range(30)]
    rows += [(40 + i, f"{prose(i + 90, 9)} Quimby, 40021 rue, quim{i}@corp.example or +1 (743) 555-38{i:02d} x@y.z,Quimby {prose(i, 9)}", "en", "s", 1) for i in range(6)]
    rows += [(100 + i, prose(200 + i, 40), "en", "s", 1) for i in range(160)] + [(300, "agent today writes", "en", "s", 1)] * 60
    rows += [(400, "naïve\0word 漢字漢字 x漢字a@b.de😀😀 éa@b.de été" + "y" * 200 + " a@b.de " + "z" * 90, "en", "s", 1)]
    return rows + awkward()


def test_terms_as_brute_force(spark):
    rows = planted()
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    for rule in (pii.Disclosure(), pii.Disclosure(generalise=0.3, remove=0.6, prior=1.0), pii.Disclosure(window=20, generalise=0.05, remove=0.95)):
        got = {}
        for r in pii.find(spark.createDataFrame(rows, SCHEMA), rule).where("size(terms) > 0").collect():
            got[r.doc_id] = sorted((t.start, t.end, t.kind, round(t.disclosure, 9), t.label) for t in r.terms)
        want = terms_by_brute_force(rows, rule)
        assert got == want and len(want) > 5
        assert rule.remove != 0.9 or {t[2] for found in want.values() for t in found} == {"removed", "generalised"}


def test_sanitised_texts(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(planted())]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id is not None}
    clashes = ", ".join(f"`{c}` string" for c in ("key", "key2", "_key", "_key2", "spans", "_spans", "blocks", "_id", "_row", "row", "Base"))
    df = spark.createDataFrame([(*r, *["x"] * 11) for r in rows], f"{SCHEMA}, {clashes}")
    done = pii.sanitise(df)
    assert done.columns == df.columns
    clean = done.collect()
    assert len(clean) == len(rows) and all(r[5:] == ("x",) * 11 for r in clean)
    texts = {r.doc_id: r.text for r in clean}
    for i, text, *_ in rows:
        spans = sorted([(s[0], s[1], s[2], f"[{s[3].upper()}]") for s in base_spans(text)] + [(t.start, 4, t.end, t.label) for t in found[i].terms])
        want, at = "", 0
        for start, _, end, label in spans:
            want += (text or "")[at : max(at, start)] + label
            at = max(at, end)
        assert texts[i] == (text if text is None else want + text[at:])
    assert "agent  writes to [EMAIL] today." in texts[0] and "[WORD],  [WORD], [EMAIL]" in texts[31]


def test_many_mentions_take_time_in_proportion(spark):
    took = []
    for n in (2000, 8000):
        text = " ".join(f"name{i} lives at no{i}.x@mail{i % 9}.example.com since {i}." for i in range(n))
        df = spark.createDataFrame([(1, text, "en", "s", 1), (2, "x", "en", "s", 1)], SCHEMA)
        start = time.monotonic()
        rows = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
        took.append(time.monotonic() - start)
        assert rows[1].count("[EMAIL]") == n and rows[2] == "x"
    assert took[1] < 4 * took[0] + 20


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(awkward(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for row in queries.op3_pii(spark, str(tmp_path)).collect():
        texts = [r[1] for r in awkward() if r[0] == row.doc_id]
        spans = base_spans(texts[0])
        assert row.base_sha256 == hashlib.sha256(told(spans).encode()).hexdigest() or row.doc_id is None
        assert row.n_email == sum(s[3] == "email" for s in spans) or row.doc_id is None


def test_main_path_is_native(spark):
    plan = pii.find(frame(spark, awkward()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert pii.find(frame(spark, [])).count() == 0 and pii.sanitise(frame(spark, [])).count() == 0
