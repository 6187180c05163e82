import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orebed.functions import pixels, predicates
from orebed.operators import aggregates, lookups, windows

PATHS = ["anim/terran/marine.anim", "HD2/anim/zerg/x.anim", "hd2\\anim\\p.anim", "SD/anim/x.anim", "SD/mainSD.anim", "sd\\units.dat", "sound/zerg/a.WAV", "readme.txt", "locales\\enUS\\a.txt", "Anim/Z.GRP"]
PATTERNS = [".*terran.*", ".*zerg.*", r"\.anim$", "anim", "^SD", ".*SD.*", "x", "[", "(?i)GRP"]


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column).first()[0]


def paths(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


def test_tiers(spark):
    got = [r[0] for r in paths(spark).select(predicates.tier(F.col("path"))).collect()]
    assert got == ["HD", "HD2", "HD2", "HD", "SD", "SD", None, None, None, "HD"]
    fits = [r[0] for r in paths(spark).select(predicates.tier_fits(predicates.tier(F.col("path")), "sd")).collect()]
    assert fits == [t == "SD" for t in got]
    assert one(spark, predicates.tier_folder(F.lit(None).cast("string"))) == "unknown"


def plain_verdict(path, include, exclude, eligible):
    import re

    if any(re.search(p, path) for p in exclude):
        return "Exclude"
    if not eligible or include and not any(re.search(p, path) for p in include):
        return "Skip"
    return "Include"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([p for p in PATTERNS if p != "["]), max_size=2), st.lists(st.sampled_from([p for p in PATTERNS if p != "["]), max_size=2), st.booleans())
def test_verdicts_and_counts(spark, include, exclude, eligible):
    df = paths(spark).withColumn("verdict", predicates.verdict(F.col("path"), include, exclude, F.lit(eligible)))
    got = {r.path: r.verdict for r in df.collect()}
    assert got == {p: plain_verdict(p, include, exclude, eligible) for p in PATHS}
    stats = aggregates.filter_stats(df).first()
    assert stats.total == len(PATHS) == stats.included + stats.excluded + stats.skipped
    assert abs(stats.inclusion_rate + stats.exclusion_rate + stats.skip_rate - 100) < 1e-9


def test_invalid_patterns(spark):
    with pytest.raises(ValueError):
        predicates.verdict(F.col("path"), ["["])
    assert paths(spark).where(predicates.passes(F.col("path"), ["["])).count() == len(PATHS)
    assert paths(spark).where(predicates.passes(F.col("path"), ["[", "zerg"], ["WAV"])).count() == 1


def test_signatures_sizes_and_entropy(spark):
    rows = [("p", b"\x89PNG\r\n\x1a\n12"), ("j", b"\xff\xd8\xff\xe0"), ("k", b"\xff\xd8\x00"), ("o", bytes(range(4))), ("n", None), ("d", bytes(range(256)) * 5), ("e", b"")]
    df = spark.createDataFrame(rows, "id string, content binary")
    c = F.col("content")
    got = {r.id: r for r in df.select("id", predicates.has_png(c).alias("png"), predicates.has_jpeg(c).alias("jpeg"), predicates.has_jpeg(c, True).alias("marker"), predicates.compressed_like(c).alias("dense"), predicates.format_fits(c, "jpeg").alias("fits"), aggregates.byte_entropy(c).alias("entropy")).collect()}
    assert [i for i in got if got[i].png] == ["p"] and [i for i in got if got[i].jpeg] == ["j"] and [i for i in got if got[i].marker] == ["j", "k"]
    assert [i for i in got if got[i].fits] == ["j", "k"] and [i for i in got if got[i].dense] == ["d"]
    assert got["d"].entropy == 8.0 and got["e"].entropy == got["n"].entropy == 0.0 and abs(got["o"].entropy - 2) < 1e-12
    assert one(spark, predicates.entropy_valid(F.lit(7.97))) and not one(spark, predicates.entropy_valid(F.lit(8.0)))
    assert [one(spark, predicates.sprite_size(F.lit(n))) for n in (1023, 1024, 10485760, 10485761)] == [False, True, True, False] and one(spark, predicates.listed_size(F.lit(16)))
    by_rows = aggregates.byte_histogram(df, "id", "content").where("id = 'd'").agg(F.count("*"), F.sum("n")).first()
    assert tuple(by_rows) == (256, 1280)
    assert math.isclose(aggregates._entropy("aab"), -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))


def test_names(spark):
    assert one(spark, predicates.basename(F.lit("a\\b/c.x"))) == "c.x" and one(spark, predicates.slashed(F.lit("a\\b"))) == "a/b"
    assert one(spark, predicates.located(F.lit("x.txt"), "enUS")) == "locales\\enUS\\x.txt" and one(spark, predicates.located(F.lit("locales\\enUS\\x"), "enUS")) == "locales\\enUS\\x"
    assert one(spark, predicates.safe_name(F.lit("(2) Ünï-map_1"))) == "_2__Ünï-map_1"
    assert [one(spark, predicates.tileset_of(F.lit(e))) for e in (0, 3, 4, 7, 8)] == ["badlands", "jungle", "jungle", "twilight", "badlands"]
    assert [one(spark, predicates.quality_prefix(F.lit(q))) for q in ("sd", "HD2", "hd4")] == ["SD/", "HD2/", ""]
    assert one(spark, predicates.is_audio(F.lit("Sound/Zerg/A.WAV"), ["zerg"])) and one(spark, predicates.probed(F.lit("abc"), F.lit("X"), "AB"))
    assert one(spark, predicates.found_in(F.lit("locales/enUS/Zerg"), "zerg", "ENUS"))
    with pytest.raises(ValueError):
        predicates.choice("x", predicates.FORMATS)


def test_pixel_columns(spark):
    assert one(spark, pixels.luminance(F.lit(255), F.lit(255), F.lit(255))) == 255 and one(spark, pixels.luminance(F.lit(1), F.lit(2), F.lit(3))) == (299 + 1174 + 342 + 500) // 1000
    assert one(spark, pixels.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64
    assert one(spark, pixels.adjacent_bits(F.array(*map(F.lit, [1, 2, 2, 1, 9])), 4)) == 0b1001
    assert tuple(one(spark, pixels.mask_pixel(F.lit(9), F.lit(9), F.lit(9), F.lit(0)))) == (0, 0, 0, 0)


def test_next_offsets_with_ties(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (1, 30), (1, 30), (1, 90_000_000), (2, 5)], "f int, o long")
    got = sorted(map(tuple, df.select("f", "o", windows.next_greater("o", "f"), windows.inferred_size("o", "f")).collect()), key=str)
    assert got == sorted([(1, 10, 30, 20), (1, 10, 30, 20), (1, 30, 90_000_000, None), (1, 30, 90_000_000, None), (1, 90_000_000, None, None), (2, 5, None, None)], key=str)


def test_next_offsets_by_ranges(spark):
    import random

    r = random.Random(1)
    rows = sorted({(r.randrange(3), r.choice([r.randrange(1 << 32), r.randrange(5000)])) for _ in range(400)})
    want = {(f, o): min((p for g, p in rows if g == f and p > o), default=None) for f, o in rows}
    got = windows.next_offsets(spark.createDataFrame(rows, "f int, o long"), "f", "o", bits=12).collect()
    assert {(x.f, x.o): x.next for x in got} == want


def test_frame_ends_differ_from_next_offsets(spark):
    df = spark.createDataFrame([("a", 0, 10, 99), ("a", 1, 50, 99), ("a", 2, 30, 99), ("a", 3, 40, 99)], "file string, frame_idx int, offset int, length int")
    assert {r.frame_idx: r.end for r in windows.frame_ends(df).collect()} == {0: 50, 1: 99, 2: 40, 3: 99}
    lines = spark.createDataFrame([(0, 4, 20), (1, 8, 20), (2, 6, 20), (3, 30, 20)], "line int, o int, e int")
    assert [r[0] for r in lines.select(windows.line_ends("line", "o", "e").alias("x"), "line").orderBy("line").collect()] == [8, 20, 20, 20]


def test_sets_and_limits(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, windows.upsert(old, new, "k").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert {r.k: r.source for r in windows.prefer_live(new, old, "k").collect()} == {1: "fallback", 2: "live", 3: "live"}
    ids = spark.range(100)
    assert windows.first_then_filter(ids, "id", 10, F.col("id") % 3 == 0).count() == 4
    assert [r.id for r in windows.head(ids, 3, "id").collect()] == [0, 1, 2]
    assert one(spark, windows.merged(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))) == [1, 2]
    cells = {r.id: (r.atlas_index, r.col, r.row) for r in windows.atlas_cells(spark.range(5, 40).union(spark.range(5, 40)), "id").collect()}
    assert cells[5] == (0, 0, 0) and cells[22] == (17, 0, 1) and len(cells) == 35
    steps = spark.createDataFrame([(0, 1), (1, 3), (2, 2)], "x int, v int").select(windows.adjacent_less("v", "x").alias("l"), "x").orderBy("x").collect()
    assert [r.l for r in steps] == [True, False, None]


def test_candidates_in_order(spark):
    targets = spark.createDataFrame([("t", ["x\\y", "b"]), ("u", ["none", "b"]), ("w", ["none"])], "target string, candidates array<string>")
    listing = spark.createDataFrame([("x/y", 1), ("b", 1), ("none", 0)], "path string, length int")
    got = lookups.first_candidate(targets, listing, "target", "candidates", "path", (lambda p: p, predicates.slashed), F.col("length") > 0).collect()
    assert {r.target: (r.path, r.pos, r.variant) for r in got} == {"t": ("x/y", 0, 1), "u": ("b", 1, 0)}


def test_keywords(spark):
    assert lookups.keywords("Marine_attack_éé") == ["mari", "atta", "éé"] and lookups.keywords("a__éééé") == ["a", "éé"]
    listing = spark.createDataFrame([(2, "sound/marine_attack.wav"), (1, "SOUND/Attack/Marines.ogg"), (0, "x")], "pos int, path string")
    got = lookups.first_with_keywords(listing, {"m": lookups.keywords("marine_attack"), "z": ["zerg"]}, F.col("path"), "pos", "path").collect()
    assert [tuple(r) for r in got] == [("m", "SOUND/Attack/Marines.ogg")]


def test_references_layers_and_palettes(spark):
    rows = spark.createDataFrame([(0, None, "a"), (1, 0, None), (2, 5, None), (3, 3, None)], "i int, ref int, v string")
    assert {r.i: r.v for r in lookups.back_referenced(rows, "i", "ref", ["v"]).collect()} == {0: "a", 1: "a", 2: None, 3: None}
    names = F.array(F.lit("Diffuse"), F.lit("TeamColor"))
    assert one(spark, lookups.layer_index(names, F.lit("teamcolor"))) == 1 and one(spark, lookups.layer_index(names, F.lit("normal"))) == 2 and one(spark, lookups.layer_index(names, F.lit("zzz"))) is None
    palette = spark.createDataFrame([(1, 9, 8, 7, 6)], "idx int, r int, g int, b int, a int")
    got = lookups.coloured(spark.createDataFrame([(0, 1), (1, 200)], "pos int, idx int"), palette).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, 1, 9, 8, 7, 6), (1, 200, 255, 0, 255, 255)]
    assert one(spark, lookups.fallback_matches(F.lit("a\\B\\c.png"), F.lit("b/C.png"))) and not one(spark, lookups.fallback_matches(F.lit("ab.png"), F.lit("b.png")))


def test_roll_ups(spark):
    df = spark.createDataFrame([(True, "HD", 0), (False, None, 9), (None, "HD", 255)], "passed boolean, tier string, a int")
    assert tuple(aggregates.roll_up(df).first())[:3] == (3, 1, 2) and aggregates.roll_up(df.limit(0)).first().pass_rate == 0.0
    assert {r.tier: (r.processed, r.skipped) for r in aggregates.tier_stats(df, "tier", F.col("passed")).collect()} == {"HD": (1, 1), "unknown": (0, 1)}
    assert tuple(df.agg(*aggregates.alpha_stats(F.col("a"))).first()) == (1, 1, 1)
    assert aggregates.fully_found(df.select(F.coalesce("passed", F.lit(False)).alias("ok")), "ok") == (1, 2)
    with pytest.raises(RuntimeError):
        aggregates.fully_found(df.select(F.coalesce("passed", F.lit(False)).alias("ok")), "ok", required=True)
    stats = aggregates.filter_stats(df.select(F.lit("Include").alias("verdict"), "tier"), tier="tier", formats={"png": F.lit(True)}).first()
    assert (stats.tier_hd, stats.tier_unknown, stats.format_png) == (2, 1, 3)
    assert np.isclose(one(spark, aggregates.rate(F.lit(1), F.lit(3))), 100 / 3)
