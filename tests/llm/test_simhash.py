import itertools
import random

from helpers import SCHEMA, awkward, components, fingerprint, frame, prose

from orebed.llm import simhash


def expected(rows):
    prints = [fingerprint(r[1]) for r in rows]
    root = components(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    return sorted(((r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints)), key=str)


def result(df):
    return sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)


def test_awkward_rows_as_brute_force(spark):
    rows = awkward()
    assert result(frame(spark, rows, clashes=True)) == expected(rows)


def test_edited_copies_as_brute_force(spark):
    r, rows = random.Random(3), []
    for i in range(300):
        w = prose(i % 25, 120).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = r.choice(["an", "the", "zz"])
        rows.append((i, " ".join(w), "en", "s", 1))
    got = result(frame(spark, rows))
    assert got == expected(rows)
    assert len({c for _, _, c in got}) < 200


def test_hot_keys_lose_no_link(spark):
    r = random.Random(1)
    centre = r.getrandbits(64)
    words = {centre ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 1, 2, 3, 4, 5]))) for _ in range(250)} | {r.getrandbits(64) for _ in range(50)}
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    df = spark.createDataFrame([(w,) for w in signed], "fp long")
    from orebed.llm.components import connected

    want = components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for bucket, levels in ((2, 0), (2, 2), (10, 2), (10**9, 2)):
        got = {row.node: row.root for row in connected(simhash.links(df, bucket, levels)).collect()}
        assert {n: got.get(n, n) for n in signed} == want


def test_one_representative_of_each_class(spark):
    rows = awkward()
    kept = simhash.representatives(spark.createDataFrame(rows, SCHEMA)).collect()
    classes = {(c if c is not None else f) for _, f, c in expected(rows)}
    assert len(kept) == len(classes) and sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, _, c in expected(rows) if c is not None})


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_ring_keys_hold_what_must_be_equal():
    assert sum(simhash.ring()) == (1 << 64) - 1 and simhash.exact_run() == 2
    assert [sorted({m.bit_count() for m in simhash.key_masks(level)}) for level in range(3)] == [[25, 26], [38, 39], [46, 47, 48]]
    for pair in itertools.combinations(range(64), 2):
        differing = sum(1 << b for b in pair)
        for level in range(3):
            assert any(not m & differing for m in simhash.key_masks(level))


def test_columns_of_helper_names_stay(spark):
    rows = [(*r, 7, 8) for r in awkward()]
    df = spark.createDataFrame(rows, f"{SCHEMA}, _key long, _key2 long")
    kept = simhash.representatives(df)
    assert kept.columns == df.columns and {(r._key, r._key2) for r in kept.collect()} == {(7, 8)}


def test_paths_that_drain_one_hop_a_round(spark):
    from orebed.llm.components import connected

    d = 1000
    path = [*range(0, 2 * d, 2), *range(2 * d - 1, 0, -2)]
    links = spark.createDataFrame([*zip(path, path[1:]), (5000, 5000), (None, 3), (7000, 7001), (7001, 7000)], "a long, b long")
    got = {r.node: r.root for r in connected(links).collect()}
    assert got == {n: 0 for n in path} | {5000: 5000, 7000: 7000, 7001: 7000}
    assert connected(links.limit(0)).count() == 0


def test_components_of_random_links(spark):
    from orebed.llm.components import connected

    r = random.Random(8)
    links = {tuple(sorted(r.sample(range(400), 2))) for _ in range(260)}
    want = components({n for link in links for n in link}, lambda a, b: (a, b) in links)
    assert {x.node: x.root for x in connected(spark.createDataFrame(sorted(links), "a long, b long")).collect()} == want


def test_ring_runs():
    assert simhash.exact_run() == 2
    assert simhash.exact_run(8, 2) == 3 and simhash.exact_run(3, 2) == 1
