import itertools
import random

import numpy as np
from helpers import SCHEMA, awkward, components, frame, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from orebed.llm import shingles


def shingle_set(text):
    w = words((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def linked(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    sets = [shingle_set(r[1]) for r in rows]
    distinct = sorted(set(sets), key=sorted)
    root = components(range(len(distinct)), lambda i, j: linked(distinct[i], distinct[j]))
    place = {s: i for i, s in enumerate(distinct)}
    least = {}
    for r, s in zip(rows, sets):
        least[root[place[s]]] = min(least.get(root[place[s]], r[0]), r[0])
    return sorted(least.values())


def edited(seed, n, texts, most):
    r, rows = random.Random(seed), []
    for i in range(n):
        w = prose(i % texts, 120).split(" ")
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = r.choice(["an", "the", "zz"])
        rows.append((i, " ".join(w), "en", "s", 1))
    return rows


def test_edited_copies_as_all_pairs(spark):
    rows = edited(3, 200, 25, 4)
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_crowded_keys_lose_no_link(spark):
    rows = edited(4, 120, 2, 7)
    want = kept(rows)
    assert 2 < len(want) < 120
    for bucket in (2, 10**9):
        assert sorted(r.doc_id for r in shingles.representatives(frame(spark, rows), bucket).collect()) == want


def test_unlike_texts_of_a_common_passage(spark):
    passage = prose(77, 60)
    rows = [(i, f"{passage} {prose(500 + i // 2, 14)} {'x' if i % 2 else 'y'}", "en", "s", 1) for i in range(160)]
    want = kept(rows)
    assert 70 < len(want) <= 80
    assert sorted(r.doc_id for r in shingles.representatives(frame(spark, rows), 8).collect()) == want


def test_rarest_shingles_bring_similar_sets_together(spark):
    r = random.Random(5)
    sets = {i: sorted(r.sample(range(60), r.randint(1, 40))) for i in range(80)}
    sets |= {100 + i: sorted({*s, 99} - set(s[:1])) for i, s in sets.items()}
    got = {}
    for row in shingles.rare_first(spark.createDataFrame(list(sets.items()), "node long, hashes array<long>")).collect():
        got.setdefault(row.token, set()).add(row.node)
    for a, b in itertools.combinations(sets, 2):
        if linked(frozenset(sets[a]), frozenset(sets[b])):
            assert any(a in nodes and b in nodes for nodes in got.values())


def test_awkward_rows(spark):
    got = shingles.representatives(spark.createDataFrame(awkward(), SCHEMA)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 4, 6, 7, 8, 9, 10, 11, 12] and sum(r.doc_id is None for r in got) == 1
    assert shingles.representatives(frame(spark, [])).count() == 0


def boxes(a, b, count):
    """The number of hashes in which sets differ, for each segment of a ring."""
    out = [0] * count
    for h in a ^ b:
        out[(h >> 32) * count >> 32] += 1
    return out


def test_similar_sets_share_the_start_of_a_chain_within_its_budgets(spark):
    r, pairs, asked = random.Random(6), 0, []
    for _ in range(4000):
        n = r.choice((r.randint(4, 12), r.randint(4, 130)))
        a = {r.getrandbits(64) for _ in range(n)}
        gone = r.randint(0, n // 5)
        b = set(r.sample(sorted(a), n - gone)) | {r.getrandbits(64) for _ in range(r.randint(0, max(0, (5 * (n - gone)) // 4 - n)))}
        if a == b or not linked(a, b):
            continue
        pairs += 1
        count = shingles.ring_size(max(len(a), len(b)).bit_length())
        differ = boxes(a, b, count)
        assert sum(differ) <= shingles.differences(len(a), max(len(a), len(b)).bit_length())
        good = [i for i in range(count) if all(sum(differ[(i + j) % count] for j in range(x)) < x for x in range(1, count + 1))]
        assert len(good) >= count - sum(differ) > 0
        (keys_a, chains_a), (keys_b, chains_b) = (map(list, map(np.ndarray.tolist, shingles.ring_keys(np.array(sorted(s), np.uint64)))) for s in (a, b))
        common = set(keys_a) & set(keys_b)
        assert common
        asked.append([(pairs, chains_a[keys_a.index(k)], chains_b[keys_b.index(k)]) for k in common])
    assert pairs > 2000
    rows = spark.createDataFrame([row for rows in asked for row in rows], "pair int, a long, b long")
    within = rows.where(shingles.within_chain(F.col("a"), F.col("b"))).select("pair").distinct().count()
    assert within == pairs


def test_chains_prune_unlike_sets_of_a_common_segment(spark):
    r, rows = random.Random(7), []
    for _ in range(400):
        level, (a, b) = 7, ([r.getrandbits(64) for _ in range(100)] for _ in range(2))
        part = {h for h in a if (h >> 32) * shingles.ring_size(level) >> 32 == 9}
        b = part | {h for h in b if (h >> 32) * shingles.ring_size(level) >> 32 != 9}
        (keys_a, chains_a), (keys_b, chains_b) = (map(list, map(np.ndarray.tolist, shingles.ring_keys(np.array(sorted(s), np.uint64)))) for s in (a, b))
        rows += [(chains_a[keys_a.index(k)], chains_b[keys_b.index(k)]) for k in set(keys_a) & set(keys_b)]
    kept_pairs = spark.createDataFrame(rows, "a long, b long").where(shingles.within_chain(F.col("a"), F.col("b"))).count()
    assert len(rows) > 100 and kept_pairs < len(rows) / 10


def test_pairs_at_the_bound_are_found_for_certain(spark):
    """Texts of 45 shingles that differ in one word; no MinHash band of round 2 was the same in these three pairs."""
    rows = []
    for seed in (3142, 3458, 5027):
        r = random.Random(seed)
        w = [f"w{r.randrange(10**6)}" for _ in range(49)]
        rows += [(seed, " ".join(w), "en", "s", 1), (seed + 1, " ".join([*w[:20], "other", *w[21:]]), "en", "s", 1)]
    assert sorted(r.doc_id for r in shingles.representatives(frame(spark, rows)).collect()) == [3142, 3458, 5027] == kept(rows)
