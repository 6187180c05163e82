"""Near duplicates by shingles of SHINGLE words: texts whose shingle sets share LEAST of their union (Jaccard similarity).

It is the form of the SimHash operator for a bound on similarity, by pigeonring filtering as well. At a similarity of 0.8 the 64-bit
fingerprints differ in some 10 bits, up to about 20, and no exact key of a useful width is left of 64 bits then. So the ring isn't cut
by bits but by shingles: the values that a shingle's hash can take, in a circle, are cut into segments, and a set has a SimHash
fingerprint and a count for each.

* Similar sets of n and m shingles differ in D = floor((n + m) / 9) shingles at most. On a ring of K segments, K over D, at least K - D
  segments start chains of which any first l segments differ in l - 1 shingles at most, all around the ring (the cycle lemma, which
  gives the strong form of the pigeonhole principle its number of starts). Such a start itself is equal in both sets, so its number,
  count and fingerprint are an exact join key; counts and fingerprints of the next segments bound the differences from below and prune
  what the key lets through. No link is lost, whatever the texts.
* Of the starts that a set may have, it leaves out its K - D - 1 with the fewest shingles: that leaves the best start of each pair in
  both. K grows with the size in steps of two, and a set also takes the next step's ring if similar sets can be of that size.
* Keys of up to MAX_BUCKET sets are joined with themselves; fingerprints of the whole sets prune the pairs by their Hamming distance,
  and what is left is checked on the whole sets.
* Sets that have a crowded key are compared with each other by another, exact key: with shingles ordered by how rare they are
  among these sets (as a count by buckets of fixed number tells), similar sets share one of their first n - ceil(0.8 n) + 1 shingles. A passage that many unlike texts have in
  common isn't rare, so it brings none of them together.
* Where such a shingle is crowded too, its sets are near copies for the most part: a few of them (pivots) are compared with all
  others that aren't in the same component yet, in rounds that take 16 times as many pivots as the one before, until the sets
  that are left form one component. So no link between components is lost, and no pairs are made within a component.

Rows: texts are lowered in ASCII and split at ASCII space. A text of fewer than SHINGLE words is one shingle; texts without a word
are equal. Equal rows each count; null doc_ids come after all others. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.llm.components import connected, extended
from orebed.llm.frames import map_columns, pick, row_key, second_key
from orebed.llm.rows import KEYS, kept_rows, sent_if_small
from orebed.llm.simhash import bits_of, shingle_hashes, signed
from orebed.session import discard, written

SHINGLE, SEED = 5, 42
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
MAX_BUCKET = 64
#: Of SPARE differing shingles one is added to the segments of a ring, so that sets can leave out their weakest starts.
SPARE = 4
#: Segments after a start that its chain tells, a byte each: a count in 4 bits and 4 bits of the fingerprint.
CHAIN = 8
MOST_TOLD = 15
#: Fingerprints of more differing bits aren't compared further. At a similarity of 0.8 the mean is 10 and the standard deviation 3.
FAR = 28
#: Buckets in which the rarity of shingles is counted; they go to every task.
BUCKETS = 1 << 20
#: Pivots of a key in the first round, and how many times as many each further round takes.
PIVOTS, GROWTH = 4, 16
#: Segments whose bits are summed at once; bounds memory for very long texts.
CHUNK = 1 << 12


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    return np.unique(np.fromiter(shingle_hashes(text, SHINGLE), np.uint64))


def differences(size: int, level: int) -> int:
    """The most shingles in which a set of this size differs from a similar one of fewer than 2^level."""
    part, whole = LEAST
    other = min(size * whole // part, (1 << level) - 1)
    return (size + other) * (whole - part) // (whole + part)


def levels(size: int) -> range:
    """Levels of the sets that are similar to one of this size and no smaller; the larger one's level is that of a pair."""
    part, whole = LEAST
    return range(size.bit_length(), (size * whole // part).bit_length() + 1)


def ring_size(level: int) -> int:
    """How many segments the ring of a level has."""
    most = differences((1 << level) - 1, level)
    return most + 1 + max(1, most // SPARE)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted hashes each segment of the ring has, and their SimHash."""
    places = ((hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    sizes = np.bincount(places, minlength=count)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    prints, filled = np.zeros(count, np.uint64), np.flatnonzero(sizes)
    for at in range(0, len(filled), CHUNK):
        part = filled[at : at + CHUNK]
        first, last = edges[part[0]], edges[part[-1] + 1]
        bits = np.unpackbits(hashes[first:last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edges[part] - first, axis=0, dtype=np.int32)
        prints[part] = np.packbits(2 * ones > sizes[part, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return sizes, prints


def ring_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each start on the rings of a set's levels, and the chain after it; none for a set that no other is similar to."""
    keys, chains = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for level in levels(len(hashes)):
        if not (most := differences(len(hashes), level)):
            continue
        count = ring_size(level)
        sizes, prints = segments(hashes, count)
        starts = np.argsort(sizes, kind="stable")[count - most - 1 :]
        contents = _mixed(prints + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys.append(_mixed(contents[starts] + (starts + (level << 40)).astype(np.uint64)).view(np.int64))
        told = (np.minimum(sizes, MOST_TOLD).astype(np.uint64) | (contents >> np.uint64(60) << np.uint64(4))).astype(np.uint8)
        after = told[(starts[:, None] + np.arange(1, CHAIN + 1)) % count]
        after[:, count - 1 :] = 0
        chains.append(after.view("<i8")[:, 0])
    return np.concatenate(keys), np.concatenate(chains)


def within_chain(a: Column, b: Column) -> Column:
    """Whether the chains after an equal start stay within their budgets: one differing shingle more for each segment."""
    spent, verdict = F.lit(0), F.lit(True)
    for i in range(CHAIN):
        x, y = (F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255)) for c in (a, b))
        n, m = (c.bitwiseAND(F.lit(MOST_TOLD)) for c in (x, y))
        # unlike contents of equal counts differ in two shingles at least, but a count of MOST_TOLD may be a higher one
        spent = spent + F.when(n != m, F.abs(n - m)).when(x == y, 0).when(n == MOST_TOLD, 1).otherwise(2)
        verdict = verdict & (spent <= i + 1)
    return verdict


def node_of(hashes: np.ndarray) -> int:
    """A hash of a set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key and key2 (of doc_id and text), node (a hash of the text's set), size (of the set), fp (its fingerprint)."""
    given = pick(docs, "doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("key"), second_key("doc_id", "text").alias("key2"), "text")

    def run(ids: list, keys: list, keys2: list, texts: list) -> tuple[list, ...]:
        sets = [shingle_set(t) for t in texts]
        nodes = [signed(node_of(s)) for s in sets]
        return ids, keys, keys2, nodes, [len(s) for s in sets], [signed(bits_of(iter(s.tolist()))) for s in sets]

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, key long, key2 long, node long, size int, fp long"
    return map_columns(given, run, schema)


def ring_index(docs: DataFrame) -> DataFrame:
    """node, band (a key that it shares with another node), chain: each once."""

    def run(texts: list) -> tuple[np.ndarray, ...]:
        sets = [shingle_set(t) for t in texts]
        found = [ring_keys(s) for s in sets]
        nodes = np.repeat(np.array([signed(node_of(s)) for s in sets], np.int64), [len(keys) for keys, _ in found])
        return nodes, *(np.concatenate(columns) for columns in zip(*found))

    keys = map_columns(pick(docs, "text"), run, "node long, band long, chain long", rows=64)
    alike = Window.partitionBy("band")
    ends = keys.select("*", F.min("node").over(alike).alias("low"), F.max("node").over(alike).alias("high"))
    return ends.where("low <> high").select("node", "band", "chain").distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes: the sets of the wanted nodes. wanted: node, and key and key2 of one of its rows."""
    texts = pick(docs, "doc_id", "text").select(row_key("doc_id", "text").alias("key"), second_key("doc_id", "text").alias("key2"), "text")
    found = texts.join(sent_if_small(wanted), list(KEYS)).select("node", "text")

    def run(nodes: list, texts: list) -> tuple[list, ...]:
        return nodes, [shingle_set(t).view(np.int64).tolist() for t in texts]

    return map_columns(found, run, "node long, hashes array<long>").dropDuplicates(["node"])


def _likely(size_a: Column, size_b: Column, fp_a: Column, fp_b: Column) -> Column:
    """Whether sizes and fingerprints allow two sets to be similar enough."""
    part, whole = LEAST
    smaller, larger = F.least(size_a, size_b).cast("long"), F.greatest(size_a, size_b).cast("long")
    return (smaller * whole >= larger * part) & (F.bit_count(fp_a.bitwiseXOR(fp_b)) <= FAR)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    part, whole = LEAST
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common, total = F.size(F.array_intersect("set_a", "set_b")).cast("long"), (F.size("set_a") + F.size("set_b")).cast("long")
    return both.where(whole * common >= part * (total - common)).select("a", "b")


def _room(size_a: Column, size_b: Column, place_a: Column, place_b: Column) -> Column:
    """Whether sets whose first common shingle has these places can have enough in common."""
    part, whole = LEAST
    most = (1 + F.least(size_a - place_a, size_b - place_b)).cast("long")
    return most * (whole + part) >= (size_a + size_b).cast("long") * part


def _sides(a: DataFrame, b: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows of a with rows of b of the same key that are likely to be similar: node, size and fp with _a and _b, and `more`."""
    columns = ("node", "size", "fp", *more)
    left, right = (rows.select(key, *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x, rows in (("a", a), ("b", b)))
    near = left.join(right, key).where(_likely(*map(F.col, ("size_a", "size_b", "fp_a", "fp_b"))))
    return near.where(_room(*map(F.col, ("size_a", "size_b", "place_a", "place_b")))) if "place" in more else near


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _crowded(rows: DataFrame, key: str, max_bucket: int) -> tuple[DataFrame, DataFrame]:
    """rows of keys that 2 to max_bucket rows share, and of those that more share."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    shared = written(rows.join(counts, key), "shingles-shared")
    return shared.where(F.col("n") <= max_bucket).drop("n"), shared.where(F.col("n") > max_bucket).drop("n")


def rarity(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each bucket: a table of fixed size, whatever the number of sets."""
    bucket = F.col("token").bitwiseAND(F.lit(BUCKETS - 1).cast("long")).alias("bucket")
    found = sets.select(F.explode("hashes").alias("token")).groupBy(bucket).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def rare_first(sets: DataFrame) -> DataFrame:
    """node, token, place: of each set the rarest shingles, of which similar sets share one.

    Any order that is the same for all sets will do, so rarity is counted by buckets of shingles; ties go by the shingle.
    """
    part, whole = LEAST
    counts = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def run(nodes: list, hashes: list) -> tuple[list, ...]:
        out: tuple[list, ...] = [], [], []
        for node, given in zip(nodes, hashes):
            tokens = np.array(given, np.int64)
            kept = len(tokens) - -(-part * len(tokens) // whole) + 1
            first = tokens[np.lexsort((tokens, counts.value[tokens & (BUCKETS - 1)]))[:kept]]
            out[0].extend([node] * len(first))
            out[1].extend(first.tolist())
            out[2].extend(range(1, len(first) + 1))
        return out

    return map_columns(sets.select("node", "hashes"), run, "node long, token long, place int")


def _by_pivots(rows: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root: roots with what all similar pairs that share a token connect. rows: those of crowded tokens."""
    columns = ("node", "token", "place", "size", "fp")
    left, pivots = rows.select(*columns), PIVOTS
    while True:
        rooted = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
        left = written(rooted.join(apart, "token").select(*columns, "root"), "shingles-left")
        if left.isEmpty():
            return roots
        # the same nodes are pivots of all their tokens, as far as it goes: they have the least hashes
        order = Window.partitionBy("token").orderBy(F.xxhash64("node"), "node")
        chosen = written(left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots).drop("rank"), "shingles-pivots")
        others = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        asked = written(_ends(_sides(chosen, others, "token", "place", "root").where("root_a <> root_b")), "shingles-asked")
        found = written(_similar(asked, sets), "shingles-links")
        if not found.isEmpty():
            roots, old = extended(roots, found), roots
            discard(old)
        left, before = written(left.select(*columns).join(chosen, ["node", "token"], "left_anti"), "shingles-left"), left
        discard(before, chosen, asked, found)
        pivots *= GROWTH


def classes(nodes: DataFrame, index: DataFrame, docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """node, root: nodes connected exactly as all similar pairs that share a band do, for every node that has a link.

    nodes: node, size, fp, key and key2 of one of its rows in docs. index: node, band and chain, each once.
    """
    rows = index.join(nodes.select("node", "size", "fp"), "node")
    cold, hot = _crowded(rows, "band", max_bucket)
    # an aggregate works out what the budgets have in common once a row, a filter or a join once for each of them
    chained = F.bool_or(within_chain(F.col("chain_a"), F.col("chain_b"))).alias("chained")
    alike = _sides(cold, cold, "band", "chain").where("node_a < node_b").groupBy("node_a", "node_b").agg(chained).where("chained")
    pairs = written(alike.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "shingles-pairs")
    crowd = written(hot.select("node").distinct(), "shingles-crowd")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd).distinct()
    sets = written(_sets(docs, written(nodes.join(wanted, "node").select("node", *KEYS), "shingles-wanted")), "shingles-sets")
    found = written(_similar(pairs, sets), "shingles-links")
    if crowd.isEmpty():
        return connected(found)
    first = rare_first(sets.join(crowd, "node", "left_semi")).join(nodes.select("node", "size", "fp"), "node")
    few, many = _crowded(first, "token", max_bucket)
    near = written(_ends(_sides(few, few, "token", "place").where("node_a < node_b")), "shingles-pairs")
    return _by_pivots(many, connected(found.union(_similar(near, sets))), sets)


def representatives(docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """docs with one row of each class of similar texts: that of the least doc_id, of equal ids the one with the least key."""
    marked = written(sketches(docs), "shingles-docs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEYS))
    nodes = written(marked.groupBy("node").agg(first.alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp")), "shingles-nodes")
    index = written(ring_index(docs), "shingles-index")
    roots = classes(nodes.select("node", "size", "fp", "first.key", "first.key2"), index, docs, max_bucket)
    firsts = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    return kept_rows(docs, marked.select(*KEYS), firsts.select("first.key", "first.key2"))
