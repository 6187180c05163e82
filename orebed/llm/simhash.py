"""Near duplicates by 64-bit SimHash; pairs are found by pigeonring filtering.

With the 64 bits cut into M segments on a ring, two fingerprints that differ in at most T bits have a segment from which every
chain of l consecutive segments differs in at most l * T / M bits (the strong form of the pigeonhole principle; Qin and Xiao,
"Pigeonring", VLDB 2018). The chain's first segments, whose budget rounds down to no bit at all, are an exact join key; the
longer chains prune what the key lets through; then the whole Hamming distance is checked.

Keys of more than MAX_BUCKET fingerprints aren't joined with themselves but made longer: the bits outside the key still hold at
most T of the differing bits, so with these cut into T + 1 parts one part is equal too, and key and part are the new, exact key.
This is done LEVELS times, so keys have 25, then 38, then 46 bits or a few more; a key of 38 bits is crowded only beyond 10^13 evenly spread
fingerprints. What is crowded then is a true cluster: two fingerprints differ in 2 bits or fewer exactly if some word lies within
one bit of both, so its members are grouped by those 65 words each: no pairs are made, no group exceeds 65, no link is lost.

Rows: a null or empty text, or one without a word, has fingerprint zero and links like any other. Equal rows each give a row.
A null doc_id can't be a component's smallest; a component of such rows alone has a null component_id. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.llm.components import connected
from orebed.llm.frames import map_columns, pick, row_key, second_key
from orebed.llm.rows import KEYS, kept_rows
from orebed.session import discard, written

SHINGLE, SEED, BITS = 3, 42, 64
#: Largest Hamming distance of a link. The last resort for hot keys is exact for 2 and below.
MAX_DISTANCE = 2
SEGMENTS = 5
MAX_BUCKET = 64
#: How often a crowded key is made longer.
LEVELS = 2
#: Shingles whose bits are summed at once; bounds memory for very long texts.
CHUNK = 1 << 15


def shingle_hashes(text: str | None, width: int = SHINGLE) -> Iterator[int]:
    """XXH64 of each shingle of `width` words, in order, repeats included; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return iter(())
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    return map(xxhash.xxh64_intdigest, shingles, repeat(SEED))


def bits_of(hashes: Iterator[int]) -> int:
    """The fingerprint of shingle hashes, unsigned: a bit is 1 if it is set in over half of them."""
    ones, n = np.zeros(BITS, np.int64), 0
    while len(h := np.fromiter(islice(hashes, CHUNK), np.uint64)):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text, unsigned."""
    return bits_of(shingle_hashes(text, width))


def signed(h: int) -> int:
    """The 64 bits of h as Spark's long."""
    return h - (1 << BITS) if h >> (BITS - 1) else h


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key and key2 (of doc_id and text), fp (the fingerprint's bits as a long)."""
    given = pick(docs, "doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("key"), second_key("doc_id", "text").alias("key2"), "text")

    def run(ids: list, keys: list, keys2: list, texts: list) -> tuple[list, ...]:
        return ids, keys, keys2, [signed(fingerprint(t)) for t in texts]

    return map_columns(given, run, f"doc_id {dict(docs.dtypes)['doc_id']}, key long, key2 long, fp long")


def ring(segments: int = SEGMENTS) -> list[int]:
    """The mask of each segment."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def exact_run(segments: int = SEGMENTS, distance: int = MAX_DISTANCE) -> int:
    """The chain length up to which a chain's budget is no bit."""
    return -(-segments // distance) - 1 if distance else segments


def _chain(start: int, length: int, segments: int) -> int:
    """The mask of a chain of segments."""
    parts = ring(segments)
    return sum(parts[(start + j) % segments] for j in range(length))


def key_masks(level: int = 0, segments: int = SEGMENTS, distance: int = MAX_DISTANCE) -> list[int]:
    """The bits that must be equal, for each slot: at level 0 a slot is a start on the ring, then slot * (distance + 1) + part."""
    if level == 0:
        return [_chain(i, exact_run(segments, distance), segments) for i in range(segments)]
    out = []
    for mask in key_masks(level - 1, segments, distance):
        free = [b for b in range(BITS) if not mask >> b & 1]
        cuts = [round(i * len(free) / (distance + 1)) for i in range(distance + 2)]
        out += [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]
    return out


def within_chains(x: Column, start: Column, segments: int = SEGMENTS, distance: int = MAX_DISTANCE) -> Column:
    """Whether every chain from the start stays within its budget; x: the fingerprints' exclusive or."""
    verdict = F.lit(False)
    for i in range(segments):
        ok = F.lit(True)
        for length in range(exact_run(segments, distance) + 1, segments + 1):
            mask = signed(_chain(i, length, segments))
            ok = ok & (F.bit_count(x.bitwiseAND(F.lit(mask))) <= length * distance // segments)
        verdict = F.when(start == i, ok).otherwise(verdict)
    return verdict


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """fp, slot, bits: a row for each key of the level. rows: fp, and slot of the level before."""
    masks = F.array(*(F.lit(signed(m)).cast("long") for m in key_masks(level)))
    if level == 0:
        slots = rows.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("slot"))
    else:
        first = F.col("slot") * (MAX_DISTANCE + 1)
        slots = rows.select("fp", F.explode(F.sequence(first, first + MAX_DISTANCE)).alias("slot"))
    return slots.select("fp", "slot", F.col("fp").bitwiseAND(F.get(masks, "slot")).alias("bits"))


def links(nodes: DataFrame, max_bucket: int = MAX_BUCKET, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints in column fp exactly as all pairs within MAX_DISTANCE bits do.

    Pairs from keys that aren't crowded are all there; members of the clusters that stay crowded are linked to the smallest
    fingerprint one bit from a common word.
    """
    rows, found, tables = nodes.select("fp"), None, []
    x = F.col("a").bitwiseXOR(F.col("b"))
    for level in range(levels + 1):
        index = written(_keyed(rows, level), "simhash-index")
        counts = index.groupBy("slot", "bits").agg(F.count("*").alias("n")).where("n > 1")
        shared = written(index.join(counts, ["slot", "bits"]), "simhash-shared")
        discard(index)
        tables.append(shared)
        cold = shared.where(F.col("n") <= max_bucket)
        left, right = (cold.select(F.col("fp").alias(name), "slot", "bits") for name in "ab")
        start = F.floor(F.col("slot") / (MAX_DISTANCE + 1) ** level)
        pairs = left.join(right, ["slot", "bits"]).where("a < b").where(within_chains(x, start)).where(F.bit_count(x) <= MAX_DISTANCE).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        rows = shared.where(F.col("n") > max_bucket).select("fp", "slot")
        if rows.isEmpty():
            break
    else:
        words = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)))
        balls = rows.select("fp").distinct().select("fp", F.explode(words).alias("word"))
        near = balls.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        found = found.union(near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))
    out = written(found.distinct(), "simhash-links")
    discard(*tables)
    return out


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and for each fingerprint component_id and first (the keys of its class's first row)."""
    marked = written(fingerprints(docs), "simhash-docs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEYS))
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), first.alias("first")), "simhash-nodes")
    roots = connected(links(nodes)).toDF("fp", "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first").alias("first"))
    return marked, written(rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id", "first"), "simhash-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id of the documents reachable over links)."""
    marked, classes = _classes(docs)
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, of equal ids the one with the least keys."""
    marked, classes = _classes(docs)
    return kept_rows(docs, marked.select(*KEYS), classes.select("first.key", "first.key2").distinct())
