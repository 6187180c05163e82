"""The engine's operators as queries over the driver's tables, each with its DuckDB SQL.

The tables hold no sprites: relational operators run on stand-ins of the same shape (offsets, candidates, keyed references),
and decoders of binary formats are tested on bytes that the tests make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.functions import pixels, predicates
from orebed.operators import aggregates, lookups, windows
from orebed.plans import assets, binaries  # noqa: F401  register their queries
from orebed.plans.registry import ORACLE_SQL, QUERIES, query, table

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict by language, hash, status against labels, and a roll-up by verdict and status."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("sha256"))
    judged = docs.withColumn("verdict", predicates.verdict(F.col("source"), include=["1"], exclude=["9$"], eligible=F.col("lang") != "de"))
    status = F.when(F.col("quality").isNull(), "missing").when((F.col("quality") == 1) & (F.col("toxic") == 0), "passed").otherwise("failed")
    checked = lookups.baseline_status(judged, table(spark, sf_dir, "labels"), "doc_id", status)
    return checked.groupBy("verdict", "status").agg(F.count("*").alias("n_docs"), F.countDistinct("sha256").alias("n_hashes"))


query("""
    SELECT verdict, status, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT h) AS BIGINT) AS n_hashes FROM (
        SELECT sha256(text) AS h,
               CASE WHEN regexp_matches(source, '9$') THEN 'Exclude' WHEN lang <> 'de' IS NOT TRUE THEN 'Skip' WHEN regexp_matches(source, '1') THEN 'Include' ELSE 'Skip' END AS verdict,
               CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 AND toxic = 0 THEN 'passed' ELSE 'failed' END AS status
        FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL""")(flagship)


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""
    SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN regexp_matches(url, 'page=|#top') THEN 'Exclude' WHEN NOT regexp_matches(url, '/(en|fr)/') THEN 'Skip'
        WHEN regexp_matches(url, '^https') THEN 'Include' ELSE 'Skip' END AS verdict FROM pages) GROUP BY verdict""")
def path_verdict(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(predicates.verdict(url, ["^https"], ["page=|#top"], url.rlike("/(en|fr)/")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""
    SELECT CAST(count(*) AS BIGINT) AS n FROM pages WHERE (regexp_matches(url, '/en/') OR regexp_matches(url, '/de/')) AND NOT regexp_matches(url, '#top')""")
def path_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(predicates.passes(F.col("url"), ["/en/", "/de/", "("], ["#top"])).agg(F.count("*").alias("n"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN next - k < 50000000 THEN next - k END AS size FROM (SELECT l_orderkey, l_linenumber, l_partkey * 1000 AS k,
        min(l_partkey * 1000) OVER (PARTITION BY l_suppkey ORDER BY l_partkey * 1000 RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM lineitem)""")
def next_offset_size(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") * 1000).alias("k"))
    return rows.select("l_orderkey", "l_linenumber", windows.inferred_size("k", "l_suppkey").alias("size"))


@query("""
    WITH bytes AS (SELECT doc_id, substr(h, i * 2 + 1, 2) AS b FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, octet_length(encode(text)))) AS i FROM documents)),
    counts AS (SELECT doc_id, b, count(*) AS n FROM bytes GROUP BY ALL), totals AS (SELECT doc_id, sum(n) AS t FROM counts GROUP BY doc_id)
    SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM counts JOIN totals USING (doc_id) GROUP BY doc_id""")
def byte_entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(aggregates.byte_entropy("text"), 6).alias("entropy"))


@query("""
    SELECT byte, CAST(count(*) AS BIGINT) AS n FROM (SELECT substr(h, i * 2 + 1, 2) AS byte FROM (SELECT hex(encode(p_name)) AS h, unnest(range(0, octet_length(encode(p_name)))) AS i FROM part)) GROUP BY byte""")
def byte_histogram(spark, sf_dir):
    return aggregates.byte_histogram(table(spark, sf_dir, "part"), "p_partkey", "p_name").groupBy("byte").agg(F.sum("n").alias("n"))


@query("""
    SELECT vec_id, CAST(list_sum(list_transform(range(1, 16), lambda i: CASE WHEN embedding[i] < embedding[i + 1] THEN 1 << (i - 1) ELSE 0 END)) AS BIGINT) AS bits FROM embeddings""")
def adjacent_bits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", pixels.adjacent_bits(F.col("embedding"), 15).alias("bits"))


@query("""
    WITH hashed AS (SELECT vec_id, label, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] < embedding[i + 1] THEN 1::HUGEINT << (i - 1) ELSE 0 END)) AS BIGINT) AS bits FROM embeddings),
    firsts AS (SELECT label, arg_min(bits, vec_id) AS first FROM hashed GROUP BY label)
    SELECT vec_id, CAST(bit_count(xor(bits, first)) AS INT) AS distance FROM hashed JOIN firsts USING (label)""")
def hamming_distance(spark, sf_dir):
    hashed = table(spark, sf_dir, "embeddings").select("vec_id", "label", pixels.adjacent_bits(F.col("embedding"), 63).alias("bits"))
    firsts = hashed.groupBy("label").agg(F.min_by("bits", "vec_id").alias("first"))
    return hashed.join(firsts, "label").select("vec_id", pixels.hamming(F.col("bits"), F.col("first")).alias("distance"))


@query("SELECT p_size, CAST(n AS INT) AS atlas_index, CAST(n % 17 AS INT) AS col, CAST(n // 17 AS INT) AS row FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS n FROM (SELECT DISTINCT p_size FROM part))")
def atlas_cells(spark, sf_dir):
    return windows.atlas_cells(table(spark, sf_dir, "part"), "p_size")


@query("SELECT p_partkey, CAST((299 * r + 587 * g + 114 * b + 500) // 1000 AS BIGINT) AS lum FROM (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, (p_partkey * 13) % 256 AS b FROM part)")
def luminance(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", pixels.luminance(key % 256, key * 7 % 256, key * 13 % 256).alias("lum"))


@query("""
    SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS status
        FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY status""")
def baseline_status(spark, sf_dir):
    status = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "passed").otherwise("failed")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return lookups.baseline_status(docs, table(spark, sf_dir, "labels"), "doc_id", status).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS passed, CAST(count(*) FILTER (quality <> 1) AS BIGINT) AS failed, round(100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*), 6) AS pass_rate FROM labels")
def regression_roll_up(spark, sf_dir):
    rolled = aggregates.roll_up(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("passed")))
    return rolled.withColumn("pass_rate", F.round("pass_rate", 6))


@query("SELECT p_brand, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand")
def last_wins(spark, sf_dir):
    return lookups.last_wins(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@query("SELECT p_partkey FROM (SELECT unnest(range(0, (SELECT max(p_partkey) + 101 FROM part))) AS p_partkey) e ANTI JOIN part USING (p_partkey)")
def missing_members(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    top = part.agg(F.max("p_partkey")).first()[0]
    return lookups.missing(spark.range(top + 101).withColumnRenamed("id", "p_partkey"), part, "p_partkey")


@query("""
    WITH tried AS (SELECT s_suppkey, unnest([s_suppkey * 31, s_suppkey * 3, s_suppkey]) AS p_partkey, unnest([0, 1, 2]) AS pos FROM supplier)
    SELECT s_suppkey, arg_min(p_partkey, pos) AS p_partkey, CAST(min(pos) AS INT) AS pos, CAST(0 AS INT) AS variant FROM tried SEMI JOIN (SELECT p_partkey FROM part WHERE p_size > 10) USING (p_partkey) GROUP BY s_suppkey""")
def candidate_first_match(spark, sf_dir):
    key = F.col("s_suppkey")
    targets = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(key * 31, key * 3, key).alias("candidates"))
    return lookups.first_candidate(targets, table(spark, sf_dir, "part"), "s_suppkey", "candidates", "p_partkey", usable=F.col("p_size") > 10)


_STEMS = ("medium_part", "standard_part", "large_part", "promo_part", "small_none")


@query("""
    WITH t AS (SELECT * FROM (VALUES ('medium_part', 'medi', 'part'), ('standard_part', 'stan', 'part'), ('large_part', 'larg', 'part'), ('promo_part', 'prom', 'part'), ('small_none', 'smal', 'none')) v(target, a, b))
    SELECT target, arg_min(p_name, p_partkey) AS p_name FROM t JOIN part ON contains(lower(p_type || ' part ' || p_name), a) AND contains(lower(p_type || ' part ' || p_name), b) GROUP BY target""")
def keyword_theta(spark, sf_dir):
    return lookups.first_with_keywords(table(spark, sf_dir, "part"), {s: lookups.keywords(s) for s in _STEMS}, F.concat("p_type", F.lit(" part "), "p_name"), "p_partkey", "p_name")


@query("""
    SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (v = 'Include') AS BIGINT) AS included, CAST(count(*) FILTER (v = 'Exclude') AS BIGINT) AS excluded, CAST(count(*) FILTER (v = 'Skip') AS BIGINT) AS skipped,
           round(100.0::DOUBLE * count(*) FILTER (v = 'Include') / count(*), 6) AS inclusion_rate, round(100.0::DOUBLE * count(*) FILTER (v = 'Exclude') / count(*), 6) AS exclusion_rate, round(100.0::DOUBLE * count(*) FILTER (v = 'Skip') / count(*), 6) AS skip_rate
    FROM (SELECT CASE WHEN regexp_matches(source, '9$') THEN 'Exclude' WHEN regexp_matches(source, '1') THEN 'Include' ELSE 'Skip' END AS v FROM documents)""")
def filter_stats(spark, sf_dir):
    stats = aggregates.filter_stats(table(spark, sf_dir, "documents").select(predicates.verdict(F.col("source"), ["1"], ["9$"]).alias("verdict")))
    return stats.select("total", "included", "excluded", "skipped", *(F.round(c, 6).alias(c) for c in ("inclusion_rate", "exclusion_rate", "skip_rate")))


@query("SELECT doc_id, CAST(quality AS BIGINT) AS n_chars FROM labels UNION ALL SELECT doc_id, n_chars FROM documents d ANTI JOIN labels USING (doc_id)")
def upsert(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    return windows.upsert(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), new, "doc_id")


@query("SELECT l_orderkey, bool_or((l_partkey & 1) = 1) AS walkable FROM lineitem GROUP BY l_orderkey")
def exists_flag(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_partkey").bitwiseAND(F.lit(1)) == 1).alias("walkable"))


@query("SELECT a.p_partkey, CASE WHEN a.p_size % 3 = 0 THEN a.p_name ELSE b.p_name END AS p_name FROM part a LEFT JOIN part b ON a.p_size % 3 <> 0 AND b.p_partkey = a.p_size AND b.p_partkey < a.p_partkey")
def back_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("long")).alias("ref"), "p_name")
    return lookups.back_referenced(rows, "p_partkey", "ref", ["p_name"]).select("p_partkey", "p_name")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey >> 4 AS tile_group, l_partkey & 15 AS sub_tile, n_name, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def index_chain(spark, sf_dir):
    group, sub = lookups.split_id(F.col("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", group.alias("tile_group"), sub.alias("sub_tile"))
    chain = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return chain.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("l_orderkey", "l_linenumber", "tile_group", "sub_tile", "n_name", "r_name")


@query("SELECT p_partkey, p_size FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 100) WHERE p_size > 25")
def limit_before_filter(spark, sf_dir):
    return windows.first_then_filter(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 100, F.col("p_size") > 25)


@query("SELECT page_id, starts_with(html, '<!DOCTYPE') AS is_page FROM pages")
def signature_predicate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.startswith("html", F.lit("<!DOCTYPE")).alias("is_page"))


@query("SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, 1 + greatest(least(length(text), 1024), 1)), lambda i: substr(text, i, 1)))) AS INT) AS n_units FROM documents")
def distinct_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", aggregates.distinct_units(F.col("text")).alias("n_units"))


@query("""
    WITH m AS (SELECT arg_max(o_orderkey, o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey)
    SELECT c_custkey, coalesce(CAST(o_orderkey AS VARCHAR), printf('main_%03d', c_custkey)) AS name FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def mapped_names(spark, sf_dir):
    last = lookups.last_wins(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey", "o_orderkey")
    names = last.select("c_custkey", F.col("o_orderkey").cast("string").alias("name"))
    return lookups.named(table(spark, sf_dir, "customer").select("c_custkey"), names, "c_custkey", "name", F.format_string("main_%03d", "c_custkey"))


@query("""
    SELECT o_orderkey, CASE WHEN nxt > o AND nxt <= 300000 THEN nxt ELSE 300000 END AS line_end FROM (SELECT *, lead(o) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt
        FROM (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS o FROM orders))""")
def line_ends(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("o"), F.lit(300_000).cast("long").alias("frame_end"))
    return rows.select("o_orderkey", windows.line_ends("o_orderkey", "o", "frame_end", "o_custkey").alias("line_end"))


@query("""
    WITH f AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS o FROM orders)
    SELECT a.o_orderkey, coalesce(arg_min(b.o, b.o_orderkey), 1000000000) AS frame_end FROM f a LEFT JOIN f b ON a.o_custkey = b.o_custkey AND b.o_orderkey > a.o_orderkey AND b.o > a.o GROUP BY a.o_orderkey""")
def frame_ends(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("o"), F.lit(1_000_000_000).cast("long").alias("length"))
    return windows.frame_ends(rows, "o_custkey", "o_orderkey", "o").select("o_orderkey", F.col("end").alias("frame_end"))


@query("SELECT tier, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN contains(lower(url), '/en/') THEN 'HD2' WHEN contains(lower(url), '/fr/') THEN 'HD' WHEN contains(lower(url), '/de/') THEN 'SD' END AS tier FROM pages) GROUP BY tier")
def tier_counts(spark, sf_dir):
    path = F.col("url")
    for folder, tier in (("/en/", "hd2/anim/"), ("/fr/", "anim/"), ("/de/", "sd/")):
        path = F.replace(path, F.lit(folder), F.lit(tier))
    return table(spark, sf_dir, "pages").select(predicates.tier(path).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, regexp_extract(url, '[^\\/]*$') AS base, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS safe FROM pages")
def path_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", predicates.basename(F.col("url")).alias("base"), predicates.safe_name(F.col("url")).alias("safe"))
