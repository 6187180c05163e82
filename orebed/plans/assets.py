"""Queries of the asset operators on stand-ins made of the driver's tables: entries, lines, pixels and listings of their shape."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orebed.functions import pixels, predicates
from orebed.operators import aggregates, lookups, terrain, validate
from orebed.plans.registry import query, table
from orebed.sources import index_files, listing, text_files

_ENTRIES_SQL = """
    WITH e AS (SELECT CAST(l_suppkey AS VARCHAR) || '.idx' AS idx_file, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS INT) AS entry_pos,
                      CAST(l_partkey % 6 AS INT) AS data_file, l_orderkey * 40 + l_linenumber % 4 AS "offset", encode(substr(md5(CAST(l_partkey AS VARCHAR)), 1, 9)) AS key FROM lineitem),
    gaps AS (SELECT data_file, "offset", min("offset") OVER (PARTITION BY data_file ORDER BY "offset" RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - "offset" AS gap FROM (SELECT DISTINCT data_file, "offset" FROM e)),
    sized AS (SELECT e.*, coalesce(gap, 4096) AS size FROM e JOIN gaps USING (data_file, "offset")),
    files AS (SELECT idx_file, row_number() OVER (ORDER BY idx_file) - 1 AS idx_pos FROM (SELECT DISTINCT idx_file FROM e))"""


def entries(spark, sf_dir):
    """Index entries: a file for each supplier, an entry for each line."""
    order = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".idx")).alias("idx_file"), (order - 1).alias("entry_pos"), (F.col("l_partkey") % 6).cast("int").alias("data_file"),
        (F.col("l_orderkey") * 40 + F.col("l_linenumber") % 4).alias("offset"), F.encode(F.substring(F.md5(F.encode(F.col("l_partkey").cast("string"), "utf-8")), 1, 9), "utf-8").alias("key"),
    )


@query(_ENTRIES_SQL + "SELECT printf('file_%03d_%05d_%s.dat', idx_pos, entry_pos, lower(hex(key))) AS name, size FROM sized JOIN files USING (idx_file) WHERE size >= 16")
def listed_entries(spark, sf_dir):
    return index_files.listed(index_files.sized(entries(spark, sf_dir))).select("name", "size")


@query(_ENTRIES_SQL + """SELECT printf('sprite_candidate_%04d_%s.dat', row_number() OVER (ORDER BY idx_file, entry_pos), substr(lower(hex(key)), 1, 8)) AS name, size FROM sized WHERE size BETWEEN 1024 AND 10485760""")
def sprite_entries(spark, sf_dir):
    return index_files.listed(index_files.sized(entries(spark, sf_dir)), sprites=True).select("name", "size")


@query(_ENTRIES_SQL + "SELECT hex(key) AS key, idx_file, entry_pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx_file, entry_pos) AS n FROM e) WHERE n = 1")
def first_entries_by_key(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return index_files.by_key(rows, rows.select("key")).select(F.hex("key").alias("key"), "idx_file", "entry_pos")


@query("""
    SELECT doc_id, CAST(CASE WHEN octet_length(h) < 8 THEN 4096 WHEN len(list_distinct(list_transform(range(1, 1 + least(octet_length(h), 16)), lambda i: substr(hex(h), 2 * i - 1, 2)))) > 12 THEN 32768 ELSE 8192 END AS BIGINT) AS size
    FROM (SELECT doc_id, encode(substr(regexp_replace(text, '[^ -~]', '', 'g'), 1, 32)) AS h FROM documents)""")
def header_sizes(spark, sf_dir):
    head = F.encode(F.substring(F.regexp_replace("text", "[^ -~]", ""), 1, 32), "utf-8")
    return table(spark, sf_dir, "documents").select("doc_id", index_files.header_size(head).alias("size"))


@query("""
    WITH lines AS (SELECT p_partkey AS line_no, CASE WHEN p_partkey % 10 = 0 THEN '# ' ELSE '' END || p_brand || ': ' || p_name || ' # ' || p_type AS value FROM part)
    SELECT trim(split_part(value, ':', 1)) AS key, arg_max(trim(substr(value, strpos(value, ':') + 1)), line_no) AS value FROM lines WHERE NOT starts_with(value, '#') GROUP BY ALL""")
def mapping_lines(spark, sf_dir):
    mark = F.when(F.col("p_partkey") % 10 == 0, "# ").otherwise("")
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.concat(mark, "p_brand", F.lit(": "), "p_name", F.lit(" # "), "p_type").alias("value"))
    return text_files.mapping(lines)


@query("SELECT CAST(p_partkey % 300 AS INT) AS id, arg_max(p_name || '/' || p_type, p_partkey) AS name FROM part GROUP BY p_partkey % 300")
def names_by_id(spark, sf_dir):
    number = F.format_string("%03d", F.col("p_partkey") % 300)
    line = F.concat(F.lit("animations/"), "p_name", F.lit("/"), "p_type", F.lit(": HD2/anim/main_"), number, F.lit(".anim # "), "p_brand")
    return text_files.names_by_id(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), line.alias("value")))


@query("""
    WITH asked AS (SELECT DISTINCT 'locales\\enUS\\' || replace(url, '/', '\\') AS path FROM pages), live AS (SELECT 'locales\\enUS\\' || replace(url, '/', '\\') AS path, page_id FROM pages WHERE page_id % 3 = 0),
    fallback AS (SELECT 'locales\\enUS\\' || replace(url, '/', '\\') AS path FROM pages WHERE page_id % 3 = 1)
    SELECT path, CASE WHEN lower(path) IN (SELECT lower(path) FROM live) THEN 'live' WHEN lower(path) IN (SELECT lower(path) FROM fallback) THEN 'fallback' END AS source FROM asked""".replace("\\\\", "\\"))
def live_or_fallback(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = F.replace(F.col("url"), F.lit("/"), F.lit("\\"))
    content = F.encode(F.lit("x"), "utf-8")
    live = pages.where("page_id % 3 = 0").select(F.concat(F.lit("locales\\enUS\\"), path).alias("path"), content.alias("content"))
    fallback = pages.where("page_id % 3 = 1").select(F.concat(F.lit("Assets/locales/enus/"), "url").alias("path"), content.alias("content"))
    return listing.requested(pages.select(path.alias("path")), live, fallback, "enUS").select("path", "source")


@query("""
    SELECT p_partkey, CAST(CASE WHEN p_size <= 40 THEN p_size * 5 ELSE 255 END AS INT) AS r, CAST(CASE WHEN p_size <= 40 THEN p_size * 3 ELSE 0 END AS INT) AS g, CAST(CASE WHEN p_size <= 40 THEN p_size ELSE 255 END AS INT) AS b, CAST(255 AS INT) AS a FROM part""")
def palette_colours(spark, sf_dir):
    colours = spark.range(41).select(F.col("id").cast("int").alias("idx"), *((F.col("id") * k).cast("int").alias(c) for c, k in (("r", 5), ("g", 3), ("b", 1))), F.lit(255).alias("a"))
    return lookups.coloured(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("idx")), colours).drop("idx")


_RGBA = "p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, (p_partkey * 13) % 256 AS b, (p_partkey % 4) * 85 AS a"


@query(f"SELECT p_partkey, CASE WHEN a = 0 THEN 0 ELSE (299 * r + 587 * g + 114 * b + 500) // 1000 END AS grey, a AS alpha FROM (SELECT p_partkey, {_RGBA} FROM part)")
def mask_pixels(spark, sf_dir):
    key = F.col("p_partkey")
    pixel = pixels.mask_pixel(key % 256, key * 7 % 256, key * 13 % 256, key % 4 * 85)
    return table(spark, sf_dir, "part").select("p_partkey", pixel.alias("m")).select("p_partkey", F.col("m.r").alias("grey"), F.col("m.a").alias("alpha"))


@query("SELECT CAST(count(*) FILTER (a = 0) AS BIGINT) AS transparent, CAST(count(*) FILTER (a > 0 AND a < 255) AS BIGINT) AS semi, CAST(count(*) FILTER (a = 255) AS BIGINT) AS opaque FROM (SELECT l_partkey % 256 AS a FROM lineitem)")
def alpha_stats(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(*aggregates.alpha_stats(F.col("l_partkey") % 256))


@query("""
    WITH p AS (SELECT vec_id, label, x, embedding[x + 1] > 0 AS v FROM (SELECT *, unnest(range(0, 64)) AS x FROM embeddings)),
    f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), q AS (SELECT p.label, x, v FROM p JOIN f ON p.vec_id = f.vec_id AND p.label = f.label)
    SELECT vec_id, CAST(count(*) FILTER (p.v <> q.v) AS BIGINT) AS n_differing, round(100.0::DOUBLE * count(*) FILTER (p.v <> q.v) / count(*), 6) AS percent FROM p JOIN q USING (label, x) GROUP BY vec_id""")
def differing_pixels(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v") > 0)
    firsts = rows.groupBy("label", "x").agg(F.min_by("v", "vec_id").alias("w"))
    joined = rows.join(firsts, ["label", "x"])
    n = F.count_if(F.col("v") != F.col("w"))
    return joined.groupBy("vec_id").agg(n.alias("n_differing"), F.round(aggregates.rate(n, F.count("*")), 6).alias("percent"))


@query("""
    SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN c IS NULL THEN 'missing' WHEN c = sha256(p_name) THEN 'passed' ELSE 'failed' END AS status FROM
        (SELECT p_partkey, p_name FROM part) b LEFT JOIN (SELECT p_partkey, sha256(CASE WHEN p_size > 25 THEN p_name ELSE p_type END) AS c FROM part WHERE p_partkey % 7 <> 0) USING (p_partkey)) GROUP BY status""")
def validated_outputs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".png"))
    baselines = part.select(F.col("p_partkey").cast("string").alias("sprite_name"), F.upper(F.sha2("p_name", 256)).alias("sha256_hash"), F.concat(F.lit("out/"), name).alias("expected_output"))
    outputs = part.where("p_partkey % 7 <> 0").select(F.concat(F.lit("run\\"), name).alias("path"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.col("p_type")).alias("content"))
    return validate.validated(baselines, outputs).groupBy("status").agg(F.count("*").alias("n"))


@query("""
    SELECT tier, CAST(count(*) FILTER (ok) AS BIGINT) AS processed, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS skipped FROM (SELECT coalesce(CASE p_size % 4 WHEN 0 THEN 'HD' WHEN 1 THEN 'HD2' WHEN 2 THEN 'SD' END, 'unknown') AS tier, p_size > 25 AS ok FROM part) GROUP BY tier""")
def tier_stats(spark, sf_dir):
    tier = F.when(F.col("p_size") % 4 == 0, "HD").when(F.col("p_size") % 4 == 1, "HD2").when(F.col("p_size") % 4 == 2, "SD")
    return aggregates.tier_stats(table(spark, sf_dir, "part").select(tier.alias("tier"), (F.col("p_size") > 25).alias("ok")), "tier", F.col("ok"))


@query("SELECT page_id FROM pages WHERE contains(lower(url), '/en/') AND contains(lower(url), 'example.org')")
def searched_paths(spark, sf_dir):
    return listing.searched(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path")), "/EN/", "Example.ORG").select("page_id")


@query("""
    WITH t AS (SELECT c_custkey AS pos, CAST(c_custkey % 512 AS INT) AS mega_id FROM customer), i AS (SELECT mega_id, row_number() OVER (ORDER BY mega_id) - 1 AS atlas_index FROM (SELECT DISTINCT mega_id FROM t)),
    m AS (SELECT i.*, (mega_id >> 4) * 16 + ((mega_id & 15) * 5) % 16 AS megatile FROM i WHERE (mega_id >> 4) < 20)
    SELECT mega_id, CAST(atlas_index AS INT) AS atlas_index, CAST(megatile AS BIGINT) AS megatile, bool_or(((megatile * 7 + c) % 5) & 1 = 1) AS walkable FROM m, (SELECT unnest(range(0, 16)) AS c) GROUP BY ALL""")
def tile_chain(spark, sf_dir):
    """Tile ids through groups to megatiles and their flags; ids of missing groups drop out."""
    tiles = table(spark, sf_dir, "customer").select(F.lit("map").alias("path"), (F.col("c_custkey") % 512).cast("int").alias("mega_id"))
    groups = spark.range(320).select(F.floor(F.col("id") / 16).alias("tile_group"), (F.col("id") % 16).alias("sub_tile"), (F.floor(F.col("id") / 16) * 16 + F.col("id") % 16 * 5 % 16).alias("megatile"))
    flags = spark.range(320 * 16).select(F.floor(F.col("id") / 16).alias("megatile"), (F.col("id") % 16).alias("cell"), ((F.floor(F.col("id") / 16) * 7 + F.col("id") % 16) % 5).alias("flags"))
    ids = terrain.megatiles(terrain.tile_ids(tiles), groups)
    return ids.join(terrain.walkable(ids, flags), ["path", "mega_id"]).select("mega_id", "atlas_index", "megatile", "walkable")


@query("""SELECT doc_id, octet_length(b) >= 64 AND len(list_distinct(list_transform(range(0, least(octet_length(b), 1024)), lambda i: substr(hex(b), 2 * i + 1, 2)))) > 204.8 AS dense FROM (SELECT doc_id, encode(text) AS b FROM documents)""")
def dense_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", predicates.compressed_like(F.encode("text", "utf-8")).alias("dense"))
