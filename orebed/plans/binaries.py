"""Queries of the binary decoders and of the remaining rules: files are put together from the driver's tables, byte by byte, and decoded."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.functions import pixels, predicates
from orebed.operators import lookups, sprites, terrain, validate, windows
from orebed.plans.registry import query, table
from orebed.session import work_dir
from orebed.sources import archive, index_files, listing, sinks, text_files


def number(value: Column | int, size: int) -> Column:
    """A number's bytes, the lowest first."""
    c = F.lit(value).cast("long") if isinstance(value, int) else value.cast("long")
    return F.unhex(F.format_string("%02x" * size, *(F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255)) for i in range(size))))


def zeros(count: int) -> Column:
    return F.lit(bytes(count))


def file(rows: DataFrame, key: str, *parts: Column) -> DataFrame:
    """path and content, from the parts in order."""
    return rows.select(F.col(key).cast("string").alias("path"), F.concat(*parts).alias("content"))


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """rows with their path as the number it was made of."""
    return rows.withColumn(key, F.col("path").cast("long")).drop("path")


@query("""
    SELECT p_partkey, CAST(y AS INT) AS y, CAST(w AS INT) AS width, CASE y WHEN 0 THEN h || '070707' || repeat('00', 2) ELSE repeat('00', 2) || h || repeat('00', 3) END AS indices
    FROM (SELECT p_partkey, hex(encode(p_brand)) AS h, octet_length(encode(p_brand)) + 5 AS w FROM part), (SELECT unnest([0, 1]) AS y)""")
def run_length_lines(spark, sf_dir):
    """A sprite of two lines for each part: a copy, a repeat and a skip, and the other way round."""
    name = F.encode("p_brand", "utf-8")
    size = F.length(name)
    first = F.concat(number(size, 1), name, F.lit(bytes([0x43, 7, 0x82])))
    second = F.concat(F.lit(bytes([0x82])), number(size, 1), name)
    head = (number(1, 2), number(size + 5, 2), number(2, 2), zeros(4), number(14, 4))
    files = file(table(spark, sf_dir, "part"), "p_partkey", *head, number(4, 2), number(F.length(first) + 4, 2), first, second)
    frames = keyed(sprites.grp_frames(files)[0], "p_partkey")
    line = lambda y: F.struct(F.lit(y).alias("y"), F.hex(F.substring("indices", y * F.col("width") + 1, F.col("width"))).alias("indices"))
    return frames.select("p_partkey", "width", F.explode(F.array(line(0), line(1))).alias("l")).select("p_partkey", "l.y", "width", "l.indices")


@query("""
    WITH e AS (SELECT s_suppkey, unnest(range(0, s_suppkey % 4 + 1)) AS i FROM supplier)
    SELECT s_suppkey, CAST(s_suppkey % 256 AS INT) AS bucket, CAST(i AS INT) AS entry_pos, substr(md5(CAST(s_suppkey * 4 + i AS VARCHAR)), 1, 9) AS key, CAST((s_suppkey + i) % 6 AS INT) AS data_file, s_suppkey * 1000 + i AS "offset" FROM e""")
def index_file_entries(spark, sf_dir):
    """An index file of one to four entries for each supplier."""
    key = F.col("s_suppkey")
    entry = lambda i: F.concat(F.encode(F.substring(F.md5(F.encode((key * 4 + i).cast("string"), "utf-8")), 1, 9), "utf-8"), number(key + i, 4), number(key * 1000 + i, 4))
    entries = F.concat(*(F.when(key % 4 >= i, entry(i)).otherwise(F.lit(b"")) for i in range(4)))
    head = (zeros(8), number(index_files.MARK, 2), number(key % 256, 1), zeros(1), F.lit(bytes([4, 4, index_files.KEY_BYTES, 24])), zeros(8))
    parsed = index_files.index_entries(file(table(spark, sf_dir, "supplier"), "s_suppkey", *head, entries))[0]
    return parsed.select(F.col("idx_file").cast("long").alias("s_suppkey"), "bucket", "entry_pos", F.decode("key", "utf-8").alias("key"), "data_file", "offset")


_FULL = {"r": "(({c} >> 11) & 31) * 8 + (({c} >> 11) & 31) // 4", "g": "(({c} >> 5) & 63) * 4 + (({c} >> 5) & 63) // 16", "b": "({c} & 31) * 8 + ({c} & 31) // 4"}
_MIXED = ", ".join(
    f"CAST(CASE i WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN CASE WHEN c0 > c1 THEN (2 * ({a}) + {b}) // 3 ELSE (({a}) + {b}) // 2 END ELSE CASE WHEN c0 > c1 THEN ({a} + 2 * ({b})) // 3 ELSE 0 END END AS INT) AS {k}"
    for k, a, b in ((k, f.format(c="c0"), f.format(c="c1")) for k, f in _FULL.items())
)


@query(f"""
    WITH b AS (SELECT p_partkey, p_partkey * 7919 % 65536 AS c0, p_partkey * 104729 % 65536 AS c1, p_partkey * 48271 % 4294967296 AS bits FROM part),
    p AS (SELECT *, (bits >> (2 * pos)) & 3 AS i FROM (SELECT *, unnest(range(0, 16)) AS pos FROM b))
    SELECT p_partkey, CAST(pos AS INT) AS pos, {_MIXED}, CAST(CASE WHEN i = 3 AND c0 <= c1 THEN 0 ELSE 255 END AS INT) AS a FROM p""")
def block_compressed_pixels(spark, sf_dir):
    """A compressed picture of one block for each part, as pixels."""
    key = F.col("p_partkey")
    head = (F.lit(b"DDS "), number(124, 4), zeros(4), number(4, 4), number(4, 4), zeros(56), number(32, 4), number(4, 4), F.lit(b"DXT1"), zeros(40))
    files = file(table(spark, sf_dir, "part"), "p_partkey", *head, number(key * 7919 % 65536, 2), number(key * 104729 % 65536, 2), number(key * 48271 % (1 << 32), 4))
    each = keyed(sprites.dds_pixels(files)[0], "p_partkey").select("p_partkey", F.posexplode(pixels.hex_groups(F.col("rgba"), 8)).alias("pos", "_hex"))
    return each.select("p_partkey", "pos", *(F.conv(F.substring("_hex", 2 * i + 1, 2), 16, 10).cast("int").alias(c) for i, c in enumerate("rgba")))


@query(f"""
    SELECT c_custkey, CAST(c_custkey & 7 AS INT) AS era, list_extract({list(predicates.ERA_TILESETS)}, (c_custkey & 7) + 1) AS tileset, CAST(pos AS INT) AS pos, CAST(pos % 3 AS INT) AS tx, CAST(pos // 3 AS INT) AS ty, CAST((c_custkey * 31 + pos) % 65536 AS INT) AS mega_id
    FROM (SELECT c_custkey, unnest(range(0, 6)) AS pos FROM customer)""")
def map_chunks(spark, sf_dir):
    """A map of 3 x 2 tiles for each customer, its tiles in two chunks, with a chunk beyond the end."""
    key = F.col("c_custkey")
    tiles = lambda *places: F.concat(F.lit(b"MTXM"), number(2 * len(places), 4), *(number((key * 31 + i) % 65536, 2) for i in places))
    parts = (F.lit(b"ERA "), number(2, 4), number(key % 65536, 2), F.lit(b"DIM "), number(4, 4), number(3, 2), number(2, 2), tiles(0, 1, 2, 3), tiles(4, 5), F.lit(b"MTXM"), number(99, 4), zeros(2))
    parsed = terrain.maps(file(table(spark, sf_dir, "customer"), "c_custkey", *parts))[0]
    facts = parsed.select("path", "era", "tileset")
    return keyed(terrain.map_tiles(parsed).join(facts, "path"), "c_custkey")


_LAYERED_HEAD = 332 + 132


@query("""
    SELECT o_orderkey, CAST(i AS INT) AS frame_idx, CAST((o_orderkey + i) % 65536 AS INT) AS x, CAST(o_custkey % 65536 AS INT) AS y, CAST(-(o_orderkey % 100) AS INT) AS x_offset, CAST(i AS INT) AS y_offset, CAST(i + 1 AS INT) AS width, 9 AS height
    FROM (SELECT *, unnest(range(0, o_orderkey % 3)) AS i FROM orders)""")
def layered_container_frames(spark, sf_dir):
    """A layered container of no frame, one or two for each order."""
    key = F.col("o_orderkey")
    names = [F.lit(n.encode().ljust(32, b"\0")) for n in (*lookups.LAYERS, *[""] * 4)]
    frame = lambda i: F.concat(number((key + i) % 65536, 2), number(F.col("o_custkey") % 65536, 2), number((65536 - key % 100) % 65536, 2), number(i, 2), number(i + 1, 2), number(9, 2), zeros(4))
    frames = F.concat(*(F.when(key % 3 > i, frame(i)).otherwise(F.lit(b"")) for i in range(2)))
    head = (F.lit(b"ANIM"), number(0x0202, 2), zeros(2), number(len(lookups.LAYERS), 2), number(1, 2), *names)
    entry = (number(key % 3, 2), zeros(2), number(64, 2), number(64, 2), number(_LAYERED_HEAD, 4), zeros(120))
    parsed = sprites.layered_files(file(table(spark, sf_dir, "orders"), "o_orderkey", *head, *entry, frames))[0]
    return keyed(sprites.layer_frames(parsed), "o_orderkey")


@query("""
    WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_size % 5 = 0 THEN p_name ELSE substr(p_name, 1, p_size % 7) || p_brand END AS b FROM part),
    d AS (SELECT p_partkey, min(i) AS i FROM (SELECT p_partkey, a, b, unnest(range(0, least(length(a), length(b)))) AS i FROM p) WHERE substr(a, i + 1, 1) <> substr(b, i + 1, 1) GROUP BY p_partkey)
    SELECT p_partkey, a = b AS equal, CAST(length(a) AS INT) AS size_a, CAST(length(b) AS INT) AS size_b, CASE WHEN a <> b THEN coalesce(i, least(length(a), length(b))) END AS first_difference FROM p LEFT JOIN d USING (p_partkey)""")
def byte_comparison(spark, sf_dir):
    other = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.substring("p_name", 1, F.col("p_size") % 7), "p_brand"))
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.encode("p_name", "utf-8").alias("a"), F.encode(other, "utf-8").alias("b"))
    return validate.compared_bytes(pairs).select(F.col("name").alias("p_partkey"), "equal", "size_a", "size_b", "first_difference")


@query("""
    SELECT p_partkey, k = 0 AS png, k = 1 AS jpeg, k IN (1, 2) AS jpeg_marker, k = 0 AS fits_png, k IN (1, 2) AS fits_jpeg FROM (SELECT p_partkey, p_size % 4 AS k FROM part)""")
def signature_rules(spark, sf_dir):
    kind = F.col("p_size") % 4
    content = F.when(kind == 0, F.lit(predicates.PNG_SIGNATURE)).when(kind == 1, F.lit(predicates.JPEG_SIGNATURE)).when(kind == 2, F.lit(predicates.JPEG_MARKER)).when(kind == 3, F.lit(bytes(8)))
    made = table(spark, sf_dir, "part").select("p_partkey", F.concat(content, F.encode("p_name", "utf-8")).alias("content"))
    c = F.col("content")
    return made.select("p_partkey", predicates.has_png(c).alias("png"), predicates.has_jpeg(c).alias("jpeg"), predicates.has_jpeg(c, marker_only=True).alias("jpeg_marker"), predicates.format_fits(c, "Png").alias("fits_png"), predicates.format_fits(c, "Jpeg").alias("fits_jpeg"))


@query("""
    SELECT tier, CAST(count(*) FILTER (tier = 'HD2') AS BIGINT) AS hd2, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'HD' WHEN 1 THEN 'HD2' WHEN 2 THEN 'SD' ELSE 'unknown' END AS tier FROM part) GROUP BY tier""")
def tier_folders(spark, sf_dir):
    kind = F.col("p_size") % 4
    given = table(spark, sf_dir, "part").select(F.when(kind == 0, "HD").when(kind == 1, "HD2").when(kind == 2, "SD").alias("t"))
    return given.groupBy(predicates.tier_folder(F.col("t")).alias("tier")).agg(F.count_if(predicates.tier_fits(F.col("t"), "HD2")).alias("hd2"), F.count("*").alias("n"))


@query("""
    SELECT p_partkey FROM part WHERE p_size % 3 < 2 AND regexp_matches(lower(p_type || '/' || p_name), 'promo|large')""")
def audio_paths(spark, sf_dir):
    size = F.col("p_size") % 3
    path = F.concat("p_type", F.lit("/"), "p_name", F.when(size == 0, ".WAV").when(size == 1, ".ogg").otherwise(".png"))
    return table(spark, sf_dir, "part").where(predicates.is_audio(path, ["promo", "large"])).select("p_partkey")


@query("SELECT page_id, contains(url, '/en/') OR contains(lower(url), '/en/') AS hit, 'x/' || replace(url, '\\', '/') AS path FROM pages")
def probed_paths(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", predicates.probed(url, url, "/EN/").alias("hit"), F.concat(F.lit("x/"), predicates.slashed(F.replace(url, F.lit("/"), F.lit("\\")))).alias("path"))


@query("""
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'SD/' WHEN 1 THEN 'HD2/' WHEN 2 THEN '' END AS prefix, p_retailprice BETWEEN 1024 AND 10485760 AS sprite, p_size >= 16 AS listed,
           7.9 + p_size / 500 BETWEEN 7.96 AND 7.99 AS compressed FROM part""")
def size_and_quality_rules(spark, sf_dir):
    kind, size = F.col("p_size") % 4, F.col("p_size")
    quality = F.when(kind == 0, "SD").when(kind == 1, "hd2").when(kind == 2, "HD4").otherwise("4k")
    return table(spark, sf_dir, "part").select(
        "p_partkey", predicates.quality_prefix(quality).alias("prefix"), predicates.sprite_size(F.col("p_retailprice")).alias("sprite"), predicates.listed_size(size).alias("listed"), predicates.entropy_valid(F.lit(7.9) + size / 500).alias("compressed")
    )


@query("""
    SELECT id, printf('HD2/anim/main_%03d.anim', id) AS path, p_size FROM (SELECT unnest(range(0, 1000)) AS id) JOIN part ON p_partkey = id AND p_size > 10""")
def generated_paths(spark, sf_dir):
    """Numbered containers that a listing has; the limit of ids comes first."""
    path = F.concat(F.lit("HD2/"), F.format_string("anim/main_%03d.anim", "p_partkey"))
    there = table(spark, sf_dir, "part").where("p_size > 10").select(path.alias("path"), "p_size")
    return listing.present(listing.generated(spark, 2000, "HD2/", limit=1000), there).select("id", "path", "p_size")


@query(f"""
    SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN list_position({list(lookups.LAYERS)}, 'normal') - 1 END AS BIGINT) AS place FROM part""")
def layer_places(spark, sf_dir):
    """By the header's names, then by convention, else none."""
    kind = F.col("p_size") % 4
    layer = F.when(kind == 0, F.lower("p_brand")).when(kind == 1, F.lit("OTHER")).when(kind == 2, F.lit("Normal")).otherwise(F.lit("none of them"))
    return table(spark, sf_dir, "part").select("p_partkey", lookups.layer_index(F.array(F.lit("other"), F.upper("p_brand")), layer).cast("long").alias("place"))


@query("""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal, o_totalprice < lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rises FROM orders""")
def ordinals(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", windows.ordinal("o_orderkey", partition=["o_custkey"]).cast("long").alias("ordinal"), windows.adjacent_less("o_totalprice", "o_orderkey", "o_custkey").alias("rises"))


@query("""
    SELECT page_id, 'fallback' AS source FROM pages p WHERE page_id % 2 = 1 AND page_id % 5 <> 0 UNION ALL SELECT page_id, 'live' FROM pages WHERE page_id % 2 = 0""")
def live_before_fallback(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    return windows.prefer_live(pages.where("page_id % 2 = 0"), pages.where("page_id % 5 <> 0"), "page_id")


@query("""SELECT s_suppkey, array_to_string(list_sort(list_distinct([s_suppkey % 3, s_suppkey % 5, s_suppkey % 7])), ',') AS merged FROM supplier""")
def merged_missing(spark, sf_dir):
    key = F.col("s_suppkey")
    merged = windows.merged(F.array(key % 3), F.array(key % 5, key % 7))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.array_sort(merged).cast("array<string>"), ",").alias("merged"))


@query("SELECT s_name FROM supplier ORDER BY s_name LIMIT 30")
def first_listed(spark, sf_dir):
    """The first thirty names of a listing: the limit is the feature."""
    return windows.head(table(spark, sf_dir, "supplier").select("s_name"), 30, "s_name")


@query("""
    SELECT printf('%04d', k) AS id, arg_max(p_name, p_partkey) AS name FROM (SELECT *, p_partkey % 300 AS k FROM part WHERE p_size % 2 = 0) GROUP BY k""")
def exported_names(spark, sf_dir):
    """Plain lines of numbered containers; lines with a quality prefix aren't exported."""
    prefix = F.when(F.col("p_size") % 2 == 0, "").otherwise("HD2/")
    line = F.concat(F.lit("animations/"), "p_name", F.lit(": "), prefix, F.format_string("anim/main_%04d.anim", F.col("p_partkey") % 300))
    return text_files.exported_map(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), line.alias("value")))


@query("SELECT p_brand AS key, arg_max(p_name, p_partkey) AS value FROM part WHERE starts_with(p_brand, 'Brand#1') GROUP BY p_brand")
def mapping_category(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.concat("p_brand", F.lit(" :"), "p_name").alias("value"))
    return text_files.category(text_files.mapping(lines), "Brand#1")


_JSON = """{{\n  "name": "' || p_name || '",\n  "frameCount": 2,\n  "grpWidth": ' || p_size || ',\n  "grpHeight": 64,\n  "textureWidth": 512,\n  "textureHeight": 256,\n  "pixelsPerUnit": 32.5,\n  "frames": [\n    {f0},\n    {f1}\n  ]\n}}"""
_FRAME = """{{"index": {i}, "x": ' || {i} * p_size || ', "y": 3, "width": ' || p_size || ', "height": 5, "offsetX": -' || p_size || ', "offsetY": {i}}}"""


@query("SELECT p_partkey, '" + _JSON.format(f0=_FRAME.format(i=0), f1=_FRAME.format(i=1)) + "' AS json FROM part")
def sheet_metadata(spark, sf_dir):
    size = F.col("p_size")
    frame = lambda i: F.struct(F.lit(i).alias("index"), (size * i).alias("x"), F.lit(3).alias("y"), size.alias("width"), F.lit(5).alias("height"), (-size).alias("x_offset"), F.lit(i).alias("y_offset"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".anim")).alias("name"), size.alias("grp_width"), F.lit(64).alias("grp_height"), F.lit(512).alias("texture_width"), F.lit(256).alias("texture_height"), F.array(frame(0), frame(1)).alias("frames"))
    return sinks.metadata(rows, 32.5).select("p_partkey", "json")


@query("SELECT l_orderkey, l_linenumber, 100000 - l_partkey - l_linenumber AS y_up, l_linenumber / 12.5 AS time FROM lineitem")
def importer_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("y"), F.col("l_linenumber").alias("height"), F.col("l_linenumber").alias("index"))
    return sinks.clip_times(sinks.bottom_up_rects(rows, F.lit(100_000)), 12.5).select("l_orderkey", "l_linenumber", "y_up", "time")


@query("""SELECT '[' || string_agg('{"output":"' || s_name || '","candidates":["a/' || s_suppkey || '.wav","b\\\\' || s_suppkey || '.ogg"]}', ',' ORDER BY s_name) || ']' AS json FROM supplier WHERE s_nationkey = 3""")
def sound_targets(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_name").alias("output"), F.array(F.concat(F.lit("a/"), key, F.lit(".wav")), F.concat(F.lit("b\\"), key, F.lit(".ogg"))).alias("candidates"))
    return text_files.targets_json(rows)


@query("""
    WITH k AS (SELECT n_name, n_nationkey % 3 <> 2 AS indexed, n_nationkey % 2 = 0 AS packed FROM nation)
    SELECT n_name AS root, CASE WHEN indexed AND packed THEN 'Mixed' WHEN indexed THEN 'Indexed' ELSE 'Packed' END AS kind, CASE WHEN indexed THEN 'Newer' ELSE 'Older' END AS version FROM k WHERE indexed OR packed""")
def installation_kinds(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    key, none = F.col("n_nationkey"), F.lit(None).cast("array<string>")
    paths = F.flatten(F.array_compact(F.array(F.when(key % 3 != 2, F.array(F.lit("Data/data/data.000"), F.lit("Data/data/0000000001.idx"))).otherwise(none), F.when(key % 2 == 0, F.array(F.lit("Data/a.MPQ"), F.lit("old.exe"))).otherwise(none))))
    rows = nation.select(F.col("n_name").alias("root"), F.explode(paths).alias("path"))
    layout = listing.Layout(newer_markers=("Data/data/data.000",), older_markers=("old.exe",), older_archives=("Data/a.MPQ",))
    return listing.installations(rows, layout).select("root", "kind", "version")


@query("""
    SELECT s_suppkey, sha256(c) AS sha, CAST(octet_length(encode(c)) AS BIGINT) AS n_bytes, CAST(s_nationkey % 6 AS INT) AS data_file
    FROM (SELECT s_suppkey, s_nationkey, s_name || '|' || repeat(s_name, CAST(1 + s_suppkey % 40 AS INT)) AS c FROM supplier)""")
def archived_contents(spark, sf_dir):
    """Suppliers' records in six data files and an index file, read back by key."""
    content = F.concat_ws("|", "s_name", F.expr("repeat(s_name, cast(1 + s_suppkey % 40 as int))"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 6).cast("int").alias("data_file"), F.encode(content, "utf-8").alias("content"))
    before = Window.partitionBy("data_file").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    key = F.unhex(F.lpad(F.hex("s_suppkey"), 18, "0"))
    placed = rows.select("*", key.alias("key"), F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)).alias("offset"))
    entry = F.concat("key", number(F.col("data_file"), 4), number(F.col("offset"), 4))
    joined = lambda c: F.expr(f"array_join(transform(array_sort(collect_list(struct(s_suppkey, hex({c}) as h))), x -> x.h), '')")
    blobs = placed.groupBy("data_file").agg(F.unhex(joined("content")).alias("content"))
    header = F.concat(number(16, 4), number(0, 4), number(7, 2), number(0, 1), number(0, 1), number(4, 1), number(4, 1), number(9, 1), number(16, 1), number(1024, 8))
    index = placed.withColumn("entry", entry).agg(F.concat(header, F.unhex(joined("entry"))).alias("content"))
    files = blobs.select(F.format_string("data/data.%03d", "data_file").alias("path"), "content").union(index.select(F.lit("data/0000000001.idx").alias("path"), "content"))
    root = f"{work_dir(spark)}/orebed/archive-{uuid.uuid4().hex}"
    sinks.write_files(files, urlparse(root).path).count()
    contents, _ = archive.extracted(archive.opened(spark, root), placed.select("key"))
    found = contents.select(F.conv(F.hex("key"), 16, 10).cast("long").alias("s_suppkey"), F.sha2("content", 256).alias("sha"), F.length("content").cast("long").alias("n_bytes"), "data_file")
    return found
