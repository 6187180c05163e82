"""The operators as queries over the test tables, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

import importlib.util
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm import bpe, chat, langid, licenses, neighbours, packing, pii, quality, simhash, token_counts
from orebed.session import work_dir, written

WORD_TOKENS, BYTE_TOKENS = "words-1", "bytes-1"
#: Documents of fewer words are deleted from the rollup and inserted again.
SHORT_WORDS = 5
#: Characters that a word is first taken to have.
GUESSED_CHARS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The byte-level vocabulary file: $BPE_VOCABULARY, else that of the installed package."""
    if path := os.environ.get("BPE_VOCABULARY"):
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None:
        raise FileNotFoundError("name a vocabulary file in BPE_VOCABULARY")
    return os.path.join(os.path.dirname(spec.origin), "byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are guessed, then revised to exact ones; short documents are deleted and inserted again; batches come twice, and a fold
    lies between. In the end the totals cover all documents."""
    docs = table(spark, sf_dir, "documents").select(
        "source", "lang", F.ceil(F.coalesce("n_chars", F.lit(0)) / GUESSED_CHARS).alias("guess"),
        token_counts.word_count(F.col("text")).alias("words"), token_counts.byte_count(F.col("text")).alias("bytes"),
    )
    counted = written(docs, "counted")
    none = F.lit(None).cast("long")

    def change(kind: str, tokenizer: str, new: Column, old: Column, rows: DataFrame = counted) -> DataFrame:
        named = F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer")
        return rows.select(*named, new.alias("n_tokens"), old.alias("old_tokens"))

    short = counted.where(F.col("words") < SHORT_WORDS)
    words, size = F.col("words"), F.col("bytes")
    first = change("insert", WORD_TOKENS, F.col("guess"), none).union(change("insert", BYTE_TOKENS, size, none))
    revised = change("revise", WORD_TOKENS, words, F.col("guess"))
    deleted = change("delete", WORD_TOKENS, none, words, short).union(change("delete", BYTE_TOKENS, none, size, short))
    again = change("insert", WORD_TOKENS, words, none, short).union(change("insert", BYTE_TOKENS, size, none, short))
    rollup = token_counts.Rollup(spark, f"{work_dir(spark)}/orebed/rollup-{uuid.uuid4().hex}")
    for batch, changes in (("0001", first), ("0002", revised), ("0002", revised), ("0003", deleted)):
        rollup.commit(batch, changes)
    rollup.fold()
    for batch, changes in (("0001", first), ("0004", again), ("0003", deleted)):
        rollup.commit(batch, changes)
    return rollup.totals().select(*token_counts.KEYS, "n_docs", "n_tokens")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.PATTERNS), F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"), pii.told(pii.spans()).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), texts=False)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = chat.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return drawn.select("conv_id", "part", "assistant", "n_turns", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), mask.alias("mask"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are words; copies of a text are a duplicate cluster, null texts none."""
    length = token_counts.word_count(F.col("text")).alias("length")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", packing.copies(F.col("text")).alias("cluster"), length)
    return packing.pack(written(docs, "lengths")).select("doc_id", "piece", "piece_start", "length", "source", "cluster", "shard", "bin", "place")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_neighbours, op3_pii, op4_quality, op5_language, op6_chat, op7_simhash, op8_packing, op9_bpe, op10_licenses)}

_LIST = lambda words: ", ".join("'" + w + "'" for w in sorted(words))
_RUNS = "|".join("[" + ("\\^" if c == "^" else c) + "]{2}" for c in "!?#$%&*<=>@^_|~+")
_OP4_SQL = rf"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
    windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
    repeated AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT r, i, unnest([0, 1, 2]) AS j FROM windows WHERE n > 1) GROUP BY r),
    split AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS k FROM docs),
    lines AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, k = max(k) OVER (PARTITION BY r) AS last, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again
              FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    judged AS (SELECT *, CASE
        WHEN len(w) >= 3 AND len(list_filter(w, lambda x: x IN ({_LIST(quality.SEPARATORS)}))) > 0.2::DOUBLE * len(w) THEN 'navigation'
        WHEN len(w) <= 8 AND 2 * len(list_filter(w, lambda x: lower(trim(x, '.,:;!?|()')) IN ({_LIST(quality.NAVIGATION)}))) > len(w) THEN 'navigation'
        WHEN regexp_matches(line, '{quality.BOILERPLATE.pattern.replace("(?ai)", "(?i)")}') THEN 'boilerplate'
        WHEN len(list_filter(w, lambda x: regexp_matches(x, '{_RUNS}'))) > 0.3::DOUBLE * len(w) THEN 'punctuation'
        WHEN NOT last AND len(w) >= 8 AND NOT regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), '{quality.ENDS.pattern.replace("'", "''")}') THEN 'punctuation' END AS fault FROM lines),
    by_doc AS (SELECT r, count(*) FILTER (again) AS dup, count(*) FILTER (fault = 'punctuation') AS p, count(*) FILTER (fault = 'navigation') AS n, count(*) FILTER (fault = 'boilerplate') AS b,
        coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (fault IS NOT NULL), 0) AS lost FROM judged GROUP BY r),
    counts AS (SELECT r, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM docs JOIN words USING (r)),
    whole AS (SELECT *, coalesce(dup, 0) AS d, coalesce(n_repeat_words, 0) AS rep, coalesce(lost, 0) AS gone FROM counts LEFT JOIN by_doc USING (r) LEFT JOIN repeated USING (r))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(d AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words,
           n_words < 50 OR 100 * rep > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * rep > 50 * n_words) AND 2 * gone <= word_chars AS kept,
           CAST(coalesce(p, 0) AS BIGINT) AS punctuation_lines, CAST(coalesce(n, 0) AS BIGINT) AS navigation_lines, CAST(coalesce(b, 0) AS BIGINT) AS boilerplate_lines, CAST(gone AS BIGINT) AS lost_chars FROM whole"""

_PLACED = """
    {name}_each AS (SELECT {keys}, unnest(m) AS w, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM {source} WHERE len(m) > 0),
    {name} AS (SELECT {keys}, w, CAST(sum(length(gap) + length(w)) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) AS e FROM {name}_each)"""
# the base patterns without what spares retries; matches are the same
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_RAW = " UNION ALL ".join(f"SELECT r, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM docs" for rank, (kind, p) in enumerate(_PLAIN.items()))
_BY_LETTERS, _BY_SHAPE = "substr({0}, 1, 3) || '*'", r"CASE WHEN regexp_full_match({0}, '\p{{N}}+') THEN '[NUMBER]' ELSE '[WORD]' END"
_OP3_SQL = rf"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    raw AS ({_RAW}), {_PLACED.format(name="placed", source="raw", keys="r, kind, rank")},
    numbered AS (SELECT *, regexp_replace(w, '[^0-9]', '', 'g') AS d FROM placed),
    base AS (SELECT r, e - length(w) AS s, rank, e, kind, kind || ':' || CASE WHEN kind IN ('email', 'ip') THEN lower(w) ELSE d END AS entity FROM numbered WHERE CASE kind
        WHEN 'email' THEN true WHEN 'ip' THEN regexp_full_match(w, '{_PART}\.{_PART}\.{_PART}\.{_PART}') WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
        ELSE length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(d[length(d) - k] AS INT)
            WHEN CAST(d[length(d) - k] AS INT) > 4 THEN 2 * CAST(d[length(d) - k] AS INT) - 9 ELSE 2 * CAST(d[length(d) - k] AS INT) END)) % 10 = 0 END),
    cut AS (SELECT r, entity, s, e, substr(t, greatest(s - 80, 0) + 1, least(s, 80)) AS x, substr(t, e + 1, 80) AS y FROM base JOIN docs USING (r)),
    sides AS (SELECT row_number() OVER () AS side, * FROM (
        SELECT r, entity, s - length(x) AS at_, x FROM (SELECT r, entity, s, CASE WHEN s > 80 THEN regexp_replace(x, '^[\p{{L}}\p{{N}}]+', '') ELSE x END AS x FROM cut)
        UNION ALL SELECT r, entity, e, CASE WHEN length(y) = 80 THEN regexp_replace(y, '[\p{{L}}\p{{N}}]+$', '') ELSE y END FROM cut)),
    found AS (SELECT side, regexp_extract_all(x, '[\p{{L}}\p{{N}}]{{3,}}') AS m, regexp_split_to_array(x, '[\p{{L}}\p{{N}}]{{3,}}') AS g FROM sides), {_PLACED.format(name="words", source="found", keys="side")},
    near AS (SELECT DISTINCT r, entity, lower(w) AS term, at_ + e - length(w) AS ts, at_ + e AS te FROM words JOIN sides USING (side)),
    open AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = n.r AND b.s < n.te AND n.ts < b.e)),
    named AS (SELECT DISTINCT r, entity, unnest([term, {_BY_LETTERS.format('term')}, {_BY_SHAPE.format('term')}]) AS name FROM open),
    both_ AS (SELECT entity, name, count(*) AS nb FROM named GROUP BY ALL),
    entities AS (SELECT entity, count(DISTINCT r) AS ne FROM base GROUP BY ALL),
    terms AS (SELECT DISTINCT r, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]{{3,}}')) AS term FROM docs),
    names AS (SELECT name, count(DISTINCT r) AS nn FROM (SELECT r, unnest([term, {_BY_LETTERS.format('term')}, {_BY_SHAPE.format('term')}]) AS name FROM terms) GROUP BY name),
    judged AS (SELECT entity, name, log2((nb + 4.0::DOUBLE * (ne / n::DOUBLE)) / (nn + 4.0::DOUBLE) / (ne / n::DOUBLE)) / log2(1 / (ne / n::DOUBLE)) AS disclosure
        FROM both_ JOIN entities USING (entity) JOIN names USING (name), (SELECT count(*) AS n FROM docs) WHERE ne < n),
    telling AS (SELECT j.entity, j.name AS term, j.disclosure, CASE WHEN j.disclosure >= 0.9 THEN 2 WHEN l.disclosure < 0.8 THEN 0 WHEN s.disclosure < 0.8 THEN 1 ELSE 2 END AS level FROM judged j
        JOIN judged l ON l.entity = j.entity AND l.name = {_BY_LETTERS.format('j.name')} JOIN judged s ON s.entity = j.entity AND s.name = {_BY_SHAPE.format('j.name')}
        WHERE j.disclosure >= 0.8 AND NOT regexp_matches(j.name, '[*\[]')),
    hits AS (SELECT r, ts, te, max(level) AS level FROM open JOIN telling USING (entity, term) GROUP BY ALL),
    spans AS (SELECT r, s, rank, e, kind FROM base UNION ALL SELECT r, ts, 4, te, CASE WHEN level = 2 THEN 'removed' ELSE 'generalised' END FROM hits),
    told AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 4) AS base_spans,
        count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (rank = 3) AS n3, count(*) FILTER (rank = 4) AS n4 FROM spans GROUP BY r)
    SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_email, CAST(coalesce(n1, 0) AS BIGINT) AS n_ip, CAST(coalesce(n2, 0) AS BIGINT) AS n_card, CAST(coalesce(n3, 0) AS BIGINT) AS n_phone,
           sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n4, 0) AS BIGINT) AS n_terms FROM docs LEFT JOIN told USING (r)"""

ORACLE_SQL = {
    "op1_token_counts": r"""
        WITH counted AS (SELECT source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
                                CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents),
        each AS (SELECT source, lang, 'words-1' AS tokenizer, words AS n FROM counted
                 UNION ALL SELECT source, lang, 'bytes-1', bytes FROM counted)
        SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM each GROUP BY ALL""",
    "op3_pii": _OP3_SQL,
    "op4_quality": _OP4_SQL,
    "op6_chat": r"""
        WITH turns AS (SELECT DISTINCT conv_id, turn,
            regexp_replace(replace(replace(coalesce(role, 'unknown'), '\', '\\'), chr(10), '\n'), '<\|(\\*im_)', '<|\\\1', 'g') AS role,
            regexp_replace(coalesce(text, ''), '<\|(\\*im_)', '<|\\\1', 'g') AS text FROM conversations),
        speakers AS (SELECT DISTINCT conv_id, role AS assistant FROM turns WHERE role <> 'system'),
        pieces AS (SELECT t.*, s.assistant, text || '<|im_end|>' || chr(10) AS body,
            '<|im_start|>' || CASE WHEN role = assistant THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
            FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        placed AS (SELECT *, coalesce(sum(length(head || body)) OVER (PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, role, text
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM pieces)
        SELECT conv_id, CAST(0 AS BIGINT) AS part, assistant, CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(length(head || body)) AS BIGINT) AS n_chars,
               sha256(string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text)) AS text_sha256,
               string_agg(CAST(CAST(begun + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begun + length(head || body) AS BIGINT) AS VARCHAR), ','
                          ORDER BY turn NULLS FIRST, role, text) FILTER (role = assistant) AS mask
        FROM placed GROUP BY conv_id, assistant""",
}
