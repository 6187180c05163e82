"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them. DataFrame functions only.

The base patterns find emails, IP addresses, card and phone numbers; each distinct value is a protected entity. Terms near its
mentions are judged by how much they tell of it. With N documents, of which n(e) mention entity e, n(t) hold term t and n(t, e)
hold t near e, a document with t mentions e with the estimated probability

    p = (n(t, e) + prior * n(e) / N) / (n(t) + prior)

The pointwise mutual information is log2(p N / n(e)), and its share of the entity's information log2(N / n(e)) is the disclosure:
near 1 if the term always comes with the entity, 0 if it is independent (after Sánchez and Batet, "C-sanitized", 2016). `prior`
documents of no bearing are added to each term's, so that rare entities and terms count, but few documents prove less than many.

Near its mentions, a term that discloses `remove` or more goes. One that discloses `generalise` or more gives way to a class of
terms that discloses less than that, judged in the same way: the terms of the same first three letters, else all words or all
numbers; if neither discloses less, it goes too.

Counts are sums over all documents, reduced in each task before they are shuffled; pairs are made only within `window` characters
around a mention, so their number grows with the mentions. Texts are cut into blocks once, so that looking around each of many
mentions, and putting a text together again, takes time in proportion to the text. Nothing is collected but the number of documents.

Rows: a null or empty text has no spans. Equal rows each give a row, and count each as a document. Positions are code points, the end
exclusive. Base spans of different kinds may overlap; a term's span overlaps none of them. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.llm.frames import apart, pick, row_key, second_key
from orebed.llm.rows import KEYS, having, keyed
from orebed.session import written

# The kinds, in order, and what they match. Possessive repeats and look-behind change no match: they spare the
# search places and retries that can't succeed, so that time is linear in the text and the matcher doesn't recur.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LETTER = r"\p{L}\p{N}"
TERM = rf"[{LETTER}]{{3,}}"
#: What letters of base spans become while terms are sought, so that words that touch them are known.
HIDDEN = "\0"
REMOVED, GENERALISED = "removed", "generalised"
WORD_CLASS, NUMBER_CLASS = "[WORD]", "[NUMBER]"
#: Characters that make a class of terms.
CLASS_LETTERS = 3
#: How a term is put: as its first letters, as word or number, or not at all.
BY_LETTERS, BY_SHAPE, NOT_AT_ALL = 0, 1, 2
#: Running values are made in chunks of this length, so that their cost doesn't grow with the square of a text's matches.
CHUNK = 256
#: Code points of a block that a text is cut into.
BLOCK = 256


@dataclass(frozen=True)
class Disclosure:
    """window: characters on either side of a mention. generalise, remove: least disclosures. prior: documents added to a term's."""

    window: int = 80
    generalise: float = 0.8
    remove: float = 0.9
    prior: float = 4.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body uses it and whatever the optimizer merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(start: Column, values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """start and the running results of step over a short array of ints."""
    return F.aggregate(values, F.array(start), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """0 and the running results of step over an array of ints."""

    def in_chunks(values: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))
        chunks = F.transform(places, lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))
        # a chunk's results are put together first, so that the long array is copied once a chunk
        return F.aggregate(chunks, F.array(F.lit(0)), lambda done, c: F.concat(done, F.slice(_steps(F.element_at(done, -1), c, step), 2, F.lit(CHUNK))))

    return _let(values, lambda v: F.when(F.size(v) > CHUNK, in_chunks(v)).otherwise(_steps(F.lit(0), v, step)))


def _placed(matches: Column, gaps: Column) -> Column:
    """array of (word, start, end) of matches; gaps: the text between them."""
    pairs = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"))

    def with_ends(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda x: F.length(x["g"]) + F.length(x["m"])), lambda a, x: a + x)

        def place(ends: Column) -> Column:
            end = lambda i: F.get(ends, i + 1)
            return F.transform(pairs, lambda x, i: F.struct(x["m"].alias("word"), (end(i) - F.length(x["m"])).alias("start"), end(i).alias("end")))

        return _let(ends, place)

    return _let(pairs, with_ends)


_NONE = "cast(array() as array<struct<word:string,start:int,end:int>>)"


def _blocks(text: Column) -> Column:
    """The text in pieces of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start to end, of its blocks."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(joined, start - first * BLOCK + 1, end - start)).otherwise("")


def _replaced(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """text with spans (sorted by start) replaced.

    put takes a span and the part of it that no earlier span has taken. Replacement begins where earlier spans end.
    """

    def whole(blocks: Column, reach: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            done = F.get(reach, i)
            return F.concat(_cut(blocks, done, s["start"]), put(s, _cut(blocks, F.greatest(done, s["start"]), s["end"])))

        return F.concat(F.array_join(F.transform(spans, piece), ""), _cut(blocks, F.element_at(reach, -1), F.length(text)))

    reach = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return _let(_blocks(text), lambda blocks: _let(reach, lambda reach: whole(blocks, reach)))


def _valid(kind: str, word: Column) -> Column:
    digits = F.regexp_replace(word, "[^0-9]", "")
    if kind == "ip":
        return word.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _entity(kind: str, word: Column) -> Column:
    return F.xxhash64(F.lit(kind), F.lower(word) if kind in ("email", "ip") else F.regexp_replace(word, "[^0-9]", ""))


def _of_kind(kind: str, rank: int) -> Column:
    """The spans of one kind, from its matches and the gaps between them."""
    placed = F.when(F.size(f"m_{kind}") > 0, _placed(F.col(f"m_{kind}"), F.col(f"g_{kind}"))).otherwise(F.expr(_NONE))
    held = F.filter(placed, lambda x: _valid(kind, x["word"]))

    def span(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), _entity(kind, x["word"]).alias("entity"))

    return F.transform(held, span)


def _base(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with key, key2 and base: array of (start, rank, end, kind, entity), sorted."""
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<string>")

    def matches(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.when(needs.get(kind, F.lit(True)), found).otherwise(none).alias(f"m_{kind}")

    def if_any_valid(kind: str) -> Column:
        return F.when(F.exists(f"m_{kind}", lambda w: _valid(kind, w)), F.col(f"m_{kind}")).otherwise(none).alias(f"m_{kind}")

    keys = (row_key("doc_id", "text").alias("key"), second_key("doc_id", "text").alias("key2"))
    df = docs.select("doc_id", *keys, F.coalesce("text", F.lit("")).alias("text"))
    # matches that fail a check cost nothing more: only texts with a match are cut at the matches
    df = df.select("*", *(matches(k, p) for k, p in PATTERNS.items()))
    df = df.select("doc_id", "text", *KEYS, *map(if_any_valid, PATTERNS))
    df = df.select("*", *(F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p in PATTERNS.items()))
    parts = [_of_kind(kind, rank) for rank, kind in enumerate(PATTERNS)]
    return df.select("doc_id", "text", *KEYS, F.array_sort(F.concat(*parts)).alias("base"))


def _near(text: Column, base: Column, window: int) -> Column:
    """(entity, term, start, end) of the terms around each base span. In text the letters of base spans are hidden."""
    letters, run = rf"[{LETTER}{HIDDEN}]", rf"[{LETTER}{HIDDEN}]{{3,}}"

    def sides(size: Column) -> Column:
        def of_span(b: Column) -> Column:
            low, high = F.greatest(b["start"] - window, F.lit(0)), F.least(b["end"] + window, size)
            before = F.struct(b["entity"].alias("entity"), low.alias("low"), b["start"].alias("high"), (b["start"] > window).alias("cut_low"), F.lit(False).alias("cut_high"))
            after = F.struct(b["entity"].alias("entity"), b["end"].alias("low"), high.alias("high"), F.lit(False).alias("cut_low"), (high - b["end"] == window).alias("cut_high"))
            return F.array(before, after)

        return F.flatten(F.transform(base, of_span))

    def snippet(blocks: Column, x: Column) -> Column:
        # a snippet that begins or ends within a word is cut back to whole words
        given = _cut(blocks, x["low"], x["high"])
        short = F.when(x["cut_low"], F.regexp_replace(given, f"^{letters}+", "")).when(x["cut_high"], F.regexp_replace(given, f"{letters}+$", "")).otherwise(given)
        return _let(short, lambda t: F.struct(x["entity"].alias("entity"), F.when(x["cut_low"], x["high"] - F.length(t)).otherwise(x["low"]).alias("at"), t.alias("text")))

    def terms(x: Column) -> Column:
        placed = _placed(F.regexp_extract_all(x["text"], F.lit(run), F.lit(0)), F.split(x["text"], run, -1))
        open_ = F.filter(placed, lambda w: ~F.contains(w["word"], F.lit(HIDDEN)))

        def term(w: Column) -> Column:
            return F.struct(x["entity"].alias("entity"), F.lower(w["word"]).alias("term"), (x["at"] + w["start"]).alias("start"), (x["at"] + w["end"]).alias("end"))

        return F.transform(open_, term)

    def found(blocks: Column) -> Column:
        cut = F.transform(_let(F.length(text), sides), lambda x: snippet(blocks, x))
        return F.flatten(F.transform(cut, terms))

    return _let(_blocks(text), found)


def mentions(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, key, key2, row (a number), base, near: array of (entity, term, start, end) around the base spans. Without the text."""
    df = _base(docs)
    hidden = _replaced(F.translate("text", HIDDEN, " "), F.col("base"), lambda s, part: F.regexp_replace(part, f"[{LETTER}]", HIDDEN))
    none = F.expr("cast(array() as array<struct<entity:bigint,term:string,start:int,end:int>>)")
    near = F.when(F.size("base") > 0, _let(hidden, lambda text: _near(text, F.col("base"), rule.window))).otherwise(none)
    return df.select("doc_id", *KEYS, F.monotonically_increasing_id().alias("row"), "base", near.alias("near"))


def by_letters(term: Column) -> Column:
    """The finer class of a term."""
    return F.concat(F.substring(term, 1, CLASS_LETTERS), F.lit("*"))


def by_shape(term: Column) -> Column:
    """The coarser class of a term."""
    return F.when(term.rlike(r"^\p{N}+$"), NUMBER_CLASS).otherwise(WORD_CLASS)


def disclosures(marked: DataFrame, docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """entity, term, disclosure, level (how to put it): the terms that disclose `generalise` or more. marked: mentions(docs), written."""
    total = marked.count()
    near = marked.select("row", F.explode("near").alias("n")).select("row", "n.entity", "n.term")
    named = near.select("row", "entity", F.explode(F.array("term", by_letters(F.col("term")), by_shape(F.col("term")))).alias("name")).distinct()
    both = named.groupBy("entity", "name").agg(F.count("*").alias("n_both"))
    entities = marked.select(F.explode(F.array_distinct("base.entity")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    found = docs.select(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("terms"))
    names = F.array_distinct(F.concat("terms", *(F.transform("terms", of_class) for of_class in (by_letters, by_shape))))
    held = found.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n_name"))
    share = F.col("n_entity") / F.lit(float(total))
    chance = (F.col("n_both") + rule.prior * share) / (F.col("n_name") + rule.prior)
    judged = both.join(entities, "entity").join(held, "name").where(F.col("n_entity") < total)
    judged = written(judged.select("entity", "name", (F.log2(chance / share) / F.log2(1 / share)).alias("disclosure")), "pii-judged")
    telling = judged.where(~F.col("name").rlike(r"[*\[]")).where(F.col("disclosure") >= rule.generalise).withColumnRenamed("name", "term")
    for i, name in enumerate((by_letters(F.col("term")), by_shape(F.col("term")))):
        of_class = judged.select("entity", F.col("name").alias(f"class_{i}"), F.col("disclosure").alias(f"disclosure_{i}"))
        telling = telling.withColumn(f"class_{i}", name).join(of_class, ["entity", f"class_{i}"])
    level = F.when(F.col("disclosure") >= rule.remove, NOT_AT_ALL).when(F.col("disclosure_0") < rule.generalise, BY_LETTERS)
    level = level.when(F.col("disclosure_1") < rule.generalise, BY_SHAPE).otherwise(NOT_AT_ALL)
    return telling.select("entity", "term", "disclosure", level.alias("level"))


def find(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, key and key2 (of doc_id and text), base and terms: arrays of (start, rank, end, kind, ...), each sorted.

    A term near several entities is put as the one it tells most of wants. terms also hold disclosure and label, what to put.
    """
    given = pick(docs, "doc_id", "text")
    marked = written(mentions(given, rule), "pii-mentions")
    telling = written(disclosures(marked, given, rule), "pii-disclosures")
    near = marked.select("row", F.explode("near").alias("n")).select("row", "n.*")
    most = (F.max("disclosure").alias("disclosure"), F.max("level").alias("level"))
    hits = near.join(telling, ["entity", "term"]).groupBy("row", "start", "end", "term").agg(*most)
    letters = F.concat(F.lit("["), by_letters(F.col("term")), F.lit("]"))
    label = F.when(F.col("level") == BY_LETTERS, letters).when(F.col("level") == BY_SHAPE, by_shape(F.col("term"))).otherwise("")
    kind = F.when(F.col("level") == NOT_AT_ALL, REMOVED).otherwise(GENERALISED)
    span = F.struct("start", F.lit(len(PATTERNS)).alias("rank"), "end", kind.alias("kind"), "disclosure", label.alias("label"))
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("terms"))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,disclosure:double,label:string>>)")
    return marked.join(spans, "row", "left").select("doc_id", *KEYS, "base", F.coalesce("terms", empty).alias("terms"))


def spans(base: str = "base", terms: str = "terms") -> Column:
    """All spans (start, rank, end, kind, label) by start, then kind."""
    fields = ("start", "rank", "end", "kind")

    def plain(column: str, label: Callable[[Column], Column]) -> Column:
        return F.transform(column, lambda s: F.struct(*(s[f].alias(f) for f in fields), label(s).alias("label")))

    return F.array_sort(F.concat(plain(base, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))), plain(terms, lambda s: s["label"])))


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """docs with base spans replaced by their kind, and telling terms by a class or nothing. Other columns stay.

    Of spans that overlap each is put where it begins, and what is left of it when the one before ends. Only texts with spans are
    shuffled, if the list of their keys can be sent to all tasks.
    """
    found = find(docs, rule).select(*KEYS, spans().alias("spans")).where(F.size("spans") > 0)
    found = written(found.dropDuplicates(list(KEYS)), "pii-spans")
    keys = written(found.select(*KEYS), "pii-keys")
    name = apart(docs, *KEYS, "spans")["spans"]
    rows, names = keyed(having(docs, keys))
    both = rows.join(found.toDF(*names, name), names).withColumn("text", _replaced(F.col("text"), F.col(name), lambda s, part: s["label"]))
    return having(docs, keys, "left_anti").unionByName(both.select(*docs.columns))
