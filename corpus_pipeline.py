"""Raw documents to packed training sequences: language, quality, near duplicates, personal data, packing.

Each stage takes all that the one before it kept. What a language or quality rule rejects goes, near duplicates leave one
document of each class, personal data is replaced in the text, and the last stage returns the pieces of packed sequences.

Rows: a null, empty or letterless text is no learned language, so it goes at once. Null ids, languages, sources and counts are kept;
a null lang becomes the one found. Equal rows are copies of one document. Columns beyond the five of documents are left out. An empty
table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm import langid, packing, pii, quality, shingles
from orebed.llm.frames import pick
from orebed.llm.token_counts import word_count
from orebed.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose best language has a lower cosine is none of the learned languages.
LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language, with that language where they name none."""
    settings = langid.Settings()
    model = langid.train(docs.where(~langid.held_out()), settings)
    tagged = langid.tag(pick(docs, *COLUMNS), model, settings)
    known = tagged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return quality.cleaned(pick(docs, *COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts that share 0.8 of their 5-word shingles the document with the least doc_id."""
    return shingles.representatives(pick(docs, *COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that reveal it replaced."""
    return pii.sanitise(pick(docs, *COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, where it starts and how many words it has, and its place in a sequence."""
    length, cluster = word_count(F.col("text")).alias("length"), packing.copies(F.col("text")).alias("cluster")
    return packing.pack(written(pick(docs, *COLUMNS).select("doc_id", "source", cluster, length), "lengths"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", best_fit),
]

#: SQL expresses neither trained vectors nor packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; between stages a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
