"""Token counts as rollups that deltas maintain.

Totals are kept by source, language and tokenizer version. A batch of signed changes is reduced to one row for each such key and
committed under its id: its files are written aside, and one rename makes them part of the state. A batch whose id is there
already changes nothing, so that a batch may be sent again after a failure. Totals are sums over batches. `fold` replaces many
batches by one, in which two tables stand: the sums, and the ids of the batches taken in, sorted, so that one id is looked up by a
filter that reaches the files. Ids are never collected or written into a plan.

The rename is atomic on HDFS and local file systems. An object store without atomic renames needs a file system layer that has
them; readers could otherwise see a batch in part.

Rows: a null source, language or version is a key of its own. A null count is no tokens. A change of an unknown kind is an error.
An empty batch is committed and changes no total; an empty state has no totals. An id may be any text.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.frames import WORD, pick

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
IDS = "id string"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """One signed row for each key. changes: kind (insert, delete, revise), the keys, n_tokens (insert, revise), old_tokens (delete, revise).

    A revision under another key is a delete and an insert.
    """
    rows = pick(changes, "kind", *KEYS, "n_tokens", "old_tokens")
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("kind", F.lit("null"))))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0).otherwise(unknown)
    tokens = F.when(F.col("kind") == "insert", new).when(F.col("kind") == "delete", -old).otherwise(new - old)
    return rows.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("n_docs"), F.sum(tokens.cast("long")).alias("n_tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share.

    Below `state` each folder is a part: a batch (`batch-` and a digest of its id) or a fold (`fold-` and a number, the highest one
    counts). A part has the tables `sums` and `ids`; `parts` of a fold lists the parts that it has taken in.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), conf)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._options = spark.sparkContext._gateway.new_array(kind, 1)
        self._options[0] = kind.NONE
        self._fs.mkdirs(self._path(f"{path}/state"))

    def _names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/state")))

    def _table(self, names: list[str], table: str, schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/state/{n}/{table}" for n in names))

    def _live(self) -> list[str]:
        """The parts that count: the last fold, and those that it hasn't taken in.

        A part that a fold has taken in is there still only if that fold broke off before it deleted it.
        """
        names = self._names()
        folds = [n for n in names if n.startswith("fold-")]
        if not folds:
            return names
        last = folds[-1]
        batches = [n for n in names if not n.startswith("fold-")]
        if not batches:
            return [last]
        taken = self._table([last], "parts", IDS)
        there = self.spark.createDataFrame([(n,) for n in batches], IDS)
        return [last, *(r.id for r in there.join(taken, "id", "left_anti").collect())]  # folders that are there, no more

    def has(self, batch: str) -> bool:
        """Whether a batch of this id is committed."""
        if self._fs.exists(self._path(f"{self.path}/state/{self._name(batch)}")):
            return True
        folds = [n for n in self._names() if n.startswith("fold-")]
        return bool(folds) and not self._table(folds[-1:], "ids", IDS).where(F.col("id") == batch).isEmpty()

    def batches(self) -> DataFrame:
        """id of each committed batch, folded ones included."""
        return self._table(self._live(), "ids", IDS)

    @staticmethod
    def _name(batch: str) -> str:
        return f"batch-{hashlib.sha256(batch.encode()).hexdigest()}"

    def _publish(self, tables: dict[str, DataFrame], name: str) -> bool:
        """Write aside, then rename. False if that name is taken, by then or before."""
        if self._fs.exists(self._path(f"{self.path}/state/{name}")):
            return False
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        for table, rows in tables.items():
            rows.write.parquet(f"{aside}/{table}")
        try:
            self._context.rename(self._path(aside), self._path(f"{self.path}/state/{name}"), self._options)
        except Exception:
            if not self._fs.exists(self._path(f"{self.path}/state/{name}")):
                raise
            self._fs.delete(self._path(aside), True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes. False, and nothing done, if its id is there."""
        if self.has(batch):
            return False
        ids = self.spark.range(1).select(F.lit(batch).alias("id"))
        return self._publish({"sums": deltas(changes), "ids": ids}, self._name(batch))

    def fold(self) -> None:
        """Replace all parts by one. One process at a time; a fold that breaks off is repeated, and readers see either state."""
        names, live = self._names(), self._live()
        if not live:
            return
        folds = [n for n in names if n.startswith("fold-")]
        number = int(folds[-1].removeprefix("fold-")) + 1 if folds else 0
        ids = self._table(live, "ids", IDS).repartitionByRange("id").sortWithinPartitions("id")
        parts = self.spark.createDataFrame([(n,) for n in names], IDS)
        tables = {"sums": _summed(self._table(live, "sums", SUMS)), "ids": ids, "parts": parts}
        if self._publish(tables, f"fold-{number:012d}"):
            for n in names:
                self._fs.delete(self._path(f"{self.path}/state/{n}"), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, without keys that are back to nothing."""
        return _summed(self._table(self._live(), "sums", SUMS)).where("n_docs <> 0 or n_tokens <> 0")
