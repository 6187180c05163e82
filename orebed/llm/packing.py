"""Conflict-constrained best-fit packing of documents into sequences.

Documents are dealt to shards of about SHARD_PIECES pieces and packed there, longest first. Open bins are ordered by residual
capacity, and each carries bitmaps: the duplicate clusters that it holds, and for each count up to source_quota the sources of
which it holds so many documents. A piece goes to the bin with the least residual that fits it and has neither its cluster nor
a full quota of its source; the search moves to the next larger residual until it finds one, else a bin is opened. A document
longer than the capacity fills whole bins first; nothing is cut off.

Rows: a null length or 0 gives one piece of length 0 (it takes a place and no room). A null cluster conflicts with nothing; a
null source counts as one source. Equal rows each give their pieces. An empty table gives none.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.llm.frames import pick

CAPACITY, SOURCE_QUOTA, SHARD_PIECES = 2048, 8, 2048


class Bins:
    """Bins of one shard by residual. `open` has a bit for each residual of which there is a bin."""

    def __init__(self, capacity: int, source_quota: int) -> None:
        self.capacity, self.quota = capacity, source_quota
        self.count, self.open = 0, 0
        #: residual -> (cluster bitmap, source bitmaps) -> bins; equal bins are asked once.
        self.at: dict[int, dict[tuple[int, tuple[int, ...]], list[int]]] = defaultdict(dict)

    def place(self, length: int, cluster: int, source: int) -> int:
        """The bin of a piece. cluster and source: their bits, 0 for a cluster that conflicts with nothing."""
        residual = length
        while rest := self.open >> residual:
            residual += (rest & -rest).bit_length() - 1  # the successor: least residual that isn't smaller
            for state, bins in self.at[residual].items():
                if not (state[0] & cluster or state[1][-1] & source):
                    number = bins.pop()
                    if not bins:
                        del self.at[residual][state]
                        if not self.at[residual]:
                            self.open ^= 1 << residual
                    self._put(number, residual - length, state, cluster, source)
                    return number
            residual += 1
        number, self.count = self.count, self.count + 1
        self._put(number, self.capacity - length, (0, (0,) * self.quota), cluster, source)
        return number

    def _put(self, number: int, residual: int, state: tuple[int, tuple[int, ...]], cluster: int, source: int) -> None:
        held, levels = state[0] | cluster, list(state[1])
        for i in range(self.quota):
            if not levels[i] & source:
                levels[i] |= source
                break
        self.at[residual].setdefault((held, tuple(levels)), []).append(number)
        self.open |= 1 << residual


def copies(text: Column) -> Column:
    """The duplicate cluster of a text among exact copies: null, so without conflict, if it is null."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def pack_shard(lengths: list[int], clusters: list, sources: list, capacity: int, source_quota: int) -> list[tuple[int, int]]:
    """(bin, place in the bin) of each piece, packed in the order given."""
    bins, used = Bins(capacity, source_quota), defaultdict(int)
    often = Counter(c for c in clusters if c is not None)
    bit: dict[object, int] = {}
    out = []
    for length, cluster, source in zip(lengths, clusters, sources):
        # a cluster that occurs once here conflicts with nothing
        c = 1 << bit.setdefault((cluster,), len(bit)) if often[cluster] > 1 else 0
        number = bins.place(length, c, 1 << bit.setdefault(source, len(bit)))
        out.append((number, used[number]))
        used[number] += 1
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, source_quota: int = SOURCE_QUOTA, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, piece_start, length, source, cluster, shard, bin, place: a row for each piece. docs: doc_id, source, cluster, length.

    A bin is named by shard and bin. Rows are dealt by their place in the input, so that no key can crowd a shard; the same
    files give the same bins.
    """
    shards = max(1, -(-docs.count() // shard_pieces))
    rows = pick(docs, "doc_id", "source", "cluster", "length").select("doc_id", "source", "cluster", F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).cast("long").alias("whole"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    starts = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = dealt.select("*", F.posexplode(starts).alias("piece", "piece_start")).withColumn("length", F.least(F.col("whole") - F.col("piece_start"), F.lit(capacity).cast("long")))
    kinds = dict(docs.dtypes)
    columns = ["doc_id", "piece", "piece_start", "length", "source", "cluster", "shard"]
    schema = f"doc_id {kinds['doc_id']}, piece int, piece_start long, length long, source {kinds['source']}, cluster {kinds['cluster']}, shard long, bin long, place long"

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        placed = pack_shard(*(shard[c].to_pylist() for c in ("length", "cluster", "source")), capacity, source_quota)
        for name, values in zip(("bin", "place"), zip(*placed)):
            shard = shard.append_column(name, pa.array(values, pa.int64()))
        return shard

    return pieces.select(*columns).groupBy("shard").applyInArrow(run, schema)
