"""Bounded-space online best-fit packing of token sequences.

Every task packs the pieces of its own documents as they come.  At most
``open_bins`` bins are open; a bitset has bit f set if an open bin has f free
places, so the tightest bin that still takes a piece is its lowest set bit
from the piece's length on.  If a piece fits nowhere and all bins are open,
the fullest closes.  Pieces of full length are sequences of their own.

Bins that are still open at the end of a task are few and partly empty.  A
second round takes their pieces apart again and packs those of many tasks
together, longest first, in tasks of about ``ROUND_PIECES`` pieces.  No task
ever holds more than its own pieces (numbers, not ids) and the open bins.

Defined cases: null text counts as empty and holds the end id alone; only
documents longer than the capacity are cut, the last piece may be shorter;
rows that repeat a key are packed each; null keys are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climekin.llm.encoding import encoder
from climekin.llm.scratch import Tables

CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces that one task of the second round takes, about.
ROUND_PIECES = 400_000
#: A bin whose free part is at most one in so many stays as it is.
FULL = 200

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, is_open boolean"


class BestFit:
    """Online best fit with a bounded number of open bins."""

    def __init__(self, capacity: int, open_bins: int, first_id: int):
        self.capacity, self.limit, self.next_id = capacity, open_bins, first_id
        self.bits, self.count = 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        got = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return got

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item."""
        room = self.bits >> length
        if room:
            free = (room & -room).bit_length() - 1 + length
            where = self._take(free)
        else:
            free, where = self.capacity, self.next_id
            self.next_id += 1
        left = free - length
        if left > 0:
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free.setdefault(left, []).append(where)
            self.bits |= 1 << left
            self.count += 1
        return where, self.capacity - free

    def open(self, least: int = 1) -> set[int]:
        """Open bins with so many free places or more."""
        return {b for free, stack in self.by_free.items() if free >= least for b in stack}


def _first_round(tokenizer: str, end_id: int, capacity: int, open_bins: int):
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches):
        encode = encoder(tokenizer).encode
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 36)
        rows = []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(t.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    where, offset = bins.put(len(cut) // 4)
                    rows.append((k, piece, at // 4, len(cut) // 4, zlib.crc32(cut), where, offset))
        still = bins.open(capacity // FULL + 1)
        for i in range(0, len(rows), 20_000):
            cols = [*zip(*rows[i : i + 20_000])]
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), *[pa.int64()] * 5])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([w in still for w in cols[5]], pa.bool_())], _names(PIECES))

    return pack


def _second_round(capacity: int, open_bins: int):
    def pack(batches):
        bins = BestFit(capacity, open_bins, (1 << 62) + (TaskContext.get().partitionId() << 36))
        for batch in batches:
            put = [bins.put(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([p[i] for p in put], pa.int64()) for i in (0, 1))], _names(PIECES)[:7])

    return pack


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    tables = Tables(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    first = tables.stage(texts.mapInArrow(_first_round(tokenizer, end_id, capacity, open_bins), PIECES), "pack-first")
    left = first.where("is_open").drop("is_open")
    tasks = max(1, -(-left.count() // ROUND_PIECES))
    # The shortest come last, which fill what the others leave.
    dealt = left.repartition(tasks, "sequence_id").sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
    again = dealt.mapInArrow(_second_round(capacity, open_bins), PIECES.removesuffix(", is_open boolean"))
    return tables.result(first.where("not is_open").drop("is_open").unionByName(again), "packed").withColumnRenamed("doc_id", key)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
