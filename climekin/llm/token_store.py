"""Token-ID output with keyed access by minimal perfect hashing.

A store is a Parquet dataset of *blocks*.  Documents lie in ascending key
order; a block holds the raw ids of some hundred documents back to back
(16 bits an id if the vocabulary allows, else 32), the token offset of every
document, and a minimal perfect hash over its distinct keys.  A slot of that
hash keeps a 32-bit fingerprint of its key and the number of the key's first
document, so that a keyed read costs two array reads and one comparison, and
an absent key is told apart with an error of 2**-32 before the stored key
itself is compared.

Defined cases: a null text counts as empty and holds the end id alone; null
keys come first, are stored and scanned, but can't be looked up; rows that
repeat a key lie next to each other, ordered by a hash of the text, and a
lookup returns all of them; an empty table gives an empty store; other columns are ignored.

Scale: one range shuffle of (key, text); all later passes read the store.
Rows of one key, null included, are ranged by their text and place as well, so
that a hot key spreads.  Starts come from a prefix sum over one row for each
partition.  A lookup groups its keys by block and reads each block once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from climekin.llm.encoding import encoder
from climekin.llm.scratch import Tables, new_path, small

#: A block is closed at so many ids.
BLOCK_IDS = 1 << 20
#: Blocks that a lookup names to its scan, at most.
FEW_BLOCKS = 1000

BLOCK_SCHEMA = (
    "part int, seq int, part_start long, n_docs int, n_null int, n_ids long, width int, min_key long, max_key long, "
    "seeds binary, fingerprints binary, entries binary, offsets binary, keys binary, payload binary"
)


def _mix(x: np.ndarray, seed) -> np.ndarray:
    """64-bit finaliser (splitmix64) of keys under a seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + (np.asarray(seed, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_FINGER, _BUCKET = 1 << 40, 1 << 41


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slots) of a minimal perfect hash over distinct int64 keys.

    Keys fall into about n/3 buckets.  From the fullest bucket on, the
    smallest seed is taken that sends its keys to free slots; buckets of one
    key name a free slot directly, as -slot - 1.
    """
    n = len(keys)
    r = max(1, n // 3)
    u = keys.view(np.uint64)
    bucket = (_mix(u, _BUCKET) % np.uint64(r)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=r)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    seeds, slots, free = np.zeros(r, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-counts, kind="stable"):
        c = counts[b]
        if c < 2:
            break
        own, at = order[firsts[b] : firsts[b + 1]], 0
        while True:
            tried = (_mix(u[own][None, :], np.arange(at, at + 32, dtype=np.uint64)[:, None]) % np.uint64(n)).astype(np.int64)
            ordered = np.sort(tried, axis=1)
            good = free[tried].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slots[own] = at + k, tried[k]
                free[tried[k]] = False
                break
            at += 32
    left = np.flatnonzero(free)
    single = np.flatnonzero(counts == 1)
    slots[order[firsts[single]]] = left[: len(single)]
    seeds[single] = -left[: len(single)] - 1
    return seeds, slots


def mph_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key; any slot for a key that is not in the set."""
    u = keys.view(np.uint64)
    s = seeds[(_mix(u, _BUCKET) % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    hashed = (_mix(u, np.maximum(s, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(s < 0, np.minimum(-s - 1, n - 1), hashed)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.view(np.uint64), _FINGER) >> np.uint64(32)).astype("<u4")


def _block(part: int, seq: int, start: int, width: int, rows: list[tuple[int | None, bytes]]) -> dict:
    keys = np.array([k for k, _ in rows if k is not None], np.int64)
    nulls = len(rows) - len(keys)
    lengths = np.array([len(i) // 4 for _, i in rows], np.int64)
    firsts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    distinct = keys[firsts]
    prints, entries = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    seeds = np.zeros(1, np.int32)
    if len(distinct):
        seeds, slots = build_mph(distinct)
        prints[slots], entries[slots] = fingerprints(distinct), firsts + nulls
    ids = np.frombuffer(b"".join(i for _, i in rows), "<u4")
    return {
        "part": part, "seq": seq, "part_start": start, "n_docs": len(rows), "n_null": nulls, "n_ids": len(ids), "width": width,
        "min_key": int(keys[0]) if len(keys) else None, "max_key": int(keys[-1]) if len(keys) else None,
        "seeds": seeds.astype("<i4").tobytes(), "fingerprints": prints.tobytes(), "entries": entries.tobytes(),
        "offsets": np.concatenate(([0], np.cumsum(lengths))).astype("<i8").tobytes(), "keys": keys.astype("<i8").tobytes(),
        "payload": ids.astype("<u2" if width == 2 else "<u4").tobytes(),
    }


def write_store(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encode every text and write a store of the ids, each followed by ``end_id``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("k").asc_nulls_first(), "h", "place"]
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("k", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("k", "t")
    schema = spark.createDataFrame([], BLOCK_SCHEMA).schema
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        coder = encoder(tokenizer)
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        part, seq, start, held, rows = TaskContext.get().partitionId(), 0, 0, 0, []
        arrow = None

        def flush():
            nonlocal seq, start, held, rows
            block = _block(part, seq, start, width, rows)
            seq, start, held, rows = seq + 1, start + held, 0, []
            return pa.RecordBatch.from_pylist([block], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.encode(t.as_py()) + end
                rows.append((k, ids))
                held += len(ids) // 4
                if held >= BLOCK_IDS:
                    yield flush()
        if rows:
            yield flush()

    # Small row groups: a lookup skips those that it doesn't want.
    ordered.mapInArrow(write, schema).write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with the number of ids before each."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row for each partition of the writer, which bounds this side.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return blocks.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start"))


def _open(row: dict) -> tuple:
    keys, offsets = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["offsets"], "<i8")
    ids = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
    return keys, offsets, ids, [np.frombuffer(row[c], d) for c, d in (("seeds", "<i4"), ("fingerprints", "<u4"), ("entries", "<u4"))]


def _find(wanted: np.ndarray, index: list) -> tuple[np.ndarray, np.ndarray]:
    """(entry, whether the stored fingerprint is the key's) of each wanted key."""
    seeds, prints, entries = index
    if not len(prints):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    slot = mph_slots(wanted, seeds, len(prints))
    return entries[slot].astype(np.int64), prints[slot] == fingerprints(wanted)


def read_store(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Every document of a store: doc_id, start, n_tokens, ids_crc32 [, ids].

    Each key goes through its block's hash, so a damaged index is an error.
    """
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, offsets, tokens, index = _open(row)
                entry, same = _find(keys, index)
                if not same.all():
                    raise ValueError("a fingerprint differs: the store is damaged")
                # Repeats of a key follow its first document.
                entry += np.arange(len(keys)) - np.searchsorted(keys, keys)
                entry = np.concatenate((np.arange(row["n_null"]), entry))
                got = {"doc_id": [None] * row["n_null"] + keys.tolist(), "start": (row["start"] + offsets[entry]).tolist(), "n_tokens": (offsets[entry + 1] - offsets[entry]).tolist()}
                cut = [tokens[offsets[e] : offsets[e + 1]] for e in entry]
                got["ids_crc32"] = [zlib.crc32(x.astype("<u4").tobytes()) for x in cut]
                arrays = [pa.array(got[c], pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
                names = list(got)
                if ids:
                    arrays, names = [*arrays, pa.array([x.tolist() for x in cut], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    need = ["start", "n_null", "width", "seeds", "fingerprints", "entries", "offsets", "keys", "payload"]
    return _blocks(spark, path).select(*need).mapInArrow(read, out)


def _place(parts: list[tuple[int, int, int]]):
    """Keys -> (key, part) for the parts whose range holds them; ranges ascend and may meet."""
    number, low, high = (np.array(x, np.int64) for x in zip(*parts))

    def place(batches):
        for batch in batches:
            k = np.asarray(batch.column(0))
            first, n = np.searchsorted(high, k, "left"), np.searchsorted(low, k, "right")
            n = np.maximum(n - first, 0)
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, n)), pa.array(number[at].astype(np.int32))], ["k", "part"])

    return place


def lookup(wanted: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Ids of the wanted keys: doc_id, start, n_tokens, ids; absent keys give no row.

    A key meets the blocks whose key range holds it: first by the ranges of
    the writer's partitions (one row each, on the driver), then by those of
    their blocks.  Keys are grouped by block, which is then read once; up to
    ``FEW_BLOCKS`` blocks are named to the scan, so that it skips the others.
    """
    spark = wanted.sparkSession
    tables = Tables(spark)
    blocks = _blocks(spark, path)
    parts = blocks.groupBy("part").agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi")).where("lo is not null").orderBy("part").collect()
    out = "doc_id long, start long, n_tokens long, ids array<int>"
    if not parts:
        return spark.createDataFrame([], out)
    keys = wanted.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    placed = keys.mapInArrow(_place([tuple(p) for p in parts]), "k long, part int")
    ranges = blocks.select("part", "seq", "min_key", "max_key")
    hits = placed.join(ranges, "part").where("k between min_key and max_key").groupBy(F.col("part").alias("p"), F.col("seq").alias("s")).agg(F.sort_array(F.collect_list("k")).alias("wanted"))
    hits = tables.stage(hits, "lookup-hits")
    if hits.count() <= FEW_BLOCKS:
        named = hits.select("p", "s").collect()
        blocks = blocks.where(F.col("part").isin(sorted({r["p"] for r in named})) & F.col("seq").isin(sorted({r["s"] for r in named})))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, offsets, tokens, index = _open(row)
                asked = np.array(row["wanted"], np.int64)
                entry, same = _find(asked, index)
                rows = []
                for k, e, good in zip(asked.tolist(), (entry - row["n_null"]).tolist(), same.tolist()):
                    while good and 0 <= e < len(keys) and keys[e] == k:
                        a, b = offsets[e + row["n_null"]], offsets[e + row["n_null"] + 1]
                        rows.append({"doc_id": k, "start": int(row["start"] + a), "n_tokens": int(b - a), "ids": tokens[a:b].tolist()})
                        e += 1
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    need = ["wanted", "start", "n_null", "width", "seeds", "fingerprints", "entries", "offsets", "keys", "payload"]
    found = blocks.join(small(hits), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select(*need).mapInArrow(read, out)
    return tables.result(found, "lookup")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, path, ids=False)
