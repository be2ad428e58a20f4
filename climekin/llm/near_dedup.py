"""MinHash near-deduplication with SuperMinHash signatures.

1.  One pass over the texts makes each document's shingle set, a digest of
    the set, its SuperMinHash signature and the hashes of its bands.
    SuperMinHash draws for every element one permutation of the slots; the
    element offers rank + fraction to the slot of each rank.  Once every slot
    holds a value below the next rank no later rank can lower any, and the
    document is done, mostly after two or three ranks of all its elements.
2.  Documents of one set are a class, and the class's smallest id its node.
    Where classes share that id, all but one get a number that is no id.
3.  Nodes that share a band are candidates.  Buckets of equal members count
    once.  First every node meets the others of its largest bucket; then, in
    every bucket that still holds several components, the members outside
    the main one meet all members.  So each pair of a bucket is either
    compared or known to be connected.
4.  A task compares the full sets of its candidates exactly, all at once by
    a product of their incidence matrices, and keeps the links as a
    union-find forest.  Only the forest leaves the task: as many rows as
    there are members at most, however many pairs were compared.  Union-find
    over the written forests gives the components.

With 25 bands of 5 rows a pair at the threshold 0.85 shares no band with
probability 4e-7, and less above it.

Scale: a bucket beyond ``CELL_MEMBERS`` or ``CELL_SHINGLES`` is dealt over
several tasks, in which each of its blocks meets each other one; large buckets
of one component are worked as one.  No task holds more than two blocks.
What can't be avoided without losing links: members of a bucket that stay
unconnected are all compared, within tasks.

Defined cases: texts without words are linked with nothing; a text of fewer
words than a shingle has its whole sequence as the one shingle; null ids are
linked with nothing (their component is null, they are kept); rows that
repeat an id are documents each: those of one shingle set share a component,
others are linked by their own texts alone, and components of one smallest id
bear the same name; an empty table gives no rows; other columns pass through
``deduplicate``; a very long text is read and signed in parts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climekin.llm.components import relabel
from climekin.llm.scratch import Tables, batches_of, release_memory, small, stage, with_columns_free

BANDS, ROWS = 25, 5
SHINGLE = 5
#: Documents are signed together up to so many shingles.
BATCH_SHINGLES = 150_000
#: Rows that a worker gets at once; texts and sets of more would take a good part of an executor's memory.
BATCH_ROWS = 1000
#: Bytes of a text that are split into words together.
TEXT_BYTES = 4 << 20
#: Members, and shingles of all their sets, that one block of a bucket holds, about.
CELL_MEMBERS = 1024
CELL_SHINGLES = 1_000_000

_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], _U)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 300_000:
            self.clear()
        self[word] = h
        return h


_words = _Words()
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    bytes.lower() changes A-Z alone; bytes.split() parts at 0x20 and
    0x09-0x0D alone.
    """
    raw, parts, at = (text or "").encode(), [], 0
    while at < len(raw):
        end = min(len(raw), at + TEXT_BYTES)
        if end < len(raw):
            # A word that the part cuts stays whole.
            gap = _SPACE.search(raw, end)
            end = gap.start() if gap else len(raw)
        words = raw[at:end].lower().split()
        parts.append(np.fromiter(map(_words.__getitem__, words), _U, len(words)))
        at = end
    h = np.concatenate(parts) if parts else np.empty(0, _U)
    if not len(h):
        return h
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, _U)
    for i in range(k):
        out += h[i : i + n] * _FACTORS[i % len(_FACTORS)] * _U(2 * (i // len(_FACTORS)) + 1)
    return np.unique(mix64(out))


def superminhash(elements: np.ndarray, doc: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """(docs, slots) signatures; elements are distinct within a document, doc is each one's document."""
    h = np.full(docs * slots, np.iinfo(np.uint64).max, _U)
    for at in range(0, len(elements), BATCH_SHINGLES):
        # Later parts of a long document start from low values and end after a rank or two.
        own, of = elements[at : at + BATCH_SHINGLES], doc[at : at + BATCH_SHINGLES]
        perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(own), 1))
        rows = np.arange(len(own))
        for rank in range(slots):
            if not len(rows):
                break
            z = mix64(own[rows] + _U((rank * 0x9E3779B97F4A7C15) % (1 << 64)))
            pick = rank + ((z & _U(0xFFFFFFFF)) * _U(slots - rank) >> _U(32)).astype(np.int64)
            slot = perm[rows, pick]
            perm[rows, pick] = perm[rows, rank]
            np.minimum.at(h, of[rows] * slots + slot, (_U(rank) << _U(48)) | (z >> _U(16)))
            done = (h.reshape(docs, slots).max(axis=1) >> _U(48)) <= rank
            rows = rows[~done[of[rows]]]
    return h.reshape(docs, slots)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0x9FB21C651E98DF25), parts.shape[:2]).copy()
    for i in range(rows):
        out = mix64((out ^ parts[:, :, i]) * _FACTORS[i % len(_FACTORS)])
    return out.view(np.int64)


def _sign(bands: int, rows: int, size: int):
    import xxhash

    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def flush(keys, hashes, sets):
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        out: list = [None] * len(sets)
        if len(full):
            doc = np.repeat(np.arange(len(full)), n[full])
            signature = superminhash(np.concatenate([sets[i] for i in full]), doc, len(full), bands * rows)
            for i, x in zip(full, bands_of(signature, bands, rows).tolist()):
                out[i] = x
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(n), pa.array(digests, pa.binary()), pa.array(out, pa.list_(pa.int64()))], schema=schema)

    def sign(batches):
        with np.errstate(over="ignore"):
            keys, hashes, sets, total = [], [], [], 0
            for batch in batches:
                for k, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    s = shingles(t.as_py(), size)
                    keys.append(k)
                    hashes.append(h)
                    sets.append(s)
                    total += len(s)
                    if total >= BATCH_SHINGLES or len(keys) >= 2000:
                        yield flush(keys, hashes, sets)
                        keys, hashes, sets, total = [], [], [], 0
            if keys:
                yield flush(keys, hashes, sets)
        _words.clear()  # later stages of the worker need the memory
        release_memory()

    return sign


def _sets(size: int):
    def make(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in part.column(1)], pa.binary())], ["node", "members"])
        _words.clear()
        release_memory()

    return make


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) sizes of the intersections of sets, given by their places in ``sets``."""
    total = len(left) * len(right)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.concatenate(([0], np.cumsum(flat[1:] != flat[:-1], dtype=np.int32)), dtype=np.int32)
    side = np.full((2, len(sets)), -1, np.int32)
    side[0, left], side[1, right] = np.arange(len(left)), np.arange(len(right))
    l, r = side[0, owner], side[1, owner]
    kinds = int(number[-1]) + 1
    cl, cr = (np.bincount(number[x >= 0], minlength=kinds) for x in (l, r))
    # Only shingles that both sides have count.
    both = (cl > 0) & (cr > 0)
    if len(left) + len(right) > len(sets):
        both &= np.bincount(number, minlength=kinds) > 1
    common = int((cl * cr)[both].sum())
    place = np.cumsum(both, dtype=np.int32) - 1
    use_l, use_r = (l >= 0) & both[number], (r >= 0) & both[number]
    lv, lo, rv, ro = place[number[use_l]], l[use_l], place[number[use_r]], r[use_r]
    kinds = int(both.sum())
    if common <= 2_000_000 or common * 500 <= total * kinds:
        # Few meetings: each is counted.
        out = np.zeros(total, np.int64)
        counts = cr[both]
        first = np.cumsum(counts) - counts
        steps = np.concatenate(([0], np.cumsum(counts[lv])))
        at = 0
        while at < len(lv):
            end = max(at + 1, int(np.searchsorted(steps, steps[at] + 2_000_000, side="right")) - 1)
            n = counts[lv[at:end]]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            meet = ro[np.repeat(first[lv[at:end]], n) + inner]
            out += np.bincount(np.repeat(lo[at:end] * len(right), n) + meet, minlength=total)
            at = end
        return out.reshape(len(left), len(right))
    out = np.zeros((len(left), len(right)), np.int64)
    step = max(1, 4_000_000 // (len(left) + len(right)))
    for at in range(0, kinds, step):
        a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        i, j = (slice(*np.searchsorted(v, (at, at + step))) for v in (lv, rv))
        a[lo[i], lv[i] - at], b[ro[j], rv[j] - at] = 1, 1
        out += (a @ b.T).astype(np.int64)
    return out


def _forest(percent: int, roots: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links among the members of a cell, as pairs of roots that they connect; fewer pairs than members."""
    names, label = np.unique(roots, return_inverse=True)
    n = np.array([len(s) for s in sets], np.int64)
    out = []
    if len(names) < 2:
        return out
    common = overlaps(sets, left, right)
    linked = (common > 0) & (100 * common >= percent * (n[left][:, None] + n[right] - common))
    for i, row in zip(left.tolist(), linked):
        met = label[right[row]]
        if not len(met) or (met == label[i]).all():
            continue
        group = np.unique(np.append(met, label[i]))
        out += [(int(names[g]), int(names[group[0]])) for g in group[1:]]
        label[np.isin(label, group)] = group[0]
    return out


_CELL = "kind int, g long, i int, j int, left boolean, right boolean, node long, root long, members binary"


def _link(percent: int):
    """Whole cells, sorted -> the roots that links connect."""

    def work(rows):
        sets = [np.frombuffer(r[4], _U) for r in rows]
        flags = np.array([r[:2] for r in rows], bool)
        return _forest(percent, np.array([r[3] for r in rows], np.int64), sets, np.flatnonzero(flags[:, 0]), np.flatnonzero(flags[:, 1]))

    def link(batches):
        cell, rows = None, []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(4)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            found = []
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if cell != tuple(keys[:, a]):
                    found += work(rows) if rows else []
                    cell, rows = tuple(keys[:, a]), []
                rows += zip(*[batch.column(c).slice(a, b - a).to_pylist() for c in range(4, 9)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
        if rows and (found := work(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
        rows = []
        release_memory()

    return link


def _blocks(members: str, shingles: str):
    """Number of blocks that so many members with so many shingles take."""
    return F.greatest(F.ceil(F.col(members) / CELL_MEMBERS), F.ceil(F.col(shingles) / CELL_SHINGLES)).cast("int")


def _dealt(node: str, seed: int, blocks):
    return F.pmod(F.xxhash64(node, F.lit(seed)), blocks).cast("int")


def _range(blocks):
    return F.sequence(F.lit(0), blocks - 1)


def _text_hash(text: str):
    """Tells texts of one id apart."""
    return F.xxhash64(text)


def _apart(spark: SparkSession, same: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame | None]:
    """Classes (n, digest, least id and text hash) with a node each, and (node, name) of all if a name is borne twice."""
    same = tables.stage(same.select("n", "digest", "least.k", "least.h"), "near-classes")
    twice = tables.stage(same.groupBy("k").agg(F.min(F.struct("n", "digest")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("k").alias("tk"), "first"), "near-twice")
    if twice.isEmpty():
        return same.withColumn("node", F.col("k")), None
    more = same.join(twice, F.col("k") == F.col("tk")).where(F.struct("n", "digest") != F.col("first")).select("n", "digest", F.monotonically_increasing_id().alias("number"))
    more = tables.stage(more, "near-more")
    low, high = same.agg(F.min("k"), F.max("k")).first()
    most = more.agg(F.max("number")).first()[0]
    if high < (1 << 63) - 1 - most:
        number = F.col("number") + F.lit(high + 1)
    elif low > most - (1 << 63) + 1:
        number = F.lit(low - 1) - F.col("number")
    else:
        raise ValueError("the ids leave no numbers free for texts that share an id")
    noded = tables.stage(same.join(more, ["n", "digest"], "left").select("n", "digest", "k", "h", F.coalesce(number, "k").alias("node")), "near-apart")
    return noded, noded.select("node", F.col("k").alias("name"))


def _own_cells(members: DataFrame, buckets: DataFrame, tables: Tables) -> DataFrame:
    """Cells in which every node meets the others of its largest bucket."""
    own = members.join(small(buckets), F.col("b") == F.col("sb")).groupBy("node").agg(F.max(F.struct("size", "b")).alias("m"), F.first("n").alias("n"))
    own = tables.stage(own.select("node", "n", F.col("m.b").alias("g")), "near-own")
    groups = own.groupBy(F.col("g").alias("og")).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("node").alias("first")).where("size > 1")
    groups = tables.stage(groups.select("og", "first", _blocks("size", "shingles").alias("blocks")), "near-groups")
    # The first member of a large group is in all its blocks.
    block = F.when((F.col("node") == F.col("first")) & (F.col("blocks") > 1), _range(F.col("blocks"))).otherwise(F.array(_dealt("node", 9, F.col("blocks"))))
    return own.join(small(groups), F.col("g") == F.col("og")).select(F.lit(0).alias("kind"), "g", F.lit(0).alias("i"), F.explode(block).alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right"), "node", F.col("node").alias("root"))


def _other_cells(members: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """Cells in which the members outside a bucket's main component meet all its members."""
    placed = members.join(small(labels.select(F.col("node").alias("ln"), "root")), F.col("node") == F.col("ln"), "left")
    placed = tables.stage(placed.select("b", "node", "n", F.coalesce("root", "node").alias("root")), "near-placed")
    by_root = placed.groupBy("b", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    mixed = by_root.groupBy(F.col("b").alias("mb")).agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("size"), F.sum("w").alias("shingles")).where("roots > 1")
    mixed = tables.stage(mixed.select("mb", F.col("m.root").alias("main"), (_blocks("size", "shingles") > 1).alias("large")), "near-mixed")
    # Large buckets of one main component are one.
    g = F.when(F.col("large"), F.col("main")).otherwise(F.col("b"))
    all_ = placed.join(small(mixed), F.col("b") == F.col("mb")).select(F.col("large").cast("int").alias("kind"), g.alias("g"), "node", "n", "root", (F.col("root") != F.col("main")).alias("left"))
    cells = all_.where("kind = 0").select("kind", "g", F.lit(0).alias("i"), F.lit(0).alias("j"), "left", F.lit(True).alias("right"), "node", "root")
    if mixed.where("large").isEmpty():
        return cells
    large = tables.stage(all_.where("kind = 1").distinct(), "near-large")
    asks = F.col("left").cast("int")
    sizes = large.groupBy(F.col("g").alias("lg")).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.sum(asks).alias("asks"), F.sum(asks * F.col("n")).alias("asked"))
    sizes = tables.stage(sizes.select("lg", _blocks("size", "shingles").alias("blocks"), _blocks("asks", "asked").alias("ask_blocks")), "near-sizes")
    large = large.join(small(sizes), F.col("g") == F.col("lg"))
    asking = large.where("left").select("kind", "g", _dealt("node", 5, F.col("ask_blocks")).alias("i"), F.explode(_range(F.col("blocks"))).alias("j"), "left", F.lit(False).alias("right"), "node", "root")
    asked = large.select("kind", "g", F.explode(_range(F.col("ask_blocks"))).alias("i"), _dealt("node", 9, F.col("blocks")).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"), "node", "root")
    return cells.unionByName(asking).unionByName(asked)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """k, h (of the text), n (shingles), node, component of every row; links are sets with 100 * common >= percent * union."""
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _classes(docs, key, text, percent, size, bands, rows)


def _classes(docs: DataFrame, key: str, text: str, percent: int, size: int, bands: int, rows: int) -> DataFrame:
    spark = docs.sparkSession
    tables = Tables(spark)
    texts = docs.select(F.col(key).cast("long").alias("k"), _text_hash(text).alias("h"), F.col(text).alias("t"))
    signed = tables.stage(texts.mapInArrow(_sign(bands, rows, size), "k long, h long, n long, digest binary, bands array<long>"), "near-signed")
    same, names = _apart(spark, signed.where("n > 0 and k is not null").groupBy("n", "digest").agg(F.min(F.struct("k", "h")).alias("least")), tables)
    same = same.select("n", "digest", F.col("k").alias("lk"), F.col("h").alias("lh"), "node")
    least = (F.col("k") == F.col("lk")) & (F.col("h") == F.col("lh"))
    noded = tables.stage(signed.join(small(same), ["n", "digest"], "left").select("k", "h", "n", F.when(F.col("k").isNotNull(), F.col("node")).alias("node"), F.when(least, F.col("bands")).alias("bands")), "near-noded")

    # Buckets of two nodes or more, with their members; of buckets with equal members one.
    member = noded.where("bands is not null").select("node", "n", F.explode("bands").alias("b"))
    shared = member.groupBy("b").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(F.col("b").alias("sb"))
    shared = tables.stage(shared, "near-shared")
    member = tables.stage(member.join(small(shared), F.col("b") == F.col("sb")).select("b", "node", "n").distinct(), "near-members")
    sizes = member.groupBy("b").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = tables.stage(sizes.groupBy("size", "lo", "hi", "x", "y").agg(F.min("b").alias("sb")).select("sb", "size"), "near-buckets")
    member = tables.stage(member.join(small(buckets), F.col("b") == F.col("sb"), "left_semi"), "near-members")

    # Full sets of the nodes that have candidates.
    owners = noded.where("bands is not null").select("node", F.col("k").alias("wk"), F.col("h").alias("wh"))
    nodes = tables.stage(owners.join(small(tables.stage(member.select(F.col("node").alias("want")).distinct(), "near-wanted")), F.col("node") == F.col("want")).select("want", "wk", "wh").distinct(), "near-nodes")
    wanted = texts.join(small(nodes), (F.col("k") == F.col("wk")) & (F.col("h") == F.col("wh"))).select("want", "t")
    sets = tables.stage(wanted.mapInArrow(_sets(size), "node long, members binary"), "near-sets")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = ["kind", "g", "i", "j"]

    def links(cells: DataFrame) -> DataFrame:
        full = cells.join(sets, "node").select([c.split()[0] for c in _CELL.split(", ")])
        dealt = full.repartition(tasks, *cell).sortWithinPartitions(*cell, "node")
        return tables.stage(dealt.mapInArrow(_link(percent), "u long, v long"), "near-links")

    # Rows of Python, even none, would start workers that stay beside those of the other steps.
    labels = tables.stage(spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root")), "labels")
    labels = relabel(labels, links(_own_cells(member, buckets, tables)), tables)
    labels = relabel(labels, links(_other_cells(member, labels, tables)), tables)

    l = labels.select(F.col("node").alias("ln"), "root")
    if names is not None:
        # A root may be a number of ours or not the least id.
        rooted = names.join(l, F.col("node") == F.col("ln"), "left").select(F.col("node").alias("ln"), F.coalesce("root", "node").alias("r"), "name")
        named = rooted.groupBy(F.col("r").alias("lr")).agg(F.min("name").alias("root"))
        l = tables.stage(rooted.join(named, F.col("r") == F.col("lr")).select("ln", "root"), "near-named")
    out = noded.join(small(l), F.col("node") == F.col("ln"), "left").select("k", "h", "n", "node", F.coalesce("root", "node", "k").alias("component"))
    return tables.result(out, "near-result")


def near_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_shingles, component_id, kept of every row."""
    found = classes(docs, key, text, **options)
    return found.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("k").eqNullSafe(F.col("component")).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose id is the smallest of their component, with the columns of ``docs``."""
    tables = Tables(docs.sparkSession)
    n = with_columns_free(["drop", "hash"], docs.columns)
    found = classes(docs, key, text, **options).select(F.col("k").alias(n["drop"]), F.col("h").alias(n["hash"]), F.coalesce(F.col("k") == F.col("component"), F.lit(True)).alias("stays"))
    ids = tables.stage(found.where(F.col(n["drop"]).isNotNull()).groupBy(n["drop"]).agg(F.bool_or("stays").alias("some"), F.bool_and("stays").alias("all")).where(~F.col("all")), "near-ids")
    dropped = stage(ids.where(~F.col("some")).select(n["drop"]), "near-dropped")
    out = docs.join(small(dropped), F.col(key) == F.col(n["drop"]), "left_anti")
    partly = ids.where("some").select(n["drop"])
    if not partly.isEmpty():
        partly = stage(found.where(~F.col("stays")).join(partly, n["drop"], "left_semi").select(n["drop"], n["hash"]).distinct(), "near-partly")
        out = out.join(small(partly), (F.col(key) == F.col(n["drop"])) & (_text_hash(text) == F.col(n["hash"])), "left_anti")
    tables.drop()
    return out


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
