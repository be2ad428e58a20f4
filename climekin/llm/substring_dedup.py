"""Removal of long repeated byte strings, by suffix arrays of shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id.

Suffix arrays need all occurrences of a string in one shard.  Every window
of LENGTH bytes is therefore named by its anchor: the 16-byte gram in it with
the smallest hash (the leftmost of equals).  Equal windows have equal
anchors; neighbouring windows mostly share one, so that the windows of one
anchor form a segment of at most 84 bytes.

1.  A window has HALF bytes before its anchor or more than HALF behind it, so
    that a segment's windows hold its left half or its right half: the anchor
    and those 33 or 34 bytes in all.  Halves are counted: each batch of
    documents sends the 32-bit prints of its halves, once for each document,
    to the print's shard.  Halves of one document only can't matter; prints
    of the others go back to the documents' blocks.  (A clash of prints only
    lets more pass.)  Anchors alone would pass ever more of a growing table,
    since unrelated texts come to share 16 bytes.
2.  Segments' windows of shared halves go to the anchor's shard, a row for each
    block and group of the shard.  Equal segments of a block are one entry, that of
    their smallest document: the others are repeats of it, whatever else the
    array holds, so that a hot passage sends one segment for each block and
    not its places.
3.  A shard takes the distinct segments of a group, each with its smallest
    document, builds the suffix array by induced sorting and the permuted
    common prefixes, and finds the runs of suffixes that share LENGTH bytes.
    The smallest document of a run decides for each window in it: it is a
    repeat in every larger document.
4.  Repeated windows are merged to spans for each document and cut.

Scale: the number of shards follows the bytes of the texts, up to the shuffle
partitions of the session; a shard is worked in groups of about
``GROUP_BYTES`` of text, so that memory stays bounded where partitions are large.
A document is named by its id and a hash of id and text together.

Defined cases: null text is empty; texts shorter than LENGTH keep all;
documents with a null id neither lose bytes nor count as originals; rows
that repeat an id don't affect each other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climekin.llm.scratch import Tables, small
from climekin.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 50
GRAM = 16
#: Bytes beside its anchor that a window has on one side at least.
HALF = (LENGTH - GRAM) // 2
#: Bytes that are worked on together.
BATCH_BYTES = 4 << 20
#: Bytes of texts for each shard, at least, and for each group of a shard, about.
SHARD_BYTES = 4 << 20
GROUP_BYTES = 8 << 20
#: Arrays of a group: segments of one anchor go to one, and smaller arrays keep to the processor's cache.
ARRAYS = 8
#: Segments that one block holds before it sends them on.
HELD_SEGMENTS = 400_000
#: Repeated spans that a task holds before it sends them on.
HELD_SPANS = 1_000_000
#: 64-bit words that a segment takes, the last one padded; it has 2 * LENGTH - GRAM bytes at most.
WORDS = 11
SEPARATOR = 0xFF  # in no UTF-8 text

_U = np.uint64
_POS = _U((1 << 24) - 1)
_LOW = _U((1 << 22) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of the texts that lie at [starts, ends) of ``data``, which is below 16 MB.

    Gives for each: first window, end of the last window, text number, anchor hash.
    """
    return _anchored(data, starts, ends, length, gram)[:4]


def _anchored(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """What ``anchors`` gives, and the anchors' places."""
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, _U, np.int64))
    padded = data + bytes(16)
    low = np.ndarray((n - gram + 1,), np.dtype("<u8"), padded, strides=(1,))
    high = np.ndarray((n - gram + 1,), np.dtype("<u8"), padded, 8, strides=(1,))
    h = _mix(low * _U(0x9E3779B97F4A7C15) + (high ^ (high >> _U(29))) * _U(0xD6E8FEB86659FD93))
    v = (h & ~_POS) | np.arange(len(h), dtype=_U)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    if have < width:
        v = np.minimum(v[: len(v) - (width - have)], v[width - have :])
    at = v & _POS  # one for each window start
    valid = np.zeros(n + 1, np.int8)
    good = ends - starts >= length
    np.add.at(valid, starts[good], 1)
    np.add.at(valid, ends[good] - length + 1, -1)
    inside = np.cumsum(valid, dtype=np.int8)[: len(at)] > 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    new &= inside
    # Windows of neighbouring texts never share a run, as texts are apart.
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.concatenate((new[1:] | ~inside[1:], [True])))
    text = np.searchsorted(starts, first, side="right") - 1
    at = at[first].astype(np.int64)
    return first, stop + length, text, _mix(h[at] + _U(1)), at


def _halves(data: bytes, first: np.ndarray, stop: np.ndarray, f: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(segments, hashes) of the windows with HALF bytes before the anchor, which all hold these, and of the others, which hold more than HALF behind it."""
    view = np.ndarray((len(data),), np.dtype("<u8"), data + bytes(8), strides=(1,))
    rest = LENGTH - GRAM - HALF + 1
    out = []
    for own, reads in ((first <= at - HALF, (-HALF, 8 - HALF, -8)), (stop - LENGTH > at - HALF, (GRAM, GRAM + 8, GRAM + rest - 8))):
        own = np.flatnonzero(own)
        h, a = f[own] + _U(len(out)), at[own]
        for x in reads:
            h = _mix((h ^ view[a + x]) * _U(0x9E3779B97F4A7C15))
        out.append((own, h))
    return out


def _gather(batches, columns):
    """Batches of (key.., text bytes) -> (rows, joined data, starts, ends, bases); long texts come in parts."""
    rows, parts, starts, ends, bases, total = [], [], [], [], [], 0
    for batch in batches:
        cols = [batch.column(c) for c in columns]
        for values in zip(*cols):
            *keys, text = [x.as_py() for x in values]
            for base in range(0, max(1, len(text) - LENGTH + 1), BATCH_BYTES):
                part = text[base : base + BATCH_BYTES + LENGTH - 1]
                if total and total + len(part) > BATCH_BYTES:
                    yield rows, b"\xff".join(parts), np.array(starts), np.array(ends), bases
                    rows, parts, starts, ends, bases, total = [], [], [], [], [], 0
                starts.append(total)
                ends.append(total + len(part))
                total += len(part) + 1
                rows.append(keys)
                parts.append(part)
                bases.append(base)
    if parts:
        yield rows, b"\xff".join(parts), np.array(starts), np.array(ends), bases


_COUNTS = pa.schema([("shard", pa.int32()), ("prints", pa.binary()), ("blocks", pa.binary())])


def _count(shards: int):
    def count(batches):
        with np.errstate(over="ignore"):
            for rows, data, starts, ends, _ in _gather(batches, (0, 1, 2)):
                first, stop, text, f, at = _anchored(data, starts, ends)
                halves = _halves(data, first, stop, f, at)
                text, f = np.concatenate([text[own] for own, _ in halves]), np.concatenate([h for _, h in halves])
                # Parts of one text may lie in two batches: their halves then count twice.
                doc = np.array([r[1] for r in rows], np.int64)[text]
                key, text = _distinct(_prints(f, shards), doc, text)
                block = np.array([r[0] for r in rows], np.uint32)[text]
                shard, f = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype("<u4")
                cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
                bounds = [*cuts, len(shard)]
                out = {"shard": [], "prints": [], "blocks": []}
                for a, b in zip(bounds, bounds[1:]):
                    by = np.argsort(block[a:b], kind="stable")
                    out["shard"].append(int(shard[a]))
                    out["prints"].append(f[a:b][by].tobytes())
                    out["blocks"].append(block[a:b][by].astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=_COUNTS)

    return count


def _prints(h: np.ndarray, shards: int) -> np.ndarray:
    """Hashes' shards, and their 32-bit prints below them."""
    return ((h % _U(shards)) << _U(32)) | (h >> _U(32))


def _distinct(key: np.ndarray, doc: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order with their texts; a key that one document alone has is left once, one of several documents at least twice."""
    order = np.argsort(key)
    key, doc, text = key[order], doc[order], text[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[keep], text[keep]


def _runs_of(batches, columns: int):
    """Consecutive rows with one value in column 0 -> (value, rows)."""
    value, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in range(columns)]):
            if held and row[0] != value:
                yield value, held
                held = []
            value = row[0]
            held.append(row)
    if held:
        yield value, held


_HITS = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("prints", pa.binary())])


def _shared(batches):
    """Counts of a shard -> the prints that several documents have, for each block that has them."""
    for shard, rows in _runs_of(batches, 3):
        f = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
        block = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows])
        order = np.argsort(f)
        f, block = f[order], block[order]
        equal = f[1:] == f[:-1]
        hot = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
        key = np.unique((block[hot].astype(_U) << _U(32)) | f[hot])
        block, f = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype("<u4")
        cuts = [*(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else []), len(block)]
        out = {"block": [int(block[a]) for a in cuts[:-1]], "shard": [shard] * (len(cuts) - 1), "prints": [f[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]}
        yield pa.RecordBatch.from_pydict(out, schema=_HITS)


def _words_of(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(segments, WORDS) matrix of the segments' bytes, zeros behind them."""
    view = np.ndarray((len(data) + 8,), np.dtype("<u8"), data + bytes(8 * WORDS + 8), strides=(1,))
    out = view[np.minimum(starts[:, None] + 8 * np.arange(WORDS), len(data))]
    left = np.clip(lengths[:, None] - 8 * np.arange(WORDS), 0, 8).astype(_U)
    return np.where(left == 8, out, out & ((_U(1) << (left * _U(8))) - _U(1)))


def _bytes_of(words: np.ndarray, lengths: np.ndarray, end: bytes = b"") -> np.ndarray:
    """The segments' bytes one after the other, each followed by ``end``."""
    table = np.zeros((len(words), 8 * WORDS + 1), np.uint8)
    table[:, : 8 * WORDS] = words.view(np.uint8).reshape(len(words), 8 * WORDS)
    if end:
        table[np.arange(len(words)), lengths] = end[0]
    return table[np.arange(8 * WORDS + 1) < (lengths + len(end))[:, None]]


def _equal(words: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): an order with equal segments together, and where new ones begin in it."""
    h = lengths.astype(_U)
    for i in range(WORDS):
        h = _mix((h ^ words[:, i]) * _U(0x9E3779B97F4A7C15))
    order = np.argsort((group.astype(_U) << _U(40)) | (h >> _U(24)))
    w = words[order]
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (w[1:] != w[:-1]).any(axis=1) | (lengths[order][1:] != lengths[order][:-1])
    return order, np.flatnonzero(new)


def _merged(docs, rows, starts, ends) -> tuple[np.ndarray, ...]:
    """Spans in order, those of a document that meet made one."""
    order = np.lexsort((starts, rows, docs))
    docs, rows, starts, ends = docs[order], rows[order], starts[order], ends[order]
    if not len(docs):
        return docs, rows, starts, ends
    head = np.ones(len(docs), bool)
    head[1:] = (docs[1:] != docs[:-1]) | (rows[1:] != rows[:-1])
    # The furthest end so far in a document: ends grow by its number, which keeps documents apart.
    number = np.cumsum(head) - 1
    far = int(ends.max()) + 1
    reach = np.maximum.accumulate(ends + number * far) - number * far
    head[1:] |= starts[1:] > reach[:-1]
    first = np.flatnonzero(head)
    return docs[first], rows[first], starts[first], np.maximum.reduceat(ends, first)


#: kind 0: settled repeats (places with their own documents and ends); kind 1: segments with their places.
_SEGMENTS = pa.schema([(n, pa.int32()) for n in ("shard", "group", "kind", "block")] + [(n, pa.binary()) for n in ("docs", "lengths", "data", "of", "rows", "starts", "arrays")])
_I8, _I4, _U1 = "<i8", "<i4", "<u1"


def _segments(shards: int, groups: int):
    """Rows of a block, its hits (kind 0) before its documents (kind 1, by id) -> segments of shared halves."""

    def send(held: list, block: int):
        """One row for each group with segments of this block, and one of settled repeats."""
        doc, row, start, length, group, words, array = (np.concatenate(x) for x in zip(*held))
        order, first = _equal(words, length, group)
        size = np.diff(np.append(first, len(order)))
        least = np.minimum.reduceat(doc[order], first)
        entry = np.repeat(np.arange(len(first)), size)
        own = doc[order] == least[entry]
        out = {n: [] for n in _SEGMENTS.names}

        def add(*values):
            for n, x in zip(_SEGMENTS.names, values):
                out[n].append(x)

        late = order[~own]
        if len(late):
            d, r, s, e = _merged(doc[late], row[late], start[late], start[late] + length[late])
            add(block % shards, -1, 0, block, d.astype(_I8).tobytes(), (e - s).astype(_I8).tobytes(), b"", b"", r.astype(_I8).tobytes(), s.astype(_I8).tobytes(), b"")
        one, kept, of = order[first], order[own], entry[own]
        number = group[one]
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(one)]
        places = np.searchsorted(of, cuts)
        for a, b, p, q in zip(cuts, cuts[1:], places, places[1:]):
            data = _bytes_of(words[one[a:b]], length[one[a:b]]).tobytes()
            g = int(number[a])
            add(g // groups, g % groups, 1, block, least[a:b].astype(_I8).tobytes(), length[one[a:b]].astype(_U1).tobytes(), data, (of[p:q] - a).astype(_I4).tobytes(), row[kept[p:q]].astype(_I8).tobytes(), start[kept[p:q]].astype(_I8).tobytes(), array[one[a:b]].tobytes())
        return pa.RecordBatch.from_pydict(out, schema=_SEGMENTS)

    def by_block(batches):
        for batch in batches:
            blocks = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield int(blocks[a]), batch.slice(a, b - a)

    def work(texts, hits):
        known = np.sort(np.concatenate(hits)) if hits else np.empty(0, _U)
        # Most others are told by a table of the prints' low bits.
        maybe = np.zeros(1 << 22, bool)
        maybe[known & _LOW] = True
        for rows, data, starts, ends, bases in _gather(texts, (2, 3, 4)) if len(known) else ():
            first, stop, text, f, at = _anchored(data, starts, ends)
            shared = np.zeros((2, len(f)), bool)
            for side, (own, h) in zip(shared, _halves(data, first, stop, f, at)):
                key = _prints(h, shards)
                some = np.flatnonzero(maybe[key & _LOW])
                key = key[some]
                side[own[some]] = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            # Of a segment with one shared half only that half's windows are left.
            last = at - HALF
            stop = np.where(shared[1], stop, np.minimum(stop, last + LENGTH))
            first = np.where(shared[0], first, np.maximum(first, last + 1))
            hot = np.flatnonzero(shared.any(axis=0))
            if not len(hot):
                continue
            first, length, text, f = first[hot], stop[hot] - first[hot], text[hot], f[hot]
            names = np.array(rows, np.int64)[text]
            group = (f % _U(shards)).astype(np.int64) * groups + (f // _U(shards) % _U(groups)).astype(np.int64)
            yield names[:, 0], names[:, 1], first - starts[text] + np.array(bases)[text], length, group, _words_of(data, first, length), (f // _U(shards * groups) % _U(ARRAYS)).astype(np.uint8)

    def cut(batches):
        with np.errstate(over="ignore"):
            block, hits, held, texts = None, [], [], []
            for b, part in by_block(batches):
                if b != block:
                    held += work(texts, hits)
                    if held:
                        yield send(held, block)
                    block, hits, held, texts = b, [], [], []
                kinds = np.asarray(part.column(1))
                n_hits = int((kinds == 0).sum())
                for shard, prints in zip(part.column(3).slice(0, n_hits).to_pylist(), part.column(4).slice(0, n_hits).to_pylist()):
                    hits.append((_U(shard) << _U(32)) | np.frombuffer(prints, "<u4").astype(_U))
                if n_hits < len(kinds):
                    texts.append(part.slice(n_hits))
                    if sum(x.nbytes for x in texts) >= 2 * BATCH_BYTES:
                        held += work(texts, hits)
                        texts = []
                        if sum(len(x[0]) for x in held) >= HELD_SEGMENTS:
                            yield send(held, block)
                            held = []
            held += work(texts, hits)
            if held:
                yield send(held, block)

    return cut


def first_documents(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For segments in ``text``, each with a document and a separator behind it: at every window's start the smallest document of the segments that hold that window."""
    sa = suffix_array(text)
    prefix = common_prefixes(text, sa, starts, 136)[sa]
    owner = np.repeat(np.arange(len(starts)), lengths + 1)
    valid = (np.arange(len(text)) + length <= (starts + lengths)[owner])[sa]
    run = np.cumsum(prefix < length)[valid]  # stretches of the array that share ``length`` bytes
    pos = sa[valid]
    out = np.full(len(text), np.iinfo(np.int64).max)
    if len(pos):
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        out[pos] = np.repeat(np.minimum.reduceat(docs[owner[pos]], first), np.diff(np.append(first, len(run))))
    return out


def _repeats(parts: list[tuple]) -> list[np.ndarray]:
    """Segments of one group from all blocks -> (block, doc, row, start, end) of repeated spans."""
    docs, lengths = (np.concatenate([np.frombuffer(p[i], t) for p in parts]).astype(np.int64) for i, t in ((4, _I8), (5, _U1)))
    counts = [len(p[5]) for p in parts]
    of = np.concatenate([np.frombuffer(p[7], _I4) + n for p, n in zip(parts, np.cumsum([0, *counts]))])
    rows, starts = (np.concatenate([np.frombuffer(p[i], _I8) for p in parts]) for i in (8, 9))
    block = np.repeat([p[3] for p in parts], counts)[of]
    words = _words_of(b"".join(p[6] for p in parts), np.cumsum(lengths) - lengths, lengths)
    array = np.concatenate([np.frombuffer(p[10], _U1) for p in parts])
    order, first = _equal(words, lengths, array)
    one = order[first]
    entry = np.empty(len(docs), np.int64)
    entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    own = lengths[one]
    at = np.cumsum(own + 1) - own - 1
    smallest, edges = np.minimum.reduceat(docs[order], first), np.searchsorted(array[one], np.arange(ARRAYS + 1))
    least = []
    for a, b in zip(edges, edges[1:]):
        if a < b:
            least.append(first_documents(_bytes_of(words[one[a:b]], own[a:b], bytes([SEPARATOR])), at[a:b] - at[a], own[a:b], smallest[a:b]))
    least = np.concatenate(least)
    del words
    # The windows of a segment overlap, as it is shorter than two of them: from the first repeated one to the last all goes.
    out = []
    for a in range(0, len(of), 200_000):
        e = of[a : a + 200_000]
        windows = lengths[e] - LENGTH + 1
        head = np.cumsum(windows) - windows
        inner = np.arange(windows.sum()) - np.repeat(head, windows)
        hit = least[np.repeat(at[entry[e]], windows) + inner] < np.repeat(docs[e], windows)
        low = np.minimum.reduceat(np.where(hit, inner, 255), head)
        high = np.maximum.reduceat(np.where(hit, inner, -1), head)
        some = np.flatnonzero(high >= 0)
        s = starts[a : a + 200_000][some]
        out.append(np.stack((block[a : a + 200_000][some], docs[e][some], rows[a : a + 200_000][some], s + low[some], s + high[some] + LENGTH)))
    return out


_SPANS = pa.schema([("block", pa.int32()), *((n, pa.binary()) for n in ("docs", "rows", "starts", "ends"))])


def _send_spans(held: list[np.ndarray]):
    block, *spans = np.concatenate(held, axis=1)
    out = {n: [] for n in _SPANS.names}
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            out["block"].append(int(block[a]))
            for n, x in zip(_SPANS.names[1:], _merged(*(s[order[a:b]] for s in spans))):
                out[n].append(x.astype(_I8).tobytes())
    return pa.RecordBatch.from_pydict(out, schema=_SPANS)


def _judge(batches):
    """Segments of whole groups -> repeated spans by block of their documents."""
    with np.errstate(over="ignore"):
        held, parts, group = [], [], None

        def rows():
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in range(len(_SEGMENTS.names))])

        for r in rows():
            if parts and r[:2] != group:
                held += _repeats(parts)
                parts = []
                # Spans of many groups leave together: one row for each block.
                if sum(x.shape[1] for x in held) >= HELD_SPANS:
                    yield _send_spans(held)
                    held = []
            group = r[:2]
            if r[2] == 0:
                d, n, w, s = (np.frombuffer(r[i], _I8) for i in (4, 5, 8, 9))
                held.append(np.stack((np.full(len(d), r[3]), d, w, s, s + n)))
            else:
                parts.append(r)
        if parts:
            held += _repeats(parts)
        if held:
            yield _send_spans(held)


def _merge(batches):
    """Spans of a block -> (doc, row, merged spans) for each document."""
    for _, parts in _runs_of(batches, 5):
        docs, rows, starts, ends = _merged(*(np.concatenate([np.frombuffer(p[i], _I8) for p in parts]) for i in (1, 2, 3, 4)))
        both = np.stack((starts, ends), axis=1).astype(_I8)
        cuts = [0, *(np.flatnonzero((rows[1:] != rows[:-1]) | (docs[1:] != docs[:-1])) + 1).tolist(), len(rows)]
        cuts = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
        first = [a for a, _ in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(docs[first]), pa.array(rows[first]), pa.array([both[a:b].tobytes() for a, b in cuts], pa.binary())], ["sk", "srow", "spans"])


def _named(key: str, text: str) -> list:
    """A document's name: its id, and a hash of id and text."""
    k = F.col(key).cast("long")
    return [k.alias("k"), F.xxhash64(k, F.col(text).cast("binary")).alias("row")]


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(sk, srow, spans): for a document's name the sorted disjoint byte spans to cut, as pairs of 64-bit integers."""
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = docs.select(*_named(key, text), F.col(text).cast("binary").alias("t")).where(f"k is not null and octet_length(t) >= {LENGTH}")
    total = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    shards = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES)))
    groups = max(1, -(-total // (shards * GROUP_BYTES)))
    rows = rows.select(F.pmod("row", F.lit(shards)).cast("int").alias("block"), F.lit(1).alias("kind"), "k", "row", "t")
    counts = rows.select("block", "row", "t").mapInArrow(_count(shards), "shard int, prints binary, blocks binary")
    hits = tables.stage(counts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_shared, "block int, shard int, prints binary"), "repeat-hits")
    hits = hits.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("k"), F.col("shard").cast("long").alias("row"), F.col("prints").alias("t"))
    dealt = hits.unionByName(rows).repartition(shards, "block").sortWithinPartitions("block", "kind", "k")
    segments = dealt.mapInArrow(_segments(shards, groups), "shard int, group int, kind int, block int, docs binary, lengths binary, data binary, of binary, rows binary, starts binary, arrays binary")
    judged = segments.repartition(shards, "shard", "group").sortWithinPartitions("shard", "group").mapInArrow(_judge, "block int, docs binary, rows binary, starts binary, ends binary")
    merged = judged.repartition(shards, "block").sortWithinPartitions("block").mapInArrow(_merge, "sk long, srow long, spans binary")
    return tables.result(merged, "repeat-spans")


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", content: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, spans [, kept binary] of every row."""
    spans = small(repeated_spans(docs, key, text))
    rows = docs.select(*_named(key, text), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("t"))

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                out = {"k": part.column(0).to_pylist(), "n": [], "r": [], "c": [], "h": [], "s": []}
                kept_all = []
                for t, s in zip(part.column(1), part.column(2)):
                    t, s = t.as_py(), s.as_py()
                    pairs = np.frombuffer(s, "<i8").reshape(-1, 2).tolist() if s else []
                    kept, at = [], 0
                    for x, y in pairs:
                        kept.append(t[at:x])
                        at = y
                    kept = b"".join([*kept, t[at:]])
                    out["n"].append(len(t))
                    out["r"].append(len(t) - len(kept))
                    out["c"].append(len(pairs))
                    out["h"].append(hashlib.sha256(kept).hexdigest())
                    out["s"].append(pairs)
                    kept_all.append(kept if content else None)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(out.values(), kinds)), pa.array(kept_all, pa.binary())], [*out, "kept"])

    joined = rows.join(spans, (F.col("k") == F.col("sk")) & (F.col("row") == F.col("srow")), "left").select("k", "t", "spans")
    done = joined.mapInArrow(cut, "k long, n long, r long, c long, h string, s array<array<long>>, kept binary")
    done = done.toDF(key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
    return done if content else done.drop("kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), content=False).drop("spans")
