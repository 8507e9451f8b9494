"""Exact substring deduplication with longest-previous-factor arrays.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier: in a document of a smaller
``doc_id`` or earlier in the same document.  All strings are judged on the input.

The longest previous factor of a position is the longest string that starts there and also starts earlier; it is found
from the suffix order by the nearest smaller positions before and after it (``previous_factors``).  Ordering all
suffixes of a corpus is neither possible in one task nor needed:

1. Every window of ``LENGTH`` bytes names an anchor, the ``GRAM``-gram of least hash in it.  Equal windows name equal
   anchors at equal offsets, and neighbouring windows mostly share theirs: about one anchor for 36 bytes.
2. Anchors meet by hash.  Where all windows of an anchor are equal to those of an earlier occurrence (equal hash of the
   text that they cover), they are earlier strings as a whole.  Within an Arrow batch that is settled before the
   shuffle, so a passage that a third of all documents share leaves one row for each batch.
3. Only anchors that occur with several different surroundings (the borders of repeated passages) need text, and of these
   only occurrences that share the ``SIDE`` bytes before or after the anchor with another: every window has as many on one
   of its sides.  So chance repeats of a ``GRAM``-gram, whose number grows with the square of the input, ask for none.
   The covered text is dealt out by anchor, and the suffix order and the previous factors of each bucket tell which
   windows start earlier.  The windows of an anchor with more than ``HOT`` such surroundings are dealt out one by one, by
   their own hash, after equal ones in a batch were settled.
4. Ranges are gathered by document and the kept bytes are put together.

The texts are shuffled once; both joins with them read the same exchange.

What is compared by bytes and what by hash: the suffix order and the previous factors of step 3 work on bytes.  Step 2 and
the windows of hot anchors in steps 2 and 3 take equal 64-bit hashes of the covered text for equal text; a wrong removal
needs two different covered texts of one hash.

Edge cases: null is an empty text; texts shorter than ``LENGTH`` lose nothing; rows with a null ``doc_id`` (and the id
2**63 - 1, which stands for it) come last; among rows of one ``doc_id`` with different texts the order is that of a hash
of the text; of identical rows one is first and the others are later copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm import textkit as tk
from opinara.llm.grouped import map_groups
from opinara.session import cut_lineage, small_batches

LENGTH = 100
GRAM = 28
#: Bytes beside the anchor that each window has on one side at least.
SIDE = (LENGTH - GRAM) // 2
#: Different surroundings of one anchor that are compared in one bucket.
HOT = 2048
#: Text bytes behind one bucket of anchors, and bytes of covered text in one bucket of suffixes, about.
ANCHOR_BUCKET, SUFFIX_BUCKET = 4 << 20, 1 << 19
NULL_ID = (1 << 63) - 1
#: Runs of texts whose anchors are settled together before the shuffle.
RUNS = 32
_POSITION = np.uint64((1 << 31) - 1)
_LOW = np.uint64((1 << 32) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    block = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    block[: len(x)] = x
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of a run of texts: doc, lo (first window), hi (last window), off (anchor minus lo), h (its hash), v (hash
    of the covered text and the anchor's place in it), left and right (hashes of the anchor with the ``SIDE`` bytes before
    and after it, 0 where no window has them); places count within each text."""
    none = {k: np.zeros(0, np.int32) for k in ("doc", "lo", "hi")} | {"off": np.zeros(0, np.uint8)} | {k: np.zeros(0, np.uint64) for k in ("h", "v")} | {k: np.zeros(0, np.uint32) for k in ("left", "right")}
    if len(data) < LENGTH:
        return none
    prefix = tk.prefix_hash(data)
    _, down = tk.powers(len(data) + 1)
    grams = tk.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(data) - GRAM + 1])
    key = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(key, LENGTH - GRAM + 1)
    size = np.diff(offsets)
    count = np.maximum(size - LENGTH + 1, 0)
    if not count.sum():
        return none
    doc = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
    place = (least[start] & _POSITION).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(place)) - 1
    lo, hi, place, doc = start[at], start[end], place[at], doc[at]
    off = place - lo
    v = tk.mix(tk.span_hash(prefix, lo, hi + LENGTH) + off.astype(np.uint64) * tk.BASE)
    before, after = np.flatnonzero(off >= SIDE), np.flatnonzero(hi + LENGTH - place >= GRAM + SIDE)
    left, right = np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint32)
    left[before] = tk.mix(tk.span_hash(prefix, place[before] - SIDE, place[before] + GRAM)) >> np.uint64(32) | np.uint64(1)
    right[after] = tk.mix(tk.span_hash(prefix, place[after], place[after] + GRAM + SIDE)) >> np.uint64(32) | np.uint64(1)
    base = offsets[doc]
    return {"doc": doc.astype(np.int32), "lo": (lo - base).astype(np.int32), "hi": (hi - base).astype(np.int32), "off": off.astype(np.uint8), "h": grams[place], "v": v, "left": left, "right": right}


def settle(v: np.ndarray, rank: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence of each value of v, later occurrences) by (rank, lo); rows equal to the first in both are
    neither."""
    order = np.lexsort((lo, rank, v))
    sv = v[order]
    new = np.ones(len(order), bool)
    new[1:] = sv[1:] != sv[:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = ~new & ((rank[order] != rank[head]) | (lo[order] != lo[head]))
    return order[new], order[later]


def dense_rank(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys, ids))
    new = np.ones(len(order), np.int64)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def merge_by(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint ascending ranges [lo, end) of each document that cover the same places."""
    if not len(doc):
        return doc, lo, end
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    step = int(end.max()) + 1
    top = np.maximum.accumulate(end + doc * step) - doc * step
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1])
    at = np.flatnonzero(new)
    return doc[at], lo[at], top[np.append(at[1:], len(doc)) - 1]


def doubling_ranks(data: np.ndarray, room: np.ndarray, depth: int, start: int = 8) -> dict[int, np.ndarray]:
    """length -> ranks of the strings of that length at each place in suffix order, -1 where they don't fit in
    ``room`` (bytes left to the end of a place's text).  The lengths are ``start`` (1, 2, 4 or 8), its doubles up to
    ``depth``, and ``depth`` itself."""
    start = min(start, depth)
    ok = np.flatnonzero(room >= start)
    head = np.zeros(len(ok), np.uint64)
    for k in range(start):
        head = (head << np.uint64(8)) | data[ok + k]
    ranks = {start: np.full(len(data), -1, np.int32)}
    ranks[start][ok] = np.unique(head, return_inverse=True)[1]
    length = start
    while length < depth:
        longer = min(2 * length, depth)
        ok = ok[room[ok] >= longer]
        prior = ranks[length]
        # For ``depth`` the halves may overlap: both are ranks of strings of ``length``.
        pair = (prior[ok].astype(np.int64) << 32) | prior[ok + longer - length]
        ranks[longer] = np.full(len(data), -1, np.int32)
        ranks[longer][ok] = np.unique(pair, return_inverse=True)[1]
        length = longer
    return ranks


def common_prefix(ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to the greatest length of ``ranks`` and in steps of
    the least; -1 for b < 0."""
    depth, n = max(ranks), len(next(iter(ranks.values())))
    same = b >= 0
    out = np.where(same, 0, -1)
    x, y = a.copy(), np.maximum(b, 0)
    full = same & (ranks[depth][x] >= 0) & (ranks[depth][x] == ranks[depth][y])
    out[full] = depth
    live = np.flatnonzero(same & ~full)
    for length in sorted((k for k in ranks if k & (k - 1) == 0), reverse=True):
        ok = live[(x[live] < n) & (y[live] < n)]
        r = ranks[length]
        step = ok[(r[x[ok]] >= 0) & (r[x[ok]] == r[y[ok]])]
        x[step] += length
        y[step] += length
        out[step] += length
    return out


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a suffix order the nearest entries before and after it of smaller positions, -1 for none."""
    n = len(order)

    def nearest(step: int) -> np.ndarray:
        at = np.arange(n) + step
        at[(at < 0) | (at >= n)] = -1
        while True:
            far = np.flatnonzero((at >= 0) & (order[np.maximum(at, 0)] > order))
            if not len(far):
                return at
            at[far] = at[at[far]]

    before, after = nearest(-1), nearest(1)
    return np.where(before >= 0, order[np.maximum(before, 0)], -1), np.where(after >= 0, order[np.maximum(after, 0)], -1)


def previous_factors(data: np.ndarray, room: np.ndarray, places: np.ndarray, depth: int, start: int = 8) -> np.ndarray:
    """Longest previous factors, up to ``depth`` and in steps of ``start``, of the ascending ``places`` among themselves;
    each place has ``depth`` bytes of room."""
    if not len(places):
        return np.zeros(0, np.int64)
    ranks = doubling_ranks(data, room, depth, start)
    order = places[np.argsort(ranks[depth][places], kind="stable")]
    before, after = smaller_neighbours(order)
    longest = np.maximum(common_prefix(ranks, order, before), common_prefix(ranks, order, after))
    out = np.zeros(len(places), np.int64)
    out[np.searchsorted(places, order)] = np.maximum(longest, 0)
    return out


_MAP = "bucket int, kind int, ids binary, keys binary, doc binary, h binary, v binary, lo binary, hi binary, off binary, side binary"
_FLAT = "id long, key long, kind int, lo int, end int, h long, hot boolean"


def _pack(bucket: int, kind: int, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, h=None, v=None, off=None, side=None) -> tuple:
    used, doc = np.unique(doc, return_inverse=True)
    raw = lambda x, kind_: b"" if x is None else x.astype(kind_).tobytes()
    return bucket, kind, raw(ids[used], np.int64), raw(keys[used], np.int64), raw(doc, np.uint32), raw(h, np.uint64), raw(v, np.uint64), raw(lo, np.uint32), raw(hi, np.uint32), raw(off, np.uint8), raw(side, np.uint32)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def _flat(ids, keys, kind, lo, end, h=None, hot=None) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.full(n, kind, np.int32)), pa.array(lo.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(h.view(np.int64) if h is not None else np.zeros(n, np.int64)), pa.array(hot if hot is not None else np.zeros(n, bool))],
        schema=_schema(_FLAT),
    )


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _meet(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors, dealt out by bucket, and ranges that a batch settled by itself."""

    def settled(parts: list[dict], ids: np.ndarray, keys: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        a = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        if not len(a["doc"]):
            return
        first, later = settle(a["v"], rank[a["doc"]], a["lo"])
        rows = []
        if len(later):
            doc, lo, end = merge_by(*(a[k][later].astype(np.int64) for k in ("doc", "lo")), a["hi"][later].astype(np.int64) + LENGTH)
            bucket = tk.mix(ids[doc].astype(np.uint64)) % np.uint64(buckets)
            rows += [_pack(k, 0, ids, keys, doc[p], lo[p], end[p]) for k, p in _by_bucket(bucket.astype(np.int64))]
        a = {k: x[first] for k, x in a.items()}
        for k, p in _by_bucket((a["h"] % np.uint64(buckets)).astype(np.int64)):
            rows.append(_pack(k, 1, ids, keys, a["doc"][p], a["lo"][p], a["hi"][p], a["h"][p], a["v"][p], a["off"][p], np.stack([a["left"][p], a["right"][p]])))
        for s in range(0, len(rows), 2048):
            yield _batch(rows[s : s + 2048], _MAP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            rank = dense_rank(ids, keys)
            parts: list[dict] = []
            for row, _, data, offsets in tk.doc_chunks(b.column(2)):
                parts.append(anchors(data, offsets))
                parts[-1]["doc"] += np.int32(row)
                if len(parts) == RUNS:
                    yield from settled(parts, ids, keys, rank)
                    parts = []
            if parts:
                yield from settled(parts, ids, keys, rank)

    return docs.mapInArrow(run, _MAP)


def shared(x: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    _, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
    return times[inverse] > 1


def _resolve(group: pa.Table) -> pa.RecordBatch | None:
    """Ranges (kind 0) and requests for text (kind 1) of one bucket."""
    read: dict[str, list[np.ndarray]] = {k: [] for k in ("id", "key", "h", "v", "lo", "hi", "off", "left", "right")}
    outs = []
    for r in group.to_pylist():
        doc = np.frombuffer(r["doc"], np.uint32)
        ids, keys = np.frombuffer(r["ids"], np.int64)[doc], np.frombuffer(r["keys"], np.int64)[doc]
        lo, hi = np.frombuffer(r["lo"], np.uint32).astype(np.int64), np.frombuffer(r["hi"], np.uint32).astype(np.int64)
        if r["kind"] == 0:
            outs.append(_flat(ids, keys, 0, lo, hi))
            continue
        left, right = np.frombuffer(r["side"], np.uint32).reshape(2, -1)
        for k, x in (("left", left), ("right", right), ("id", ids), ("key", keys), ("lo", lo), ("hi", hi), ("h", np.frombuffer(r["h"], np.uint64)), ("v", np.frombuffer(r["v"], np.uint64)), ("off", np.frombuffer(r["off"], np.uint8))):
            read[k].append(x)
    if read["id"]:
        a = {k: np.concatenate(x) for k, x in read.items()}
        rank = dense_rank(a["id"], a["key"])
        first, later = settle(a["v"], rank, a["lo"])
        if len(later):
            ids, keys = a["id"][later], a["key"][later]
            doc, lo, end = merge_by(rank[later], a["lo"][later], a["hi"][later] + LENGTH)
            known, at = np.unique(rank[later], return_index=True)
            at = at[np.searchsorted(known, doc)]
            outs.append(_flat(ids[at], keys[at], 0, lo, end))
        ask = first[shared(a["h"][first])]
        sides = [np.where(a[k][ask] > 0, shared((a["h"][ask] & ~_LOW) | a[k][ask]), False) for k in ("left", "right")]
        ask = ask[sides[0] | sides[1]]
        if len(ask):
            _, inverse, times = np.unique(a["h"][ask], return_inverse=True, return_counts=True)
            outs.append(_flat(a["id"][ask], a["key"][ask], 1, a["lo"][ask], a["hi"][ask] + LENGTH, a["h"][ask], times[inverse] > HOT))
    return pa.Table.from_batches(outs).combine_chunks().to_batches()[0] if outs and sum(o.num_rows for o in outs) else None


_SLICE = "bucket int, kind int, ids binary, keys binary, doc binary, lo binary, size binary, text binary"


def _slices(texts: DataFrame, buckets: int) -> DataFrame:
    """The covered text of each request, dealt out by anchor; hot ones window by window, by the window's hash.
    ``texts``: id, key, text, asks (array of lo, end, h, hot)."""
    rows = texts.select("id", "key", "text", F.col("asks.lo").alias("lo"), F.col("asks.end").alias("end"), F.col("asks.h").alias("h"), F.col("asks.hot").alias("hot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            # Longer runs than elsewhere: each run makes one row for every bucket that it reaches.
            for row, stop, data, offsets in tk.doc_chunks(b.column(2), 2 * tk.CHUNK):
                part = b.slice(row, stop - row)
                counts = part.column(3).value_lengths().to_numpy()
                doc = np.repeat(np.arange(row, stop), counts)
                base = offsets[doc - row]
                lo, end = (part.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
                h, hot = part.column(5).flatten().to_numpy().view(np.uint64), part.column(6).flatten().to_numpy(zero_copy_only=False).astype(bool)
                out = []
                cold = np.flatnonzero(~hot)
                for k, p in _by_bucket((h[cold] % np.uint64(buckets)).astype(np.int64)):
                    p = cold[p]
                    out.append(_slice_row(k, 1, ids, keys, data, doc[p], base[p], lo[p], end[p] - lo[p]))
                warm = np.flatnonzero(hot)
                if len(warm):
                    n = end[warm] - lo[warm] - LENGTH + 1
                    which = np.repeat(warm, n)
                    start = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    at = base[which] + start
                    prefix = tk.prefix_hash(data)
                    own = tk.span_hash(prefix, at, at + LENGTH)
                    first, later = settle(own, dense_rank(ids, keys)[doc[which]], start)
                    if len(later):
                        d, s, e = merge_by(doc[which[later]], start[later], start[later] + LENGTH)
                        for k, p in _by_bucket((tk.mix(ids[d].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
                            out.append(_slice_row(k, 0, ids, keys, None, d[p], None, s[p], e[p] - s[p]))
                    w = which[first]
                    for k, p in _by_bucket((own[first] % np.uint64(buckets)).astype(np.int64)):
                        out.append(_slice_row(k, 1, ids, keys, data, doc[w[p]], base[w[p]], start[first][p], np.full(len(p), LENGTH)))
                for s in range(0, len(out), 1024):
                    yield _batch(out[s : s + 1024], _SLICE)

    return rows.mapInArrow(run, _SLICE)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenated spans [start, start + size)."""
    total = int(size.sum())
    return data[np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)]


def _slice_row(bucket, kind, ids, keys, data, doc, base, lo, size) -> tuple:
    used, short = np.unique(doc, return_inverse=True)
    text = b"" if data is None else gather(data, base + lo, size).tobytes()
    return bucket, kind, ids[used].tobytes(), keys[used].tobytes(), short.astype(np.uint32).tobytes(), lo.astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes(), text


def _factors(group: pa.Table) -> pa.RecordBatch | None:
    """Ranges of one bucket's windows that start earlier, from its previous factors."""
    outs, held = [], {k: [] for k in ("id", "key", "lo", "size")}
    texts = []
    for r in group.to_pylist():
        doc = np.frombuffer(r["doc"], np.uint32)
        ids, keys = np.frombuffer(r["ids"], np.int64)[doc], np.frombuffer(r["keys"], np.int64)[doc]
        lo, size = np.frombuffer(r["lo"], np.uint32).astype(np.int64), np.frombuffer(r["size"], np.uint32).astype(np.int64)
        if r["kind"] == 0:
            outs.append(_flat(ids, keys, 0, lo, lo + size))
            continue
        for k, x in (("id", ids), ("key", keys), ("lo", lo), ("size", size)):
            held[k].append(x)
        texts.append(np.frombuffer(r["text"], np.uint8))
    if texts:
        a = {k: np.concatenate(x) for k, x in held.items()}
        data = np.concatenate(texts)
        begin = np.cumsum(a["size"]) - a["size"]
        # In the order of documents and places, a smaller position is an earlier start.
        order = np.lexsort((a["lo"], a["key"], a["id"]))
        same = np.zeros(len(order), bool)
        same[1:] = np.logical_and.reduce([a[k][order][1:] == a[k][order][:-1] for k in ("id", "key", "lo", "size")])
        order = order[~same]
        a = {k: x[order] for k, x in a.items()}
        data = gather(data, begin[order], a["size"])
        begin = np.cumsum(a["size"]) - a["size"]
        room = np.repeat(begin + a["size"], a["size"]) - np.arange(len(data))
        places = np.flatnonzero(room >= LENGTH)
        again = places[previous_factors(data, room, places, LENGTH) >= LENGTH]
        if len(again):
            own = np.searchsorted(begin, again, "right") - 1
            start = again - begin[own] + a["lo"][own]
            which, lo, end = merge_by(own, start, start + LENGTH)
            # Windows LENGTH apart would merge with their bytes; that is what is removed.
            outs.append(_flat(a["id"][which], a["key"][which], 0, lo, end))
    return pa.Table.from_batches(outs).combine_chunks().to_batches()[0] if outs and sum(o.num_rows for o in outs) else None


def removed_ranges(docs: DataFrame, text_bytes: int) -> DataFrame:
    """(id, key, lo, end): ranges to remove; ``docs`` has id, key and text."""
    step = max(ANCHOR_BUCKET, min(64 * ANCHOR_BUCKET, text_bytes >> 12))
    buckets = min(1 << 22, max(32, text_bytes // step))
    flat = cut_lineage(map_groups(_meet(docs, buckets), ["bucket"], _resolve, _FLAT), "anchors")
    # Bytes that the requests deal out; hot ones send each window by itself.
    covered = F.col("end") - F.col("lo")
    size = flat.where("kind = 1").agg(F.sum(F.when(F.col("hot"), (covered - LENGTH + 1) * LENGTH).otherwise(covered).cast("long"))).first()[0] or 0
    known = flat.where("kind = 0").select("id", "key", "lo", "end")
    if not size:
        return known
    asks = flat.where("kind = 1").groupBy("id", "key").agg(F.collect_list(F.struct("lo", "end", "h", "hot")).alias("asks"))
    sliced = _slices(docs.join(asks, ["id", "key"]), max(32, size // SUFFIX_BUCKET))
    found = map_groups(sliced, ["bucket"], _factors, _FLAT)
    return known.unionAll(found.select("id", "key", "lo", "end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``keep_text`` the kept text (bytes of characters that were
    cut in two are dropped), and the columns ``carry``; one row per document."""
    small_batches(docs.sparkSession)
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(own.alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    text_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = base.repartition("id", "key")
    lists = removed_ranges(dealt, text_bytes).groupBy("id", "key").agg(F.collect_list(F.struct("lo", "end")).alias("cut"))
    whole = dealt.join(lists, ["id", "key"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("key")))
    if carry:
        # Carried columns join by themselves: with them beside the text, the two uses of the texts would be two shuffles.
        beside = docs.select(own.alias("id"), F.xxhash64(text).alias("key"), F.struct(*carry).alias("c")).groupBy("id", "key").agg(F.collect_list("c").alias("carried"))
        whole = whole.join(beside.hint("merge"), ["id", "key"], "left").withColumn("c", F.get("carried", F.col("nth") - 1))
    rows = whole.select("id", "text", F.col("cut.lo").alias("lo"), F.col("cut.end").alias("end"), "nth", *[F.col(f"c.{c}").alias(c) for c in carry])
    whole_fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField(c, T.StringType()) for c in ["kept_sha256", "kept"][: 1 + keep_text]]
    schema = T.StructType(whole_fields + [docs.schema[c] for c in carry])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text + list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            ids = b.column(0)
            los, ends, nth = b.column(2), b.column(3), b.column(4).to_numpy()
            for row, stop, data, offsets in tk.doc_chunks(b.column(1)):
                for k in range(row, stop):
                    raw = data[offsets[k - row] : offsets[k - row + 1]]
                    n = len(raw)
                    if nth[k] > 1:
                        cut = np.array([[0, n]], np.int64) if n >= LENGTH else np.zeros((0, 2), np.int64)
                    elif los[k].is_valid:
                        lo, end = (np.asarray(x[k].values, np.int64) for x in (los, ends))
                        _, lo, end = merge_by(np.zeros(len(lo), np.int64), lo, end)
                        cut = np.stack([lo, end], 1)
                    else:
                        cut = np.zeros((0, 2), np.int64)
                    edges = [0, *cut.ravel().tolist(), n]
                    kept = b"".join(raw[edges[i] : edges[i + 1]].tobytes() for i in range(0, len(edges), 2))
                    i = ids[k].as_py()
                    out.append((None if i == NULL_ID else i, n, n - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if keep_text else [])))
            kinds_ = [pa.int64()] * 4 + [pa.string()] * (1 + keep_text)
            cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds_]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)], *[b.column(5 + k) for k in range(len(carry))]], names)

    return rows.mapInArrow(run, schema)
