"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` turns texts into index segments: one row per run of documents with the sorted terms of the run, the
length of each posting list and the postings (word positions, ascending within a term).  Segments are partitioned
by document, so a frequent word is a list in every segment and never one long list in one task, and a search needs no
shuffle.  ``search`` intersects the offset-adjusted lists of each benchmark window within each segment, from the
window's rarest term of that segment to its most frequent one, and returns exact phrase matches; with ``span`` also
proximity matches (all words of a window within ``span`` words, in any order).

The index holds the postings of all words of all texts, so that one stored index serves any benchmark.

Edge cases: null text has no words; an item without words has no windows; repeated items and repeated windows count
for every item that holds them; ids of any type count as their text; the windows of an item with a null ``item_id``
count for hits and ``contaminated`` but not for the numbers of items and the hash of their ids; rows with a null or repeated ``doc_id`` are kept apart, as matches are found per
row; an empty corpus or benchmark gives no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm import textkit as tk
from opinara.session import cut_lineage, small_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Positions left free between documents of a segment; no window may be longer.
GAP = 64
#: Benchmark text held in memory at once; a larger benchmark is searched in that many passes.
BLOCK_BYTES = 16 << 20
#: Candidates expanded at once while a segment is searched.
CANDIDATES = 1 << 20

SEGMENT = "doc_ids binary, id_null binary, n_words binary, base binary, terms binary, counts binary, positions binary"
MATCHES = T.StructType(
    [T.StructField("segment", T.LongType()), T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("near_items", T.ArrayType(T.StringType()))]
)


def item_windows(items: pd.DataFrame, window: int = WINDOW) -> dict:
    """Distinct windows of the items as vocabulary numbers, with the items that hold each."""
    found: dict[tuple, set] = {}
    for item_id, text in zip(items["item_id"], items["text"], strict=True):
        if text is None:
            continue
        own = set() if item_id is None or item_id != item_id else {str(item_id)}
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        for i in range(max(1, len(words) - window + 1)) if words else ():
            found.setdefault(tuple(words[i : i + window]), set()).update(own)
    vocab = sorted({w for key in found for w in key})
    at = {w: i for i, w in enumerate(vocab)}
    terms = np.full((len(found), window), -1, np.int32)
    for i, key in enumerate(found):
        terms[i, : len(key)] = [at[w] for w in key]
    owners = [sorted(x) for x in found.values()]
    return {"hashes": tk.hash_words(vocab), "terms": terms, "owners": np.array([x for o in owners for x in o], object), "owner_at": np.cumsum([0, *map(len, owners)])}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the positional index over all words."""
    small_batches(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in tk.doc_chunks(batch.column(1), 4 * tk.CHUNK):
                hashes, first = tk.token_hashes(data, offsets, tk.ALNUM)
                n_words = np.diff(first)
                base = first[:-1] + GAP * np.arange(1, hi - lo + 1)
                position = np.arange(len(hashes)) + np.repeat(base - first[:-1], n_words)
                order = np.argsort(hashes, kind="stable")
                terms, counts = np.unique(hashes[order], return_counts=True)
                own = ids.slice(lo, hi - lo)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_ids": [own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
                        "id_null": [own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()],
                        "n_words": [n_words.astype(np.int64).tobytes()],
                        "base": [base.astype(np.int64).tobytes()],
                        "terms": [terms.astype(np.uint64).tobytes()],
                        "counts": [counts.astype(np.int64).tobytes()],
                        "positions": [position[order].astype(np.uint32).tobytes()],
                    },
                    schema=pa.schema([(c.split()[0], pa.binary()) for c in SEGMENT.split(", ")]),
                )

    parts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(index, SEGMENT)
    return parts.select(F.monotonically_increasing_id().alias("segment"), "*")


class Segment:
    """One index segment in memory."""

    def __init__(self, row: dict):
        read = lambda k, kind: np.frombuffer(row[k], kind)
        self.segment = row["segment"]
        self.ids = [None if null else int(i) for i, null in zip(read("doc_ids", np.int64), read("id_null", np.uint8), strict=True)]
        self.n_words, self.base = read("n_words", np.int64), read("base", np.int64)
        self.terms, self.counts = read("terms", np.uint64), read("counts", np.int64)
        self.positions = read("positions", np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, self.counts) + self.positions

    def live(self, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose words occur, their terms here, and the order of their terms from the rarest."""
        none = np.zeros((0, block["terms"].shape[1]), np.int64)
        if not len(self.terms) or not len(block["hashes"]):
            return np.zeros(0, np.int64), none, none
        at = np.minimum(np.searchsorted(self.terms, block["hashes"]), len(self.terms) - 1)
        at = np.where(self.terms[at] == block["hashes"], at, -1)
        # Slot by slot, so that windows with a word that doesn't occur here leave early.
        terms, live = block["terms"], np.arange(len(block["terms"]))
        for k in range(terms.shape[1]):
            own = terms[live, k]
            live = live[(own < 0) | (at[np.maximum(own, 0)] >= 0)]
        here = np.where(terms[live] >= 0, at[np.maximum(terms[live], 0)], -1)
        size = np.where(here >= 0, self.counts[np.maximum(here, 0)], np.iinfo(np.int64).max)
        return live, here, np.argsort(size, axis=1, kind="stable")

    def anchors(self, live: np.ndarray, here: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(line of ``here``, position of its rarest term) in runs of bounded length."""
        rarest = here[np.arange(len(here)), order[:, 0]] if len(here) else np.zeros(0, np.int64)
        size = self.counts[rarest]
        total = np.cumsum(size)
        lo = 0
        while lo < len(live):
            done = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, done + CANDIDATES, "right")))
            n = size[lo:hi]
            line = np.repeat(np.arange(lo, hi), n)
            yield line, self.positions[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[rarest[lo:hi]], n)]
            lo = hi

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def phrases(self, block: dict) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) of every exact occurrence."""
        live, here, order = self.live(block)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for line, position in self.anchors(live, here, order):
            start = position - order[line, 0]
            for k in range(1, here.shape[1]):
                slot = order[line, k]
                term = here[line, slot]
                ok = (term < 0) | self.has(term, start + slot)
                line, start = line[ok], start[ok]
            found.append((live[line], start))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2

    def near(self, block: dict, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) where all words of a window (as often as the window has them) lie within ``span`` words."""
        live, here, order = self.live(block)
        found: list[tuple[int, int]] = []
        for line, position in self.anchors(live, here, order):
            for k in range(1, here.shape[1]):
                term = here[line, order[line, k]]
                low = (term << 32) + np.maximum(position - span + 1, 0)
                at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
                ok = (term < 0) | ((self.keys[at] >= low) & (self.keys[at] <= (term << 32) + position + span - 1))
                line, position = line[ok], position[ok]
            for w, p in zip(line.tolist(), position.tolist(), strict=True):
                need: dict[int, int] = {}
                for t in here[w]:
                    if t >= 0:
                        need[int(t)] = need.get(int(t), 0) + 1
                events = []
                for t in need:
                    lo, hi = np.searchsorted(self.keys, [(t << 32) + max(p - span + 1, 0), (t << 32) + p + span])
                    events += [(int(x) & 0xFFFFFFFF, t) for x in self.keys[lo:hi]]
                events.sort()
                have, left, missing = dict.fromkeys(need, 0), 0, len(need)
                for q, t in events:
                    have[t] += 1
                    missing -= have[t] == need[t]
                    while events[left][0] <= q - span:
                        have[events[left][1]] -= 1
                        missing += have[events[left][1]] == need[events[left][1]] - 1
                        left += 1
                    if not missing:
                        found.append((int(live[w]), p))
                        break
        return (np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64))

    def rows_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, position, "right") - 1


def search(index: DataFrame, items: pd.DataFrame, window: int = WINDOW, span: int | None = None) -> DataFrame:
    """One row per document of ``index``: merged hit ranges (pairs of int64, ends excluded), items with an exact
    window, and with ``span`` items with a proximity match.  ``items`` is a bounded block of the benchmark."""
    if window > GAP or (span or 0) > GAP:
        raise ValueError(f"windows and spans are at most {GAP} words")
    shared = index.sparkSession.sparkContext.broadcast(item_windows(items, window))

    def owners(block: dict, windows: np.ndarray) -> list[str]:
        return sorted({x for w in np.unique(windows) for x in block["owners"][block["owner_at"][w] : block["owner_at"][w + 1]]})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        length = (block["terms"] >= 0).sum(1)
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                n = len(seg.ids)
                hits, items_of, near_of = [b""] * n, [[] for _ in range(n)], [[] for _ in range(n)]
                windows, start = seg.phrases(block)
                doc = seg.rows_of(start)
                for d in np.unique(doc):
                    own = doc == d
                    s = start[own] - seg.base[d]
                    hits[d] = merge_ranges(np.stack([s, s + length[windows[own]]], 1)).tobytes()
                    items_of[d] = owners(block, windows[own])
                if span:
                    windows, place = seg.near(block, span)
                    doc = seg.rows_of(place)
                    for d in np.unique(doc):
                        near_of[d] = owners(block, windows[doc == d])
                yield pa.RecordBatch.from_pydict(
                    {"segment": [seg.segment] * n, "row": list(range(n)), "doc_id": seg.ids, "n_words": seg.n_words.tolist(), "hits": hits, "items": items_of, "near_items": near_of},
                    schema=pa.schema([("segment", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))]),
                )

    return index.mapInArrow(match, MATCHES)


def merge_ranges(x: np.ndarray) -> np.ndarray:
    """Disjoint ascending ranges that cover the same integers; touching ranges become one."""
    if not len(x):
        return x.reshape(0, 2).astype(np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    top = np.maximum.accumulate(x[:, 1])
    new = np.concatenate([[True], x[1:, 0] > top[:-1]])
    return np.stack([x[new, 0], top[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)]], 1).astype(np.int64)


def benchmark_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark in blocks of about ``limit`` text bytes; its size is measured first.  Ids are
    text here: pandas would make numbers beside a null inexact."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // limit) + 1
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int | None = 15, limit: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    One pass over the stored index for each block of the benchmark; several passes are merged by row."""
    blocks = benchmark_blocks(items, limit)
    index = cut_lineage(build_index(docs), "postings")
    found = None
    for block in blocks:
        part = search(index, block.toPandas(), window, span)
        found = part if found is None else found.unionAll(part)
    several = len(blocks) > 1

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ranges = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in f["hits"]]
            items_ = [sorted(x) for x in f["items"]]
            n_hit = [int((r[:, 1] - r[:, 0]).sum()) for r in ranges]
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"],
                    "n_words": f["n_words"],
                    "n_hit": n_hit,
                    "n_items": [len(x) for x in items_],
                    "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items_],
                    "contaminated": [x > 0 for x in n_hit],
                    "n_near_items": [len(x) for x in f["near_items"]],
                }
            )

    if several:
        merged = found.groupBy("segment", "row", "doc_id", "n_words").agg(F.collect_list("hits").alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"))

        def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                f["hits"] = [merge_ranges(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in h])).tobytes() for h in f["h"]]
                yield f.drop(columns="h")[[c.name for c in MATCHES]]

        found = merged.mapInPandas(join, MATCHES)
    return found.mapInPandas(final, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long")
