"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a shorter text is one shingle).  Texts with one and the same word sequence form a
class of copies; only one representative of each class goes on.  Then

1. MinHash signatures of ``K`` values are cut into bands of ``R``; representatives that agree on a band share a bucket.
   A pair at the threshold shares none of the buckets with a probability below 1e-7.
2. Each bucket is named by its least member, its centre.  Members of all buckets of one centre form a group, so a
   cluster that meets in thirty bands is dealt out once or twice, not thirty times.  A pair belongs to the least centre
   that its two members share.
3. Large groups are dealt out as pairs of blocks of about ``BLOCK`` members, so no task holds more than two blocks.
   Inside, signatures are compared a few values at a time; a pair is dropped as soon as the posterior probability that
   its similarity reaches the threshold, under a uniform prior, is below ``TOLERANCE``.
4. Members of remaining pairs bring their shingle sets, and the similarities of the remaining pairs are exact.
   A group reports sums of links and a spanning forest, never its pairs.
5. Connected components over the forests give the class ids.

Edge cases: null, empty and wordless texts have no shingles: each is a class of its own without links.  Rows with a null
or repeated ``doc_id`` are distinct documents.  Ties (several least rows) go to the least row in reading order; an empty
table gives an empty result; other columns are ignored.  ``class_id`` is the least non-null ``doc_id`` of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textkit as tk
from opinara.llm.components import connected_components
from opinara.llm.grouped import map_groups
from opinara.llm.joins import broadcast_if_few, join_by_size, packed, unpacked
from opinara.session import cut_lineage, small_batches

WORDS = 5
THRESHOLD = 0.8
K, R = 128, 4
TOLERANCE = 1e-6
STEPS = (16, 32, 64, 128)
BLOCK = 384

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, K, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, each text's first shingle, number of words, two hashes of the word sequence)."""
    words, first = tk.token_hashes(data, offsets, tk.ALNUM)
    size = np.diff(first)
    texts = len(size)
    sequence = np.zeros((texts, 2), np.uint64)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64), size, sequence
    up, _ = tk.powers(len(words))
    place = np.arange(len(words)) - np.repeat(first[:-1], size)
    full = np.flatnonzero(size > 0)
    for k in (0, 1):
        terms = tk.mix(words + np.uint64(k * 0x51ED270B)) * up[place]
        sequence[full, k] = tk.mix(np.add.reduceat(terms, first[:-1][full]) + size[full].astype(np.uint64))
    many = np.maximum(size - n + 1, (size > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(many)])
    start = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], many)
    length = np.minimum(np.repeat(size, many), n)
    out = np.zeros(len(start), np.uint64)
    for k in range(n):
        use = length > k
        out[use] = tk.mix(out[use] * tk.BASE + words[start[use] + k])
    return out, begin, size, sequence


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values of each text, 16 bits each; zero for texts without shingles."""
    size = np.diff(begin)
    out = np.zeros((len(size), K), np.uint16)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    at = begin[:-1][full]
    for k in range(K):
        least = np.minimum.reduceat((h ^ _XOR[k]) * _MULTIPLY[k], at)
        out[full, k] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    return out


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least number of equal values among n for which P(similarity >= threshold) is at least ``tolerance``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n + 1


def prune(a: np.ndarray, b: np.ndarray, same: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of two signature blocks that survive every step."""
    n = STEPS[0]
    agree = np.zeros((len(a), len(b)), np.uint16)
    for k in range(n):
        agree += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(agree >= least[n])
    if same:
        i, j = i[i < j], j[i < j]
    have = agree[i, j].astype(np.int64)
    for lo, hi in zip(STEPS[:-1], STEPS[1:], strict=True):
        if not len(i):
            break
        for s in range(0, len(i), 1 << 16):  # bounded temporaries
            e = slice(s, s + (1 << 16))
            have[e] += (a[i[e], lo:hi] == b[j[e], lo:hi]).sum(1)
        ok = have >= least[hi]
        i, j, have = i[ok], j[ok], have[ok]
    return i, j


def first_common(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray, centre: int) -> np.ndarray:
    """Whether ``centre`` is the least number that both rows of each pair list; lists are sorted and hold ``centre``."""
    out = np.ones(len(i), bool)
    for at, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        u, v = x[p], y[q]
        if u[0] < centre and v[0] < centre:
            u, v = u[u < centre], v[v < centre]
            out[at] = not np.isin(u, v, assume_unique=True).any()
    return out


def exact_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of the sets of each pair reaches the threshold."""
    out = np.zeros(len(i), bool)
    size = np.array([len(s) for s in sets])
    if len(i) < 4 * len(sets):
        for at, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            lo, hi = sorted((size[p], size[q]))
            if lo >= threshold * hi:
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                out[at] = both >= threshold * (lo + hi - both)
        return out
    # Many pairs: one incidence matrix of the shingles that several members have, multiplied in column blocks.
    doc = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    doc, column = doc[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 1 << 13
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((len(sets), width), np.float32)
        block[doc[s:e], column[s:e] - lo] = 1
        both += block @ block.T
    n = both[i, j].astype(np.float64)
    return n >= threshold * (size[i] + size[j] - n)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
    return np.array([find(x) for x in range(n)], np.int64)


def _sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text_key, n_words, h1, h2, sig): one stored row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tk.doc_chunks(b.column(2)):
                hashes, begin, size, sequence = shingles(data, offsets)
                sig = signatures(hashes, begin)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(size), pa.array(sequence[:, 0].view(np.int64)), pa.array(sequence[:, 1].view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "text_key", "n_words", "h1", "h2", "sig"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), text.alias("text"))
    signed = rows.mapInArrow(run, "doc_id long, text_key long, n_words long, h1 long, h2 long, sig binary")
    return cut_lineage(signed.select(F.monotonically_increasing_id().alias("row"), "*"), "signatures")


def text_key(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, rep): a hash of each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = tk.mix(np.arange(1, K // R + 1, dtype=np.uint64) * tk.BASE)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, K // R)
            keys = tk.mix(sig ^ salt)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), K // R))], ["bucket", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "bucket long, rep long")


def _groups(reps: DataFrame) -> DataFrame:
    """(centre, lo, hi, rep, block, centres): members of each pair of blocks of each centre's group."""
    bands = _bands(reps)
    full = bands.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    member = cut_lineage(join_by_size(bands, full, ["bucket"]).select("centre", "rep").distinct(), "members")
    centres = member.groupBy("rep").agg(F.array_sort(F.collect_list("centre")).alias("centres"))  # at most K / R each
    sizes = member.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)  # other groups are one block
    dealt = join_by_size(member, sizes, ["centre"], how="left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")).drop("n")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("centre", F.least("block", "other").cast("int").alias("lo"), F.greatest("block", "other").cast("int").alias("hi"), "rep", "block")
    return paired.join(centres, "rep")


def _blocks(block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(block == lo), np.flatnonzero(block == hi)


def candidates(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(centre, lo, hi, rep, block, centres, sig): members of at least one pair that pruning leaves."""
    least = {n: least_matches(n, threshold, tolerance) for n in STEPS}
    schema = "centre long, lo int, hi int, rep long, block int, centres array<long>, sig binary"

    def run(g: pa.Table) -> pa.RecordBatch | None:
        g = g.combine_chunks()
        lo, hi, centre = g.column("lo")[0].as_py(), g.column("hi")[0].as_py(), g.column("centre")[0].as_py()
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint16).reshape(-1, K)
        a, b = _blocks(g.column("block").to_numpy(), lo, hi)
        i, j = prune(sig[a], sig[b], lo == hi, least)
        if not len(i):
            return None
        keep = np.unique(np.concatenate([a[i], b[j]]))
        out = g.take(pa.array(keep)).select(schema_names)
        return out.to_batches()[0] if out.num_rows else None

    schema_names = [x.split()[0] for x in schema.split(", ")]
    rows = _groups(reps).join(reps.select("rep", "sig"), "rep")
    return map_groups(rows, ["centre", "lo", "hi"], run, schema)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, items): sorted distinct shingle hashes of the wanted representatives (rep, doc_id, text_key)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    want = wanted.select("rep", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    joined = own.join(broadcast_if_few(want), F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tk.doc_chunks(b.column(1)):
                hashes, begin, _, _ = shingles(data, offsets)
                sets = [np.unique(hashes[begin[k] : begin[k + 1]]).tobytes() for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["rep", "items"])

    # Copies of one row (same id, same text) give the same set; one is kept.
    return joined.select("rep", "text").mapInArrow(run, "rep long, items binary").groupBy("rep").agg(F.first("items").alias("items"))


def verified(found: DataFrame, sets: DataFrame, sizes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(rep, links, root): each group's exact sums of linked documents and its spanning forest."""
    least = {n: least_matches(n, threshold, tolerance) for n in STEPS}

    def run(g: pa.Table) -> pa.RecordBatch | None:
        g = g.sort_by("rep").combine_chunks()
        lo, hi, centre = g.column("lo")[0].as_py(), g.column("hi")[0].as_py(), g.column("centre")[0].as_py()
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint16).reshape(-1, K)
        rep, weight = g.column("rep").to_numpy(), g.column("n").to_numpy()
        a, b = _blocks(g.column("block").to_numpy(), lo, hi)
        i, j = prune(sig[a], sig[b], lo == hi, least)
        i, j = a[i], b[j]
        lists = [np.array(x, np.int64) for x in g.column("centres").to_pylist()]
        ok = first_common(lists, lists, i, j, centre)
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        items = [np.frombuffer(x, np.uint64) for x in g.column("items").to_pylist()]
        ok = exact_pairs(items, i, j, threshold)
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        links = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
        root = forest(len(rep), i, j)
        keep = links > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(links[keep].astype(np.int64)), pa.array(rep[root[keep]])], ["rep", "links", "root"])

    rows = found.join(sets, "rep").join(sizes, "rep")
    return map_groups(rows, ["centre", "lo", "hi"], run, "rep long, links long, root long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, doc_id, text_key, class_id, n_links (documents with a similarity of at least
    ``threshold``, copies included), copy_of (least doc_id with the same word sequence), n_words, first (whether it is
    the row that stands for its class)."""
    small_batches(docs.sparkSession)
    signed = _sign(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "row")
    classes = signed.where("n_words > 0").groupBy("h1", "h2").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n"))
    classes = cut_lineage(classes.select("h1", "h2", F.col("least.row").alias("rep"), F.col("least.doc_id").alias("rep_id"), F.col("least.text_key").alias("rep_key"), "n"), "classes")
    reps = cut_lineage(signed.select(F.col("row").alias("rep"), "sig").join(classes.select("rep"), "rep"), "representatives")
    found = cut_lineage(candidates(reps, threshold, tolerance), "candidates")
    wanted = classes.join(found.select("rep").distinct(), "rep").select("rep", F.col("rep_id").alias("doc_id"), F.col("rep_key").alias("text_key"))
    sets = _shingle_sets(docs, wanted, id_col, text_col)
    links = cut_lineage(verified(found, sets, classes.select("rep", "n"), threshold, tolerance), "links")
    roots = connected_components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    totals = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(totals, "rep", "left").join(roots.withColumnRenamed("u", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = cut_lineage(named, "named")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), F.col("rep_id").alias("id"), "rep_key", "rep")).alias("best"), F.count(F.lit(1)).alias("reps")).where("reps > 1")
    whole = join_by_size(named, best, ["root"], "reps", "left")
    class_id = F.when(F.col("best").isNotNull(), F.col("best.id")).otherwise(F.col("rep_id"))
    whole = whole.select("h1", "h2", "n", "rep", "rep_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), class_id.alias("class_id"), F.coalesce("best.rep", "rep").alias("best"))
    worded = join_by_size(signed.drop("sig").where("n_words > 0"), whole, ["h1", "h2"], how="left")
    out = worded.unionByName(signed.drop("sig").where("n_words = 0"), allowMissingColumns=True)  # all of one key, never joined
    alone = F.col("n_words") == 0
    return out.select(
        "row",
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("copy_of"),
        "n_words",
        (alone | (F.col("row") == F.col("best"))).alias("first"),
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but the first document of each class; columns unchanged, of any name.

    The rows to drop are counted by (doc_id, text); of identical rows the one of least JSON text stays where one is to
    stay.  Null, empty and wordless texts all stay; an empty table stays empty."""
    marked = near_duplicates(docs, **options).groupBy("doc_id", "text_key").agg(F.count_if(~F.col("first")).alias("drop"), F.count(F.lit(1)).alias("rows"))
    gone = cut_lineage(marked.where("drop > 0").select("doc_id", "text_key", (F.col("rows") - F.col("drop")).alias("stay")), "removed")
    rows = packed(docs, id=F.col("doc_id").cast("long"), key=text_key(F.col("text")))
    match = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    whole = unpacked(rows.join(broadcast_if_few(gone), match, "left_anti"))
    mixed = gone.where("stay > 0")
    if not mixed.take(1):
        return whole
    # Identical rows (one id, one text) of which the first of the class is one.
    some = rows.join(broadcast_if_few(mixed), match).groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return whole.unionAll(unpacked(some))
