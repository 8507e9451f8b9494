"""Keyword vectors: anchors, centroids, similarities, neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import stats
from opinara.functions.arrays import list_matrix
from opinara.functions.scalar import cosine, dot, norm
from opinara.operators.ranks import running_sums
from opinara.session import cut_lineage, small_batches

#: Topics at most where topic rows are broadcast: a bound on centroids and anchors.
MAX_TOPICS = 10_000
#: Rows on each side of a block of pairs; rows that are compared at once.
PAIR_BLOCK, STRIP = 1000, 32


def lookup(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Words with their vectors; unknown words keep null, for coverage counts."""
    return words.join(vectors, "word", "left")


def coverage(words: DataFrame, vectors: DataFrame) -> DataFrame:
    return lookup(words, vectors).groupBy("topic").agg(F.count(F.lit(1)).alias("words"), F.count("vector").alias("known"))


def centroids(rows: DataFrame, weighted: bool = True, unit: bool = False) -> DataFrame:
    """topic, n, weight_sum, centroid: means by dimension, summed in map tasks first."""
    v = F.transform("vector", lambda x: x / norm(F.col("vector"))) if unit else F.col("vector")
    w = F.col("weight") if weighted else F.lit(1.0)
    flat = rows.where("vector is not null").select("topic", w.alias("w"), F.posexplode(v).alias("dim", "x"))
    per = flat.groupBy("topic", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("ws"), F.sum(F.col("w") * F.col("x")).alias("s"))
    packed = per.groupBy("topic").agg(F.max("n").alias("n"), F.max("ws").alias("weight_sum"), F.array_sort(F.collect_list(F.struct("dim", (F.col("s") / F.col("ws")).alias("v")))).alias("c"))
    return packed.select("topic", "n", "weight_sum", F.transform("c", lambda x: x["v"]).alias("centroid"))


def checked_topics(rows: DataFrame) -> DataFrame:
    if rows.limit(MAX_TOPICS + 1).count() > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    return rows


def centroid_similarity(centroid: DataFrame) -> DataFrame:
    """(t1 < t2, similarity) of topic centroids."""
    a = checked_topics(centroid).select(F.col("topic").alias("t1"), F.col("centroid").alias("a"))
    b = centroid.select(F.col("topic").alias("t2"), F.col("centroid").alias("b"))
    return a.join(F.broadcast(b), F.col("t1") < F.col("t2")).select("t1", "t2", cosine(F.col("a"), F.col("b")).alias("similarity"))


def anchor_scores(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(word, topic, anchor_sim, other_sim): each word's cosine to its own topic's anchor and its best one to another's.

    ``anchors`` (topic, anchor) are few; each word meets them in one array."""
    packed = checked_topics(anchors).agg(F.collect_list(F.struct("topic", "anchor")).alias("anchors"))
    sims = rows.join(F.broadcast(packed)).withColumn("s", F.transform("anchors", lambda a: F.struct(a["topic"].alias("topic"), cosine(F.col("vector"), a["anchor"]).alias("sim"))))
    own = F.element_at(F.filter("s", lambda x: x["topic"] == F.col("topic")), 1)["sim"]
    other = F.array_max(F.transform(F.filter("s", lambda x: x["topic"] != F.col("topic")), lambda x: x["sim"]))
    return sims.select("word", "topic", own.alias("anchor_sim"), other.alias("other_sim"))


def anchor_select(rows: DataFrame, anchors: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Words whose cosine to their own topic's anchor passes and beats all other anchors; a topic of none keeps its best."""
    scored = anchor_scores(rows, anchors).withColumn("passes", (F.col("anchor_sim") >= threshold) & (F.col("anchor_sim") > F.coalesce("other_sim", F.lit(-1.0))))
    w = Window.partitionBy("topic")
    best = F.row_number().over(w.orderBy(F.desc("anchor_sim"), "word")) == 1
    ranked = scored.withColumn("_any", F.max("passes").over(w)).withColumn("_best", best)
    return ranked.where("passes or (not _any and _best)").select("word", "topic", "anchor_sim", "other_sim", "passes")


def keyword_cap(selected: DataFrame, k: int = 5, floor: float = 0.4) -> DataFrame:
    """At most k words of a topic by anchor similarity, all but the first at least ``floor``."""
    w = Window.partitionBy("topic").orderBy(F.desc("anchor_sim"), "word")
    return selected.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & ((F.col("rank") == 1) | (F.col("anchor_sim") >= floor)))


def keyword_rules(rows: DataFrame, threshold: float = 0.30, shared: float = 0.50, dropped: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """Candidate words (topic, word, df, anchor_sim, other_sim) that pass all rules, with ``selected_by``.

    The similarity to the own anchor reaches ``threshold`` and beats all other anchors; a word of several topics (df above
    1) needs ``shared``; words that a review dropped (topic, word) don't count, those it added (topic, word, anchor_sim,
    other_sim) do; a topic of none keeps its best candidate."""
    ok = (F.col("anchor_sim") >= threshold) & (F.col("anchor_sim") > F.coalesce("other_sim", F.lit(-2.0))) & ((F.col("df") == 1) | (F.col("anchor_sim") >= shared))
    cand = rows.withColumn("passes", F.coalesce(ok, F.lit(False)))
    if dropped is not None:
        cand = cand.join(F.broadcast(checked_topics(dropped.select("topic", "word").distinct().withColumn("_out", F.lit(True)))), ["topic", "word"], "left")
        cand = cand.withColumn("passes", F.col("passes") & F.col("_out").isNull()).drop("_out")
    columns = ["topic", "word", "anchor_sim", "other_sim", "selected_by"]
    kept = cand.where("passes").withColumn("selected_by", F.lit("rule")).select(*columns)
    if added is not None:
        new = added.select("topic", "word", "anchor_sim", "other_sim", F.lit("review").alias("selected_by")).join(kept.select("topic", "word"), ["topic", "word"], "left_anti")
        kept = kept.unionByName(new)
    best = cand.groupBy("topic").agg(F.max(F.struct("anchor_sim", F.struct("word", "other_sim").alias("w"))).alias("b"))
    empty = best.join(kept.select("topic").distinct(), "topic", "left_anti")
    fallback = empty.select("topic", F.col("b.w.word").alias("word"), F.col("b.anchor_sim").alias("anchor_sim"), F.col("b.w.other_sim").alias("other_sim"), F.lit("fallback").alias("selected_by"))
    return kept.unionByName(fallback)


def keyword_top(selected: DataFrame, anchors: DataFrame, k: int = 5, floor: float = 0.40) -> DataFrame:
    """The main keyword set of each topic: its anchor first, then at most k - 1 words (topic, word, anchor_sim) by similarity
    to it, without those below ``floor`` and without fragments: words all of whose tokens are in a longer keyword."""
    from opinara.functions.scalar import fragment_of_longer

    own = selected.join(F.broadcast(checked_topics(anchors.select("topic", "anchor"))), "topic").where(F.col("word") != F.col("anchor"))
    # A topic's keywords are a short list.
    lists = own.groupBy("topic").agg(F.collect_set("word").alias("_all"))
    words = own.join(lists, "topic").withColumn("_all", F.array_append("_all", F.col("anchor")))
    ok = words.where(~fragment_of_longer(F.col("word"), F.col("_all")) & (F.col("anchor_sim") >= floor)).select("topic", "word", "anchor_sim", F.lit("rule").alias("kind"))
    whole = ok.unionByName(anchors.select("topic", F.col("anchor").alias("word"), F.lit(1.0).alias("anchor_sim"), F.lit("anchor").alias("kind")))
    w = Window.partitionBy("topic").orderBy(F.col("kind") != "anchor", F.desc("anchor_sim"), "word")
    return whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Words without content of their own in a phrase (fixed values).
PHRASE_STOP = ("a", "an", "the", "of", "to", "for", "in", "on", "and", "or", "towards", "toward", "with", "by", "at", "from")


def phrase_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """``words`` (word) with vector and source: the word itself, its tokens joined by underscores, or the mean over those
    content words that have a vector; null if none does."""
    w = words.select("word").distinct()
    key = F.regexp_replace("word", " ", "_")
    exact = w.join(vectors.select("word", F.col("vector").alias("v1")), "word", "left")
    joined = exact.withColumn("_key", key).join(vectors.select(F.col("word").alias("_key"), F.col("vector").alias("v2")), "_key", "left").drop("_key")
    parts = joined.where("v1 is null and v2 is null and contains(word, ' ')").select("word", F.explode(F.split("word", " +")).alias("part")).where(~F.lower("part").isin(*PHRASE_STOP))
    found = parts.join(vectors.select(F.col("word").alias("part"), "vector"), "part").select("word", F.posexplode("vector").alias("dim", "x"))
    mean = found.groupBy("word", "dim").agg(F.avg("x").alias("x")).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v3"))
    out = joined.join(mean, "word", "left")
    source = F.when(F.col("v1").isNotNull(), "word").when(F.col("v2").isNotNull() & F.col("word").contains(" "), "phrase").when(F.col("v3").isNotNull(), "composed")
    asd = lambda c: F.col(c).cast("array<double>")
    vector = F.when(source == "word", asd("v1")).when(source == "phrase", asd("v2")).when(source == "composed", asd("v3"))
    return out.select("word", vector.alias("vector"), source.alias("source"))


def cached_vectors(words: DataFrame, cache: DataFrame, provider) -> DataFrame:
    """(word, vector, cached) of the distinct words: from the cache table, else from ``provider``, a function from a list of
    words to a list of vectors that runs once per Arrow batch of words the cache lacks; append those rows to the cache."""
    own = words.select("word").where("word is not null").distinct()
    known = cache.select("word", F.col("vector").cast("array<double>").alias("vector"))
    hit = own.join(known, "word").select("word", "vector", F.lit(True).alias("cached"))
    miss = own.join(known.select("word"), "word", "left_anti")

    def run(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"word": f["word"], "vector": [list(map(float, v)) for v in provider(f["word"].tolist())], "cached": False})

    return hit.unionAll(miss.mapInPandas(run, f"word {dict(words.dtypes)['word']}, vector array<double>, cached boolean"))


def subset_projection(centroid: DataFrame, largest: int = 12) -> DataFrame:
    """(topic, size, subset, residual, angle): for each topic and subset size, the other topics whose unit centroids' span
    leaves least of its own.  All subsets are tried: 2 ** topics of them, one topic a group, at most ``largest`` topics."""
    rows = centroid.select("topic", "centroid")
    n = rows.count()
    if n > largest:
        raise ValueError(f"{n} topics have too many subsets; at most {largest}")
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("topic", "centroid"))).alias("all_topics"))
    kind = dict(rows.dtypes)["topic"]

    def run(frames):
        for f in frames:
            for topic, every in zip(f["topic"], f["all_topics"], strict=True):
                names = [r["topic"] for r in every]
                x = np.array([r["centroid"] for r in every], np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                at = names.index(topic)
                rest = [k for k in range(len(names)) if k != at]
                found = stats.subset_residuals(x[at], x[rest])
                yield pd.DataFrame({"topic": topic, "size": [s for s, _, _ in found], "subset": [[names[rest[k]] for k in c] for _, c, _ in found], "residual": [r for _, _, r in found], "angle": [float(np.degrees(np.arcsin(min(1.0, r)))) for _, _, r in found]})

    return rows.select("topic").join(F.broadcast(packed)).repartition(max(n, 1), "topic").mapInPandas(run, f"topic {kind}, size int, subset array<{kind}>, residual double, angle double")  # one row


def centroid_conditioning(centroid: DataFrame) -> DataFrame:
    """topics, rank and condition of the unit centroids."""
    rows = checked_topics(centroid).orderBy("topic").toPandas()
    x = np.array(rows["centroid"].tolist(), np.float64)
    rank, condition = stats.conditioning(x / np.linalg.norm(x, axis=1, keepdims=True))
    return centroid.sparkSession.createDataFrame([(len(x), rank, condition)], "topics int, rank int, condition double")


def point_distances(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, word, distance) between complete coordinate rows; rows with a missing coordinate have none, and pairs of different
    lengths a null distance.

    Both sides are packed into blocks of about ``PAIR_BLOCK`` rows, one row a block; a task holds one block of points and streams the
    blocks of queries past it in arrays, so that there may be any number of either and no block is copied in a shuffle.  Only
    what is returned grows with queries times points."""
    small_batches(points.sparkSession)
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v.cast("double"))) & F.col("word").isNotNull()
    sides = [rows.where(whole).select("word", F.col("vector").cast("array<double>").alias("vector")) for rows in (queries, points)]
    kinds = [dict(rows.dtypes)["word"] for rows in sides]
    blocks = [max(1, -(-s.count() // PAIR_BLOCK)) for s in sides]

    def packed(side: int, names: tuple[str, str]) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks() if (held := [b for b in batches if b.num_rows]) else []
            for s in range(0, len(t), 2 * PAIR_BLOCK):
                parts = [t.column(c).chunk(0)[s : s + 2 * PAIR_BLOCK] for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in parts], names=list(names))

        return sides[side].repartition(blocks[side], F.xxhash64("word")).mapInArrow(pack, f"{names[0]} array<{kinds[side]}>, {names[1]} array<array<double>>")

    def matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(vectors.offsets.to_numpy())
        x = np.zeros((len(size), max(width, int(size.max(initial=0)))))
        x[np.arange(x.shape[1])[None] < size[:, None]] = vectors.flatten().to_numpy()
        return x, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                word, vector, query, asked = (b.column(c)[k].values for c in range(4))
                x, size = matrix(vector, 0)
                q, sizes = matrix(asked, x.shape[1])
                x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
                ids, columns = [v.to_numpy(zero_copy_only=False) for v in (query, word)], np.ascontiguousarray(x.T)
                for s in range(0, len(q), 4 * STRIP):
                    some = slice(s, s + 4 * STRIP)
                    out = np.empty((len(q[some]), len(x)))
                    for r in range(0, len(out), STRIP):
                        total = np.zeros((len(out[r : r + STRIP]), len(x)))
                        for c in range(len(columns)):
                            d = columns[c][None] - q[some][r : r + STRIP, c][:, None]
                            d *= d
                            total += d
                        out[r : r + STRIP] = np.sqrt(total)
                    i, j = np.nonzero(ids[0][some, None] != ids[1][None])
                    alike = sizes[some][i] == size[j]
                    yield pa.RecordBatch.from_arrays([query.take(pa.array(s + i)), word.take(pa.array(j)), pa.array(out[i, j], mask=~alike)], names=["query", "word", "distance"])

    # The blocks of queries are read again for every block of points, so they are stored.
    asked = cut_lineage(packed(0, ("q", "asked")), "queries").coalesce(-(-blocks[0] // 64))
    both = packed(1, ("word", "vector")).hint("shuffle_replicate_nl").crossJoin(asked)
    return both.mapInArrow(run, f"query {kinds[0]}, word {kinds[1]}, distance double")


def twonn_dimension(neighbours: DataFrame, drop: float = 0.02) -> DataFrame:
    """Two-nearest-neighbour dimension from ranks 1 and 2: slope through the origin of -log(1 - ECDF) over log ratios.

    Points whose nearest neighbour is at the smallest distances (a share ``drop``) are left out; null below 30 points."""
    ok = neighbours.where("distance > 0")
    two = ok.groupBy("word").agg(F.min("distance").alias("r1"), F.element_at(F.array_sort(F.collect_list("distance")), 2).alias("r2")) if "rank" not in neighbours.columns else ok.groupBy("word").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("r2"))
    # Stored: the neighbours cost far more than their two distances, and are read three times below.
    return twonn_of(cut_lineage(two.where("r1 is not null and r2 is not null"), "two"), drop)


def twonn_of(two: DataFrame, drop: float = 0.02) -> DataFrame:
    """``twonn_dimension`` from the two distances (word, r1, r2) of each point, which are read three times."""
    all_ = two.agg(F.count(F.lit(1)).alias("all_points"), F.percentile("r1", F.lit(drop)).alias("q"))
    kept = two.join(F.broadcast(all_)).where(F.col("r1") > F.col("q")).select("word", "all_points", F.log(F.col("r2") / F.col("r1")).alias("x"))  # one row
    n = kept.count()
    ranked = running_sums(kept.withColumn("_one", F.lit(1)), [], ["x", "word"], "_one", "i")
    share = F.least(F.greatest(F.col("i") / F.lit(float(max(n, 1))), F.lit(1e-9)), F.lit(1 - 1e-9))
    y = -F.log(1 - share)
    out = ranked.agg(F.count(F.lit(1)).alias("points"), F.try_divide(F.sum(F.col("x") * y), F.sum(F.col("x") * F.col("x"))).alias("d"), F.max("all_points").alias("all_points"))
    return out.select("points", F.when(F.col("all_points") >= 30, F.col("d")).alias("dimension"))


def _dealt_blocks(values: DataFrame, bags: Sequence[tuple[Sequence[str], float]], key: str) -> tuple[DataFrame, list, str]:
    """Rows (first, second, block, key, x) dealt so that every two blocks of rows meet in one group; the bags as column
    numbers; the type of the key."""
    from opinara.operators.dimension import topic_arrays

    names = sorted({t for topics, _ in bags for t in topics})
    rows = topic_arrays(values, names, key)
    n_blocks = max(1, -(-values.where(F.col(key).isNotNull() & F.col("value").isNotNull()).select(key).distinct().count() // PAIR_BLOCK))
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")
    at = {t: k for k, t in enumerate(names)}
    return dealt, [([at[t] for t in topics], float(k)) for topics, k in bags], dict(values.dtypes)[key]


def _block_pairs(f: pd.DataFrame, key: str, columns: list, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of both blocks of a group, and the distances and common topics of their pairs; nan where there is none, and for
    a block with itself on and below the diagonal."""
    ids = f[key].to_numpy()
    x = np.array(f["x"].tolist(), np.float64)
    left, right = (np.flatnonzero(f["block"].to_numpy() == f[c].iloc[0]) for c in ("first", "second"))
    found, shared = _bag_distances(x[left], x[right], columns, least)
    if f["first"].iloc[0] == f["second"].iloc[0]:
        found[np.tril_indices(len(found))] = np.nan
    return ids[left], ids[right], found, shared


def pair_distances(values: DataFrame, bags: Sequence[tuple[Sequence[str], float]], key: str = "user_id", least: int = 2) -> DataFrame:
    """(a < b, common, distance) of all pairs of rows that share ``least`` topics of a bag (topics, K), any number of rows.

    Rows are dealt into blocks by hash and every two blocks meet in one task's arrays, of ``PAIR_BLOCK`` rows a side, so no
    row per pair and topic is made.  The distance of a pair in a bag is sqrt(K / c * sum of squares over its c common
    topics); the result is the median over the bags that have one, ``common`` the count of the first bag.  ``values``
    has one row for each key and topic; null keys and values are left out."""
    dealt, columns, kind = _dealt_blocks(values, bags, key)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        left, right, found, shared = _block_pairs(f, key, columns, least)
        i, j = np.nonzero(~np.isnan(found))
        a, b = left[i], right[j]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "common": shared[i, j], "distance": found[i, j]})

    return dealt.groupBy("first", "second").applyInPandas(run, f"a {kind}, b {kind}, common long, distance double")


def nearest_pairs(values: DataFrame, bags: Sequence[tuple[Sequence[str], float]], k: int, key: str = "user_id", least: int = 2) -> DataFrame:
    """(word, neighbour, distance, rank): the k nearest rows at a positive distance, by the distances of ``pair_distances``.

    How they are found is told in ``incomplete``."""
    from opinara.operators.incomplete import nearest_lists

    found = nearest_lists(values, bags, k, key, least).select("word", F.posexplode(F.arrays_zip("neighbours", "distances")).alias("at", "f"))
    return found.select("word", F.col("f.neighbours").alias("neighbour"), F.col("f.distances").alias("distance"), (F.col("at") + 1).alias("rank"))


def query_distances(values: DataFrame, queries: DataFrame, bags: Sequence[tuple[Sequence[str], float]], key: str = "user_id", least: int = 2) -> DataFrame:
    """(a, b, common, distance) of a stated set of query rows a with all other rows b, as in ``pair_distances``.

    Both sides are packed into blocks of about ``PAIR_BLOCK`` rows, one row a block, which is all that is shuffled; the product of the
    blocks meets in arrays, so no row per pair and topic is made, no block is copied in a shuffle and nothing goes through the
    driver.  Only what is returned grows with queries times rows."""
    from opinara.operators.dimension import topic_arrays

    small_batches(values.sparkSession)

    names = sorted({t for topics, _ in bags for t in topics})
    at = {t: k for k, t in enumerate(names)}
    columns = [([at[t] for t in topics], float(k)) for topics, k in bags]
    kind = dict(values.dtypes)[key]
    sides = [topic_arrays(rows, names, key) for rows in (queries, values)]
    blocks = [max(1, -(-s.count() // PAIR_BLOCK)) for s in sides]

    def packed(side: int, names_: tuple[str, str], parts: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(blocks[side])).cast("int")
        rows = sides[side].select(block.alias("block"), F.struct(F.col(key).alias("id"), "x").alias("r")).repartition(parts, "block")
        return rows.groupBy("block").agg(F.collect_list("r").alias("r")).select(F.col("r.id").alias(names_[0]), F.col("r.x").alias(names_[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in batches:
            for k in range(pair.num_rows):
                a, x, b, y = (pair.column(c)[k].values for c in ("a", "x", "b", "y"))
                ids = [v.to_numpy(zero_copy_only=False) for v in (a, b)]
                x, y = list_matrix(x), list_matrix(y)
                for s in range(0, len(x), 8 * STRIP):
                    found, common = _bag_distances(x[s : s + 8 * STRIP], y, columns, least)
                    i, j = np.nonzero(~np.isnan(found) & (ids[0][s : s + 8 * STRIP, None] != ids[1][None]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[0][s + i], a.type), pa.array(ids[1][j], b.type), pa.array(common[i, j]), pa.array(found[i, j])], names=["a", "b", "common", "distance"])

    both = packed(1, ("b", "y"), min(blocks[1], 2000)).crossJoin(packed(0, ("a", "x"), -(-blocks[0] // 64)))
    return both.mapInArrow(run, f"a {kind}, b {kind}, common long, distance double")


def _bag_distances(left: np.ndarray, right: np.ndarray, columns: list, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians over the bags of the corrected distances of every left with every right row, nan where no bag has one, and the
    first bag's numbers of common topics.  Bags that are alike are computed once."""
    seen = [np.ascontiguousarray((~np.isnan(x)).astype(np.float64).T) for x in (left, right)]
    flat = [np.ascontiguousarray(np.nan_to_num(x, nan=0.0).T) for x in (left, right)]
    once: dict[tuple, np.ndarray] = {}
    shared = None
    d, both = (np.empty((len(left), len(right))) for _ in range(2))
    for use, k in columns:
        name = (*use, k)
        if name in once:
            continue
        s, common = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
        for c in use:
            np.multiply(seen[0][c][:, None], seen[1][c][None], out=both)
            np.subtract(flat[0][c][:, None], flat[1][c][None], out=d)
            d *= d
            d *= both
            common += both
            s += d
        shared = common.astype(np.int64) if shared is None else shared
        s *= k
        s /= np.maximum(common, 1, out=both)
        np.sqrt(s, out=s)
        s[common < least] = np.nan
        once[name] = s
    if len(once) == 1:
        return next(iter(once.values())), shared
    found = np.sort(np.stack([once[(*use, k)] for use, k in columns]), 0)  # missing ones last
    n = (~np.isnan(found)).sum(0)
    middle = [np.take_along_axis(found, np.clip(m, 0, len(found) - 1)[None], 0)[0] for m in ((n - 1) // 2, n // 2)]
    return np.where(n > 0, (middle[0] + middle[1]) / 2, np.nan), shared


def missing_corrected_distance(values: DataFrame, key: str = "user_id", n_topics: int | None = None, least: int = 2) -> DataFrame:
    """(a < b, common, distance) between rows with missing entries: d2 = K / c * sum of squares over c common topics.

    All pairs that have ``least`` common topics, of any number of rows."""
    topics = [r.topic for r in checked_topics(values.select("topic").where("topic is not null").distinct()).collect()]
    return pair_distances(values, [(topics, float(n_topics or len(topics)))], key, least)


def semantic_rank(centroid: DataFrame, centred: bool = False) -> DataFrame:
    """Participation ratio, exponential rank, first share and mean cosine of the unit centroids' Gram matrix."""
    rows = checked_topics(centroid).orderBy("topic").toPandas()
    x = np.array(rows["centroid"].tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if centred:
        x = x - x.mean(0)
    g = x @ x.T
    s = stats.spectrum(g)
    values = np.linalg.eigvalsh(g)
    n = len(g)
    out = pd.DataFrame([{"topics": n, "pr": s["pr"], "erank": s["erank"], "first_share": float(values.max() / values[values > 0].sum()), "mean_cosine": float((g.sum() - np.trace(g)) / max(n * (n - 1), 1))}])
    return centroid.sparkSession.createDataFrame(out)


def subspace_residuals(rows: DataFrame, centroid: DataFrame, k: int = 5) -> DataFrame:
    """Per topic: length of its centroid outside the span of its own k heaviest words, and its angle."""
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        r = stats.subspace_residual(np.array(f["centroid"].iloc[0], np.float64), np.array(f.sort_values("_n")["vector"].tolist(), np.float64))
        return pd.DataFrame({"topic": [f["topic"].iloc[0]], "k": [len(f)], "residual": [r], "angle": [float(np.degrees(np.arcsin(min(1.0, r))))]})

    return top.join(F.broadcast(checked_topics(centroid).select("topic", "centroid")), "topic").groupBy("topic").applyInPandas(run, "topic int, k int, residual double, angle double")


def word_matching(rows: DataFrame, pairs: Sequence[tuple[int, int]], k: int = 10) -> DataFrame:
    """Greedy one-to-one word matches of given topic pairs, among their k heaviest words."""
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("topic", "word", "vector")
    which = rows.sparkSession.createDataFrame([(f"{a}_{b}", a, b) for a, b in pairs], "pair string, a int, b int")
    side = which.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("topic")), F.struct(F.lit(1).alias("side"), F.col("b").alias("topic")))).alias("s")).select("pair", "s.*")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        vectors = {str(x): np.array(v, np.float64) for x, v in zip(f["word"], f["vector"], strict=True)}
        a, b = (sorted(map(str, f[f["side"] == s]["word"])) for s in (0, 1))
        out = pd.DataFrame(stats.greedy_matching(a, b, vectors), columns=["word_a", "word_b", "similarity"])
        return out.assign(pair=f["pair"].iloc[0])[["pair", "word_a", "word_b", "similarity"]]

    return side.join(top, "topic").groupBy("pair").applyInPandas(run, "pair string, word_a string, word_b string, similarity double")


def centroid_agreement(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """(topic, cosine, least): how well rebuilt centroids (topic, centroid) agree with stored ones, and the least over all topics.

    Topics that only one side has get a null cosine, and so do centroids of no length or of another number of components;
    ``least`` is over the rest."""
    both = rebuilt.select("topic", F.col("centroid").alias("a")).join(stored.select("topic", F.col("centroid").alias("b")), "topic", "full")
    rows = both.select("topic", F.when(F.size("a") == F.size("b"), cosine(F.col("a"), F.col("b"))).alias("cosine"))
    return rows.join(F.broadcast(rows.agg(F.min("cosine").alias("least"))))  # one row


def cosine_pairs(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of each row with each of a few given vectors (query, qvector)."""
    return rows.join(F.broadcast(checked_topics(queries)), F.lit(True)).select("word", "query", cosine(F.col("vector"), F.col("qvector")).alias("similarity"), dot(F.col("vector"), F.col("qvector")).alias("dot"))
