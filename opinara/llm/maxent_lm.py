"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax.

Tokens are runs of bytes that aren't ASCII white space, A-Z lower-cased, and one end token for each text.  Two scores
come out: a smoothed unigram baseline from exact corpus counts, and the model's log10 probability.

Counts.  Every training token is counted: per batch first, then by a shuffle on the token's hash.  The most frequent
``HEAD`` tokens are broadcast (a fixed bound); occurrences of rarer ones are joined with the count table by hash.

Model.  The ``CLASSES * SIZE`` most frequent tokens are classes of ``SIZE`` tokens each, by rank.  All other tokens,
known or not, are one more class, the tail, in which they share ``SIZE`` kinds by their hash; within a kind they keep
their baseline proportions.  P(token) = P(class | context) * P(token or kind | class, context), so every token has both
factors, and the probabilities of all tokens sum to one (with one unknown token for each kind).  Both factors are
log-linear in hashed features of the context: the previous token, the one before it (a skip feature) and both together
(an n-gram feature).  Biases start at the unigram distribution.  The hashed tables grow with the square root of the
training tokens, from ``LEAST_ROWS`` to ``MOST_ROWS`` rows: the upper bound keeps them fit for broadcasting.

Training.  The training texts of each of ``ROUNDS`` rounds (each text in one of them) are dealt out into shards by a
hash of the row; the number of shards follows from the number of training tokens alone.  Each shard takes AdaGrad steps
from the broadcast weights over its texts in the order of their hashes.  The changes, weighted by tokens, are averaged
block by block of the tables, first over ``FAN`` shards, then over those sums: no group grows with the number of tasks,
and the model is the same however many partitions the input has.  Only the averaged weights reach the driver.

Scoring gathers rows of the weight tables for a block of positions at a time in numpy.

Edge cases: null is the empty text (one end token); rows with null or repeated ``doc_id`` are scored one by one, and a
null id belongs to training; without training texts all counts and base scores are 0 and each token has the probability
of its kind; repeated rows have equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textkit as tk
from opinara.llm.grouped import map_groups
from opinara.llm.labelled import held_out
from opinara.session import cut_lineage, small_batches

#: Tokens whose counts are broadcast.
HEAD = 1 << 18
#: Classes of frequent tokens, and tokens of a class; the tail has as many kinds.
CLASSES, SIZE = 63, 64
#: Rows of each hashed weight table: ``LEAST_ROWS`` up to ``ROW_TOKENS`` training tokens.
LEAST_ROWS, MOST_ROWS, ROW_TOKENS = 1 << 13, 1 << 17, 1 << 26
#: Training tokens of a shard up to ``SHARDS`` shards; beyond, shards and their size grow alike.
SHARD_TOKENS, SHARDS = 1 << 20, 32
ROUNDS = 2
STEP = 0.25
#: Positions in one gradient step, and in one block of scoring.
BATCH = 4096
#: Rows of a table whose changes are summed together, and shards that are summed first.
BLOCK_ROWS, FAN = 256, 64
BOUND = 80.0
END = np.uint64(0x1F83D9ABFB41BD6B)
SMOOTH = 0.1


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with END after each text, each text's first token)."""
    for lo, hi, data, offsets in tk.doc_chunks(texts):
        hashes, first = tk.token_hashes(data, offsets, tk.GRAPH)
        n = hi - lo
        out = np.full(len(hashes) + n, END, np.uint64)
        keep = np.ones(len(out), bool)
        keep[first[1:] + np.arange(n)] = False
        out[keep] = hashes
        yield lo, hi, out, first + np.arange(n + 1)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over the training texts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.unique(h, return_counts=True) for _, _, h, _ in tokens(b.column(0))]
            if not parts:
                continue
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
            for s in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + (1 << 18)].view(np.int64)), pa.array(sums[s : s + (1 << 18)])], ["token", "c"])

    counted = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "token long, c long")
    return cut_lineage(counted.groupBy("token").agg(F.sum("c").alias("c")), "counts")


def table_rows(n_tokens: int) -> int:
    """Rows of the hashed tables: powers of two that grow with the square root of the training tokens."""
    bits = round(np.log2(max(n_tokens / ROW_TOKENS, 1.0)) / 2)
    return min(LEAST_ROWS << int(bits), MOST_ROWS)


def shard_count(n_tokens: int) -> int:
    units = -(-n_tokens // SHARD_TOKENS)
    return int(max(1, units if units <= SHARDS else round(SHARDS * (units / SHARDS) ** 0.5)))


class Model:
    """Head counts and weights; everything has a fixed bound.

    ``tail``: occurrences and distinct tokens of each kind beyond the classes."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, n_tokens: int, n_kinds: int, tail: tuple[np.ndarray, np.ndarray]):
        self.head, self.counts, self.n_tokens, self.n_kinds, self.tail = head.astype(np.uint64), counts.astype(np.int64), n_tokens, n_kinds, tail
        self.total = n_tokens + SMOOTH * (n_kinds + 1)
        used = min(len(head), CLASSES * SIZE)
        mass = np.zeros(CLASSES * SIZE)
        mass[:used] = (self.counts[:used] + SMOOTH) / self.total
        # Each kind has one unknown token.
        self.tail_mass = (tail[0] + SMOOTH * (tail[1] + 1)) / self.total
        grid = np.concatenate([mass.reshape(CLASSES, SIZE), self.tail_mass[None]])
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(grid.sum(1)), -60).astype(np.float32)
            self.token_bias = np.where(grid > 0, np.log(np.maximum(grid, 1e-300)), -60).astype(np.float32)
        self.rows = table_rows(n_tokens)
        self.class_weights = np.zeros((self.rows, CLASSES + 1), np.float32)
        self.token_weights = np.zeros((self.rows, SIZE), np.float32)
        self._index: tk.HashIndex | None = None

    def copy(self) -> Model:
        out = Model(self.head, self.counts, self.n_tokens, self.n_kinds, self.tail)
        out.class_weights, out.token_weights = self.class_weights.copy(), self.token_weights.copy()
        return out

    def places(self, hashes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place in it) of each token."""
        frequent = (rank >= 0) & (rank < CLASSES * SIZE)
        return np.where(frequent, rank // SIZE, CLASSES), np.where(frequent, rank % SIZE, (hashes % np.uint64(SIZE)).astype(np.int64))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Each token's rank by frequency, -1 beyond the head."""
        if self._index is None:
            self._index = tk.HashIndex(self.head)
        return self._index.find(hashes)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / self.total)


def context_rows(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashed contexts of each position: previous token, the one before it, both (columns)."""
    n = len(hashes)
    one, two = np.full(n, END, np.uint64), np.full(n, END, np.uint64)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    begin = first[:-1]
    one[begin] = END  # every text has at least its end token
    two[begin] = END
    second = begin[np.diff(first) > 1] + 1
    two[second] = END
    a, b = tk.mix(one + np.uint64(1)), tk.mix(two + np.uint64(2))
    return np.stack([a, b, tk.mix(a * np.uint64(3) + b)], 1)


def class_features(context: np.ndarray, rows: int) -> np.ndarray:
    return (context & np.uint64(rows - 1)).astype(np.int32)


def token_features(context: np.ndarray, klass: np.ndarray, rows: int) -> np.ndarray:
    return (tk.mix(context + (klass + 1)[:, None].astype(np.uint64) * tk.BASE) & np.uint64(rows - 1)).astype(np.int32)


def _logits(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.take(weights, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        out += np.take(weights, rows[:, k], axis=0)
    out += bias
    # Exponentials of what is kept within this bound neither overflow nor vanish in single precision.
    return np.clip(out, -BOUND, BOUND, out=out)


def _log_softmax_at(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    at = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    return at - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def score_positions(model: Model, hashes: np.ndarray, rank: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural log probability of each token; in the tail that of its kind."""
    out = np.empty(len(rank))
    klass, place = model.places(hashes, rank)
    for s in range(0, len(rank), BATCH):
        e = slice(s, s + BATCH)
        k, c = klass[e], context[e]
        out[e] = _log_softmax_at(_logits(model.class_bias, model.class_weights, class_features(c, model.rows)), k).astype(np.float64)
        out[e] += _log_softmax_at(_logits(np.take(model.token_bias, k, axis=0), model.token_weights, token_features(c, k, model.rows)), place[e])
    return out


def _descend(weights: np.ndarray, square: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """One AdaGrad step on the rows of a table; each position's gradient goes to all its feature rows."""
    n = len(rows)
    flat = rows.T.ravel()
    flat = flat.astype(np.uint16) if len(weights) <= 1 << 16 else flat
    order = np.argsort(flat, kind="stable")
    used, source = flat[order], order % n
    start = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
    size = np.diff(np.append(start, len(used)))
    # Rows by falling use: the j-th gradients of all that have more than j are added at once, the few often used summed.
    rank = np.argsort(np.uint16(0xFFFF) - np.minimum(size, 0xFFFF).astype(np.uint16), kind="stable")
    start, size = start[rank], size[rank]
    total = np.take(gradient, source[start], axis=0)
    often = int(np.searchsorted(-size, -16, "left"))
    for s in range(often):
        total[s] = np.take(gradient, source[start[s] : start[s] + size[s]], axis=0).sum(0)
    for j in range(1, 16):
        e = int(np.searchsorted(-size, -j, "left"))
        if e <= often:
            break
        total[often:e] += np.take(gradient, source[start[often:e] + j], axis=0)
    at = used[start].astype(np.int64)
    square[at] += np.einsum("ij,ij->i", total, total) / total.shape[1]
    total *= (STEP / np.sqrt(square[at] + 1e-6))[:, None]
    weights[at] = np.take(weights, at, axis=0) - total


class Learner:
    """AdaGrad over a stream of texts, in steps of ``BATCH`` positions however the texts arrive."""

    def __init__(self, model: Model):
        self.model, self.n = model, 0
        self.square = {"class": np.full(model.rows, 1e-3, np.float32), "token": np.full(model.rows, 1e-3, np.float32)}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, hashes: np.ndarray, first: np.ndarray) -> None:
        klass, place = self.model.places(hashes, self.model.rank(hashes))
        self.held.append((klass, place, context_rows(hashes, first)))
        self.waiting += len(hashes)
        if self.waiting >= BATCH:
            self._steps(last=False)

    def finish(self) -> None:
        if self.waiting:
            self._steps(last=True)

    def _steps(self, last: bool) -> None:
        klass, place, context = (np.concatenate(x) for x in zip(*self.held, strict=True))
        end = len(klass) if last else len(klass) // BATCH * BATCH
        for s in range(0, end, BATCH):
            e = slice(s, min(s + BATCH, end))
            k, c = klass[e], context[e]
            self._step("class", self.model.class_bias, class_features(c, self.model.rows), k)
            self._step("token", np.take(self.model.token_bias, k, axis=0), token_features(c, k, self.model.rows), place[e])
        self.n += end
        self.held, self.waiting = [(klass[end:], place[end:], context[end:])], len(klass) - end

    def _step(self, part: str, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
        weights = getattr(self.model, f"{part}_weights")
        logits = _logits(bias, weights, rows)
        np.exp(logits, out=logits)
        logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
        logits[np.arange(len(target)), target] -= 1
        _descend(weights, self.square[part], rows, logits)


_CHANGE = "block int, part int, n long, change binary"


def _averaged(rows: DataFrame, keys: list[str], kind: type) -> DataFrame:
    """(block, part, n, change) of each group: changes averaged by tokens, in the order of their parts."""

    def add(g: pa.Table) -> pa.RecordBatch:
        g = g.sort_by("part")
        total, n = 0.0, 0
        for m, raw in zip(g.column("n").to_pylist(), g.column("change").to_pylist(), strict=True):
            total, n = total + np.frombuffer(raw, kind).astype(np.float64) * m, n + m
        return pa.RecordBatch.from_pydict({"block": g.column("block")[:1].combine_chunks(), "part": pa.array([g.column("part")[0].as_py() // FAN], pa.int32()), "n": [n], "change": [(total / n).astype(np.float32).tobytes()]})

    return map_groups(rows, keys, add, _CHANGE)


def train_round(docs: DataFrame, model: Model, number: int, rounds: int, shards: int) -> Model:
    """The model after averaging what the shards learnt from this round's texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    blocks = model.rows // BLOCK_ROWS

    def changes(shard: int, learner: Learner) -> Iterator[pa.RecordBatch]:
        learner.finish()
        if not learner.n:
            return
        for k, part in enumerate(("class", "token")):
            change = (getattr(learner.model, f"{part}_weights") - getattr(shared.value, f"{part}_weights")).astype(np.float16)
            raw = [change[b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS].tobytes() for b in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32) + k * blocks), pa.array(np.full(blocks, shard, np.int32)), pa.array(np.full(blocks, learner.n)), pa.array(raw, pa.binary())], ["block", "part", "n", "change"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, learner = -1, None
        for b in batches:
            own = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if learner is None or own[lo] != shard:
                    if learner is not None:
                        yield from changes(shard, learner)
                    shard, learner = int(own[lo]), Learner(shared.value.copy())
                for _, _, hashes, first in tokens(b.column(1).slice(lo, hi - lo)):
                    learner.add(hashes, first)
        if learner is not None:
            yield from changes(shard, learner)

    rows = docs.where(~F.col("held_out") & (F.pmod(F.xxhash64("key", "text"), F.lit(rounds)) == number))
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(number), "text", "key"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("text", "key").alias("at"), "text")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "at").select("shard", "text")
    learnt = dealt.mapInArrow(run, _CHANGE).withColumn("fan", F.floor(F.col("part") / FAN).cast("int"))
    learnt = _averaged(learnt, ["block", "fan"], np.float16)
    if shards > FAN:
        learnt = _averaged(learnt, ["block"], np.float32)
    out = model.copy()
    for r in learnt.collect():  # 2 * blocks rows of BLOCK_ROWS rows of weights: the size of the tables, which is bounded
        table, k = (out.token_weights, r.block - blocks) if r.block >= blocks else (out.class_weights, r.block)
        table[k * BLOCK_ROWS : (k + 1) * BLOCK_ROWS] += np.frombuffer(r.change, np.float32).reshape(BLOCK_ROWS, -1)
    return out


def prepare(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text, held_out) of each document."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), 10, 0).alias("held_out"))


def most_frequent(counts: DataFrame, head: int) -> DataFrame:
    """The tokens above the lowest count that leaves at most ``head`` of them.

    Found from a histogram of counts on a logarithmic scale (under 700 bins) and, in the bin that is cut, of the counts
    themselves; a global top-k would send each task's k best to one place."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 10)
    room, bound = head, 1
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).orderBy(F.desc("level")).collect():
        if r.n <= room:
            room -= r.n
            continue
        bound = r.most + 1
        inner = counts.where(F.col("c").between(r.least, r.most) & (F.col("c") > r.most - 10_000)).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        for q in inner.orderBy(F.desc("c")).collect():
            if q.n > room:
                break
            room, bound = room - q.n, q.c
        break
    return counts.where(F.col("c") >= bound)


def train(rows: DataFrame, counts: DataFrame, rounds: int = ROUNDS, head: int = HEAD) -> Model:
    size = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    top = most_frequent(counts, head).toPandas().sort_values(["c", "token"], ascending=[False, True])
    keys, c = top["token"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    # Sums by kind over all tokens, less those that have a place in a class.
    tail = np.zeros((2, SIZE), np.int64)
    for r in counts.groupBy(F.pmod("token", F.lit(SIZE)).alias("kind")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        tail[:, r.kind] = r.c, r.n
    used = (keys[: CLASSES * SIZE] % np.uint64(SIZE)).astype(np.int64)
    tail[0] -= np.bincount(used, c[: CLASSES * SIZE], SIZE).astype(np.int64)
    tail[1] -= np.bincount(used, minlength=SIZE)
    model = Model(keys, c, int(size.n or 0), int(size.kinds or 0), (tail[0], tail[1]))
    for k in range(rounds if size.n else 0):
        model = train_round(rows, model, k, rounds, shard_count(model.n_tokens))
    return model


def score(rows: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log10 = np.log(10.0)
        tail_log = np.log10(m.tail_mass)
        for b in batches:
            for lo, hi, hashes, first in tokens(b.column(2)):
                rank = m.rank(hashes)
                known = rank >= 0
                base = np.where(known, m.log_base(m.counts[np.maximum(rank, 0)] if len(m.counts) else np.zeros(len(rank))), 0.0)
                value = score_positions(m, hashes, rank, context_rows(hashes, first)) / log10
                outer = (rank < 0) | (rank >= CLASSES * SIZE)
                # Tokens of the tail have their baseline share of their kind; the baseline of rare ones is joined later.
                value += np.where(outer, base - tail_log[(hashes % np.uint64(SIZE)).astype(np.int64)], 0.0)
                rare = [hashes[first[k] : first[k + 1]][~known[first[k] : first[k + 1]]].view(np.int64) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(tk.sums_by(known, first)), pa.array(tk.sums_by(base, first)), pa.array(tk.sums_by(value, first)), pa.array(rare, pa.list_(pa.int64()))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    scored = rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>")
    scored = cut_lineage(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "scores")
    rare = scored.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    log_base = F.log10((F.coalesce("c", F.lit(0)) + SMOOTH) / F.lit(model.total))
    more = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * log_base).alias("base"))
    return scored.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("base", F.lit(0.0))).alias("score"),
    )


def language_scores(docs: DataFrame, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = prepare(docs)
    counts = count_tokens(rows)
    return score(rows, counts, train(rows, counts, rounds, head))
