"""Language identification by prediction by partial matching (PPM).

For every language the training bytes build a variable-order context tree: for each context of up to ``ORDER`` bytes
the counts of the bytes that followed it.  The statistics are then frozen.  A byte's code length in its longest known
context is -log2 of its share there, or, where it never followed, the context's escape cost (method C: distinct
followers over occurrences plus distinct followers) plus its code length in the next shorter context; order -1 is
uniform over 256 bytes.  The language with the shortest total code wins; the score is its share of 2 ** -length.

As the statistics are frozen, the code lengths of all n-grams that any tree knows are computed once, for all languages
of a block together, and kept in one table per order.  A language's code lengths don't depend on the other languages, so
blocks of ``BLOCK`` languages make one model of any number of them; it grows with that number only.  Texts are scored for whole runs at a time: each position looks up its
longest n-gram, and only what no tree knows falls through to the next order, paying each tree's escapes.

Learning uses a bounded sample (``PER_LANGUAGE`` rows of each language, whole texts); all texts are predicted whole.
Edge cases: null text or one without a letter is ``und`` with score 0; empty training data makes everything ``und``;
equal code lengths go to the first language in order; repeated rows get equal results, and rows of one doc_id and language
teach once, by the text of the smallest hash; a doc_id that is no number reads as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textkit as tk
from opinara.llm.labelled import held_out, one_text_each
from opinara.session import cut_lineage, small_batches

#: Bytes of context; n-grams are one longer and must fit a 64-bit key.
ORDER = 3
#: Training rows of each language, those of the smallest hashes.
PER_LANGUAGE = 400
#: Languages of one part of the model.
BLOCK = 100
UNDETERMINED = "und"


def gram_keys(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position as a number, with the length above them; the first n - 1 are left out."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    key = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        key = (key << np.uint64(8)) | data[k : len(data) - n + 1 + k]
    return key


def frame(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A run of texts with ``order`` newlines before each text, so that no context reaches into another text, and
    the new offsets (of each text's first byte, without its newlines)."""
    n = len(offsets) - 1
    out = np.full(len(data) + n * order, 10, np.uint8)
    at = offsets + order * np.arange(1, n + 2)
    where = np.ones(len(out), bool)
    if n:
        heads = (at[:-1, None] - order + np.arange(order)).ravel()
        where[heads] = False
    out[where] = data
    return out, at


def count_grams(texts: pa.Array, order: int = ORDER) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """n -> (keys, counts) of the n-grams of the texts, n from 1 to order + 1, each at its text's own positions."""
    found: dict[int, list] = {n: [] for n in range(1, order + 2)}
    for _, _, data, offsets in tk.doc_chunks(texts):
        framed, at = frame(data, offsets, order)
        own = np.zeros(len(framed), bool)
        for lo, hi in zip(at[:-1], at[:-1] + np.diff(offsets), strict=True):
            own[lo:hi] = True
        for n in found:
            keys = gram_keys(framed, n)[own[n - 1 :]]
            found[n].append(np.unique(keys, return_counts=True))
    out = {}
    for n, parts in found.items():
        keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        unique, inverse = np.unique(keys, return_inverse=True)
        out[n] = (unique, np.bincount(inverse, counts, len(unique)).astype(np.int64))
    return out


class Model:
    """Frozen code lengths of all languages.

    ``grams[n]``: keys of the n-grams, ``cost[n]``: their code lengths (rows) by language (columns), escapes included.
    ``contexts[n]``, ``escape[n]``: keys of the n-byte contexts and each language's cost of leaving them (0 where the
    language's tree doesn't have the context)."""

    def __init__(self, languages: list[str], counts: list[dict[int, tuple[np.ndarray, np.ndarray]]], order: int = ORDER):
        self.languages, self.order = languages, order
        self.grams: dict[int, np.ndarray] = {}
        self.cost: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.escape: dict[int, np.ndarray] = {}
        lower = np.full((256, len(languages)), 8.0)  # order -1
        for n in range(1, order + 2):
            keys = np.unique(np.concatenate([c[n][0] for c in counts])) if counts else np.zeros(0, np.uint64)
            parents = np.unique(keys >> np.uint64(8)) if n > 1 else np.zeros(1, np.uint64)
            escape = np.zeros((len(parents), len(languages)))
            if n == 1:
                below = lower[keys.astype(np.int64)] if len(keys) else np.zeros((0, len(languages)))
            else:
                short = keys & np.uint64((1 << 8 * (n - 1)) - 1)
                below = self.cost[n - 1][np.searchsorted(self.grams[n - 1], short)] if len(keys) else np.zeros((0, len(languages)))
            cost = np.zeros((len(keys), len(languages)))
            for j, c in enumerate(counts):
                own, count = c[n]
                parent = np.searchsorted(parents, own >> np.uint64(8)) if n > 1 else np.zeros(len(own), np.int64)
                total = np.bincount(parent, count, len(parents))
                kinds = np.bincount(parent, minlength=len(parents))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, j] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                cost[:, j] = escape[np.searchsorted(parents, keys >> np.uint64(8)) if n > 1 else np.zeros(len(keys), np.int64), j] + below[:, j]
                at = np.searchsorted(keys, own)
                cost[at, j] = -np.log2(count / (total[parent] + kinds[parent]))
            self.grams[n], self.cost[n], self.contexts[n - 1], self.escape[n - 1] = keys, cost, parents, escape
        self._index: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def index(self) -> dict:
        if self._index is None:
            self._index = {n: (tk.HashIndex(self.grams[n]), tk.HashIndex(self.contexts[n]) if n <= self.order else None) for n in self.grams}
        return self._index

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        n, k = len(offsets) - 1, len(self.languages)
        bits = np.zeros((n, k))
        if not len(data) or not k:
            return bits
        framed, at = frame(data, offsets, self.order)
        top = self.order + 1
        keys = gram_keys(framed, top) if len(framed) >= top else np.zeros(0, np.uint64)
        own = np.zeros(len(framed) + 1, np.int8)
        size = np.diff(offsets)
        np.add.at(own, at[:-1][size > 0], 1)
        np.add.at(own, (at[:-1] + size)[size > 0], -1)
        keys = keys[np.cumsum(own[:-1], dtype=np.int8)[top - 1 :] > 0]  # one n-gram for each byte of the texts
        row = self.index()[top][0].find(keys)
        for j in range(k):
            column = np.ascontiguousarray(self.cost[top][:, j])
            value = column[np.maximum(row, 0)] if len(column) else np.zeros(len(row))
            value[row < 0] = 0.0
            bits[:, j] = tk.sums_by(value, offsets)
        open_ = np.flatnonzero(row < 0)
        doc = np.searchsorted(offsets, open_, "right") - 1
        rest = keys[open_]
        for order in range(self.order, -1, -1):
            if not len(rest):
                break
            # No tree has this n-gram: each pays its escape from the context, then tries one byte less.
            if order:
                context = self.index()[order][1].find(rest >> np.uint64(8))
                known = context >= 0
                for j in range(k):
                    bits[:, j] += np.bincount(doc[known], self.escape[order][context[known], j], n)
                rest = rest & np.uint64((1 << 8 * order) - 1)
                row = self.index()[order][0].find(rest)
                hit = row >= 0
                for j in range(k):
                    bits[:, j] += np.bincount(doc[hit], self.cost[order][row[hit], j], n)
                rest, doc = rest[~hit], doc[~hit]
            else:
                for j in range(k):
                    bits[:, j] += np.bincount(doc, minlength=n) * (8.0 + self.escape[0][0, j])
        return bits


class Models:
    """Models of blocks of languages, in the order of all languages.

    A language's code lengths don't depend on the other languages of its model, so the blocks together are one model."""

    def __init__(self, parts: list[Model]):
        self.parts = parts
        self.languages = [name for p in parts for name in p.languages]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((len(offsets) - 1, 0)), *(p.code_lengths(data, offsets) for p in self.parts)], 1)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER, lang_col: str = "lang") -> Models:
    """The model of rows with a language whose remainder modulo 5 isn't 0; any number of languages.

    The ids of each language are chosen by a distributed top-k of their hashes, with one text each, however often an id is
    repeated; n-grams are counted where the rows are, summed by a shuffle, and only the sums of this sample, of at most
    ``per_language`` rows a language, come to the driver, those of ``BLOCK`` languages at a time."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").count().collect()
    languages = sorted(r[0] for r in sizes)
    # A hash threshold that leaves about twice the wanted rows of each language, then the exact top-k of those.
    bound = spark.createDataFrame([(lang, min(1 << 30, int((1 << 30) * (2 * per_language + 100) / n))) for lang, n in sizes], "lang string, bound long")
    near = rows.select("lang", "doc_id").join(F.broadcast(bound), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("bound"))
    ids = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id"))), 1, per_language).alias("x"))
    chosen = ids.select("lang", F.explode("x.doc_id").alias("doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0)
            for lang in pc.unique(langs).to_pylist():
                for n, (keys, counts) in count_grams(pc.filter(b.column(1), pc.equal(langs, lang)), order).items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "n", "key", "c"])

    # At most per_language ids of each language are broadcast.
    text = one_text_each(rows.join(F.broadcast(chosen), ["lang", "doc_id"]), "lang", "doc_id").select("lang", "text")
    summed = text.mapInArrow(count, "lang string, n int, key long, c long").groupBy("lang", "n", "key").agg(F.sum("c").alias("c"))
    blocks = [languages[k : k + BLOCK] for k in range(0, len(languages), BLOCK)]
    if len(blocks) > 1:
        summed = cut_lineage(summed, "grams")
    return Models([_model(summed.where(F.col("lang").between(b[0], b[-1])) if len(blocks) > 1 else summed, b, order) for b in blocks])


def _model(summed: DataFrame, languages: list[str], order: int) -> Model:
    """The model of one block of languages."""
    found = summed.toPandas()
    counts = []
    for lang in languages:
        own = found[found["lang"] == lang]
        counts.append({})
        for n in range(1, order + 2):
            part = own[own["n"] == n].sort_values("key")
            counts[-1][n] = (part["key"].to_numpy(np.int64).astype(np.uint64), part["c"].to_numpy(np.int64))
    return Model(languages, counts, order)


def predict(docs: DataFrame, model: Model | Models) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per input row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for b in batches:
            texts = b.column(2)
            parts = [m.code_lengths(data, offsets) for _, _, data, offsets in tk.doc_chunks(texts)]
            bits = np.concatenate(parts) if parts else np.zeros((0, len(m.languages)))
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
            if m.languages:
                best = bits.argmin(1)
                share = 1 / np.exp2(np.clip(bits.min(1)[:, None] - bits, -1000, 0)).sum(1)
            else:
                best, share, lettered = np.zeros(len(bits), np.int64), np.zeros(len(bits)), np.zeros(len(bits), bool)
            best = np.where(lettered, best, len(m.languages))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[best], pa.string()), pa.array(np.where(lettered, share, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
