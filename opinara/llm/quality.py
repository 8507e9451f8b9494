"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a short vector of transformed statistics (shares smoothed towards a prior by a few pseudo-counts,
then square-rooted, so that short and long texts have comparable spreads).  Both classes get a mean and a covariance
that is shrunk towards the pooled covariance and towards a multiple of the identity.  The score is the logistic of the
difference of the class log densities; each density needs the Mahalanobis distance, computed for whole batches with
the Cholesky factor that was cached at fitting.

Only a bounded sample of labelled training rows (``PER_CLASS`` of each class) is used for fitting; every text is scored
whole.  Edge cases: null and empty texts have the statistics of no words, and a score like any other; ties and
repeated rows get equal scores; without training labels of both classes every score is ``PRIOR``; rows of one doc_id
teach once, by the text of the smallest hash; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm import textkit as tk
from opinara.llm.labelled import held_out, labelled_texts
from opinara.session import small_batches

#: Labelled rows of each class that are fitted at most.
PER_CLASS = 5000
SHRINK_POOLED, SHRINK_IDENTITY = 0.15, 0.02
#: The score when nothing could be learnt.
PRIOR = 0.5
FEATURES = ("upper", "symbols", "bare_tokens", "repeats", "again", "marked_ends", "word_length", "short_words", "digits", "line_repeats")

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 sentence mark, 5 symbol, 6 above ASCII, 0 space and control
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = 5
_CLASS[[ord(c) for c in ".,;:'\"-?"]] = 4


def _share(count: np.ndarray, total: np.ndarray, prior: float, strength: float) -> np.ndarray:
    return (count + prior * strength) / (total + strength)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The feature matrix of a run of texts."""
    n = len(offsets) - 1
    if not len(data):
        data = np.zeros(0, np.uint8)
    kind = _CLASS[data]
    by = lambda mask: tk.sums_by(mask, offsets)
    upper, lower, digits, symbols, high = (by(kind == k) for k in (1, 2, 3, 5, 6))
    letters = upper + lower
    chars = letters + digits + symbols + high + by(kind == 4)
    starts, ends, first = tk.token_spans(data, offsets, tk.GRAPH)
    words = np.diff(first)
    if len(starts):
        hashes = tk.span_hash(tk.prefix_hash(tk.LOWER[data]), starts, ends)
        doc = tk.doc_of(first)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        named = np.zeros(len(data) + 1, np.int64)
        np.cumsum((kind != 5) & (kind != 4) & (kind != 0), out=named[1:])
        bare = named[ends] == named[starts]
        marked = kind[ends - 1] == 5
        short = (ends - starts) <= 3
        # A pair of neighbouring words of one text that the text has already had.
        second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        again = np.zeros(len(hashes), bool)
        if len(second):
            pairs = tk.mix(hashes[second - 1] * np.uint64(31) + hashes[second] + doc[second].astype(np.uint64) * tk.BASE)
            order = np.argsort(pairs, kind="stable")
            again[second[order[1:]]] = pairs[order][1:] == pairs[order][:-1]
        per = lambda x: tk.sums_by(x, first)
        same_n, bare_n, marked_n, short_n, again_n = map(per, (same, bare, marked, short, again))
    else:
        same_n = bare_n = marked_n = short_n = again_n = np.zeros(n, np.int64)
    newline = np.zeros(256, bool)
    newline[10] = True
    lines, line_ends, line_first = tk.token_spans(data, offsets, ~newline)
    line_dup = np.zeros(n, np.int64)
    if len(lines):
        lh = tk.mix(tk.span_hash(tk.prefix_hash(data), lines, line_ends) + tk.doc_of(line_first).astype(np.uint64) * tk.BASE)
        order = np.argsort(lh, kind="stable")
        dup = np.zeros(len(lh), bool)
        dup[order[1:]] = lh[order][1:] == lh[order][:-1]
        line_dup = tk.sums_by(dup, line_first)
    f = np.stack(
        [
            np.sqrt(_share(upper, letters, 0.03, 60)),
            np.sqrt(_share(symbols, chars, 0.002, 300)),
            np.sqrt(_share(bare_n, words, 0.005, 20)),
            np.sqrt(_share(same_n, words, 0.01, 20)),
            # Pairs come again more often in a longer text, so their share is taken of a power of its length.
            np.sqrt(_share(again_n, 4 * words.astype(np.float64) ** 0.7, 0.05, 40)),
            np.sqrt(_share(marked_n, words, 0.005, 20)),
            np.log(_share(chars, words, 5.0, 20)),
            _share(short_n, words, 0.35, 20),
            np.sqrt(_share(digits, chars, 0.01, 200)),
            np.sqrt(_share(line_dup, np.diff(line_first), 0.02, 10)),
        ],
        1,
    )
    return f


def batch_statistics(texts: pa.Array) -> np.ndarray:
    parts = [statistics(data, offsets) for _, _, data, offsets in tk.doc_chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = SHRINK_POOLED, identity: float = SHRINK_IDENTITY) -> dict | None:
    """Means, inverse Cholesky factors and log determinants of both classes; None unless both have two rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    weight = np.array([(y == 0).mean(), (y == 1).mean()])
    both = weight[0] * own[0] + weight[1] * own[1]
    model = {"centre": centre, "scale": scale, "mean": [], "factor": [], "log_det": []}
    for k in (0, 1):
        s = (1 - pooled) * own[k] + pooled * both
        s = (1 - identity) * s + identity * np.trace(both) / len(both) * np.eye(len(s))
        chol = np.linalg.cholesky(s)
        model["mean"].append(z[y == k].mean(0))
        model["factor"].append(np.linalg.inv(chol))
        model["log_det"].append(2 * np.log(np.diag(chol)).sum())
    return model


def score(x: np.ndarray, model: dict | None) -> np.ndarray:
    """Probability of class 1 under equal priors."""
    if model is None:
        return np.full(len(x), PRIOR)
    z = (x - model["centre"]) / model["scale"]
    log_density = [-0.5 * (((z - model["mean"][k]) @ model["factor"][k].T) ** 2).sum(1) - 0.5 * model["log_det"][k] for k in (0, 1)]
    return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality") -> dict | None:
    """Fits the model on labelled rows whose remainder modulo 3 isn't 1."""

    small_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = batch_statistics(b.column(0))
            yield pa.RecordBatch.from_pydict({"label": b.column(1), "x": pa.array(list(x), pa.list_(pa.float64()))})

    rows = labelled_texts(docs, labels, label, per_class, 3, 1).select("text", "label").mapInArrow(features, "label int, x array<double>").toPandas()
    if not len(rows):
        return None
    order = np.lexsort([*np.array(rows["x"].tolist()).T, rows["label"]])  # sums must not depend on the order of tasks
    return fit(np.array(rows["x"].tolist())[order], rows["label"].to_numpy()[order])


def classify(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns named in ``keep``; one row per input row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id"), F.col("text"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), *kept)
    fields = [f for f in rows.schema if f.name != "text" or "text" in keep]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = score(batch_statistics(b.column(b.schema.get_field_index("text"))), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, schema)
