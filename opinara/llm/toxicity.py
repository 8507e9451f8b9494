"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek and full-width look-alikes) and digit or sign substitutions to
one letter, drops invisible characters and turns ASCII punctuation and white space into spaces; ``l`` and ``1`` fold
to ``i``.  Lexicon entries are folded the same way and start at a word boundary; an entry is a whole word or a word
beginning.  A match inside an exception phrase doesn't count.  The summed weights, normalised by the text's length,
are turned into a probability by a logistic curve.

A short list of seed words comes with fixed weights, and a short list of exception phrases.  Labelled training rows add
entries: words and word beginnings that are frequent among toxic rows and rare among the others, weighted by their log
odds.  They also add exceptions: pairs of neighbouring words, one of which an entry matches, that are frequent among the
other rows and rare among the toxic ones.  The curve is fitted on the same bounded sample (``PER_CLASS`` rows of each
class, of which near copies of each other teach once: their words would else look like signals).  Every text is scored
whole.

Edge cases: null and empty texts have no match and the score of the curve at zero; repeated rows get equal scores;
of overlapping matches that start at one place the heaviest counts; without labels the seeds and a fixed curve apply;
rows of one doc_id teach once, by the text of the smallest hash; a doc_id that is no number reads as null; other columns
are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textkit as tk
from opinara.llm.labelled import held_out, labelled_texts
from opinara.session import cut_lineage, small_batches

PER_CLASS = 3000
THRESHOLD = 0.7
#: Shortest and longest word beginning that may become an entry.
PREFIX = (4, 12)
#: An exception phrase is so many times as frequent among rows that aren't toxic as among toxic ones.
EXCEPTION_ODDS = 4.0
SEED_WEIGHT = 3.0
SEEDS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "scum", "loser", "trash", "bastard", "asshole", "bitch", "retard")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "pond scum", "sore loser paradox")
#: Intercept, weight of log(1 + sum) and of the length-normalised sum, before anything was learnt.
CURVE = (-1.5, 1.5, 1.0)
#: Pseudo-words added to the length.
LENGTH_PRIOR = 30.0

# Fixed look-alikes: Cyrillic, then Greek, then digits and signs.
_LOOKALIKE = dict(zip("аеорсухіѕјкмтнвԁɡӏ", "aeopcyxisjkmthbdgi", strict=True)) | dict(zip("αεορτυικνχ", "aeoptuikvx", strict=True)) | dict(zip("01345789@$", "oieastbgas", strict=True)) | {"l": "i"}
_INVISIBLE = (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    table |= {ord(a): b for a, b in _LOOKALIKE.items()}
    for c in range(26):
        small = chr(97 + c)
        for base in (0xFF41, 0xFF21):  # full-width letters
            table[base + c] = _LOOKALIKE.get(small, small)
    table |= {c: None for c in _INVISIBLE}
    return table


TABLE = _table()


def fold(text: str) -> str:
    """The text as the automaton sees it, with a space at either end."""
    return " " + text.lower().translate(TABLE) + " "


def automaton(entries: dict[str, float], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for e, w in entries.items():
        a.add_word(e, (len(e), w))
    for x in exceptions:
        f = fold(x)
        a.add_word(f, (len(f), None))
    a.make_automaton()
    return a


def matches(folded: str, auto: ahocorasick.Automaton) -> tuple[float, int]:
    """(sum of weights, number) of the matches that count."""
    best: dict[int, tuple[float, int]] = {}
    free: list[tuple[int, int]] = []
    for end, (n, w) in auto.iter(folded):
        start = end - n + 1
        if w is None:
            free.append((start, end))
        elif start not in best or w > best[start][0]:
            best[start] = (w, end)
    if free and best:
        # One sweep: of the exceptions that start at or before a match, the one that ends last decides.
        free.sort()
        starts, reach = [a for a, _ in free], []
        for _, b in free:
            reach.append(max(b, reach[-1]) if reach else b)
        for s in [s for s, (_, e) in best.items() if (k := bisect_right(starts, s)) and e <= reach[k - 1]]:
            del best[s]
    return math.fsum(w for w, _ in best.values()), len(best)


def signals(text: str | None, auto: ahocorasick.Automaton) -> tuple[float, float, int]:
    """log(1 + sum), length-normalised sum and number of matches."""
    folded = fold(text or "")
    total, n = matches(folded, auto)
    if not n:
        return 0.0, 0.0, 0
    return math.log1p(total), total / math.sqrt(len(folded.split()) + LENGTH_PRIOR), n


def probability(x: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + x[:, 0] * curve[1] + x[:, 1] * curve[2], -50, 50)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; slopes stay positive."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (p - y) + ridge * b
        h = (a * (p * (1 - p))[:, None]).T @ a + (ridge + 1e-6) * np.eye(3)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), max(float(b[1]), 0.0), max(float(b[2]), 0.0)


def choose_entries(counts: pd.DataFrame, n_pos: int, n_neg: int, min_odds: float = 3.0) -> dict[str, float]:
    """Entries from (entry, pos, neg) document counts: enough support and odds, and no shorter beginning as good."""
    least = max(4, n_pos // 100)
    c = counts[counts["pos"] >= least].copy()
    c["w"] = np.log((c["pos"] + 0.5) / (n_pos + 1)) - np.log((c["neg"] + 0.5) / (n_neg + 1))
    c = c[c["w"] >= min_odds]
    c["n"] = c["entry"].str.len()
    chosen: dict[str, float] = {}
    rate = dict(zip(c["entry"], zip(c["w"], c["pos"], c["neg"], strict=True), strict=True))
    # A beginning that nearly always goes on in one way gives way to its continuation.
    loose = {e[:-1] for e, (_, pos, neg) in rate.items() if e[:-1] in rate and pos >= 0.97 * rate[e[:-1]][1] and neg <= rate[e[:-1]][2]}
    for e in sorted(rate.keys() - loose, key=lambda e: (len(e), e)):
        w, pos, neg = rate[e]
        shorter = [e[:k] for k in range(PREFIX[0] + 1, len(e)) if e[:k] in chosen]
        if any(rate[s][2] <= neg for s in shorter):
            continue
        chosen[e] = float(w)
    return {e: round(chosen[e], 6) for e in sorted(chosen)}


def matched_phrases(folded: str, auto: ahocorasick.Automaton) -> set[str]:
    """Each matched word with the word before it and with the one after it, where one space parts them."""
    out = set()
    for end, (n, w) in auto.iter(folded):
        if w is None:
            continue
        start = end - n + 2  # entries begin with the space before their word
        stop = folded.find(" ", start)
        after = folded.find(" ", stop + 1)
        if after > stop + 1:
            out.add(folded[start:after])
        before = folded.rfind(" ", 0, max(start - 1, 0)) + 1
        if 0 < before < start - 1:
            out.add(folded[before:stop])
    return out


def choose_exceptions(counts: pd.DataFrame, n_pos: int, n_neg: int, odds: float = EXCEPTION_ODDS) -> tuple[str, ...]:
    """Phrases from (phrase, pos, neg) document counts that speak against toxicity, with enough support."""
    c = counts[counts["neg"] >= max(4, n_neg // 200)]
    ratio = (c["neg"] + 0.5) / (n_neg + 1) / ((c["pos"] + 0.5) / (n_pos + 1))
    return tuple(sorted(c[ratio >= odds]["phrase"]))


def word_minima(text: str | None, n: int = 4) -> list[int]:
    """The least of ``n`` hashes of the text's word pairs: near copies share most of them."""
    words = fold(text or "").split()
    h = tk.hash_words(words)
    pairs = tk.mix(h[:-1] * tk.BASE + h[1:]) if len(h) > 1 else h
    return [int((tk.mix(pairs + np.uint64(k * 0x9E37)) if len(pairs) else np.zeros(1, np.uint64)).min() >> np.uint64(1)) for k in range(n)]


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row of each label and group of near copies, from a bounded sample (doc_id, text, label)."""
    keys = ["k0", "k1", "k2", "k3"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([word_minima(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(keys))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found.T)], [*b.schema.names, *keys])

    out = rows.select("doc_id", "text", "label").mapInArrow(add, "doc_id long, text string, label int, " + ", ".join(f"{k} long" for k in keys))
    for k in keys:
        out = out.groupBy("label", k).agg(F.min(F.struct("doc_id", "text", *[x for x in keys if x != k])).alias("x")).select("label", k, "x.*")
    return out.select("text", "label")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, exceptions: tuple[str, ...] = EXCEPTIONS) -> dict:
    """Lexicon and curve from labelled rows whose remainder modulo 3 isn't 1."""
    small_batches(docs.sparkSession)
    seeds = {f" {fold(s).strip()} ": SEED_WEIGHT for s in SEEDS}
    sample = docs.withColumn("doc_id", F.col("doc_id").try_cast("long"))
    rows = cut_lineage(distinct_texts(labelled_texts(sample, labels, "toxic", per_class, 3, 1)), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        total = Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[label] += 1
                own = set()
                for w in set(fold(text or "").split()):
                    own.add(f" {w} ")
                    own.update(f" {w[:k]}" for k in range(PREFIX[0], min(len(w), PREFIX[1]) + 1))
                seen[label].update(own)
        keys = sorted(seen[0].keys() | seen[1].keys())
        total_row = [""] if total else []
        yield pa.RecordBatch.from_pydict({"entry": total_row + keys, "pos": [total[1]] * len(total_row) + [seen[1][k] for k in keys], "neg": [total[0]] * len(total_row) + [seen[0][k] for k in keys]}, schema=pa.schema([("entry", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    counts = rows.mapInArrow(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # What returns to the driver are the entries of enough support and odds 3 to 1 in counts, of a bounded sample.
    counts = counts.where("entry = '' or (pos >= 4 and pos > 3 * neg)").toPandas()
    size = counts[counts["entry"] == ""]
    if not len(size) or not size["pos"].iloc[0] or not size["neg"].iloc[0]:
        return {"entries": seeds, "curve": CURVE, "exceptions": exceptions}
    n_pos, n_neg = int(size["pos"].iloc[0]), int(size["neg"].iloc[0])
    entries = seeds | choose_entries(counts[counts["entry"] != ""], n_pos, n_neg)
    lexicon = docs.sparkSession.sparkContext.broadcast(entries)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(lexicon.value, ())
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[label].update(matched_phrases(fold(text or ""), auto))
        keys = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["phrase", "pos", "neg"])

    near = rows.mapInArrow(phrases, "phrase string, pos long, neg long").groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    near = near.where("neg >= 4 and neg > pos").toPandas()  # pairs of the bounded sample
    exceptions = (*exceptions, *choose_exceptions(near, n_pos, n_neg))
    model = {"entries": entries, "curve": CURVE, "exceptions": exceptions}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(shared.value["entries"], exceptions)
        for b in batches:
            x = np.array([signals(t, auto)[:2] for t in b.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), b.column(1)], ["a", "b", "label"])

    seen = rows.mapInArrow(see, "a double, b double, label int").toPandas().sort_values(["a", "b", "label"])
    return model | {"curve": fit_curve(seen[["a", "b"]].to_numpy(), seen["label"].to_numpy())}


def classify(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and n_matches; one row per input row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        auto = automaton(m["entries"], m["exceptions"])
        for b in batches:
            s = [signals(t.as_py(), auto) for t in b.column(2)]  # one text at a time is a Python string
            p = probability(np.array([x[:2] for x in s]).reshape(-1, 2), m["curve"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array([x[2] for x in s], pa.int64())], ["doc_id", "held_out", "score", "predicted", "n_matches"])

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_matches long")
