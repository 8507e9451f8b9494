import hashlib
import random

import numpy as np
import pytest

from opinara.llm import substring_dedup as sd


def brute(rows, n=sd.LENGTH):
    """Rows (doc_id, text) -> sorted results; identical rows: one is first."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, _key(rows[i][1]), i))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        cover = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - n + 1):
            w = raw[s : s + n]
            if w in seen:
                cover[s : s + n] = True
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover, strict=False) if not c)
        spans = int((cover[:-1] & ~np.concatenate([[False], cover[:-2]])).sum()) if len(raw) else 0
        out.append((rows[i][0], len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


KEYS: dict = {}


def _key(text):
    return KEYS[text or ""]


def make(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 80))))
        t = " ".join(parts)
        if rng.random() < 0.3 and rows:
            t = list(rng.choice(rows)[1] or "")
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = "#"
            t = "".join(t)
        rows.append((k, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 500), (n + 3, "ab" * 300), (n + 4, "x" * 99), (n + 5, "y" * 100), (n + 6, "y" * 101), (None, passages[0]), (3, passages[1] + "!"), (5, rows[5][1]), (5, rows[5][1]), (None, passages[0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 2048), (2, 2), (3, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = make(seed)
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, kept string, id int").repartition(5)
    KEYS.update({r.t: r.k for r in docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) k").collect()})
    assert sorted(map(tuple, sd.remove_repeats(docs).collect()), key=str) == brute(rows)


def test_kept_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "é" * 80, "en"), (2, "x" + "é" * 80 + "z", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept, r.lang, r.n_removed) for r in sd.remove_repeats(docs, keep_text=True, carry=("lang",)).collect()}
    # Of 160 bytes the even runs repeat from the second character on; the cut may split no kept character here.
    assert got[2][0].startswith("x") and got[2][0].endswith("z") and got[2][1] == "de" and got[1][1] == "en"
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_previous_factors_equal_definition():
    rng = np.random.default_rng(4)
    for _ in range(20):
        data = rng.integers(97, 99, rng.integers(20, 120)).astype(np.uint8)
        depth = int(rng.integers(2, 12))
        room = len(data) - np.arange(len(data))
        places = np.flatnonzero(room >= depth)
        got = sd.previous_factors(data, room, places, depth, start=1)
        raw = data.tobytes()
        for p, g in zip(places.tolist(), got.tolist(), strict=True):
            want = max((next((k for k in range(depth) if raw[p + k] != raw[q + k]), depth) for q in range(p)), default=0)
            assert g == want


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 50, 50, 1500, 1620, 3000])
    a = sd.anchors(data, offsets)
    for d in range(5):
        own = a["doc"] == d
        starts = [s for lo, hi in zip(a["lo"][own], a["hi"][own], strict=True) for s in range(lo, hi + 1)]
        assert starts == list(range(max(0, offsets[d + 1] - offsets[d] - sd.LENGTH + 1)))


def test_chance_repeats_of_an_anchor_ask_for_no_text(spark):
    """Strings too short to be part of an equal window on either side leave no text to compare."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    for size, asked in ((52, False), (120, True)):
        phrase = word(size)
        docs = spark.createDataFrame([(k, k, word(150) + phrase + word(150)) for k in range(40)], "id long, key long, text string")
        flat = sd.map_groups(sd._meet(docs, 4), ["bucket"], sd._resolve, sd._FLAT)
        assert (flat.where("kind = 1").count() > 0) == asked
