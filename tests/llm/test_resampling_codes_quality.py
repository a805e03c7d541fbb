"""Importance resampling, vector codes and quality: odd rows, brute force, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import LONG, ODD

from postbag.llm import importance, quality, vector_codes


@pytest.fixture(scope="module")
def clashing(spark):
    """Odd rows beside columns that operators name themselves."""
    rows = [(i, t, 1, 2, "r", "w") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, n int, rank string, weight string")


# ---- importance


def plain_runs(text, n):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def plain_resample(docs, target, n, buckets, seed, percent, least):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for run in plain_runs(t, n)[0]:
                out[zlib.crc32(run.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    rows = []
    for i, text in docs:
        runs, words = plain_runs(text, n)
        total = 0
        for run in runs:
            b = zlib.crc32(run.encode()) % buckets
            total += math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
        weight = total // len(runs) if runs else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, words, len(runs), weight, score, None])
    may = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0], r[2], r[3]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("n", [1, 3])
def test_resample_as_brute_force(spark, clashing, n):
    r = random.Random(n)
    words = ["Ab", "cd", "é", "x9", "日本", "long" * 30, "z"]
    docs = [(i, r.choice([" ", "-", "\n", "\x00"]).join(r.choices(words, k=r.randrange(12)))) for i in range(300)]
    docs += [*ODD, (3, docs[0][1]), (3, docs[0][1])]
    target = ["ab cd é", None, "", "cd cd", "Z"]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = importance.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, percent=40, least_words=4)
    assert Counter(tuple(x) for x in got.collect()) == plain_resample(docs, target, n, 97, 2024, 40, 4)
    odd = importance.resample(clashing, clashing, n=n)
    assert odd.count() == len(ODD) and importance.resample(clashing.where("false"), clashing).count() == 0
    assert importance.resample(clashing, clashing.where("false")).count() == len(ODD)


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("limit", [1, 3, 7, 1000])
def test_runs_never_reach_into_the_next_text(n, limit):
    texts = ["a b c d e", "", "f", "g h", " i,j;k ", "lmnopqrstuvwxyz " * 3, "é é"]
    got = Counter()
    for owner, codes, _ in importance.runs([t.encode() for t in texts], n, 1 << 40, limit):
        got.update(zip(owner.tolist(), codes.tolist()))
    want = Counter((i, zlib.crc32(run.encode())) for i, t in enumerate(texts) for run in plain_runs(t, n)[0])
    assert got == want


def test_ranks_of_tied_scores(spark):
    rows = [(i, 30, 30, 0, i % 3 * 300) for i in range(90)] + [(i, 1, 1, 0, 600) for i in range(90, 99)]
    scored = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long")
    got = {r.id: r["rank"] for r in importance._placed(scored, 41, "n_words >= 20 AND id IS NOT NULL").collect()}
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    assert {i: k for i, k in got.items() if k} == {r[0]: k + 1 for k, r in enumerate(order[:41])} and len(got) == 99


# ---- vector codes


def plain_codes(vectors, size, rounds, parts=4):
    """``{id: (code, error)}`` and the codebooks, by whole scans; ``vectors`` are ``(id, list)``."""
    ids = [i for i, _ in sorted(vectors)]
    x = np.floor(1024 * np.array([v for _, v in sorted(vectors)], np.float64)).astype(np.int64)
    w = x.shape[1] // parts
    books, code, error = [], [], 0
    for p in range(parts):
        part = x[:, p * w : (p + 1) * w]
        book = part[:size].copy()
        for r in range(rounds + 1):
            d = ((part[:, None] - book[None]) ** 2).sum(2)
            at = d.argmin(1)
            if r < rounds:
                for e in set(at.tolist()):
                    book[e] = part[at == e].sum(0) // (at == e).sum()
        books.append(book)
        code.append(at)
        error = error + d.min(1)
    return {i: (tuple(int(c[k]) for c in code), int(error[k])) for k, i in enumerate(ids)}, books


@pytest.mark.parametrize("size,scale", [(16, 1.0), (300, 1.0), (9, 30_000.0)])
def test_codes_as_brute_force(spark, size, scale):
    r = np.random.default_rng(size)
    x = (r.standard_normal((30, 8)) * scale).repeat(25, 0) + r.standard_normal((750, 8)) * 0.2
    x[::7] = np.round(x[::7] * 4) / 4  # ties
    vectors = [(int(i), row.tolist()) for i, row in enumerate(x.astype(np.float32).astype(np.float64))]
    table = spark.createDataFrame([(i, v, i % 5 or None) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    encoded, books = vector_codes.encode(table.repartition(3), size=size)
    want, plain = plain_codes(vectors, size, 4)
    kind = np.dtype(np.uint8 if size <= 256 else ">u2")
    got = encoded.collect()
    assert {v.vec_id: (tuple(np.frombuffer(v.codes, kind).tolist()), v.error) for v in got} == want
    assert all((a == b).all() for a, b in zip(books.rounds[-1], plain))
    sums = Counter()
    for v in got:
        sums[v.label] += v.error
    assert all(v.label_error == sums[v.label] for v in vector_codes.with_label_error(encoded).collect())


def test_bounds_hold_and_spare_work():
    """Codes of every round equal whole scans, with net displacements no longer than the sum of the moves."""
    r = np.random.default_rng(1)
    x = (np.repeat(r.standard_normal((64, 8)), 40, 0) * 900 + r.standard_normal((2560, 8)) * 40).astype(np.int64)
    groups, history, state, work = vector_codes.spans(64, 8), [x[::40].copy()], (None, None, None), []
    for _ in range(6):
        code, best, bound, stamp, computed = vector_codes.assign(x, history, groups, *state)
        d = vector_codes.distances(x, history[-1])
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        for g, (a, b) in enumerate(groups):
            others = np.where(np.arange(a, b) == code[:, None], np.inf, d[:, a:b]).min(1)
            moved = vector_codes.displacements(history, groups)[stamp[:, g], g]
            assert (bound[:, g] - moved <= np.sqrt(others) + 1e-3).all()
        state = code, bound, stamp
        work.append(computed)
        means = [x[code == e].sum(0) // max((code == e).sum(), 1) if (code == e).any() else c for e, c in enumerate(history[-1])]
        history.append(np.array(means))
    assert work[0] == x.shape[0] * 64 and max(work[1:]) < work[0] / 2
    there, here = np.zeros((64, 8), np.int64), np.full((64, 8), 9)
    net = vector_codes.displacements([there, here, there], groups)
    assert (net[0] == 0).all() and (net[1] > 25).all()  # the way back undoes the way there


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.25, 1.0]
    rows = [(1, None, 1), (2, [nan, 0.0, 0.0], 1), (3, [inf, 0.0, 0.0], 1), (4, [None, 0.0, 0.0], 1), (5, [], 1)]
    rows += [(6, v, None), (7, v, None), (7, v, 2), (None, v, None), (8, [1.0], 2), (9, [1e300, 0.0, -1e300], 2), (10, LONG and v, 3)]
    table = spark.createDataFrame([(*r, "x", b"y") for r in rows], "vec_id long, embedding array<double>, label int, error string, codes binary")
    encoded, books = vector_codes.encode(table, size=256)
    got = sorted(encoded.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert [r.vec_id for r in got] == [6, 7, 7, 9, 10, None] and books.width == 1
    assert all(r.error == 0 for r in got) and [x[0].tolist() for x in books.rounds[0]] == [[512], [-256], [1024], [0]]
    assert vector_codes.with_label_error(encoded).count() == 6
    empty, _ = vector_codes.encode(table.where("false"))
    assert empty.count() == 0 and vector_codes.with_label_error(empty).count() == 0


# ---- quality


def prose(r, n):
    return " ".join(r.choice(["the", "and", "house", "river", "Walked", "slow", "of"]) + r.choice(["", "", ",", "."]) for _ in range(n))


def test_quality_held_out(spark, clashing):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        text, kind = prose(r, r.randrange(5, 200)), i % 6
        if kind == 0:
            text = " ".join(w + r.choice(["###", "$$", "*"]) for w in text.split())
        elif kind == 1:
            text = "BUY NOW!! " * r.randrange(3, 60)
        docs.append((i, text))
        labels.append((i, int(kind > 1)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (2, 1)], "doc_id long, quality int")
    model = quality.train(table, marks)
    assert len(model.pairs) == 8 and any(np.abs(t).max() > 0 for _, _, t in model.pairs)
    got = {x.doc_id: x.score for x in quality.score(table, model).collect()}
    held = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and np.mean([(got[i] >= 0.3) == bool(q) for i, q in held]) > 0.97
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels], "doc_id long, quality int")
    same = quality.train(table, flipped)
    assert all((a == b).all() for a, b in zip(model.tables, same.tables))  # held-out labels are never learnt from
    odd = quality.score(clashing, model).collect()
    assert len(odd) == len(ODD) and all(0 <= x.score <= 1 for x in odd)
    assert len({x.score for x in odd if x.doc_id in (1, 2, 3)}) == 1
    assert quality.score(clashing.where("false"), model).count() == 0


def test_quality_without_labels(spark, clashing):
    marks = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    for labels in (marks, marks.where("false")):
        scores = {x.score for x in quality.score(clashing, quality.train(clashing, labels)).collect()}
        assert len(scores) == 1


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"w{k} x") for k in range(400)] + [(k, "y z") for k in range(2, 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 300)], "doc_id long, quality int")
    seen = []
    real, quality.fit = quality.fit, lambda x, good: seen.append(len(good)) or real(x, good)
    try:
        quality.train(docs, labels, sample=50)
    finally:
        quality.fit = real
    assert 0 < seen[0] <= 50


def test_long_texts_are_measured_in_pieces():
    text = ("ab cd, ef!\n" * 900_000).encode()
    one = quality.measures(text)
    real, quality.PIECE = quality.PIECE, 1 << 40
    try:
        whole = quality.measures(text)
    finally:
        quality.PIECE = real
    assert np.allclose(one, whole, atol=2e-3)


def test_pairs_catch_what_single_measures_cannot():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    good = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, both = quality.fit(x, good, pairs=0), quality.fit(x, good, pairs=1)
    assert ((alone.scores(x) > 0.5) == good).mean() < 0.7 and both.pairs[0][:2] == (0, 1)
    assert ((both.scores(x) > 0.5) == good).mean() > 0.95
