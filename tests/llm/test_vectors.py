"""Whitening and vector codes against plain NumPy and whole numbers, on vectors with nulls, infinities, other lengths and repeats."""

import hashlib
import math
import random

import numpy as np
import pytest

from tickloom.llm import codes, vectors, whitening

COLUMNS = "vec_id bigint, embedding array<double>, label int, n string, deviation int, x int, code string"


def rows_of(n, d, seed=3, scale=0.4):
    rng = random.Random(seed)
    out = [(i * 3 % n if i % 50 else i, [rng.gauss(0, scale) * (1 + k % 3) for k in range(d)], None if i % 4 == 0 else i % 3) for i in range(n)]
    out += [(900, None, 1), (901, [None] * d, 1), (902, [0.5] * (d - 1) + [float("nan")], 1), (903, [math.inf] + [0.0] * (d - 1), 2), (904, [0.1] * (d + 2), 1), (905, [], 1), (906, [0.2] * (d - 1), 0)]
    out += [out[5], out[5], (None, [0.25] * d, None), (None, [-1e-9] * d, 2)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "c") for r in rows], COLUMNS).repartition(5)


def kept(rows, d):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]


def test_whitening(spark):
    d = 7
    rows = rows_of(300, d)
    good = kept(rows, d)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in good], object)
    n, sums = len(x), x.sum(0)
    c = np.array((x * n - sums) / n, float)
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert len(got) == n * d and {r["n"] for r in got} == {n}
    want = {}
    for i, r in enumerate(good):
        key = (r[0], int(((x[i] * n - sums) ** 2).sum()))
        want.setdefault(key, []).append(c[i] @ axes / np.sqrt(e))
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9 and r["identity_error"] < 1e-9
    assert found.keys() == want.keys()
    sign = np.sign(next(iter(want.values()))[0] * np.array([found[next(iter(want))][k + 1][0] for k in range(d)]))
    for key, z in want.items():
        for k in range(d):
            assert np.allclose(sorted(found[key][k + 1]), sorted(w[k] * sign[k] for w in z), atol=1e-9)


def test_whitening_of_few_directions(spark):
    """A constant direction and one that repeats another are not whitened; what is left is."""
    rng = random.Random(1)
    rows = [(i, [a := rng.gauss(0, 3), 2.0, a, rng.gauss(0, 1)], 0) for i in range(80)]
    model = whitening.fit(frame(spark, rows))
    assert model.whole == 2 and model.identity_error < 1e-9
    z = [r["whitened"] for r in model.projected(frame(spark, rows)).collect()]
    assert all(w[2] is None and w[3] is None and w[1] is not None for w in z)
    one = whitening.whitened(frame(spark, rows[:1] * 3)).collect()
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(0, None, None, None)}
    nothing = frame(spark, [(1, None, 1), (2, [None], 1)])
    assert whitening.whitened(nothing).count() == 0 and whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [], 1)])).count() == 0
    limited = whitening.whitened(frame(spark, rows), components=1)
    assert limited.count() == 80 and {r[0] for r in limited.select("component").collect()} == {1}


def test_huge_entries_are_whole_or_null():
    gap = np.array([[1 << 40, -3], [2, 5]])
    assert whitening.deviations(gap, 1 << 20, [5, 6]).to_pylist() == [None, ((2 << 20) - 5) ** 2 + ((5 << 20) - 6) ** 2]
    assert whitening.entries(np.array([1e300, -0.001])).tolist() == [(1 << 40) + 1_000_000, 999_999]


def test_moments_merge():
    rng = np.random.default_rng(4)
    z = rng.normal(5, 2, (500, 3))
    parts = [whitening.moments(p) for p in np.split(z, [10, 11, 300])]
    n, mean, products = parts[0]
    got = (n, mean, products)
    for p in parts[1:]:
        got = whitening.merged(got, p)
    assert got[0] == 500 and np.allclose(got[1], z.mean(0)) and np.allclose(got[2] / 500, np.cov(z.T, bias=True))


def test_length_is_the_most_frequent_one(spark):
    rows = frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0], 0), (3, [2.0], 0), (4, [1.0, 3.0], 0), (5, [None], 0)])
    assert vectors.length_of(rows, "embedding") == 2
    assert vectors.length_of(rows.where("vec_id IN (1, 2, 3)"), "embedding") == 1


def plain_codes(rows, d, rounds=codes.ROUNDS):
    width = -(-d // codes.PARTS)
    x = [[math.floor(1024 * c) for c in r[1]] + [0] * (codes.PARTS * width - d) for r in rows]
    order = sorted(range(len(x)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, np.array(x[i], np.int32).tobytes()))[: codes.ENTRIES]
    books = [[x[i][p * width : (p + 1) * width] for i in order] for p in range(codes.PARTS)]

    def nearest():
        out = []
        for v in x:
            code = []
            for p, book in enumerate(books):
                part = v[p * width : (p + 1) * width]
                code.append(min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book)))
            out.append(code)
        return out

    for _ in range(rounds):
        at = nearest()
        for p, book in enumerate(books):
            for i in range(len(book)):
                mine = [v[p * width : (p + 1) * width] for v, c in zip(x, at, strict=True) if c[p][1] == i]
                if mine:
                    book[i] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at = nearest()
    text = ",".join(str(v) for b in books for e in b for v in e)
    return ["".join(f"{i:02x}" for _, i in c) for c in at], [sum(e for e, _ in c) for c in at], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("n", "d"), [(420, 6), (60, 8), (300, 3)])
def test_codes(spark, n, d):
    rows = rows_of(n, d, seed=n, scale=0.01)  # a coarse grid: many ties and equal parts
    good = kept(rows, d)
    want, errors, digest = plain_codes(good, d)
    table, books = codes.compressed(frame(spark, rows))
    assert codes.digest(books) == digest
    key = lambda r: tuple((v is not None, v) for v in r)
    by_label = {}
    for r, e in zip(good, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    got = codes.with_label_errors(table).select("vec_id", "label", "code", "error", "label_error").collect()
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], r[2], c, e, by_label[r[2]]) for r, c, e in zip(good, want, errors, strict=True)], key=key)


def test_codes_of_nothing(spark):
    table, books = codes.compressed(frame(spark, [(1, None, 1)]))
    assert table.count() == 0 and books == [] and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    assert codes.with_label_errors(table).count() == 0
    table, books = codes.compressed(frame(spark, [(1, [], 1), (2, [], None)]))
    assert [tuple(r) for r in table.select("code", "error").orderBy("vec_id").collect()] == [("00000000", 0)] * 2


def test_bounds_prune_and_never_change_a_choice():
    rng = np.random.default_rng(8)
    for scale in (3, 60, 4000, 1 << 25):  # ties everywhere up to numbers whose squares doubles don't hold
        centres = rng.integers(-scale, scale, (20, 5))
        x = centres[rng.integers(0, 20, 900)] + rng.integers(-max(1, scale // 40), max(1, scale // 40) + 1, (900, 5))
        book = codes.Book(x[:64].copy(), np.zeros(64))
        at, high, low = codes.first(x, book)
        found = 0
        for _ in range(6):
            counts = np.bincount(at, minlength=64)
            sums = np.zeros((64, 5), np.int64)
            np.add.at(sums, at, x)
            book = book.replaced(sums, counts)
            at, high, low, n = codes.again(x, book, at, high, low)
            found += n
            d = ((x[:, None].astype(object) - book.entries[None].astype(object)) ** 2).sum(2)
            best = d.min(1)
            assert all(d[i, at[i]] == best[i] and (d[i, : at[i]] > best[i]).all() for i in range(len(x)))
            assert (high.astype(float) ** 2 >= best.astype(float)).all() and (low.astype(float) ** 2 <= d.astype(float)).all()
        assert found < 6 * 900 * 64 * 0.6
