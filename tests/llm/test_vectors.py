"""URL filter, hard negatives and vector codes."""

import math

import numpy as np
import pytest

from spanguard.llm import codes, negatives, urls, vectors


# ---------------------------------------------------------------- op11
ODD_URLS = [None, "", "no scheme", "://", "http://", "http://HOST.Org", "http://host.org?x=/", "https://Example.ORG/es/1#a", "a://b://c/d", "x://ÄÉ.com/fr/é😀?q", "http://sub.example.org/en/12", "http://notexample.org/en/12", "ftp://com/de/", "http://a.com/de", "http://x.net/a\nb?c", "http://casino.net/en/4"]


def one_verdict(url):
    host, path = urls.split_url(url)
    fits = [(k, h, p) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        kind, h, p = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, h + p, kind
    weights, bias = urls.trained()
    cells = urls.gram_cells(host, 1) + urls.gram_cells(path, 2)
    return host, path, None, "block" if sum(weights[c] for c in cells) / math.sqrt(len(cells)) + bias > urls.SURE * urls.UNIT else "allow"


def test_urls_equal_plain_loops(spark):
    rows = [(i, u, "host", 1) for i, u in enumerate(ODD_URLS)] + [(None, "http://a.net/" + "long/" * 100_000, "x", 2), (3, ODD_URLS[3], "twice", None)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule int")).collect()
    assert len(out) == len(rows)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out), key=str)
    assert got == sorted(((r[0], *one_verdict(r[1])) for r in rows), key=str)
    by_id = {r.page_id: r for r in out}
    assert by_id[5].rule is None and by_id[7].rule == "example.org/es/" and by_id[10].rule == "example.org/en/1" and by_id[11].rule == "org/"
    assert by_id[12].verdict == "block" and by_id[8].host == "b:" and by_id[9].path == "/fr/é😀"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_of_sites_not_in_the_table():
    verdict = lambda u: one_verdict(u)[3]
    blocked = ["http://m.casino-nights.net/en/7", "https://www.freebets24.net/de/5.html", "http://blog.adult-movies.net/", "http://cheap-pills-now.net/es/3", "https://pornsite.net/en/4", "http://adstracking.net/fr/1"]
    allowed = ["http://www.herald.net/en/7", "https://gardening.net/de/5.html", "http://blog.mathematics.net/", "http://cooking.net/es/3", "https://history-notes.net/en/4", "http://painting.net/fr/1", "https://a.net/", "http://therest.net/en/5"]
    assert sum(verdict(u) == "block" for u in blocked) >= 5
    assert all(verdict(u) == "allow" for u in allowed)


def test_urls_without_labels_are_allowed(spark):
    model = urls.train([], ["http://a.b/"])
    out = urls.judge(spark.createDataFrame([(1, "http://casino.net/")], "page_id long, url string"), rules=(), model=model)
    assert out.first().verdict == "allow"


def test_urls_plan_is_native_and_without_a_shuffle(spark):
    plan = urls.judge(spark.range(9).selectExpr("id AS page_id", "'http://a.net/' AS url"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange", "Join"))


# ---------------------------------------------------------------- vectors
VECTORS = "vec_id long, embedding array<float>, label int, q string, place int"


def random_rows(n, dim, seed=7, labels=4, of=400):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    x = centre[rng.integers(0, 5, n)] * rng.uniform(0, 1.5, (n, 1)) + rng.normal(size=(n, dim)) * 0.2
    return [(int(i), [float(np.float32(c)) for c in v], int(k), "q", 1) for i, v, k in zip(rng.permutation(of)[:n], x, rng.integers(0, labels, n))]


ODD_VECTORS = [
    (None, [0.5] * 8, 1, "a", 1), (None, [0.5] * 8, 2, "a", 1), (700, None, 1, "a", 1), (701, [1.0, None] * 4, 1, "a", 1), (702, [float("nan")] * 8, 1, "a", 1), (703, [float("inf")] * 8, 2, "a", 1),
    (800, [0.25] * 8, 1, "a", None), (800, [0.25] * 8, 1, "a", None), (801, [0.25] * 8, None, "a", 1), (900, [], 1, None, 1), (901, [1.0, 2.0], 2, None, 1), (902, [1e30] * 8, 3, "a", 1), (1000, [0.0] * 8, 1, "a", 1), (903, [-0.001] * 8, 2, "a", 1),
]


def taken(rows, dim, labelled=False):
    out = []
    for i, v, label, *_ in rows:
        if v is None or any(c is None or not math.isfinite(c) for c in v) or labelled and label is None:
            continue
        q = [max(-vectors.MOST, min(vectors.MOST, math.floor(256 * c))) for c in v]
        out.append((i, label, q + [0] * (dim - len(q))))
    return out


def mined(rows, dim):
    rows = list(enumerate(taken(rows, dim, labelled=True)))
    dot = lambda a, b: sum(x * y for x, y in zip(a[1][2], b[1][2]))
    key = lambda r: (-r[0], r[1][1][0] is None, r[1][1][0])
    out = []
    for a in rows:
        if a[1][0] is None or a[1][0] % 100:
            continue
        others = [(dot(a, b), b) for b in rows if b[0] != a[0]]
        for ps, p in sorted((x for x in others if x[1][1][1] == a[1][1]), key=key)[:5]:
            fit = [x for x in others if x[1][1][1] != a[1][1] and 30 * ps <= 100 * x[0] <= 90 * ps]
            out += [(a[1][0], p[1][0], k, n[1][0], ps, ns) for k, (ns, n) in enumerate(sorted(fit, key=key)[:10], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("odd_rows", [False, True])
def test_negatives_equal_all_pairs(spark, odd_rows, monkeypatch):
    rows = random_rows(300, 8) + (ODD_VECTORS if odd_rows else [])
    if odd_rows:  # several blocks of anchors, several tiles
        monkeypatch.setattr(negatives, "BLOCK_ROWS", 2)
        monkeypatch.setattr(negatives, "TILE", 1)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    from pyspark.sql import functions as F

    got = negatives.mine(df, F.col("id") % 100 == 0).collect()
    want = mined(rows, 8)
    assert len(want) > 40 and sorted(map(tuple, got), key=str) == want


def test_negatives_of_empty_tables(spark):
    from pyspark.sql import functions as F

    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("id") % 100 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [0.1], 1, "a", 1)], VECTORS), F.col("id") % 100 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, [], 1, "a", 1), (101, [], 2, "a", 1), (102, [], 1, "a", 1)], VECTORS), F.col("id") % 100 == 0).collect() == [(100, 102, 1, 101, 0, 0)]


def test_brackets_hold_and_rule_rows_out():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (500, 6)) + np.repeat(rng.integers(-900, 900, (5, 6)), 100, axis=0)
    longest = float((x**2).sum(1).max())
    rows = negatives.augmented(x, longest)
    assert np.allclose((rows**2).sum(1), longest)
    pivots = negatives.choose_pivots(rows, 8)
    a = x[::50]
    low, high = negatives.brackets(negatives._distances(np.column_stack([a, np.zeros(len(a))]), pivots), (a**2).sum(1).astype(float), negatives._distances(rows, pivots), longest)
    exact = a @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    tenth = -np.sort(-exact, axis=1)[:, 9:10]
    assert (high < tenth).mean() > 0.3  # rows that need no check


def coded(rows, dim):
    """The contract, in loops."""
    rows = taken(rows, dim)
    width = dim // 16
    part = lambda q, p: q[p * width : (p + 1) * width]
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:64]
    books = [[part(r[2], p) for r in ranked] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min((far(v, e), i) for i, e in enumerate(book))
    for _ in range(2):
        for p, book in enumerate(books):
            at = [near(part(r[2], p), book)[1] for r in rows]
            groups = [[part(r[2], p) for r, k in zip(rows, at) if k == i] for i in range(len(book))]
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(groups, book)]
    found = [[near(part(r[2], p), books[p]) for p in range(16)] for r in rows]
    errors = [sum(f[0] for f in x) for x in found]
    import hashlib

    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for r, e in zip(rows, errors):
        total[r[1]] = total.get(r[1], 0) + e
    return sorted(((r[0], "".join(f"{f[1]:02x}" for f in x), e, total[r[1]], digest) for r, x, e in zip(rows, found, errors)), key=str)


@pytest.mark.parametrize("kind", ["plain", "odd", "few", "shuffled totals"])
def test_codes_equal_plain_loops(spark, kind, monkeypatch):
    rows = random_rows(150, 32)
    if kind == "odd":
        rows = rows[:80] + rows[:9] + [(i, None if v is None else v * 4, *r) for i, v, *r in ODD_VECTORS]
    if kind == "few":
        rows = rows[:20]
    if kind == "shuffled totals":
        monkeypatch.setattr(codes, "FEW_LABELS", 1)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert sorted(map(tuple, codes.compress(df).collect()), key=str) == coded(rows, 32)


def test_codes_of_other_widths_and_empty_tables(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1, "a", 1)], VECTORS)).count() == 0
    out = codes.compress(spark.createDataFrame([(2, [], 1, "a", 1), (1, [], None, "a", 1)], VECTORS)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in out) == [(1, "00" * 16, 0), (2, "00" * 16, 0)]
    out = codes.compress(spark.createDataFrame(random_rows(90, 20), VECTORS)).collect()
    assert len(out) == 90 and all(len(r.code) == 32 for r in out)


def test_cells_leave_few_entries_to_measure():
    rng = np.random.default_rng(5)
    book = codes.Cells(rng.integers(-90, 90, (64, 4)))
    x = rng.integers(-100, 100, (400, 4)).astype(np.int32)
    far = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
    entry, best = book.nearest(x)
    assert (best == far.min(1)).all() and (entry == far.argmin(1)).all()
