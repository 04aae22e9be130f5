"""Exact dedup and SimHash near-dedup."""

import random

import numpy as np
import pytest
import xxhash

from spanguard.llm import bloom, exact_dedup, simhash
from spanguard.llm.components import connected, local_roots


def squeeze(t):
    return "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")


def test_exact_decisions_of_odd_rows(odd):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(odd).collect()), key=str)
    assert len(got) == 11
    assert [x for x in got if x[2] == 3] == [(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]
    # null, null, "" and white space are one group; the longest original stays.
    assert sorted(x[3] for x in got if x[2] == 4) == [False, False, False, True]
    assert {x[1] for x in got if x[2] == 4} == {5}


def test_exact_deduplicate_keeps_columns_and_one_row(odd, none):
    out = exact_dedup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == 6
    assert len({squeeze(r.text) for r in out.collect()}) == 6
    assert exact_dedup.deduplicate(none).count() == 0 and exact_dedup.decisions(none).count() == 0
    twice = odd.where("doc_id = 1")
    assert exact_dedup.deduplicate(twice).count() == 1
    assert sorted(r.kept for r in exact_dedup.decisions(twice).collect()) == [False, True]


CLASHING = ["__a", "__c0", "__sha", "__node", "__text", "__maybe", "sha", "n", "id", "row", "maybe", "at", "found", "word", "bits", "node", "key", "keys", "of", "a", "k", "d1", "d2", "u", "root", "a.b", "__id", "_1"]


def test_columns_with_clashing_names_are_kept(odd):
    from pyspark.sql import functions as F

    extra = odd.select("doc_id", "text", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("text"), F.lit("-"))).alias(c) for c in CLASHING])
    for out in (exact_dedup.deduplicate(extra), simhash.drop_near_duplicates(extra)):
        assert out.columns == extra.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{'-' if r.text is None else r.text}" for r in rows for c in CLASHING)
    words = bloom.build(odd.where("doc_id > 3"), "text", bloom.size_for(9))
    out = bloom.flag(extra, "text", words, bloom.size_for(9), "in_it")
    assert out.columns == [*extra.columns, "in_it"] and out.count() == 11 and all(r["sha"].startswith("sha:") for r in out.collect())
    assert exact_dedup.decisions(extra).count() == 11


def test_bloom_never_misses(spark):
    keys = spark.range(3000).selectExpr("CAST(id % 1000 AS STRING) AS k")
    bits = bloom.size_for(3000)
    words = bloom.build(keys, "k", bits, least=2)
    asked = spark.range(4000).selectExpr("CAST(id AS STRING) AS k", "id")
    got = {r.id: r.f for r in bloom.flag(asked, "k", words, bits, "f").collect()}
    assert all(got[i] for i in range(1000)) and sum(got[i] for i in range(1000, 4000)) < 100


def brute(texts, k=3, tau=2):
    """{id: (fingerprint, smallest linked id)}"""
    fps = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
        count = [0] * 64
        for x in s:
            h = xxhash.xxh64_intdigest(x, seed=42)
            for b in range(64):
                count[b] += h >> b & 1
        fps[i] = sum(1 << b for b in range(64) if 2 * count[b] > len(s))
    ids, root = sorted(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= tau:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (fps[i], find(i)) for i in ids}


@pytest.mark.parametrize("tau", [0, 1, 2, 4])
def test_near_duplicates_equal_brute_force(spark, tau):
    rnd = random.Random(tau)
    vocab = [f"w{i}" for i in range(200)]
    texts = [(0, ""), (1, None), (2, "one two"), (3, "One TWO")]
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(3, 150))]
        for _ in range(rnd.randint(1, 6)):
            w = list(base)
            if rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = "changed"
            texts.append((len(texts), " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df, tau=tau).collect()}
    assert got == brute(texts, tau=tau)


def test_pigeonhole_loses_no_pair_of_a_dense_group():
    rng = np.random.default_rng(3)
    center = np.uint64(rng.integers(0, 2**63))
    flips = rng.integers(0, 64, (400, 3)).astype(np.uint64)
    fps = np.unique(np.bitwise_xor.reduce(np.uint64(1) << flips, axis=1) ^ center)
    for tau in (1, 2, 3, 5, 8):
        order = list(rng.permutation(64))
        choices = [simhash._cuts(order, m) for m in range(2, min(tau + 1, 10) + 1)]
        names = {tuple(s): i for i, s in enumerate({tuple(s) for parts in choices for p in parts for s in simhash._segments(p)})}
        bits = simhash._bits(fps.view(np.int64)).astype(np.float32)
        cells = {}
        for s, i in names.items():
            for v in simhash._segment_values(bits, list(s)):
                cells[i * 256 + int(v)] = cells.get(i * 256 + int(v), 0) + 1
        plan = simhash.allocate(choices, names, cells, fps.size, tau)
        assert sum(plan.thresholds) == tau - len(plan.parts) + 1
        masks = simhash._masks(plan)
        a, b = fps[:150, None], fps[None, :150]
        near = np.bitwise_count(a ^ b) <= tau
        met = np.zeros_like(near)
        for m, _ in masks:
            met |= (a & m) == (b & m)
        assert not (near & ~met).any()


def test_odd_rows_and_blocks(odd, none, monkeypatch):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert len(simhash.near_duplicates(odd).collect()) == 11
    assert got[3, 0] == got[4, 0] == got[5, 0] == 3 and got[None, 0] == 3
    assert simhash.near_duplicates(none).count() == 0
    monkeypatch.setattr(simhash, "BLOCK", 2)  # buckets in block pairs
    assert {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd).collect()} == got


def jaccard(a, b, k=5):
    def grams(t):
        w = t.lower().split()
        return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_drop_near_duplicates_of_planted_groups(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows, copies = [], set()
    for g in range(25):
        base = [rnd.choice(vocab) for _ in range(150)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rnd.randint(0, 4)):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            assert jaccard(" ".join(w), rows[-1][1]) >= 0.0
            copies.add(len(rows))
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, fp long")
    out = simhash.drop_near_duplicates(df)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == df.columns
    assert {i for i, _ in rows} - copies <= kept  # clean documents stay
    text = dict(rows)
    left = [(a, b) for a in kept for b in kept if a < b and jaccard(text[a], text[b]) >= 0.8]
    assert not left


@pytest.mark.parametrize("kind", ["appended", "truncated", "inserted"])
def test_drop_near_duplicates_of_texts_edited_in_one_run(spark, kind):
    rnd = random.Random(kind)
    vocab = [f"w{i}" for i in range(3000)]
    rows, copies = [], set()
    for _ in range(150):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 400))]
        n, run = len(base), [rnd.choice(vocab) for _ in range(100)]
        share = rnd.uniform(0.13, 0.18)
        at = {"appended": n, "inserted": rnd.randrange(n), "truncated": 0}[kind]
        copy = base[: n - int(n * share)] if kind == "truncated" else base[:at] + run[: int(n * share)] + base[at:]
        rows.append((len(rows), " ".join(base)))
        if 0.8 <= jaccard(rows[-1][1], " ".join(copy)) < 0.88:
            copies.add(len(rows))
            rows.append((len(rows), " ".join(copy)))
    assert len(copies) > 100
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - copies


def test_near_stage_links_all_fingerprints_within_its_distance(spark):
    rnd = random.Random(12)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    fps += [x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 10))) for x in fps for _ in range(2)]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "node long, fp long")
    got = {r.u: r.root for r in connected(simhash.simhash_links(nodes, 8)).collect()}
    assert got == {i: r for i, r in enumerate(root) if i != r} and 60 < len(set(root)) < 180 and len(set(fps)) < 180


def test_drop_near_duplicates_by_fingerprints(spark, monkeypatch):
    """What fingerprints find is found without the bands."""
    monkeypatch.setattr(simhash, "sketch_links", lambda nodes, sketch: spark.createDataFrame([], "u long, v long"))
    rnd = random.Random(13)
    base = [f"w{rnd.randrange(3000)}" for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join(rnd.sample(base, 400)))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_sketch_finds_pairs_at_the_least_similarity():
    sketch, rng = simhash.Sketch.make(0.8), np.random.default_rng(4)
    for _ in range(2000):
        grams = rng.integers(0, 2**63, 110).astype(np.uint64)
        low = np.array([sketch.minima(grams[:99]), sketch.minima(grams[11:])])  # 88 of 110 in both
        keys = sketch.keys(low)
        assert (keys[0] == keys[1]).any() and (low[0].astype(np.uint8) == low[1].astype(np.uint8)).sum() >= sketch.least


def test_clusters_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 4)
    monkeypatch.setattr(simhash, "TOKENS", 16)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice("xyz") + w if rnd.random() < 0.02 else w for w in base)) for i in range(40)]
    root = {i: i for i, _ in rows}
    for a, x in rows:
        for b, y in rows:
            if a < b and root[a] != root[b] and jaccard(x, y) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert 1 < len(set(root.values())) < 40
    assert {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(root.values())


def test_drop_near_duplicates_of_odd_rows(odd, none):
    out = simhash.drop_near_duplicates(odd)
    got = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns and got.count(1) == 2 and got.count(2) == 0 and len(got) == 10
    assert simhash.drop_near_duplicates(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(900, 950)] + [(7, 7)]
    got = {r.u: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 900 for i in (*range(901, 950), 1000))
    u, r = local_roots(np.array([5, 3]), np.array([4, 4]))
    assert dict(zip(u.tolist(), r.tolist())) == {4: 3, 5: 3}
