"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Correlated bits of the fingerprints are grouped into partitions. Each partition i gets its own threshold
t_i, with sum(t_i) = tau - partitions + 1, so that two fingerprints within tau bits are within t_i bits in
some partition i. Dynamic programming allocates the thresholds, and the number of partitions is chosen, so
that probes plus estimated candidates cost least; the estimates come from histograms over all fingerprints.
Fingerprints are then dealt by their probe keys and verified.

The pipeline's stage links by Jaccard similarity. Its candidates are the fingerprints of shingle sets within
STAGE_TAU bits, found in the same way; pairs of the similarity that lie further apart, which fingerprints can't
tell, come from MinHash bands. Candidates are joined to clusters, and each cluster is compared on the whole
shingle sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import as_column, cut, map_arrow, parts, table
from .components import connected, local_roots
from .words import mix

#: Costs in nanoseconds that the allocation weighs: making, shuffling and sorting a key; comparing a pair.
KEY_NS, PAIR_NS = 1500.0, 2.0
#: A bucket of more rows is compared in blocks, each block pair a group of its own.
BLOCK = 8192
SEGMENT_BITS = 8
MOST_PARTITIONS = 10
#: Bits in which the fingerprints of the pipeline's stage may differ.
STAGE_TAU = 8
#: Minima in a band, and the share of pairs at the least similarity that no band may find.
BAND_ROWS, MISS = 5, 1e-4
#: Texts of a cluster that are compared at once (two such blocks at most), shingles that a step counts, and
#: about how many rows of a group in blocks are compared with all blocks at first.
GROUP, TOKENS, PIVOTS = 512, 4096, 8


# ---------------------------------------------------------------- fingerprints
def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Runs of k words, space-joined; the whole sequence if there are fewer."""
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    text = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    first = np.cumsum(size) - size
    last = (first + size - 1)[k - 1 :].tolist()
    return [text[s:e] for s, e in zip(first.tolist(), last)]


def fingerprint(features: list[bytes], seed: int = 42) -> int:
    """64-bit SimHash as a signed integer: a bit is 1 if over half of the features' XXH64 have it."""
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(x, seed) for x in features], dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 without hashes."""
    if not h.size:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, h.size, 4096):  # bounds the unpacked bits of a long text
        part = h[s : s + 4096]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > h.size, bitorder="little").view(np.int64)[0])


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def fingerprints(docs: DataFrame, keep: list[str], text_col: str, shingle: int = 3) -> DataFrame:
    """keep, plus fp: the SimHash of the texts' word shingles; null is empty."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_column(batch, "__text")
            out = np.zeros(len(texts), dtype=np.int64)
            for i, x in enumerate(texts):
                out[i] = fingerprint(shingles(_words(x.as_py()), shingle))
            yield pa.RecordBatch.from_arrays([*(as_column(batch, c) for c in keep), pa.array(out)], [*keep, "fp"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("binary").alias("__text"))
    return map_arrow(rows, run, schema)


# ---------------------------------------------------------------- plan of the probes
@dataclass(frozen=True)
class Plan:
    """Bits of each partition, its threshold (-1: not probed), and the estimated pairs to compare."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    keys: int
    pairs: float


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8), bitorder="little").reshape(-1, 64)


def group_bits(together: np.ndarray, n: int) -> list[int]:
    """Order of the 64 bits in which each run of eight holds bits that correlate most."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, order = list(range(64)), []
    while left:
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while left and len(group) < SEGMENT_BITS:
            nxt = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        order += group
    return order


def _cuts(order: list[int], m: int) -> list[list[int]]:
    at = [round(64 * i / m) for i in range(m + 1)]
    return [order[a:b] for a, b in itertools.pairwise(at)]


def _segments(part: list[int]) -> list[list[int]]:
    k = math.ceil(len(part) / SEGMENT_BITS)
    at = [round(len(part) * i / k) for i in range(k + 1)]
    return [part[a:b] for a, b in itertools.pairwise(at)]


def _segment_values(bits: np.ndarray, segment: list[int]) -> np.ndarray:
    return bits[:, segment].astype(np.int64) @ (1 << np.arange(len(segment), dtype=np.int64))


def _sums(df: DataFrame, of, schema: str) -> dict:
    """Sums over all rows of the counts that `of` finds in each batch; bounded by the number of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for k, v in of(as_column(batch, "fp").to_numpy(zero_copy_only=False)):
                total[k] = total.get(k, 0) + v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["cell", "n"])

    rows = map_arrow(df.select("fp"), run, schema).groupBy("cell").agg(F.sum("n").alias("n"))
    return {r.cell: r.n for r in rows.collect()}  # at most 4,096 or some 20,000 cells


def make_plan(distinct: DataFrame, tau: int) -> Plan:
    """Choose partitions and thresholds from statistics over all distinct fingerprints."""

    def pairs_of_bits(fps: np.ndarray):
        b = _bits(fps).astype(np.float32)
        both = (b.T @ b).astype(np.int64)
        return [(i * 64 + j, int(both[i, j])) for i in range(64) for j in range(64)] + [(4096, fps.size)]

    cells = _sums(distinct, pairs_of_bits, "cell long, n long")
    n = cells.get(4096, 0)
    together = np.array([[cells.get(i * 64 + j, 0) for j in range(64)] for i in range(64)], dtype=np.float64)
    order = group_bits(together, n)
    choices = [_cuts(order, m) for m in range(2, min(tau + 1, MOST_PARTITIONS) + 1)] or [_cuts(order, 1)]
    segments = [s for parts in choices for part in parts for s in _segments(part)]
    names = {tuple(s): i for i, s in enumerate(segments)}

    def histograms(fps: np.ndarray):
        b = _bits(fps)
        found = []
        for s, i in names.items():
            count = np.bincount(_segment_values(b, list(s)), minlength=1)
            found += [(i * 256 + int(v), int(count[v])) for v in np.flatnonzero(count)]
        return found

    cells = _sums(distinct, histograms, "cell long, n long")
    return allocate(choices, names, cells, n, tau)


def _distances(cells: dict, name: int, width: int, n: int) -> np.ndarray:
    """Probability of each Hamming distance between two rows in a segment."""
    p = np.zeros(1 << width)
    for v in range(1 << width):
        p[v] = cells.get(name * 256 + v, 0)
    p /= max(n, 1)
    values = np.arange(1 << width)
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    return np.bincount(distance.ravel(), weights=np.outer(p, p).ravel(), minlength=width + 1)


def allocate(choices, names: dict, cells: dict, n: int, tau: int) -> Plan:
    """Dynamic programming over the partitions of each choice; the cheapest choice wins."""
    best: tuple[float, Plan] | None = None
    for parts in choices:
        m = len(parts)
        cost: list[dict[int, tuple[float, int, float]]] = []
        for part in parts:
            dist = np.ones(1)
            for s in _segments(part):
                dist = np.convolve(dist, _distances(cells, names[tuple(s)], len(s), n))
            w, of = len(part), {-1: (0.0, 0, 0.0)}
            for t in range(min(tau, w) + 1):
                keys = math.comb(w, t)
                pairs = n * n / 2 * sum(dist[d] * math.comb(w - d, t - d) for d in range(t + 1))
                of[t] = (max(n, 1) * keys * KEY_NS + pairs * PAIR_NS, keys, pairs)  # few keys also without rows
            cost.append(of)
        want = tau - m + 1
        state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for i, of in enumerate(cost):
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (c, ts) in state.items():
                for t, (more, _, _) in of.items():
                    k = total + t
                    if k - (m - 1 - i) <= want and (k not in after or c + more < after[k][0]):
                        after[k] = (c + more, (*ts, t))
            state = after
        if want not in state:
            continue
        c, ts = state[want]
        plan = Plan(tuple(map(tuple, parts)), ts, sum(cost[i][t][1] for i, t in enumerate(ts)), sum(cost[i][t][2] for i, t in enumerate(ts)))
        if best is None or c < best[0]:
            best = (c, plan)
    assert best is not None
    return best[1]


# ---------------------------------------------------------------- probe and verify
def _masks(plan: Plan) -> list[tuple[np.uint64, np.uint64]]:
    """(mask of the bits that must agree, salt) of each probe key."""
    out = []
    for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds)):
        if t < 0:
            continue
        for free in itertools.combinations(part, t):
            mask = sum(1 << b for b in part if b not in free)
            out.append((np.uint64(mask), np.uint64(((i << 48) + len(out) + 1) * 0x9E3779B97F4A7C15 % 2**64)))
    return out


def probe_keys(nodes: DataFrame, plan: Plan) -> DataFrame:
    """A row (key, and the columns of nodes) for each probe key of each fingerprint."""
    masks = _masks(plan)
    schema = T.StructType([T.StructField("key", T.LongType()), *nodes.schema])
    step = max(1, (1 << 17) // len(masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                batch = whole.slice(s, step)
                fp = as_column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
                with np.errstate(over="ignore"):
                    keys = np.concatenate([mix((fp & m) ^ salt) for m, salt in masks])
                again = pa.array(np.tile(np.arange(len(fp)), len(masks)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(as_column(batch, c).take(again) for c in batch.schema.names)], ["key", *batch.schema.names])

    return map_arrow(nodes, run, schema)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def linked(rows: DataFrame, counted: DataFrame, size: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (u, v) that connect all nodes of rows (key, node, ...) that have a key in common and compare alike.

    counted has a row for each row of `rows`, with its key. compare takes rows (part, guest, node, ...) sorted by
    part and links the nodes of each part; where a part has guests, those with the others only.

    A group of over `size` rows is compared in blocks, so that no task holds an unbounded group. At first each
    block is compared in itself and with a few pivots of the group, which joins dense groups in linear time. Only
    the rows outside the group's largest component then meet its other blocks, so no link is lost.
    """
    hot = cut(counted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size))
    many = hot.count()
    columns = [c for c in rows.columns if c != "key"]
    if not many:
        return compare(_dealt(rows.select(F.col("key").alias("part"), F.lit(0).alias("guest"), *columns)))
    side = F.broadcast(hot) if many <= 200_000 else hot
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / F.lit(size)).cast("int")
    placed = rows.join(side, "key", "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    part = lambda *of: F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", *of)).alias("part")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pivots = placed.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(5)), F.col("n")) < PIVOTS)).withColumn("to", every).where("to != own")
    home = placed.select(part("own"), F.lit(0).alias("guest"), *columns)
    first = cut(compare(_dealt(home.unionByName(pivots.select(part("to"), F.lit(0).alias("guest"), *columns)))))
    root = connected(first)
    split = placed.where("blocks > 1").join(root, F.col("node") == F.col("u"), "left").withColumn("root", F.coalesce("root", "node")).drop("u")
    each = split.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = each.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("rest")).where("rest > 0")
    main = cut(main)
    if main.isEmpty():
        return first
    split = split.join(main, "key").withColumn("outside", F.ceil(F.col("rest") / F.lit(size)).cast("int"))
    guests = split.where("root != main").withColumn("at", F.pmod(F.xxhash64("node", F.lit(7)), F.col("outside")).cast("int")).withColumn("to", every).where("to != own")
    hosts = split.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("outside") - 1)))
    pairs = hosts.select(part("own", "at"), F.lit(0).alias("guest"), *columns).unionByName(guests.select(part("to", "at"), F.lit(1).alias("guest"), *columns))
    return first.unionByName(compare(_dealt(pairs)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Batches that hold whole buckets only."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: as_column(batch, c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        key = now["part"]
        if not key.size:
            continue
        last = int(np.searchsorted(key, key[-1], side="left"))
        held = {c: v[last:] for c, v in now.items()}
        if last:
            yield {c: v[:last] for c, v in now.items()}
    if held is not None and held["part"].size:
        yield held


def _near(run: dict[str, np.ndarray], tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j, same bucket, at most tau bits apart), a bounded number at a time."""
    key, fp = run["part"], run["fp"].view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [key.size]]))
    bucket = np.repeat(size, size)
    for o in range(1, 32):  # small buckets, all at once
        i = np.flatnonzero((key[:-o] == key[o:]) & (bucket[:-o] <= 32)) if key.size > o else np.zeros(0, np.int64)
        if not i.size:
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + o]) <= tau]
        if i.size:
            yield i, i + o
    for s, n in zip(first[size > 32], size[size > 32]):
        for a in range(s, s + n, 1024):
            for b in range(a, s + n, 1024):
                x, y = fp[a : min(a + 1024, s + n)], fp[b : min(b + 1024, s + n)]
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= tau)
                i, j = i + a, j + b
                ordered = i < j
                if ordered.any():
                    yield i[ordered], j[ordered]


def _apart(pairs: Iterator[tuple[np.ndarray, np.ndarray]], guest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a guest and another; all pairs where there are no guests."""
    if not guest.any():
        yield from pairs
        return
    for i, j in pairs:
        mixed = guest[i] != guest[j]
        if mixed.any():
            yield i[mixed], j[mixed]


def hamming_links(nodes: DataFrame, plan: Plan, tau: int) -> DataFrame:
    """Edges (u, v) that connect all nodes (fp, node) within tau bits.

    What a batch of buckets links is contracted to stars before it leaves the task, so a dense group gives a
    row for each member, not for each pair; connectivity is kept whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            node, us, vs, held = part["node"], [], [], 0

            def contracted() -> pa.RecordBatch:
                u, v = local_roots(np.concatenate(us), np.concatenate(vs))
                return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

            for i, j in _apart(_near(part, tau), part["guest"]):
                us.append(node[i])
                vs.append(node[j])
                held += i.size
                if held > 1 << 19:
                    batch = contracted()
                    us, vs = [batch.column(0).to_numpy()], [batch.column(1).to_numpy()]
                    held = us[0].size
            if us:
                yield contracted()

    keys = probe_keys(nodes, plan)
    return linked(keys, keys.select("key"), BLOCK, lambda dealt: map_arrow(dealt, run, "u long, v long"))


# ---------------------------------------------------------------- operators
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 2) -> DataFrame:
    """One row per row of docs: id, fp (long), component_id.

    Rows whose fingerprints differ in tau bits or fewer are linked; component_id is the smallest id
    reachable, the row's own included (null ids don't count unless all are null). Texts without words, empty
    and null ones have fingerprint zero and link like any other. Repeated rows are all returned.
    """
    if tau > 8:
        raise ValueError("tau over 8 gives too many probe keys for 64-bit fingerprints")
    rows = cut(fingerprints(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")), ["__id"], "text", shingle))
    groups = cut(rows.groupBy("fp").agg(F.min("__id").alias("__low")))
    plan = make_plan(groups, tau)
    edges = hamming_links(groups.select("fp", F.col("fp").alias("node")), plan, tau)
    roots = connected(edges)
    # Of the fingerprints only; each component's smallest id, then back to the rows by fingerprint.
    comp = groups.join(roots, groups["fp"] == roots["u"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "__low")
    low = comp.groupBy(F.col("root").alias("__r")).agg(F.min("__low").alias("component_id"))
    of = comp.join(low, F.col("root") == F.col("__r")).select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(of, F.col("fp") == F.col("__fp")).select(F.col("__id").alias(id_col), "fp", "component_id")


@dataclass(frozen=True)
class Sketch:
    """Minima of shingle hashes under random multipliers: bands of BAND_ROWS make keys, their low bytes a sketch.

    A pair whose sets have the similarity agrees in each minimum with that probability, however its texts were
    edited. bands and least follow from it: a pair misses every band with a probability of MISS at most, and
    agrees in fewer than `least` minima with a tenth of that.
    """

    bands: int
    least: int
    by: np.ndarray

    @classmethod
    def make(cls, similarity: float, seed: int = 11) -> Sketch:
        if not 0.3 <= similarity <= 1:
            raise ValueError("similarity has to be from 0.3 to 1")
        bands = math.ceil(math.log(MISS) / math.log(max(1e-9, 1 - similarity**BAND_ROWS)))
        n, least, below = bands * BAND_ROWS, 0, 0.0
        while least < n:
            below += math.comb(n, least) * similarity**least * (1 - similarity) ** (n - least)
            if below > MISS / 10:
                break
            least += 1
        rng = np.random.Generator(np.random.PCG64(seed))
        return cls(bands, least, rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1) | np.uint64(1))

    def minima(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(self.by.size, 2**64 - 1, dtype=np.uint64)
        for s in range(0, grams.size, 1024):  # bounds the products of a long text
            np.minimum(low, (grams[s : s + 1024, None] * self.by[None, :]).min(axis=0), out=low)
        return low

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """texts x bands."""
        rows = minima.reshape(len(minima), self.bands, BAND_ROWS)
        key = mix(np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), rows.shape[:2]).copy())
        for r in range(BAND_ROWS):
            key = mix(key ^ rows[:, :, r])
        return key


def _grams(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles, sorted."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, 7) for g in shingles(_words(text), shingle)], dtype=np.uint64))


def _sketches(docs: DataFrame, shingle: int, sketch: Sketch) -> DataFrame:
    """(id, d1, d2, node, check, fp, keys, sketch) of texts that have words; node and check are hashes of the words,
    fp is the SimHash of the set of shingles."""
    schema = T.StructType([*(docs.schema[c] for c in ("id", "d1", "d2")), T.StructField("node", T.LongType()), T.StructField("check", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            texts = [x.as_py() for x in as_column(batch, "text")]
            grams = [_grams(x, shingle) for x in texts]
            fps = pa.array(np.array([majority(g) for g in grams], dtype=np.int64))
            low = np.array([sketch.minima(g) for g in grams])
            joined = [b" ".join(_words(x)) for x in texts]
            hashes = [pa.array(np.array([xxhash.xxh64_intdigest(x, seed) for x in joined], dtype=np.uint64).view(np.int64)) for seed in (1, 2)]
            keys = sketch.keys(low).view(np.int64)
            each = pa.ListArray.from_arrays(np.arange(len(low) + 1, dtype=np.int32) * sketch.bands, keys.ravel())
            sketches = pa.array([x.tobytes() for x in low.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(as_column(batch, c) for c in ("id", "d1", "d2")), *hashes, fps, each, sketches], schema.fieldNames())

    return map_arrow(docs.select("id", "d1", "d2", F.col("text").cast("binary").alias("text")), run, schema)


def _shared(keys: DataFrame) -> DataFrame:
    """The rows (key, node) whose key another row has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            same = part["part"][1:] == part["part"][:-1]
            here = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if here.any():
                yield pa.RecordBatch.from_arrays([pa.array(part[c][here]) for c in ("part", "node")], ["key", "node"])

    return map_arrow(_dealt(keys.withColumnRenamed("key", "part")), run, "key long, node long")


def _alike(key: np.ndarray, sketch: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j, same bucket, at least so many bytes of the sketches equal), a bounded number at a time."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [key.size]]))
    bucket = np.repeat(size, size)
    for o in range(1, min(32, key.size)):  # small buckets, all at once
        i = np.flatnonzero((key[:-o] == key[o:]) & (bucket[:-o] <= 32))
        if not i.size:
            break
        i = i[(sketch[i] == sketch[i + o]).sum(axis=1) >= least]
        if i.size:
            yield i, i + o
    for s, n in zip(first[size > 32], size[size > 32]):
        for a in range(s, s + n, 256):
            for b in range(a, s + n, 256):
                x, y = sketch[a : min(a + 256, s + n)], sketch[b : min(b + 256, s + n)]
                i, j = np.nonzero((x[:, None] == y[None, :]).sum(axis=2, dtype=np.int16) >= least)
                i, j = i + a, j + b
                ordered = i < j
                if ordered.any():
                    yield i[ordered], j[ordered]


def _stars(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that connect the nodes of the pairs: a row for each node, not for each pair."""
    us, vs, held = [], [], 0
    for u, v in pairs:
        us.append(u)
        vs.append(v)
        held += u.size
        if held > 1 << 19:
            u, v = local_roots(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], u.size
    if us:
        u, v = local_roots(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def simhash_links(nodes: DataFrame, tau: int) -> DataFrame:
    """Edges (u, v) that connect all nodes (node, fp) whose fingerprints differ in tau bits or fewer."""
    groups = cut(nodes.groupBy("fp").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")))
    first = groups.select("fp", F.col("low").alias("node"))
    many = groups.where("n > 1").select(F.col("fp").alias("f"), "low")
    same = nodes.join(many, F.col("fp") == F.col("f")).where("node != low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    return hamming_links(first, make_plan(first, tau), tau).unionByName(same)


def sketch_links(nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """Edges (u, v) that connect all nodes (node, keys, sketch) that share a key and have sketches alike."""
    shared = cut(_shared(nodes.select(F.explode("keys").alias("key"), "node")))
    rows = shared.join(nodes.select(F.col("node").alias("__n"), "sketch"), F.col("node") == F.col("__n")).select("key", "node", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            node, bytes_ = part["node"], np.frombuffer(b"".join(part["sketch"]), dtype=np.uint8).reshape(len(part["node"]), -1)
            yield from _stars((node[i], node[j]) for i, j in _apart(_alike(part["part"], bytes_, sketch.least), part["guest"]))

    return linked(rows, shared.select("key"), BLOCK, lambda dealt: map_arrow(dealt, run, "u long, v long"))


def similar_sets(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of sets with that Jaccard similarity, exactly; sides of two kinds are only compared with each other."""
    size = np.array([x.size for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(many > 1) - 1
    twice = many[token] > 1  # others are in one set only
    owner, token = owner[twice], number[token[twice]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for t in range(0, int(token[-1]) + 1 if token.size else 0, TOKENS):
        a, b = np.searchsorted(token, [t, t + TOKENS])
        has = np.zeros((len(sets), min(TOKENS, int(token[-1]) + 1 - t)), dtype=np.float32)
        has[owner[a:b], token[a:b] - t] = 1
        both += has @ has.T
    near = (both > 0) & (both >= similarity * (size[:, None] + size[None, :] - both.astype(np.float64)))
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(near, 1))


def _verified(clusters: DataFrame, contents: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (u, v) that connect the members of each cluster (u, root) whose shingle sets have that similarity.

    contents has for each node the digests (d1, d2) of a text, docs the texts. Each text goes to its cluster once,
    clusters of over GROUP texts are compared as linked() says, on whole shingle sets; only links leave a task.
    """
    member = clusters.unionByName(clusters.select(F.col("root").alias("u"), "root").distinct())
    member = cut(member.join(contents, F.col("u") == F.col("node")).select(F.col("root").alias("key"), "node", "d1", "d2"))
    bits = bloom.size_for(member.count())
    words = cut(bloom.build(member, "d1", bits))
    texts = bloom.flag(docs.select("d1", "d2", F.col("text").cast("binary").alias("text")), "d1", words, bits, "found")
    texts = texts.where("found").dropDuplicates(["d1", "d2"]).select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "text")
    rows = member.join(texts, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("key", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for guest, node, sets in _groups(batches, shingle):
                if len(sets) > 1:
                    i, j = similar_sets(sets, guest, similarity)
                    yield node[i], node[j]

        yield from _stars(compared())

    return linked(rows, member.select("key"), GROUP, lambda dealt: map_arrow(dealt, run, "u long, v long"))


def _groups(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(guests, nodes, shingle sets) of each part."""
    last, guests, nodes, sets = None, [], [], []
    for batch in batches:
        for part, guest, node, text in zip(*(as_column(batch, c) for c in ("part", "guest", "node", "text"))):
            if part.as_py() != last:
                if sets:
                    yield np.array(guests), np.array(nodes), sets
                last, guests, nodes, sets = part.as_py(), [], [], []
            guests.append(guest.as_py())
            nodes.append(node.as_py())
            sets.append(_grams(text.as_py(), shingle))
    if sets:
        yield np.array(guests), np.array(nodes), sets


def _apart_nodes(rows: DataFrame) -> DataFrame:
    """rows with nodes of their own for texts of other words that have the same 64-bit hash; as a rule there are none."""
    own = cut(rows.groupBy("node").agg(F.min("check").alias("own"), F.max("check").alias("other")).where("own != other").select("node", "own"))
    if own.isEmpty():
        return rows
    other = F.when(F.col("own").isNotNull() & (F.col("check") != F.col("own")), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return cut(rows.join(own, "node", "left").withColumn("node", other).select(rows.columns))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, tau: int = STAGE_TAU) -> DataFrame:
    """docs with one row left of each group of near-duplicates, the one with the smallest id (null ids last).

    Two texts are linked if their sets of `shingle`-word shingles (lower-cased, fewer words: the whole
    sequence) have a Jaccard similarity of `similarity` or more; groups are connected components. Candidates
    are all pairs whose SimHash fingerprints of these sets differ in `tau` bits or fewer. For the pairs of the
    similarity that lie further apart there are MinHash bands over the same shingles, which miss a pair with a
    probability of about MISS whatever the edits. Every link is verified on the whole sets. Texts of the same words are one node from the
    start. Texts without words, null and empty ones too, are left alone. Rows that repeat both id and text count
    as one document: they stay or go together. All columns are kept, whatever their names; an empty table gives
    no rows.
    """
    sketch = Sketch.make(similarity)
    text = F.col(f"`{text_col}`")
    known = [F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("d1"), F.xxhash64(text, F.lit(17)).alias("d2")]
    slim = docs.select(*known, text.alias("text"))
    spoken = slim.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    rows = _apart_nodes(cut(_sketches(spoken, shingle, sketch)))
    nodes = rows.select("node", "fp", "keys", "sketch").dropDuplicates(["node"])
    found = simhash_links(nodes.select("node", "fp"), tau).unionByName(sketch_links(nodes.select("node", "keys", "sketch"), sketch))
    clusters = connected(found)
    contents = rows.groupBy("node").agg(F.min(F.struct("d1", "d2")).alias("t")).select("node", "t.d1", "t.d2")
    comp = connected(_verified(clusters, contents, spoken, shingle, similarity))
    # The groups of two documents or more, the document of each that stays, and the others.
    own = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("d1").alias("c"), F.col("d2").alias("d"))
    of = rows.select("id", "d1", "d2", "node").join(comp, F.col("node") == F.col("u"), "left")
    of = cut(of.select("id", "d1", "d2", F.coalesce("root", "node").alias("group")))
    stays = of.groupBy(F.col("group").alias("g")).agg(F.min(own).alias("best"), F.max(own).alias("worst")).where(~F.col("best").eqNullSafe(F.col("worst")))
    gone = of.join(stays, F.col("group") == F.col("g")).where(~own.eqNullSafe(F.col("best")))
    gone = cut(gone.select(F.col("id").alias("i"), F.col("d1").alias("e1"), F.col("d2").alias("e2")).distinct())
    bits = bloom.size_for(gone.count())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *known)
    marked = bloom.flag(packed, "d1", cut(bloom.build(gone, "e1", bits)), bits, "maybe")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    kept = marked.where("maybe").join(gone, same, "left_anti")
    return marked.where(~F.col("maybe")).select("row.*").unionByName(kept.select("row.*"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
