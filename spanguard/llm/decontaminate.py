"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, verified exactly.

The CGK random walk maps a word sequence to a longer one such that a small edit distance becomes a small
Hamming distance. Each repetition draws its own walk and samples a few coordinates of the embedding; a
window and an item whose samples agree in some repetition are a candidate, which the exact edit distance
(bit-parallel, free ends in the text) accepts or rejects. Windows are embedded only where they can match at
all: an item-sized window with k word edits or fewer shares all but 2k of its word pairs with the item.

The walks of long items agree too rarely for any fixed number of repetitions, so what they don't settle is
verified too: each run of text in which some item-sized window holds that many word pairs of one item.
Windows are places in the words of a few texts, never copies of them, so memory doesn't grow with the items' length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_column, map_arrow, parts, table, text_slices
from .words import mix, split_words

#: Coordinates sampled in each repetition, the share of coordinates that agree at the most edits of a short
#: item, and the share to find by them; together they give the number of repetitions. The rest is verified.
SAMPLED, AGREE, RECALL = 2, 0.5, 0.99
#: Items whose texts have more bytes than this in all are handled in several passes over the documents.
BLOCK_BYTES = 32 << 20
#: Words of texts whose windows wait to be embedded together, and windows of one step.
HELD_WORDS, STEP_WINDOWS = 1 << 21, 4096
#: Repetitions before windows inside a match that was found are left out of the others; windows of long items begin
#: at each of so many places in an item's length, those of items up to this many words at every word.
FIRST_REPS, PLACES = 4, 64
PAD = np.uint64(0x5DEECE66D)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def repetitions(recall: float = RECALL, agree: float = AGREE, sampled: int = SAMPLED) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


def most_edits(words: int, similarity: float) -> int:
    return int(words * (1 - similarity) + 1e-9)


# ---------------------------------------------------------------- embedding
@dataclass
class Sampler:
    """Walks and sampled coordinates of all repetitions for windows of one size class."""

    steps: int
    seeds: np.ndarray  # of each repetition
    at: np.ndarray  # repetitions x sampled coordinates

    @classmethod
    def make(cls, size: int, reps: int, seed: int = 7) -> Sampler:
        rng = np.random.Generator(np.random.PCG64([seed, size]))
        steps = max(1, 2 * size)  # the walk moves on at every other step: over the whole window
        at = np.sort(rng.integers(0, steps, (reps, SAMPLED)), axis=1)
        return cls(int(at.max()) + 1, rng.integers(0, 2**63, reps).astype(np.uint64), at)

    def keys(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, reps: slice = slice(None)) -> np.ndarray:
        """Key of each window in the repetitions; a window begins at start, words holds PAD at its text's end."""
        seeds, sampled = self.seeds[reps, None], self.at[reps]
        place = np.repeat(start[None, :], seeds.size, axis=0)
        key = np.repeat(mix(seeds), start.size, axis=1)
        for j in range(self.steps):
            word = words[place]
            taken = np.flatnonzero((sampled == j).any(axis=1))
            if taken.size:
                key[taken] = mix(key[taken] ^ word[taken])
            step = (mix(word ^ (seeds + np.uint64(j))) >> np.uint64(17)) & np.uint64(1)
            place = np.minimum(place + step.astype(np.int64), end)
        return key


# ---------------------------------------------------------------- exact distance
def fit_distance(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(least edits, start, end) of item against any run of text; the first end that is best, then the longest run."""
    d, end = _best_end(item, text)
    if end == 0:
        return d, 0, 0
    _, back = _best_end(item[::-1], text[:end][::-1], d)
    return d, end - back, end


def _best_end(item: list[int], text: list[int], stop_at: int | None = None) -> tuple[int, int]:
    """Bit-parallel edit distance with a free start in text: (least edits, end of the first best run)."""
    m = len(item)
    if not m:
        return 0, 0
    eq: dict[int, int] = {}
    for i, w in enumerate(item):
        eq[w] = eq.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, w in enumerate(text):
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best or (score == stop_at and score == best):
            best, at = score, j + 1
            if best == stop_at:
                break
    return best, at


# ---------------------------------------------------------------- index of items
@dataclass
class SizeClass:
    low: int
    edits: int
    need: int
    width: int
    before: int
    sampler: Sampler
    keys: np.ndarray  # sorted
    items: np.ndarray  # item of each key
    pairs: np.ndarray  # word pairs of the members, sorted
    owners: np.ndarray  # item of each word pair


class ItemIndex:
    """Items by size class, with their keys, and a bitmap of their word pairs."""

    def __init__(self, texts: list[str | None], similarity: float):
        column = pa.array([t or "" for t in texts], pa.large_string())
        self.items: list[np.ndarray] = []
        for _, _, raw, offsets in text_slices(column):
            w = split_words(raw, offsets)
            self.items += np.split(w.hash, w.first_of_row(len(offsets) - 1)[1:-1])
        self.similarity = similarity
        self.size = np.array([w.size for w in self.items], dtype=np.int64)
        self.edits = np.array([most_edits(w.size, similarity) for w in self.items], dtype=np.int64)
        pairs = [_pairs(w) for w in self.items if w.size > 1]
        singles = [mix(w) for w in self.items if w.size == 1]
        found = np.unique(np.concatenate([*pairs, *singles])) if pairs or singles else np.zeros(0, np.uint64)
        self.bits = max(16, math.ceil(math.log2(64 * max(found.size, 1))))
        self.map = np.zeros(1 << self.bits, dtype=bool)
        self.map[(found & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True
        self.words = [frozenset(w.tolist()) for w in self.items]
        self.one = {int(w[0]): [] for w in self.items if w.size == 1}
        for i, w in enumerate(self.items):
            if w.size == 1:
                self.one[int(w[0])].append(i)
        self.classes = self._classes()

    def _classes(self) -> list[SizeClass]:
        sizes = sorted({w.size for w in self.items if w.size > 1})
        out, reps = [], repetitions()
        while sizes:
            low = sizes[0]
            high = max(s for s in sizes if s <= max(low, int(low * 1.2)))
            sizes = [s for s in sizes if s > high]
            members = [i for i, w in enumerate(self.items) if low <= w.size <= high]
            edits = most_edits(high, self.similarity)
            width = high + 2 * edits
            sampler = Sampler.make(low, reps)
            end = np.cumsum([self.items[i].size + 1 for i in members]) - 1
            start = np.concatenate([[0], end[:-1] + 1])
            keys = sampler.keys(np.concatenate([np.append(self.items[i], PAD) for i in members]), start, end)
            order = np.argsort(keys.ravel(), kind="stable")
            items = np.broadcast_to(np.array(members), keys.shape).ravel()
            own = [np.unique(_pairs(self.items[i])) for i in members]
            pairs, owners = np.concatenate(own), np.repeat(members, [x.size for x in own])
            by = np.argsort(pairs, kind="stable")
            out.append(SizeClass(low, edits, max(1, low - 1 - 2 * edits), width, edits, sampler, keys.ravel()[order], items[order], pairs[by], owners[by]))
        return out


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * _PAIR + words[1:])


def find(index: ItemIndex, column: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, edits, start, end, words of the text) for each row and item within the allowed edits.

    start and end count words; of several places the one with the fewest edits, then the first.
    """
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    held = Held(index, found)
    low_bits = np.uint64((1 << index.bits) - 1)
    for first, stop, raw, offsets in text_slices(column):
        w = split_words(raw, offsets)
        if not w.hash.size:
            continue
        bounds = w.first_of_row(stop - first)
        if index.one:
            for at in np.flatnonzero(np.isin(w.hash, np.array(list(index.one), dtype=np.uint64))):
                row = int(w.row[at])
                for i in index.one[int(w.hash[at])]:
                    place = int(at - bounds[row])
                    found.setdefault((first + row, i), (0, place, place + 1, int(bounds[row + 1] - bounds[row])))
        if w.hash.size < 2:
            continue
        hit = index.map[(_pairs(w.hash) & low_bits).astype(np.int64)]
        hit &= w.row[1:] == w.row[:-1]
        if not hit.any():
            continue
        text = Texts(first, w.hash, bounds)
        for k, c in enumerate(index.classes):
            total = np.zeros(hit.size + c.low + 1, dtype=np.int32)
            np.cumsum(hit, out=total[1 : hit.size + 1])
            total[hit.size + 1 :] = total[hit.size]
            start = np.flatnonzero(total[c.low - 1 : c.low - 1 + hit.size] - total[: hit.size] >= c.need)
            if start.size:
                cover = np.zeros(hit.size + c.low, dtype=np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + c.low - 1, -1)
                held.add(text, k, start, w.row[start], np.flatnonzero(hit & (np.cumsum(cover)[: hit.size] > 0)))
        if held.size >= HELD_WORDS:
            held.settle()
    held.settle()
    return sorted((r, i, *v) for (r, i), v in found.items())


@dataclass
class Texts:
    """Word hashes of a run of texts, the number of the first, and the first word of each."""

    first: int
    words: np.ndarray
    bounds: np.ndarray


class Held:
    """Windows that wait for the walks, by size class, as places in the words of a few texts."""

    def __init__(self, index: ItemIndex, found: dict) -> None:
        self.index, self.found = index, found
        self.clear()

    def clear(self) -> None:
        self.texts: list[Texts] = []
        self.windows: list[list[tuple]] = [[] for _ in self.index.classes]
        self.size = 0

    def add(self, text: Texts, k: int, start: np.ndarray, row: np.ndarray, dense: np.ndarray) -> None:
        """start, row: windows of class k that share enough word pairs with an item; dense: the word pairs in them."""
        if not self.texts or self.texts[-1] is not text:
            self.texts.append(text)
            self.size += text.words.size
        stride = max(1, self.index.classes[k].low // PLACES)
        if stride > 1:  # the first of each run of windows, and one of each stride
            new = np.ones(start.size, dtype=bool)
            new[1:] = np.diff(start) > 1
            ahead = start - np.repeat(start[new], np.diff(np.append(np.flatnonzero(new), start.size)))
            start, row = start[ahead % stride == 0], row[ahead % stride == 0]
        self.windows[k].append((len(self.texts) - 1, start, row, dense))

    def settle(self) -> None:
        if not self.texts:
            return
        # All words in one array, with PAD after each text; shift: where a slice's words begin in it.
        padded = [np.insert(t.words, t.bounds[1:], PAD) for t in self.texts]
        shift = np.cumsum([0, *(p.size for p in padded)])
        words = np.concatenate(padded)
        for c, windows in zip(self.index.classes, self.windows):
            if not windows:
                continue
            text = np.repeat([t for t, *_ in windows], [s.size for _, s, *_ in windows])
            start, row = (np.concatenate([w[k] for w in windows]) for k in (1, 2))
            begin = np.concatenate([self.texts[t].bounds[r] + r + shift[t] for t, _, r, _ in windows])
            end = np.concatenate([self.texts[t].bounds[r + 1] + r + shift[t] for t, _, r, _ in windows])
            start = start + row + shift[text]
            row = row + np.array([t.first for t in self.texts])[text]
            left = np.arange(start.size)
            for reps in (slice(0, FIRST_REPS), slice(FIRST_REPS, None)):
                spans = [self._walk(c, words, part, start, begin, end, row, reps) for part in np.array_split(left, -(-left.size // STEP_WINDOWS) or 1)]
                spans = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
                if spans.size:  # windows that begin in a match that was found
                    cover = np.zeros(words.size + 1, np.int32)
                    np.add.at(cover, np.maximum(spans[:, 0] - c.before, 0), 1)
                    np.add.at(cover, spans[:, 1], -1)
                    left = left[np.cumsum(cover)[start[left]] == 0]
            for t, _, _, dense in windows:
                _verify_rest(self.index, self.found, self.texts[t].first, self.texts[t].words, self.texts[t].bounds, c, dense)
        self.clear()

    def _walk(self, c: SizeClass, words: np.ndarray, part: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, reps: slice) -> list[tuple[int, int]]:
        """Verify the candidates of these windows, each run of them once; returns the places of what is found."""
        if not part.size or reps.start >= c.sampler.seeds.size:
            return []
        keys = c.sampler.keys(words, start[part], end[part], reps)
        lo, hi = np.searchsorted(c.keys, keys, side="left"), np.searchsorted(c.keys, keys, side="right")
        rep, win = np.nonzero(hi > lo)
        if not rep.size:
            return []
        many = hi[rep, win] - lo[rep, win]
        slot = np.repeat(lo[rep, win], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(c.items[slot] * part.size + np.repeat(win, many))  # by item, then window
        item, at = pairs // part.size, part[pairs % part.size]
        low, high = np.maximum(start[at] - c.before, begin[at]), np.minimum(start[at] + c.width, end[at])
        new = np.ones(at.size, dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (row[at[1:]] != row[at[:-1]]) | (low[1:] > high[:-1])
        cuts, spans = np.flatnonzero(new), []
        for a, b in zip(cuts.tolist(), (np.append(cuts[1:], at.size) - 1).tolist()):
            i, x = int(item[a]), at[a]
            run = words[low[a] : high[b]]
            # An item with so few edits has all but that many of its words in the run.
            if len(self.index.words[i].intersection(run.tolist())) < len(self.index.words[i]) - self.index.edits[i]:
                continue
            _verify(self.index, self.found, int(row[x]), i, int(low[a] - begin[x]), run, int(end[x] - begin[x]))
            if (got := self.found.get((int(row[x]), i))) is not None:
                spans.append((int(begin[x]) + got[1], int(begin[x]) + got[2]))
        return spans


def _verify_rest(index: ItemIndex, found: dict, first: int, words: np.ndarray, bounds: np.ndarray, c: SizeClass, at: np.ndarray) -> None:
    """Verify each run of words that can hold an item of the class; at: its word pairs in windows that pass.

    A window of an item's size at the start of a match holds all but 2k of its word pairs, so some `need` pairs
    of the item in order lie that close, and the match starts and ends within reach of them.
    """
    pair = mix(words[at] * _PAIR + words[at + 1])
    lo, hi = np.searchsorted(c.pairs, pair, side="left"), np.searchsorted(c.pairs, pair, side="right")
    many = hi - lo
    if not many.any():
        return
    slot = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, place = c.owners[slot], np.repeat(at, many)
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    row = np.searchsorted(bounds, place, side="right") - 1
    size, edits = index.size[item], index.edits[item]
    last = np.arange(item.size) + np.maximum(1, size - 1 - 2 * edits) - 1
    inside = last < item.size
    last = np.minimum(last, item.size - 1)
    near = np.flatnonzero(inside & (item[last] == item) & (row[last] == row) & (place[last] - place <= size - 2))
    if not near.size:
        return
    item, row, size = item[near], row[near], size[near]
    start = np.maximum(place[last[near]] - size + 2, bounds[row])
    stop = np.minimum(place[near] + size + edits[near], bounds[row + 1])
    new = np.ones(near.size, dtype=bool)  # runs that overlap are one
    new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (start[1:] > stop[:-1])
    cuts = np.flatnonzero(new)
    for a, b in zip(cuts, np.append(cuts[1:], near.size) - 1):
        r = int(row[a])
        s, e = int(start[a : b + 1].min()), int(stop[a : b + 1].max())
        _verify(index, found, first + r, int(item[a]), s - int(bounds[r]), words[s:e], int(bounds[r + 1] - bounds[r]))


def _verify(index: ItemIndex, found: dict, row: int, i: int, first: int, run: np.ndarray, length: int) -> None:
    """Record the item's best place in a run of words of a row, which begins at its word `first`."""
    have, item = found.get((row, i)), index.items[i]
    if have is not None and have[0] == 0 and have[1] <= first:
        return
    whole = np.flatnonzero(run[: max(0, run.size - item.size + 1)] == item[0])
    for k in (1, item.size // 2, item.size - 1):  # a few words rule most places out
        whole = whole[run[whole + k] == item[k]]
    at = next((int(p) for p in whole if np.array_equal(run[p : p + item.size], item)), None)
    d, start, end = (0, at, at + item.size) if at is not None else fit_distance(item.tolist(), run.tolist())
    if d <= index.edits[i]:
        new = (d, first + start, first + end, length)
        if have is None or new < have:
            found[row, i] = new


# ---------------------------------------------------------------- operators
def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of the different items, in blocks of bounded size."""
    rows = items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        got = sorted(part.collect(), key=lambda r: (r.i is None, r.i, r.t or ""))
        if got:
            yield [r.i for r in got], [r.t for r in got]


_INDEXES: dict[tuple, ItemIndex] = {}


def _index(texts: list[str | None], similarity: float) -> ItemIndex:
    """The index of this Python worker, built once for a block of items."""
    key = (hash(tuple(texts)), len(texts), similarity)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = ItemIndex(texts, similarity)
    return _INDEXES[key]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row per document row and item found in it: id, item id, edits, item_words, similarity, start_word, end_word.

    Words are lower-cased runs of letters and digits. An item of L words is found where some run of a text's
    words is within floor(L * (1 - similarity)) word edits of it; items under five words have to match
    exactly. None is missed at a similarity of 0.75 or more. Null or empty texts and
    items without words match nothing; rows of docs that repeat are each reported, items that repeat id and text
    once; empty tables give no rows; other columns aren't read.
    """
    out = None
    schema = T.StructType([docs.schema[id_col], T.StructField(item_id, items.schema[item_id].dataType), *(T.StructField(c, T.LongType()) for c in ("edits", "item_words")), T.StructField("similarity", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("start_word", "end_word"))])
    for ids, texts in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))  # of BLOCK_BYTES or so

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, texts = shared.value
            index = _index(texts, similarity)
            for batch in parts(batches, 2048):
                got = find(index, as_column(batch, "__text"))
                if not got:
                    continue
                row, item, edits, start, end, _ = (list(x) for x in zip(*got))
                size = [index.items[i].size for i in item]
                yield pa.RecordBatch.from_arrays(
                    [as_column(batch, id_col).take(pa.array(row)), pa.array([own[i] for i in item]), pa.array(edits), pa.array(size), pa.array([1 - d / n for d, n in zip(edits, size)]), pa.array(start), pa.array(end)],
                    schema.fieldNames(),
                )

        rows = map_arrow(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text")), run, schema)
        out = rows if out is None else out.unionByName(rows)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs without the rows in which leaks() finds an item; all columns, whatever their names, no shuffle.

    Null and empty texts stay, repeated rows stay or go together, an empty table gives no rows; without items, or
    with none that has words, all rows stay.
    """
    texts = items.select(F.lit(0).alias("i"), F.col(f"`{item_text}`").alias("t"))
    for _, texts in _blocks(texts, "i", "t"):
        shared = docs.sparkSession.sparkContext.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value, similarity)
            for batch in parts(batches, 2048):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r for r, *_ in find(index, as_column(batch, text_col))]] = False
                yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
