"""Language identification of words in code-switched text by a linear-chain conditional random field.

Affix, n-gram and lexicon features of each word give its emission scores, learned transitions join
neighbouring words, and forward-backward gives each word's label probabilities. A text's language is the one
with the largest mean probability over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_column, map_arrow, table, text_slices
from .words import Words, mix, split_words

#: Weights of a language; about so many texts of each language are drawn for training, and each sequence of
#: training has so many words, in runs of RUN words on average; steps of training.
TABLE_BITS, SAMPLE, SEQUENCE, RUN, STEPS = 18, 150, 48, 12, 40
#: More bounds of the training sample: languages, and bytes of a text.
MOST_LANGUAGES, SAMPLE_TEXT_BYTES = 256, 1 << 16
BLOCK = 32
_MASK = np.uint64((1 << TABLE_BITS) - 1)


# ---------------------------------------------------------------- features
def _salted(code: np.ndarray, salt: int) -> np.ndarray:
    return (mix(code.astype(np.uint64) * np.uint64(64) + np.uint64(salt)) & _MASK).astype(np.int32)


def word_features(w: Words) -> np.ndarray:
    """words x 7: the word itself (lexicon), prefixes and suffixes of one to three bytes."""
    raw = np.concatenate([w.raw, np.zeros(3, np.uint8)]).astype(np.int64)
    out = [(w.hash & _MASK).astype(np.int32)]
    size = w.end - w.start
    head = np.zeros(w.start.size, np.int64)
    tail = np.zeros(w.start.size, np.int64)
    for i in range(3):
        inside = size > i
        head = head * 257 + np.where(inside, raw[w.start + i] + 1, 0)
        tail = tail * 257 + np.where(inside, raw[np.maximum(w.end - 1 - i, 0)] + 1, 0)
        out += [_salted(head, 1 + i), _salted(tail, 11 + i)]
    return np.stack(out, axis=1)


def gram_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte trigrams of all words, word ends marked, and the first gram of each word."""
    size = w.end - w.start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first - w.start, size)
    here = w.raw[at].astype(np.int64)
    left = np.empty_like(here)
    left[1:] = here[:-1]
    left[first] = 0
    right = np.empty_like(here)
    right[:-1] = here[1:]
    right[first + size - 1] = 0
    return _salted((left << 16) | (here << 8) | right, 21), first


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """words x languages: sums of feature weights, grams averaged."""
    if not w.start.size:
        return np.zeros((0, weights.shape[1]), np.float32)
    grams, first = gram_features(w)
    size = (w.end - w.start).astype(np.float32)
    out = np.add.reduceat(weights[grams], first, axis=0) / size[:, None]
    for column in word_features(w).T:
        out += weights[column]
    return out


# ---------------------------------------------------------------- forward-backward
def posteriors(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of chains that lie one after the other; bounds: their first words, and the end.

    Chains are cut into blocks whose transfer matrices are multiplied for all blocks at once, so the steps
    taken one after the other are a block's words plus the blocks of the longest chain.
    """
    n, k = emission.shape
    if not n:
        return emission.copy()
    size = np.diff(bounds)
    blocks = -(-size // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    m = int(blocks.sum())
    chain = np.repeat(np.arange(size.size), blocks)
    inside = np.arange(m) - first_block[chain]
    start = bounds[:-1][chain] + inside * BLOCK
    length = np.minimum(BLOCK, bounds[1:][chain] - start)
    place = start[:, None] + np.arange(BLOCK)[None, :]
    real = np.arange(BLOCK)[None, :] < length[:, None]
    p = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.where(real[:, :, None], p[np.minimum(place, n - 1)], 0.0)
    t = np.exp(transition - transition.max())
    whole = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for j in range(BLOCK):
        live = np.flatnonzero(real[:, j])
        if not live.size:
            break
        step = (whole[live] @ t) * a[live, j][:, None, :]
        whole[live] = step / np.maximum(step.max(axis=(1, 2), keepdims=True), 1e-300)
    enter, leave = np.ones((m, k)), np.ones((m, k))
    most = int(blocks.max())
    has = [np.flatnonzero(blocks > j) for j in range(most)]
    for j in range(1, most):
        b = first_block[has[j]] + j
        x = np.einsum("nk,nkl->nl", enter[b - 1], whole[b - 1])
        enter[b] = x / np.maximum(x.max(axis=1, keepdims=True), 1e-300)
    for j in range(most - 1, 0, -1):
        b = first_block[has[j]] + j
        x = np.einsum("nkl,nl->nk", whole[b], leave[b])
        leave[b - 1] = x / np.maximum(x.max(axis=1, keepdims=True), 1e-300)
    forward = np.empty((m, BLOCK, k))
    f = enter
    for j in range(BLOCK):
        x = (f @ t) * a[:, j]
        x /= np.maximum(x.max(axis=1, keepdims=True), 1e-300)
        f = np.where(real[:, j][:, None], x, f)
        forward[:, j] = f
    out = np.empty((m, BLOCK, k))
    g = leave
    for j in range(BLOCK - 1, -1, -1):
        out[:, j] = forward[:, j] * g
        x = (a[:, j] * g) @ t.T
        x /= np.maximum(x.max(axis=1, keepdims=True), 1e-300)
        g = np.where(real[:, j][:, None], x, g)
    found = out[real]
    return found / found.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- model
@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray

    def label(self, w: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of the words, and the first word of each row and the end."""
        bounds = w.first_of_row(rows)
        p = np.ones((w.start.size, len(self.languages)))
        filled = np.flatnonzero(np.diff(bounds))
        if filled.size:
            chains = np.append(bounds[filled], bounds[-1])
            p = posteriors(emissions(w, self.weights), chains, self.transition)
        return p, bounds


def fit(texts: list[str], langs: list[str], seed: int = 5, steps: int = STEPS) -> Crf:
    """Train on sequences in which runs of words of texts in different languages alternate."""
    names = sorted(set(langs))
    label = {x: i for i, x in enumerate(names)}
    k, rng = len(names), np.random.Generator(np.random.PCG64(seed))
    order = np.array([label[x] for x in langs])
    w = None
    parts = []
    for first, stop, raw, offsets in text_slices(pa.array(texts, pa.large_string())):
        w = split_words(raw, offsets)
        if w.start.size:
            grams, at = gram_features(w)
            parts.append((word_features(w), grams, np.diff(np.append(at, grams.size)), order[first + w.row]))
    weights = np.zeros((1 << TABLE_BITS, k), np.float32)
    transition = np.zeros((k, k))
    if not parts:
        return Crf(names, weights, transition)
    words, grams, size, y = (np.concatenate([p[i] for p in parts]) for i in range(4))
    # Runs of words, dealt anew, make the code-switched sequences.
    cuts = np.flatnonzero(rng.random(y.size) < 1 / RUN)
    runs = np.split(np.arange(y.size), cuts)
    seq = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
    seq = seq[: max(1, seq.size // SEQUENCE) * SEQUENCE]
    first = np.cumsum(size) - size
    length = min(SEQUENCE, seq.size)
    s = seq.size // length
    seq = seq[: s * length]
    gold = y[seq].reshape(s, length)
    share = 1 / size
    gram_word = np.repeat(np.arange(y.size), size)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    observed = np.zeros((k, k))
    np.add.at(observed, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    for step in range(1, steps + 1):
        e = np.add.reduceat(weights[grams], first, axis=0) * share[:, None].astype(np.float32)
        for column in words.T:
            e += weights[column]
        x = e[seq].reshape(s, length, k).astype(np.float64)
        a, t = np.exp(x - x.max(axis=2, keepdims=True)), np.exp(transition)
        f, b = np.empty_like(a), np.empty_like(a)
        f[:, 0] = a[:, 0] / a[:, 0].sum(axis=1, keepdims=True)
        for j in range(1, length):
            z = (f[:, j - 1] @ t) * a[:, j]
            f[:, j] = z / z.sum(axis=1, keepdims=True)
        b[:, -1] = 1
        for j in range(length - 2, -1, -1):
            z = (a[:, j + 1] * b[:, j + 1]) @ t.T
            b[:, j] = z / z.sum(axis=1, keepdims=True)
        p = f * b
        p /= p.sum(axis=2, keepdims=True)
        pair = observed
        if length > 1:
            ahead = a[:, 1:] * b[:, 1:]
            each = np.einsum("sjk,kl,sjl->sj", f[:, :-1], t, ahead)
            pair = np.einsum("sjk,kl,sjl->kl", f[:, :-1] / each[:, :, None], t, ahead)
        g = np.zeros((y.size, k), np.float32)
        p[np.arange(s)[:, None], np.arange(length)[None, :], gold] -= 1
        g[seq] = p.reshape(-1, k)
        grad = np.zeros_like(weights)
        scaled = g * share[:, None].astype(np.float32)
        for c in range(k):
            grad[:, c] = np.bincount(grams, weights=scaled[gram_word, c], minlength=1 << TABLE_BITS)
            for column in words.T:
                grad[:, c] += np.bincount(column, weights=g[:, c], minlength=1 << TABLE_BITS)
        grad += 0.02 * weights
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        weights -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        transition += 0.5 * (observed - pair) / max(observed.sum(), 1) * k
    return Crf(names, weights, transition)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Crf:
    """Fit on a bounded sample: about `sample` texts of each language, drawn by a hash of the id.

    The MOST_LANGUAGES languages with most rows are learned. Rows whose language or text is null, and texts of
    over SAMPLE_TEXT_BYTES, aren't used; of rows that repeat id and language, the one with the smallest text is.
    """
    text = F.col(f"`{text_col}`")
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), text.alias("text")).where(F.col("lang").isNotNull() & (F.octet_length(text) <= SAMPLE_TEXT_BYTES))
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    count = {r["lang"]: r["n"] for r in most.collect()}
    if not count:
        return Crf([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((0, 0)))
    share = F.lit(0.0)
    for lang, n in count.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < share * 1_000_000)
    rows = drawn.groupBy("id", "lang").agg(F.min("text").alias("text")).collect()  # bounded by the sample
    rows.sort(key=lambda r: (r["id"] is None, r["id"], r["lang"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Crf, keep: list[str], text_col: str = "text", runs: bool = False) -> DataFrame:
    """keep, lang_pred, score, n_words, n_switches, and with runs=True also runs of words of one language.

    Null texts, and texts without a letter, are `und` with score 0; so is all where nothing was learned.
    runs: array of (first word, end, language).
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_switches", T.LongType())]
    if runs:
        fields.append(T.StructField("runs", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))))
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            texts = as_column(batch, "__text")
            n = len(texts)
            lang, score, count, switches, spans = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
            for first, stop, raw, offsets in text_slices(texts):
                w = split_words(raw, offsets)
                if not crf.languages or not w.start.size:
                    continue
                p, bounds = crf.label(w, stop - first)
                filled = np.flatnonzero(np.diff(bounds))
                mean = np.add.reduceat(p, bounds[filled], axis=0) / np.diff(bounds)[filled][:, None]
                best = mean.argmax(axis=1)
                lang[first + filled] = np.array(crf.languages, object)[best]
                score[first + filled] = np.clip(mean[np.arange(filled.size), best], 0, 1)
                count[first + filled] = np.diff(bounds)[filled]
                label = p.argmax(axis=1)
                change = np.flatnonzero((label[1:] != label[:-1]) & (w.row[1:] == w.row[:-1])) + 1
                switches[first : stop] = np.bincount(w.row[change], minlength=stop - first)
                if runs:
                    edges = np.unique(np.concatenate([change, bounds[filled]]))
                    for s, e in zip(edges, np.append(edges[1:], w.start.size)):
                        r = int(w.row[s])
                        spans[first + r].append({"start": int(s - bounds[r]), "end": int(e - bounds[r]), "lang": crf.languages[label[s]]})
                letters = ((raw | 32) >= 97) & ((raw | 32) <= 122)
                total = np.concatenate([[0], np.cumsum(letters)])
                for r in np.flatnonzero(total[offsets[1:]] == total[offsets[:-1]]):
                    if not _has_letter(texts[int(first + r)].as_py()):
                        lang[first + r], score[first + r] = "und", 0.0
            made = [pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(count), pa.array(switches)]
            if runs:
                made.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*(as_column(batch, c) for c in keep), *made], schema.fieldNames())

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")), run, schema)


def held_out(id_col: str = "doc_id"):
    """True for every fifth document by the CRC-32 of its id as text, and for null ids; training never sees them."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
