"""Toxicity: a bidirectional gated recurrent network over words and their characters.

Every word enters as the sum of a hashed word vector and the mean of hashed vectors of
its byte n-grams. Two gated recurrent layers read a window in both directions, attention
pools their states, and a logistic unit scores the window. A text is cut into overlapping
windows that cover all its words; its score is that of its worst window, calibrated on
labelled texts that took no part in the training.

The network is trained in numpy on a bounded sample of labelled rows (``most_toxic`` and
``most_clean``). Labels say which texts are toxic, not where; so each round trains on the
window of every toxic text that scores highest so far, against windows of clean texts,
among them those that score highest. Vectors start from the words' and n-grams' log-odds.

Defined results: null, empty and word-free texts are one window without words and score 0.
Repeated rows and equal texts get equal scores. Very long texts are scored whole, in as
many windows as they need. Extra columns are ignored; ``lang``, ``source`` and labels are not
inputs. An empty table gives an empty table. Without a label of each kind every score is
the share of toxic labels (or 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.shared import fitted, map_batches
from lexspan.llm.textbytes import chunks, distinct, mix, span_hash, text_column, word_spans

WINDOW = 24
STRIDE = 12
WORD_BITS = 15
GRAM_BITS = 15
GRAMS = (3, 4, 5)
DIM = 8
HIDDEN = 10
ATTEND = 8
BATCH = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b".,;:!?", np.uint8)] = True


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans without one closing mark, and the text of each."""
    starts, ends, owner = word_spans(raw, offsets)
    if len(starts):
        ends = ends - ((ends - starts > 1) & _MARK[raw[ends - 1]])
    return starts, ends, owner


def grams_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of the byte n-grams of each word with its edges marked."""
    size = ends - starts + 2
    heads = np.cumsum(size) - size
    total = int(size.sum())
    place = np.arange(total) - np.repeat(heads, size)
    at = np.repeat(starts - 1, size) + place
    data = _LOWER[raw[np.clip(at, 0, len(raw) - 1)]].astype(np.uint64) + np.uint64(1)
    data[heads] = 300
    data[heads + size - 1] = 301
    owner = np.repeat(np.arange(len(starts)), size)
    buckets, owners = [], []
    value = data.copy()
    for n in range(2, max(GRAMS) + 1):
        if total < n:
            break
        value = value[: total - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n in GRAMS:
            inside = np.flatnonzero(place[: total - n + 1] + n <= np.repeat(size, size)[: total - n + 1])
            buckets.append((mix(value[inside] + np.uint64(n)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
            owners.append(owner[inside])
    bucket, of = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return bucket[order], of[order]


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the words of each window, text of the window); -1 where a window has no word.

    ``counts`` are the words of each text; the windows cover all of them.
    """
    many = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), many)
    turn = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    place = turn[:, None] * STRIDE + np.arange(WINDOW)
    first = (np.cumsum(counts) - counts)[text]
    return np.where(place < counts[text][:, None], first[:, None] + place, -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes; ``vocab`` rows are word inputs, the last row is the empty word."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": f(1 << WORD_BITS, DIM, scale=0.05),
            "gram": f(1 << GRAM_BITS, DIM, scale=0.05),
            "v": f(2 * HIDDEN, scale=0.3),
            "b": np.zeros(1, np.float32),
            "A": f(2 * HIDDEN, ATTEND, scale=0.3),
            "a": f(ATTEND, scale=0.3),
        }
        for d in "fb":
            self.p["W" + d] = f(2 * DIM, 3 * HIDDEN, scale=0.3)
            self.p["U" + d] = f(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p["c" + d] = np.zeros(3 * HIDDEN, np.float32)
        self.calibration = (1.0, 0.0)

    def inputs(self, keys: np.ndarray, bucket: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Vectors of words, given their hashes and n-grams."""
        n = len(keys)
        counts = np.maximum(np.bincount(of, minlength=n), 1).astype(np.float32)
        heads = np.searchsorted(of, np.arange(n))
        grams = np.add.reduceat(self.p["gram"][bucket], heads, axis=0) / counts[:, None]
        return np.concatenate([self.p["word"][self.slot(keys)], grams], axis=1)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - WORD_BITS)).astype(np.int64)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Each direction's input part of the gates, with a last row for the empty word."""
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return {d: x @ self.p["W" + d] + self.p["c" + d] for d in "fb"}

    def forward(self, gates: dict[str, np.ndarray], index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows; ``index`` points into the gates' rows, -1 at the empty word."""
        rows = len(index)
        states = np.empty((rows, WINDOW, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            u, h = self.p["U" + d], np.zeros((rows, HIDDEN), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g, r_ = gates[d][index[:, t]], h @ u
                zr = _sigmoid(g[:, : 2 * HIDDEN] + r_[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(g[:, 2 * HIDDEN :] + r * r_[:, 2 * HIDDEN :])
                before, h = h, n + z * (h - n)
                states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
                if keep is not None:
                    keep.append((d, t, before, z, r, n, r_[:, 2 * HIDDEN :]))
        inner = np.tanh(states @ self.p["A"])
        e = inner @ self.p["a"]
        e[index < 0] = -1e9
        e -= e.max(axis=1, keepdims=True)
        weight = np.exp(e) * (index >= 0)
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", weight, states)
        if keep is not None:
            keep.append((states, inner, weight, pooled))
        return pooled @ self.p["v"] + self.p["b"]

    def gradients(self, x, gates, index, target, importance) -> tuple[dict, np.ndarray]:
        """(gradients of all but the vectors, gradient of the word inputs ``x``)."""
        keep: list = []
        logit = self.forward(gates, index, keep)
        states, inner, weight, pooled = keep.pop()
        d_logit = ((_sigmoid(logit) - target) * importance / len(index)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        g["v"], g["b"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["v"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("bth,bh->bt", states, d_pooled)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["a"] = np.einsum("bt,btk->k", d_e, inner)
        d_inner = d_e[:, :, None] * self.p["a"] * (1 - inner**2)
        g["A"] = np.einsum("bth,btk->hk", states, d_inner)
        d_states += d_inner @ self.p["A"].T
        d_gates = {d: np.zeros_like(gates[d]) for d in "fb"}
        d_h = {d: np.zeros((len(index), HIDDEN), np.float32) for d in "fb"}
        for d, t, before, z, r, n, r_n in reversed(keep):
            k = 0 if d == "f" else HIDDEN
            dh = d_h[d] + d_states[:, t, k : k + HIDDEN]
            d_n = dh * (1 - z) * (1 - n**2)
            d_z = dh * (before - n) * z * (1 - z)
            d_r = d_n * r_n * r * (1 - r)
            recurrent = np.concatenate([d_z, d_r, d_n * r], axis=1)
            g["U" + d] += before.T @ recurrent
            d_h[d] = dh * z + recurrent @ self.p["U" + d].T
            np.add.at(d_gates[d], index[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
        d_x = np.zeros_like(x)
        for d in "fb":
            own = d_gates[d][:-1]
            g["W" + d], g["c" + d] = x.T @ own, d_gates[d].sum(axis=0)
            d_x += own @ self.p["W" + d].T
        return g, d_x

    def window_logits(self, gates: dict[str, np.ndarray], index: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(gates, index[i : i + BATCH]) for i in range(0, len(index), BATCH)])

    def score(self, logit: np.ndarray) -> np.ndarray:
        slope, shift = self.calibration
        return _sigmoid(slope * logit.astype(np.float64) + shift)


class _Corpus:
    """The sample's words, once each, with their n-grams; and its windows."""

    def __init__(self, texts: list[str]):
        keys, counts, words, heads = [], [], [], 0
        known: dict[int, int] = {}
        grams, owners, kept = [], [], []
        for _, _, raw, offsets in chunks(pa.array(texts, pa.large_string())):
            starts, ends, owner = words_of(raw, offsets)
            counts.append(np.bincount(owner, minlength=len(offsets) - 1))
            if not len(starts):
                continue
            unique, sample, which = np.unique(span_hash(raw, starts, ends, lower=True), return_index=True, return_inverse=True)
            new = np.array([k not in known for k in unique.tolist()])
            if new.any():
                bucket, of = grams_of(raw, starts[sample[new]], ends[sample[new]])
                grams.append(bucket)
                owners.append(of + heads)
                kept.append(unique[new])
                for i, k in enumerate(unique[new].tolist()):
                    known[k] = heads + i
                heads += int(new.sum())
            words.append(np.array([known[k] for k in unique.tolist()])[which])
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.keys, self.bucket, self.owner = cat(kept, np.uint64), cat(grams, np.int32), cat(owners, np.int64)
        self.words, self.counts = cat(words, np.int64), cat(counts, np.int64)
        self.heads = np.searchsorted(self.owner, np.arange(len(self.keys) + 1))
        index, self.text = windows_of(self.counts)
        self.index = np.where(index >= 0, np.append(self.words, -1)[index], -1).astype(np.int32)

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.heads[words + 1] - self.heads[words]
        at = np.arange(int(size.sum())) + np.repeat(self.heads[words] - (np.cumsum(size) - size), size)
        return self.bucket[at], np.repeat(np.arange(len(words)), size)

    def text_logits(self, net: Network) -> tuple[np.ndarray, np.ndarray]:
        """(logit of each text, its worst window)."""
        gates = net.gates(net.inputs(self.keys, self.bucket, self.owner))
        logit = net.window_logits(gates, self.index)
        order = np.lexsort((logit, self.text))
        last = order[np.searchsorted(self.text, np.arange(len(self.counts)), "right") - 1]
        return logit[last], last


def _log_odds(bad: np.ndarray, good: np.ndarray, bad_total: float, good_total: float) -> np.ndarray:
    odds = np.log((bad + 0.5) / (bad_total + 1)) - np.log((good + 0.5) / (good_total + 1))
    return np.clip(odds * np.minimum(1, (bad + good) / 8), -4, 4).astype(np.float32)


def _start_vectors(net: Network, corpus: _Corpus, toxic: np.ndarray) -> None:
    """The first coordinate of each vector: how much likelier the word is in toxic texts."""
    text = np.repeat(np.arange(len(corpus.counts)), corpus.counts)
    pair = np.unique(text * max(len(corpus.keys), 1) + corpus.words)
    word, bad = pair % max(len(corpus.keys), 1), toxic[pair // max(len(corpus.keys), 1)]
    of_bad = np.bincount(word[bad], minlength=len(corpus.keys)).astype(float)
    of_good = np.bincount(word[~bad], minlength=len(corpus.keys)).astype(float)
    slots = net.slot(corpus.keys)
    for name, size, spot, w in (("word", 1 << WORD_BITS, slots, np.arange(len(slots))), ("gram", 1 << GRAM_BITS, corpus.bucket, corpus.owner)):
        b, g = np.bincount(spot, weights=of_bad[w], minlength=size), np.bincount(spot, weights=of_good[w], minlength=size)
        scale = 1.0 if name == "word" else max(b.sum() + g.sum(), 1) / max(of_bad.sum() + of_good.sum(), 1)
        net.p[name][:, 0] = _log_odds(b, g, of_bad.sum() * scale / max(scale, 1), of_good.sum() * scale / max(scale, 1)) if name == "word" else _log_odds(b, g, b.sum() / scale, g.sum() / scale)


def train(texts: list[str], toxic: np.ndarray, *, rounds: int = 6, passes: int = 2, rate: float = 0.01, share: float | None = None, seed: int = 0) -> Network:
    """A calibrated network from labelled texts; one in four is set aside for the calibration.

    ``share`` is the toxic share of all labels where that of the texts given differs.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    toxic = np.asarray(toxic, bool)
    aside = np.arange(len(texts)) % 4 == 3
    if not (toxic & ~aside).any() or not (~toxic & ~aside).any():
        share = (toxic.mean() if len(toxic) else 0.0) if share is None else share
        net.calibration = (0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
        return net
    corpus = _Corpus([t for t, a in zip(texts, aside, strict=True) if not a])
    label = toxic[~aside]
    _start_vectors(net, corpus, label)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    by_text = np.searchsorted(corpus.text, np.arange(len(corpus.counts) + 1))
    mean_odds = np.append(net.inputs(corpus.keys, corpus.bucket, corpus.owner)[:, [0, DIM]].sum(axis=1), -9)
    score = mean_odds[corpus.index].max(axis=1)
    table = np.concatenate([corpus.index, np.full((1, WINDOW), -1, np.int32)])
    for turn in range(rounds):
        order = np.lexsort((score, corpus.text))
        worst = order[by_text[1:] - 1]
        clean_windows = np.flatnonzero(~label[corpus.text])
        chosen = np.concatenate([worst, rng.choice(clean_windows, min(len(clean_windows), 2 * len(worst)), replace=False)])
        chosen = np.concatenate([chosen, np.full(len(chosen) // 50 + 1, len(corpus.index))])  # a window without words is clean
        target = np.concatenate([label, np.zeros(len(chosen) - len(worst), bool)]).astype(np.float32)
        heavier = np.where(target > 0, max(1.0, (1 - target).sum() / max(target.sum(), 1) / 2), 1.0).astype(np.float32)
        for _ in range(passes):
            shuffle = rng.permutation(len(chosen))
            for i in range(0, len(shuffle), 512):
                at = shuffle[i : i + 512]
                index = table[chosen[at]]
                used, local = np.unique(index, return_inverse=True)
                local = local.reshape(index.shape) - (1 if used[0] < 0 else 0)
                used = used[used >= 0]
                if not len(used):
                    continue
                bucket, of = corpus.grams(used)
                x = net.inputs(corpus.keys[used], bucket, of)
                g, d_x = net.gradients(x, net.gates(x), local, target[at], heavier[at])
                step += 1
                size = np.bincount(of, minlength=len(used)).astype(np.float32)
                for name, spot, grad in (("word", net.slot(corpus.keys[used]), d_x[:, :DIM]), ("gram", bucket, d_x[of, DIM:] / size[of][:, None])):
                    rows, to = np.unique(spot, return_inverse=True)
                    total = np.stack([np.bincount(to, weights=grad[:, j], minlength=len(rows)) for j in range(DIM)], axis=1).astype(np.float32)
                    _adam(net.p[name], moments[name], rows, total, rate, step)
                for name, grad in g.items():
                    _adam(net.p[name], moments[name], slice(None), grad, rate, step)
        gates = net.gates(net.inputs(corpus.keys, corpus.bucket, corpus.owner))
        score = net.window_logits(gates, corpus.index)
        rate *= 0.8

    held = _Corpus([t for t, a in zip(texts, aside, strict=True) if a])
    logit, _ = held.text_logits(net)
    net.calibration = _fit_line(logit, toxic[aside], _importance(toxic, share)[aside])
    return net


def _adam(value, moments, rows, grad, rate, step) -> None:
    m, v = moments
    m[rows] = 0.9 * m[rows] + 0.1 * grad
    v[rows] = 0.99 * v[rows] + 0.01 * grad**2
    value[rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)


def _importance(toxic: np.ndarray, share: float | None) -> np.ndarray:
    """Weights of texts, 1 on average, that give the toxic ones the share they have in all labels."""
    own = toxic.mean()
    return np.ones(len(toxic)) if share is None else np.where(toxic, share / own, (1 - share) / (1 - own))


def _fit_line(logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the texts set aside, lightly held to 1 and 0."""
    a, b = 1.0, 0.0
    y = toxic.astype(float)
    for _ in range(200):
        p = _sigmoid(a * logit + b)
        w = weight * np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([(weight * (p - y) * logit).sum() + (a - 1), (weight * (p - y)).sum() + 0.1 * b])
        curve = np.array([[(w * logit * logit).sum() + 1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.1]])
        change = np.linalg.solve(curve, gradient)
        a, b = a - np.clip(change[0], -1, 1), b - np.clip(change[1], -1, 1)
    return float(max(a, 0.05)), float(b)


def batch_scores(net: Network, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, score of each text, its number of windows)."""
    for low, high, raw, offsets in chunks(text):
        starts, ends, owner = words_of(raw, offsets)
        index, of = windows_of(np.bincount(owner, minlength=high - low))
        if len(starts):
            keys, sample, which = distinct(span_hash(raw, starts, ends, lower=True))
            gates = net.gates(net.inputs(keys, *grams_of(raw, starts[sample], ends[sample])))
            index = np.where(index >= 0, np.append(which, -1)[index], -1)
        else:
            gates = net.gates(np.zeros((0, 2 * DIM), np.float32))
        logit = net.window_logits(gates, index)
        heads = np.searchsorted(of, np.arange(high - low))
        score = np.where(index[heads, 0] >= 0, net.score(np.maximum.reduceat(logit, heads)), 0.0)
        yield low, high, score, np.diff(np.append(heads, len(of)))


def _scoring(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, score, windows in batch_scores(shipped.value, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array(score), pa.array(windows, pa.int64())], ["doc_id", "score", "n_windows"])

    return run


def _dropping(shipped, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, score, _ in batch_scores(shipped.value, batch.column("text")):
                yield batch.slice(low, high - low).filter(pa.array(score < threshold))

    return run


def held_out(doc_id="doc_id"):
    """Rows that are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, *, most_toxic: int = 2500, most_clean: int = 4000, seed: int = 0) -> Network:
    """A network from at most so many labelled texts of each kind, drawn by a hash of their id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, bad = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count(F.lit(1)), F.sum("toxic")).first()
    share = bad / total if total else None  # the caps below may change it
    drawn = None
    for kind, most in ((1, most_toxic), (0, most_clean)):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.union(part)
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "text").limit(most_toxic + most_clean)

    def run(table: pa.Table) -> Network:
        return train(text_column(table["text"]).to_pylist(), table["toxic"].to_numpy() == 1, share=share, seed=seed)

    return fitted(sample, run) or train([], np.empty(0))


def toxicity_scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score and number of windows per document."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)  # about 3 MB, whatever the input
    return map_batches(docs.select("doc_id", "text"), _scoring(shipped), "doc_id long, score double, n_windows long")


#: Score from which a text counts as toxic (contract).
THRESHOLD = 0.3


def drop_toxic(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; nothing is shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    return map_batches(docs, _dropping(shipped, threshold), docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_scores(docs, net).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_windows")
