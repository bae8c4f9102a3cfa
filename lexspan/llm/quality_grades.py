"""Quality classifier: ordinal cumulative-link regression on hashed text.

One weight vector over hashed words and word pairs gives each document a latent value;
ordered thresholds part the values into grades: ``P(grade >= k) = s(value - t_k)``. The
expected grade and the probability of the highest grade follow; selection asks for a tail
probability. The weights are fitted in numpy on a bounded sample of labelled rows, every
document is scored in tasks over its whole text.

Grades are built from the two labels: 0 poor quality, 1 good quality but toxic, 2 good
and not toxic (toxic rows of poor quality: 0).

Defined results: null, empty and word-free texts have the value of no evidence, which is
that of the thresholds alone, and zero words. Repeated rows get equal results. Extra
columns are ignored. Very long texts are graded whole. An empty table gives an empty
table. Without labels all weights are 0 and the thresholds 0 and 1, so every document has
tail probabilities of 0.5 and 0.269.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.shared import fitted, map_batches
from lexspan.llm.textbytes import chunks, span_hash, text_column, windows_hash, word_spans

BITS = 17
GRADES = 3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = True


def _slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text, words per text): each word, each pair, each word's shape and last bytes."""
    starts, ends, owner = word_spans(raw, offsets)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    if not len(starts):
        return np.empty(0, np.int64), owner, counts
    words = span_hash(raw, starts, ends, lower=True)
    pairs, at = windows_hash(words, owner, 2)
    of = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int64)
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    signs = np.concatenate([[0], np.cumsum(_SIGN[raw])])
    shape = np.minimum(upper[ends] - upper[starts], 3) * 4 + np.minimum(signs[ends] - signs[starts], 3)
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    # The first 64 slots are set aside for shapes and for immediate repeats.
    slot = np.concatenate([np.maximum(of(words), 64), np.maximum(of(pairs), 64), shape + 16 * again])
    return slot, np.concatenate([owner, owner[at], owner]), counts


class CumulativeLink:
    """Shared weights and ordered thresholds."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.first = 0.0
        self.gaps = np.zeros(GRADES - 2)  # logarithms of the distances between thresholds

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def values(self, slot: np.ndarray, text: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=self.weights[slot], minlength=len(counts)) / np.maximum(counts, 1)

    def tails(self, value: np.ndarray) -> np.ndarray:
        """[document, k]: probability of grade k + 1 or more."""
        return 1 / (1 + np.exp(-np.clip(value[:, None] - self.thresholds, -40, 40)))


def train(texts: list[str], grades: np.ndarray, *, passes: int = 12, rate: float = 0.5, decay: float = 1e-6, seed: int = 0) -> CumulativeLink:
    """Adaptive-gradient ascent of the ordinal likelihood over the sample."""
    model, rng = CumulativeLink(), np.random.default_rng(seed)
    if not len(texts):
        return model
    grades = np.asarray(grades)
    share = np.array([(grades >= k).mean() for k in range(1, GRADES)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    model.first, model.gaps = float(start[0]), np.log(np.maximum(np.diff(start), 1e-2))
    slots, sizes = [], []
    for _, _, raw, offsets in chunks(pa.array(texts, pa.large_string())):
        slot, text, counts = _slots(raw, offsets)
        for group in np.split(np.arange(len(counts)), range(64, len(counts), 64)):
            inside = np.isin(text, group)
            key = np.unique(text[inside] * (1 << BITS) + slot[inside], return_counts=True)
            row, feature = key[0] >> BITS, key[0] & ((1 << BITS) - 1)
            edges = np.searchsorted(row, np.append(group, group[-1] + 1))
            for i, g in enumerate(group):
                slots.append((feature[edges[i] : edges[i + 1]], (key[1][edges[i] : edges[i + 1]] / max(counts[g], 1)).astype(np.float32)))
    squares = np.full(1 << BITS, 1e-4, np.float32)
    edge_squares = np.full(GRADES - 1, 1e-2)
    for _ in range(passes):
        order = rng.permutation(len(slots))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            feature = np.concatenate([slots[b][0] for b in batch])
            amount = np.concatenate([slots[b][1] for b in batch])
            row = np.repeat(np.arange(len(batch)), [len(slots[b][0]) for b in batch])
            value = np.bincount(row, weights=model.weights[feature] * amount, minlength=len(batch))
            tail = np.concatenate([np.ones((len(batch), 1)), model.tails(value), np.zeros((len(batch), 1))], axis=1)
            slope = tail * (1 - tail)
            g, at = grades[batch], np.arange(len(batch))
            p = np.maximum(tail[at, g] - tail[at, g + 1], 1e-9)
            up, down = slope[at, g] / p, slope[at, g + 1] / p
            d_value = (up - down) / len(batch)
            rows, to = np.unique(feature, return_inverse=True)
            gradient = np.bincount(to, weights=d_value[row] * amount, minlength=len(rows)).astype(np.float32) - decay * model.weights[rows]
            squares[rows] += gradient**2
            model.weights[rows] += rate * gradient / np.sqrt(squares[rows])
            d_t = np.zeros(GRADES + 1)
            np.add.at(d_t, g, -up / len(batch))
            np.add.at(d_t, g + 1, down / len(batch))
            d_t = d_t[1:GRADES]
            moved = np.array([d_t.sum(), *(d_t[j + 1 :].sum() * np.exp(model.gaps[j]) for j in range(GRADES - 2))])
            edge_squares += moved**2
            step = 0.05 * moved / np.sqrt(edge_squares)
            model.first += step[0]
            model.gaps += step[1:]
    return model


def _grading(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for low, high, raw, offsets in chunks(batch.column("text")):
                slot, text, counts = _slots(raw, offsets)
                value = model.values(slot, text, counts)
                tail = model.tails(value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array(counts, pa.int64()), pa.array(tail.sum(axis=1)), pa.array(tail[:, -1])], ["doc_id", "n_words", "expected_grade", "tail_probability"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = 12_000, seed: int = 0) -> CumulativeLink:
    """A model from at most ``most_rows`` labelled documents, drawn by a hash of their id."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    graded = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    drawn = graded.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "text").limit(most_rows)

    def run(table: pa.Table) -> CumulativeLink:
        return train(text_column(table["text"]).to_pylist(), table["grade"].to_numpy().astype(np.int64), seed=seed)

    return fitted(sample, run) or CumulativeLink()


def graded(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """doc_id, words, expected grade (0 to 2) and probability of the highest grade per document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # half a MB, whatever the input
    return map_batches(docs.select("doc_id", "text"), _grading(shipped), "doc_id long, n_words long, expected_grade double, tail_probability double")


#: Tail probability from which a document is selected.
SELECT = 0.5


def op6_quality_grades(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = graded(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.withColumn("kept", (F.col("tail_probability") >= SELECT) & (F.col("n_words") > 0))
