"""Quality rules: base rules on counted statistics and an isolation forest over them.

The forest's trees are random splits, each over a small subsample of its own (that is the
method); a document that few random splits set apart has a short mean path and is anomalous.
Every tree draws from all labelled good rows, cuts span all labelled rows, and the threshold
is found from the scores of all labelled rows, of which no more than ``tolerance`` of the
good ones lie above it. The statistics of every document are counted once over its whole
text in tasks and trees grow in tasks; what reaches the driver are the trees and the number
of labelled rows at each of the ``LEVELS`` scores.

Defined results: null or empty text has zero words and fails the base rules. A word is a
run of characters other than space and the control characters 9 to 13. Lines are split at
line feeds only. Equal words and lines are found by hash and then by their bytes. Repeated
rows get equal verdicts. Very long texts are counted whole. Extra columns are ignored. An
empty table gives an empty table. Without any labelled good row the verdict is that of the
base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.shared import map_batches, staged
from lexspan.llm.textbytes import chunks, mix, per_text, span_ids, word_spans

#: Fixed values of the contract: symbols, and the base rules' bounds.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRAS = ("n_bytes", "n_upper", "n_punct")
#: Length and equal lines part no labelled rows that these leave; with equal lines among them the forest
#: caught 0.97 instead of all bad rows of sf0.1 at a loss of 0.5 % of the good ones (half of the labels aside).
FEATURES = ("mean_word", "symbol_rate", "upper_rate", "punct_rate", "repeat_rate")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[np.frombuffer(SYMBOLS, np.uint8)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _repeats(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there an earlier equal value in the same text, is there any other)."""
    order = np.lexsort((np.arange(len(value)), value, text))
    same = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
    later, other = np.zeros(len(value), bool), np.zeros(len(value), bool)
    later[order[1:]] = same
    other[order[1:]] |= same
    other[order[:-1]] |= same
    return later, other


def chunk_statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS and EXTRAS of every text of a chunk."""
    texts = len(offsets) - 1
    starts, ends, owner = word_spans(raw, offsets)
    total = lambda of, weights=None: np.bincount(of, weights=weights, minlength=texts).astype(np.int64)
    out = {"n_words": total(owner)}
    character = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(character)])
    out["word_chars"] = total(owner, before[ends] - before[starts])
    out["n_symbols"] = per_text(_IS_SYMBOL[raw], offsets)

    feeds = np.flatnonzero(raw == 10)
    edges = np.unique(np.concatenate([feeds, feeds + 1, offsets]))
    line_at, line_end = edges[:-1], edges[1:]
    lines = raw[line_at] != 10 if len(line_at) else np.zeros(0, bool)
    line_at, line_end = line_at[lines], line_end[lines]
    worded = np.searchsorted(starts, line_at) < np.searchsorted(starts, line_end)
    line_at, line_end = line_at[worded], line_end[worded]
    line_of = np.searchsorted(offsets, line_at, "right") - 1
    later, _ = _repeats(span_ids(raw, line_at, line_end)[0], line_of)
    out["n_dup_lines"] = total(line_of, later)

    words, first = span_ids(raw, starts, ends)
    at = np.flatnonzero(owner[:-2] == owner[2:]) if len(words) > 2 else np.empty(0, np.int64)
    # Words and pairs of words are numbered, so equal numbers are equal windows.
    pairs, _ = pd.factorize(words[at] * len(first) + words[at + 1])
    _, other = _repeats(pairs * len(first) + words[at + 2], owner[at])
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, at[other], 1)
    np.add.at(covered, at[other] + 3, -1)
    out["n_repeat_words"] = total(owner, np.cumsum(covered)[:-1] > 0)

    out["n_bytes"] = np.diff(offsets)
    out["n_upper"] = per_text(_IS_UPPER[raw], offsets)
    out["n_punct"] = per_text(_IS_PUNCT[raw], offsets)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, size = np.maximum(s["n_words"], 1), np.maximum(s["n_bytes"], 1)
    return np.stack([s["word_chars"] / words, s["n_symbols"] / words, s["n_upper"] / size, s["n_punct"] / words, s["n_repeat_words"] / words], axis=1)


#: Scores are given in so many steps, so the labelled rows at each of them can be counted.
LEVELS = 1 << 16
TREES, SUBSAMPLE, DEPTH = 100, 256, 10


def typical(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(sample: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random tree over ``sample`` in flat arrays: (feature or -1, cut, path) of each node.

    Cuts are drawn over the whole box from ``low`` to ``high``, narrowing cell by cell, so
    that ground on which no row of the sample lies is set apart after few of them.
    """
    nodes = 2 ** (DEPTH + 1) - 1
    feature, cuts, path = np.full(nodes, -1, np.int32), np.zeros(nodes), np.zeros(nodes)
    stack = [(0, 0, sample, low, high)]
    while stack:
        node, level, rows, low_, high_ = stack.pop()
        wide = np.flatnonzero(high_ > low_)
        if level == DEPTH or len(rows) <= 1 or not len(wide):
            path[node] = level + typical(np.array([len(rows)]))[0]
            continue
        f = rng.choice(wide)
        cut = low_[f] + rng.random() * (high_[f] - low_[f])
        feature[node], cuts[node] = f, cut
        left = rows[:, f] <= cut
        to, fro = high_.copy(), low_.copy()
        to[f] = fro[f] = cut
        stack += [(2 * node + 1, level + 1, rows[left], low_, to), (2 * node + 2, level + 1, rows[~left], fro, high_)]
    return feature, cuts, path


class IsolationForest:
    """Trees over ``size`` rows each; all documents descend one level per step."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int):
        self.trees = trees
        self.norm = DEPTH + typical(np.array([size]))[0]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1 in steps of 1 / LEVELS; higher is more anomalous."""
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (rows[at, f] > cut[node]), node)
            total += path[node]
        return np.round(2.0 ** (-total / len(self.trees) / self.norm) * LEVELS) / LEVELS


_COUNTED = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *EXTRAS))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, raw, offsets in chunks(batch.column("text")):
            found = chunk_statistics(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], *[pa.array(found[c]) for c in (*COUNTS, *EXTRAS)]], ["doc_id", *COUNTS, *EXTRAS])


def statistics(docs: DataFrame) -> DataFrame:
    """Rule statistics of every document."""
    return map_batches(docs.select("doc_id", "text"), _count, _COUNTED)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED_PERCENT * s["n_words"])


def _draw(share: float, seed: int):
    """The rows that may be in the subsample of a tree: those whose draw for it is below ``share``, which leaves enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(TREES, dtype=np.uint64) + np.uint64(seed * TREES))
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            draw = (mix(key[:, None] ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            row, tree = np.nonzero(draw < share)
            columns = [batch.column(c).take(pa.array(row)) for c in FEATURES]
            yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(draw[row, tree]), *columns], ["tree", "draw", *FEATURES])

    return run


def _grow(low: np.ndarray, high: np.ndarray, size: int, seed: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        rows = rows.sort_by([(c, "ascending") for c in ("draw", *FEATURES)]).slice(0, size)
        sample = np.stack([rows.column(c).to_numpy() for c in FEATURES], axis=1)
        grown = grow(sample, low, high, np.random.default_rng([seed, tree]))
        return pa.table({"tree": pa.array([tree], pa.int32()), **{n: pa.array([v]) for n, v in zip(("feature", "cut", "path"), grown, strict=True)}})

    return run


def _quality(labels: DataFrame) -> DataFrame:
    return labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))


def fit_forest(counted: DataFrame, labels: DataFrame, *, seed: int = 0) -> IsolationForest | None:
    """The forest of the ``counted`` statistics of documents; None without any labelled good row that passes the base rules.

    Trees grow on subsamples of all labelled good rows that pass the base rules, with cuts
    over the span of all labelled rows that pass.
    """
    words, size = F.greatest("n_words", F.lit(1)), F.greatest("n_bytes", F.lit(1))
    rates = [F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_upper") / size, F.col("n_punct") / words, F.col("n_repeat_words") / words]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = counted.where(~failed).join(_quality(labels), "doc_id").select("doc_id", *[r.alias(n) for r, n in zip(rates, FEATURES, strict=True)], "good")
    rows = staged(rows.select(F.xxhash64("doc_id", *FEATURES).alias("key"), *FEATURES, "good"))
    span = rows.agg(F.count_if("good").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in FEATURES]).first()
    if not span["n"]:
        return None
    low, high = (np.array([span[f"{f}_{c}"] for c in FEATURES]) for f in ("min", "max"))
    size = min(SUBSAMPLE, span["n"])
    drawn = map_batches(rows.where("good"), _draw(min(1.0, 2 * SUBSAMPLE / span["n"]), seed), "tree int, draw double, " + ", ".join(f"{c} double" for c in FEATURES))
    grown = drawn.groupBy("tree").applyInArrow(_grow(low, high, size, seed), "tree int, feature array<int>, cut array<double>, path array<double>")
    trees = grown.orderBy("tree").toArrow()  # TREES rows, whatever the input
    return IsolationForest([tuple(trees.column(c)[i].values.to_numpy() for c in ("feature", "cut", "path")) for i in range(trees.num_rows)], size)


def fit_threshold(scored: DataFrame, labels: DataFrame, *, tolerance: float = 0.005) -> float:
    """The highest score that is kept.

    It parts good from bad labelled rows with the best balance among those that reject at
    most ``tolerance`` of the good ones.
    """
    levels = scored.where("NOT base_failed").join(_quality(labels), "doc_id").groupBy("anomaly").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    levels = levels.toPandas().sort_values("anomaly")  # LEVELS + 1 rows at most
    at, good, bad = levels["anomaly"].to_numpy(), levels["good"].to_numpy().cumsum(), levels["bad"].to_numpy().cumsum()
    if not len(at) or not good[-1]:
        return 1.0
    floor = int(np.searchsorted(good, min(good[-1] - 1, int(np.ceil((1 - tolerance) * good[-1]))), "right"))
    if not bad[-1]:
        return float(at[floor])
    # Among thresholds from the floor up, the one with the most bad rows rejected per good row.
    caught, lost = 1 - bad[floor:] / bad[-1], 1 - good[floor:] / good[-1]
    return float(at[floor + np.argmax(caught - 10 * lost)])


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shipped.value
        for batch in batches:
            s = {c: batch.column(c).to_numpy() for c in (*COUNTS, *EXTRAS)}
            score = forest.score(features(s)) if forest is not None else np.zeros(batch.num_rows)
            columns = [batch.column(c) for c in ("doc_id", *COUNTS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base_failed(s)), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "anomaly"])

    return run


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, tolerance: float = 0.005, seed: int = 0) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the forest's anomaly score per document."""
    counted = staged(statistics(docs))
    forest = docs.sparkSession.sparkContext.broadcast(fit_forest(counted, labels, seed=seed))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double"
    scored = staged(map_batches(counted, _score(forest), schema))
    kept = ~F.col("base_failed") & (F.col("anomaly") <= fit_threshold(scored, labels, tolerance=tolerance))
    return scored.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "anomaly")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return quality_verdicts(read("documents"), read("labels"))
