"""Packing of documents into fixed-length sequences with a controlled mixture of sources.

Every source is a queue of tokens. Each window (sequence) takes from every queue the
queue's quantum, ``window * share`` tokens; the fraction that integer tokens cannot
deliver stays in the queue's deficit counter and is delivered by a later window. Because
the quanta are constant, the counters after any number of rounds follow from the times at
which tokens are due, see ``RoundRobin``. So any partition can take up the round robin at
any window with the exact deficits, without knowing what other partitions do, and every
window but the last is full.

The queue position of a document follows from three sums: tokens before it in its
partition, tokens of its queue in earlier partitions, and nothing else; documents are
tokenised once, in place, and their ids are staged without a shuffle.

Defined results: null text counts as empty and gives the single end id; a null source is a
queue of its own, as is every other source. Repeated rows are packed as often as they
occur, ties in their order of reading. Very long texts are encoded whole and cut into as
many pieces as windows take them. Columns other than doc_id, source and text are ignored.
An empty table gives no pieces.

The target proportions are the sources' shares of all tokens: the only ones that every
window can keep when every token is packed once. The driver holds one number a source.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.shared import map_batches, staged
from lexspan.llm.textbytes import chunks, eights, equal_spans, span_hash, span_ids, word_spans

#: Rows up to which the table of queue bases is broadcast (about 40 bytes each).
BROADCAST_ROWS = 100_000


class WordEncoder:
    """Token ids of white-space separated words, each distinct word encoded once.

    The tokenizer drops white space and never joins across it, so the ids of a text are
    those of its words in order. Known words are a sorted array of 64-bit hashes with
    their bytes and ids in flat arrays; a word is known when its bytes are.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str("Ab") != "ab":
            raise ValueError(f"{path} does not fold case; its words can't be encoded by their lower-case form")
        self.limit = limit
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.gap = "\x01"
        (self.gap_id,) = self.tokenizer.encode(self.gap, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int32)
        self.ids = np.empty(0, self.kind)
        self.bytes = np.empty(0, np.uint8)

    def _look(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each word stands, whether it is known)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = (self.keys[place] == keys) & (self.size[place] == size)
        at = np.flatnonzero(known)
        known[at] = equal_spans(eights(raw), starts[at], eights(self.bytes), self.at[place[at]], size[at])
        return place, known

    def _learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Encodes words and gives where their ids begin, and how many there are."""
        data = raw.tobytes()
        ids, count = self._ids([data[a : a + n].decode("utf-8", "replace") for a, n in zip(starts.tolist(), size.tolist(), strict=True)])
        first = np.cumsum(count, dtype=np.int64) - count + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.keys, keys)
        # Of words with one hash only the first is kept; the others are encoded whenever they come.
        fresh = (self.keys[np.minimum(place, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), bool)
        fresh[1:] &= keys[1:] != keys[:-1]
        at = np.cumsum(size[fresh]) - size[fresh]
        inside = np.arange(int(size[fresh].sum())) - np.repeat(at, size[fresh])
        self.at = np.insert(self.at, place[fresh], at + len(self.bytes))
        self.bytes = np.concatenate([self.bytes, raw[np.repeat(starts[fresh], size[fresh]) + inside]])
        for name, value in (("size", size), ("first", first), ("count", count), ("keys", keys)):
            setattr(self, name, np.insert(getattr(self, name), place[fresh], value[fresh]))
        return np.stack([first, count.astype(np.int64)])

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each).

        Many words go into one call, with a word between them that is one id of its own and
        stands in none of them.
        """
        encode = lambda texts: [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if any(self.gap in w for w in words):
            parts = [x for w in words for x in encode([w])]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int32)
        texts = [f" {self.gap} ".join([*words[i : i + 256], ""]) for i in range(0, len(words), 256)]
        flat = np.concatenate([x for i in range(0, len(texts), 16) for x in encode(texts[i : i + 16])])
        cut = np.flatnonzero(flat == self.gap_id)
        return np.delete(flat, cut), (np.diff(np.concatenate([[-1], cut])) - 1).astype(np.int32)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the chunk, number of ids of each text)."""
        starts, ends, owner = word_spans(raw, offsets)
        texts = len(offsets) - 1
        if not len(starts):
            return np.empty(0, self.kind), np.zeros(texts, np.int64)
        starts, ends, owner = split_tails(raw, starts, ends, owner)
        raw = raw.copy()
        raw[starts] = _FOLD[raw[starts]]
        which, sample = span_ids(raw, starts, ends)
        if len(self.keys) + len(sample) > self.limit:
            self.clear()
        begin, size = starts[sample], (ends - starts)[sample]
        keys = span_hash(raw, begin, ends[sample])
        place, known = self._look(raw, keys, begin, size)
        where = np.zeros((2, len(sample)), np.int64)  # first id and number of ids of each distinct word
        where[:, known] = self.first[place[known]], self.count[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(keys[new], kind="stable")]
            where[:, new] = self._learn(raw, keys[new], begin[new], size[new])
        first, count = where[:, which]
        heads = np.cumsum(count) - count
        ids = self.ids[np.arange(int(count.sum())) + np.repeat(first - heads, count)]
        return ids, np.bincount(owner, weights=count, minlength=texts).astype(np.int64)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_TAIL = np.zeros(256, bool)
_TAIL[np.frombuffer(b".,;:!?", np.uint8)] = True


def split_tails(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a single mark after a final ASCII letter as two spans.

    The tokenizer separates letters from such a mark and folds case before it merges, so
    this (and a small first letter) changes no id, and fewer distinct words remain.
    """
    tail = (ends - starts > 1) & _TAIL[raw[ends - 1]] & _LETTER[raw[np.maximum(ends - 2, 0)]]
    at = np.flatnonzero(tail)
    count = 1 + tail
    begin, end = np.repeat(starts, count), np.repeat(ends, count)
    second = at + np.arange(len(at)) + 1
    begin[second] = ends[at] - 1
    end[second - 1] = ends[at] - 1
    return begin, end, np.repeat(owner, count)


_ENCODERS: dict[str, WordEncoder] = {}


def _tokenise(path: str, end_id: int, queues: dict[str | None, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        encoder, part, reached = _ENCODERS[path], TaskContext.get().partitionId(), {}
        for batch in batches:
            sources = batch.column("source").to_pylist()
            for low, high, raw, offsets in chunks(batch.column("text")):
                ids, counts = encoder.encode(raw, offsets)
                ends = np.cumsum(counts)
                whole = np.insert(ids, ends, encoder.kind(end_id))
                lengths = counts + 1
                queue = [queues[s] for s in sources[low:high]]
                begins = []
                for q, n in zip(queue, lengths.tolist(), strict=True):
                    begins.append(reached.get(q, 0))
                    reached[q] = begins[-1] + n
                edges = np.concatenate([[0], np.cumsum(lengths)]) * whole.itemsize
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(whole.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (high - low), pa.int32()), batch.column("doc_id")[low:high], pa.array(queue, pa.int32()), pa.array(lengths, pa.int64()), pa.array(begins, pa.int64()), blob.cast(pa.binary())],
                    ["part", "doc_id", "queue", "tokens", "begin", "ids"],
                )

    return run


class RoundRobin:
    """Tokens that each queue has delivered before a window.

    Token ``j`` of a queue of ``n`` is due at time ``(j + 0.5) / n``; tokens are delivered in
    the order of their times, those of one time in the order of the queues. A queue's count
    is so a rank that never falls and never exceeds its total, and at any time it is within
    half a token of its share, however many queues there are.
    """

    def __init__(self, totals: list[int], window: int):
        self.totals, self.window = np.array(totals, np.int64), window
        self.total = int(self.totals.sum())
        self.windows = -(-self.total // window)
        self.margin = 2 + len(totals) // window

    def _due(self, times: np.ndarray) -> np.ndarray:
        """[queue, time]: tokens due before each time."""
        due = np.ceil(self.totals[:, None] * times[None, :] - 0.5).astype(np.int64)
        return np.clip(due, 0, self.totals[:, None])

    def delivered(self, w: np.ndarray) -> np.ndarray:
        """[queue, window]: tokens delivered before each window of ``w``."""
        target = np.minimum(np.asarray(w, np.int64) * self.window, self.total)
        slack = len(self.totals) + 1
        low, high = np.clip((target - slack) / max(self.total, 1), 0, 1), np.clip((target + slack) / max(self.total, 1), 0, 1)
        for _ in range(64):
            middle = (low + high) / 2
            open_ = np.flatnonzero((middle > low) & (middle < high))
            if not len(open_):
                break
            found = self._due(middle[open_]).sum(axis=0)
            low[open_] = np.where(found <= target[open_], middle[open_], low[open_])
            high[open_] = np.where(found >= target[open_], middle[open_], high[open_])
        out = self._due(low)
        # What is due at one and the same time is delivered in the order of the queues.
        short = np.flatnonzero(out.sum(axis=0) < target)
        if len(short):
            more = self._due(high[short]) - out[:, short]
            out[:, short] += np.clip(target[short] - out[:, short].sum(axis=0) - (np.cumsum(more, axis=0) - more), 0, more)
        return out

    def near(self, queue: np.ndarray, position: np.ndarray) -> np.ndarray:
        """A window at most ``margin`` away from the one that takes the token at ``position`` of its queue."""
        out = np.empty(len(queue), np.int64)
        for rows in _blocks(len(queue), len(self.totals)):
            out[rows] = self._due((position[rows] + 0.5) / self.totals[queue[rows]]).sum(axis=0) // self.window
        return out


#: Entries of the tables (queues x windows) that a task holds at once, about: 32 MB each.
TABLE = 1 << 22


def _blocks(size: int, width: int) -> Iterator[slice]:
    step = max(1, TABLE // max(width, 1))
    return (slice(a, min(a + step, size)) for a in range(0, size, step))


def _touched(first: np.ndarray, last: np.ndarray, queues: int) -> Iterator[tuple[int, int]]:
    """Ranges of windows, of bounded size, that together hold all ranges ``first`` to ``last``."""
    order = np.argsort(first)
    reach = np.maximum.accumulate(last[order])
    heads = np.flatnonzero(np.concatenate([[True], first[order][1:] > reach[:-1]]))
    for a, b in zip(first[order][heads].tolist(), reach[np.append(heads[1:], len(order)) - 1].tolist(), strict=True):
        for block in _blocks(b - a, queues):
            yield a + block.start, a + block.stop


def _cut(totals: list[int], window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = RoundRobin(totals, window)
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, queue, tokens, begin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "queue", "tokens", "begin"))
            blobs = batch.column("ids")
            first = np.maximum(plan.near(queue, begin) - plan.margin, 0)
            last = np.minimum(plan.near(queue, begin + tokens - 1) + plan.margin + 1, plan.windows)
            by_queue = np.lexsort((begin, queue))
            for w0, w1 in _touched(first, last, len(totals)):
                done = plan.delivered(np.arange(w0, w1 + 1))
                before = np.cumsum(np.diff(done, axis=1), axis=0)  # tokens of a queue and those before it, by window
                rows = by_queue[(first[by_queue] < w1) & (last[by_queue] > w0)]
                for q, own in zip(*_groups(queue[rows], rows), strict=True):
                    cuts = done[q]
                    low, high = np.maximum(begin[own], cuts[0]), np.minimum(begin[own] + tokens[own], cuts[-1])
                    own, low, high = own[low < high], low[low < high], high[low < high]
                    if not len(own):
                        continue
                    points = np.unique(np.concatenate([low, high, cuts[(cuts > low[0]) & (cuts < high[-1])]]))
                    at = points[:-1]
                    which = np.searchsorted(low, at, "right") - 1
                    inside = at < high[which]  # not between rows that are no neighbours in the queue
                    at, end, which = at[inside], points[1:][inside], which[inside]
                    turn = np.searchsorted(cuts, at, "right") - 1
                    ahead = before[q - 1] if q else np.zeros(w1 - w0, np.int64)
                    row = own[which]
                    start, length = at - begin[row], end - at
                    pieces = []
                    for r, a, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                        data = blobs[r].as_buffer()
                        kind = np.dtype(np.uint16 if data.size == 2 * tokens[r] else np.uint32)
                        pieces.append(np.frombuffer(data, kind, n, a * kind.itemsize).astype("<u4").tobytes())
                    columns = {
                        "doc_id": pa.array(docs[row]),
                        "start": pa.array(start),
                        "length": pa.array(length),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                        "doc_tokens": pa.array(tokens[row]),
                        "sequence_id": pa.array(w0 + turn),
                        "offset": pa.array(ahead[turn] + at - cuts[turn]),
                        "queue": pa.array(np.full(len(at), q, np.int32)),
                    }
                    if with_ids:
                        columns["ids"] = pa.array(pieces, pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def _groups(queue: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    heads = np.flatnonzero(np.concatenate([[True], queue[1:] != queue[:-1]])) if len(rows) else np.empty(0, np.int64)
    return queue[heads].tolist(), np.split(rows, heads[1:]) if len(rows) else []


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``with_ids`` adds the piece's ids (little-endian unsigned 32-bit integers), from which
    sequences are put together by ``sequence_id`` and ``offset``.
    """
    docs = docs.select("doc_id", "source", "text")
    # One row a source, the largest first.
    sources = docs.groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b")).orderBy(F.desc("b"), F.asc_nulls_first("source")).collect()
    queues = {r["source"]: i for i, r in enumerate(sources)}

    ids = staged(map_batches(docs, _tokenise(tokenizer_path, end_id, queues), "part int, doc_id long, queue int, tokens long, begin long, ids binary"))
    sums = staged(ids.groupBy("queue", "part").agg(F.sum("tokens").alias("here")))
    base = sums.withColumn("base", F.sum("here").over(Window.partitionBy("queue").orderBy("part")) - F.col("here")).drop("here")
    found = {r["queue"]: r["total"] for r in sums.groupBy("queue").agg(F.sum("here").alias("total")).collect()}
    totals = [found.get(q, 0) for q in range(len(queues))]
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = ids.join(base, ["queue", "part"]).select("doc_id", "queue", "tokens", (F.col("begin") + F.col("base")).alias("begin"), "ids")
    return map_batches(placed, _cut(totals, window, with_ids), PIECE + (", ids binary" if with_ids else ""))


def pack_public(docs: DataFrame) -> DataFrame:
    """Packing with the word-level public vocabulary, as the contract's columns."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("queue")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_public(spark.read.parquet(f"{sf_dir}/documents.parquet"))
