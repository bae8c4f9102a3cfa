"""Removal of long repeated byte strings with a run-length index.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else,
in the same text or another. Windows (strings of that length) are the unit of work:

1. *Anchors.* Each window is filed under the least hash among its ``GRAM``-byte strings,
   so equal windows meet wherever they are. Neighbouring windows with one anchor form a
   segment; a segment's bytes are its windows' bytes. Anchors are counted over the whole
   corpus. Those that are so frequent that they would fill a partition are set back
   behind all others and the count is repeated; then a window has a frequent anchor only
   when it lies inside frequent text, where segments are equal and counted once a task.
2. *Index.* A segment whose anchor occurs once can match nothing. Where all segments of an
   anchor are equal, their hashes travel and no bytes. The rest meet by anchor.
   Of each batch of segments a Burrows-Wheeler transform is built and compressed to its
   runs; at both ends of every run a sample holds the place in the text and the length
   of the match with the neighbouring suffix. Along the text a match shortens by one per
   byte until the next sample, so the samples give the matching statistics of every
   place in one streaming pass. Windows with a match of ``length`` are marked, as are all
   windows of a segment that occurs twice as a whole.
3. *Marks.* Texts are read again, segments find their marks by their hash, and the marked
   stretches of each text are merged and cut out. Judgements are made on the input only.

Segments are equal when their anchor (62 bits) and their hash modulo the prime 2**61 - 1 are.

Defined results: null text is empty; texts shorter than ``length`` lose nothing. A very long
text is cut in one chunk of its own. Repeated rows are separate texts that repeat each
other. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.shared import map_batches, staged
from lexspan.llm.textbytes import PrimeSums, chunks, mix, prefix_hash, text_column

LENGTH = 200
GRAM = 40
#: Bits of the tables of anchors that occur more than once and of those with unequal segments (8 MB
#: each, whatever the input). Others that share a place with one of them only cost work.
FILTER_BITS = 26
#: Bytes of segments that one index holds, unless a single anchor has more.
INDEX_BYTES = 1 << 20
#: Times that frequent anchors are set back.
SET_BACK = 2
SEPARATOR = 0xFF  # never occurs in UTF-8

def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Frequent:
    """A bounded set of anchors that come after all others."""

    def __init__(self, anchors: np.ndarray):
        self.anchors = np.sort(anchors.astype(np.uint64))
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.anchors >> np.uint64(40)).astype(np.int64) & 0xFFFF] = True

    def set_back(self, value: np.ndarray) -> np.ndarray:
        """Anchors have 62 bits; bit 62 puts the frequent ones last."""
        if not len(self.anchors):
            return value
        at = np.flatnonzero(self.near[(value >> np.uint64(40)).astype(np.int64) & 0xFFFF])
        place = np.minimum(np.searchsorted(self.anchors, value[at]), len(self.anchors) - 1)
        at = at[self.anchors[place] == value[at]]
        value[at] |= np.uint64(1 << 62)
        return value


def doubled(value: np.ndarray, least: np.ndarray, whole: np.ndarray, width: int) -> np.ndarray:
    """Anchors that occur twice within one window's reach, so that a segment may repeat itself.

    A place holds an anchor if its hash is the least of some window over it, that is, the
    greatest least of all of them. Two places of one anchor with nothing between are neighbours.
    """
    low = np.where(whole, least, np.uint64(0))
    fill = np.zeros(width - 1, np.uint64)
    reach = np.concatenate([fill, low, fill])
    most = ~sliding_least(~reach, width)
    at = np.flatnonzero(value == most[: len(value)])
    again = (value[at[1:]] == value[at[:-1]]) & (np.diff(at) <= width)
    return value[at[1:]][again]


def segments(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, frequent: Frequent, counting: bool = False, bits: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the bytes, first byte, windows, text) of the segments of a chunk.

    ``counting`` gives only the first two. ``bits``: only segments with an anchor in this
    table or one that is doubled; the latter have a negative number of windows.
    """
    count = len(raw) - length + 1
    if count <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    total, down = prefix_hash(raw)
    grams = len(raw) - gram + 1
    value = mix((total[gram:] - total[:grams]) * down[:grams]) >> np.uint64(2)
    value = frequent.set_back(value)
    least = sliding_least(value, length - gram + 1)
    sizes = np.diff(offsets)
    whole = np.arange(count) + length <= np.repeat(offsets[1:], sizes)[:count]
    same = np.zeros(count, bool)
    same[1:] = (least[1:] == least[:-1]) & whole[:-1]
    starts = np.flatnonzero(whole & ~same)
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    windows = np.add.reduceat(whole, starts, dtype=np.int64)
    if bits is not None:
        again = np.isin(least[starts], doubled(value, least, whole, length - gram + 1))
        kept = np.flatnonzero(again | _in_table(bits, least[starts].view(np.int64)))
        starts, windows, again = starts[kept], windows[kept], again[kept]
    digest = PrimeSums(raw).hash(starts, starts + windows + length - 1).view(np.int64)
    anchor = least[starts].view(np.int64)
    if counting:
        return anchor, digest
    if bits is not None:
        windows = np.where(again, -windows, windows)
    return anchor, digest, starts, windows, np.searchsorted(offsets, starts, "right") - 1


def _count(length: int, gram: int, frequent: Frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column("text")):
                anchor, digest = segments(raw, offsets, length, gram, frequent, True)[:2]
                order = np.argsort(anchor)
                anchor, digest = anchor[order], digest[order]
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else order
                if len(first):
                    low, high = np.minimum.reduceat(digest, first), np.maximum.reduceat(digest, first)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(np.diff(np.append(first, len(anchor)))), pa.array(low), pa.array(high)], ["anchor", "times", "low", "high"])

    return run


def _slot(anchor: np.ndarray) -> np.ndarray:
    return mix(anchor.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)


def _in_table(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    slot = _slot(anchor)
    return bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1) > 0


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = _slot(batch.column("anchor").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], ["word", "bit"])


class Scan:
    """What tasks need to cut texts into the segments that may have a match."""

    def __init__(self, length: int, gram: int, frequent: Frequent, bits: np.ndarray, mixed: np.ndarray):
        self.length, self.gram, self.frequent, self.bits, self.mixed = length, gram, frequent, bits, mixed

    def open_segments(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, hash, first byte, windows, text, are bytes needed) of segments that may have a match."""
        anchor, digest, starts, windows, text = segments(raw, offsets, self.length, self.gram, self.frequent, bits=self.bits)
        return anchor, digest, starts, np.abs(windows), text, (windows < 0) | _in_table(self.mixed, anchor)


def _gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum(sizes)])
    data = raw[np.arange(int(edges[-1])) + np.repeat(starts - edges[:-1], sizes)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


PLACE = "key long, doc_id long, start int, anchor long, digest long, windows long, sent boolean, data binary"


def _cut(shipped):
    """Every open segment with its place. The first of its kind in a task is sent, with its bytes where they are needed; so is the second, without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shipped.value
        once: set[int] = set()
        twice: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for low, _, raw, offsets in chunks(batch.column("text")):
                anchor, digest, starts, windows, text, mixed = scan.open_segments(raw, offsets)
                sent = np.zeros(len(digest), bool)
                first = np.zeros(len(digest), bool)
                for i, d in enumerate(digest.tolist()):
                    if d not in once:
                        once.add(d)
                        first[i] = sent[i] = True
                    elif d not in twice:
                        twice.add(d)
                        sent[i] = True
                with_bytes = first & mixed
                sizes = np.where(with_bytes, windows + scan.length - 1, 0)
                data = _gather(raw, starts, sizes)
                columns = [keys[low + text], (starts - offsets[text]).astype(np.int32), anchor, digest, windows, sent]
                arrays = [*[pa.array(c) for c in columns], pc.if_else(pa.array(with_bytes), data, pa.scalar(None, pa.binary()))]
                arrays.insert(1, batch.column("doc_id").take(pa.array(low + text)))
                yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "start", "anchor", "digest", "windows", "sent", "data"])

    return run


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number (zeros behind the end)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    return key


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array by doubling, from ranks of eight bytes; settled suffixes are not sorted again."""
    n, step = len(text), 8
    key = packed(text)
    order = np.argsort(key)
    rank, slot = np.empty(n, np.int64), np.arange(n)
    key = key[order]
    while len(slot):
        head = np.ones(len(slot) + 1, bool)
        head[1:-1] = key[1:] != key[:-1]
        rank[order[slot]] = np.maximum.accumulate(np.where(head[:-1], slot, 0))
        open_ = ~(head[:-1] & head[1:])
        if step >= n:
            tied = slot[open_]  # only ends of the text that zeros made equal
            order[tied] = order[tied][np.lexsort((-order[tied], rank[order[tied]]))]
            break
        slot = slot[open_]
        at = order[slot]
        ahead = np.zeros(len(at), np.int64)
        inside = at + step < n
        ahead[inside] = rank[at[inside] + step] + 1
        key = rank[at] << 32 | ahead
        turn = np.argsort(key)
        order[slot], key = at[turn], key[turn]
        step *= 2
    return order


def common_length(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common start of the suffixes at ``a`` and ``b``, up to about ``most``."""
    n, found, key = len(text), np.zeros(len(a), np.int64), packed(text)
    live = np.arange(len(a))
    while len(live):  # eight bytes at a time
        x, y = a[live] + found[live], b[live] + found[live]
        same = (x + 8 <= n) & (y + 8 <= n) & (found[live] < most)
        same[same] = key[x[same]] == key[y[same]]
        live = live[same]
        found[live] += 8
    live = np.arange(len(a))
    for _ in range(8):
        x, y = a[live] + found[live], b[live] + found[live]
        same = (x < n) & (y < n)
        same[same] = text[x[same]] == text[y[same]]
        live = live[same]
        found[live] += 1
    return found


class RunIndex:
    """A run-compressed Burrows-Wheeler transform with samples at both ends of each run."""

    def __init__(self, text: np.ndarray, most: int):
        order = suffix_order(text)
        self.size = len(text)
        before = text[order - 1].astype(np.int16)  # the character before each suffix
        before[order == 0] = -1
        edge = np.ones(len(text) + 1, bool)  # no run goes on over a separator or the start
        edge[1:-1] = (before[1:] != before[:-1]) | (before[1:] == SEPARATOR) | (before[1:] < 0) | (before[:-1] < 0)
        self.heads = np.flatnonzero(edge[:-1])
        self.characters = before[self.heads]
        tails = np.flatnonzero(edge[1:])
        first, last = self.heads[self.heads > 0], tails[tails < len(text) - 1]
        zero = np.concatenate([self.heads[self.heads == 0], tails[tails == len(text) - 1]])
        self.samples = [(order[first], common_length(text, order[first], order[first - 1], most)), (order[last], common_length(text, order[last], order[last + 1], most)), (order[zero], np.zeros(len(zero), np.int64))]

    def matching_statistics(self) -> np.ndarray:
        """For each place the longest match that starts at another place, streamed from the samples."""
        best = np.zeros(self.size, np.int64)
        for place, match in (self.samples[0], self.samples[1]):
            reach = np.zeros(self.size, np.int64)
            np.maximum.at(reach, place, place + match)
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(self.size))
        return best


def mark_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows also start elsewhere among the segments."""
    sizes = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    matches = RunIndex(text, int(sizes.max())).matching_statistics() >= length
    heads = np.cumsum(sizes) - sizes
    return [matches[h : h + max(s - length, 0)] for h, s in zip(heads.tolist(), sizes.tolist(), strict=True)]


def _intervals(flags: np.ndarray, length: int) -> list[int]:
    """[start, end, start, end, ...] of the bytes that marked windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    out: list[int] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if out and a <= out[-1]:
            out[-1] = b - 1 + length
        else:
            out += [a, b - 1 + length]
    return out


def _index(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions come in the order of anchor and digest."""
        waiting: list[tuple[int, int, bytes, bool]] = []
        held = 0

        def out(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["anchor", "digest", "cuts"])

        def flush() -> pa.RecordBatch:
            marks = mark_windows([w[2] for w in waiting], length)
            rows = [(a, d, [0, len(p)] if twice else _intervals(m, length)) for (a, d, p, twice), m in zip(waiting, marks, strict=True)]
            return out([r for r in rows if r[2]])

        group: dict[int, list] = {}
        current = None
        sole: list[tuple[int, int, list[int]]] = []

        def close_group():
            nonlocal held
            for digest, (data, times, size) in group.items():
                if data is None or (len(group) == 1 and times > 1):  # nothing else to match
                    if times > 1:
                        sole.append((current, digest, [0, size]))
                else:
                    waiting.append((current, digest, data, times > 1))
                    held += len(data)

        for batch in batches:
            data = batch.column("data")
            for i, (anchor, digest, windows) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "windows")), strict=True)):
                if anchor != current:
                    close_group()
                    group, current = {}, anchor
                    if held >= INDEX_BYTES:
                        yield flush()
                        waiting, held = [], 0
                entry = group.setdefault(digest, [None, 0, windows + length - 1])
                entry[1] += 1
                if entry[0] is None and data[i].is_valid:
                    entry[0] = data[i].as_py()
            if sole:
                yield out(sole)
                sole = []
        close_group()
        if sole:
            yield out(sole)
        if waiting:
            yield flush()

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_out(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = text_column(batch.column("text")), batch.column("cuts")
            removed, spans, hashes, sizes, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                data = texts[i].as_buffer().to_pybytes()
                pairs = np.array(cuts[i].values.to_numpy(zero_copy_only=False) if cuts[i].is_valid else [], np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                at, out, merged = 0, [], []
                for a, b in pairs.tolist():
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    out.append(data[at:a])
                    at = b
                out.append(data[at:])
                rest = b"".join(out)
                sizes.append(len(data))
                removed.append(len(data) - len(rest))
                spans.append(len(merged))
                hashes.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            arrays = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(hashes, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())] if with_text else arrays, [*names, "kept"] if with_text else names)

    return run


def _scan_for(text: DataFrame, length: int, gram: int) -> Scan:
    """Count anchors, set the frequent ones back, and collect the bounded tables that tasks need."""
    spark = text.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = Frequent(np.empty(0, np.uint64))
    for turn in range(SET_BACK + 1):
        counts = staged(map_batches(text, _count(length, gram, frequent), "anchor long, times long, low long, high long").groupBy("anchor").agg(F.sum("times").alias("times"), (F.min("low") < F.max("high")).alias("mixed")).where("times > 1"))
        total = counts.agg(F.sum("times")).first()[0] or 0
        # By their share of the repeated segments, no more than 16 * parts anchors can be this frequent.
        hot = counts.where("mixed").where(F.col("times") > max(200.0, total / (16 * parts))).select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(np.uint64)
        hot = hot[hot < np.uint64(1 << 62)]
        if not len(hot) or turn == SET_BACK:
            break
        frequent = Frequent(np.concatenate([frequent.anchors, hot]))
    return Scan(length, gram, frequent, _table(counts), _table(counts.where("mixed")))


def _table(counts: DataFrame) -> np.ndarray:
    """A bit for every anchor (and for others in the same place)."""
    words = map_batches(counts.select("anchor"), _slots, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: bytes, removed bytes, removed stretches and the hash of what is left.

    ``with_text`` adds the remaining bytes as ``kept``.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    text = keyed.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text")
    shipped = spark.sparkContext.broadcast(_scan_for(text.select("text"), length, gram))
    cut = staged(map_batches(text, _cut(shipped), PLACE))
    sent = cut.where("sent").select("anchor", "digest", "windows", "data")
    marks = staged(map_batches(sent.repartition("anchor").sortWithinPartitions("anchor", "digest"), _index(length), "anchor long, digest long, cuts array<int>"))
    places = cut.select("key", F.col("doc_id").alias("_id"), "start", "anchor", "digest").distinct()
    cuts = places.join(marks, ["anchor", "digest"]).select("key", "_id", F.transform("cuts", lambda c: c + F.col("start")).alias("cuts"))
    cuts = staged(cuts.groupBy("key", "_id").agg(F.flatten(F.collect_list("cuts")).alias("cuts")))
    # Rows of one number and one text share their cuts; the hash alone does not decide whose they are.
    return map_batches(keyed.join(cuts, (keyed["key"] == cuts["key"]) & keyed["doc_id"].eqNullSafe(cuts["_id"]), "left").select("doc_id", "text", "cuts"), _cut_out(with_text), RESULT + (", kept binary" if with_text else ""))


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
