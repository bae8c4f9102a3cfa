"""Best-fit packing of documents whose number of sequences is certified by lower bounds.

Documents are tokenised in place; only sizes and checksums travel. They are dealt over
groups of bounded size, and each group is packed by best-fit decreasing: the largest piece
first, each into the fullest sequence that has room. A lower bound follows from the
group's sizes alone, as the largest value over families of dual feasible functions. A
group that needs no more sequences than its bound is certified: no packing is better. The
others keep their full sequences, give up the pieces of their emptiest ones, exchange them
with other such groups and are packed anew, until every group is certified, one group
holds all that is left, or ``rounds`` are over.

A piece of the whole window is a sequence of its own. Longer documents are cut into whole
windows behind a first piece with the rest, so that at most one piece a document is short.

Defined results: null text counts as empty; an empty text is the single end id. Repeated
rows are packed as often as they occur; ties of size go in the order of the ids. Very long
texts are encoded whole. Other columns are ignored, whatever their names. An empty table
gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.shared import map_batches, staged
from lexspan.llm.textbytes import chunks, eights, equal_spans, span_hash, span_ids, word_spans

#: White space beyond ASCII, and the special token, in UTF-8; texts that hold one are encoded in one go.
ODD_SPACE = b"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", key long, sequence_id long, offset long, part long, bins long, bound long, free long"

_LETTER, _TAIL = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_TAIL[np.frombuffer(b".,;:!?", np.uint8)] = True


def split_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of stretches that the tokenizer treats apart, in order and without gaps.

    Its pattern lets a word take one space before it. Other white space before a word is
    split into all but its last character and the last; at the end of a text it stays whole.
    A single mark behind a final ASCII letter stands alone.
    """
    starts, ends, owner = word_spans(raw, offsets)
    texts = len(offsets) - 1
    first = np.searchsorted(owner, np.arange(texts), "left")
    # Where the white space before each word begins, and one stretch more for the end of each text.
    before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    heads = first[first < np.searchsorted(owner, np.arange(texts), "right")]
    before[heads] = offsets[owner[heads]]
    gap = starts - before
    takes = (gap > 0) & (raw[np.maximum(starts - 1, 0)] == 32) if len(starts) else np.zeros(0, bool)
    word = starts - takes
    last = np.where((gap > 0) & ~takes, starts - 1, word)  # before the single last character of other white space
    tail = offsets[:-1].copy()
    tail[owner] = ends  # of repeated places the last one counts
    mark = ends - ((ends - starts > 1) & _TAIL[raw[ends - 1]] & _LETTER[raw[np.maximum(ends - 2, 0)]]) if len(ends) else ends
    begin = np.stack([before, last, word, mark], 1).ravel()
    end = np.stack([last, word, mark, ends], 1).ravel()
    text = np.repeat(owner, 4)
    place = np.concatenate([np.arange(len(begin)), np.searchsorted(text, np.arange(texts), "right") - 0.5])
    begin, end, text = np.concatenate([begin, tail]), np.concatenate([end, offsets[1:]]), np.concatenate([text, np.arange(texts)])
    order = np.argsort(place, kind="stable")
    order = order[end[order] > begin[order]]
    return begin[order], end[order], text[order]


class ByteEncoder:
    """Token ids of texts, each distinct unit encoded once; units are equal when their bytes are."""

    def __init__(self, path: str, limit: int = 1_000_000):
        import json
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        if parts["normalizer"] is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError(f"{path} is no byte-level vocabulary without normaliser and prefix space")
        self.odd = re.compile(b"|".join([ODD_SPACE, *[re.escape(t["content"].encode()) for t in parts["added_tokens"]]]))
        self.limit = limit
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.first, self.count = (np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
        self.ids, self.bytes = np.empty(0, np.uint32), np.empty(0, np.uint8)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _encoded_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``; many units go into one text, a line end behind each, which is one id of its own there."""
        solid = np.array([not u.isspace() for u in units])
        kept = [u for u, s in zip(units, solid.tolist(), strict=True) if s]
        flat, _ = self._encoded(["\n".join([*kept[i : i + 256], ""]) for i in range(0, len(kept), 256)] or [""])
        ends = np.flatnonzero(flat == self.line)
        count = np.zeros(len(units), np.int64)
        count[solid] = np.diff(ends, prepend=-1) - 1
        ids, blank = np.delete(flat, ends), np.flatnonzero(~solid)
        if len(blank):
            more, count[blank] = self._encoded([units[i] for i in blank.tolist()])
            heads = np.cumsum(count) - count
            at = np.zeros(int(count.sum()), bool)
            at[np.arange(len(more)) + np.repeat(heads[blank] - np.cumsum(count[blank]) + count[blank], count[blank])] = True
            out = np.empty(len(at), np.uint32)
            out[at], out[~at] = more, ids
            ids = out
        return ids, count

    def _units(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of new and known units, where each unit's ids begin, how many there are)."""
        size, keys = ends - starts, span_hash(raw, starts, ends)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = (self.keys[place] == keys) & (self.size[place] == size) if len(self.keys) else np.zeros(len(keys), bool)
        at = np.flatnonzero(known)
        known[at] = equal_spans(eights(raw), starts[at], eights(self.bytes), self.at[place[at]], size[at])
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.flatnonzero(known)
        first[at], count[at] = self.first[place[at]], self.count[place[at]]
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            ids, many = self._encoded_units([data[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            first[new], count[new] = np.cumsum(many) - many + len(self.ids), many
            self.ids = np.concatenate([self.ids, ids])
            # Of units with one hash the first is kept, the others are encoded whenever they come.
            fresh = new[np.unique(keys[new], return_index=True)[1]]
            if len(self.keys):
                fresh = fresh[self.keys[np.minimum(np.searchsorted(self.keys, keys[fresh]), len(self.keys) - 1)] != keys[fresh]]
            heads = np.cumsum(size[fresh]) - size[fresh]
            inside = np.arange(int(size[fresh].sum())) - np.repeat(heads, size[fresh])
            heads = heads + len(self.bytes)
            self.bytes = np.concatenate([self.bytes, raw[np.repeat(starts[fresh], size[fresh]) + inside]])
            order = np.argsort(np.concatenate([self.keys, keys[fresh]]), kind="stable")
            for name, value in (("keys", keys[fresh]), ("at", heads), ("size", size[fresh]), ("first", first[fresh]), ("count", count[fresh])):
                setattr(self, name, np.concatenate([getattr(self, name), value])[order])
        return self.ids, first, count

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of every text of the chunk."""
        data, texts = raw.tobytes(), len(offsets) - 1
        odd = np.zeros(texts, bool)
        if m := [m.start() for m in self.odd.finditer(data)]:
            odd[np.searchsorted(offsets, np.array(m), "right") - 1] = True
        starts, ends, owner = split_units(raw, offsets)
        plain = ~odd[owner]
        starts, ends, owner = starts[plain], ends[plain], owner[plain]
        which, sample = span_ids(raw, starts, ends)
        if len(self.keys) + len(sample) > self.limit:
            self.clear()
        ids, first, count = self._units(raw, starts[sample], ends[sample])
        first, count = first[which], count[which]
        heads = np.cumsum(count) - count
        flat = ids[np.arange(int(count.sum())) + np.repeat(first - heads, count)]
        cuts = np.cumsum(np.bincount(owner, weights=count, minlength=texts).astype(np.int64))
        out = np.split(flat, cuts[:-1])
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._encoded([data[offsets[i] : offsets[i + 1]].decode()])[0]
        return out


_ENCODERS: dict[str, ByteEncoder] = {}


def _cut(path: str, end_id: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ByteEncoder(path)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for low, high, raw, offsets in chunks(batch.column("text")):
                rows = []
                for doc, ids in zip(docs[low:high], _ENCODERS[path].encode(raw, offsets), strict=True):
                    whole = np.append(ids, np.uint32(end_id)).astype("<u4")
                    edges = [0, *range((len(whole) - 1) % window + 1, len(whole) + 1, window)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        blob = whole[a:b].tobytes()
                        rows.append((doc, k, a, b - a, zlib.crc32(blob), blob))
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:-1], names if with_ids else names[:-1])

    return run


def lower_bound(sizes: np.ndarray, window: int) -> int:
    """The least number of sequences that pieces of these sizes can need, by dual feasible functions.

    A dual feasible function maps any set of sizes that fits into one window to values of at
    most 1 in sum, so the sum over all sizes bounds the number of windows. Three families,
    all in whole numbers: thresholds (large sizes count fully, small ones not at all),
    multiples rounded down, and both combined by rounding to units of a threshold.
    """
    if not len(sizes):
        return 0
    many = np.bincount(sizes, minlength=window + 1).astype(np.int64)
    size = np.arange(window + 1, dtype=np.int64)
    weight = np.cumsum(many * size)
    number = np.cumsum(many)
    best = -(-int(weight[-1]) // window)
    # Sizes above window - e count as a window, those from e on as they are, smaller ones as nothing.
    e = np.arange(1, window // 2 + 1)
    values = (number[-1] - number[window - e]) * window + weight[window - e] - weight[e - 1]
    best = max(best, int(-(-values.max() // window)))
    present = np.flatnonzero(many)
    count = many[present]
    for k in range(1, 101):
        scaled = (k + 1) * present
        value = np.where(scaled % window == 0, present * k, scaled // window * window)
        best = max(best, -(-int((count * value).sum()) // (window * k)))
    for unit in range(1, window // 2 + 1):
        full = window // unit
        value = np.where(2 * present > window, 2 * (full - (window - present) // unit), np.where(2 * present == window, full, 2 * (present // unit)))
        best = max(best, -(-int((count * value).sum()) // (2 * full)))
    return best


def best_fit_decreasing(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence of each piece, its offset there, free room of each sequence); ``sizes`` fall."""
    room: list[list[int]] = [[] for _ in range(window + 1)]  # sequences by free room
    some = 0  # bit r is set when room[r] has one
    bins, offsets, free = [], [], []
    for size in sizes.tolist():
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            one = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            left, one = window, len(free)
            free.append(window)
        bins.append(one)
        offsets.append(window - left)
        free[one] = left - size
        room[left - size].append(one)
        if left > size:
            some |= 1 << (left - size)
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(free, np.int64)


def _packed(window: int, turn: int):
    """Packs a group; sequence ids are unique over all turns and groups.

    Where the pieces already had sequences and packing anew takes no fewer, they keep them.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table.column("key").to_numpy(), -table.column("length").to_numpy()))))
        sizes, part = table.column("length").to_numpy(), table.column("part")[0].as_py()
        bins, offsets, free = best_fit_decreasing(sizes, window)
        ids, free = (turn << 56 | part << 26) + bins, free[bins]
        if turn:
            old, which = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
            if len(old) <= bins.max() + 1:
                ids, offsets = old[which], table.column("offset").to_numpy()
                free = (window - np.bincount(which, weights=sizes).astype(np.int64))[which]
        made = {"sequence_id": ids, "offset": offsets, "part": np.full(len(ids), part), "bins": np.full(len(ids), len(np.unique(ids))), "bound": np.full(len(ids), lower_bound(sizes, window)), "free": free}
        return pa.table({c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "key")} | {c: pa.array(v, pa.int64()) for c, v in made.items()})

    return run


def place(pieces: DataFrame, *, window: int, group_rows: int = 20_000, exchanged: int = 2_000, rounds: int = 16) -> DataFrame:
    """``pieces`` with sequence_id, offset, and the sequences and the lower bound of the group that packed them last.

    ``group_rows`` is the mean number of pieces in a group, ``exchanged`` about the most
    sequences that an open group gives up in a round, the emptiest first. A certified group
    only gives up what is at most half full, of which it has one. Each round at least halves
    the groups, as their pieces allow, so a group never holds more than a few times either.
    """
    groups = max(1, -(-pieces.count() // group_rows))
    spread = lambda *by: F.pmod(F.xxhash64(*by), F.lit(groups))
    rows, done = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "part": spread("key")}), []
    for turn in range(rounds):
        packed = staged(rows.groupBy("part").applyInArrow(_packed(window, turn), PLACED))
        unsure, ragged = F.col("bins") > F.col("bound"), 2 * F.col("free") >= window
        left = packed.where(unsure | ragged).select("part").distinct().count() if groups > 1 and turn + 1 < rounds else 0
        if left < 2:
            break
        ahead = F.sum("here").over(Window.partitionBy("part").orderBy(F.desc("free"))) - F.col("here")
        roomy = packed.where(unsure & (F.col("free") > 0) & (F.col("offset") == 0)).groupBy("part", "free").agg(F.count(F.lit(1)).alias("here"))
        least = roomy.withColumn("ahead", ahead).where(F.col("ahead") < exchanged).groupBy("part").agg(F.min("free").alias("least"))
        marked = staged(packed.join(least, "part", "left").withColumn("gives", F.coalesce(F.col("free") >= F.col("least"), F.lit(False)) | ragged).drop("least"))
        given = marked.where("gives")
        done.append(marked.where("NOT gives").drop("gives"))
        groups = min(-(-left // 2), -(-given.count() // group_rows))
        rows = given.withColumn("part", spread("part", F.lit(turn))).drop("gives", "bins", "bound", "free")
    return reduce(DataFrame.unionByName, done, packed)


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 0, with_ids: bool = False, **options) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, and what certifies its group.

    ``with_ids`` adds the piece's ids (little-endian unsigned 32-bit integers), from which
    sequences are put together by ``sequence_id`` and ``offset``. ``options`` go to ``place``.
    """
    cut = map_batches(docs.select("doc_id", "text"), _cut(tokenizer_path, end_id, window, with_ids), PIECE + (", ids binary" if with_ids else ""))
    pieces = staged(cut.withColumn("key", F.monotonically_increasing_id()))
    placed = place(pieces.drop("ids"), window=window, **options).drop("part", "free")
    return placed.join(pieces.select("key", "ids"), "key").drop("key") if with_ids else placed.drop("key")


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
