"""Near-duplicate join on word shingles with adaptive multi-match prefixes.

Two texts whose sets of five-word shingles have a Jaccard similarity of at least 0.75 are
linked; the result is each document's component.

1. *Profile.* One pass over the text gives each document the size and a key of its set, and
   adds every shingle of the corpus to a table of ``2**SKETCH_BITS`` counters: an estimate
   of how many documents hold a shingle. Documents with equal sets share a key and are one
   node from here on, so exact copies cost nothing. A second hash of the set stands beside
   the key; sets that differ in it are told apart.
2. *Prefixes.* Shingles are ordered from rare to frequent by that table. In that order two
   similar sets share at least ``l`` of their first ``n - ceil(0.75 n) + l`` shingles. Each
   document takes the ``l`` whose prefix has the least estimated cost (postings plus the
   candidates that they bring, of which only those with ``l`` matches are verified).
3. *Candidates.* Postings meet by shingle, in lists ordered by size. A list of at most
   ``FULL`` gives all its pairs; those that meet in short lists alone must share as many
   prefix shingles as the smaller of their two ``l``, or more where their sizes demand it.
   Where two nodes that meet in short lists share too few there, the long lists that both are
   in count too. The postings of longer lists carry their node's long lists, so there the
   shared ones are counted at once and the same condition holds for those that share enough
   of them; a prefix as a whole never travels twice. A list whose estimate is above ``HOT`` is
   divided by the node's key into parts of about that length, whichever tasks they fall to;
   the smallest document of every part stands for it in one list more.
4. *Verification.* First the outlines of candidates travel to blocks of pairs: how many
   members a set has in each of equal ranges of the hash. Two sets share at most the sum of
   the lesser counts, which rules most pairs out for good. The texts of the rest follow, once
   to a block, and their sets are compared there in full. Each block returns the links as a
   star.
5. *Contraction.* Long lists first pair each document with those ``BEST`` of the next
   ``NEAR`` that share most of its long lists and with the one that shares most with all. Links
   merge nodes into components. Then every long list that still holds more than one component pairs each
   node outside the largest one with the ``BEST`` of other components, which merges most of
   them; last, it gives all pairs between components that meet the condition, each in the
   first list that the two share; nodes outside the largest component of a divided list
   visit all its parts. Pairs inside a component need no check, so no link between
   components is lost and a large group of near copies never expands into all its pairs.

Defined results: null, empty or word-free text has an empty set and links to nothing. A
text with fewer than five words has one shingle, the whole sequence. Repeated rows and ties
are nodes with equal sets. Very long texts are read whole; a set takes eight bytes a word
where it is compared. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.graph import components
from lexspan.llm.shared import map_batches, staged
from lexspan.llm.textbytes import by_text_and_value, chunks, mix, span_hash, windows_hash, word_spans

WIDTH = 5
#: Similarity as a ratio of integers: 100 * intersection >= 75 * union.
PERCENT = 75
SKETCH_BITS = 19
BLOCK = 4096
#: A list of at most so many nodes gives all its pairs at once.
FULL = 33
#: Distances that a longer list gives first.
NEAR = 16
#: Of these, and of the members of other components, so many with the most shared are verified before all that are left.
BEST = 2
MOST_MATCHES = 4
#: Estimated postings from which a list is divided into parts of about that length.
HOT = 4096
#: Pairs that are verified together.
BLOCK_PAIRS = 2000
#: Bits of the fixed-size table that keeps the texts of most documents without a candidate out of a shuffle.
FILTER_BITS = 23
#: Members of a set for each range of its outline, at most; there are more than half as many.
PER_RANGE = 4


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes text by text, their count per text)."""
    for low, high, raw, offsets in chunks(column):
        starts, ends, owner = word_spans(raw, offsets)
        words = span_hash(raw, starts, ends, lower=True)
        value, at = windows_hash(words, owner, width)
        text = owner[at]
        counts = np.bincount(owner, minlength=high - low)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            begin = np.concatenate([[0], np.cumsum(counts)])
            whole = np.zeros(len(short), np.uint64)
            for j in range(width - 1):
                has = counts[short] > j
                whole[has] = whole[has] * np.uint64(0x9E3779B97F4A7C15) + words[begin[short[has]] + j]
            place = np.searchsorted(text, short)
            value = np.insert(value, place, mix(whole + counts[short].astype(np.uint64)))
            text = np.insert(text, place, short)
        value = value[by_text_and_value(text, value)]
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        yield low, high, value[first], np.bincount(text[first], minlength=high - low)


def set_keys(value: np.ndarray, sizes: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(key, check) of each set: two independent hashes; the key is 0 only for an empty set."""
    edges = np.concatenate([[0], np.cumsum(sizes)])

    def total(salt: int) -> np.ndarray:
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)])
        return mix(running[edges[1:]] - running[edges[:-1]] + sizes.astype(np.uint64))

    keys = np.maximum(total(0x517CC1B727220A95) >> np.uint64(64 - bits), np.uint64(1))
    return np.where(sizes > 0, keys, np.uint64(0)).view(np.int64), total(0x2545F4914F6CDD1D).view(np.int64)


class Names:
    """Names sets by their key, and by key and check where different sets have one key.

    Such keys are counted in the profile; of N documents about N**2 / 2**65 have one.
    """

    def __init__(self, shared: np.ndarray, bits: int):
        self.shared, self.bits = shared, bits

    def __call__(self, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        keys, checks = set_keys(value, sizes, self.bits)
        return np.where(np.isin(keys, self.shared), keys ^ checks, keys) if len(self.shared) else keys


def _profile(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "node", "check", "n", "block", "counts"]
        for batch in batches:
            for low, high, value, sizes in shingle_sets(batch.column("text"), width):
                table += np.bincount(value >> np.uint64(64 - SKETCH_BITS), minlength=len(table))
                none = pa.nulls(high - low, pa.int32()), pa.nulls(high - low, pa.list_(pa.int64()))
                keys, checks = set_keys(value, sizes, bits)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array(keys), pa.array(checks), pa.array(sizes, pa.int64()), *none], names)
        used = [i for i in range(0, len(table), BLOCK) if table[i : i + BLOCK].any()]
        if used:
            none = [pa.nulls(len(used), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array([i // BLOCK for i in used], pa.int32()), pa.array([table[i : i + BLOCK] for i in used], pa.list_(pa.int64()))], names)

    return run


def _add_blocks(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK, np.int64)
    for batch in tables:
        total += batch.column("counts").flatten().to_numpy().reshape(-1, BLOCK).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.int64()))], ["block", "counts"])


def needed(sizes: np.ndarray) -> np.ndarray:
    """The least number of shingles a set of this size shares with a similar one."""
    return -(-PERCENT * sizes // 100)


def choose_matches(met: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Matches to ask of each set, given running sums of the estimated lists in prefix order.

    A prefix costs its postings, and a verification (about the size of the set) for each
    candidate; candidates are at most the postings met, divided by the matches asked for.
    """
    need = needed(sizes)
    costs = []
    for asked in range(1, MOST_MATCHES + 1):
        ends = np.minimum(sizes - need + asked, sizes)
        lists = met[heads + ends] - met[heads]
        costs.append(np.where(asked <= need, ends * 4.0 + lists + lists / asked * (sizes / 16.0), np.inf))
    return np.argmin(np.stack(costs), axis=0) + 1


def prefixes(value: np.ndarray, sizes: np.ndarray, estimate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each prefix member in ``value``, its set, matches asked of each set)."""
    heads = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    # Rare first, to the sixteen upper bits of the estimate, then by hash: an order of all shingles.
    order = np.argsort((estimate.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16), kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    met = np.concatenate([[0.0], np.cumsum(estimate[order], dtype=np.float64)])
    asked = choose_matches(met, heads, sizes)
    ends = np.where(sizes > 0, np.minimum(sizes - needed(sizes) + asked, sizes), 0)
    which = np.repeat(np.arange(len(sizes)), ends)
    return order[np.arange(len(which)) - np.repeat(np.cumsum(ends) - ends, ends) + heads[which]], which, asked


POSTING = "shingle long, part int, parts int, node long, n int, asked byte, rest int"


def _postings(width: int, shipped):
    """The prefix of each set, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, name, hot = shipped.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, value, sizes in shingle_sets(batch.column("text"), width):
                node = name(value, sizes)
                new = _unseen(node, seen)
                if not len(new):
                    continue
                value, sizes, node = value[_members(sizes, new)], sizes[new], node[new]
                estimate = table[value >> np.uint64(64 - SKETCH_BITS)]
                at, which, asked = prefixes(value, sizes, estimate)
                length = np.bincount(which, minlength=len(sizes))
                parts = np.where(estimate[at] > hot, np.ceil(estimate[at] / hot), 1).astype(np.int64)
                unit = (mix(node.view(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                arrays = [
                    pa.array(value[at].view(np.int64)),
                    pa.array((unit[which] * parts).astype(np.int32)),
                    pa.array(parts.astype(np.int32)),
                    pa.array(node[which]),
                    pa.array(sizes[which].astype(np.int32)),
                    pa.array(asked[which].astype(np.int8)),
                    pa.array((sizes - length)[which].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["shingle", "part", "parts", "node", "n", "asked", "rest"])

    return run


def _unseen(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """The first rows of the nodes that this task has not met yet."""
    _, first = np.unique(node, return_index=True)
    new = [i for i, k in zip(first.tolist(), node[first].tolist(), strict=True) if k and k not in seen]
    seen.update(node[new].tolist())
    return np.array(sorted(new), np.int64)


def _members(sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the members of the chosen sets."""
    heads, size = (np.cumsum(sizes) - sizes)[chosen], sizes[chosen]
    return np.arange(int(size.sum())) + np.repeat(heads - (np.cumsum(size) - size), size)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _whole_lists(batches: Iterator[pa.RecordBatch], limit: int = 200_000) -> Iterator[pa.Table]:
    """Runs of whole lists from a partition in the order of shingle and part."""
    held: list[pa.RecordBatch] = []
    waiting, most = 0, limit
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            waiting += batch.num_rows
        if waiting >= most:
            table = pa.Table.from_batches(held)
            cut = int(_heads(table.column("shingle").to_numpy(), table.column("part").to_numpy())[-1])  # the last list may go on
            if cut:
                yield table.slice(0, cut)
            held, waiting = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
            most = max(limit, 2 * waiting)
    if waiting:
        yield pa.Table.from_batches(held)


def _keep_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of shingles that two or more nodes hold, each once, with the list's length.

    Parts of a divided list stay, and the first node of each goes to the list of part -1.
    """
    for table in _whole_lists(batches):
        key, part, node = (table.column(c).to_numpy() for c in ("shingle", "part", "node"))
        at = _heads(key, part, node)
        starts = _heads(key[at], part[at])
        counts = np.diff(np.append(starts, len(at)))
        divided = table.column("parts").to_numpy()[at] > 1
        size = np.repeat(counts, counts)
        kept = np.flatnonzero((size > 1) | divided)
        if len(kept):
            yield _with_length(table, at[kept], size[kept])
        stands = starts[divided[starts]]
        if len(stands):
            yield _with_length(table, at[stands], np.ones(len(stands), np.int64), -1)


def _with_length(table: pa.Table, at: np.ndarray, size: np.ndarray, part: int | None = None) -> pa.RecordBatch:
    out = table.take(pa.array(at)).combine_chunks().to_batches()[0]
    columns = {n: out.column(n) for n in out.schema.names}
    if part is not None:
        columns["part"] = pa.array(np.full(len(at), part, np.int32))
    return pa.RecordBatch.from_pydict(columns | {"in_list": pa.array(size, pa.int64())})


def _short_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each list, with the number of shared prefix shingles that they need."""
    for table in _whole_lists(batches):
        key, part, node, n, asked, rest = (table.column(c).to_numpy() for c in ("shingle", "part", "node", "n", "asked", "rest"))
        starts = _heads(key, part)
        counts = np.diff(np.append(starts, len(key)))
        last, here = np.repeat(starts + counts, counts), np.arange(len(key))
        for step in range(1, int(counts.max())):
            a = here[here + step < last]
            least, fits = _least(n, asked, rest, a, a + step)
            a, b = node[a[fits]], node[a[fits] + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(least[fits].astype(np.int32))], ["a", "b", "asked"])


def _least(n, asked, rest, a, b) -> tuple[np.ndarray, np.ndarray]:
    """(prefix shingles that the pairs of rows must share, whether their sizes allow a link).

    The smaller of the two numbers of matches, or more where the sizes demand it: what two
    sets share lies in both prefixes or in the rest behind one of the prefixes, and the
    whole must reach 3/7 of the sum of sizes.
    """
    x, y = n[a].astype(np.int64), n[b].astype(np.int64)
    overlap = -(-PERCENT * (x + y) // (100 + PERCENT))
    return np.maximum(np.minimum(asked[a], asked[b]), overlap - np.maximum(rest[a], rest[b])), 100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)


class _LongLists:
    """The long lists that the rows of a run of lists are in, as rows of 0 and 1 over those that two rows share."""

    def __init__(self, table: pa.Table):
        column = table.column("longs").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        self.edges, self.values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()

    def dense(self, rows: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        """(matrix over all lists, matrix over those before ``below``)."""
        size = self.edges[rows + 1] - self.edges[rows]
        value = self.values[np.arange(int(size.sum())) + np.repeat(self.edges[rows] - (np.cumsum(size) - size), size)]
        row = np.repeat(np.arange(len(rows)), size)
        names, which, times = np.unique(value, return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1
        kept = times[which] > 1
        whole = np.zeros((len(rows), int((times > 1).sum())), np.float32)
        whole[row[kept], place[which[kept]]] = 1
        return whole, whole[:, names[times > 1] < below]


def _central(whole: np.ndarray) -> np.ndarray:
    """How many of their long lists rows share with all others, from 0 to below 1; of near copies those with few changes share most."""
    total = whole @ whole.sum(axis=0)
    return total / (total.max(initial=0) + 1)


def _first_of_each(x: np.ndarray, y: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` of their ``x`` with the highest ``value``, the earlier ``y`` first."""
    order = np.lexsort((y, -value, x))
    heads = _heads(x[order]) if len(order) else order
    return order[np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order)))) < most]


def _long_pairs(near: int, best: int | None = None):
    """Pairs of long lists that share enough of these.

    ``near`` above 0: those at so many distances and with the most central node. 0: all pairs
    of different components, each in the first list that both are in. ``best``: of these
    the ones that share most, so many for each node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches, 20_000):
            key, part, node, n, asked, rest = (table.column(c).to_numpy() for c in ("shingle", "part", "node", "n", "asked", "rest"))
            lists = _LongLists(table)
            starts = _heads(key, part)
            ends = np.append(starts[1:], len(key))
            found = []
            if not near:
                group, outer, guest = (table.column(c).to_numpy(zero_copy_only=False) for c in ("group", "outer", "guest"))
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if near:
                    whole, _ = lists.dense(np.arange(s, e), 0)
                    central = _central(whole)
                    hub = int(np.argmax(central))
                    x = np.concatenate([*[np.arange(step, e - s) for step in range(1, near + 1)], np.delete(np.arange(e - s), hub)])
                    y = np.concatenate([*[np.arange(max(e - s - step, 0)) for step in range(1, near + 1)], np.full(e - s - 1, hub)])
                    least, fits = _least(n, asked, rest, s + x, s + y)
                    shared = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", whole[x[at : at + 4096]], whole[y[at : at + 4096]]) for at in range(0, len(x), 4096)]])
                    good = np.flatnonzero(fits & (shared >= least))
                    x, y, value = x[good], y[good], (shared + central[y])[good]
                    chosen = np.union1d(_first_of_each(x, y, value, best or near), np.flatnonzero(y == hub))
                    found.append((s + x[chosen], s + y[chosen]))
                    continue
                own, outside = s + np.flatnonzero(~guest[s:e]), s + np.flatnonzero(outer[s:e])
                for i in range(0, len(outside), 512):
                    top = []
                    for j in range(0, len(own), 2048):
                        x, y = outside[i : i + 512], own[j : j + 2048]
                        whole, early = lists.dense(np.concatenate([x, y]), int(key[s]))
                        least, fits = _least(n, asked, rest, x[:, None], y[None, :])
                        fits &= (group[x][:, None] != group[y]) & (guest[x][:, None] | ~outer[y] | (x[:, None] < y))
                        shared = whole[: len(x)] @ whole[len(x) :].T
                        fits &= (shared >= least) & (early[: len(x)] @ early[len(x) :].T == 0)
                        at = np.nonzero(fits)
                        top.append((x[at[0]], y[at[1]], shared[at] + _central(whole[len(x) :])[at[1]]))
                        if best:
                            top = [tuple(np.concatenate([t[k] for t in top]) for k in range(3))]
                            chosen = _first_of_each(*top[0], best)
                            top = [tuple(t[chosen] for t in top[0])]
                    found += [t[:2] for t in top]
            if found:
                a, b = (node[np.concatenate([f[k] for f in found])] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _chosen(width: int, shipped, give):
    """What ``give`` makes of the nodes that the filter lets through, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, name = shipped.value
        seen: set[int] = set()
        for batch in batches:
            for low, _, value, sizes in shingle_sets(batch.column("text"), width):
                node = name(value, sizes)
                new = _unseen(node, seen)
                slot = mix(node[new].view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
                new = new[bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0]
                if len(new):
                    columns = give(batch.column("text"), new + low, value[_members(sizes, new)], sizes[new])
                    yield pa.RecordBatch.from_pydict({"node": pa.array(node[new])} | columns)

    return run


def _give_text(text: pa.Array, rows: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
    return {"text": text.take(pa.array(rows)).cast(pa.string())}


def _give_outline(text: pa.Array, rows: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
    return {"n": pa.array(sizes, pa.int64()), "outline": outlines(value, sizes)}


def outlines(value: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Of each set its counts in 2**k equal ranges of the hash, one byte each; 255 stands for that or more."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(sizes, 1) / PER_RANGE)), 1).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(1 << bits)])
    place = (value >> np.repeat(64 - bits, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(edges[:-1], sizes)
    counts = np.minimum(np.bincount(place, minlength=int(edges[-1])), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(counts)])


def may_link(x: np.ndarray, y: np.ndarray, sizes: int) -> bool:
    """Whether sets with these outlines, of so many members together, may be similar."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1)
    return (100 + PERCENT) * int(np.minimum(x, y).sum()) >= PERCENT * sizes


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that outlines do not rule out. Rows come by block, a block's outlines before its pairs."""
    current, held = None, {}
    for batch in batches:
        block, a, b, n, outline = (batch.column(c).to_pylist() for c in ("block", "a", "b", "n", "outline"))
        kept = []
        for i in range(batch.num_rows):
            if block[i] != current:
                current, held = block[i], {}
            if b[i] is None:
                counts = np.frombuffer(outline[i], np.uint8).astype(np.int64)
                held[a[i]] = np.where(counts == 255, n[i], counts), n[i]
                continue
            (x, size_x), (y, size_y) = held[a[i]], held[b[i]]
            if may_link(x, y, size_x + size_y):
                kept.append(i)
        if kept:
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("block", "a", "b")], ["block", "a", "b"])


def _verify(width: int):
    """Links of each block as a star around one of its nodes. Rows come by block, a block's texts before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets, root = None, {}, {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def stars() -> pa.RecordBatch:
            links = [(find(x), x) for x in root if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            block, a, b = (batch.column(c).to_pylist() for c in ("block", "a", "b"))
            found = {}
            with_text = np.flatnonzero(batch.column("text").is_valid().to_numpy(zero_copy_only=False))
            for low, high, value, sizes in shingle_sets(batch.column("text").take(pa.array(with_text)), width):
                edges = np.concatenate([[0], np.cumsum(sizes)])
                found |= {int(with_text[low + i]): value[edges[i] : edges[i + 1]].copy() for i in range(high - low)}
            for i in range(batch.num_rows):
                if block[i] != current:
                    if root:
                        yield stars()
                    current, sets, root = block[i], {}, {}
                if b[i] is None:
                    sets[a[i]] = found[i]
                    continue
                x, y = find(a[i]), find(b[i])
                if x == y:
                    continue
                both = np.concatenate([sets[a[i]], sets[b[i]]])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= PERCENT * (len(both) - shared):
                    root[max(x, y)] = min(x, y)
        if root:
            yield stars()

    return run


def _of_nodes(text: DataFrame, nodes: DataFrame, width: int, name: Names, give, schema: str) -> DataFrame:
    """Texts or outlines of ``nodes`` and of a few others that share their place in the fixed-size filter."""
    slots = nodes.mapInArrow(_slots, "word int, bit long")
    words = slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # 2**(FILTER_BITS - 6) rows at most
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shipped = text.sparkSession.sparkContext.broadcast((table, name))  # 1 MB, whatever the input
    return staged(map_batches(text, _chosen(width, shipped, give), f"node long, {schema}"))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _in_blocks(blocks: DataFrame, held: DataFrame) -> DataFrame:
    """Each block's pairs behind what ``held`` has of their nodes, once each."""
    wanted = blocks.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    columns = [c for c in held.columns if c != "node"]
    first = wanted.join(held.hint("merge"), "node").select("block", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), *columns)
    pairs = blocks.select("block", F.lit(1).alias("kind"), "a", "b")
    return first.unionByName(pairs, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")


def _links(text: DataFrame, outline: DataFrame, pairs: DataFrame, width: int, name: Names) -> DataFrame:
    """Links that join whatever the similar ones of ``pairs`` join.

    Pairs go to blocks by the smallest neighbour of one of them, so most groups of mutual
    candidates meet in one block and each text travels there once; a neighbour with many
    pairs has several blocks of about BLOCK_PAIRS pairs.
    """
    both = pairs.union(pairs.select("b", "a"))
    leaders = both.groupBy("a").agg(F.min("b").alias("leader")).select("a", F.least("a", "leader").alias("leader"))
    led = pairs.join(leaders, "a")
    parts = led.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PAIRS).alias("parts")).where("parts > 1")
    # Nodes that are neighbours in a list have close keys, so ranges of keys part a large group with few crossings.
    salt = F.when(F.col("parts").isNotNull(), F.floor((F.col("a") / 2.0**64 + 0.5) * F.col("parts"))).otherwise(F.lit(0))
    blocks = staged(led.join(parts, "leader", "left").select(F.xxhash64("leader", salt).alias("block"), "a", "b"))
    possible = staged(map_batches(_in_blocks(blocks, outline), _possible, "block long, a long, b long"))
    texts = _of_nodes(text, _nodes(possible), width, name, _give_text, "text string")
    return staged(map_batches(_in_blocks(possible, texts), _verify(width), "a long, b long"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = mix(batch.column("node").to_numpy().view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
        yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], ["word", "bit"])


def _by_list(postings: DataFrame) -> DataFrame:
    return postings.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "n", "node")


def _grouped(live: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings of the lists with more than one component.

    ``outer``: not in the largest component of its list; ``guest``: such a node that visits
    another part of its divided list.
    """
    named = live.join(roots.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    sizes = named.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("held"))
    lists = sizes.groupBy("shingle").agg(F.count(F.lit(1)).alias("groups"), F.max_by("group", F.struct("held", "group")).alias("largest")).where("groups > 1")
    rows = named.join(lists, "shingle").withColumn("outer", F.col("group") != F.col("largest")).drop("largest", "groups")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part"))
    guests = rows.where("outer AND parts > 1").withColumn("part", F.explode(others)).withColumn("guest", F.lit(True))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests)


def ngram_components(docs: DataFrame, *, width: int = WIDTH, hot: int | None = None, key_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) per document.

    ``hot``: estimated postings from which a list is divided; ``key_bits``: bits of a set's key.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", "text")
    profile = staged(map_batches(text, _profile(width, key_bits), "doc_id long, node long, check long, n long, block int, counts array<long>"))
    members = profile.where("block IS NULL").select("doc_id", "node", "check", "n")
    blocks = profile.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(_add_blocks, "block int, counts array<long>")
    # 2**SKETCH_BITS numbers, whatever the input.
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in blocks.collect():
        sketch[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = row["counts"]
    noise = sketch.mean()
    sketch = np.maximum(sketch - noise - 3 * noise**0.5, 1).astype(np.float32)
    shared = members.where("n > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node").toPandas()
    name = Names(shared["node"].to_numpy(np.int64), key_bits)
    members = members.join(F.broadcast(spark.createDataFrame(shared, "node long").withColumn("twice", F.lit(True))), "node", "left") if len(shared) else members.withColumn("twice", F.lit(None).cast("boolean"))
    members = members.select("doc_id", F.when(F.col("twice"), F.col("node").bitwiseXOR(F.col("check"))).otherwise(F.col("node")).alias("node"), "n")

    postings = map_batches(text, _postings(width, spark.sparkContext.broadcast((sketch, name, hot or HOT))), POSTING)
    live = staged(map_batches(_by_list(postings), _keep_lists, POSTING + ", in_list long"))
    is_long = (F.col("in_list") > FULL) | (F.col("parts") > 1)
    short, long = live.where(~is_long), live.where(is_long).drop("in_list")
    longs = staged(long.where("part >= 0").groupBy("node").agg(F.collect_list("shingle").alias("longs")))

    met = map_batches(_by_list(short.drop("in_list", "parts")), _short_pairs, "a long, b long, asked int")
    met = staged(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("asked").alias("asked")))
    both = met.where("shared < asked")
    for c in ("a", "b"):
        both = both.join(longs.select(F.col("node").alias(c), F.col("longs").alias(f"longs_{c}")), c)
    both = both.where(F.col("shared") + F.size(F.array_intersect("longs_a", "longs_b")) >= F.col("asked"))
    together = met.where("shared >= asked").select("a", "b").union(both.select("a", "b"))
    near = map_batches(_by_list(long.join(longs, "node")), _long_pairs(NEAR, BEST), "a long, b long")
    pairs = staged(together.union(near).distinct())
    outline = _of_nodes(text, _nodes(pairs).union(long.select("node")), width, name, _give_outline, "n long, outline binary")
    links = _links(text, outline, pairs, width, name)
    roots = components(links)
    for best in (BEST, None):
        rest = _by_list(_grouped(long.where("part >= 0"), roots).join(longs, "node"))
        more = staged(map_batches(rest, _long_pairs(0, best), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links, pairs = links.union(_links(text, outline, more, width, name)), pairs.union(more)
            roots = components(links)

    labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("_smallest"))
    return labelled.join(smallest, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_smallest", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their component; those linked with nothing all stay."""
    keep = ngram_components(docs).where("doc_id = component_id OR n_shingles = 0 OR doc_id IS NULL").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
