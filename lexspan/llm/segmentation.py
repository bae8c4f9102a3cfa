"""Sampling distinct segmentations of texts with a SentencePiece vocabulary, and decoding.

A text is cut before each space mark; pieces never reach over such a cut, so its lattice
is the chain of its units' lattices, and each distinct unit is worked out once a chunk.
Backward sums over a lattice make every step of a path an exact draw.

*Gumbel top-k.* The perturbed log-probability of the best segmentation is a Gumbel
variable of the whole. Along its path every step leaves a set of untried siblings behind;
the sets part all other segmentations, and the best perturbed value inside a set is a
Gumbel variable at the set's mass, truncated by the value of the path that left it. The
sets wait in a heap by that value (their exact bound, as in A* search); the top one is
opened by drawing its segmentation, which leaves new sets in turn. So segmentations come
without replacement in the order of their perturbed values. The inclusion score is the
chance to be among the first k, given the value of the next one. All draws are functions
of the seed, the row's key and the place, whatever the partitioning.

Every set takes part; of those that a path leaves behind, the k + 1 of the highest bounds
are entered into the heap, as no other can be among the next k.

Defined results: null text is empty; an empty text has one segmentation, without pieces.
A text with fewer than k segmentations gives all of them. Characters outside the
vocabulary fall back to bytes. Repeated rows give repeated results, and equal texts under
different keys different draws. Very long texts are segmented whole, a chunk of their own
each. An empty table gives an empty table. Extra columns are ignored. A null key draws as
key 0. ``round_trip`` is false for a text that holds the space mark itself, which decodes
to a space; that a piece's bytes are the text's is compared for every edge of a lattice.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.shared import map_batches
from lexspan.llm.textbytes import chunks, eights, equal_spans, mix, prefix_hash, span_ids, text_column

MARK = "▁"
SAMPLES = 3
FALLBACK = 1 << 24  # pieces from here on stand for a character written as bytes
#: Bits of the hash by which a piece is looked up first.
LOOK_BITS = 20
#: Bytes of text that are worked on at once: few enough that a chunk's lattice stays in a core's cache.
CHUNK_BYTES = 1 << 19


class Vocabulary:
    """Pieces by the hash of their bytes, all their prefixes, and a log-probability each.

    The scores of a merge-ranked vocabulary are ranks, not probabilities; they are taken
    as a Zipf law, ``-ln(rank + 10)``, normalised. Unigram scores are used as they are.
    """

    def __init__(self, path: str, alpha: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.surface: list[bytes] = [b""] * size
        self.byte_ids = np.zeros(256, np.int64)
        score = np.array([sp.get_score(i) for i in range(size)])
        ordinary = []
        for i in range(size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.surface[i] = sp.id_to_piece(i).encode()
                ordinary.append(i)
        ordinary = np.array(ordinary)
        if (score[ordinary] == np.round(score[ordinary])).all():
            weight = -np.log(-score[ordinary] + 10.0)
            score[ordinary] = weight - np.log(np.exp(weight).sum())
        self.score = score * alpha
        self.fallback = float(self.score[ordinary].min()) - 10.0 * alpha
        prefixes: dict[bytes, int] = {}
        for i in ordinary.tolist():
            piece = self.surface[i]
            for n in range(1, len(piece)):
                prefixes.setdefault(piece[:n], -1)
            prefixes[piece] = i
        keys = list(prefixes)
        raw = np.frombuffer(b"".join(keys), np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        starts = np.concatenate([[0], ends[:-1]])
        total, down = prefix_hash(raw)
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.piece = hashes[order], np.array(list(prefixes.values()))[order]
        self.longest = int((ends - starts).max())
        self.view, self.at = eights(raw), starts[order]
        bucket = (self.hashes >> np.uint64(64 - LOOK_BITS)).astype(np.int64)
        self.bucket = np.searchsorted(bucket, np.arange(1 << LOOK_BITS)).astype(np.int32)
        self.fullest = int(np.bincount(bucket).max())

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each hash stands, whether it stands there)."""
        place = self.bucket[(value >> np.uint64(64 - LOOK_BITS)).astype(np.int64)]
        last = np.int32(len(self.hashes) - 1)
        live = np.arange(len(value))
        for _ in range(self.fullest):
            live = live[self.hashes[np.minimum(place[live], last)] < value[live]]
            if not len(live):
                break
            place[live] += 1
        place = np.minimum(place, last)
        return place, self.hashes[place] == value


class Lattice:
    """The lattices of distinct units as one graph with exact step probabilities."""

    def __init__(self, vocab: Vocabulary, raw: np.ndarray, offsets: np.ndarray):
        units = len(offsets) - 1
        head = np.flatnonzero((raw & 0xC0) != 0x80)
        unit = np.searchsorted(offsets, head, "right") - 1
        chars = np.bincount(unit, minlength=units)
        self.base = np.concatenate([[0], np.cumsum(chars + 1)])[:-1]
        nodes = int(chars.sum()) + units
        node_at = np.zeros(len(raw) + 1, np.int64)
        node_at[head] = np.arange(len(head)) + unit
        last = self.base + chars  # a unit's end
        level = np.repeat(last, chars + 1) - np.arange(nodes)
        total, down = prefix_hash(raw)
        end = offsets[1:][unit]
        source, target, piece, score, turn = [], [], [], [], []
        out_of = np.zeros(nodes, np.int64)
        view = eights(raw)
        live = np.arange(len(head))
        single = np.zeros(len(head), bool)
        after = np.append(head[1:], len(raw))
        for size in range(1, vocab.longest + 1):
            live = live[head[live] + size <= end[live]]
            if not len(live):
                break
            at = head[live]
            value = mix((total[at + size] - total[at]) * down[at] + np.uint64(size))
            place, known = vocab.find(value)
            live, place, at = live[known], place[known], at[known]
            is_piece = np.flatnonzero(vocab.piece[place] >= 0)
            src, place, stop = live[is_piece], place[is_piece], at[is_piece] + size
            true = equal_spans(view, head[src], vocab.view, vocab.at[place], np.full(len(src), size))
            if not true.all():  # another string with the hash of a piece
                src, place, stop = src[true], place[true], stop[true]
            node, p = node_at[head[src]], vocab.piece[place]
            source.append(node)
            target.append(np.where(stop == end[src], last[unit[src]], node_at[stop]))
            piece.append(p)
            score.append(vocab.score[p])
            turn.append(out_of[node])
            out_of[node] += 1
            single[src[after[src] == stop]] = True
        bare = np.flatnonzero(~single)
        node = node_at[head[bare]]
        source.append(node)
        target.append(node + 1)
        piece.append(FALLBACK + head[bare])
        score.append(vocab.fallback * (after[bare] - head[bare]))
        turn.append(out_of[node])
        out_of[node] += 1
        source, target, piece, score, turn = (np.concatenate(x) for x in (source, target, piece, score, turn))
        ranked = np.argsort(level.astype(np.uint16) if int(chars.max(initial=0)) < 1 << 16 else level, kind="stable")
        self.rank = np.empty(nodes, np.int64)
        self.rank[ranked] = np.arange(nodes)
        # Edges by the rank of the node they leave, and there in the order in which they were found.
        ahead = np.empty(nodes, np.int64)
        ahead[ranked] = np.cumsum(out_of[ranked]) - out_of[ranked]
        order = ahead[source] + turn
        self.target, self.piece = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sorted_source, sorted_score = np.empty(len(order), np.int64), np.empty(len(order))
        self.target[order], self.piece[order], sorted_source[order], sorted_score[order] = target, piece, source, score
        source, score = sorted_source, sorted_score
        self.size = out_of
        first_of_source = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else np.empty(0, np.int64)
        self.first = np.zeros(nodes, np.int64)
        self.first[source[first_of_source]] = first_of_source
        back = np.zeros(nodes)
        levels = level[source]
        cuts = np.flatnonzero(np.concatenate([[True], levels[1:] != levels[:-1], [True]])) if len(source) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            value = score[a:b] + back[self.target[a:b]]
            heads = np.flatnonzero(np.concatenate([[True], source[a + 1 : b] != source[a : b - 1]]))
            most = np.maximum.reduceat(value, heads)
            width = np.diff(np.append(heads, b - a))
            back[source[a:b][heads]] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, width)), heads))
        self.log_p = score + back[self.target] - back[source]
        p = np.exp(self.log_p)
        each = np.diff(np.append(first_of_source, len(p)))
        running = np.cumsum(p)
        begin = np.repeat(running[first_of_source] - p[first_of_source], each) if len(p) else p
        share = (running - begin) / np.maximum(np.repeat(np.add.reduceat(p, first_of_source), each), 1e-300) if len(p) else p
        # What the siblings of an edge have: a likely edge's siblings are summed, not taken from 1.
        small = np.where(p > 0.5, 0.0, p)
        others = np.repeat(np.add.reduceat(small, first_of_source), each) if len(p) else p
        self.log_rest = np.log(np.maximum(np.where(p > 0.5, others, 1 - p), 1e-300))
        closing = np.append(first_of_source[1:], len(p)) - 1 if len(p) else []
        share[closing] = 1.0
        self.key = self.rank[source] + share
        self.last_node = np.zeros(nodes, bool)
        self.last_node[last] = True
        # Ids of each edge: one, or one for each byte of a character outside the vocabulary.
        self.width = np.ones(len(self.piece), np.int64)
        odd = np.flatnonzero(self.piece >= FALLBACK)
        self.width[odd] = (after - head)[np.searchsorted(head, self.piece[odd] - FALLBACK)]
        self.plain = not len(odd)

    def draw(self, node: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """An edge out of each node."""
        edge, size = self.first[node], self.size[node]
        value = self.rank[node] + np.minimum(uniform, 1 - 1e-9)
        live = np.flatnonzero(size > 1)
        for step in range(1, int(size.max(initial=1))):
            live = live[(size[live] > step) & (self.key[edge[live]] <= value[live])]
            if not len(live):
                break
            edge[live] += 1
        return edge


def _scramble(key: np.ndarray, *parts) -> np.ndarray:
    for p in parts:
        key = mix(key + np.asarray(p).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return key


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    key = _scramble(key, *parts)
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(uniform):
    return -np.log(-np.log(uniform))


_ALL = (1 << 64) - 1


def _one_uniform(key: int, *parts: int) -> float:
    """``_uniform`` of single numbers."""
    for p in parts:
        key = (key + p * 0x9E3779B97F4A7C15 + 1) & _ALL
        key = ((key ^ (key >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
        key = ((key ^ (key >> 27)) * 0x94D049BB133111EB) & _ALL
        key ^= key >> 31
    return ((key >> 11) + 0.5) * 2.0**-53


class Sampler:
    """Top-k segmentations of the texts of one chunk."""

    def __init__(self, vocab: Vocabulary, raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int):
        self.k = k
        self.texts = len(offsets) - 1
        self.keys = mix(keys.astype(np.int64).view(np.uint64))
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 2:
            cut[:-3] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut[:-1]) if len(raw) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        self.text = np.searchsorted(offsets, starts, "right") - 1
        self.count = np.bincount(self.text, minlength=self.texts)
        self.edge_of = np.concatenate([[0], np.cumsum(self.count)])
        self.unit, sample = span_ids(raw, starts, ends)
        size = ends[sample] - starts[sample]
        heads = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.units = raw[np.arange(int(heads[-1])) + np.repeat(starts[sample] - heads[:-1], size)]
        self.lattice = Lattice(vocab, self.units, heads) if len(sample) else None
        self.place = np.arange(len(self.unit)) - self.edge_of[self.text] if len(self.unit) else self.unit

    def _walk(self, unit_at: np.ndarray, node: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, edge) of the steps from ``node`` to the end of each occurrence's unit."""
        occurrence, edges = [], []
        lat = self.lattice
        key = _scramble(self.keys[self.text[unit_at]], turn, self.place[unit_at])
        live = ~lat.last_node[node]
        unit_at, node, key = unit_at[live], node[live], key[live]
        while len(unit_at):
            edge = lat.draw(node, _uniform(key, node - lat.base[self.unit[unit_at]]))
            occurrence.append(unit_at)
            edges.append(edge)
            node = lat.target[edge]
            live = ~lat.last_node[node]
            unit_at, node, key = unit_at[live], node[live], key[live]
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return cat(occurrence), cat(edges)

    def run(self) -> Iterator[tuple[int, int, float, float, np.ndarray]]:
        """(text, turn, log-probability, perturbed value, edges) and then per text the next value."""
        texts = self.texts
        self.next_value = np.full(texts, -np.inf)
        heaps: list[list] = [[] for _ in range(texts)]
        paths: list[list[np.ndarray]] = [[] for _ in range(texts)]
        value = _gumbel(_uniform(self.keys, 0, 0, 7))
        opened = [(t, float(value[t]), None) for t in range(texts)]
        for turn in range(1, self.k + 1):
            if not opened:
                break
            if self.lattice is None:
                for t, v, _ in opened:
                    yield t, turn, 0.0, v, np.empty(0, np.int64)
                return
            occurrence, edge, begin = self._paths(opened, paths, turn)
            order = np.argsort(occurrence, kind="stable")
            occurrence, edge = occurrence[order], edge[order]
            log_p = self.lattice.log_p[edge]
            edges_at = np.searchsorted(occurrence, self.edge_of)
            running = np.concatenate([[0.0], np.cumsum(log_p)])
            prefix = running[:-1] - np.repeat(running[edges_at[:-1]], np.diff(edges_at))
            which = np.repeat(np.arange(texts), np.diff(edges_at))
            index = np.arange(len(edge)) - edges_at[which]
            bound = np.full(texts, -np.inf)
            bound[[t for t, _, _ in opened]] = [v for _, v, _ in opened]
            open_step = (index > begin[which]) & (self.lattice.size[self._source(edge, occurrence)] > 1)
            candidate = np.flatnonzero(open_step)
            mass = prefix[candidate] + self.lattice.log_rest[edge[candidate]]
            draw = _uniform(self.keys[which[candidate]], turn, index[candidate], 11)
            best = -np.logaddexp(-bound[which[candidate]], -(mass + _gumbel(draw)))
            by = self._best_of_each(which[candidate], best)
            heads = np.searchsorted(which[candidate][by], np.arange(texts + 1)).tolist()
            for t, v, branch in opened:
                a, b = edges_at[t], edges_at[t + 1]
                own = edge[a:b]
                paths[t].append(own)
                yield t, turn, float(running[b] - running[a]), v, own
                number = len(paths[t]) - 1
                for c in by[heads[t] : min(heads[t + 1], heads[t] + self.k + 1)].tolist():
                    i = int(index[candidate[c]])
                    heapq.heappush(heaps[t], (-float(best[c]), number, i, (int(own[i]),)))
                if branch is not None:  # what is left of the set that was opened
                    parent, i, used, node = branch
                    tried = (*used, int(own[i]))
                    if len(tried) < self.lattice.size[node]:
                        left = np.exp(self.lattice.log_p[self._untried(node, tried)]).sum()
                        m = float(prefix[a + i]) + np.log(max(left, 1e-300))
                        g = -np.logaddexp(-v, -(m + _gumbel(_one_uniform(int(self.keys[t]), turn, i, 13))))
                        heapq.heappush(heaps[t], (-float(g), parent, i, tried))
            nxt = []
            for t, _, _ in opened:
                if heaps[t]:
                    self.next_value[t] = -heaps[t][0][0]
                    if turn < self.k:
                        v, parent, i, used = heapq.heappop(heaps[t])
                        nxt.append((t, -v, (parent, i, used, int(self._node_before(paths[t][parent], i, t)))))
                else:
                    self.next_value[t] = -np.inf
            opened = nxt

    def _untried(self, node: int, tried: tuple[int, ...]) -> list[int]:
        first = int(self.lattice.first[node])
        return [e for e in range(first, first + int(self.lattice.size[node])) if e not in tried]

    def _best_of_each(self, text: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The k + 1 best candidates of each text (texts in order), best first."""
        rest, chosen = np.arange(len(text)), []
        for _ in range(min(self.k + 1, 8)):
            if not len(rest):
                break
            heads = np.flatnonzero(np.concatenate([[True], text[rest][1:] != text[rest][:-1]]))
            most = np.maximum.reduceat(best[rest], heads)
            top = best[rest] == np.repeat(most, np.diff(np.append(heads, len(rest))))
            chosen.append(rest[top])
            rest = rest[~top]
        chosen = np.concatenate([*chosen, rest]) if self.k + 1 > 8 else np.concatenate(chosen) if chosen else rest
        return chosen[np.lexsort((-best[chosen], text[chosen]))]

    def _source(self, edge: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """The node that each step of a path leaves."""
        node = np.empty(len(edge), np.int64)
        first = np.ones(len(edge), bool)
        first[1:] = occurrence[1:] != occurrence[:-1]
        node[first] = self.lattice.base[self.unit[occurrence[first]]]
        inner = np.flatnonzero(~first)
        node[inner] = self.lattice.target[edge[inner - 1]]
        return node

    def _node_before(self, path: np.ndarray, i: int, t: int) -> int:
        if i and not self.lattice.last_node[self.lattice.target[path[i - 1]]]:
            return self.lattice.target[path[i - 1]]
        done = int(self.lattice.last_node[self.lattice.target[path[:i]]].sum())
        return self.lattice.base[self.unit[self.edge_of[t] + done]]

    def _paths(self, opened, paths, turn):
        """Steps of the new path of each opened set, and the step at which it branches."""
        lat = self.lattice
        begin = np.full(self.texts, -1)
        occ, edges, at, node = [], [], [], []
        for t, _, branch in opened:
            low, high = self.edge_of[t], self.edge_of[t + 1]
            if branch is None:
                at.append(np.arange(low, high))
                node.append(lat.base[self.unit[low:high]])
                continue
            parent, i, used, source = branch
            begin[t] = i
            kept = paths[t][parent][:i]
            finished = np.cumsum(lat.last_node[lat.target[kept]]) - lat.last_node[lat.target[kept]] if i else np.empty(0, np.int64)
            here = low + int(lat.last_node[lat.target[kept]].sum())
            options = self._untried(source, used)
            share = np.exp(lat.log_p[options] - lat.log_p[options].max()).cumsum()
            u = _one_uniform(int(self.keys[t]), turn, i, 17)
            sibling = options[min(int(np.searchsorted(share, u * share[-1], "right")), len(options) - 1)]
            occ += [low + finished, np.array([here])]
            edges += [kept, np.array([sibling])]
            at.append(np.arange(here, high))
            node.append(np.concatenate([[lat.target[sibling]], lat.base[self.unit[here + 1 : high]]]))
        walked, walked_edges = self._walk(np.concatenate(at), np.concatenate(node), turn)
        return np.concatenate([*occ, walked]).astype(np.int64), np.concatenate([*edges, walked_edges]).astype(np.int64), begin

    def ids(self, vocab: Vocabulary, edges: np.ndarray) -> np.ndarray:
        """Vocabulary ids of a path; characters that fell back become their bytes."""
        if self.lattice is None:
            return edges
        piece = self.lattice.piece[edges]
        if self.lattice.plain:
            return piece
        width = self.lattice.width[edges]
        out = np.repeat(piece, width)
        odd = np.flatnonzero(out >= FALLBACK)
        ahead = (np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width))[odd]
        out[odd] = vocab.byte_ids[self.units[out[odd] - FALLBACK + ahead]]
        return out


    def all_ids(self, vocab: Vocabulary, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all paths one after another, number of ids of each)."""
        size = np.array([len(p) for p in paths], np.int64)
        flat = np.concatenate([*paths, np.empty(0, np.int64)])
        if self.lattice is None or self.lattice.plain:
            return self.ids(vocab, flat), size
        running = np.concatenate([[0], np.cumsum(self.lattice.width[flat])])
        ends = np.cumsum(size)
        return self.ids(vocab, flat), running[ends] - running[ends - size]


class Decoder:
    """Bytes of ids by one gather; the space marks become spaces and the first one goes."""

    def __init__(self, vocab: Vocabulary):
        surface = [s.replace(MARK.encode(), b" ") for s in vocab.surface]
        self.size = np.array([len(s) for s in surface])
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(surface), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        heads = np.cumsum(size) - size
        data = self.data[np.arange(int(size.sum())) + np.repeat(self.first[ids] - heads, size)].tobytes()
        return data[1:] if data[:1] == b" " else data


_LOADED: dict[tuple[str, float], tuple[Vocabulary, Decoder]] = {}


def _load(path: str, alpha: float) -> tuple[Vocabulary, Decoder]:
    if (path, alpha) not in _LOADED:
        vocab = Vocabulary(path, alpha)
        _LOADED[path, alpha] = vocab, Decoder(vocab)
    return _LOADED[path, alpha]


def _sample(path: str, k: int, seed: int, alpha: float, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, _ = _load(path, alpha)
        for batch in batches:
            texts = text_column(batch.column("text")).to_pylist()
            keys = np.array([x or 0 for x in batch.column("key").to_pylist()], np.int64) ^ np.int64(seed)
            marked = pa.array([(MARK + t.replace(" ", MARK)) if t else "" for t in texts], pa.large_string())
            plain = np.array([MARK not in t for t in texts], bool)
            for low, high, raw, offsets in chunks(marked, CHUNK_BYTES):
                sampler = Sampler(vocab, raw, offsets, keys[low:high], k)
                rows = list(sampler.run())
                text = np.array([r[0] for r in rows], np.int64)
                log_p, value = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
                inclusion = -np.expm1(-np.exp(np.minimum(log_p - sampler.next_value[text], 50)))
                flat, sizes = sampler.all_ids(vocab, [r[4] for r in rows])
                data, edges = memoryview(flat.astype("<u4")).cast("B"), (4 * np.concatenate([[0], np.cumsum(sizes)])).tolist()
                written = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                columns = {
                    "key": batch.column("key")[low:high].take(pa.array(text)),
                    "sample": pa.array([r[1] for r in rows], pa.int32()),
                    "log_prob": pa.array(log_p),
                    "perturbed": pa.array(value),
                    "inclusion": pa.array(np.where(np.isneginf(sampler.next_value[text]), 1.0, inclusion)),
                    "n_pieces": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(w) for w in written], pa.int64()),
                    "round_trip": pa.array(plain[low + text]),
                }
                if with_ids:
                    columns["ids"] = pa.array([bytes(w) for w in written], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


SAMPLED = "key long, sample int, log_prob double, perturbed double, inclusion double, n_pieces long, ids_crc32 long, round_trip boolean"


def sample_segmentations(rows: DataFrame, path: str, *, k: int = SAMPLES, seed: int = 0, alpha: float = 1.0, with_ids: bool = False) -> DataFrame:
    """Up to ``k`` distinct segmentations of each ``text``, drawn by its ``key``.

    ``alpha`` sharpens (above 1) or flattens the distribution; ``with_ids`` adds the ids as
    little-endian unsigned 32-bit integers.
    """
    return map_batches(rows.select("key", "text"), _sample(path, k, seed, alpha, with_ids), SAMPLED + (", ids binary" if with_ids else ""))


def _decode_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode = _load(path, 1.0)
        for batch in batches:
            texts = [decode(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)).decode("utf-8", "replace") if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    return run


def decode_segmentations(rows: DataFrame, path: str) -> DataFrame:
    """The text of each row's ``ids``."""
    return map_batches(rows.select("key", "ids"), _decode_ids(path), "key long, text string")


def op3_segmentation(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumnRenamed("doc_id", "key")
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("key", "doc_id")


def op3_decoded(spark, sf_dir: str) -> DataFrame:
    """Every sampled segmentation decoded again: the hash of the text, and whether all samples give the same one."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    decoded = decode_segmentations(sample_segmentations(docs, path, with_ids=True), path).select("key", F.sha2("text", 256).alias("sha"))
    return decoded.groupBy(F.col("key").alias("doc_id")).agg(F.min("sha").alias("decoded_sha256"), (F.min("sha") == F.max("sha")).alias("all_equal"))


#: The space mark itself decodes to a space.
OP3_DECODED_SQL = "SELECT doc_id, sha256(replace(coalesce(text, ''), chr(9601), ' ')) AS decoded_sha256, true AS all_equal FROM documents"
