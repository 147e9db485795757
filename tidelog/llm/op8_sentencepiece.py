"""SentencePiece encoding and decoding, with distinct segmentations sampled by Gumbel top-k.

A text is normalised as the model does (a leading space, spaces as U+2581) and cut into units at the spaces and line
feeds, which no piece crosses. A unit's lattice has an edge for every piece, and for a character without a piece one
of its bytes. Pieces weigh as their ranks in the vocabulary, 1 / (rank + ZIPF) (a merge list has no probabilities of its own), and backward
sums make of the weights the probability of an edge given its start, so that a whole text's segmentations have total 1.

Sampling without replacement: every segmentation has its log-probability plus Gumbel noise, and the k largest are
wanted. The space is searched best first, from the top. A node's largest value is drawn before its parts, the part
that holds it is chosen in proportion to its mass, and the largest value of the rest, given that it is below, is drawn
then (a truncated Gumbel). So the largest value's path is a plain sample, each step of it leaves one open node, the
rest at that step, and the next segmentation is found behind the open node of the largest value. All heuristics are exact, so k + 1 nodes are
opened for k results. The (k+1)-th value is the threshold t, and a result's inclusion score is the probability that
its value is over t, 1 - exp(-exp(log p - t)), 1 if there are no more segmentations. Open nodes of a mass below
exp(-FAINT) of their text count as empty, wherever they are: one of them would be next with a probability of some exp(-FAINT + 10) at most.

All texts of a batch take their steps together in numpy. Noise is a hash of the row's key, the result's rank, and the
step, so it depends on neither partitions nor batches. Lattices of units are kept between batches, up to CACHE
nodes of some 50 bytes; memory otherwise grows with a batch of BATCH bytes, or with the longest text.

Defined cases: null text counts as empty, which has one segmentation, of no pieces; texts with fewer than k segmentations give fewer
rows; rows of equal key and text give equal rows; null keys count as the empty text; U+2581 in a text decodes as a space, as with
the model itself; texts of any length are segmented whole; an empty table gives an empty result; other columns are ignored by sampled(), and kept by
encoded() and segmented() but for those of the names that they add, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import table

NAME = "op8_sentencepiece"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SAMPLES, ZIPF, WIDTH, FAINT, CACHE, BATCH = 2, 10.0, 16, 60.0, 600_000, 1 << 17
_UNIT = re.compile("▁+[^▁\n]*|\n|[^▁\n]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray, turn: np.ndarray | np.uint64) -> np.ndarray:
    """In (0, 1), of a seed and a counter."""
    return ((_mix(seed + np.atleast_1d(turn) * _BASE) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _next_key(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The key of strings that are a character longer."""
    key = (key + code + np.uint64(1)) * _BASE
    return key ^ (key >> np.uint64(32))


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[0], first[0] + 1, ..., size[0] of them, then those from first[1] on, and so on."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Vocabulary:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.content = [b""] * size
        short = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.content[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.content[i] = piece.replace("▁", " ").encode()
                if len(piece) <= WIDTH:
                    short.append((piece, i))
        self.log_weight = -np.log(np.arange(size) + ZIPF)
        self.log_weight[self.byte_ids] = self.log_weight[3]  # bytes weigh the same
        begins = {piece[:n]: -1 for piece, _ in short for n in range(1, len(piece))} | dict(short)
        keys = self._keys(list(begins))
        if len(np.unique(keys)) < len(keys):
            raise ValueError("pieces of equal keys")
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(begins.values()), dtype=np.int32)[order]
        # One slot a key by its first bits; the few that share one are searched for. Slot and key of "none" are the last ones.
        slots = (self.keys >> np.uint64(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, dtype=np.int32)
        self.slot[slots] = np.arange(len(slots))
        shared = np.bincount(slots, minlength=1 << 20) > 1
        self.slot[shared] = -2
        self.bytes = np.frombuffer(b"".join(self.content), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in self.content], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _keys(strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), dtype=np.uint64)
        codes = list(map(_codes, strings))
        sizes = np.array(list(map(len, codes)))
        for n in range(int(sizes.max(initial=0))):
            rows = np.flatnonzero(sizes > n)
            out[rows] = _next_key(out[rows], np.array([codes[r][n] for r in rows], dtype=np.uint64))
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece of each key, -1 where there is none, and whether any piece begins with it."""
        spot = self.slot[keys >> np.uint64(44)]
        some = np.flatnonzero(spot == -2)
        spot[some] = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        known = (self.keys[spot] == keys) & (spot >= 0)
        return np.where(known, self.ids[spot], np.int32(-1)), known

    def joined(self, ids: np.ndarray) -> bytes:
        """What the pieces spell, with the leading space."""
        return self.bytes[_ragged(self.begins[ids], self.sizes[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        text = self.joined(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """Lattices of distinct units, node by node, a node for each character and one at the end. The edges that begin at node n are those from
    first[n] to first[n + 1], by length: `reach` is the running sum of their probabilities, `piece` their piece, -1 for a character's bytes.
    """

    KINDS = {"first": np.int32, "code": np.uint32, "mass": np.float64, "reach": np.float32, "piece": np.int32, "length": np.uint8}
    NODES = ("first", "code", "mass")  # the others have an entry an edge

    def __init__(self, words: Vocabulary):
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.size = self.edges = 0
        for name, kind in self.KINDS.items():
            setattr(self, name, np.zeros(1, dtype=kind))
        self.seen = np.zeros(0, dtype=np.int32)

    def _room(self, nodes: int, edges: int) -> None:
        """Arrays with room for so many more. mass: log of the weight of all ways from a node to its unit's end; code: 0 at a unit's end."""
        for name, kind in self.KINDS.items():
            used, more = (self.size + 1, nodes) if name in self.NODES else (self.edges, edges)
            old = getattr(self, name)
            if used + more > len(old):
                new = np.zeros(max(used + more, len(old) * 3 // 2), dtype=kind)
                new[:used] = old[:used]
                setattr(self, name, new)
        if self.size + nodes > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros(max(self.size + nodes, len(self.seen) * 3 // 2) - len(self.seen), dtype=np.int32)])

    def _thin(self) -> None:
        """Only the units that came more than once since the last time stay, if they are half of the nodes at most."""
        kept = [(u, at) for u, at in self.at.items() if self.seen[at] > 1]
        begins = np.fromiter((at for _, at in kept), dtype=np.int64, count=len(kept))
        sizes = np.fromiter((len(u) + 1 for u, _ in kept), dtype=np.int64, count=len(kept))
        if sizes.sum() > CACHE // 2:
            kept, begins, sizes = [], begins[:0], sizes[:0]
        nodes = _ragged(begins, sizes)
        counts = (self.first[nodes + 1] - self.first[nodes]).astype(np.int64)
        edges = _ragged(self.first[nodes].astype(np.int64), counts)
        held = {k: getattr(self, k)[nodes] if k in self.NODES else getattr(self, k)[edges] for k in self.KINDS}
        self.clear()
        self._room(len(nodes), len(edges))
        for k in ("code", "mass"):
            getattr(self, k)[: len(nodes)] = held[k]
        for k in ("reach", "piece", "length"):
            getattr(self, k)[: len(edges)] = held[k]
        self.first[1 : len(nodes) + 1] = np.cumsum(counts)
        self.at = dict(zip((u for u, _ in kept), (np.cumsum(sizes) - sizes).tolist(), strict=True))
        self.size, self.edges = len(nodes), len(edges)

    def starts(self, units: list[str]) -> np.ndarray:
        """The first node of each unit."""
        out = np.fromiter(map(self.at.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            if self.size > CACHE:
                self._thin()
                out = np.fromiter(map(self.at.get, units, repeat(-1)), dtype=np.int64, count=len(units))
                new = np.flatnonzero(out < 0).tolist()
            fresh = [units[k] for k in new]
            self._add(list(dict.fromkeys(fresh)))
            out[new] = np.fromiter(map(self.at.__getitem__, fresh), dtype=np.int64, count=len(new))
        self.seen[: self.size] += np.bincount(out, minlength=self.size).astype(np.int32)
        return out

    def log_edge(self, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Log-probability of edges, given that a path comes to their nodes."""
        return self.weight(node, edge) + self.mass[node + self.length[edge]] - self.mass[node]

    def weight(self, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
        piece = self.piece[edge]
        out = self.words.log_weight[piece]
        spell = np.flatnonzero(piece < 0)
        out[spell] = self.words.log_weight[3] * _utf8_size(self.code[node[spell]])
        return out

    def _add(self, units: list[str]) -> None:
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        slabs = [0, *(np.flatnonzero(np.diff(begin // 65_536)) + 1).tolist(), len(units)]
        for a, b in zip(slabs, slabs[1:], strict=False):
            if b > a:
                self._solve(units[a:b], sizes[a:b])

    def _solve(self, units: list[str], sizes: np.ndarray) -> None:
        words, ends = self.words, np.cumsum(sizes + 1) - 1
        nodes = int(ends[-1]) + 1
        left = np.repeat(ends, sizes + 1) - np.arange(nodes)  # characters up to the unit's end
        code = np.zeros(nodes, dtype=np.uint32)
        code[left > 0] = _codes("".join(units))
        # Edges by length, for all nodes at once: a node drops out where no piece goes on.
        where, keys, found = np.flatnonzero(left > 0), np.zeros(nodes - len(units), dtype=np.uint64), []
        for n in range(1, WIDTH + 1):
            keys = _next_key(keys, code[where + n - 1].astype(np.uint64))
            piece, known = words.find(keys)
            if n == 1:  # a character without a piece has its bytes
                piece = np.where((piece < 0) & (code[where] < 0x80), words.byte_ids[np.minimum(code[where], 0x7F)], piece)
                found.append((where, piece))
            else:
                some = np.flatnonzero(piece >= 0)
                found.append((where[some], piece[some]))
            longer = np.flatnonzero(known & (left[where] > n))
            where, keys = where[longer], keys[longer]
            if not len(where):
                break
        counts = np.zeros(nodes, dtype=np.int64)
        for at, _ in found:
            counts[at] += 1
        first = np.cumsum(counts) - counts
        total = int(counts.sum())
        piece, length, fill = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.uint8), first.copy()
        for n, (at, p) in enumerate(found, 1):
            piece[fill[at]], length[fill[at]] = p, n
            fill[at] += 1
        start = np.repeat(np.arange(nodes), counts)
        weight = words.log_weight[piece]
        spell = np.flatnonzero(piece < 0)
        weight[spell] = words.log_weight[3] * _utf8_size(code[start[spell]])
        # Backward sums, for all nodes of equal distance from their unit's end at once.
        order = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(int(left.max()) + 2))
        many = counts[order]
        edge_bounds = np.append(0, np.cumsum(many))[bounds]
        edges = _ragged(first[order], many)
        out_weight, out_end = weight[edges], (start + length)[edges]
        row_first = np.cumsum(many) - many
        mass = np.zeros(nodes)
        for d in range(1, len(bounds) - 1):
            a, b = edge_bounds[d], edge_bounds[d + 1]
            rows, opens = order[bounds[d] : bounds[d + 1]], row_first[bounds[d] : bounds[d + 1]] - a
            ways = out_weight[a:b] + mass[out_end[a:b]]
            top = np.maximum.reduceat(ways, opens)
            sums = np.add.reduceat(np.exp(ways - np.repeat(top, many[bounds[d] : bounds[d + 1]])), opens)
            mass[rows] = top + np.log(sums)
        share = np.exp(weight + mass[start + length] - mass[start])
        for j in range(1, int(counts.max())):
            rows = first[counts > j] + j
            share[rows] += share[rows - 1]
        share[first[counts > 0] + counts[counts > 0] - 1] = 1.0
        self._room(nodes, total)
        here, those = slice(self.size, self.size + nodes), slice(self.edges, self.edges + total)
        self.code[here], self.mass[here] = code, mass
        self.first[self.size + 1 : self.size + nodes + 1] = self.edges + first + counts
        self.reach[those], self.piece[those], self.length[those] = np.minimum(share, 1.0), piece, length
        self.at.update(zip(units, (self.size + ends - sizes).tolist(), strict=True))
        self.size, self.edges = self.size + nodes, self.edges + total


def _utf8_size(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64)


@lru_cache(maxsize=1)
def _kept(path: str) -> Lattices:
    """The worker's own, from task to task."""
    return Lattices(vocabulary(path))


def units_of(text: str | None) -> list[str]:
    """The text's units, with U+2581 for the spaces that they begin with."""
    if not text:
        return []
    if "▁" in text or "\0" in text or "  " in text or text[0] == " ":
        return _UNIT.findall("▁" + text.replace(" ", "▁"))
    marked = "▁" + text.replace(" ", "\0▁")
    return list(filter(None, marked.replace("\n", "\0\n\0").split("\0"))) if "\n" in text else marked.split("\0")


class Paths:
    """Sampled segmentations of some texts: steps in order, a node and an edge each."""

    def __init__(self, node: np.ndarray, edge: np.ndarray, first: np.ndarray):
        self.node, self.edge, self.first = node, edge, first  # first: where each text's steps begin, and the end

    @staticmethod
    def sample(lattices: Lattices, starts: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> Paths:
        """Plain samples. starts: the first nodes of the units of all texts; sizes: units a text; seeds: one a text."""
        count = len(starts)
        place = _ragged(np.zeros(len(sizes), dtype=np.int64), sizes).astype(np.uint64)
        own = _mix(np.repeat(seeds, sizes) + place * np.uint64(0xD1B54A32D192ED03))
        who, node, rounds = np.arange(count), starts, []
        while len(who):
            u = np.minimum(_uniform(own, np.uint64(len(rounds) + 1)).astype(np.float32), np.float32(0.99999994))
            edge = lattices.first[node].astype(np.int64)
            beyond = np.flatnonzero(lattices.reach[edge] <= u)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[lattices.reach[edge[beyond]] <= u[beyond]]
            rounds.append((who, node, edge))
            node = node + lattices.length[edge]
            more = np.flatnonzero(lattices.code[node])
            who, node, own = who[more], node[more], own[more]
        steps = np.zeros(count, dtype=np.int64)
        for turn, (w, _, _) in enumerate(rounds, 1):
            steps[w] = turn
        at = np.cumsum(steps) - steps
        nodes, edges = np.empty(int(steps.sum()), dtype=np.int64), np.empty(int(steps.sum()), dtype=np.int64)
        for turn, (w, n, x) in enumerate(rounds):
            spot = at[w] + turn
            nodes[spot], edges[spot] = n, x
        total = np.append(0, np.cumsum(steps))
        return Paths(nodes, edges, total[np.append(0, np.cumsum(sizes))])


def _truncated(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel noise of a location, given that it is at most top; -inf where there is no mass."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        out = location - np.log(np.exp(location - top) - np.log(u))
    return np.where(np.isfinite(location), out, -np.inf)


class Sampler:
    """The k largest perturbed segmentations of each text of a batch, and the threshold."""

    def __init__(self, lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int):
        self.lattices, self.seeds = lattices, seeds
        units = list(map(units_of, texts))
        self.sizes = np.array([len(x) for x in units], dtype=np.int64)
        self.starts = lattices.starts([u for x in units for u in x])
        self.unit_first = np.append(0, np.cumsum(self.sizes))
        self.unit_mass = np.bincount(np.repeat(np.arange(len(texts)), self.sizes), weights=lattices.mass[self.starts], minlength=len(texts))
        n = len(texts)
        self.nodes: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.edges: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.pieces: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.values: list[list[float]] = [[] for _ in range(n)]
        self.log_p: list[list[float]] = [[] for _ in range(n)]
        self._open: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]  # for each result, steps and values of the open nodes
        self._taken: list[dict] = [{} for _ in range(n)]  # (result, step): edges that are gone
        self.threshold = np.full(n, -np.inf)
        top = -np.log(-np.log(_uniform(seeds, np.uint64(0))))
        none = np.zeros(0, dtype=np.int64)
        self._extend(np.arange(n), [none] * n, [none] * n, self.starts, self.sizes, top, 0)
        for rank in range(1, k + 1):
            self._next(rank, rank == k)

    def _extend(self, who: np.ndarray, nodes: list[np.ndarray], edges: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray, top: np.ndarray, rank: int) -> None:
        """A result for each of `who`: its given steps, then samples of the units from `starts` on. Nodes open behind the given steps."""
        lattices = self.lattices
        noise = _mix(self.seeds[who] + np.uint64((2 * rank + 1) * 0xA0761D6478BD642F % (1 << 64)))
        tail = Paths.sample(lattices, starts, sizes, noise)
        given = np.array([len(x) for x in nodes], dtype=np.int64)
        if given.any():
            first = tail.first + np.append(0, np.cumsum(given))
            node, edge = np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.int64)
            is_given = np.zeros(first[-1], dtype=bool)
            is_given[_ragged(first[:-1], given)] = True
            node[is_given], edge[is_given] = np.concatenate(nodes), np.concatenate(edges)
            node[~is_given], edge[~is_given] = tail.node, tail.edge
        else:
            first, node, edge = tail.first, tail.node, tail.edge
        piece = lattices.piece[edge]
        weight = lattices.words.log_weight[piece]
        spell = np.flatnonzero(piece < 0)
        weight[spell] = lattices.words.log_weight[3] * _utf8_size(lattices.code[node[spell]])
        # Edges' probabilities multiply to a text's weight over that of all ways through its units.
        counts = np.diff(first)
        totals = np.bincount(np.repeat(np.arange(len(who)), counts), weights=weight, minlength=len(who)) - self.unit_mass[who]
        # Open nodes matter where a path still has mass. Most paths have lost theirs soon, so the first steps of all texts are tried before whole texts.
        tried, rows = np.minimum(counts, 128), np.arange(len(who))
        step, value = [None] * len(who), [None] * len(who)
        while len(rows):
            size = tried[rows]
            near = _ragged(first[rows], size)
            text = np.repeat(rows, size)
            log_p = np.minimum(lattices.log_edge(node[near], edge[near]), 0.0)
            opens = np.cumsum(size) - size
            before = np.cumsum(log_p) - log_p
            before -= np.repeat(before[np.minimum(opens, max(len(before) - 1, 0))], size) if len(before) else 0.0
            place = near - first[text]
            live = np.flatnonzero((before >= -FAINT) & (place >= given[text]))
            with np.errstate(divide="ignore"):
                rest = np.log(-np.expm1(log_p[live]))
            rest[log_p[live] > -1e-12] = -np.inf
            u = _uniform(_mix(noise + np.uint64(0x632BE59BD9B4E019))[text[live]], place[live].astype(np.uint64))
            values = _truncated(before[live] + rest, top[text[live]], u)
            cuts = np.searchsorted(text[live], np.append(rows, len(who)))
            final = np.zeros(len(rows))
            final[size > 0] = before[(opens + size - 1)[size > 0]]
            enough = (size == counts[rows]) | (final < -FAINT)
            for r, ok, a, b in zip(rows.tolist(), enough.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
                if ok:
                    step[r], value[r] = place[live[a:b]], values[a:b]
            rows = rows[~enough]
            tried[rows] = np.minimum(counts[rows], tried[rows] * 8)
        for k, d in enumerate(who.tolist()):
            a, b = first[k], first[k + 1]
            self.pieces[d].append(piece[a:b])
            self.nodes[d].append(node[a:b])
            self.edges[d].append(edge[a:b])
            self._open[d].append((step[k], value[k]))
            self.values[d].append(float(top[k]))
            self.log_p[d].append(float(min(totals[k], 0.0)))

    def _next(self, rank: int, last: bool) -> None:
        lattices = self.lattices
        who, tops, nodes, edges, starts, sizes = [], [], [], [], [], []
        for d in range(len(self.nodes)):
            while True:
                best, result, at = -np.inf, 0, 0
                for r, (_, values) in enumerate(self._open[d]):
                    if len(values):
                        i = int(values.argmax())
                        if values[i] > best:
                            best, result, at = float(values[i]), r, i
                if best == -np.inf or last:
                    break
                step = int(self._open[d][result][0][at])
                node, edge = self.nodes[d][result], self.edges[d][result]
                here = int(node[step])
                gone = self._taken[d].setdefault((result, step), [int(edge[step])])
                left = np.array([e for e in range(int(lattices.first[here]), int(lattices.first[here + 1])) if e not in gone], dtype=np.int64)
                p = np.exp(lattices.log_edge(np.full(len(left), here), left))
                if p.sum() > 0:
                    break
                self._open[d][result][1][at] = -np.inf  # nothing is left there after all: the next node
            if last:
                self.threshold[d] = best
            if best == -np.inf or last:
                continue
            seed = self.seeds[d : d + 1]
            running = np.cumsum(p)
            pick = int(np.searchsorted(running, _uniform(seed, np.uint64(1_000_003 * rank + 7))[0] * running[-1], side="right"))
            pick = min(pick, len(left) - 1)
            gone.append(int(left[pick]))
            before = lattices.log_edge(node[:step], edge[:step]).sum() if step else 0.0
            remains = np.delete(p, pick).sum()
            location = before + np.log(remains) if remains > 0 else -np.inf
            self._open[d][result][1][at] = _truncated(np.array([location]), np.array([best]), _uniform(seed, np.uint64(1_000_003 * rank + 11)))[0]
            # The rest of the unit, if the new edge doesn't end it, then the units behind it.
            unit = int(np.count_nonzero(lattices.code[node[:step] + lattices.length[edge[:step]]] == 0))
            behind = self.starts[self.unit_first[d] + unit + 1 : self.unit_first[d + 1]]
            goal = here + int(lattices.length[left[pick]])
            if lattices.code[goal] > 0:
                behind = np.append(goal, behind)
            who.append(d), tops.append(best), nodes.append(node[: step + 1]), starts.append(behind), sizes.append(len(behind))
            edges.append(np.append(edge[:step], left[pick]))
        if who:
            self._extend(np.array(who), nodes, edges, np.concatenate(starts), np.array(sizes, dtype=np.int64), np.array(tops), rank)

    def ids(self, d: int, result: int) -> np.ndarray:
        node, piece = self.nodes[d][result], self.pieces[d][result]
        spell = np.flatnonzero(piece < 0)
        if not len(spell):
            return piece
        out = []
        begin = 0
        for i in spell:
            out += [piece[begin:i], self.lattices.words.byte_ids[np.frombuffer(chr(self.lattices.code[node[i]]).encode("utf-8", "surrogatepass"), dtype=np.uint8)]]
            begin = i + 1
        return np.concatenate([*out, piece[begin:]])

    def inclusion(self, d: int, result: int) -> float:
        if self.threshold[d] == -np.inf:
            return 1.0
        return float(-np.expm1(-np.exp(min(self.log_p[d][result] - self.threshold[d], 700.0))))


def seed_of(key: object) -> int:
    return xxhash.xxh64_intdigest("" if key is None else str(key), 8)


def segmentations(lattices: Lattices, keys: list, texts: list[str | None], k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text at most k rows (ids, log-probability, perturbed value, inclusion score), by falling value."""
    texts = [x or "" for x in texts]
    sampler = Sampler(lattices, texts, np.array([seed_of(x) for x in keys], dtype=np.uint64), k)
    return [[(sampler.ids(d, r), sampler.log_p[d][r], sampler.values[d][r], sampler.inclusion(d, r)) for r in range(len(sampler.nodes[d]))] for d in range(len(texts))]


def round_trips(words: Vocabulary, texts: list[str | None], found: list[list[tuple]]) -> list[bool]:
    """For each row of each text, do its pieces decode to the text. All are decoded at once, and held against the text's bytes."""
    ids = [row[0] for rows in found for row in rows]
    if not ids:
        return []
    every = np.concatenate(ids).astype(np.int64)
    data = words.joined(every)
    sizes = np.append(0, np.cumsum(words.sizes[every]))
    ends = np.cumsum([len(x) for x in ids])
    cuts = np.append(0, sizes[ends]).tolist()
    out, at = [], 0
    for text, rows in zip(texts, found, strict=True):
        want = (" " + text.replace("▁", " ")).encode("utf-8", "surrogatepass") if text else b""
        for _ in rows:
            out.append(data[cuts[at] : cuts[at + 1]] == want)
            at += 1
    return out


def _portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of some BATCH bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def sampled(documents: DataFrame, key: str = "doc_id", k: int = SAMPLES, path: str = VOCABULARY) -> DataFrame:
    """key, rank, n_pieces, log_prob, perturbed, inclusion, ids, decoded and text of each sampled segmentation."""
    return documents.select(key, "text").mapInArrow(_rows(key, k, path, True), f"{key} {documents.schema[key].dataType.simpleString()}, {_COLUMNS}, ids array<int>, decoded string, text string")


_COLUMNS = "rank int, n_pieces int, log_prob double, perturbed double, inclusion double"


def _rows(key: str, k: int, path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lattices = vocabulary(path), _kept(path)
        for whole in batches:
            for batch in _portions(whole, "text"):
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = segmentations(lattices, keys, texts, k)
                flat = [(d, r, *row) for d, rows in enumerate(found) for r, row in enumerate(rows, 1)]
                take = pa.array([x[0] for x in flat], pa.int64())
                out = {key: batch.column(0).take(take), "rank": pa.array([x[1] for x in flat], pa.int32()), "n_pieces": pa.array([len(x[2]) for x in flat], pa.int32())}
                out |= {x: pa.array([v[i] for v in flat], pa.float64()) for i, x in enumerate(("log_prob", "perturbed", "inclusion"), 3)}
                if full:
                    out |= {"ids": pa.array([x[2] for x in flat], pa.list_(pa.int32())), "decoded": pa.array([words.decode(x[2]) for x in flat], pa.string()), "text": batch.column(1).take(take)}
                else:
                    digests = [hashlib.sha256(x[2].astype("<i4").tobytes()).hexdigest() for x in flat]
                    out |= {"ids_sha256": pa.array(digests, pa.string()), "round_trip": pa.array(round_trips(words, texts, found), pa.bool_())}
                yield pa.RecordBatch.from_pydict(out)

    return run


def encoded(documents: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """The documents with piece_ids, the first sampled segmentation, seeded by the key, and its inclusion score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _kept(path)
        for whole in batches:
            for batch in _portions(whole, "text"):
                at = batch.schema.get_field_index
                found = segmentations(lattices, batch.column(at(key)).to_pylist(), batch.column(at("text")).to_pylist(), 1)
                columns = [*batch.columns, pa.array([f[0][0] for f in found], pa.list_(pa.int32())), pa.array([f[0][3] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "piece_ids", "inclusion"])

    frame = documents.drop("piece_ids", "inclusion")
    return frame.mapInArrow(run, StructType(list(frame.schema.fields)).add("piece_ids", ArrayType(IntegerType())).add("inclusion", "double"))


_SEGMENTATION = StructType().add("ids", ArrayType(IntegerType())).add("log_prob", "double").add("perturbed", "double").add("inclusion", "double").add("round_trip", "boolean")


def segmented(documents: DataFrame, key: str = "doc_id", path: str = VOCABULARY, k: int = SAMPLES) -> DataFrame:
    """The documents with `segmentations`, their k sampled ones by falling value, seeded by the key, each decoded again
    (round_trip: is that the text), and with piece_ids and inclusion, those of the first one.
    """
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lattices = vocabulary(path), _kept(path)
        for whole in batches:
            for batch in _portions(whole, "text"):
                at = batch.schema.get_field_index
                texts = batch.column(at("text")).to_pylist()
                found = segmentations(lattices, batch.column(at(key)).to_pylist(), texts, k)
                flat = [(d, *row) for d, rows in enumerate(found) for row in rows]
                good = round_trips(words, texts, found)
                numbers = [pa.array([x[i] for x in flat], pa.float64()) for i in (2, 3, 4)]
                each = pa.StructArray.from_arrays([pa.array([x[1] for x in flat], pa.list_(pa.int32())), *numbers, pa.array(good, pa.bool_())], fields=list(kind))
                several = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32()), each)
                columns = [*batch.columns, pa.array([f[0][0] for f in found], pa.list_(pa.int32())), pa.array([f[0][3] for f in found], pa.float64()), several]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "piece_ids", "inclusion", "segmentations"])

    frame = documents.drop("piece_ids", "inclusion", "segmentations")
    schema = StructType(list(frame.schema.fields)).add("piece_ids", ArrayType(IntegerType())).add("inclusion", "double").add("segmentations", ArrayType(_SEGMENTATION))
    return frame.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return documents.mapInArrow(_rows("doc_id", SAMPLES, VOCABULARY, False), f"doc_id bigint, {_COLUMNS}, ids_sha256 string, round_trip boolean")


ORACLE_SQL = None
