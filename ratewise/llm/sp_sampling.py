"""Operator 5: SentencePiece encoding and decoding with sampled segmentations.

``sample_rows`` draws ``k`` distinct segmentations of each text without
replacement by Gumbel top-k: the lattice of all segmentations is searched in
the order of Gumbel-perturbed log-probabilities, with the exact backward sums
of the lattice as the A-star bound.  A subtree's perturbed maximum is drawn
when its parent is opened (a Gumbel truncated at the parent's), so the first
leaf reached is the first sample, the best unopened subtree leads to the next,
and no segmentation can come twice.  The value after the k-th gives each
sample's inclusion probability.

No piece of the vocabulary continues after white space, so the lattice of a
text is the chain of its words' lattices, and each distinct word's sums are
worked out once per slice, frequent ones once per worker.  Words are numbered by
their hashes, and every text is compared with its words' lattices character by
character.  Only edges that a piece has are stored, by node; a slice's lattices
are written over the last one's.  All words of a slice advance together in
numpy; the random numbers are hashes of (row key, place in the text, sample), so
a row's samples do not depend on how rows are batched.

A segmentation's weight is the product of its pieces' weights.  The model file
ranks pieces by merge order and has no probabilities; a piece's weight is
rank ** -``power`` (Zipf's law).  Characters without a piece are one edge of
byte pieces, as in the library.

Map-only: no shuffle; the model file is broadcast (under 1 MB).

Cases: null and empty texts have one empty segmentation; a text with fewer
than k segmentations gives those it has, each with log-inclusion 0; repeated rows
get the same samples (same key); texts of any length are one lattice; an empty
table gives no rows; other columns are ignored.  The word mark U+2581 in a
text reads back as a space, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import per_text, slices, vocabulary

SAMPLES = 2
POWER = 1.0
MARK = "▁"
_NEVER = -np.inf
SLOT_BITS = 21
CACHED = 200_000  # lattice nodes that a worker keeps
_END = 0xFFFFFFFF  # in place of a character: the node after a word's last
SLOT_MASK = np.uint64((1 << SLOT_BITS) - 1)


class Vocabulary:
    """Pieces of a SentencePiece model, as hash tables for numpy."""

    def __init__(self, model: bytes, power: float = POWER):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not special[i]]
        if any(re.search(f"[^{MARK}]{MARK}", names[i]) or "\n" in names[i] for i in normal):
            raise ValueError("a piece continues after white space; words' lattices would not be independent")
        self.longest = max(len(names[i]) for i in normal)
        # one table for pieces and for beginnings of pieces (id -1)
        begun = {names[i][:m]: -1 for i in normal for m in range(1, len(names[i]))}
        begun.update((names[i], i) for i in normal)
        longer = {names[i][:m] for i in normal for m in range(1, len(names[i]))}
        keys = list(begun)
        flat = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in keys])
        h = K.Prefix(K.mix(flat)).ranges(np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(h)
        self.hashes = h[order]
        self.ids = np.array([begun[x] for x in keys], np.int32)[order]
        self.more = np.array([x in longer for x in keys])[order]
        if len(np.unique(self.hashes)) != len(self.hashes):
            raise ValueError("two pieces have one hash")
        # place of each entry by the low bits of its hash; where two share
        # them, the later ones are found by binary search
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        low = (self.hashes & SLOT_MASK).astype(np.int64)
        self.slot[low[::-1]] = np.arange(len(low) - 1, -1, -1)
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        self.shared[low[self.slot[low] != np.arange(len(low))]] = True
        rank = np.empty(n)
        rank[normal] = np.arange(1, len(normal) + 1)
        self.weight = np.zeros(n)
        self.weight[normal] = -power * np.log(rank[normal])
        self.weight = self.weight.astype(np.float32).astype(np.float64)  # as the lattice stores them
        self.byte_weight = float(np.float32(-power * np.log(len(normal) + 256)))
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        # bytes of every piece, for decoding
        data = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else (b"" if special[i] else names[i].encode()) for i in range(n)]
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.size = np.array([len(d) for d in data])
        self.start = np.cumsum(self.size) - self.size

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece id of each hash (-1: none), and whether longer pieces begin so."""
        low = (h & SLOT_MASK).astype(np.int64)
        i = self.slot[low]
        hit = self.hashes[i] == h  # an empty slot's -1 is the last entry, whose slot is not empty
        again = np.flatnonzero(~hit & (i >= 0))
        again = again[self.shared[low[again]]]
        i[again] = np.minimum(np.searchsorted(self.hashes, h[again]), len(self.hashes) - 1)
        hit[again] = self.hashes[i[again]] == h[again]
        return np.where(hit, self.ids[i], -1), hit & self.more[i]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, word marks and all."""
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.data[at].tobytes()


class Lattice:
    """Lattices of words, one after the other.  A word of n characters has the
    nodes ``node`` .. ``node + n``; the edges of node v are
    first[v] .. first[v + 1], by size.  Arrays are longer than what they hold."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.nodes = vocab, 0
        self.point = np.zeros(0, np.uint32)    # by node: its character
        self.first = np.zeros(1, np.int64)
        self.size = np.zeros(0, np.int16)      # by edge: characters,
        self.goes_on = np.zeros(0, bool)       # whether the word does after it,
        self.piece = np.zeros(0, np.int32)     # its piece (-1: spelled in bytes),
        self.logp = np.zeros(0)                # log-probability at its node,
        self.below = np.zeros(0, np.float32)   # and that of the node's shorter edges together (the first: -1)

    def _room(self, nodes: int, edges: int, held: int) -> None:
        """Space for so many more; ``held`` edges are in use."""
        for name, used, n in (("point", self.nodes, self.nodes + nodes), ("first", self.nodes + 1, self.nodes + nodes + 1),
                              *((x, held, held + edges) for x in ("size", "goes_on", "piece", "logp", "below"))):
            old = getattr(self, name)
            if len(old) < n:
                new = np.empty(n + n // 4, old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)

    def add(self, points: np.ndarray, prefix: K.Prefix, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Append the words at points[begin:begin + length]; the first node of each."""
        vocab, longest = self.vocab, self.vocab.longest
        end = np.cumsum(length)
        chars, nodes = int(end[-1]) if len(end) else 0, int(length.sum()) + len(length)
        if not nodes:
            return np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(length)), length)
        i = np.arange(chars)
        node = i + word                             # nodes and edges count from 0 in here
        place = i + (begin - (end - length))[word]
        left = end[word] - i                        # characters to the word's end
        # edges, by size; ``degree`` counts those found at each character
        degree = np.zeros(chars, np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        at, sums, down, ahead = place, prefix.sums[place], prefix.down[place], left
        for size in range(1, longest + 1):
            ids, more = vocab.lookup(K.mix((prefix.sums[at + size] - sums) * down + K.U(size)))
            has = np.arange(len(i)) if size == 1 else np.flatnonzero(ids >= 0)
            weight, which = vocab.weight[ids[has]], i[has]
            if size == 1:  # characters without a piece: bytes
                x = np.flatnonzero(ids < 0)
                c = points[place[x]]
                weight[x] = np.float32(vocab.byte_weight) * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)).astype(np.float32)
            found.append((which, degree[which], np.full(len(has), size, np.int16), ids[has], weight))
            degree[which] += 1
            go = np.flatnonzero(more & (ahead > size))  # only where a longer piece may go on
            if not len(go):
                break
            i, at, sums, down, ahead = i[go], at[go], sums[go], down[go], ahead[go]
        char, rank, size, piece, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        # for the sums: by characters left; in there the nodes' first edges,
        # their second edges and so on, nodes with most edges first
        farthest, most = int(left.max()), int(degree.max())
        width = most + 1
        with_edges = np.bincount(left * width + degree, minlength=(farthest + 1) * width).reshape(-1, width)
        with_edges = np.cumsum(with_edges[:, :0:-1], axis=1)[:, ::-1]  # [t, j]: nodes t before an end, of more than j edges
        start = np.concatenate([[0], np.cumsum(with_edges)])[:-1].reshape(-1, most)
        level = np.concatenate([[0], np.cumsum(with_edges[:, 0])])
        key = left * width + (most - degree)
        order = np.argsort(key.astype(np.uint16) if farthest < (1 << 16) // width - 1 else key, kind="stable")
        where = np.empty(chars, np.int64)
        where[order] = np.arange(chars) - level[left[order]]
        spot = start[left[char], rank] + where[char]
        x, to = np.empty(len(spot)), np.empty(len(spot), np.int64)
        x[spot], to[spot] = weight, node[char] + size
        order = node[order]
        total, upto = np.zeros(nodes), np.empty(len(spot))
        for t in range(1, farthest + 1):
            a, n = int(start[t, 0]), with_edges[t].tolist()
            n = n[:n.index(0)] if 0 in n else n
            cut = [a]
            for m in n:
                cut.append(cut[-1] + m)
            parts = list(zip(n, cut, cut[1:], strict=False))
            x[a:cut[-1]] += total[to[a:cut[-1]]]
            top = x[a:cut[1]].copy()
            for m, b, c in parts[1:]:
                np.maximum(top[:m], x[b:c], out=top[:m])
            for m, b, c in parts:
                np.subtract(x[b:c], top[:m], out=upto[b:c])
            np.exp(upto[a:cut[-1]], out=upto[a:cut[-1]])
            every = upto[a:cut[1]].copy()
            for (_, before, _), (m, b, c) in zip(parts, parts[1:], strict=False):
                upto[b:c] += upto[before:before + m]
                every[:m] = upto[b:c]
            for m, b, c in parts:
                upto[b:c] /= every[:m]
            total[order[level[t]:level[t + 1]]] = top + np.log(every)
        # by node
        base, held = self.nodes, int(self.first[self.nodes])
        self._room(nodes, len(spot), held)
        count = np.zeros(nodes, np.int64)
        count[node] = degree
        first = np.concatenate([[0], np.cumsum(count)])
        self.first[base:base + nodes + 1] = first + held
        self.point[base:base + nodes] = _END
        self.point[base + node] = points[place]
        spot_of = first[node[char]] + rank
        edge = spot_of + held
        self.size[edge], self.piece[edge], self.goes_on[edge] = size, piece, left[char] > size
        self.logp[edge] = x[spot] - total[node[char]]
        below = np.full(len(edge) + 1, -1, np.float32)
        below[spot_of + 1] = upto[spot]
        below[first[node]] = -1
        self.below[held:held + len(edge)] = below[:-1]
        self.nodes += nodes
        return base + end - length + np.arange(len(length))


class Known:
    """Lattices of a slice's words: those of words that earlier slices held
    twice or more (at most ``CACHED`` nodes), and behind them those of the words
    that are new, until the next slice.  A sampler is done with before the next."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.lattice, self.kept = Lattice(self.vocab), 0
        self.hashes, self.nodes = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of kept words, by hash

    def get(self, points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """First node of each word; the words are all of ``points``, in order."""
        if len(self.lattice.point) > 20 * CACHED:  # after a very long text
            self.clear()
        lat = self.lattice
        lat.nodes = self.kept
        prefix = K.Prefix(K.mix(points))
        hashes, one, number, count = np.unique(word_hashes(prefix, begin, length), return_index=True, return_inverse=True, return_counts=True)
        node = np.empty(len(hashes), np.int64)
        at = np.searchsorted(self.hashes, hashes)
        old = np.zeros(len(hashes), bool)
        inside = np.flatnonzero(at < len(self.hashes))
        old[inside] = self.hashes[at[inside]] == hashes[inside]
        node[old] = self.nodes[at[old]]
        keep = np.flatnonzero(~old & (count > 1))
        keep = keep[np.cumsum(length[one[keep]] + 1) <= CACHED - lat.nodes]
        if len(keep):
            node[keep] = lat.add(points, prefix, begin[one[keep]], length[one[keep]])
            self.kept, old[keep] = lat.nodes, True
            self.nodes = np.insert(self.nodes, at[keep], node[keep])
            self.hashes = np.insert(self.hashes, at[keep], hashes[keep])
        new = np.flatnonzero(~old)
        node[new] = lat.add(points, prefix, begin[one[new]], length[one[new]])
        node = node[number]
        place = np.arange(len(points)) + np.repeat(node - begin, length)
        if (lat.point.take(place, mode="clip") != points).any() or (lat.point.take(node + length, mode="clip") != _END).any():
            # two words have one hash: number them by their characters
            text, seen = points.tobytes().decode("utf-32-le"), {}
            number = np.array([seen.setdefault(text[a:a + n], len(seen)) for a, n in zip(begin.tolist(), length.tolist(), strict=True)])
            one = np.unique(number, return_index=True)[1]
            lat.nodes = self.kept
            node = lat.add(points, prefix, begin[one], length[one])[number]
        return node


def word_hashes(prefix: K.Prefix, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    return prefix.ranges(begin, begin + length)


def hashed(seed: np.ndarray, place: np.ndarray, what: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return seed + (place.astype(np.uint64) * np.uint64(64) + np.uint64(what)) * np.uint64(K._BASE)


def unit(state: np.ndarray) -> np.ndarray:
    return ((K.mix(state) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def uniform(seed: np.ndarray, place: np.ndarray, what: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on (row, place, purpose) alone."""
    return unit(hashed(seed, place, what))


class Path:
    """One segmentation of every text of a slice.  ``by_place`` has the edge
    that starts at each character (-1: none); the other arrays are by edge, those
    of text d at start[d]:start[d + 1]: the character, piece and log-probability,
    and the perturbed value of the edges not taken."""

    def __init__(self, by_place: np.ndarray, first: np.ndarray, lattice: Lattice):
        self.by_place, self.at = by_place, np.flatnonzero(by_place >= 0)
        self.edge = by_place[self.at]
        self.piece, self.logp = lattice.piece[self.edge], lattice.logp[self.edge]
        self.rest = np.full(len(self.at), _NEVER)
        self.start = np.searchsorted(self.at, first)


def truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel(location) given that it is at most ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        x = location - np.log(np.exp(location - bound) - np.log(u))
    return np.where(np.isneginf(location), _NEVER, np.minimum(x, bound))


class Sampler:
    """Samples for the texts of one slice."""

    def __init__(self, known: Known, texts: list[str], keys: np.ndarray):
        self.vocab, self.texts = known.vocab, len(texts)
        self.marked = "".join([MARK + t for t in texts if t]).replace(" ", MARK)
        self.points = points = np.frombuffer(self.marked.encode("utf-32-le"), np.uint32)
        self.first = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)])  # characters of text d
        # words: a line end; or marks, if any, and what follows up to a mark or line end
        mark, line = points == ord(MARK), points == ord("\n")
        begins = line.copy()
        begins[1:] |= line[:-1] | (mark[1:] & ~mark[:-1])
        begins[self.first[:-1][np.diff(self.first) > 0]] = True
        self.place = np.flatnonzero(begins)                     # first character of each word
        self.length = np.diff(np.append(self.place, len(points)))
        self.node = known.get(points, self.place, self.length)
        self.lattice = known.lattice
        self.word = np.searchsorted(self.place, self.first)     # words of text d
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.word))
        self.seed = K.mix(keys.view(np.uint64))
        # what the random numbers' hashes advance by over an edge
        self.step = np.arange(self.vocab.longest + 1, dtype=np.uint64) * np.uint64(64) * np.uint64(K._BASE)

    def walk(self, by_place: np.ndarray, words: np.ndarray, skip: np.ndarray, sample: int) -> None:
        """Draw the edges of ``words`` from ``skip`` characters on."""
        lat = self.lattice
        keep = skip < self.length[words]
        words, skip = words[keep], skip[keep]
        node, place, doc = self.node[words] + skip, self.place[words] + skip, self.doc[words]
        state = hashed(self.seed[doc], place - self.first[doc], 2 * sample)
        while len(node):
            u = unit(state).astype(np.float32)
            # the longest edge is the likeliest; sums grow at edges only, so the first one that reaches u is drawn
            edge = lat.first[node + 1] - 1
            over = np.flatnonzero(lat.below[edge] >= u)
            while len(over):
                edge[over] -= 1
                over = over[lat.below[edge[over]] >= u[over]]
            by_place[place] = edge
            on = np.flatnonzero(lat.goes_on[edge])
            size = lat.size[edge[on]].astype(np.int64)
            node, place, state = node[on] + size, place[on] + size, state[on] + self.step[size]

    def draw(self, k: int) -> tuple[list[tuple[int, int, Path, float, float]], np.ndarray]:
        """((text, sample number, path, log-probability, perturbed value) ...),
        and each text's bound: the best value after its last sample."""
        n, lat = int(self.first[-1]), self.lattice
        going = np.flatnonzero(np.diff(self.first) > 0)
        value = np.full(self.texts, _NEVER)
        value[going] = -np.log(-np.log(uniform(self.seed[going], np.zeros(len(going), np.int64), 1)))
        paths: list[Path] = []
        chosen: list[tuple[int, int, Path, float, float]] = []
        taken: dict[tuple[int, int], list[int]] = {}  # (path, place) -> edges of its node already opened
        by_place = np.full(n, -1, np.int64)
        self.walk(by_place, np.arange(len(self.place)), np.zeros(len(self.place), np.int64), 0)
        fresh = self.first[:-1].copy()  # place from which a text's path is new
        for sample in range(k):
            path = Path(by_place, self.first, lat)
            # log-probabilities of the texts' paths, and of every prefix
            upto = np.concatenate([[0.0], np.cumsum(path.logp)])
            before = upto[path.start[:-1]]
            whole = upto[path.start[1:]] - before
            chosen += [(d, sample, path, logp, v) for d, logp, v in zip(going.tolist(), whole[going].tolist(), value[going].tolist(), strict=True)]
            paths.append(path)
            # what the path leaves beside it, from where it is new
            d = np.repeat(np.arange(self.texts), np.diff(path.start))
            new = np.flatnonzero(path.at >= fresh[d])
            d, logp = d[new], path.logp[new]
            with np.errstate(divide="ignore"):
                beside = np.log(np.maximum(-np.expm1(logp), 0.0))
            beside[logp > -1e-12] = _NEVER
            location = (upto[1:][new] - logp - before[d]) + beside
            path.rest[new] = truncated(location, value[d], uniform(self.seed[d], path.at[new] - self.first[d], 2 * sample + 1))
            best, source = np.full(self.texts, _NEVER), np.zeros(self.texts, np.int64)
            for j, p in enumerate(paths):
                some = np.flatnonzero(np.diff(p.start))
                if len(some):
                    top = np.maximum.reduceat(p.rest, p.start[some])
                    better = top > best[some]
                    best[some[better]], source[some[better]] = top[better], j
            value = best
            going = going[np.isfinite(best[going])]
            if sample == k - 1 or not len(going):
                break
            # open the best subtree of each text: same prefix, another edge, then anew
            by_place = np.full(n, -1, np.int64)
            logp_at = [np.zeros(n) for _ in paths]
            for x, p in zip(logp_at, paths, strict=True):
                x[p.at] = p.logp
            at, place, prefix = (np.zeros(len(going), t) for t in (np.int64, np.int64, np.float64))
            for g, (d, j) in enumerate(zip(going.tolist(), source[going].tolist(), strict=True)):
                old, a = paths[j], self.first[d]
                at[g] = i = old.start[d] + np.argmax(old.rest[old.start[d]:old.start[d + 1]])
                place[g] = s = old.at[i]
                by_place[a:s] = old.by_place[a:s]
                prefix[g] = logp_at[j][a:s].sum()
            word = np.searchsorted(self.place, place, side="right") - 1
            node = self.node[word] + place - self.place[word]
            # probabilities of the edges of each size, but those already opened
            edges = np.full((len(going), self.vocab.longest), -1, np.int64)
            p = np.zeros(edges.shape)
            count = lat.first[node + 1] - lat.first[node]
            row = np.repeat(np.arange(len(going)), count)
            e = np.arange(len(row)) + np.repeat(lat.first[node] - (np.cumsum(count) - count), count)
            edges[row, lat.size[e] - 1], p[row, lat.size[e] - 1] = e, np.exp(lat.logp[e])
            gone = [taken.setdefault((j, s), [int(paths[j].by_place[s])]) for j, s in zip(source[going].tolist(), place.tolist(), strict=True)]
            row, e = np.repeat(np.arange(len(going)), [len(x) for x in gone]), np.array([e for x in gone for e in x])
            p[row, lat.size[e] - 1] = 0.0
            c = np.cumsum(p, axis=1)
            seed, offset, every = self.seed[going], place - self.first[going], np.arange(len(going))
            u = uniform(seed, offset, 2 * (sample + 1) + 40)
            size = np.minimum((c < (u * c[:, -1])[:, None]).sum(1), c.shape[1] - 1)
            by_place[place] = edges[every, size]
            for x, e in zip(gone, by_place[place].tolist(), strict=True):
                x.append(e)
            # the edges still closed at this node keep a value below this one
            p[every, size] = 0.0
            with np.errstate(divide="ignore"):
                rest = truncated(prefix + np.log(p.sum(axis=1)), best[going], uniform(seed, offset, 2 * (sample + 1) + 41))
            for j, old in enumerate(paths):
                mine = source[going] == j
                old.rest[at[mine]] = rest[mine]
            count = self.word[going + 1] - word
            begin = np.cumsum(count) - count
            skip = np.zeros(int(count.sum()), np.int64)
            skip[begin] = place - self.place[word] + size + 1
            self.walk(by_place, np.repeat(word - begin, count) + np.arange(len(skip)), skip, sample + 1)
            fresh[going] = place + 1
        return chosen, value

    def ids(self, path: Path) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids[first[d]:first[d+1]] are text d's piece ids on the
        path, bytes spelled out."""
        ids = path.piece.astype(np.int64)
        count = np.ones(len(ids), np.int64)
        spelled = np.flatnonzero(ids < 0)
        point = self.points[path.at[spelled]].astype(np.int64)
        count[spelled] += (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
        end = np.cumsum(count)
        out = np.repeat(ids, count)
        for n in range(1, 5):  # UTF-8 of the characters of n bytes
            mine = count[spelled] == n
            start, c = end[spelled[mine]] - n, point[mine]
            for j in range(n):
                byte = (c >> (6 * (n - 1 - j))) & 0x3F | 0x80
                if j == 0:
                    byte = c if n == 1 else (c >> (6 * (n - 1))) | (0xF00 >> n & 0xFF)
                out[start + j] = self.vocab.byte_id[byte]
        return out, np.concatenate([[0], end])[path.start]

    def spelled(self, text: int) -> str:
        """A text as its pieces spell it, word marks and all."""
        return self.marked[self.first[text]:self.first[text + 1]]


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), x: log-probability over the bound."""
    if x < -30:
        return x
    return float(np.log(-np.expm1(-np.exp(x)))) if x < 3.7 else 0.0


@functools.lru_cache(maxsize=1)
def _known(model: bytes, power: float) -> Known:
    """Kept by a Python worker for its next tasks."""
    return Known(Vocabulary(model, power))


def _model(path: str | None) -> bytes:
    with open(path or vocabulary("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def sample_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                k: int = SAMPLES, power: float = POWER, with_ids: bool = False) -> DataFrame:
    """id, sample (0 ..), n_tokens, log_prob, log_inclusion (log of
    the probability to be among the samples), ids_sha256 (of the little-endian 32-bit ids), round_trip (the ids decode to the text), and
    with ``with_ids`` the ids."""
    if not 1 <= k <= 20:
        raise ValueError("k must be 1 to 20")
    shared = docs.sparkSession.sparkContext.broadcast(_model(path))
    kind_of_id = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = _known(shared.value, power)
            vocab = known.vocab
            for part in slices(batch, "text", 1_000_000):
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                sampler = Sampler(known, texts, part.column("key").to_numpy())
                chosen, bound = sampler.draw(k)
                rows = [(d, 0, 0.0, 0.0, np.zeros(0, np.int32), True) for d, t in enumerate(texts) if not t]
                for path in dict.fromkeys(c[2] for c in chosen):
                    mine = [c for c in chosen if c[2] is path]
                    ids, first = sampler.ids(path)
                    same = vocab.decode(ids) == "".join([sampler.spelled(c[0]) for c in mine]).encode()
                    ids32 = ids.astype("<i4")
                    for d, sample, _, logp, _ in mine:
                        own = ids32[first[d]:first[d + 1]]
                        inclusion = log_inclusion(logp - bound[d]) if np.isfinite(bound[d]) else 0.0
                        rows.append((d, sample, logp, inclusion, own, same or vocab.decode(own) == sampler.spelled(d).encode()))
                rows.sort(key=lambda r: r[:2])
                take = pa.array([r[0] for r in rows], pa.int64())
                cols = [part.column("id").take(take), pa.array([r[1] for r in rows], pa.int32()), pa.array([len(r[4]) for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64()),
                        pa.array([hashlib.sha256(r[4].tobytes()).hexdigest() for r in rows], pa.string()),
                        pa.array([r[5] for r in rows], pa.bool_())]
                if with_ids:
                    cols.append(pa.array([r[4] for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["id", "sample", "n_tokens", "log_prob", "log_inclusion", "ids_sha256", "round_trip"] + ["ids"] * with_ids
    schema = f"id {kind_of_id}, sample int, n_tokens long, log_prob double, log_inclusion double, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and the library's own ids (best segmentation) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(path))

    def factory() -> Callable[[list[str]], list[pa.Array]]:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        return lambda texts: [pa.array(sp.encode(texts, num_threads=1), pa.list_(pa.int32()))]
    return per_text(docs, id_col, text_col, factory, "ids array<int>")


def decode_rows(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and ``text`` of each sequence of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(_model(path))
    kind_of_id = encoded.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            texts = [sp.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind_of_id}, text string")
    return out.withColumnRenamed("id", id_col)
