"""Lattices of vocabulary pieces over many short strings at once, in NumPy.

A string's nodes are the gaps between its characters; an edge is a piece that spells the characters between two nodes.
Characters that are no piece by themselves get an edge of their own with piece -1 (spelled in bytes), so every string
has a path.  All strings of a call are laid out one after another and handled together, position by position.
"""

from __future__ import annotations

import numpy as np

from clausemill.llm.words import mix

_U = np.uint64
SPACE_MARK = 0x2581
#: Stands for a real U+2581 in a text, which no piece may spell.
_ALIEN = 0x110000


class Vocabulary:
    """Pieces of a SentencePiece model: text of each id (None for bytes, controls and unknown) and its rank."""

    def __init__(self, pieces: list[str | None], ranks: np.ndarray, byte_ids: np.ndarray):
        self.pieces, self.ranks, self.byte_ids = pieces, ranks, byte_ids
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for number, piece in enumerate(pieces):
            at = 0
            for ch in piece or "":
                key = (at, ord(ch))
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                at = nodes[key]
            if piece:
                ends[at] = number
        self.ends = np.array(ends, np.int32)
        self.depth = max((len(x) for x in pieces if x), default=1)
        size = 1 << (4 * len(nodes) + 16).bit_length()
        self._mask = _U(size - 1)
        self._keys, self._next = np.full(size, np.iinfo(np.uint64).max, _U), np.full(size, -1, np.int32)
        keys = np.array([a << 21 | c for a, c in nodes], _U)
        left, value = np.arange(len(keys)), np.fromiter(nodes.values(), np.int32, len(nodes))
        at = mix(keys) & self._mask
        while len(left):
            free = self._next[at[left]] == -1
            first = np.unique(at[left[free]], return_index=True)[1]
            win = left[free][first]
            self._keys[at[win]], self._next[at[win]] = keys[win], value[win]
            left = np.setdiff1d(left, win)
            taken = self._next[at[left]] != -1
            at[left[taken]] = (at[left[taken]] + _U(1)) & self._mask

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        """Read a SentencePiece model with byte pieces; called on the driver."""
        import sentencepiece

        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        n = model.get_piece_size()
        special = [model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(n)]
        pieces = [None if special[k] else model.id_to_piece(k) for k in range(n)]
        plain = [k for k in range(n) if not special[k]]
        ranks = np.zeros(n, np.int64)
        ranks[sorted(plain, key=lambda k: -model.get_score(k))] = np.arange(len(plain))
        return cls(pieces, ranks, np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32))

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Trie nodes reached by a character, -1 where there is none."""
        key = node.astype(_U) << _U(21) | char.astype(_U)
        at = mix(key) & self._mask
        out = self._next[at].copy()
        off = np.flatnonzero((out != -1) & (self._keys[at] != key))
        while len(off):
            at[off] = (at[off] + _U(1)) & self._mask
            out[off] = self._next[at[off]]
            off = off[(out[off] != -1) & (self._keys[at[off]] != key[off])]
        return out

    def zipf(self, sharpness: float = 1.0) -> np.ndarray:
        """Log probability of each piece by its rank in the vocabulary; the last entry is that of a spelled character."""
        weight = -sharpness * np.log(self.ranks + 2.0)
        real = np.array([x is not None for x in self.pieces])
        out = np.where(real, weight - np.log(np.exp(weight[real]).sum()), -np.inf)
        return np.append(out, out[real].min() - 5.0)


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the strings in a row, spaces as the vocabulary's mark, and the length of each."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    chars = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(chars == SPACE_MARK, _ALIEN, np.where(chars == 0x20, SPACE_MARK, chars)), sizes


class Lattice:
    """Edges over some strings, in order of their end; node k of string s is base[s] + k."""

    def __init__(self, vocabulary: Vocabulary, strings: list[str]):
        self.chars, self.sizes = code_points(strings)
        n = len(self.chars)
        owner = np.repeat(np.arange(len(strings)), self.sizes)
        self.base = np.cumsum(self.sizes) - self.sizes + np.arange(len(strings))
        self.last = self.base + self.sizes
        first_char = np.cumsum(self.sizes) - self.sizes
        stop = np.repeat(first_char + self.sizes, self.sizes)
        at, node = np.arange(n), np.zeros(n, np.int32)
        single = np.zeros(n, bool)
        starts, widths, pieces = [], [], []
        for width in range(1, vocabulary.depth + 1):
            node = vocabulary.step(node, self.chars[at + width - 1])
            alive = node != -1
            at, node = at[alive], node[alive]
            number = vocabulary.ends[node]
            real = number != -1
            starts.append(at[real])
            widths.append(np.full(int(real.sum()), width, np.int32))
            pieces.append(number[real])
            if width == 1:
                single[at[real]] = True
                bare = np.flatnonzero(~single)
                starts.append(bare)
                widths.append(np.ones(len(bare), np.int32))
                pieces.append(np.full(len(bare), -1, np.int32))
            more = at + width < stop[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        start, width, self.piece = np.concatenate(starts), np.concatenate(widths), np.concatenate(pieces)
        end = start + owner[start] + width
        order = np.argsort(end, kind="stable")
        self.piece, self.end, self.width = self.piece[order], end[order], width[order]
        self.start = self.end - self.width
        self.head = np.flatnonzero(np.append(True, self.end[1:] != self.end[:-1])) if len(order) else order
        self.nodes = n + len(strings)
        rel = self.end[self.head] - np.repeat(self.base, self.sizes) if n else self.end
        self._levels = np.argsort(np.minimum(rel, 65535).astype(np.uint16), kind="stable") if rel.max(initial=0) < 65536 else np.argsort(rel, kind="stable")
        self._cuts = np.append(np.flatnonzero(np.append(True, np.diff(rel[self._levels]) != 0)), len(rel)) if n else np.zeros(1, int)
        self._size = np.diff(np.append(self.head, len(self.end)))

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all paths to each node; log_p has a row for each piece and one for -1."""
        weight = log_p[self.piece]
        alpha = np.zeros((self.nodes, *log_p.shape[1:]))
        for a, b in zip(self._cuts[:-1], self._cuts[1:], strict=True):
            group = self._levels[a:b]
            size = self._size[group]
            begin = np.cumsum(size) - size
            edge = np.repeat(self.head[group] - begin, size) + np.arange(int(size.sum()))
            x = alpha[self.start[edge]] + weight[edge]
            top = np.maximum.reduceat(x, begin, axis=0)
            alpha[self.end[edge[begin]]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size, axis=0)), begin, axis=0))
        return alpha

    def _shares(self, log_p: np.ndarray) -> np.ndarray:
        """For each edge, its posterior among the edges into its end."""
        alpha = self.forward(log_p)
        return np.exp(alpha[self.start] + log_p[self.piece] - alpha[self.end])

    def expected(self, log_p: np.ndarray) -> np.ndarray:
        """For each edge, how often a segmentation of its string uses it, over all segmentations."""
        share, mass = self._shares(log_p), np.zeros(self.nodes)
        mass[self.last] = 1.0
        out = np.zeros(len(share))
        for a, b in zip(self._cuts[-2::-1], self._cuts[:0:-1], strict=True):  # from the last node of each string
            group = self._levels[a:b]
            size = self._size[group]
            edge = np.repeat(self.head[group] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out[edge] = share[edge] * mass[self.end[edge]]
            mass[self.start[edge]] += out[edge]  # each start once: its string has one node on this level
        return out

    def backward_tables(self, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each edge, the summed posterior of the edges into its end up to itself; for each node, its first edge.

        Sums stay within a node, so that they don't depend on the other strings.
        """
        upto = self._shares(log_p)
        for rank in range(1, int(self._size.max(initial=0))):
            at = self.head[self._size > rank] + rank
            upto[at] += upto[at - 1]
        upto[self.head + self._size - 1] = 2.0
        first = np.zeros(self.nodes, np.int64)
        first[self.end[self.head]] = self.head
        return upto, first

    def sample(self, log_p: np.ndarray, which: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample a path for each occurrence: string `which`, beginning at character `places` of a row with `seeds`.

        Returns the characters' places at which pieces begin, counted from the first occurrence's first character as
        all occurrences follow each other, and the edges taken there.  Draws depend on seed and place alone.
        """
        upto, first = self.backward_tables(log_p)
        size = self.sizes[which]
        offset = np.cumsum(size) - size
        taken = np.full(int(size.sum()), -1, np.int64)
        live = np.flatnonzero(size > 0)
        node = self.last[which]
        while len(live):
            rel = node[live] - self.base[which[live]]
            draw = (mix(seeds[live] + (places[live] + rel).astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(11)) * 2.0**-53
            edge = first[node[live]]
            on = np.arange(len(live))
            while len(on := on[draw[on] >= upto[edge[on]]]):
                edge[on] += 1
            node[live] = self.start[edge]
            taken[offset[live] + rel - self.width[edge]] = edge
            live = live[node[live] > self.base[which[live]]]
        at = np.flatnonzero(taken >= 0)
        return at, taken[at]
