"""An Aho-Corasick automaton over the pieces of a vocabulary, and a single-pass Viterbi that it drives.

Many words run through the automaton in step, as columns of arrays. At each position the output links give all pieces that
end there, longest first; each relaxes the best score of the position. For a unigram model the score of a split is the
sum of its pieces' scores. For a byte-pair model a split counts only if every two neighbours are what merging their own
text gives; exactly one split of a text has that property, and it is what merging the whole text gives. Whether two pieces
may be neighbours is worked out once per pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words and letters that run in step.
WIDTH = 20_000


class Automaton:
    """pieces: bytes -> id. rank: of a merge of two neighbouring pieces, None if there is none. scores: for unigram models."""

    def __init__(self, pieces: dict[bytes, int], rank: Callable[[bytes, bytes], float | None] | None = None, scores: dict[int, float] | None = None, atoms: Callable[[bytes], list[bytes]] | None = None):
        self.ids, self.rank = pieces, rank
        self.atoms = atoms or (lambda b: [b[i : i + 1] for i in range(len(b))])
        self.text = {i: p for p, i in pieces.items()}
        self.none = max(self.text, default=0) + 1
        self.length = np.zeros(self.none + 1, np.int64)
        self.score = np.zeros(self.none + 1)
        for i, p in self.text.items():
            self.length[i] = len(p)
            self.score[i] = (scores or {}).get(i, 0.0)
        self.build()
        self.pairs = np.empty(0, np.int64)
        self.allowed = np.empty(0, bool)

    def build(self) -> None:
        children: list[dict[int, int]] = [{}]
        own: dict[int, int] = {}
        for piece, i in self.ids.items():
            node = 0
            for b in piece:
                step = children[node].get(b)
                if step is None:
                    step = children[node][b] = len(children)
                    children.append({})
                node = step
            own[node] = i
        self.delta = np.zeros((len(children), 256), np.int32)
        self.first = np.full(len(children), -1, np.int64)
        self.shorter = np.full(self.none + 1, -1, np.int64)
        fail = [0] * len(children)
        order = [0]
        for node in order:
            if node:
                self.delta[node] = self.delta[fail[node]]
                self.first[node] = own.get(node, self.first[fail[node]])
                if node in own:
                    self.shorter[own[node]] = self.first[fail[node]]
            for b, child in children[node].items():
                fail[child] = int(self.delta[fail[node], b]) if node else 0
                order.append(child)
            for b, child in children[node].items():
                self.delta[node, b] = child

    def merge(self, text: bytes) -> list[bytes]:
        """Pieces of a short text by merging, the best-ranked pair first and of equal ones the leftmost."""
        parts = self.atoms(text)
        while len(parts) > 1:
            ranks = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
            if not ranks:
                break
            _, i = min(ranks)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_join(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces as they are; `none` before a piece asks for the piece alone."""
        codes = before * (self.none + 1) + piece
        wanted = np.unique(codes)
        at = np.searchsorted(self.pairs, wanted)
        new = wanted[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != wanted)] if len(self.pairs) else wanted
        if len(new):
            answers = []
            for code in new.tolist():
                a, b = divmod(code, self.none + 1)
                pair = [self.text[b]] if a == self.none else [self.text[a], self.text[b]]
                answers.append(self.merge(b"".join(pair)) == pair)
            joined = np.concatenate([self.pairs, new])
            order = np.argsort(joined, kind="stable")
            self.pairs, self.allowed = joined[order], np.concatenate([self.allowed, answers])[order].astype(bool)
        return self.allowed[np.searchsorted(self.pairs, codes)]

    def viterbi(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of falling length: the last piece up to each position (-1: none), and how many pieces lead there."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max(initial=0))
        letters = np.zeros((len(words), width), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        letters[np.arange(width) < lengths[:, None]] = flat
        last = np.full((len(words), width + 1), -1, np.int64)
        best = np.full((len(words), width + 1), -np.inf)
        count = np.zeros((len(words), width + 1), np.int32)
        last[:, 0], best[:, 0] = self.none, 0.0
        state = np.zeros(len(words), np.int32)
        for i in range(1, width + 1):
            alive = int(np.searchsorted(-lengths, -i, "right"))
            state = self.delta[state[:alive], letters[:alive, i - 1]]
            piece = self.first[state]
            rows = np.flatnonzero(piece >= 0)
            piece = piece[rows]
            while len(rows):
                start = i - self.length[piece]
                before = last[rows, start]
                good = before >= 0
                if self.rank is not None:
                    good[good] = self.may_join(before[good], piece[good])
                value = best[rows, start] + self.score[piece]
                better = good & (value > best[rows, i])
                r, p, s = rows[better], piece[better], start[better]
                last[r, i], best[r, i], count[r, i] = p, value[better], count[r, s] + 1
                piece = self.shorter[piece]
                on = (piece >= 0) & ~good if self.rank is not None else piece >= 0
                rows, piece = rows[on], piece[on]
        return last, count, lengths

    def each(self, words: list[bytes]):
        """Runs of the Viterbi over all words, as (positions in words, last, count, lengths)."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        at = 0
        while at < len(order):
            wide = max(1, len(words[order[at]]))
            chosen = order[at : at + max(1, min(WIDTH, (1 << 22) // wide))]
            yield (chosen, *self.viterbi([words[k] for k in chosen]))
            at += len(chosen)

    def counts(self, words: list[bytes]) -> list[int]:
        out = [0] * len(words)
        for chosen, last, count, lengths in self.each(words):
            for k, n in zip(chosen, count[np.arange(len(chosen)), lengths].tolist()):
                out[k] = n
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Piece ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        for chosen, last, _, lengths in self.each(words):
            at, steps, rows = lengths.copy(), [], np.arange(len(chosen))
            while (at > 0).any():
                piece = np.where(at > 0, last[rows, at], -1)
                steps.append(piece)
                at = np.maximum(at - np.where(piece >= 0, self.length[piece], 0), 0)
            found = np.stack(steps[::-1], 1).tolist() if steps else [[]] * len(chosen)
            for k, ids in zip(chosen, found):
                out[k] = [i for i in ids if i >= 0]
        return out
