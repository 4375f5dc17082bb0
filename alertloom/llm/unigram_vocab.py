"""Unigram pieces and scores of a public SentencePiece vocabulary.

Pieces are byte strings over words that start with a mark byte (a blank, which
no word holds). The model file's scores order the pieces; a piece of rank r
gets weight 1/(r + RANK_SHIFT), normalised over all pieces (Zipf's law with
Mandelbrot's shift). Every byte is a piece of its own, so each word has at
least one segmentation; bytes without an entry get the last rank.
"""

from __future__ import annotations

from math import exp, log

import numpy as np

from alertloom.llm.common import ship_by_value

RANK_SHIFT = 2.7
MARK = b" "


def read_pieces(path: str) -> list[bytes]:
    """Usable pieces by descending score: lower-cased A-Z, without control symbols; all single bytes included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = sorted((-model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    pieces = [model.id_to_piece(i).replace("▁", " ").encode().lower() for _, i in ranked]
    usable = [p for p in pieces if p.rfind(MARK) <= 0]
    return list(dict.fromkeys([*usable, *(bytes([b]) for b in range(256))]))


def prior(pieces: list[bytes]) -> np.ndarray:
    """Probabilities by rank."""
    weights = 1.0 / (np.arange(len(pieces)) + RANK_SHIFT)
    return weights / weights.sum()


class Lattice:
    """All segmentations of a word into pieces, under given natural-log scores; pieces are held in a trie."""

    def __init__(self, pieces: list[bytes], scores: list[float]) -> None:
        self.scores = scores
        #: node * 256 + byte -> next node; node -> piece that ends there, or -1.
        self.steps: dict[int, int] = {}
        self.piece_at = [-1]
        self.longest = max(map(len, pieces), default=0)
        for i, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                following = self.steps.get(node << 8 | byte)
                if following is None:
                    following = self.steps[node << 8 | byte] = len(self.piece_at)
                    self.piece_at.append(-1)
                node = following
            self.piece_at[node] = i

    def arcs(self, word: bytes, low: int, high: int) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every piece in the word that starts from ``low`` to ``high`` - 1, by start."""
        step, piece_at, n, out = self.steps.get, self.piece_at, len(word), []
        for start in range(low, high):
            node, end = 0, start
            while end < n and (node := step(node << 8 | word[end])) is not None:
                end += 1
                if (i := piece_at[node]) >= 0:
                    out.append((start, end, i))
        return out

    def forward(self, word: bytes) -> float:
        """Log probability of all segmentations together: a forward recursion in log space.

        Only as many positions are held as the longest piece spans.
        """
        step, piece_at, scores, n = self.steps.get, self.piece_at, self.scores, len(word)
        ring = min(n, self.longest) + 1
        reached: list[list[float]] = [[] for _ in range(ring)]
        reached[0].append(0.0)
        for start in range(n):
            here = reached[start % ring]
            alpha = here[0] if len(here) == 1 else log_sum(here)
            here.clear()
            node, end = 0, start
            while end < n and (node := step(node << 8 | word[end])) is not None:
                end += 1
                if (i := piece_at[node]) >= 0:
                    reached[end % ring].append(alpha + scores[i])
        return log_sum(reached[n % ring])


def log_sum(values: list[float]) -> float:
    """log(sum(exp(values))) without overflow."""
    top = max(values)
    return top + log(sum([exp(v - top) for v in values]))


ship_by_value(__name__)
