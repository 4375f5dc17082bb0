"""Token counts by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens (words behind their mark) are inserted in a trie. Each new
node gets the best score of any segmentation of its path, and that
segmentation's number of pieces: the pieces that may end there are the path's
suffixes, so a shared prefix is worked out once for all words below it. A
word's count is the one stored where it ends. Of equally good segmentations the
one with fewer pieces counts. A document's count is the sum over its words.

A worker keeps its trie from batch to batch and starts a new one beyond
``MOST_NODES``. Nothing is exchanged. Defined results: null and empty texts have
no tokens; repeated rows give repeated results; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from alertloom.llm.common import checked_columns, ship_by_value
from alertloom.llm.unigram_vocab import MARK, Lattice

#: Nodes of a worker's trie; one word may exceed them by its length.
MOST_NODES = 1_000_000
#: Words up to this many bytes are also looked up whole, without going down the trie again.
SHORT = 64
PART = 1024


class PretokenTrie:
    """Pre-tokens by their bytes; each node holds its path's best score and number of pieces."""

    def __init__(self, pieces: list[bytes], scores: list[float]) -> None:
        #: The vocabulary reversed: finds the pieces that end at a place, going backwards.
        self.backwards = Lattice([p[::-1] for p in pieces], scores)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.counts = [0.0], [0]
        self.short: dict[bytes, int] = {}

    def terminal_count(self, word: bytes) -> int:
        """Number of pieces in the best segmentation of a word behind its mark, which is inserted if it is new."""
        known = self.short.get(word)
        if known is not None:
            return known
        if len(self.best) > MOST_NODES:
            self.clear()
        children, path, node = self.children, [0], 0
        for end, byte in enumerate(word, 1):
            node = children.get(edge := node << 8 | byte)
            if node is None:
                node = children[edge] = len(self.best)
                self._score(word, end, path)
            path.append(node)
        if len(word) <= SHORT:
            self.short[word] = self.counts[node]
        return self.counts[node]

    def _score(self, word: bytes, end: int, path: list[int]) -> None:
        """Score the new node at ``end``, from its ancestors on ``path``."""
        step, piece_at, scores, best, counts = self.backwards.steps.get, self.backwards.piece_at, self.backwards.scores, self.best, self.counts
        top, fewest, reverse, start = -1e300, 0, 0, end
        while start and (reverse := step(reverse << 8 | word[start - 1])) is not None:
            start -= 1
            if (i := piece_at[reverse]) >= 0:
                score = best[path[start]] + scores[i]
                if score > top or (score == top and counts[path[start]] + 1 < fewest):
                    top, fewest = score, counts[path[start]] + 1
        best.append(top)
        counts.append(fewest)


def count_tokens(docs: DataFrame, pieces: list[bytes], scores: list[float]) -> DataFrame:
    """doc_id, n_words, n_tokens and n_distinct_words for every document."""
    docs = checked_columns(docs, "doc_id", "text")
    given = docs.sparkSession.sparkContext.broadcast((pieces, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PretokenTrie(*given.value)
        for batch in batches:
            for low in range(0, batch.num_rows, PART):
                part = batch.slice(low, PART)
                texts = [Counter((x.as_py() or b"").lower().split()) for x in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array([t.total() for t in texts], pa.int64()),
                        "n_tokens": pa.array([sum(n * trie.terminal_count(MARK + w) for w, n in t.items()) for t in texts], pa.int64()),
                        "n_distinct_words": pa.array([len(t) for t in texts], pa.int64()),
                    }
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint, n_distinct_words bigint")


ship_by_value(__name__)
