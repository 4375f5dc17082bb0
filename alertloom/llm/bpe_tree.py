"""Byte-level BPE encoding and decoding by monoid tree reduction.

Each pre-token is halved down to single bytes. Two neighbouring encodings are
joined by re-encoding a window of tokens around the seam; the window grows on
whichever side is not yet stable. A side is stable when the outermost token of
the window and the untouched token next to it are *compatible*: encoding their
concatenated bytes gives back just the two. A token sequence whose neighbours
are all compatible is the BPE encoding of its bytes, because no merge of lower
rank can cross any of its seams; so tokens outside the window are final.
Decoding concatenates byte strings up a balanced tree.

Nulls are empty texts with no tokens; repeated rows give repeated results; an
empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from alertloom.llm.common import checked_columns, lean, ship_by_value

#: Distinct pieces that a worker remembers before it starts afresh; bounds memory.
MEMO_PIECES = 400_000


class TreeBpe:
    """Encoder and decoder over tiktoken-style ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Apply the merges in rank order, leftmost first, to a whole byte string."""
        n = len(data)
        ends, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n and (rank := self.ranks.get(data[i : ends[j]])) is not None:
                heapq.heappush(queue, (rank, i, ends[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, end = heapq.heappop(queue)
            j = ends[i]
            if not alive[i] or j >= n or not alive[j] or ends[j] != end:
                continue
            alive[j], ends[i] = False, end
            if end < n:
                prev[end] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return tuple(self.ranks[data[i : ends[i]]] for i in range(n) if alive[i])

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two tokens' bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO_PIECES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b])
        return known

    def compatible(self, a: int, b: int) -> bool:
        return self.pair(a, b) == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the concatenation of what two encodings stand for."""
        if not left or not right:
            return left + right
        a = b = 1
        window = self.pair(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        while True:
            lo, hi = max(0, len(left) - a), min(len(right), b)
            if a + b > 2:
                window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[lo:] + right[:hi])))
            firm_left = lo == 0 or self.compatible(left[lo - 1], window[0])
            firm_right = hi == len(right) or self.compatible(window[-1], right[hi])
            if firm_left and firm_right:
                return left[:lo] + window + right[hi:]
            a, b = a * (1 if firm_left else 2), b * (1 if firm_right else 2)

    def tree(self, data: bytes) -> tuple[int, ...]:
        """Encode by halves."""
        if len(data) == 1:
            return (self.ranks[data],)
        known = self.memo.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= 64:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[data] = known
        return known

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern; a match that is itself a token is that token."""
        data = piece.encode()
        rank = self.ranks.get(data)
        return self.tree(data) if rank is None else (rank,)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(_PieceBytes(self).__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for, concatenated level by level."""
        level = list(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        while len(level) > 1:
            level = [b"".join(level[i : i + 64]) for i in range(0, len(level), 64)]
        return level[0] if level else b""


class _PieceBytes(dict):
    """Packed ids by piece, bounded."""

    def __init__(self, bpe: TreeBpe) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.piece(piece), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode the whole text of every document.

    Returns doc_id, the columns named in ``extra``, n_tokens, ids_sha256 and
    decoded_sha256; with ``keep_ids`` also ids, packed as little-endian unsigned
    32-bit integers. The rank table (a fixed vocabulary file) goes to the
    workers with the function; no rows are exchanged.
    """
    docs = checked_columns(docs, "doc_id", "text", *extra)
    fields = [docs.schema[c] for c in ("doc_id", *extra)]
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(table.value, pattern)
        packed, digest = _PieceBytes(bpe).__getitem__, lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [b"".join(map(packed, bpe.split(x.as_py() or ""))) for x in part.column("text")]
                out = {n: part.column(n) for n in names}
                out |= {
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array(map(digest, ids), pa.string()),
                    "decoded_sha256": pa.array([digest(bpe.decode(x)) for x in ids], pa.string()),
                }
                if keep_ids:
                    out["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.mapInArrow(lean(run), schema)


ship_by_value(__name__)
