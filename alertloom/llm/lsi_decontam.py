"""Benchmark decontamination by latent semantic retrieval and alignment.

Documents are cut into overlapping passages. Passages and benchmark items are
TF-IDF vectors over the items' vocabulary, with document frequencies counted over
every document. A randomised SVD of the items' and all documents' passages gives
the latent axes: how much any two terms have in common is summed over every
passage once (as sparse cells, by partition), and the products that the SVD
needs are taken with that matrix. Every passage of every document is searched: its
latent cosine is taken with each item that could still be a leak there, which
leaves out only items of which too few words stand around the passage for any
common subsequence to be long enough. Candidates of enough cosine are aligned with
the item by longest common subsequence around the passage. An item counts as
leaked where the subsequence covers ``SURE`` of it, or ``LIKELY`` of it and its
answer (its last sentence) stands there word for word.

Words are lower-cased and stripped of ASCII punctuation. Items are read one block
at a time, of ``BLOCK_ITEMS`` items or ``BLOCK_WORDS`` words at most (a longer
item is a block of its own), so what the driver holds and broadcasts is bounded.
A block's documents are stored as term numbers, so texts are split into words once
a block; its leaks are written before the next block is read. Defined
results: null and empty texts and items match nothing; repeated rows give
repeated results; with no items or no documents the result is empty; extra
columns are ignored, and kept under any name by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import checked_columns, lean, remove_written, row_key, sheltered, ship_by_value, written

PASSAGE, STRIDE = 32, 16
AXES, EXTRA_AXES, POWER = 256, 16, 2
BLOCK_ITEMS, BLOCK_WORDS = 1_024, 16_384
#: Passages that are looked at together, and the share of passages from which a word counts as frequent there.
COARSE, FREQUENT = 4, 0.05
#: Least latent cosine of a candidate.
LEAST_COSINE = 0.3
SURE, LIKELY = 0.6, 0.45
#: Words gathered from documents before they are looked up together.
BATCH_WORDS = 200_000
#: Passages whose latent vectors are made at once.
ROWS = 2_048
#: Pairs of a passage and an item whose words are gathered at once.
PAIRS = 5_000
#: Products of two terms of a passage that are summed at once by a worker.
PRODUCTS = 6_000_000
#: Terms whose rows of the matrix of common terms are stored together, and tasks that multiply by it (its size doesn't grow with the documents).
STRIP, MULTIPLIERS = 16, 8
#: ASCII punctuation becomes a blank, A-Z lower case.
FOLD = bytes(32 if chr(b) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def fold(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def answer_of(text: bytes | None) -> list[bytes]:
    """The words of an item's last sentence that has any."""
    for mark in b".?!\n":
        text = (text or b"").replace(bytes([mark]), b"\x00")
    return next((w for part in reversed(text.split(b"\x00")) if (w := fold(part))), [])


def common_subsequence(item: list, words: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(item)) - 1
    for w in words:
        if (match := places.get(w)) is not None:
            both = row & match
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


class Gathered:
    """Words of several documents in one row, as term numbers; the last number stands for all other words."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.concatenate([np.zeros(0, np.int32), *texts], dtype=np.int32)

    def windows(self, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, low, high) of passages that start every ``stride`` words; the last one may be shorter."""
        n = np.where(self.sizes > 0, np.maximum(1, -(-(self.sizes - PASSAGE) // stride) + 1), 0)
        doc = np.repeat(np.arange(len(n)), n)
        low = self.begin[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * stride
        return doc, low, np.minimum(low + PASSAGE, self.begin[doc + 1])


def number_type(terms: dict[bytes, int]) -> str:
    return "<u2" if len(terms) < 1 << 16 else "<i4"


def numbered(rows: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, words) of rows of doc_id and text: the words' term numbers, as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        get, other, kind = known.get, repeat(len(known)), number_type(known)
        for batch in batches:
            words = [np.fromiter(map(get, fold(x.as_py()), other), kind).tobytes() for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "words": pa.array(words, pa.binary())})

    return rows.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, words binary")


def gathered(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[list, Gathered]]:
    """Numbered documents in groups of about ``BATCH_WORDS`` words: ids, term numbers."""
    ids: list = []
    texts: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for doc_id, words in zip(batch.column("doc_id").to_pylist(), batch.column("words"), strict=True):
            ids.append(doc_id)
            texts.append(np.frombuffer(words.as_py(), kind))
            held += len(texts[-1])
            if held >= BATCH_WORDS:
                yield ids, Gathered(texts)
                ids, texts, held = [], [], 0
    if ids:
        yield ids, Gathered(texts)


class Coverage:
    """Which items can a passage's surroundings hold: the item's places whose words stand there, as bits.

    No common subsequence is longer than the number of those places, so no leak
    is left out. It is first looked for around ``COARSE`` passages together, with
    the most frequent words' places taken as held; what is left is then counted
    exactly, passage by passage.
    """

    def __init__(self, items: list[list[int]], answers: list[list[int]], size: int, idf: np.ndarray) -> None:
        frequent = np.append(idf[:size] < -np.log(FREQUENT), True)
        self.classes = []
        by_reach: dict[tuple[int, int], list[int]] = {}
        for i, w in enumerate(items):
            by_reach.setdefault((-(-len(w) // STRIDE), -(-len(w) // 64)), []).append(i)
        for (reach, lanes), which in sorted(by_reach.items()):
            bits = np.zeros((size + 1, len(which), lanes), np.uint64)
            answer = np.zeros((len(which), lanes), np.uint64)
            for c, i in enumerate(which):
                asked = set(answers[i])
                for k, w in enumerate(items[i]):
                    bit = np.uint64(1 << k % 64)
                    bits[w, c, k // 64] |= bit
                    if w in asked:
                        answer[c, k // 64] |= bit
            always = np.bitwise_or.reduce(bits[frequent], axis=0)
            sizes = np.array([len(items[i]) for i in which])
            self.classes.append((reach, np.array(which), bits, bits.any((1, 2)) & ~frequent, always, answer, sizes))

    def _long_enough(self, around: np.ndarray, answer: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        count = np.bitwise_count(around).sum(-1, dtype=np.int64)
        answered = ((around & answer) == answer).all(-1)
        return (count >= SURE * sizes - 1e-6) | (answered & (count >= LIKELY * sizes - 1e-6))

    def pairs(self, g: Gathered) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) pairs; passages are numbered as ``g.windows(STRIDE)`` gives them."""
        doc, low, _ = g.windows(STRIDE)
        windows = np.bincount(doc, minlength=len(g.sizes))
        first_window = np.cumsum(windows) - windows
        groups = -(-windows // COARSE)
        of_group = np.repeat(np.arange(len(groups)), groups)
        at_group = np.arange(len(of_group)) - np.repeat(np.cumsum(groups) - groups, groups)
        found = [np.zeros((2, 0), np.int64)]
        of = np.repeat(np.arange(len(g.sizes)), g.sizes)
        wide_piece = COARSE * STRIDE
        pieces = -(-g.sizes // wide_piece)
        place = (np.arange(len(g.ids)) - g.begin[of]) // wide_piece
        for reach, which, bits, seen, always, answer, sizes in self.classes:
            # Pieces of COARSE strides, with empty ones between documents.
            back, ahead = -(-reach // COARSE), (reach + PASSAGE // STRIDE + COARSE - 2) // COARSE
            wide = back + 1 + ahead
            first = np.cumsum(pieces + wide) - pieces
            known = np.flatnonzero(seen[g.ids])
            held = np.zeros((int((pieces + wide).sum()) + 2 * wide, *bits.shape[1:]), np.uint64)
            if len(known):
                piece = first[of[known]] + place[known]
                starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
                held[piece[starts]] = np.bitwise_or.reduceat(bits[g.ids[known]], starts, axis=0)
            n = 1
            while 2 * n <= wide:
                held, n = held[:-n] | held[n:], 2 * n
            if n < wide:
                held = held[: n - wide] | held[wide - n :]
            u, c = np.nonzero(self._long_enough(held[first[of_group] + at_group - back] | always, answer, sizes))
            r = (first_window[of_group[u]] + COARSE * at_group[u])[:, None] + np.arange(COARSE)
            own = COARSE * at_group[u][:, None] + np.arange(COARSE) < windows[of_group[u]][:, None]
            r, c = r[own], np.repeat(c, COARSE).reshape(-1, COARSE)[own]
            for k in range(0, len(r), PAIRS):
                w, i = r[k : k + PAIRS], c[k : k + PAIRS]
                start = np.maximum(low[w] - reach * STRIDE, g.begin[doc[w]])
                length = np.minimum(low[w] + (reach + PASSAGE // STRIDE) * STRIDE, g.begin[doc[w] + 1]) - start
                edge = np.cumsum(length) - length
                words = np.repeat(start - edge, length) + np.arange(int(length.sum()))
                around = np.bitwise_or.reduceat(bits[g.ids[words], np.repeat(i, length)], edge, axis=0)
                ok = self._long_enough(around, answer[i], sizes[i])
                found.append(np.stack([w[ok], which[i[ok]]]))
        return tuple(np.concatenate(found, axis=1))


def _summed(rows: DataFrame, run: Callable, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over partitions of the arrays that ``run`` yields; only their sum, of a fixed shape, reaches the driver."""
    step = max(1, 200_000 // max(1, int(np.prod(shape[1:]))))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in run(batches):
            total += x
        cuts = range(0, shape[0], step)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(cuts), pa.int64()), "data": pa.array([total[c : c + step].tobytes() for c in cuts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in table.column("data").to_pylist()], axis=0)
        return pa.table({"part": table.column("part")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(shape)
    for row in rows.mapInArrow(lean(parts), "part bigint, data binary").groupBy("part").applyInArrow(add, "part bigint, data binary").collect():
        piece = np.frombuffer(bytes(row.data)).reshape(-1, *shape[1:])
        out[row.part : row.part + len(piece)] = piece
    return out


def passage_frequencies(docs: DataFrame, size: int, kind: str) -> np.ndarray:
    """For each of ``size`` terms the number of passages (end to end) with it; at the end, the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        n = size + 1
        for _, g in gathered(batches, kind):
            doc, low, high = g.windows(PASSAGE)
            at = np.repeat(np.arange(len(low)), high - low)
            inside = g.ids < size
            distinct = np.unique(at[inside] * n + g.ids[inside])
            counts = np.bincount(distinct % n, minlength=n).astype(float)
            counts[-1] = len(low)
            yield counts

    return _summed(docs, run, (size + 1,))


def term_products(g: Gathered, idf: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every two terms of a passage (TF-IDF, of unit length, end to end): cell, the first term * size + the other, and the product of their weights."""
    _, low, high = g.windows(PASSAGE)
    at, ids = np.repeat(np.arange(len(low)), high - low), g.ids
    at, ids = at[ids < size], ids[ids < size]
    cells, counts = np.unique(at * size + ids, return_counts=True)
    at, ids = cells // size, cells % size
    weight = counts * idf[ids]
    norm = np.sqrt(np.bincount(at, weight**2, minlength=len(low)))
    weight = weight / np.maximum(norm[at], 1e-12)
    for apart in range(PASSAGE):
        one = np.flatnonzero(at[apart:] == at[: len(at) - apart])
        if not len(one):
            return
        yield ids[one] * size + ids[one + apart], weight[one] * weight[one + apart]


def added_up(held: list[np.ndarray], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Sums by cell, a row for each strip of terms; ``held``: the cell and, in the last ``bits`` bits, the product, so that numbers alone are sorted."""
    both = np.concatenate(held)
    both.sort()
    cell = both >> bits
    edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    cell, total = cell[edges], (np.add.reduceat(both & ((1 << bits) - 1), edges) / (1 << bits)).astype(np.float32)
    strip = cell // (STRIP * size)
    begin = np.flatnonzero(np.append(True, strip[1:] != strip[:-1]))
    place = (cell - strip * (STRIP * size)).astype(np.int64)
    rows = list(zip(begin.tolist(), np.append(begin[1:], len(cell)).tolist(), strict=True))
    yield _strips(strip[begin], [place[a:b] for a, b in rows], [total[a:b] for a, b in rows])


def _strips(strip: np.ndarray, places: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "strip": pa.array(strip, pa.int64()),
            "places": pa.array([x.astype(np.int32).tobytes() for x in places], pa.binary()),
            "sums": pa.array([x.astype(np.float32).tobytes() for x in sums], pa.binary()),
        }
    )


def _cells(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(batch.column("places")[k].as_py(), np.int32), np.frombuffer(batch.column("sums")[k].as_py(), np.float32)


def common_terms(docs: DataFrame, idf: np.ndarray, size: int, kind: str) -> DataFrame:
    """A'A of the TF-IDF passages A of all numbered rows, on and above the diagonal, in strips of terms (strip, places, sums); stored."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    bits = 62 - (size * size).bit_length()
    columns = "strip bigint, places binary, sums binary"

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for _, g in gathered(batches, kind):
            for cell, weight in term_products(g, shared.value, size):
                held.append(cell << bits | np.minimum((weight * (1 << bits)).astype(np.int64), (1 << bits) - 1))
                n += len(cell)
            if n >= PRODUCTS:
                yield from added_up(held, size, bits)
                held, n = [], 0
        if n:
            yield from added_up(held, size, bits)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, strip in enumerate(batch.column("strip").to_pylist()):
                places, sums = _cells(batch, k)
                if strip not in strips:
                    strips[strip] = np.zeros(STRIP * size)
                strips[strip][places] += sums
        for strip, row in strips.items():
            places = np.flatnonzero(row)
            yield _strips(np.array([strip]), [places], [row[places]])

    return written(spark, docs.mapInArrow(lean(products), columns).repartition("strip").mapInArrow(lean(total), columns), "common-terms")


def latent_axes(docs: DataFrame, idf: np.ndarray, size: int, kind: str, axes: int = AXES) -> np.ndarray:
    """Orthonormal term vectors (terms x axes) by a randomised SVD of the TF-IDF passages of all numbered rows."""
    width = min(axes + EXTRA_AXES, size)
    context = docs.sparkSession.sparkContext
    common = common_terms(docs, idf, size, kind)
    few = common.coalesce(MULTIPLIERS)

    def gram(q: np.ndarray) -> np.ndarray:
        given = context.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            q = given.value
            out = np.zeros_like(q)
            for batch in batches:
                for k, strip in enumerate(batch.column("strip").to_pylist()):
                    rows = slice(strip * STRIP, min(size, (strip + 1) * STRIP))
                    places, sums = _cells(batch, k)
                    above = np.zeros((STRIP, size))
                    above.ravel()[places] = sums
                    above = above[: rows.stop - rows.start]
                    out[rows] += above @ q
                    np.fill_diagonal(above[:, rows], 0)
                    out += above.T @ q[rows]
            yield out

        total = _summed(few, run, q.shape)
        given.destroy()
        return total

    q = np.random.default_rng(8).standard_normal((size, width))
    for _ in range(POWER):
        q = np.linalg.qr(gram(q))[0]
    values, vectors = np.linalg.eigh(q.T @ gram(q))
    remove_written(common)
    keep = np.argsort(values)[::-1][:axes]
    return q @ vectors[:, keep[values[keep] > 1e-9]]


def find_block(docs: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
    """Leaks of one block of items; stored."""
    spark = docs.sparkSession
    words = [fold(t) for _, t in items]
    terms = {w: i for i, w in enumerate(sorted(set(chain.from_iterable(words))))}
    size, kind = len(terms), number_type(terms)
    rows = written(spark, numbered(docs, terms), "numbered")
    frequencies = passage_frequencies(rows, size, kind)
    idf = np.log((frequencies[-1] + 1) / (np.append(frequencies[:-1], 0) + 1)) + 1e-3
    # From Arrow, as Spark starts further Python workers to read rows of Python objects, and they stay.
    item_texts = spark.createDataFrame(pa.table({"doc_id": pa.array(range(len(items)), pa.int64()), "text": pa.array([t for _, t in items], pa.binary())})).coalesce(1)
    axes = latent_axes(rows.select(F.lit(None).cast("bigint").alias("doc_id"), "words").unionByName(numbered(item_texts, terms)), idf, size, kind)
    item_words = [[terms[x] for x in w] for w in words]
    item_rows = np.zeros((len(items), axes.shape[1]), np.float32)
    for i, ids in enumerate(item_words):
        row = (idf[ids, None] * axes[ids]).sum(0)
        item_rows[i] = row / max(np.linalg.norm(row), 1e-12)
    table = np.vstack([idf[:-1, None] * axes, np.zeros((1, axes.shape[1]))]).astype(np.float32)
    answers = [[terms[x] for x in answer_of(t)] for _, t in items]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = spark.sparkContext.broadcast((idf, table, item_rows, item_words, answers, [i for i, _ in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, table, item_rows, item_words, answers, item_ids = given.value
        coverage = Coverage(item_words, answers, size, idf)
        for ids, g in gathered(batches, kind):
            doc, low, high = g.windows(STRIDE)
            found: dict[tuple[int, int], tuple] = {}
            near, which = coverage.pairs(g)
            rows = np.unique(near)
            near = np.searchsorted(rows, near)
            for part in range(0, len(rows), ROWS):
                spans = [g.ids[a:b] for a, b in zip(low[rows[part : part + ROWS]].tolist(), high[rows[part : part + ROWS]].tolist(), strict=True)]
                latent = np.add.reduceat(table[np.concatenate(spans)], np.cumsum([0, *map(len, spans[:-1])]), axis=0)
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
                here = np.flatnonzero((near >= part) & (near < part + ROWS))
                cosines = np.einsum("ij,ij->i", latent[near[here] - part], item_rows[which[here]])
                close = here[cosines >= LEAST_COSINE]
                for r, i, cosine in zip(rows[near[close]].tolist(), which[close].tolist(), cosines[cosines >= LEAST_COSINE].tolist(), strict=True):
                    d, w = int(doc[r]), item_words[i]
                    at = int(low[r] - g.begin[d])
                    around = g.ids[max(g.begin[d], low[r] - len(w)) : min(g.begin[d + 1], low[r] + PASSAGE + len(w))].tolist()
                    share = common_subsequence(w, around) / len(w)
                    answered = share >= LIKELY and _stands_in(answers[i], around)
                    if share >= SURE or answered:
                        old = found.get((d, int(i)))
                        best = (share, answered, cosine, at)
                        found[d, int(i)] = best if old is None else (max(old[0], share), old[1] or answered, max(old[2], best[2]), min(old[3], at))
            if found:
                keys, values = list(found), list(found.values())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([ids[d] for d, _ in keys], id_arrow),
                        "item_id": pa.array([item_ids[i] for _, i in keys], pa.int64()),
                        "lcs_share": pa.array([v[0] for v in values], pa.float64()),
                        "answered": pa.array([v[1] for v in values], pa.bool_()),
                        "cosine": pa.array([v[2] for v in values], pa.float64()),
                        "first_word": pa.array([v[3] for v in values], pa.int64()),
                    }
                )

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    leaks = written(spark, rows.mapInArrow(lean(run), f"doc_id {id_type}, {LEAK}"), "leaks")
    remove_written(rows)
    return leaks


LEAK = "item_id bigint, lcs_share double, answered boolean, cosine double, first_word bigint"


def _stands_in(answer: list, words: list) -> bool:
    n = len(answer)
    return bool(n) and any(words[k] == answer[0] and words[k : k + n] == answer for k in range(len(words) - n + 1))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items that have words, in blocks of bounded size; one block is held at a time."""
    block: list[tuple[int, bytes]] = []
    held = 0
    rows = checked_columns(benchmark, "item_id", "text").where("text is not null").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        text = row.text.encode()
        size = len(fold(text))
        if block and size and (len(block) == BLOCK_ITEMS or held + size > BLOCK_WORDS):
            yield block
            block, held = [], 0
        if size:
            block.append((row.item_id, text))
            held += size
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs_share, answered, cosine and first_word for every leak, once a document row and item."""
    docs = checked_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    found = [find_block(docs, block) for block in item_blocks(benchmark)] if not docs.isEmpty() else []
    if not found:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {LEAK}")
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with their own columns; a row is judged by its text, whatever its doc_id."""
    held, restore = sheltered(docs, "doc_id", "text")
    keyed = held.withColumn("row key", row_key())
    leaked = find_leaks(keyed.select(F.col("row key").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("gone")).distinct()
    return restore(keyed.join(leaked, F.col("row key") == F.col("gone"), "left_anti"))


ship_by_value(__name__)
