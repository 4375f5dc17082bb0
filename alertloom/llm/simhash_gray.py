"""SimHash near-duplicates over a Gray-order hierarchical index.

A document's fingerprint has a bit set where more than half of its shingles'
64-bit hashes have it. Distinct fingerprints are cut into six blocks of bits.
Two that differ in at most two bits agree on four of the blocks, so they meet
under one of 15 masks; a mask's shared pattern is the index's upper node, and
what remains under it is 22 bits at most, which bounds a node at 2**22
fingerprints whatever the corpus. Below, fingerprints lie in Gray order, packed
sixteen to a leaf; every node keeps the bits that all below it share, and a
whole pair of nodes is left out once those shared bits alone differ in more
than the allowed number of places. Links found under a node are kept as a
spanning forest, so they never outnumber the fingerprints; components are then
found by star contraction.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; rows that repeat share their component; a null doc_id never names a
component unless all its members' ids are null; an empty table gives an empty
result; extra columns are ignored, and kept under any name by
``drop_near_duplicates``, which decides by row: ids that repeat with other
texts are other rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import checked_columns, lean, row_key, sheltered, ship_by_value, written
from alertloom.llm.graph import connected_components

BITS = 64
#: Widths of the blocks; with all but two of them equal, 22 bits at most are left.
BLOCKS = (11, 11, 11, 11, 10, 10)
MAX_DISTANCE = 2
LEAF = 16
#: Shingles whose bits are unpacked at once.
CHUNK = 16_384


def masks() -> list[int]:
    """The bits on which a table's upper nodes agree, one mask for each choice of two free blocks."""
    blocks, at = [], 0
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [((1 << BITS) - 1) ^ blocks[i] ^ blocks[j] for i, j in combinations(range(len(blocks)), 2)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each bit, the highest first, how many of the hashes have it."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that more than half of ``n`` hashes have."""
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: bytes, width: int, seed: int) -> int:
    """Fingerprint of a text's shingles of ``width`` words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: max(1, len(words) - width + 1)].tolist()
    ends = (ends - 1)[min(width, len(words)) - 1 :].tolist()
    hash64, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), CHUNK):
        counts += bit_counts(np.array([hash64(line[a:b], seed) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], np.uint64))
    return majority(counts, len(starts))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, key, fp): the row's key, and the fingerprint's bits as a signed long."""
    docs = checked_columns(docs, "doc_id", "text").select("doc_id", "text", row_key().alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.array([fingerprint(x.as_py() or b"", width, seed) for x in texts], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "fp": pa.array(found.view(np.int64))})

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, fp bigint")


def gray_rank(fp: Column) -> Column:
    """Position of a bit pattern in Gray order (as a signed long; order within a node is all that counts)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


class GrayNode:
    """Links within one upper node: fingerprints in Gray order under a hierarchy of shared bit patterns."""

    def __init__(self, fps: np.ndarray, distance: int) -> None:
        self.fps, self.distance = fps, distance
        self.parent = np.arange(len(fps))
        low = np.arange(0, len(fps), LEAF)
        #: Levels from leaves up: bits that are one in all, and bits that are zero in all.
        self.levels = [(np.bitwise_and.reduceat(fps, low), np.bitwise_and.reduceat(~fps, low))]
        while len(self.levels[-1][0]) > 1:
            ones, zeros = self.levels[-1]
            low = np.arange(0, len(ones), LEAF)
            self.levels.append((np.bitwise_and.reduceat(ones, low), np.bitwise_and.reduceat(zeros, low)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def links(self) -> Iterator[tuple[int, int]]:
        """Index pairs that join what is not yet joined."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if level < 0:
                continue
            wide = (self.levels[level - 1][0] if level else self.fps)
            left = np.arange(a * LEAF, min(len(wide), (a + 1) * LEAF))
            right = np.arange(b * LEAF, min(len(wide), (b + 1) * LEAF))
            if level:
                ones, zeros = self.levels[level - 1]
                apart = (ones[left, None] & zeros[None, right]) | (zeros[left, None] & ones[None, right])
            else:
                apart = wide[left, None] ^ wide[None, right]
            i, j = np.nonzero(np.bitwise_count(apart) <= self.distance)
            for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
                if level:
                    if x <= y:
                        stack.append((level - 1, x, y))
                elif x < y and (p := self.find(x)) != (q := self.find(y)):
                    self.parent[max(p, q)] = min(p, q)
                    yield x, y


def gray_links(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that join all within ``distance`` bits."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"the masks leave two blocks free: distance must be 0 to {MAX_DISTANCE}")
    signed = [m - (1 << 64) if m >> 63 else m for m in masks()]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("node")) for i, m in enumerate(signed)])
    dealt = fps.select("fp", F.explode(tables).alias("k")).select("k.t", "k.node", "fp", gray_rank(F.col("fp")).alias("gray"))
    dealt = dealt.repartition("t", "node").sortWithinPartitions("t", "node", "gray").select("t", "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in (*batches, None):
            if batch is None:
                t, node, fp = kept or [np.zeros(0, np.int64)] * 3
                done = len(t)
            else:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                t, node, fp = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
                done = int(np.flatnonzero((t != t[-1]) | (node != node[-1]))[-1]) + 1 if len(t) and ((t != t[-1]) | (node != node[-1])).any() else 0
                kept = [t[done:], node[done:], fp[done:]]
            if not done:
                continue
            t, node, fp = t[:done], node[:done], fp[:done].view(np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (node[1:] != node[:-1])]))
            sizes = np.diff(np.append(edges, done))
            found: list[tuple[int, int]] = []
            for at, n in zip(edges[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                if n == 2:
                    if int(fp[at] ^ fp[at + 1]).bit_count() <= distance:
                        found.append((at, at + 1))
                else:
                    found += [(at + i, at + j) for i, j in GrayNode(fp[at : at + n], distance).links()]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            both = fp.view(np.int64)[pairs]
            yield pa.RecordBatch.from_pydict({"a": pa.array(both.min(1)), "b": pa.array(both.max(1))})

    return dealt.mapInArrow(lean(run), "a bigint, b bigint").distinct()


def first_row() -> Column:
    """Aggregate: doc_id and key of the row that stands for a group."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))


def _linked(docs: DataFrame, width: int, seed: int, distance: int) -> DataFrame:
    """(doc_id, key, fp, component_id, first) for every row of ``docs``; first: the key of the component's first row."""
    spark = docs.sparkSession
    prints = written(spark, fingerprints(docs, width, seed), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), first_row().alias("first"))
    labels = connected_components(gray_links(distinct, distance))
    return prints.join(name_components(distinct, labels, "fp"), F.col("fp") == F.col("of")).drop("of")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    return _linked(docs, width, seed, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def name_components(distinct: DataFrame, labels: DataFrame, vertex: str) -> DataFrame:
    """(of, component_id, first) for every vertex of ``distinct`` (vertex, least, first)."""
    named = distinct.join(labels, F.col(vertex) == F.col("vertex"), "left").select(F.col(vertex).alias("of"), "least", "first", F.coalesce("component", vertex).alias("root"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first")["key"].alias("first_key")).withColumnRenamed("root", "at")
    return named.join(whole, F.col("root") == F.col("at")).select("of", "component_id", F.col("first_key").alias("first"))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Keep the first row of each component, given as (key, first) with keys as ``row_key`` makes them.

    That is the row of the smallest doc_id, one without doc_id only where none has
    any; of several with that id the one of the smallest key; of rows that share
    doc_id and text, one. Columns and their names stay as they are.
    """
    losers = groups.where(F.col("key") != F.col("first")).select(F.col("key").alias("gone")).distinct()
    held, restore = sheltered(docs, "doc_id", "text")
    kept = held.withColumn("row key", row_key()).join(losers, F.col("row key") == F.col("gone"), "left_anti")
    return restore(kept.dropDuplicates(["row key"]))


def drop_near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, distance: int = MAX_DISTANCE) -> DataFrame:
    """Keep one row of each component, as ``keep_first`` says."""
    return keep_first(docs, _linked(docs, width, seed, distance))


ship_by_value(__name__)
