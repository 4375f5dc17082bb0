"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is cut into blocks of a fixed size; every block is a reference, with
its 13-word windows indexed by position. What a document may share with a
reference is sent there as text and factored greedily: from each place the
longest match among all positions of the index, compared word by word, becomes
a factor of so many words, with its source document and position, and the parse
goes on behind it. The windows across a factor's end are looked up one by one.
Factors of 13 words or more, and the windows found across their ends, come back
as duplicate spans.

Which reference a window is sent to is settled before, for all blocks at once. A
window's anchor is the smallest hash among its seven 7-word runs; equal windows
have equal anchors, and neighbours mostly share one. Each block reports its
distinct anchors, and learns (a bit each) which of them another document has.
It then reports the windows with such anchors, by hash and smallest doc_id, and
learns for each the block that holds it under the smallest doc_id of all. A run
of windows with the same block is a segment; equal segments from different
blocks are parsed once. A reference that many segments ask for is copied as
often as their size calls for, so no task takes more than its share.

Hashes only choose what is compared: a removed word always lies in a window that
was found word by word. Were two different windows to agree in all 96 bits of
their hashes, the comparison would fail and the run would end with an error
(``RuntimeError``) rather than a wrong result; ``_runs`` takes other factors then.

Defined results: null and empty texts have no words; a document without a doc_id
is neither reduced nor a reference; rows that share a doc_id are the same
document, none smaller than the other; an empty table gives an empty result;
extra columns are ignored. A doc_id that isn't a whole number is a TypeError.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from alertloom.llm.common import checked_columns, ship_by_value

WIDTH = 13
RUN = 7
#: Text of a block and of a packed piece of it, in bytes.
BLOCK_BYTES = 12_000_000
PIECE_BYTES = 400_000
#: The hash range is dealt over as many buckets as there are blocks, up to this number.
MOST_BUCKETS = 65_536
#: Text that a copy of a reference is asked for, in bytes.
ASKED_BYTES = 16_000_000
REPORT = "bucket int, block int, data binary, checks binary, owners binary"
ANSWER = "block int, stage int, bucket int, data binary"
SEGMENT = "source int, digest binary, least bigint, words binary, block int, places binary"
TARGET = "source int, digest binary, block int, places binary"
REQUEST = "source int, digest binary, least bigint, words binary"
FOUND = "source int, digest binary, factors binary"
#: A factor: first word in its segment, words, source doc_id, first word in the source, and 1 if it is a window across a factor's end.
FACTOR = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _runs(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of ``width`` successive word hashes."""
    factors = np.random.default_rng(seed).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(h) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for j, f in enumerate(factors):
        out += h[j : j + n] * f if n > 0 else out
    return _mix(out)


#: Powers of an odd base modulo 2**64, and of its inverse, for hashes of byte runs by differences of prefix sums.
BASE = 0x9E6C63D0876A9A63
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once.
CHUNK_BYTES = 1 << 20
#: The blanks that bytes.split() knows.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts in a row, and the number of words of each text."""
    line = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    blank = BLANK[line]
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((line.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(line)))])
    hashes = (sums[end] - sums[begin]) * _powers(INVERSE, len(line))[begin]
    cuts = np.cumsum([len(t) + 1 for t in texts])
    return _mix(hashes ^ (end - begin).astype(np.uint64)), np.diff(np.searchsorted(begin, np.concatenate([[0], cuts])))


class Block:
    """A block's documents by ascending doc_id, with the hash, anchor and owner of every window."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.rows = unpacked(pieces)
        hashes, sizes, held, size = [], [], [], 0
        for _, text in [*self.rows, (None, None)]:
            if held and (text is None or size + len(text) > CHUNK_BYTES):
                found, counts = word_hashes(held)
                hashes.append(found)
                sizes.append(counts)
                held, size = [], 0
            if text is not None:
                held.append(text)
                size += len(text)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        # A window counts where it lies in one document that has a doc_id.
        named = np.array([i is not None for i, _ in self.rows], bool)
        per = np.where(named, np.maximum(0, self.sizes - WIDTH + 1), 0)
        self.first = np.concatenate([[0], np.cumsum(per)])
        self.doc = np.repeat(np.arange(len(per)), per)
        self.place = (np.cumsum(self.sizes) - self.sizes)[self.doc] + np.arange(len(self.doc)) - self.first[self.doc]
        self.windows = _runs(self.hashes, WIDTH, 1)[self.place]
        self.ids = np.array([i if i is not None else 0 for i, _ in self.rows], np.int64)
        self.owners = self.ids[self.doc]

    def anchors(self) -> np.ndarray:
        low = _runs(self.hashes, RUN, 2)
        least = low.copy()
        for j in range(1, WIDTH - RUN + 1):
            np.minimum(least[: len(low) - j], low[j:], out=least[: len(low) - j])
        return _mix(least[self.place])

    def distinct_anchors(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchors, and whether two documents of the block have it."""
        change = np.ones(len(anchors), bool)
        change[1:] = (anchors[1:] != anchors[:-1]) | (self.owners[1:] != self.owners[:-1])
        values, owners = anchors[change], self.owners[change]
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        if not len(values):
            return values, np.zeros(0, bool)
        start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        last = np.append(start[1:], len(values)) - 1
        return values[start], owners[start] != owners[last]

    def distinct_windows(self, answers: pa.Table, buckets: int) -> tuple[np.ndarray, ...]:
        """For the windows whose anchor another document has: their places, the number of each among the distinct ones; of these, by hash, both hashes and the smallest owner."""
        anchors = self.anchors()
        distinct, _ = self.distinct_anchors(anchors)
        places = np.flatnonzero(_in_sorted(anchors, distinct[_answered(answers, 1, distinct, buckets).astype(bool)]))
        values, checks = self.windows[places], (_runs(self.hashes, WIDTH, 3)[self.place[places]] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((checks, values))
        values, checks = values[order], checks[order]
        new = np.ones(len(order), bool)
        new[1:] = (values[1:] != values[:-1]) | (checks[1:] != checks[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        # Documents ascend and the sort is stable: the first of equals has the smallest owner.
        return places, number, values[new], checks[new], self.owners[places[order[new]]]


def unpacked(pieces: list[bytes]) -> list[tuple]:
    """(doc_id, text) rows of a block, in the same order whatever the order of its pieces."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    rows = [row for p in pieces for row in pickle.loads(unpack(p))]  # noqa: S301 - written by pack_blocks
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _edges(values: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket begins in sorted hashes; buckets are equal ranges of the hash."""
    cuts = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return [0, *np.searchsorted(values, cuts, side="left").tolist(), len(values)]


def _short(values: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """32 bits of a bucket's hashes: enough for anchors, which only choose what is looked at."""
    low, high = (bucket << 64) // buckets, (bucket + 1 << 64) // buckets
    return ((values - np.uint64(low)) // np.uint64((high - low >> 32) + 1)).astype(np.uint32)


def _report(block: int, buckets: int, values: np.ndarray, owners: np.ndarray, checks: np.ndarray | None = None) -> pa.Table:
    edges = _edges(values, buckets)
    used = [b for b in range(buckets) if edges[b] < edges[b + 1]]
    part = lambda x, b: x[edges[b] : edges[b + 1]]
    return pa.table(
        {
            "bucket": pa.array(used, pa.int32()),
            "block": pa.array([block] * len(used), pa.int32()),
            "data": pa.array([(part(values, b) if checks is not None else _short(part(values, b), b, buckets)).tobytes() for b in used], pa.binary()),
            "checks": pa.array([part(checks, b).tobytes() if checks is not None else None for b in used], pa.binary()),
            "owners": pa.array([part(owners, b).tobytes() for b in used], pa.binary()),
        }
    )


def _answered(answers: pa.Table, stage: int, values: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of one stage, put together in the order of the (sorted) values reported."""
    edges, out = _edges(values, buckets), np.zeros(len(values), np.int32)
    for s, bucket, data in zip(*(answers.column(c).to_pylist() for c in ("stage", "bucket", "data")), strict=True):
        if s == stage:
            low, high = edges[bucket], edges[bucket + 1]
            out[low:high] = np.unpackbits(np.frombuffer(data, np.uint8), count=high - low) if stage == 1 else np.frombuffer(data, np.int32)
    return out


def _answers(key: tuple, table: pa.Table, stage: int, data: list[np.ndarray]) -> pa.Table:
    n = table.num_rows
    return pa.table(
        {
            "block": table.column("block").cast(pa.int32()),
            "stage": pa.array([stage] * n, pa.int32()),
            "bucket": pa.array([key[0].as_py()] * n, pa.int32()),
            "data": pa.array([x.tobytes() for x in data], pa.binary()),
        }
    )


def pack_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, piece): the documents, compressed and dealt evenly over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        turn, rows, size = TaskContext.get().partitionId() * 7919, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal turn, size
            turn += 1
            out = pa.RecordBatch.from_pydict({"block": pa.array([turn % blocks], pa.int32()), "piece": pa.array([pack(pickle.dumps(rows))], pa.binary())})
            rows.clear()
            size = 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                rows.append((doc_id, text.as_py() or b""))
                size += len(rows[-1][1]) + 16
                if size >= PIECE_BYTES:
                    yield flush()
        if rows:
            yield flush()

    return docs.mapInArrow(run, "block int, piece binary")


def report_anchors(packed: DataFrame, buckets: int) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table.column("piece").to_pylist())
        values, shared = block.distinct_anchors(block.anchors())
        return _report(key[0].as_py(), buckets, values, np.uint8(shared))

    return packed.groupBy("block").applyInArrow(run, REPORT)


def answer_anchors(reports: DataFrame) -> DataFrame:
    """A bit for each anchor reported: whether two documents have it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        data = [np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]
        flags = [np.frombuffer(x, np.uint8) for x in table.column("owners").to_pylist()]
        # Two anchors of one block that agree in 32 bits count as shared, which only means that more is looked at.
        every = np.sort(np.concatenate([*data, *[d[f > 0] for d, f in zip(data, flags, strict=True)]]))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        return _answers(key, table, 1, [np.packbits(_in_sorted(d, shared)) for d in data])

    return reports.groupBy("bucket").applyInArrow(run, ANSWER)


def report_windows(packed: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, values, checks, owners = Block(left.column("piece").to_pylist()).distinct_windows(right, buckets)
        return _report(key[0].as_py(), buckets, values, owners, checks)

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, REPORT)


def answer_windows(reports: DataFrame) -> DataFrame:
    """For each window reported the block that holds it under the smallest doc_id of all; -1 where none is smaller."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        data, checks, owners = [
            [np.frombuffer(x, kind) for x in table.column(name).to_pylist()] for name, kind in (("data", np.uint64), ("checks", np.uint32), ("owners", np.int64))
        ]
        sizes = [len(d) for d in data]
        block = np.repeat(table.column("block").to_numpy().astype(np.int32), sizes)
        value, check, owner = np.concatenate(data), np.concatenate(checks), np.concatenate(owners)
        order = np.lexsort((owner, check, value))
        new = np.ones(len(order), bool)
        new[1:] = (value[order][1:] != value[order][:-1]) | (check[order][1:] != check[order][:-1])
        head = order[new][np.cumsum(new) - 1]
        source = np.empty(len(order), np.int32)
        source[order] = np.where(owner[head] < owner[order], block[head], -1)
        return _answers(key, table, 2, np.split(source, np.cumsum(sizes)[:-1]))

    return reports.groupBy("bucket").applyInArrow(run, ANSWER)


def find_segments(packed: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Runs of windows that one reference holds under a smaller doc_id: once a block, with the smallest doc_id and all places (row, word)."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        number, block = key[0].as_py(), Block(left.column("piece").to_pylist())
        places, at, values, _, owners = block.distinct_windows(right, buckets)
        elsewhere = _answered(right, 2, values, buckets)[at]
        route = np.full(len(block.windows), -1, np.int32)
        route[places] = np.where(elsewhere >= 0, elsewhere, np.where(owners[at] < block.owners[places], number, -1))
        held: dict[tuple[int, bytes], tuple] = {}
        for k in np.unique(block.doc[route >= 0]).tolist():
            doc_id, text = block.rows[k]
            own = route[block.first[k] : block.first[k + 1]]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            words = text.split()
            for low, high, source in zip(cuts[:-1], cuts[1:], own[cuts[:-1]].tolist(), strict=True):
                if source >= 0:
                    line = b" ".join(words[low : high + WIDTH - 1])
                    # Documents ascend: the first has the smallest doc_id.
                    held.setdefault((source, hashlib.sha256(line).digest()), (doc_id, line, []))[2].extend((k, low))
        return pa.table(
            {
                "source": pa.array([s for s, _ in held], pa.int32()),
                "digest": pa.array([d for _, d in held], pa.binary()),
                "least": pa.array([x[0] for x in held.values()], pa.int64()),
                "words": pa.array([x[1] for x in held.values()], pa.binary()),
                "block": pa.array([number] * len(held), pa.int32()),
                "places": pa.array([np.array(x[2], np.int32).tobytes() for x in held.values()], pa.binary()),
            }
        )

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SEGMENT)


def distinct_requests(segments: DataFrame) -> DataFrame:
    """One of equal segments, with the smallest doc_id; ``segments`` are sorted within partitions, equal ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for pair in zip(batch.column("source").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                keep.append(pair != last)
                last = pair
            yield batch.select(["source", "digest", "least", "words"]).filter(pa.array(keep, pa.bool_()))

    return segments.mapInArrow(run, REQUEST)


def targets(segments: DataFrame) -> DataFrame:
    """Where segments stand. In Arrow like ``distinct_requests``, so both read one exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["source", "digest", "block", "places"])

    return segments.mapInArrow(run, TARGET)


class Reference:
    """A block indexed by position, that factors segments."""

    def __init__(self, block: Block, wanted: np.ndarray) -> None:
        self.block = block
        places = np.flatnonzero(_in_sorted(block.windows, np.unique(wanted)))
        #: Window numbers by hash, then by position.
        self.places = places[np.argsort(block.windows[places], kind="stable")]
        self.keys = block.windows[self.places]
        self.texts: dict[int, list[bytes]] = {}

    def words(self, k: int) -> list[bytes]:
        found = self.texts.get(k)
        if found is None:
            found = self.texts[k] = self.block.rows[k][1].split()
        return found

    def longest(self, windows: np.ndarray, at: int, words: list[bytes], limit: int, most: int) -> tuple[int, int] | None:
        """Window number of the longest match that starts at a window, below ``limit``, and its number of windows (``most`` at most)."""
        low, high = np.searchsorted(self.keys, windows[at], side="left"), np.searchsorted(self.keys, windows[at], side="right")
        some = self.places[low:high]
        some = some[: np.searchsorted(some, limit)]
        best = None
        for j, n in self._by_length(some, windows, at, most):
            k = int(self.block.doc[j])
            begin = j - int(self.block.first[k])
            # The hashes agree; the words decide.
            one, other = self.words(k)[begin : begin + n + WIDTH - 1], words[at : at + n + WIDTH - 1]
            if one == other:
                true = n
            else:
                true = next(i for i, (x, y) in enumerate(zip(one, other, strict=True)) if x != y) - WIDTH + 1
            if true > 0 and (best is None or true > best[1]):
                best = (j, true)
            if true == n:
                break
        return best

    def _by_length(self, some: np.ndarray, windows: np.ndarray, at: int, most: int) -> Iterator[tuple[int, int]]:
        """Candidates and their number of matching windows by hash, longest first, of equals the first."""
        if not len(some):
            return
        known, ends = self.block.windows, self.block.first[self.block.doc[some] + 1]
        left, n, step, dropped = some, 1, WIDTH, []
        while n < most:
            # Windows WIDTH apart have all words in between, so steps of that many lose nothing; the last ones are single.
            step = min(step, most - n)
            going = left + n + step - 1 < ends
            going[going] = known[left[going] + n + step - 1] == windows[at + n + step - 1]
            if going.any():
                if not going.all():
                    dropped.append((left[~going], n))
                left, ends, n = left[going], ends[going], n + step
            elif step > 1:
                step = 1
            else:
                break
        for j in left.tolist():
            yield j, n
        # Those left behind reach less far; they count only where no longer match holds by its words.
        for group, least in reversed(dropped):
            for j in group.tolist():
                yield j, least

    def factor(self, words: list[bytes], windows: np.ndarray, least: int) -> list[tuple[int, ...]]:
        """The greedy parse of a segment relative to the documents before ``least``."""
        block, out, at, n = self.block, [], 0, len(windows)
        limit = int(block.first[np.searchsorted(block.ids[: int(block.doc[-1]) + 1], least)])

        def span(w: int, most: int, across: int) -> int:
            match = self.longest(windows, w, words, limit, most)
            if match is None:
                raise RuntimeError("different windows share a hash: choose other factors in _runs")
            k = int(block.doc[match[0]])
            out.append((w, match[1] + WIDTH - 1, int(block.ids[k]), match[0] - int(block.first[k]), across))
            return match[1]

        while at < n:
            end = at + span(at, n - at, 0)
            for w in range(end, min(end + WIDTH - 1, n)):
                span(w, 1, 1)
            at = end + WIDTH - 1
        return out


def factor_segments(packed: DataFrame, requests: DataFrame, *by: str) -> DataFrame:
    """The factors of each request; ``packed`` and ``requests`` meet by reference (and its copy)."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[bytes] = []
        if right.num_rows:
            lines = right.column("words").to_pylist()
            hashes, counts = [], []
            for k in range(0, len(lines), 1_000):
                h, c = word_hashes(lines[k : k + 1_000])
                hashes.append(h)
                counts.append(c)
            windows = _runs(np.concatenate(hashes), WIDTH, 1)
            ends = np.cumsum(np.concatenate(counts))
            starts = np.append(0, ends[:-1])
            reference = Reference(Block(left.column("piece").to_pylist()), windows)
            for line, least, low, high in zip(lines, right.column("least").to_pylist(), starts.tolist(), ends.tolist(), strict=True):
                found.append(np.array(reference.factor(line.split(), windows[low : high - WIDTH + 1], least), np.int64).tobytes())
        return pa.table({"source": right.column("source").cast(pa.int32()), "digest": right.column("digest"), "factors": pa.array(found, pa.binary())})

    return packed.groupBy("block", *by).cogroup(requests.groupBy("source", *by)).applyInArrow(run, FOUND)


def find_factors(packed: DataFrame, segments: DataFrame) -> DataFrame:
    """(block, places, factors): a block's segments and their factors."""
    sorted_segments = segments.repartition("source", "digest").sortWithinPartitions("source", "digest", "least")
    requests = distinct_requests(sorted_segments)
    asked = requests.groupBy("source").agg(F.sum(F.octet_length("words") + 64).alias("size"))
    hot = asked.where(F.col("size") > ASKED_BYTES).select(F.col("source").alias("at"), F.ceil(F.col("size") / ASKED_BYTES).cast("int").alias("parts"))
    dealt = requests.join(hot, F.col("source") == F.col("at"), "left")
    cool = dealt.where("at is null").select(*requests.columns)
    part = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part")
    warm = dealt.where("at is not null").select(*requests.columns, part)
    copies = packed.join(hot, F.col("block") == F.col("at")).select("block", "piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = factor_segments(packed, cool).unionByName(factor_segments(copies, warm, "part"))
    found = found.select(F.col("source").alias("of"), F.col("digest").alias("like"), "factors")
    places = targets(sorted_segments)
    return places.join(found, (F.col("source") == F.col("of")) & (F.col("digest") == F.col("like"))).select("block", "places", "factors")


def reduce_documents(packed: DataFrame, factors: DataFrame, id_type: str, whole: bool) -> DataFrame:
    """The documents without the words of their factors."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[int, list[np.ndarray]] = {}
        for places, found in zip(right.column("places").to_pylist(), right.column("factors").to_pylist(), strict=True):
            found = np.frombuffer(found, np.int64).reshape(-1, FACTOR)
            for k, at in np.frombuffer(places, np.int32).reshape(-1, 2).tolist():
                spans.setdefault(k, []).append(found + np.array([at, 0, 0, 0, 0]))
        out: dict[str, list] = {name: [] for name in kinds}
        for k, (doc_id, text) in enumerate(unpacked(left.column("piece").to_pylist())):
            words = text.split()
            kept, n_kept, n_factors, own = words, len(words), 0, None
            if k in spans:
                own = np.concatenate(spans[k])
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, own[:, 0], 1)
                np.add.at(cover, own[:, 0] + own[:, 1], -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept, n_kept, n_factors = list(compress(words, keep.tolist())), int(keep.sum()), int((own[:, 4] == 0).sum())
            line = b" ".join(kept)
            values = [doc_id, len(words), len(words) - n_kept, n_factors, hashlib.sha256(line).hexdigest()]
            if whole:
                rows = [] if own is None else own[np.lexsort(own.T[::-1])]
                values += [line.decode(), [dict(zip(FACTOR_NAMES, map(int, row[:4]), strict=True)) for row in rows if not row[4]]]
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return pa.table({name: pa.array(v, kinds[name]) for name, v in out.items()})

    arrow_id = to_arrow_type(packed.sparkSession.range(0).select(F.lit(None).cast(id_type).alias("x")).schema["x"].dataType)
    kinds = {"doc_id": arrow_id, "n_words": pa.int64(), "n_removed": pa.int64(), "n_factors": pa.int64(), "kept_sha256": pa.string()}
    schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, n_factors bigint, kept_sha256 string"
    if whole:
        kinds |= {"kept": pa.string(), "factors": pa.list_(pa.struct([(name, pa.int64()) for name in FACTOR_NAMES]))}
        schema += f", kept string, factors array<struct<{', '.join(f'{name}: bigint' for name in FACTOR_NAMES)}>>"
    return packed.groupBy("block").cogroup(factors.groupBy("block")).applyInArrow(run, schema)


FACTOR_NAMES = ("first_word", "n_words", "source_id", "source_word")


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors and kept_sha256 for every row.

    With ``keep_text`` also kept, the remaining text, and factors: for each its
    first word, words, source document and first word there. How passages divide
    into factors depends on how documents fall into blocks; what is removed doesn't.
    """
    docs = checked_columns(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType
    if id_type.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"doc_id must be a whole number, not {id_type.simpleString()}")
    size = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    buckets = min(blocks, MOST_BUCKETS)
    packed = pack_blocks(docs, blocks)
    shared = answer_anchors(report_anchors(packed, buckets))
    held = answer_windows(report_windows(packed, shared, buckets))
    factors = find_factors(packed, find_segments(packed, shared.unionByName(held), buckets))
    return reduce_documents(packed, factors, id_type.simpleString(), keep_text)


ship_by_value(__name__)
