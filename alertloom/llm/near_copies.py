"""Near copies by SimHash over the Gray-order index, then by the exact Jaccard similarity of their shingles.

A text is the set of its ``WIDTH``-word shingles' 64-bit hashes. All that a
similarity of ``SIMILAR`` or more between two texts joins comes out as one
component; nothing is estimated.

First fingerprints of the sets are searched in ``simhash_gray``'s index: sets of one
fingerprint, and those that it links, are compared. Few similar sets are as close as
its masks can tell (two bits), so an exact way for the rest follows. Each set is
compared with a few others of its kind: under each of ``BANDS``
least hashes, with one that stands for all that have it. That joins most of a
group of near copies at a cost in proportion to its size. Then sets are met in
full: they are sorted in one order for all (common shingles last, the others by
hash), and as two similar sets share a shingle among the first fifth of each
(and one more), they meet under those only. The first shingle that they share
must leave enough behind it in both, which rules most meetings out; pairs that
are joined already are passed over. Under a shingle of few sets the pairs are
put down and their signatures compared (the parity of each slot of a fixed number
that shingles fall into: sets differ in at least as many shingles as signatures
in bits); under one of many sets the signatures are fetched first, so only pairs
that pass are put down. What is left is compared set by set. Fingerprints, order, hubs and
signatures decide how many sets are compared, never which components are found.

Defined results: a null or empty text has an empty set, and empty sets are alike;
a text of fewer words is one shingle; rows that repeat share their component; a
null doc_id never names a component unless all its members' ids are null; extra
columns are ignored, and kept under any name by ``drop_near_copies``, which
decides by row: ids that repeat with other texts are other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import checked_columns, lean, remove_written, row_key, ship_by_value, written
from alertloom.llm.graph import connected_components
from alertloom.llm.simhash_gray import CHUNK, bit_counts, first_row, gray_links, keep_first, majority, name_components

WIDTH = 5
#: Least similarity, as a fraction; the bounds below are in whole numbers.
SIMILAR = (4, 5)
#: A shingle that leads more sets than this is common, and goes to the end of the order.
COMMON, MOST_COMMON, ROUNDS = 8, 1 << 18, 1
#: Bits of a signature.
SLOTS = 1024
#: Least hashes under which sets are first compared.
BANDS = 8
MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Slots of a table of wanted sets, at most; set_ids that a worker remembers.
WANTED, SEEN = 1 << 24, 200_000
#: Sets under a shingle, from which on signatures are fetched before pairs are put down.
MANY = 16
#: Pairs whose signatures are compared at once.
SIGNED = 20_000
#: Cells of a node's table of pairs that are looked at together.
CELLS = 200_000
#: Rows whose sets are held together by a worker.
ROWS = 512


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: max(1, len(words) - width + 1)].tolist()
    ends = (ends - 1)[min(width, len(words)) - 1 :].tolist()
    hash64 = xxhash.xxh64_intdigest
    return np.unique(np.array([hash64(line[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            yield batch.slice(k, ROWS)


def signature(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each slot."""
    slots = np.bincount((shingles % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    return np.packbits((slots & 1).astype(np.uint8)).tobytes()


def set_fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set; zero for an empty one."""
    counts = sum(bit_counts(shingles[k : k + CHUNK]) for k in range(0, max(1, len(shingles)), CHUNK))
    return majority(counts, len(shingles))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least shingle under each of ``BANDS`` orders; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    return np.array([(shingles * m).min() for m in MULTIPLIERS], np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, key, set_id, n, fp, signature, least, shingles) for every row; equal sets have equal set_ids."""
    docs = checked_columns(docs, "doc_id", "text").select("doc_id", "text", row_key().alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in _sliced(batches):
            sets = [shingle_set(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())]
            signs = [signature(s) for s in sets]
            held = [s.tobytes() for s in sets]
            ids = np.array([xxhash.xxh64_intdigest(s) for s in held], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "key": batch.column("key"),
                    "set_id": pa.array(ids),
                    "n": pa.array([len(s) for s in sets], pa.int32()),
                    "fp": pa.array(np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)),
                    "signature": pa.array(signs, pa.binary()),
                    "least": pa.array([least_hashes(s) for s in sets], pa.list_(pa.int64())),
                    "shingles": pa.array(held, pa.binary()),
                }
            )

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, set_id bigint, n int, fp bigint, signature binary, least array<bigint>, shingles binary")


def leading(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(set_id, n, head): for each set the shingles under which it meets others, copies left out as far as a worker remembers.

    ``common`` runs from rare to frequent.
    """
    order = np.argsort(common)
    shared = sets.sparkSession.sparkContext.broadcast((common[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = shared.value
        seen: set[int] = set()
        for batch in _sliced(batches):
            fresh = []
            for set_id in batch.column("set_id").to_pylist():
                fresh.append(set_id not in seen)
                seen.add(set_id)
            if len(seen) > SEEN:
                seen.clear()
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            sizes, heads = [], []
            for x in batch.column("shingles"):
                s = np.frombuffer(x.as_py(), np.uint64)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, level[at], 0), kind="stable")]
                sizes.append(len(s))
                heads.append(s[: len(s) - -(-len(s) * SIMILAR[0] // SIMILAR[1]) + 1].view(np.int64).copy())
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, heads)]).astype(np.int32), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_pydict({"set_id": batch.column("set_id"), "n": pa.array(sizes, pa.int32()), "head": lists})

    return sets.select("set_id", "shingles").mapInArrow(lean(run), "set_id bigint, n int, head array<bigint>")


def common_shingles(sets: DataFrame) -> np.ndarray:
    """Shingles that lead many sets, from rare to frequent; at most ``MOST_COMMON`` a round reach the driver."""
    found: dict[int, int] = {}
    for _ in range(ROUNDS):
        now = np.array(sorted(found, key=lambda s: (found[s], s)), np.int64).view(np.uint64)
        counts = leading(sets, now).select(F.explode("head").alias("shingle")).groupBy("shingle").count().where(F.col("count") > COMMON)
        most = counts.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
        new = dict(zip(most["shingle"].to_pylist(), most["count"].to_pylist(), strict=True))
        if not new.keys() - found.keys():
            break
        found = new | found
    return np.array(sorted(found, key=lambda s: (found[s], s)), np.int64).view(np.uint64)


def alike(size: np.ndarray, place: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs under one shingle, sets in order of size, that may be similar if this is the first shingle they share; none of one label."""
    num, den = SIMILAR
    last = np.searchsorted(size * num, size * den, side="right")
    i = 0
    while i < len(size):
        wide = max(1, int(last[i]) - i)
        upto = min(len(size), i + max(1, CELLS // wide))
        while upto > i + 1 and (upto - i) * (int(last[upto - 1]) - i) > 4 * CELLS:
            upto = i + (upto - i) // 2
        a, b = np.arange(i, upto)[:, None], np.arange(i, int(last[upto - 1]))[None, :]
        most = np.minimum(size[a] - place[a], size[b] - place[b])
        x, y = np.nonzero((b > a) & (label[a] != label[b]) & (size[b] * num <= size[a] * den) & (most * (num + den) >= num * (size[a] + size[b])))
        if len(x):
            yield x + i, y + i
        i = upto


def meetings(heads: DataFrame) -> DataFrame:
    """Pairs (a, b) of set_ids that meet under a shingle of few sets; for one of many, each set (a) with shingle, n, place and label.

    ``heads``: shingle, n, set_id, place, label.
    """
    dealt = heads.select("shingle", "n", "set_id", "place", "label").repartition("shingle").sortWithinPartitions("shingle", "n", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        many = None
        for batch in _and_end(batches):
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
            if not kept or not len(kept[0]):
                continue
            once = np.append(True, (kept[0][1:] != kept[0][:-1]) | (kept[2][1:] != kept[2][:-1]))
            kept = [x[once] for x in kept]
            edges = np.flatnonzero(np.append(True, kept[0][1:] != kept[0][:-1]))
            ends = np.append(edges[1:], len(kept[0]))
            # The last shingle's sets may go on in the next batch: they wait, unless they are many already.
            waits = batch is not None and kept[0][-1] != many and ends[-1] - edges[-1] <= MANY
            done = int(edges[-1]) if waits else len(kept[0])
            wide = ends - edges > MANY
            if many is not None:
                wide |= kept[0][edges] == many
            many = int(kept[0][-1]) if wide[-1] and not waits else None
            shingle, size, ids, place, label = [x[:done] for x in kept]
            kept = [x[done:] for x in kept]
            few = [np.zeros((2, 0), np.int64)]
            for at, end in zip(edges[~wide].tolist(), ends[~wide].tolist(), strict=True):
                if end <= done and end - at > 1:
                    for x, y in alike(size[at:end], place[at:end], label[at:end]):
                        few.append(np.stack([ids[at + x], ids[at + y]]))
            pairs = _pairs(np.concatenate(few, axis=1))
            rows = np.repeat(wide, ends - edges)[:done]
            empty, null = pa.nulls(len(pairs[0]), pa.int64()), pa.nulls(int(rows.sum()), pa.int64())
            both = [[pa.array(pairs[0]), pa.array(pairs[1]), empty, empty, empty, empty], [pa.array(ids[rows]), null, *[pa.array(x[rows]) for x in (shingle, size, place, label)]]]
            for columns in both:
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shingle", "n", "place", "label"])

    return dealt.mapInArrow(lean(run), "a bigint, b bigint, shingle bigint, n bigint, place bigint, label bigint")


def signed_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) under shingles of many sets whose signatures allow the similarity; ``rows``: shingle, n, set_id, place, label, signature."""
    dealt = rows.select("shingle", "n", "set_id", "place", "label", "signature").repartition("shingle").sortWithinPartitions("shingle", "n")
    num, den = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in _and_end(batches):
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
                new.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(len(batch), SLOTS // 64))
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
            if not kept or not len(kept[0]):
                continue
            edges = np.flatnonzero(np.append(True, kept[0][1:] != kept[0][:-1]))
            ends = np.append(edges[1:], len(kept[0]))
            done = len(kept[0]) if batch is None else int(edges[-1])
            _, size, ids, place, label, signs = [x[:done] for x in kept]
            kept = [x[done:] for x in kept]
            for at, end in zip(edges.tolist(), ends.tolist(), strict=True):
                if end > done:
                    continue
                found = [np.zeros((2, 0), np.int64)]
                for x, y in alike(size[at:end], place[at:end], label[at:end]):
                    for k in range(0, len(x), SIGNED):
                        i, j = at + x[k : k + SIGNED], at + y[k : k + SIGNED]
                        apart = np.bitwise_count(signs[i] ^ signs[j]).sum(1, dtype=np.int64)
                        ok = apart * (num + den) <= (size[i] + size[j]) * (den - num)
                        found.append(np.stack([ids[i[ok]], ids[j[ok]]]))
                pairs = _pairs(np.concatenate(found, axis=1))
                if len(pairs[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return dealt.mapInArrow(lean(run), "a bigint, b bigint")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _pairs(found: np.ndarray) -> np.ndarray:
    return np.unique(np.sort(found, axis=0), axis=1)


def with_both(pairs: DataFrame, sets: DataFrame, *names: str) -> DataFrame:
    """Pairs (a, b) with the named columns of both sets, as name_a and name_b."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set_id").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in names]), side)
    return pairs.select("a", "b", *[f"{x}_{side}" for x in names for side in ("a", "b")])


def close_signatures(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule the similarity out."""
    num, den = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = [np.frombuffer(b"".join(batch.column(f"signature_{x}").to_pylist()), np.uint64).reshape(len(batch), SLOTS // 64) for x in "ab"]
            sizes = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            apart = np.bitwise_count(one ^ other).sum(1, dtype=np.int64)
            yield batch.filter(pa.array(apart * (num + den) <= sizes * (den - num))).select(["a", "b"])

    light = sets.select("set_id", "n", "signature").dropDuplicates(["set_id"])
    return with_both(pairs, light, "n", "signature").mapInArrow(lean(run), "a bigint, b bigint")


def wanted_sets(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, shingles) of the wanted sets. A table of bounded size leaves most others out before any exchange."""
    slots = min(WANTED, 1 << max(10, (8 * wanted.count()).bit_length()))
    marked = np.zeros(slots, bool)
    marked[wanted.select(F.pmod("wanted", F.lit(slots)).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    shared = sets.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in _sliced(batches):
            ids = batch.column("set_id").to_numpy()
            yield batch.filter(pa.array(bits[np.mod(ids, slots)]))

    some = sets.select("set_id", "shingles").mapInArrow(lean(run), "set_id bigint, shingles binary")
    return some.join(wanted, F.col("set_id") == F.col("wanted"), "left_semi")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, compared in full; stored."""
    spark = sets.sparkSession
    pairs = written(spark, pairs.distinct(), "candidates")
    held = wanted_sets(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), sets).dropDuplicates(["set_id"])
    held = written(spark, held, "candidate-sets")
    num, den = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            keep = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * den >= num * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    links = written(spark, with_both(pairs, held, "shingles").mapInArrow(lean(run), "a bigint, b bigint"), "links")
    remove_written(pairs, held)
    return links


def gray_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints the Gray-order index links, or are equal: one set stands for each fingerprint."""
    prints = sets.select("set_id", "fp").dropDuplicates(["set_id"])
    hubs = prints.groupBy("fp").agg(F.min("set_id").alias("hub"))
    side = lambda name: hubs.select(F.col("fp").alias(name), F.col("hub").alias(f"of_{name}"))
    equal = prints.join(side("at"), F.col("fp") == F.col("at")).select(F.col("of_at").alias("x"), F.col("set_id").alias("y")).where("x <> y")
    linked = gray_links(hubs.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.col("of_a").alias("x"), F.col("of_b").alias("y"))
    return equal.unionByName(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def hub_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set with one that stands for all that share a least hash."""
    keys = sets.select("set_id", "least").dropDuplicates(["set_id"]).select("set_id", F.posexplode("least").alias("band", "key"))
    hubs = keys.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("set_id", "band").alias("h"), "set_id"))["set_id"].alias("hub"), F.count("*").alias("c")).where("c > 1")
    met = keys.join(hubs.select(F.col("band").alias("b__"), F.col("key").alias("k__"), "hub"), (F.col("band") == F.col("b__")) & (F.col("key") == F.col("k__"))).where("set_id <> hub")
    return met.select(F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")).distinct()


def similar_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all set_ids whose sets are similar, as far as similarities reach."""
    spark = sets.sparkSession
    first = similar(close_signatures(gray_pairs(sets).unionByName(hub_pairs(sets)).distinct(), sets), sets)
    joined = written(spark, connected_components(first), "joined")
    remove_written(first)
    heads = leading(sets, common_shingles(sets)).join(joined, F.col("set_id") == F.col("vertex"), "left")
    heads = heads.select("set_id", "n", F.coalesce("component", "set_id").alias("label"), F.posexplode("head").alias("place", "shingle"))
    met = written(spark, meetings(heads), "meetings")
    signatures = sets.select(F.col("set_id").alias("of"), "signature").dropDuplicates(["of"])
    many = met.where("b is null").join(signatures, F.col("a") == F.col("of")).withColumnRenamed("a", "set_id")
    few = close_signatures(met.where("b is not null").select("a", "b").distinct(), sets)
    second = similar(few.unionByName(signed_pairs(many)), sets)
    remove_written(met)
    return second.unionByName(joined.select(F.col("vertex").alias("a"), F.col("component").alias("b")))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, component_id, first) for every row of ``docs``; first: the key of the component's first row. Also the stored sets that it reads."""
    sets = written(docs.sparkSession, shingle_sets(docs), "shingle-sets")
    labels = connected_components(similar_links(sets))
    distinct = sets.groupBy("set_id").agg(F.min("doc_id").alias("least"), first_row().alias("first"))
    by_set = name_components(distinct, labels, "set_id")
    return sets.select("doc_id", "key", "set_id").join(by_set, F.col("set_id") == F.col("of")).select("doc_id", "key", "component_id", "first"), sets


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``."""
    return _linked(docs)[0].select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Keep one row of each component, as ``keep_first`` says."""
    groups, sets = _linked(docs)
    losers = written(docs.sparkSession, groups.select("key", "first").where("key <> first"), "copies")
    remove_written(sets)
    return keep_first(docs, losers)


ship_by_value(__name__)
