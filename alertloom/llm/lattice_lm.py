"""Subword lattice language model: marginal probability over all segmentations.

A text is its words and then one end. Each word, behind its mark, is a path
through the lattice of vocabulary pieces; pieces never cross a word's start, so
a text's marginal probability is the product over its words. A forward
recursion in log space sums over all segmentations of a word, once per distinct
word. Pieces and their first scores come from an existing vocabulary; passes
of expectation over the training documents' words (forward and backward
counts, all of them) and the end symbol's share turn them into the model's
scores. Probabilities of all pieces and the end sum to one, so the texts'
probabilities do too.

Words are counted per partition before any exchange. Documents get their
words' values in two ways: the ``HOT_WORDS`` most frequent words (a fixed
bound) are broadcast; the rest is joined by word. A frequent word therefore
never meets in one task.

Defined results: null text counts as empty and is just an end; a null doc_id
is hashed as the empty text; repeated rows are scored alike; an empty table
gives an empty result, and where no row is for training, counts are zero and
the vocabulary's own scores stay; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import checked_columns, remove_written, ship_by_value, written
from alertloom.llm.unigram_vocab import MARK, Lattice, prior

HOT_WORDS = 65_536
HELD_OUT = (7, 2)
#: Weight of the vocabulary's own scores, in pieces, against the counts.
PRIOR_PIECES = 2_000.0
#: Rounds of expected counts over all training words.
PASSES = 2
#: Distinct words and bytes of text that a worker counts before it hands them on.
COUNTED, COUNTED_BYTES = 300_000, 64 << 20
#: Places of a word whose pieces are listed at once.
ARC_STARTS = 4_096
PART = 512


def is_training(doc_id: object) -> bool:
    """Documents are held out where crc32 of the doc_id as text, modulo 7, is 2."""
    text = "" if doc_id is None else str(doc_id)
    return zlib.crc32(text.encode()) % HELD_OUT[0] != HELD_OUT[1]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, c_all, chosen): counts over training documents and over all, for every distinct word.

    The end of texts is counted under the empty word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()
        size = 0

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | other.keys())
            c = [train[w] for w in words]
            out = {"word": pa.array(words, pa.binary()), "c": pa.array(c, pa.int64()), "c_all": pa.array([x + other[w] for x, w in zip(c, words, strict=True)], pa.int64())}
            train.clear()
            other.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                into, text = train if is_training(doc_id) else other, text.as_py() or b""
                into.update(text.lower().split())
                into[b""] += 1
                size += len(text)
                if len(train) + len(other) >= COUNTED or size >= COUNTED_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    counted = docs.mapInArrow(run, "word binary, c bigint, c_all bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def add_expected(lattice: Lattice, odds: list[float], word: bytes, c: int, sums: list[float]) -> None:
    """Add c times each piece's expected count in a word, from forward and backward sums.

    ``odds`` are the pieces' probabilities. Sums are linear; where a forward sum
    gets small, it and those ahead that a piece can reach are scaled by a power of
    two. Pieces are listed for ``ARC_STARTS`` places at a time, backwards again.
    """
    n, longest = len(word), lattice.longest
    alpha, scale = [0.0] * (n + 1), [0] * (n + 1)
    alpha[0], shift, last = 1.0, 0, 0
    for low in range(0, n, ARC_STARTS):
        arcs = lattice.arcs(word, low, min(n, low + ARC_STARTS))
        for start, end, i in arcs:
            if start != last:
                last = start
                if alpha[start] < 1e-200:
                    shift += 600
                    for k in range(start, min(n, start + longest) + 1):
                        alpha[k] *= 2.0**600
                scale[start] = shift
            alpha[end] += alpha[start] * odds[i]
    scale[n] = shift
    beta = [0.0] * (n + 1)
    beta[n] = c / alpha[n]
    for low in range((n - 1) // ARC_STARTS * ARC_STARTS, -1, -ARC_STARTS):
        if n > ARC_STARTS:
            arcs = lattice.arcs(word, low, min(n, low + ARC_STARTS))
        for start, end, i in reversed(arcs):
            # beta[k] is the backward sum times 2**-scale[k], so alpha * beta needs no more scaling.
            through = odds[i] * beta[end]
            if scale[end] != scale[start]:
                through *= 2.0 ** (scale[end] - scale[start])
            beta[start] += through
            sums[i] += alpha[start] * through


def expected_pieces(words: DataFrame, pieces: list[bytes], scores: list[float]) -> np.ndarray:
    """Expected count of each piece over the training words, under given scores; one row a piece reaches the driver."""
    spark = words.sparkSession
    given = spark.sparkContext.broadcast((pieces, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, scores = given.value
        lattice, odds = Lattice(pieces, scores), [exp(x) for x in scores]
        counts = [0.0] * len(pieces)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                add_expected(lattice, odds, MARK + word, c, counts)
        sums = np.array(counts)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int64()), "n": pa.array(sums[used])})

    found = words.where("c > 0 and word <> X''").select("word", "c").mapInArrow(run, "piece bigint, n double")
    out = np.zeros(len(pieces))
    for row in found.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[row.piece] = row.n
    return out


def score_words(words: DataFrame, pieces: list[bytes], scores: list[float], end_score: float) -> DataFrame:
    """Adds lp: the log10 probability that the model's lattice gives a word (the end, for the empty word)."""
    given = words.sparkSession.sparkContext.broadcast((pieces, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*given.value)
        for batch in batches:
            lp = [(lattice.forward(MARK + w) if w else end_score) / log(10) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp, pa.float64())], [*batch.schema.names, "lp"])

    return words.mapInArrow(run, "word binary, c bigint, c_all bigint, lp double")


def score_documents(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document."""
    docs = checked_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    counted = written(spark, count_words(docs), "words")
    totals = counted.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.col("word") == F.expr("X''"), F.col("c")))).first()
    tokens, kinds, ends = (x or 0 for x in totals)
    if tokens:
        scores = np.log(prior(pieces)).tolist()
        for _ in range(PASSES):
            gathered = expected_pieces(counted, pieces, scores) + PRIOR_PIECES * prior(pieces)
            whole = gathered.sum() + ends
            scores, end_score = np.log(gathered / whole).tolist(), log(ends / whole)
    else:
        scores, end_score = np.log(prior(pieces) / 2).tolist(), log(0.5)
    words = written(spark, score_words(counted, pieces, scores, end_score), "scored")
    remove_written(counted)
    hot_rows = words.orderBy(F.desc("c_all"), "word").limit(HOT_WORDS).select("word", "c", "lp").collect()
    floor = log10(tokens + kinds + 1)
    hot = spark.sparkContext.broadcast({bytes(r.word): (log10(r.c + 1) - floor, r.lp, r.c > 0) for r in hot_rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = hot.value.get, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            ids = batch.column("doc_id").to_pylist()
            for low in range(0, batch.num_rows, PART):
                rare: list[bytes] = []
                times: list[int] = []
                sizes: list[int] = []
                sums: list[tuple] = []
                for doc_id, text in zip(ids[low : low + PART], texts[low : low + PART], strict=True):
                    counts = Counter((text.as_py() or b"").lower().split())
                    counts[b""] = 1
                    base = lp = 0.0
                    seen, held = 0, len(rare)
                    for word, n in counts.items():
                        value = known(word)
                        if value is None:
                            rare.append(word)
                            times.append(n)
                        else:
                            base += n * value[0]
                            lp += n * value[1]
                            seen += n * value[2]
                    sizes.append(len(rare) - held)
                    sums.append((doc_id, not is_training(doc_id), counts.total(), seen, base, lp))
                numbers = np.arange(row + 1, row + 1 + len(sums))
                row += len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(numbers, sizes)), pa.array(rare, pa.binary()), pa.array(times, pa.int64()), *[pa.nulls(len(rare), t) for t in types]], names
                )
                # A word with a blank never occurs: these rows just carry the sums, dealt evenly.
                own = pa.array([MARK + int(k).to_bytes(8, "big") for k in numbers], pa.binary())
                done = [pa.array(v, t) for v, t in zip(zip(*sums, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers), own, pa.array(np.zeros(len(sums), np.int64)), *done], names)

    id_type = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(id_type), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["row", "word", "n", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    rows = docs.mapInArrow(run, f"row bigint, word binary, n bigint, doc_id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    joined = rows.join(words.select(F.col("word").alias("of"), "c", "lp"), F.col("word") == F.col("of"), "left")
    base = F.log10(F.col("c") + 1.0) - F.lit(floor)
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base_score", F.col("n") * base)).alias("base_score"),
        F.sum(F.coalesce("score", F.col("n") * F.col("lp"))).alias("score"),
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


ship_by_value(__name__)
