"""The pipeline's near-duplicate stage goes through the fingerprints and their Gray-order index."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from alertloom.llm import near_copies, simhash_gray
from tests.llm.test_corpus_operators import components


def pairs_of_copies(n, words, seed):
    """Texts 2k and 2k + 1 differ in one word."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        text = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
        texts += [" ".join(text), " ".join([*text[:-1], "other"])]
    return texts


def test_index_links_what_fingerprints_link(spark):
    docs = spark.createDataFrame(list(enumerate(pairs_of_copies(30, 1500, 1) + pairs_of_copies(30, 40, 2) + ["", "a b"])), "doc_id bigint, text string").repartition(3)
    sets = near_copies.written(spark, near_copies.shingle_sets(docs), "sets")
    prints = {r.set_id: r.fp for r in sets.collect()}
    links = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= simhash_gray.MAX_DISTANCE]
    assert len(links) >= 20
    got = [(r.a, r.b) for r in near_copies.gray_pairs(sets).collect()]
    assert components(got, prints) == components(links, prints)


def test_stage_drops_copies_by_the_index_alone(spark, monkeypatch):
    """With the exact way for the rest turned off, very near copies still go."""
    none = lambda frame: frame.where("false")
    hubs, heads = near_copies.hub_pairs, near_copies.leading
    monkeypatch.setattr(near_copies, "hub_pairs", lambda sets: none(hubs(sets)))
    monkeypatch.setattr(near_copies, "leading", lambda sets, common: none(heads(sets, common)))
    docs = spark.createDataFrame(list(enumerate(pairs_of_copies(30, 1500, 1))), "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept >= set(range(0, 60, 2)) and len(kept) <= 40


def test_linked_fingerprints_are_checked_in_full(spark):
    docs = spark.createDataFrame(list(enumerate(pairs_of_copies(10, 60, 3))), "doc_id bigint, text string")
    sets = near_copies.written(spark, near_copies.shingle_sets(docs).withColumn("fp", F.lit(7).cast("bigint")), "sets")
    pairs = near_copies.gray_pairs(sets)
    assert pairs.count() == 19
    assert near_copies.similar(near_copies.close_signatures(pairs, sets), sets).count() == 1
