"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from alertloom.llm import near_copies
from tests.llm.conftest import SCHEMA, ascii_lower, words_of
from tests.llm.test_corpus_operators import components


def shingles(text):
    words = words_of(ascii_lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def copies(seed):
    """Prose, copies of it with some words changed, cut or appended, and a passage that many share."""
    rnd = random.Random(seed)
    prose = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    license_lines = prose(40)
    texts = []
    for _ in range(40):
        text = prose(rnd.randint(3, 200)) + license_lines * rnd.randrange(2)
        texts.append(text)
        for _ in range(rnd.randrange(4)):
            copy = list(text)
            for _ in range(rnd.randint(0, 1 + len(copy) // 40)):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(10**6)}"
            texts.append(copy[rnd.randrange(3) :] + prose(rnd.randrange(12)))
    rows = [(i, " ".join(t), "en", "s", 0, "x") for i, t in enumerate(texts)]
    more = [" ".join(texts[0]).upper(), "\n".join(texts[1]), None, "", " \n"]
    return rows + [(1000 + i, t, "en", "s", 0, "x") for i, t in enumerate(more)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize(("most", "many", "bands"), [(1, 2, 8), (32, 16, 1)])
def test_stage_drops_every_similar_copy(spark, monkeypatch, seed, most, many, bands):
    monkeypatch.setattr(near_copies, "COMMON", most)
    monkeypatch.setattr(near_copies, "MANY", many)
    monkeypatch.setattr(near_copies, "MULTIPLIERS", near_copies.MULTIPLIERS[:bands])
    rows = copies(seed)
    sets = {r[0]: shingles(r[1]) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    assert sum(sets[a] != sets[b] for a, b in links) > 15
    want = components(links, sets)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_rows_without_id_are_copies_too_and_no_rows_are_fine(spark, no_docs):
    rows = [(None, "a b c"), (3, "a b c"), (3, "A  b c"), (None, "d e f g h i"), (None, "D E F G H I")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text.split()[0].lower()) for r in kept) == [(0, "d"), (3, "a")]
    assert corpus_pipeline.near_duplicates(spark, no_docs, "").count() == 0


def test_places_and_sizes_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(1, 60, 300))
    place, label = rng.integers(0, size // 5 + 1), rng.integers(0, 40, 300)
    got = {(int(a), int(b)) for x, y in near_copies.alike(size, place, label) for a, b in zip(x, y, strict=True)}
    most = lambda a, b: min(size[a] - place[a], size[b] - place[b])
    assert got == {(a, b) for b in range(300) for a in range(b) if label[a] != label[b] and most(a, b) * 9 >= 4 * (size[a] + size[b]) and size[b] * 4 <= size[a] * 5}


def test_a_large_group_is_joined_without_all_its_pairs(spark):
    """Copies of one text, each with a few words changed: far fewer pairs are put down than there are in the group."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(300):
        copy = list(base)
        copy[rnd.randrange(200)] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r.component_id for r in near_copies.near_copies(docs).collect()} == {0}
    sets = near_copies.written(spark, near_copies.shingle_sets(docs), "sets")
    assert near_copies.hub_pairs(sets).count() < 300 * near_copies.BANDS
    joined = near_copies.connected_components(near_copies.similar(near_copies.hub_pairs(sets), sets))
    assert joined.select("component").distinct().count() == 1
