"""Leaks of long items, and of items whose rare words were replaced, against brute-force subsequences."""

from __future__ import annotations

import random

import pytest

from alertloom.llm import lsi_decontam
from tests.llm.conftest import SCHEMA
from tests.llm.test_corpus_operators import lcs


def corpus(seed, sizes, rare_share):
    """Prose of common words, and items of common and rare words."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("aeinorst") for _ in range(k))
    common = [word(4) for _ in range(300)]
    prose = lambda k: [rnd.choice(common) for _ in range(k)]
    items = [[word(9) if rnd.random() < rare_share else rnd.choice(common) for _ in range(rnd.randint(*sizes))] for _ in range(20)]
    return rnd, prose, items


def leaks(spark, texts, items):
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in lsi_decontam.find_leaks(docs, bench).collect()}


def test_long_items_are_found(spark):
    rnd, prose, items = corpus(1, (110, 160), 0.15)
    texts = [prose(rnd.randint(100, 300)) for _ in range(400)]
    for i in range(0, 400, 4):
        at = rnd.randint(0, len(texts[i]))
        texts[i][at:at] = items[i // 4 % 20]
    assert {(i, i // 4 % 20) for i in range(0, 400, 4)} <= leaks(spark, texts, items)


def test_items_without_their_rare_words_are_found(spark):
    rnd, prose, items = corpus(2, (20, 50), 0.4)
    count = {}
    for x in items:
        for w in x:
            count[w] = count.get(w, 0) + 1
    texts = [prose(rnd.randint(100, 300)) for _ in range(400)]
    for i in range(0, 400, 4):
        item = items[i // 4 % 20]
        rarest = sorted(range(len(item)), key=lambda k: (len(item[k]) < 9, count[item[k]]))[: round(0.3 * len(item))]
        at = rnd.randint(0, len(texts[i]))
        texts[i][at:at] = [f"other{rnd.randrange(10**6)}" if k in rarest else w for k, w in enumerate(item)]
    want = {(i, i // 4 % 20) for i in range(0, 400, 4)}
    assert all(lcs(items[k], texts[i]) >= lsi_decontam.SURE * len(items[k]) for i, k in want)
    found = leaks(spark, texts, items)
    assert len(found & want) >= 0.95 * len(want), len(found & want)


def brute(text, items):
    """Items that leak by the rule alone: longest common subsequence around every passage."""
    found = set()
    for at in range(0, max(1, len(text) - lsi_decontam.PASSAGE + lsi_decontam.STRIDE), lsi_decontam.STRIDE) if text else ():
        for k, (item, answer) in items.items():
            around = text[max(0, at - len(item)) : at + lsi_decontam.PASSAGE + len(item)]
            share = lsi_decontam.common_subsequence(item, around) / len(item)
            if share >= lsi_decontam.SURE or (share >= lsi_decontam.LIKELY and lsi_decontam._stands_in(answer, around)):
                found.add(k)
    return found


@pytest.mark.parametrize("changed", [0.1, 0.25, 0.4])
def test_recall_over_whole_tables(spark, changed):
    """Every document and item of the tables, with paraphrases planted: what the rule finds by brute force against the operator."""
    sf, rnd = "/root/testdata/sf0.01", random.Random(int(100 * changed))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: (lsi_decontam.fold(r.text.encode()), lsi_decontam.answer_of(r.text.encode())) for r in bench.collect()}
    texts = {r.doc_id: lsi_decontam.fold((r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    vocabulary = sorted({w for t in texts.values() for w in t})
    for i, doc_id in enumerate(sorted(texts)):
        if i % 3 == 0:
            item = list(rnd.choice(sorted(items.values()))[0])
            for k in rnd.sample(range(len(item)), int(changed * len(item))):
                item[k] = rnd.choice(vocabulary)
            at = rnd.randint(0, len(texts[doc_id]))
            texts[doc_id][at:at] = item
    docs = spark.createDataFrame([(i, b" ".join(t).decode()) for i, t in texts.items()], "doc_id bigint, text string").repartition(8)
    want = {(i, k) for i, t in texts.items() for k in brute(t, items)}
    found = {(r.doc_id, r.item_id) for r in lsi_decontam.find_leaks(docs, bench).collect()}
    print("changed", changed, "by rule", len(want), "found", len(found & want))
    assert found <= want and len(want) > 250 and len(found) >= 0.95 * len(want)


def test_blocks_of_items_change_little(spark, monkeypatch):
    rnd, prose, items = corpus(4, (15, 40), 0.4)
    texts = [prose(rnd.randint(50, 200)) for _ in range(100)]
    for i in range(0, 100, 2):
        texts[i][10:10] = items[i // 2 % 20]
    want = {(i, i // 2 % 20) for i in range(0, 100, 2)}
    monkeypatch.setattr(lsi_decontam, "BLOCK_ITEMS", 7)
    assert want <= leaks(spark, texts, items)
    monkeypatch.setattr(lsi_decontam, "BLOCK_WORDS", 10)
    monkeypatch.setattr(lsi_decontam, "BLOCK_ITEMS", 20)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(77, "..."), (78, None)], "item_id bigint, text string")
    assert [len(b) for b in lsi_decontam.item_blocks(bench)] == [1] * 20
