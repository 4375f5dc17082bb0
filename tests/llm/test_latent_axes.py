"""The latent axes come from every document: against a singular value decomposition of all passages."""

from __future__ import annotations

import random

import numpy as np
import pytest

from alertloom.llm import lsi_decontam


def passages(texts, terms, idf):
    rows = []
    for words in texts:
        for at in range(0, len(words), lsi_decontam.PASSAGE):
            row = np.zeros(len(terms))
            for w in words[at : at + lsi_decontam.PASSAGE]:
                if w in terms:
                    row[terms[w]] += idf[terms[w]]
            rows.append(row / max(np.linalg.norm(row), 1e-12))
    return np.array(rows)


@pytest.mark.parametrize("products", [500, 6_000_000])
def test_axes_are_those_of_all_documents(spark, monkeypatch, products):
    monkeypatch.setattr(lsi_decontam, "PRODUCTS", products)
    monkeypatch.setattr(lsi_decontam, "BATCH_WORDS", 2_000)
    monkeypatch.setattr(lsi_decontam, "POWER", 12)
    rnd = random.Random(5)
    terms = {b"t%02d" % i: i for i in range(50)}
    names = sorted(terms)
    # Documents of one of five kinds each, far more than any fixed number of them.
    texts = [[rnd.choice(names[kind * 10 : kind * 10 + 10]) if rnd.random() < 0.6 else b"other" for _ in range(rnd.choice([0, 3, 12, 40, 70]))] for kind in rnd.choices(range(5), [9, 8, 7, 6, 1], k=4_000)]
    docs = spark.createDataFrame([(i, b" ".join(t).decode() if t else None) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    rows = lsi_decontam.written(spark, lsi_decontam.numbered(docs, terms), "numbered")
    kind = lsi_decontam.number_type(terms)
    frequencies = lsi_decontam.passage_frequencies(rows, len(terms), kind)
    idf = np.append(np.log((frequencies[-1] + 1) / (frequencies[:-1] + 1)), 0) + 1e-3
    a = passages(texts, terms, idf)
    assert frequencies.tolist() == [*(a > 0).sum(0), len(a)]
    gram = np.zeros((len(terms), len(terms)))
    for strip, places, sums in lsi_decontam.common_terms(rows, idf, len(terms), kind).collect():
        gram.ravel()[strip * lsi_decontam.STRIP * len(terms) + np.frombuffer(bytes(places), np.int32)] += np.frombuffer(bytes(sums), np.float32)
    assert np.abs(gram - np.triu(a.T @ a)).max() < 1e-4 * gram.max()
    got = lsi_decontam.latent_axes(rows, idf, len(terms), kind, 5)
    assert np.abs(got.T @ got - np.eye(5)).max() < 1e-9
    best = np.linalg.eigvalsh(a.T @ a)[-5:].sum()
    assert abs(np.linalg.norm(a @ got) ** 2 - best) < 1e-4 * best
