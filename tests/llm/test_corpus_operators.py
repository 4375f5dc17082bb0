"""Operators over whole corpora and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from alertloom.llm import graph, lsi_decontam, rlz_dedup, simhash_gray
from tests.llm.conftest import SCHEMA, ascii_lower, make_texts, words_of


def brute_fingerprint(text):
    words = words_of(ascii_lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- SimHash


def test_near_duplicates(docs, rows, no_docs):
    got = {r.doc_id: r for r in simhash_gray.near_duplicates(docs).collect()}
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    ids = sorted(prints)
    want = components([(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], ids)
    assert {i: got[i].fingerprint for i in ids} == {i: f"{prints[i]:016x}" for i in ids}
    assert {i: got[i].component_id for i in ids} == want
    assert simhash_gray.near_duplicates(no_docs).count() == 0
    kept = simhash_gray.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


@pytest.mark.parametrize("seed", range(3))
def test_gray_index_finds_every_link(spark, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) & ((1 << 64) - 1) for b in base for _ in range(8)} | {0, 1, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash_gray.gray_links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert set((r.a, r.b) for r in links) <= set(pairs)
    assert components([(r.a, r.b) for r in links], signed) == components(pairs, signed)


def test_gray_node_prunes_but_loses_nothing():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 2**14, 3000, dtype=np.uint64))
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    joined = components(list(simhash_gray.GrayNode(fps, 1).links()), range(len(fps)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 1
    assert joined == components(list(zip(*np.nonzero(np.triu(near, 1)), strict=True)), range(len(fps)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = {r.vertex: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == 7 for i in range(200, 260)) and 5 not in got
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- substring dedup


def without_repeats(every):
    """(doc_id, words, removed, digest, kept) by a dictionary of all windows."""
    first = {}
    for doc_id, text in every:
        w = words_of(text)
        for k in range(len(w) - 12) if doc_id is not None else ():
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, doc_id), doc_id)
    want = []
    for doc_id, text in every:
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - 12) if doc_id is not None else ():
            if first[tuple(w[k : k + 13])] < doc_id:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return want


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))


def removed(df):
    return by_id((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [2_000, 10_000_000])
@pytest.mark.parametrize("asked_bytes", [300, 10_000_000])
def test_repeats_are_removed(spark, docs, rows, no_docs, monkeypatch, block_bytes, asked_bytes):
    monkeypatch.setattr(rlz_dedup, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(rlz_dedup, "ASKED_BYTES", asked_bytes)
    monkeypatch.setattr(rlz_dedup, "PIECE_BYTES", 700)
    extra = spark.createDataFrame([(None, rows[2][1], None, None, None, None), (rows[0][0], rows[2][1], None, None, None, None)], SCHEMA)
    every = [(r[0], r[1]) for r in rows] + [(None, rows[2][1]), (rows[0][0], rows[2][1])]
    got = rlz_dedup.remove_repeats(docs.unionByName(extra), keep_text=True)
    assert removed(got) == by_id(without_repeats(every))
    texts = {}
    for doc_id, text in every:
        texts.setdefault(doc_id, []).append(words_of(text))
    found = 0
    for r in got.where("size(factors) > 0").collect():
        for f in r.factors:
            found += 1
            sources = [w[f.source_word : f.source_word + f.n_words] for w in texts[f.source_id]]
            assert f.source_id < r.doc_id and f.n_words >= 13 and any(w[f.first_word : f.first_word + f.n_words] in sources for w in texts[r.doc_id])
    assert found > 10 and rlz_dedup.remove_repeats(no_docs).count() == 0


def test_factors_are_the_longest_matches():
    rnd = random.Random(6)
    prose = lambda k: [str(rnd.randrange(10**6)) for _ in range(k)]
    whole = prose(400)
    sources = [whole[:60], prose(20) + whole[:200] + prose(20), whole[100:130], whole[188:300] + prose(5)]
    block = rlz_dedup.Block([packed([(i, " ".join(w).encode()) for i, w in enumerate(sources)])])
    line = " ".join(whole[:300]).encode()
    windows = rlz_dedup._runs(rlz_dedup.word_hashes([line])[0], 13, 1)
    factors = rlz_dedup.Reference(block, windows).factor(line.split(), windows, 99)
    assert [f[:4] for f in factors if not f[4]] == [(0, 200, 1, 20), (200, 100, 3, 12)]
    assert [f[:4] for f in factors if f[4]] == [(w, 13, 3, w - 188) for w in range(188, 200)]


def packed(rows):
    import pickle

    import zstandard

    return zstandard.ZstdCompressor().compress(pickle.dumps(rows))


def test_windows_of_equal_hash_are_told_apart(spark, docs, rows, monkeypatch):
    """Thousands of windows share 64 bits; where they share all 96 the run fails instead of removing wrong words."""
    runs = rlz_dedup._runs
    monkeypatch.setattr(rlz_dedup, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(rlz_dedup, "PIECE_BYTES", 700)
    monkeypatch.setattr(rlz_dedup, "_runs", lambda h, width, seed: runs(h, width, seed) & np.uint64(0xF0 if seed == 1 else 2**64 - 1))
    assert removed(rlz_dedup.remove_repeats(docs, keep_text=True)) == by_id(without_repeats([(r[0], r[1]) for r in rows]))
    monkeypatch.setattr(rlz_dedup, "_runs", lambda h, width, seed: runs(h, width, seed) & np.uint64(0xF0 if seed in (1, 3) else 2**64 - 1))
    with pytest.raises(Exception, match="share a hash"):
        rlz_dedup.remove_repeats(docs).collect()


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole number"):
        rlz_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# --- decontamination


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rnd = random.Random(0)
    for _ in range(100):
        a, b = ([rnd.choice(b"abcd".split(b"") if False else [b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(1, 30))] for _ in range(2))
        assert lsi_decontam.common_subsequence(a, b) == lcs(a, b)


def test_leaks_are_found(spark, no_docs):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(3, 8)))
    common = [word() for _ in range(200)]
    prose = lambda k: [rnd.choice(common) for _ in range(k)]
    items = [[rnd.choice(common) if rnd.random() < 0.4 else word() for _ in range(rnd.randint(15, 50))] for _ in range(12)]
    rows, want = [], set()
    for i in range(120):
        text = prose(rnd.randint(0, 300))
        if i % 3 == 0:
            k = rnd.randrange(12)
            item = list(items[k])
            if i % 2:
                item = [w for w in item if rnd.random() > 0.15]
            at = rnd.randint(0, len(text))
            text[at:at] = item
            want.add((i, k))
        rows.append((i, " ".join(text).capitalize(), "en", "s", 0, "x"))
    rows.append((500, None, None, None, None, None))
    bench = spark.createDataFrame([(k, " ".join(x) + ".") for k, x in enumerate(items)] + [(98, None), (99, "")], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lsi_decontam.find_leaks(docs, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & want) >= 0.95 * len(want) and {d for d, _ in found} <= {d for d, _ in want}
    assert {(d, k) for d, k in want if d % 2 == 0} <= found
    assert sorted(r.doc_id for r in lsi_decontam.drop_contaminated(docs, bench).collect()) == sorted({r[0] for r in rows} - {d for d, _ in found})
    assert lsi_decontam.find_leaks(no_docs, bench).count() == 0 and lsi_decontam.find_leaks(docs, bench.limit(0)).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        seen.append((name, docs.count(), docs.columns))
    assert len(seen) == 5 and all(c == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, c in seen[:-1])
    assert 200 >= seen[0][1] >= seen[1][1] >= seen[2][1] == seen[3][1] == seen[4][1] > 100
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.ids_sha256 for r in docs.collect())


def test_make_texts_repeat():
    assert make_texts() == make_texts()


def test_pipeline_equals_brute_force(spark):
    """The whole pipeline on the smallest tables: learned rules as learned, everything after by plain loops."""
    import public_tokenizers as P
    import tiktoken

    from alertloom.llm import bpe_tree, decision_list
    from tests.llm.test_text_operators import base_of, entropy_of, surface_of

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = decision_list.learn(*decision_list.training_rows(docs, labels))
    features = {r.doc_id: r for r in decision_list.surface(docs).select("doc_id", *decision_list.FEATURES).collect()}
    texts = {}
    for r in docs.collect():
        n, _, _, _, repeated = surface_of(r.text)
        x = np.array([[float(features[r.doc_id][f]) for f in decision_list.FEATURES]])
        rejected = any(all(t.holds(x)[0] for t in rule.tests) for rule in rules)
        if n >= 20 and 100 * repeated <= 30 * n and not rejected:
            texts[r.doc_id] = r.text
    words = {i: words_of(ascii_lower(t)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    groups = components([(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], sets)
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = [(lsi_decontam.fold(r.text.encode()), lsi_decontam.answer_of(r.text.encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaked(words):
        for at in range(0, max(1, len(words) - lsi_decontam.STRIDE), lsi_decontam.STRIDE):
            for item, answer in items:
                around = words[max(0, at - len(item)) : at + lsi_decontam.PASSAGE + len(item)]
                share = lsi_decontam.common_subsequence(item, around) / len(item)
                stands = any(around[k : k + len(answer)] == answer for k in range(len(around)))
                if share >= lsi_decontam.SURE or (share >= lsi_decontam.LIKELY and stands):
                    return True
        return False

    texts = {i: t for i, t in texts.items() if not leaked(lsi_decontam.fold(t.encode()))}
    ranks = bpe_tree.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts.items():
        base = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in base_of(t).split(",") if x)]
        more = [(s, "entropy", e) for s, _, e in entropy_of(t) if not any(a <= s and e <= b for a, _, b in base)]
        order = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
        out, at = "", 0
        for s, k, e in sorted(base + more, key=lambda x: (x[0], order[x[1]])):
            if s >= at:
                out += t[at:s] + f"[{k}]"
            at = max(at, e)
        clean = out + t[at:] if base or more else t
        want[i] = hashlib.sha256(np.array(library.encode_ordinary(clean), "<u4").tobytes()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want
