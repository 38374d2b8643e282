"""Components, near-duplicates of texts and vectors, the language model, the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import lattice, neardup
from quantloom.llm.blocks import dealt, roots
from quantloom.llm.components import components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles_of(text, size):
    w = words_of(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def grouped(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_rings_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + k) for k in range(1, 50)] + [(5, 5), (None, 3), (300, 299)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = grouped({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert found == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_local_roots():
    ids = np.array([9, 4, 7, 2, 5])
    names, root = roots(ids, np.array([0, 1]), np.array([1, 2]))
    assert dict(zip(names.tolist(), root.tolist(), strict=True)) == {4: 4, 7: 4, 9: 4}


def test_blocks_meet_once(spark):
    rows = spark.range(50).select(F.col("id"), (F.col("id") % 2 * 0).alias("bucket"))
    met = Counter()
    groups = defaultdict(list)
    for r in dealt(rows, "bucket", "id", 12).collect():
        groups[r.bucket, r.part, r.lot].append((r.id, r.side))
    for members in groups.values():
        for i, (a, sa) in enumerate(members):
            for b, sb in members[i + 1 :]:
                if sa < 0 or sa != sb:
                    met[min(a, b), max(a, b)] += 1
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


def corpus(seed=1):
    """Copies, near copies with one to ten words changed, short and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = rnd.choices(vocabulary, k=70)
    rows = []
    for _ in range(120):
        w = list(base)
        for k in rnd.sample(range(70), rnd.randint(0, 8)):
            w[k] = rnd.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 60))) for _ in range(60)]
    rows += [rows[0]] * 5 + [rows[0].upper(), "a b", "A  b", "b a", "one", "One", "", None, " \t", "x " * 3000]
    return list(enumerate(rows, start=10))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)  # several blocks per bucket
    rows = corpus(size)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(4)
    found = {r.doc_id: r for r in neardup.near_duplicates(frame, size).collect()}
    sets = {i: shingles_of(t, size) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = grouped(sets, links)
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in found.items())


def test_signatures_are_compared_unsigned():
    """Words whose top bits differ are one bit apart each, and a pair that close is a candidate."""
    rows = {"root": [1, 2], "side": [-1, -1], "n_shingles": [50, 50], "band": [0, 0], "s0": [0, -(2**63) + 1], "s1": [3, -(2**63)], "s2": [-7, -7], "s3": [0, -(2**63) + 6]}
    table = pa.table({name: pa.array(column, pa.int64()) for name, column in rows.items()})
    pair = neardup._candidates(table, 0, 2, np.zeros((2, neardup.BANDS), np.int64), 0.8)
    assert pair.tolist() == [[False, True], [False, False]]


def test_families_whose_links_cross_components(spark):
    """Families of texts around a lost centre, most of whose links are found among a bucket's members only."""
    rnd = random.Random(11)
    vocabulary = [f"v{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = rnd.choices(vocabulary, k=90)
        for _ in range(42):
            own = list(base)
            for k in rnd.sample(range(90), 5):
                own[k] = rnd.choice(vocabulary)
            texts.append(" ".join(own))
    rnd.shuffle(texts)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).collect()}
    sets = {i: shingles_of(t, 2) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert found == grouped(sets, links)


def test_alike_rows_meet_the_others_only(spark):
    rows = spark.range(60).select("id", F.lit(0).alias("bucket"), (F.col("id") % 20 != 0).alias("alike"))
    groups = defaultdict(list)
    for r in dealt(rows, "bucket", "id", 12, alike="alike").collect():
        groups[r.bucket, r.part, r.lot].append((r.id, r.side))
    met = Counter()
    for members in groups.values():
        for i, (a, sa) in enumerate(members):
            for b, sb in members[i + 1 :]:
                if sa < 0 or sa != sb:
                    met[min(a, b), max(a, b)] += 1
    assert set(met.values()) == {1} and set(met) == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 20 == 0 or b % 20 == 0}


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "q r s t u v w"), (3, "a b c d e f"), (4, "q r s t u v w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(1, 1, True), (2, 1, False), (None, None, True), (3, 1, False), (4, 1, False)}
    kept = neardup.deduplicated(frame).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "a b c d e f"), (1, "a b c d e f")]
    assert neardup.near_duplicates(frame.where("false")).count() == 0


def test_bands_rarely_miss():
    assert (1 - 0.8**neardup.ROWS) ** neardup.BANDS < 1e-5


# -- vectors


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * 1.5
    near, other = lattice.decode_e8(x)
    doubled = np.rint(near * 2).astype(int)
    parity = doubled % 2
    assert ((parity == 0).all(1) | (parity == 1).all(1)).all() and (near.sum(1) % 2 == 0).all()
    for move in [v for v in np.vstack((np.eye(8) * 2, -np.eye(8) * 2, [[1, 1] + [0] * 6, [1, -1] + [0] * 6], np.full((1, 8), 0.5), np.full((1, 8), -0.5)))]:
        assert (np.square(x - near).sum(1) <= np.square(x - near - move).sum(1) + 1e-9).all()


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 20)
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centres = unit(rng.normal(size=(12, 32)))
    x = np.vstack([unit(c + rng.normal(size=(n, 32)) * 0.015) for c, n in zip(centres, [60, 30] + [3] * 10, strict=True)] + [unit(rng.normal(size=(80, 32)))])
    rows = [(k, [float(v) for v in np.float32(r)]) for k, r in enumerate(x)] + [(500, [float(v) for v in np.float32(x[0])]), (501, [2 * float(v) for v in np.float32(x[0])])]
    odd = [(600, None), (601, []), (602, [0.0] * 32), (603, [float("nan")] * 32), (604, [1.0] * 4), (605, [None] + [1.0] * 31), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, label int, kept string").repartition(3)
    found = {r.vec_id: r for r in lattice.near_vectors(frame).collect()}
    a = np.array([v for _, v in rows], float)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    ids = [i for i, _ in rows]
    link = (a @ a.T >= 0.95) & ~np.eye(len(a), dtype=bool)
    want = grouped(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(link), strict=True)])
    assert {i: found[i].component_id for i in ids} == want
    assert {i: found[i].n_links for i in ids} == dict(zip(ids, link.sum(1).tolist(), strict=True))
    assert all(found[i].n_links == 0 and found[i].kept for i, _ in odd) and found[None].component_id is None
    assert lattice.near_vectors(frame.where("false")).count() == 0


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    rnd = random.Random(8)
    good = [" ".join(rnd.choices([f"word{k}" for k in range(60)], k=50)) for _ in range(80)]
    junk = [" ".join(rnd.choices(["zz$$$", "qq###", "LOUD!!", "xx%%%"], k=50)) for _ in range(40)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(good + junk)]
    rows += [(500, good[0], "en", "s0", 1), (501, good[1] + " token = 0123456789abcdef0123", "en", None, 2), (502, None, None, "s1", None), (503, "", "en", "s2", 0), (None, good[2], "en", "s1", 3)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1 if k < 80 else 0, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == documents.columns
        kept.append(docs.collect())
    filtered, unique, clean, mixed = kept
    assert {r.doc_id for r in filtered} >= set(range(80)) | {500, 501, None} and not {r.doc_id for r in filtered} & set(range(80, 120))
    assert 0 in {r.doc_id for r in unique} and 500 not in {r.doc_id for r in unique}
    assert len(clean) == len(unique)
    spoilt = [r for r in clean if r.doc_id == 501]
    assert all("0123456789abcdef" not in r.text and r.n_chars == len(r.text) for r in spoilt)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    final = pipeline.run(spark, str(tmp_path)).collect()
    assert len(final) == len(mixed) and all(len(r.ids) == r.n_tokens for r in final)
    none = documents.where("false")
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0


def test_pipeline_says_which_texts_come_back(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    rows = [(1, "Plain words here.", "en", "a"), (2, "a space mark \u2581 itself", "en", "a"), (3, None, "en", "a"), (4, "", "en", "a")]
    name, last = pipeline.STAGES[-1]
    assert "decoding" in name
    found = last(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "").collect()
    assert {r.doc_id: r.decoded for r in found} == {1: True, 2: False, 3: True, 4: True}
