"""Sharding, secrets, mixing, tokens, media, pieces and quality: brute force, round trips and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import media, mixing, pieces, quality, queries, secret_scan, shard, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    (1, "Plain words here.", "a"), (2, "", "a"), (3, None, None), (None, "no id", "b"), (5, "same", "b"), (5, "same", "b"),
    (6, "  spaced   out \n\n", "a"), (7, "é ü 日本 😀 ▁", None), (8, "x" * 30_000 + " tail", "a"), (9, "\t\x0b\x0c", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, "clash", 7) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# -- sharding


@pytest.mark.parametrize("n", [1, 2, 5, 24, 1000])
def test_permutation_is_one_to_one_and_inverts(n):
    p = shard.permute(np.arange(n), n, 3)
    assert sorted(p) == list(range(n))
    assert (shard.permute(p, n, 3, back=True) == np.arange(n)).all()


def test_shards_are_even_gapless_and_layout_free(odd, empty):
    def placed(frame):
        return shard.shard_rows(frame, 4, seed=1).collect()

    rows = placed(odd)
    assert len(rows) == len(ODD)
    by = {k: sorted(r.slot for r in rows if r["shard"] == k) for k in range(4)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(repr, rows)) == sorted(map(repr, placed(odd.repartition(1))))
    assert placed(empty) == []


def test_runs_of_identical_rows(spark):
    rows = shard.shard_rows(spark.range(10_000).select(F.lit(1).alias("x")), 3).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sorted(r.n for r in rows) == [3333, 3333, 3334] and all(r.m == r.n - 1 for r in rows)


def test_query_shards_whole_documents(spark, tmp_path):
    rows = [(k, f"text {k % 7}", "en", f"s{k % 3}", 6) for k in range(60)] + [(None, None, None, None, None), (3, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    whole = shard.shard_rows(spark.read.parquet(str(tmp_path / "documents.parquet")), 24, seed=1).collect()
    want = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in whole]
    found = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in queries.op1_sharding(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want)) and len(found) == len(rows)


# -- secrets


def brute_spans(text, rules=secret_scan.RULES):
    found = [(m.start(), m.end(), k, r.kind) for k, r in enumerate(rules) for m in r.compiled.finditer(text or "") if len(m.group(r.group)) >= r.least]
    return [(s, e, kind) for s, e, _, kind in sorted(found, key=lambda x: (x[0], x[2]))]


def test_scan_equals_searching_everything():
    rnd = random.Random(2)
    bits = ["password", "PassWd", "secret", "token=", "api_key", "ApiKey", ": ", "= '", '"', "AKIA", "ABCDEFGHIJKLMNOP", "deadbeefdeadbeef", "0123456789abcdef01", "abcDEF123456/+", " ", "é", "\n", "ghp_" + "a" * 36, "xoxb-1234567890", "sk_live_" + "b" * 20]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(1500)] + [None, ""]
    assert secret_scan.scan(pa.array(texts)) == [brute_spans(t) for t in texts]


@pytest.mark.parametrize("label", ["", "RSA ", "ENCRYPTED ", "OPENSSH "])
def test_private_keys_are_found_whole(label):
    head, body, end = f"-----BEGIN {label}PRIVATE KEY-----", "\nMIIEow+/AB==\nzzZZ99\n", f"-----END {label}PRIVATE KEY-----"
    headers = "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0102\n"
    for key in (head + body + end, head + headers + body + end):
        found = secret_scan.scan(pa.array([f"a {key} b", f"{head}{body}, {key}"]))
        assert (2, 2 + len(key), "private_key") in found[0]
        assert [x[:2] for x in found[1] if x[2] == "private_key"] == [(0, len(head + body)), (len(head + body) + 2, len(head + body) + 2 + len(key))]
    cut = head + headers + body
    assert (0, len(cut), "private_key") in secret_scan.scan(pa.array([cut + "!"]))[0]


def test_hex_rule_is_the_runs_of_the_plain_pattern():
    text = "0123456789abcdef0 g0123456789abcdeff0 0123456789abcde " + "ab" * 20
    plain = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert [(s, e) for s, e, k in brute_spans(text) if k == "hex"] == plain


def test_queries_name_mandatory_trigrams_only():
    assert secret_scan.trigram_query(r"[0-9a-f]{16,}") == secret_scan.ANY
    assert secret_scan.trigram_query("abcd") == ("and", frozenset({("tri", b"abc"), ("tri", b"bcd")}))
    assert secret_scan.trigram_query("abc|x*") == secret_scan.ANY


def test_redaction_unites_overlaps(spark, odd, empty):
    frame = spark.createDataFrame([(1, 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redacted(frame).collect()}
    assert got == {1: 'é [SECRET]" end', 2: "clean", 3: None}
    assert secret_scan.secret_spans(odd).count() == len(ODD) and secret_scan.redacted(empty).count() == 0


# -- mixing


def water_fill(sizes, weights, share, most):
    total, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        left = total - sum(targets[k] for k in range(len(sizes)) if k not in open_)
        w = sum(weights[k] for k in open_)
        for k in open_:
            targets[k] = weights[k] * left / w
        over = {k for k in open_ if targets[k] > most * sizes[k]}
        if not over:
            return targets
        for k in over:
            targets[k] = most * sizes[k]
        open_ -= over
        if not open_:
            return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 1000, 5], [1, 1], [50], [3, 900, 20, 20, 7, 0]])
def test_targets_fill_like_water(spark, sizes):
    frame = spark.createDataFrame([(f"s{k}", v) for k, v in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.source_targets(frame).orderBy("source").collect()]
    want = water_fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5, 2.0)
    assert got == pytest.approx(want)


def test_copies(odd, empty):
    rows = mixing.copies(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.copies <= 2 for r in rows)
    assert {r.doc_id: r["size"] for r in rows if r.doc_id in (2, 3, 6, 9)} == {2: 0, 3: 0, 6: 2, 9: 0}
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.copies(odd.repartition(1)).collect()))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.copies(empty).count() == 0


def test_sources_come_near_their_targets(spark):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    for r in mixing.copies(frame).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target


# -- token files


def test_bpe_equals_the_library():
    encoder = tokenfile.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    bits = ["word", " ", "  ", "\n", "don't", ".", "Ünï", "123", "\t", "\xa0", "　", "!?", "'s", "naïve,", "日本", "<|endoftext|>", "\x85", "\x1c"]
    texts = [None, "", " ", "   "] + ["".join(rnd.choices(bits, k=rnd.randint(1, 14))) for _ in range(600)]
    ids, bounds = encoder.encode_column(pa.array(texts, pa.string()))
    want = encoder.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [w.tolist() for w in want]


def test_token_table(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokenfile.ByteBpe(path)
    rows = sorted(tokenfile.token_table(odd, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _, _ in ODD), key=lambda i: (i is not None, i))
    texts, at = {i: t for i, t, _ in ODD}, 0
    for r in rows:
        ids = np.append(encoder.encode([texts[r.doc_id] or ""])[0], 0).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfile.token_table(empty, path).count() == 0


def test_file_reads_single_documents_and_sees_damage(tmp_path):
    path = tmp_path / "a.zst"
    docs = [np.arange(k, dtype=np.uint32) * 7 for k in (3, 0, 5000, 1, 40)]
    with path.open("wb") as f:
        writer = tokenfile.TokenFileWriter(f, frame_ids=64)
        for k, d in enumerate(docs):
            writer.add(k if k else None, d)
        writer.close()
    file = tokenfile.TokenFile(str(path))
    assert {k: d.tolist() for k, d in file.documents([4, 1])} == {1: [], 4: docs[4].tolist()}
    assert [d.tolist() for _, d in file.documents()] == [d.tolist() for d in docs]
    with path.open("wb") as f:
        writer = tokenfile.TokenFileWriter(f)
        for k, d in enumerate(docs):
            writer.add(k, d)
        writer.close()
    single, asked = tokenfile.TokenFile(str(path)), []
    whole = single.frame
    single.frame = lambda k: asked.append(k) or whole(k)
    assert [d.tolist() for _, d in single.documents([2])] == [docs[2].tolist()] and len(asked) == 1 and single.plain[asked[0]] == 4 * len(docs[2])
    data = bytearray(path.read_bytes())
    data[10] ^= 255
    path.write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017
        list(tokenfile.TokenFile(str(path)).documents([0]))


# -- media


def test_archives_outside_the_manifest_do_not_count(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "lost.zip").write_bytes(b"cut short")
    frame = spark.createDataFrame([(1, b"a"), (2, None), (None, b"c" * 2000)], "key long, bytes binary").repartition(2)
    media.write_archives(frame, str(folder))
    assert not (folder / "lost.zip").exists()
    (folder / "late.zip").write_bytes(b"cut short")
    assert sorted((r.key or 0, r.n_bytes) for r in media.read_media(spark, str(folder)).collect()) == [(0, 2000), (1, 1), (2, 0)]
    media.write_archives(frame, str(folder))
    assert media.read_media(spark, str(folder)).count() == 6 and not (folder / "late.zip").exists()



def test_media_round_trip(odd, empty):
    rows = media.media_table(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in ODD)
    texts = {i: (t or "").encode() for i, t, _ in ODD}
    for r in rows:
        payload = media.padded(texts[r.doc_id])
        assert len(payload) % 576 == 0 and len(payload) > 0
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        image = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256, r.tail_crc32) == (len(image), hashlib.sha256(image).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.media_table(empty).count() == 0


def test_byte_ranges_cover_members_once(spark, tmp_path):
    frame = spark.range(200).select(F.col("id").alias("key"), F.encode(F.repeat(F.lit("ab"), F.col("id").cast("int")), "UTF-8").alias("bytes")).repartition(2)
    media.write_archives(frame, str(tmp_path / "m"))
    read = media.read_media(spark, str(tmp_path / "m"), rangebytes="700", batchbytes="500")
    assert sorted(r.key for r in read.collect()) == list(range(200))


def test_members_are_retried_by_offset():
    import zipfile
    from io import BytesIO

    held = BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", b"payload")
        info = z.getinfo("a")
    calls = []

    def flaky(uri, start, size):
        calls.append(start)
        if len(calls) < 3:
            raise OSError("lost")
        return held.getvalue()[start : start + size]

    assert media.read_member("x", info.header_offset, info.file_size, info.CRC, flaky) == b"payload"
    assert calls[:3] == [info.header_offset] * 3


# -- pieces


def test_pieces_equal_the_library(odd, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model_of(path)
    rnd = random.Random(3)
    texts = [None, "", " ", "   ", "▁▁a", "a" + " " * 37 + "b", "日本語 テスト", "\x00\x01 😀", "x" * 50] + ["".join(rnd.choices("abcdeinorst .,é", k=rnd.randint(1, 60))) for _ in range(800)]
    ids, bounds = own.encode(pa.array(texts, pa.string()))
    want = library.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    assert own.decode(ids, bounds) == library.decode(want)
    frame = pieces.encoded(odd, path)
    rows = {r.doc_id: r for r in frame.collect()}
    assert all(r.n_tokens == len(r.ids) for r in rows.values())
    assert all(r.decoded for i, r in rows.items() if i != 7)  # a text with the space mark itself
    back = {r.doc_id: r.text for r in pieces.decoded(frame, path).collect()}
    assert back[1] == "Plain words here." and back[8].endswith(" tail")
    assert pieces.encoded(empty, path).count() == 0


def test_long_stretches_equal_the_library():
    """Stretches worked on in windows, and long runs of spaces."""
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model_of(path)
    rnd = random.Random(9)
    texts = ["".join(rnd.choices(letters, k=rnd.randint(1000, 2600))) for letters in ("ab", "abc ", "the", "etaoinshr", "0123456789", "\u00e1\u00e9iab", "\u4f60\u597dx") for _ in range(4)]
    texts += ["a" * 3000, "ab" * 2000, " " * 3000, " " * 3000 + "x", (" " * 300 + "word") * 8, "supercalifragilistic" * 150, "z" * 1024, "z" * 1025]
    ids, bounds = own.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text)


def test_unigram_models_take_the_best_sum():
    def model_bytes(entries):
        import struct

        def field(n, data):
            return bytes([n << 3 | 2, len(data)]) + data

        out = b""
        for piece, score, kind in entries:
            p = piece.encode()
            out += field(1, field(1, p) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
        return out + field(2, bytes([3 << 3, 1])) + field(3, field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0]))

    entries = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(c, s, 1) for c, s in (("▁", -3.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("▁a", -4.5), ("ba", -2.0), ("aba", -9.0))]
    model = pieces.PieceModel(model_bytes(entries))
    ids, _ = model.encode(pa.array(["aba"]))
    assert [model.pieces[k] for k in ids] == ["▁a", "ba"]


# -- quality


def test_classifier_learns_and_ignores_nothing_but_text(spark):
    rnd = random.Random(5)
    good = [" ".join(rnd.choices(["the", "river", "runs", "quietly", "home"], k=40)) for _ in range(150)]
    bad = [" ".join(rnd.choices(["the$$$", "river###", "BUY!!", "runs%%%", "NOW!!"], k=40)) for _ in range(150)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, good[0])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k < 150 else 0) for k in range(300) if k % 3] + [(None, 1), (5, None)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).collect()
    score = {r.doc_id: r.score for r in rows}
    held = [k for k in range(300) if k % 3 == 0]
    assert sum((score[k] >= 0.5) == (k < 150) for k in held) >= 0.97 * len(held)
    assert score[900] == score[901] and 0 <= score[900] <= 1 and score[None] == score[0]


def test_folded_table_gives_the_softmax(spark):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=(1 << quality.SLOT_BITS, quality.WIDTH)).astype(np.float32), rng.normal(size=(2, quality.WIDTH)).astype(np.float32), 0.3)
    text = "Some words, some words and été"
    data = np.frombuffer(text.encode(), np.uint8)
    slots, _ = quality.features(data, np.array([0, len(data)]))
    logits = model.layer @ model.vectors[slots].mean(0)
    assert model.logits(pa.array([text]))[0] == pytest.approx(logits[1] - logits[0] + 0.3, rel=1e-4)


def test_labels_odds_count_once(spark):
    """A text that says nothing scores by the labels' shares, whether the sample holds all labelled rows or as many of each label."""
    docs = spark.createDataFrame([(k, "neither here nor there") for k in range(440)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 40)) for k in range(440)], "doc_id long, label int")
    for most in (40, 1500):
        assert quality.scored(docs, quality.fit(docs, labels, per_class=most)).first().score == pytest.approx(400 / 440, abs=0.02)


def test_sample_is_2000_of_a_label_and_packs_any_count(spark):
    assert quality.PER_CLASS == 2000
    slots, counts = np.array([0, 5, 9, (1 << quality.SLOT_BITS) - 1]), np.array([1, quality._MOST, quality._MOST + 1, 5 * quality._MOST + 3])
    own, number = quality.unpacked(quality.packed(slots, counts))
    assert {k: number[own == k].sum() for k in slots} == dict(zip(slots.tolist(), counts.tolist(), strict=True))


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert quality.scored(docs, model).first().score == 0.5
