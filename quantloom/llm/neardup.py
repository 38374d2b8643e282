"""MinHash near-duplicate groups.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form a
class, and one document stands for each class from then on. Per set, many universal hash minima
are taken; bands of them name buckets, and the minima's lowest bits are kept as a signature.

Links are found in two passes. In the first, each bucket links its members to its smallest one.
In the second, members of one bucket that are still in different components are compared with
each other, inside a task. Pairs whose signatures are too far apart are left out, every other pair
is confirmed on the full sets, and components are formed by alternating large-star and small-star.
Pairs within one component need no look, as they cannot change it; so a bucket of very many
copies costs one row per copy and not one per pair, and no pair that could join two components is
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from . import text as words
from .components import components
from .runtime import discard, tidy, written

#: Bands of rows of minima. A pair of similarity 0.8 shares no band with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
MINIMA = BANDS * ROWS
#: Lowest bits of this many minima are compared; a pair of similarity s differs in (1 - s) / 2 of them.
BITS = 240
#: Standard deviations that a linked pair's signatures may stray.
STRAY = 6.0
#: A list of ids up to this long is broadcast (8 bytes each); a longer one is joined by shuffling.
MOST_BROADCAST = 1 << 20

_random = np.random.Generator(np.random.PCG64(5))
_FACTOR = _random.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, MINIMA, dtype=np.uint64)
_CHUNK = 2048
#: Members of a bucket that are compared with each other at once, rows a task holds, and columns of the matrices.
BLOCK, _PORTION, _COLUMNS = 512, 1 << 14, 1 << 13


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash a * x + b (mod 2**64) over the set."""
    with np.errstate(over="ignore"):
        out = np.full(MINIMA, 2**64 - 1, np.uint64)
        for k in range(0, len(shingles), _CHUNK):
            part = np.multiply.outer(_FACTOR, shingles[k : k + _CHUNK])
            part += _ADD[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out


def _bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band's bucket."""
    with np.errstate(over="ignore"):
        name = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in words.mixed(least).reshape(BANDS, ROWS).T:
            name = words.mixed(name ^ column)
    return name.view(np.int64)


def _signature(least: np.ndarray) -> np.ndarray:
    bits = np.zeros(256, np.uint8)
    bits[:BITS] = (words.mixed(least ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(1))[:BITS]
    return np.packbits(bits).view(np.int64)


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's set of shingles of ``size`` words, as sorted hashes."""
    for first, last, data, bounds in words.runs(texts):
        hashed, before, _ = words.words(data, bounds)
        for k in range(last - first):
            yield words.shingles(hashed[before[k] : before[k + 1]], size)


_SKETCH = "n_shingles long, k1 long, k2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _sketches(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, two keys of the set, four words of signature, bands) per document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, 7), np.int64)
            bands = np.zeros((batch.num_rows, BANDS), np.int64)
            with np.errstate(over="ignore"):
                for k, own in enumerate(sets_of(batch.column(1), size)):
                    if len(own):
                        least = minima(own)
                        keys = np.array([own.sum(), words.mixed(own ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum()], np.uint64)
                        rows[k] = [len(own), *keys.view(np.int64), *_signature(least)]
                        bands[k] = _bands(least)
            full = rows[:, 0] > 0
            ends = np.concatenate(([0], np.cumsum(full * BANDS))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[full].ravel()))
            names = ["doc_id", "n_shingles", "k1", "k2", "s0", "s1", "s2", "s3", "bands"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in rows.T), listed], names=names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(sketch), "doc_id long, " + _SKETCH)


def _most_differing(similarity: float) -> int:
    share = (1 - similarity) / 2
    return int(BITS * share + STRAY * (BITS * share * (1 - share)) ** 0.5)


def _close(similarity: float):
    """A condition on signatures a.s*, b.s* and sizes that linked pairs meet but for one in a billion."""
    most = _most_differing(similarity)
    differ = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(1, 4)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    small, large = F.least("a.n_shingles", "b.n_shingles"), F.greatest("a.n_shingles", "b.n_shingles")
    return (differ <= most) & (small * 100 >= large * round(similarity * 100))


def _texts_of(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents listed in ``ids``."""
    ids = ids.distinct()
    ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    return written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"), "texts")


def confirmed(pairs: DataFrame, documents: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts' full sets are similar enough."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), documents)
    sided = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    needed = round(similarity * 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(sets_of(batch.column(2), size), sets_of(batch.column(3), size), strict=True):
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= needed * (len(one) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return sided.select("a", "b", "ta", "tb").mapInArrow(tidy(compare), "a long, b long").distinct()


def _candidates(rows: pa.Table, a: int, b: int, bands: np.ndarray, similarity: float) -> np.ndarray:
    """Among rows a to b, one group, which pairs are to be confirmed here (above the diagonal).

    Those of different components, on different sides if there are two, close by size and
    signature, and without an earlier band in common, where they would have met before.
    """
    column = {name: rows.column(name).to_numpy()[a:b] for name in ("root", "side", "n_shingles", "band", "s0", "s1", "s2", "s3")}
    root, side, n = column["root"], column["side"], column["n_shingles"]
    small, large = np.minimum.outer(n, n), np.maximum.outer(n, n)
    pair = np.triu((root[:, None] != root) & ((side < 0) | (side[:, None] != side)) & (small * 100 >= large * round(similarity * 100)), 1)
    if not pair.any():
        return pair
    # numpy counts the bits of a signed number's absolute value, so the words are taken as unsigned
    signed = [column[f"s{k}"].view(np.uint64) for k in range(4)]
    differ = sum(np.bitwise_count(s[:, None] ^ s).astype(np.int64) for s in signed)
    pair &= differ <= _most_differing(similarity)
    own = bands[a:b]
    for k in range(int(column["band"][0])):
        if not pair.any():
            break
        pair &= own[:, k][:, None] != own[:, k]
    return pair


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over runs of shingles."""
    shingle, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = count > 1
    rank = np.cumsum(common) - 1
    place, owner = rank[place][common[place]], owner[common[place]]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for s in range(0, int(common.sum()), _COLUMNS):
        lo, hi = np.searchsorted(place, (s, s + _COLUMNS))
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[owner[lo:hi], place[lo:hi] - s] = 1
        out += has @ has.T
    return out


def _crossing(shared: DataFrame, found: DataFrame, classes: DataFrame, documents: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (u, v) between different components of ``found`` whose members share a bucket.

    Members of one bucket are compared in the bucket's own task, a large bucket's in blocks, in which
    the members of its most frequent component meet the others but not each other: first by signature, to learn which members need their texts, then on the full sets. What a task emits
    are members and, of the links it finds, stars; never pairs.
    """
    placed = shared.join(found, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("root"))
    apart = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    marks = classes.select("id", "n_shingles", "s0", "s1", "s2", "s3", "bands")
    placed = placed.join(apart, "bucket")
    most = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    placed = placed.join(most, "bucket").withColumn("alike", F.col("root") == F.col("most")).drop("most").join(marks, "id")
    placed = written(placed.withColumn("band", (F.array_position("bands", F.col("bucket")) - 1).cast("int")), "apart")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in blocks.whole_groups(batches, "bucket", _PORTION):
            bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
            some = np.zeros(rows.num_rows, bool)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pair = _candidates(rows, a, b, bands, similarity)
                some[a:b] = pair.any(0) | pair.any(1)
            yield from rows.select(["bucket", "id"]).filter(pa.array(some)).combine_chunks().to_batches()

    needed = blocks.dealt(placed, "bucket", "id", BLOCK, alike="alike").mapInArrow(tidy(flag), "bucket long, id long").distinct()
    needed = written(needed, "needed")
    texts = _texts_of(needed.select(F.col("id").alias("doc_id")), documents)
    full = placed.join(needed, ["bucket", "id"]).join(texts, F.col("id") == F.col("doc_id")).drop("doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in blocks.whole_groups(batches, "bucket", BLOCK):
            bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
            ids = rows.column("id").to_numpy()
            sets = list(sets_of(rows.column("text"), size))
            one, other = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pair = _candidates(rows, a, b, bands, similarity)
                if pair.any():
                    n = np.array([len(x) for x in sets[a:b]])
                    both = _shared_counts(sets[a:b])
                    i, j = np.nonzero(pair & (both > 0) & (100 * both >= round(similarity * 100) * (n[:, None] + n - both)))
                    one.append(i + a)
                    other.append(j + a)
            if one and len(i := np.concatenate(one)):
                names, root = blocks.roots(ids, i, np.concatenate(other))
                yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(names)], names=["u", "v"])

    return blocks.dealt(full, "bucket", "id", BLOCK, alike="alike").mapInArrow(tidy(compare), "u long, v long").where("u <> v").distinct()


def near_duplicates(documents: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of ``documents``: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased; a text of fewer
    words than ``size`` has its whole sequence as its one shingle. Documents whose sets' Jaccard
    similarity is ``similarity`` or more are linked; ``component_id`` is the smallest doc_id
    reachable by links, itself included, and ``kept`` says that it is the row's own.

    A null or empty text, or one without words, has an empty set and is linked with nothing. A
    row without doc_id is linked with nothing, has no component_id and is kept. Repeated rows are
    of one component and alike; rows of one doc_id with several texts are one document that is
    linked as any of its texts is. Texts are read whole. An empty table gives an empty result.
    Columns other than doc_id and text are not read.
    """
    sketches = written(_sketches(documents, size), "sketches")
    key = ["n_shingles", "k1", "k2"]
    able = sketches.where("doc_id is not null and n_shingles > 0")
    rest = [F.first(c).alias(c) for c in ("s0", "s1", "s2", "s3", "bands")]
    classes = written(able.groupBy(*key).agg(F.min("doc_id").alias("id"), *rest), "classes")
    marks = classes.select("id", "n_shingles", "s0", "s1", "s2", "s3")

    def close(pairs: DataFrame) -> DataFrame:
        joined = pairs.alias("p").join(marks.alias("a"), F.col("p.a") == F.col("a.id")).join(marks.alias("b"), F.col("p.b") == F.col("b.id"))
        return joined.where(_close(similarity)).select("p.a", "p.b").distinct()

    members = classes.select("id", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last")
    shared = written(members.join(heads, "bucket"), "buckets")
    first = written(close(shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()), "pairs")
    links = written(confirmed(first, documents, size, similarity).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    found = components(links)

    more = written(_crossing(shared, found, classes, documents, size, similarity), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # a doc_id with several texts holds its classes together
    several = able.groupBy("doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x <> y").select("doc_id")
    if not several.isEmpty():
        ids = classes.select(*key, "id")
        also = able.join(several, "doc_id", "left_semi").join(ids, key).select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
        stars = found.select(F.col("component").alias("u"), F.col("node").alias("v"))
        found = components(stars.unionByName(also))
    for done in (shared, first):
        discard(done)
    id_of = classes.select(*key, "id").join(found, F.col("id") == F.col("node"), "left").select(*key, F.coalesce("component", "id").alias("__c"))
    rows = sketches.select("doc_id", *key).join(id_of, key, "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("__c")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(documents: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``documents`` with one document of each near-duplicate group, the one with the smallest doc_id.

    Rows without doc_id, and texts without words, are kept. Of several rows with one doc_id the
    first by text and then by the other columns stays.
    """
    gone = near_duplicates(documents, size, similarity).where("not kept").select("doc_id").distinct()
    gone = written(gone, "duplicates")
    small = gone.count() <= MOST_BROADCAST
    rest = documents.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
    several = documents.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    several = written(several, "repeated")
    if several.isEmpty():
        return rest
    order = [F.col("text"), *[F.col(f"`{c}`") for c in documents.columns if c != "text"]]
    once = rest.join(several, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
    first = rest.join(several, "doc_id", "left_semi").withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return once.unionByName(first.where("__k = 1").select(*[F.col(f"`{c}`") for c in documents.columns]))
