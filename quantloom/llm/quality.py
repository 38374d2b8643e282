"""Quality classifier: supervised subword embeddings.

A document's features are its words, its pairs of neighbouring words, and the byte 3- and 4-grams
within words and their borders, each hashed into a table of learned vectors. The vectors' average goes through a softmax layer.
Vectors and layer are trained together by numpy stochastic gradient descent with per-coordinate
step sizes, on the driver, over a bounded sample of labelled documents.

Scoring uses that averaging and the layer are linear: the layer is folded into the table first, so
that a feature costs one look-up and a document's logit is the average of its features' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as words
from .runtime import tidy

#: Slots of the hashed table and length of its vectors.
SLOT_BITS, WIDTH = 18, 8
_MOST = (1 << (32 - SLOT_BITS)) - 1
#: Labelled documents per class that are trained on, those with the smallest hashes of doc_id: the documented bound of the sample.
PER_CLASS = 2000
EPOCHS, BATCH, STEP = 8, 32, 0.25
#: Text bytes worked on at a time; a feature takes some 40 bytes while it is made.
_RUN_BYTES = 1 << 18


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each feature, number of features before each text and in all) for a run of texts.

    Features of a text are its words (A-Z lower-cased), then its pairs of words, then its 3-grams
    and its 4-grams of bytes, of which no inner byte is white space; white space and the text's ends
    all count as a blank. A pair's hash is its words' hashes' exclusive or, so that all repetitions
    of a word are one feature, whatever the word.
    """
    n = len(bounds) - 1
    hashed, before, _ = words.words(data, bounds)
    slots = [(hashed >> np.uint64(64 - SLOT_BITS)).astype(np.int32)]
    counts = [np.diff(before)]
    inner = np.ones(max(0, len(hashed) - 1), bool)
    inner[before[(before > 0) & (before < len(hashed))] - 1] = False  # not across texts
    pairs = words.mixed(hashed[:-1] ^ hashed[1:])[inner]
    slots.append((pairs >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
    counts.append(np.maximum(0, np.diff(before) - 1))
    padded = np.full(len(data) + n + 1, 0x20, np.uint32)
    start = bounds + np.arange(n + 1)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(bounds))
    padded[place] = np.where(words._SPACES[data], np.uint8(0x20), data)
    solid = padded != 0x20
    for size, factor in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        if len(padded) < size:
            slots.append(np.zeros(0, np.int32))
            counts.append(np.zeros(n, np.int64))
            continue
        whole = solid[1 : len(padded) - size + 2].copy()
        for k in range(2, size - 1):
            whole &= solid[k : len(padded) - size + 1 + k]
        at = np.flatnonzero(whole)
        with np.errstate(over="ignore"):
            code = padded[at]
            for k in range(1, size):
                code = (code << np.uint32(8)) | padded[at + k]
            code = (code ^ (code >> np.uint32(15))) * np.uint32(factor)
            code = (code ^ (code >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        slots.append((code >> np.uint32(32 - SLOT_BITS)).astype(np.int32))
        counts.append(np.diff(np.searchsorted(at, start)))
    per = np.array(counts)
    ends = np.concatenate(([0], np.cumsum(per.sum(0))))
    out = np.empty(ends[-1], np.int32)
    shift = ends[:-1].copy()
    for own, number in zip(slots, per, strict=True):
        own_ends = np.concatenate(([0], np.cumsum(number)))
        out[np.arange(len(own)) + np.repeat(shift - own_ends[:-1], number)] = own
        shift += number
    return out, ends


@dataclass
class Model:
    """Vectors by slot, the layer's weights per class, and a constant for the classes' shares."""

    vectors: np.ndarray
    layer: np.ndarray
    shift: float

    def table(self) -> np.ndarray:
        """Per slot, what a feature adds to the logit of label 1."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32)

    def logits(self, texts: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
        table = self.table() if table is None else table
        out = np.zeros(len(texts))
        for first, last, data, bounds in words.runs(texts, _RUN_BYTES):
            slots, ends = features(data, bounds)
            total = np.concatenate(([0.0], np.cumsum(table[slots], dtype=np.float64)))
            out[first:last] = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(1, np.diff(ends))
        return out + self.shift


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def packed(slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Slots with their counts in 32 bits each; a count that has no room takes several entries."""
    times = -(-counts // _MOST)
    slot, left = np.repeat(slots, times), np.full(int(times.sum()), _MOST)
    left[np.cumsum(times) - 1] = counts - (times - 1) * _MOST
    return (slot.astype(np.uint32) << np.uint32(32 - SLOT_BITS)) | left.astype(np.uint32)


def unpacked(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (features >> np.uint32(32 - SLOT_BITS)).astype(np.int64), (features & np.uint32(_MOST)).astype(np.float32)


def train(samples: list[tuple[int, np.ndarray]], shares: tuple[float, float], seed: int = 0) -> Model:
    """A model from (label, packed slots and counts) per document; ``shares`` are the labels' counts in all the data.

    Documents are weighted so that both labels weigh the same, however many the sample has of each;
    then the logit is shifted by the log odds of the labels in all the data.
    Without documents of both labels the vectors stay untrained at zero and the shift decides.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    n = 1 << SLOT_BITS
    shift = float(np.log((shares[1] + 1) / (shares[0] + 1)))
    if len({label for label, _ in samples}) < 2:
        return Model(np.zeros((n, WIDTH), np.float32), np.zeros((2, WIDTH), np.float32), shift)
    vectors = rng.uniform(-0.5, 0.5, (n, WIDTH)).astype(np.float32) / WIDTH
    layer = rng.uniform(-0.5, 0.5, (2, WIDTH)).astype(np.float32)
    seen, seen_layer = np.full(n, 1e-6, np.float32), 1e-6
    weight = len(samples) / (2 * np.bincount([x[0] for x in samples], minlength=2))
    for epoch in range(EPOCHS):
        order, step = rng.permutation(len(samples)), STEP * (1 - epoch / EPOCHS)
        for s in range(0, len(order), BATCH):
            some = [(samples[k][0], *unpacked(samples[k][1])) for k in order[s : s + BATCH]]
            slots = np.concatenate([x[1] for x in some])
            length = np.array([len(x[1]) for x in some])
            doc = np.repeat(np.arange(len(some)), length)
            share = np.concatenate([x[2] / max(1.0, x[2].sum()) for x in some]).astype(np.float32)
            held = vectors[slots] * share[:, None]
            mean = np.stack([np.bincount(doc, held[:, k], len(some)) for k in range(WIDTH)], 1).astype(np.float32)
            wrong = _softmax(mean @ layer.T)
            own = np.array([x[0] for x in some])
            wrong[np.arange(len(some)), own] -= 1
            wrong = (wrong * weight[own, None] / len(some)).astype(np.float32)
            used, place = np.unique(slots, return_inverse=True)
            each = (wrong @ layer)[doc] * share[:, None]
            to_vectors = np.stack([np.bincount(place, each[:, k], len(used)) for k in range(WIDTH)], 1).astype(np.float32)
            to_layer = wrong.T @ mean
            seen[used] += np.square(to_vectors).mean(1)
            seen_layer += float(np.square(to_layer).mean())
            vectors[used] -= step * to_vectors / np.sqrt(seen[used])[:, None]
            layer -= step * to_layer / np.float32(np.sqrt(seen_layer))
    return Model(vectors, layer, shift)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 0) -> Model:
    """Train on up to ``per_class`` documents of each label.

    ``labels`` holds (doc_id, label 0 or 1); rows with a null are left out, and a doc_id labelled
    both ways counts as 0. Of several texts of one doc_id the one with the least hash is taken. Label shares are counted over all of ``labels``. What comes to the driver
    are the sample's features, bounded by ``per_class``.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    counted = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = documents.select("doc_id", "text", F.xxhash64("text").alias("first")).join(F.broadcast(chosen), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, last, data, bounds in words.runs(batch.column(1), _RUN_BYTES):
                slots, ends = features(data, bounds)
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    rows.append(packed(*np.unique(slots[a:b], return_counts=True)).tobytes())
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first", "label", "features"])

    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(tidy(featured), f"doc_id {kind}, first long, label int, features binary")
    found = rows.groupBy("doc_id", "label").agg(F.min_by("features", F.struct("first", "features")).alias("features")).collect()
    found.sort(key=lambda r: (r["label"], r["doc_id"]))
    samples = [(r["label"], np.frombuffer(r["features"], np.uint32)) for r in found]
    del found
    return train(samples, (counted.get(0, 0), counted.get(1, 0)), seed)


def scored(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with the probability of label 1; a column called ``name`` is replaced.

    Texts are read whole. Null and empty texts have no features and score by the labels' shares
    alone; repeated rows score alike; an empty table gives an empty result. The score depends on
    the text only.
    """
    kept = documents.drop(name)
    at = kept.columns.index("text")
    table, shift = model.table(), model.shift

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(np.zeros((0, WIDTH)), np.zeros((2, WIDTH)), shift)
        for batch in batches:
            value = 1 / (1 + np.exp(-np.clip(own.logits(batch.column(at), table), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, name])

    return kept.mapInArrow(tidy(score), kept.withColumn(name, F.lit(0.0)).schema)
