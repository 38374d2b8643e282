"""Language-model scoring with a hierarchical Pitman-Yor model of word trigrams.

A token is predicted from the two tokens before it. Each two words that occur one after the other
are a context restaurant whose dishes are the training tokens after them; a new table sends a
customer to the restaurant of the nearer word alone, which all those contexts share, and a new
table there sends one to the root restaurant of all tokens, whose base is uniform over the known
tokens and one unknown. Seating is sampled by Gibbs sweeps (``seating``), with discounts from the
numbers of dishes with one and two customers and sampled concentrations; after burn-in,
predictive probabilities are averaged over sweeps. They add up to one over the known tokens and one
unknown.

How it is spread: a nearer word's restaurant and all contexts that share it are in one slice, so
both levels are sampled together inside a task. Words that are very frequent have several
restaurants, dealt by the word before them, of about ``HOT`` customers each. The root's dishes are
dealt over slices of their own. Slices first sample under a root of their own making, from their own
dishes, and send their tables to the common root; that one is sampled, and the slices sample again
under it, which gives the probabilities.

What moves: documents are packed into blocks; a block asks for each of its distinct tokens and then
for each of its distinct trigrams once, with the number of times it trains on it, and the answers come back in
the order asked. So counting and scoring are one exchange, and its size grows with the distinct
trigrams of blocks. Texts are cut into tokens once, and a block's trigrams are found once: what it asks is written,
beside the place of each token's trigram among them, and both samplings of the slices read it. Tokens are numbered by falling frequency (in each of the slices that number
them), so that packed numbers are short. Only totals and the list of very frequent words, of
``MOST_HOT`` at most, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packets, seating
from . import text as words
from .runtime import discard, release_shuffles, tidy, written, written_by

BURN_IN, SAMPLES = 2, 4
#: Text bytes of a block, text bytes for each slice of tokens, and tokens for each slice of contexts.
BLOCK_BYTES, TOKEN_BYTES, SLICE_TOKENS = 8 << 20, 32 << 20, 1 << 20
#: Customers of one restaurant of a nearer word; a more frequent word has several.
HOT = 1 << 19
MOST_HOT = 1 << 20
#: The end token's identity.
END = np.uint64(0x5851F42D4C957F2D)
#: Numbers of an unknown token and of the place before a text's first; known tokens follow.
UNKNOWN, START, FIRST = 0, 1, 2
#: Scores travel as whole numbers of this part of a power of ten.
PARTS = 8192
_ROW, _ANSWER, _COUNT, _KINDS, _FREQUENT, _LOST, _OPEN = range(7)
_FIXED = 1 << 20


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, number of tokens before each text and in all): words, then one end per text."""
    parts, ends, i, n = [], [np.zeros(1, np.int64)], 0, len(bounds) - 1
    total = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + words.RUN_BYTES, side="right")) - 1)
        hashed, before, _ = words.words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        out = np.full(len(hashed) + j - i, END, np.uint64)
        out[np.arange(len(hashed)) + np.repeat(np.arange(j - i), np.diff(before))] = hashed
        parts.append(out)
        ends.append(total + before[1:] + np.arange(1, j - i + 1))
        total, i = total + len(out), j
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(ends).astype(np.int64)


def _bits(numbers: np.ndarray) -> int:
    return int(numbers.max()).bit_length() if len(numbers) else 0


def _coded(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first row of each distinct row in ascending order, rank of each row among them)."""
    key, places = columns[0], len(columns[0]).bit_length()
    for column in columns[1:]:
        if _bits(key) + _bits(column) + places > 63:
            key = packets.ranked(key)[1]
        if _bits(key) + _bits(column) + places > 63:
            column = packets.ranked(column)[1]
        key = (key << _bits(column)) | column
    return packets.ranked(key)


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, rank = packets.ranked(numbers)
    return numbers[first], rank


def _changes(numbers: np.ndarray) -> np.ndarray:
    """Whether each number differs from the one before it."""
    out = np.ones(len(numbers), bool)
    out[1:] = numbers[1:] != numbers[:-1]
    return out


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first row of each run, run of each row), given which rows begin one."""
    return np.flatnonzero(new), np.cumsum(new) - 1


def contexts_of(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the token before each token, the one before that); ``START`` before a text's first."""
    near, far = np.empty_like(ids), np.empty_like(ids)
    near[1:], far[2:] = ids[:-1], ids[:-2]
    first = bounds[:-1]
    near[first] = far[first] = START
    second = first + 1
    far[second[second < bounds[1:]]] = START
    return near, far


@dataclass
class Spread:
    """How contexts are dealt over slices."""

    slices: int
    hot: np.ndarray
    parts: np.ndarray

    def slice_of(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        part = np.zeros(len(near), np.uint64)
        if len(self.hot) and len(near):
            at = np.minimum(np.searchsorted(self.hot, near), len(self.hot) - 1)
            some = self.hot[at] == near
            part[some] = words.mixed(far[some].view(np.uint64)) % self.parts[at[some]].astype(np.uint64)
        return (words.mixed(words.mixed(near.view(np.uint64)) ^ part) % np.uint64(self.slices)).astype(np.int64)

    def trigrams(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """([near, token, far] of each distinct trigram by slice and in ascending order, where each token's is, bounds of slices)."""
        near, far = contexts_of(ids, bounds)
        first, code = _coded(near, ids, far)
        rows = [near[first], ids[first], far[first]]
        home = self.slice_of(rows[0], rows[2])
        order = np.sort((home << len(home).bit_length()) | np.arange(len(home))) & ((1 << len(home).bit_length()) - 1)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return [r[order] for r in rows], place[code], np.searchsorted(home[order], np.arange(self.slices + 1))


# -- packing documents and numbering tokens


def _block(documents: list[tuple], ids: int) -> tuple[int, int, int, bytes]:
    """Documents, their tokens by rank among the block's distinct ones, and these."""
    doc, none, train, length, data = (np.concatenate(x) for x in zip(*documents, strict=True))
    tokens, bounds = tokens_of(data, np.concatenate(([0], np.cumsum(length))))
    names, code = _distinct(tokens)
    return ids, _ROW, 0, packets.pack(doc, none, train, np.diff(bounds), code, packets.steps(names))


def _blocks(parts: int):
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            held, size, n = [], 0, 0
            for batch in batches:
                train = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
                none = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                for a, b, data, bounds in words.runs(batch.column(2), BLOCK_BYTES):
                    held.append((doc[a:b], none[a:b], train[a:b], np.diff(bounds), data))
                    size += len(data) + 16 * (b - a)
                    if size >= BLOCK_BYTES:
                        yield _block(held, own + parts * n)
                        held, size, n = [], 0, n + 1
            if held:
                yield _block(held, own + parts * n)

        yield from packets.batches_of(rows())

    return block


def _ask_tokens(slices: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block, _, _, payload in packets.rows_of(batches):
                _, _, train, length, code, names = packets.unpack(payload)
                names = np.cumsum(names.view(np.uint64))
                counts = np.bincount(code, np.repeat(train, length), len(names)).astype(np.int64)
                home = ((names >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
                cuts = np.searchsorted(home, np.arange(slices + 1, dtype=np.uint64))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[s], cuts[s + 1]
                    yield s, _ROW, block, packets.pack(packets.steps(names[a:b]), counts[a:b])

        yield from packets.batches_of(rows())

    return ask


def _number_tokens(slices: int):
    """Answer blocks with tokens' numbers and counts; add the totals of the slice."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for own, asked in packets.groups_of(batches):
                opened = [packets.unpack(payload) for _, _, payload in asked]
                names, code = _distinct(np.concatenate([np.cumsum(x.view(np.uint64)) for x, _ in opened]))
                count = np.bincount(code, np.concatenate([n for _, n in opened]), len(names)).astype(np.int64)
                ids = np.full(len(names), UNKNOWN, np.int64)
                known = np.flatnonzero(count)
                ids[known[np.lexsort((names[known], -count[known]))]] = FIRST + own + slices * np.arange(len(known))
                at = 0
                for (_, block, _), (x, _) in zip(asked, opened, strict=True):
                    own_code = code[at : at + len(x)]
                    yield block, _ANSWER, own, packets.pack(ids[own_code], count[own_code])
                    at += len(x)
                yield -1, _COUNT, int(count.sum()), None
                yield -1, _KINDS, len(known), None
                for k in np.flatnonzero(count > HOT).tolist():
                    yield int(ids[k]), _FREQUENT, int(count[k]), None

        yield from packets.batches_of(rows())

    return number


def _encode(n: int, v: int):
    """Blocks in numbers: documents, their tokens, known tokens and base scores, and all tokens' numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block, found in packets.groups_of(batches):
                doc, none, train, length, code, _ = packets.unpack(found[0][2])
                answers = [packets.unpack(payload) for _, _, payload in found[1:]]
                ids, count = (np.concatenate(x) for x in zip(*answers, strict=True))
                base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
                first = np.cumsum(length) - length
                sums = [np.add.reduceat(x[code], first) for x in ((count > 0).astype(np.int64), base)]
                yield block, _ROW, 0, packets.pack(doc, none, train, length, sums[0], sums[1].view(np.int64), ids[code])

        yield from packets.batches_of(rows())

    return encode


# -- contexts


def _ask_trigrams(spread: Spread):
    """What blocks ask of slices, and blocks with the place of each token's trigram in that instead of its number."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block, _, _, payload in packets.rows_of(batches):
                *documents, ids = packets.unpack(payload)
                train, length = documents[2:4]
                (near, token, far), place, cuts = spread.trigrams(ids, np.concatenate(([0], np.cumsum(length))))
                yield block, _ROW, 0, packets.pack(*documents, place)
                n = np.bincount(place, np.repeat(train, length), len(near)).astype(np.int64)
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[s], cuts[s + 1])
                    yield s, _ANSWER, block, packets.pack(packets.steps(near[own]), token[own], far[own], n[own])

        yield from packets.batches_of(rows())

    return ask


class Contexts:
    """The restaurants of a slice, from all that blocks have asked of it."""

    def __init__(self, asked: list[list[np.ndarray]]) -> None:
        near = np.concatenate([np.cumsum(a[0]) for a in asked])
        token, far, n = (np.concatenate([a[k] for a in asked]) for k in (1, 2, 3))
        first, self.code = _coded(near, token, far)
        near, token, far = near[first], token[first], far[first]
        n = np.bincount(self.code, n, len(near)).astype(np.int64)
        other = _changes(near)
        pair, self.of = _runs(other | _changes(token))
        self.names, self.token = _distinct(token[pair])
        restaurants, group = _coded(near, far)
        heads, head = _runs(other[pair])
        self.lower = seating.Level(n, group, len(restaurants))
        self.upper = seating.Level(np.bincount(self.of, n > 0, len(pair)), head, len(heads))

    def sweep(self, root: np.ndarray, rng: np.random.Generator) -> None:
        """One sweep under the root's probabilities of ``names``."""
        seating.two_levels(self.upper, self.lower, self.of, root[self.token], rng)

    def sent(self) -> np.ndarray:
        """Customers at the root for each of ``names``."""
        return np.bincount(self.token, self.upper.tables, len(self.names)).astype(np.int64)

    def averaged(self, root: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Each trigram's averaged probability."""
        mean = np.zeros(len(self.of))
        for sweep in range(BURN_IN + SAMPLES):
            self.sweep(root, rng)
            if sweep >= BURN_IN:
                mean += self.lower.predicted(self.upper.predicted(root[self.token])[self.of])
        return mean / SAMPLES


def _generator(stage: int, seed: int, own: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([stage, seed, own]))


def _root_slice(ids: np.ndarray, slices: int) -> np.ndarray:
    return (words.mixed(ids.view(np.uint64)) % np.uint64(slices)).astype(np.int64)


def _send_tables(seed: int, root_slices: int, v: int):
    """Sample each slice under a root of its own and send the tables to the common one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for own, asked in packets.groups_of(batches):
                here, rng = Contexts([packets.unpack(payload) for _, _, payload in asked]), _generator(1, seed, own)
                for _ in range(BURN_IN):
                    customers = here.sent()
                    here.sweep((customers + 0.5) / (customers.sum() + 0.5 * (v + 1)), rng)
                tables, home = here.sent(), _root_slice(here.names, root_slices)
                for r in np.unique(home).tolist():
                    k = home == r
                    yield r, _ROW, own, packets.pack(packets.steps(here.names[k]), tables[k])

        yield from packets.batches_of(rows())

    return send


def root_masses(customers: np.ndarray, slices: int, v: int, seed: int, own: int) -> tuple[np.ndarray, float, float]:
    """(customers less discounted tables of each dish of a slice of the root, all discounted tables, the concentration), averaged."""
    rng, level = _generator(2, seed, own), seating.Level(customers, np.zeros(len(customers), np.int64), 1)
    mass, lost, concentration = np.zeros(len(customers)), 0.0, 0.0
    base = np.full(len(customers), 1.0 / (v + 1))
    for sweep in range(BURN_IN + SAMPLES):
        level.opened *= slices  # the other slices' tables, taken to be as many as here
        level.sweep(base, rng)
        level.opened = np.array([level.tables.sum()])
        if sweep >= BURN_IN:
            mass += customers - level.discount * level.tables
            lost += level.discount * float(level.tables.sum())
            concentration += level.concentration
    return mass / SAMPLES, lost / SAMPLES, concentration / SAMPLES


def _seat_root(seed: int, root_slices: int, v: int):
    """Answer context slices with the root's masses; add totals."""

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for own, asked in packets.groups_of(batches):
                opened = [packets.unpack(payload) for _, _, payload in asked]
                names, code = _distinct(np.concatenate([np.cumsum(x) for x, _ in opened]))
                customers = np.bincount(code, np.concatenate([n for _, n in opened]), len(names)).astype(np.int64)
                mass, lost, concentration = root_masses(customers, root_slices, v, seed, own)
                bits = mass.astype(np.float32).view(np.uint32)
                at = 0
                for (_, source, _), (x, _) in zip(asked, opened, strict=True):
                    yield source, _ROW, own, packets.pack(bits[code[at : at + len(x)]])
                    at += len(x)
                yield -1, _COUNT, int(customers.sum()), None
                for kind, amount in ((_LOST, lost), (_OPEN, concentration / root_slices)):
                    yield -1, kind, round(amount * _FIXED), None

        yield from packets.batches_of(rows())

    return seat


def _answer_trigrams(seed: int, root_slices: int, opening: float, total: float, v: int):
    """Sample each slice under the common root and answer blocks with their trigrams' log10 probabilities."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for own, found in packets.groups_of(batches):
                asked = [(block, packets.unpack(payload)) for kind, block, payload in found if kind == _ANSWER]
                here, rng = Contexts([a for _, a in asked]), _generator(3, seed, own)
                home, root = _root_slice(here.names, root_slices), np.zeros(len(here.names))
                for kind, r, payload in found:
                    if kind == _ROW:
                        root[home == r] = packets.unpack(payload)[0].astype(np.uint32).view(np.float32)
                root = (root + opening / (v + 1)) / total
                score = np.rint(-PARTS * np.log10(here.averaged(root, rng))).astype(np.int64)
                at = 0
                for block, a in asked:
                    yield block, _ANSWER, own, packets.pack(score[here.code[at : at + len(a[0])]])
                    at += len(a[0])

        yield from packets.batches_of(rows())

    return answer


_SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _add_up(n: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in packets.groups_of(batches):
            doc, none, train, length, known, base, place = packets.unpack(found[0][2])
            answers = np.concatenate([packets.unpack(payload)[0] for _, _, payload in found[1:]])
            score = -np.add.reduceat(answers[place], np.cumsum(length) - length) / PARTS
            columns = [pa.array(doc, mask=none.astype(bool)), pa.array(train.astype(bool)), pa.array(length), pa.array(known), pa.array(np.full(len(doc), n))]
            columns += [pa.array(base.view(np.float64)), pa.array(score), pa.array(10.0 ** np.minimum(-score / length, 300.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCORES.split(", ")])

    return add


def _totals(rows: DataFrame) -> dict[int, int]:
    return {r["kind"]: r["n"] for r in rows.where("to = -1").groupBy("kind").agg(F.sum("source").alias("n")).collect()}


def scored(documents: DataFrame, seed: int = 0) -> DataFrame:
    """Per row of ``documents`` (doc_id, train, text): doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are words, runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased, and one end
    per text. The model learns from rows whose ``train`` is true (null: false). ``base_score`` is the
    sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))), ``score`` the model's log10 probability of
    the text, ``perplexity`` 10 ** (-score / n_tokens).

    A null or empty text, or one without words, is one end token. A null doc_id stays null. Repeated
    rows score alike, and each of them trains. Texts are worked on whole, however long. An
    empty table gives an empty result, and without training rows every token is unknown. Columns other than
    the three are not read, whatever their names. The result doesn't depend on the rows' order or
    partitions.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("train").cast("boolean").alias("train"), "text")
    parts = rows.rdd.getNumPartitions()
    blocks = written(rows.mapInArrow(tidy(_blocks(parts)), packets.SCHEMA), "blocks")
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size, n_blocks = (size[0] or 0) + 8 * size[1], blocks.count()

    slices = max(1, -(-size // TOKEN_BYTES))
    asked = packets.gathered(blocks.mapInArrow(tidy(_ask_tokens(slices)), packets.SCHEMA), slices)
    known = written(asked.mapInArrow(tidy(_number_tokens(slices)), packets.SCHEMA), "tokens")
    del asked
    sums = _totals(known)
    n, v = sums.get(_COUNT, 0), sums.get(_KINDS, 0)
    found = blocks.unionByName(known.where(F.col("kind") == _ANSWER))
    coded = written(packets.gathered(found, n_blocks).mapInArrow(tidy(_encode(n, v)), packets.SCHEMA), "numbers")
    parted = max(HOT, n // MOST_HOT)
    hot = sorted((r["to"], -(-r["source"] // parted)) for r in known.where((F.col("kind") == _FREQUENT) & (F.col("source") > parted)).collect())
    for done in (blocks, known):
        discard(done)
    del found
    release_shuffles(spark)

    spread = Spread(max(1, -(-n // SLICE_TOKENS)), *np.array(hot, np.int64).reshape(-1, 2).T.copy())
    placed, asked = written_by(coded.mapInArrow(tidy(_ask_trigrams(spread)), packets.SCHEMA), "trigrams", "kind", (_ROW, _ANSWER))
    discard(coded)
    sent = packets.gathered(asked, spread.slices).mapInArrow(tidy(_send_tables(seed, slices, v)), packets.SCHEMA)
    root = written(packets.gathered(sent, slices).mapInArrow(tidy(_seat_root(seed, slices, v)), packets.SCHEMA), "root")
    sums = _totals(root)
    customers, lost, concentration = sums.get(_COUNT, 0), sums.get(_LOST, 0) / _FIXED, sums.get(_OPEN, _FIXED) / _FIXED
    del sent
    release_shuffles(spark)

    both = asked.unionByName(root.where(F.col("kind") == _ROW))
    answer = _answer_trigrams(seed, slices, lost + concentration, customers + concentration, v)
    answers = written(packets.gathered(both, spread.slices).mapInArrow(tidy(answer), packets.SCHEMA), "answers")
    for done in (asked, root):
        discard(done)
    del both
    release_shuffles(spark)
    return packets.gathered(placed.unionByName(answers), n_blocks).mapInArrow(tidy(_add_up(n)), _SCORES)
