"""SentencePiece encoding and decoding in batched numpy.

Texts are cut into stretches, a run of the space mark and what follows it; no piece reaches across
such a cut. Each distinct stretch is encoded once. Stretches of equal length advance together
through a Viterbi lattice: at each character, the hashes of the substrings that end there probe
the sorted hashes of the pieces, the possible pieces are weighed, and a vectorised maximum keeps
the best as a backpointer.

For a unigram model a path's weight is the sum of its pieces' scores. A BPE model's result is not
the best of any sum of scores, so a path counts only if each two neighbours on it are what merging
makes of them put together; of a stretch's paths exactly one is such, and it is what merging makes
of the stretch. Whether two pieces can be neighbours is found, again for arrays of pairs, by
undoing their merges from the latest on and looking for a merge across their border that would
have come first.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .runtime import tidy
from .text import mixed

#: Fixed values of the public model format: piece types, model types, the space mark.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Texts are worked on in runs of about this many bytes, and stretches in groups of this many characters.
RUN_BYTES, GROUP_CHARS = 3 << 20, 1 << 17
#: Stretches of a BPE model of more than this many characters are worked on in windows, with so many characters in common.
LONG, WINDOW, OVERLAP = 1024, 512, 64
#: Stretches that a worker remembers.
MOST_KNOWN = 3 << 16
_CACHE_BITS = 20
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _ends(size: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(size)))


def _gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = _ends(size)
    return pool[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends


class Keys:
    """Sorted hashes with the ids that they stand for, found by their leading bits first."""

    BITS = 17

    def __init__(self, hashes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes)
        self.keys = np.append(hashes[order], _U(0))
        self.ids = np.append(ids[order], -1).astype(np.int64)
        edges = np.arange(1 << self.BITS, dtype=np.uint64) << _U(64 - self.BITS)
        self.first = np.append(np.searchsorted(self.keys[:-1], edges), len(hashes)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(hashes) else 0

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each hash, or -1."""
        lead = (hashes >> _U(64 - self.BITS)).astype(np.int32)
        at, end = self.first[lead], self.first[lead + 1]
        out = np.where((at < end) & (self.keys[at] == hashes), self.ids[at], -1)
        rest = np.flatnonzero(end - at > 1)
        for step in range(1, self.most):
            rest = rest[end[rest] - at[rest] > step]
            if not len(rest):
                break
            hit = self.keys[at[rest] + step] == hashes[rest]
            out[rest[hit]] = self.ids[at[rest[hit]] + step]
        return out


class PieceModel:
    """A model file with an identity normaliser, a leading space mark and byte fallback."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.kind, normaliser = UNIGRAM, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1):
            raise ValueError("only models with an identity normaliser, a leading mark and all white space kept are supported")
        self.scores, self.kinds = np.array(scores), np.array(kinds)
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        bytes_ = {int(self.pieces[k][3:5], 16): int(k) for k in np.flatnonzero(self.kinds == BYTE)}
        self.byte_ids = np.array([bytes_.get(b, self.unknown) for b in range(256)], np.int32)
        self.known: dict[str, dict[str, bytes]] = {MARK: {}, "": {}}
        self.free = len(self.pieces)  # stands for a character that is no piece
        self._index()

    # -- hashes of pieces, and how each is put together

    def _index(self) -> None:
        usable = np.flatnonzero((self.kinds == NORMAL) | (self.kinds == USER))
        self.lengths = np.ones(self.free + 1, np.int64)
        self.lengths[:-1] = [len(p) for p in self.pieces]
        self.longest = int(self.lengths[usable].max())
        self.powers = np.array([pow(_BASE, k, 2**64) for k in range(self.longest * 2 + 1)], np.uint64)
        self.hashes = mixed(np.arange(self.free + 1, dtype=np.uint64) ^ _U(0xABCDEF0123456789))
        for k in usable:
            self.hashes[k] = self._hash(self.pieces[k])
        self.probe = Keys(self.hashes[usable], usable)
        if self.kind != BPE:
            self.weight = np.append(self.scores, self.scores[usable].min() - 10.0)
            return
        # rank: when merging makes a piece, the best score first; single characters are there from the start
        self.rank = np.full(self.free + 1, -1.0)
        longer = usable[self.lengths[usable] > 1]
        self.rank[longer] = -self.scores[longer]
        self.left, self.right = np.full(self.free + 1, -1, np.int64), np.full(self.free + 1, -1, np.int64)
        self.by_text = {self.pieces[k]: int(k) for k in usable}
        reached = np.zeros(self.free + 1, bool)
        reached[usable[self.lengths[usable] == 1]] = reached[self.free] = True
        for k in longer:
            parts = self.merged(self.pieces[k], stop=True)
            if len(parts) == 2 and all(p in self.by_text for p in parts):
                self.left[k], self.right[k] = (self.by_text[p] for p in parts)
                reached[k] = True
        self.probe_any, usable = self.probe, usable[reached[usable]]
        self.probe = Keys(self.hashes[usable], usable)
        self.pair_key = np.full(1 << _CACHE_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << _CACHE_BITS, bool)

    def _hash(self, text: str) -> np.uint64:
        total = 0
        for char in text:
            total = (total * _BASE + int(_CHAR(ord(char)))) % 2**64
        return _U(total)

    def merged(self, text: str, stop: bool = False) -> list[str]:
        """What merging makes of a stretch, the best and then the leftmost merge first; with ``stop``, before it would be a single piece.

        Parts are a linked list, and possible merges wait in a heap; one whose parts have changed since is passed over.
        """
        n = count = len(text)
        parts: list[str] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (piece := self.by_text.get(parts[i] + parts[j])) is not None:
                heapq.heappush(waiting, (-float(self.scores[piece]), i, len(parts[i]), len(parts[j])))

        for i in range(n - 1):
            offer(i)
        while waiting and count > (2 if stop else 1):
            _, i, own, other = heapq.heappop(waiting)
            j = after[i]
            if len(parts[i]) != own or j >= n or len(parts[j]) != other:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[j] < n:
                before[after[j]] = i
            count -= 1
            offer(before[i])
            offer(i)
        return [part for part in parts if part]

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces x and y, put together, as they are."""
        key = x * (self.free + 1) + y
        slot = (mixed(key.astype(np.uint64)) >> _U(64 - _CACHE_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.pair_key[slot] != key)
        out = self.pair_fits[slot]
        if len(miss):
            new, place = np.unique(key[miss], return_inverse=True)
            found = self._fits(new // (self.free + 1), new % (self.free + 1))
            out[miss] = found[place]
            slot = (mixed(new.astype(np.uint64)) >> _U(64 - _CACHE_BITS)).astype(np.int64)
            slot, last = np.unique(slot, return_index=True)
            self.pair_key[slot], self.pair_fits[slot] = new[last], found[last]
        return out

    def _fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        active = np.arange(len(x))
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), np.inf)
        while len(active):
            with np.errstate(over="ignore"):
                together = self.hashes[x] * self.powers[self.lengths[y]] + self.hashes[y]
            piece = self.probe_any(together)
            crosses = (piece >= 0) & (self.rank[piece] < limit)  # a merge across comes while x and y are still apart
            out[active[crosses]] = False
            go = ~crosses & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            active, x, y, limit = active[go], x[go], y[go], limit[go]
            first = self.rank[x] > self.rank[y]  # of equal merges the left one comes first, so the right one is undone first
            limit = np.where(first, self.rank[x], np.nextafter(self.rank[y], np.inf))
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    # -- encoding

    def _viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all stretches in a row, number per stretch) for stretches of one length, a row of code points each."""
        n, length = chars.shape
        back = np.full((n, length + 1), -1, np.int64)
        best = np.zeros((n, length + 1))
        prefix = np.zeros((n, length + 1), np.uint64)
        with np.errstate(over="ignore"):
            coded = _CHAR(chars)
            for i in range(length):
                prefix[:, i + 1] = prefix[:, i] * _U(_BASE) + coded[:, i]
            for i in range(1, length + 1):
                top = np.full(n, -np.inf)
                for size in range(min(i, self.longest), 0, -1):
                    piece = self.probe(prefix[:, i] - prefix[:, i - size] * self.powers[size])
                    if size == 1:
                        piece = np.where(piece < 0, self.free, piece)
                    at = np.flatnonzero(piece >= 0)
                    if self.kind == BPE:
                        at = at[~np.isfinite(top[at])]
                        if i > size and len(at):
                            at = at[self.fits(back[at, i - size], piece[at])]
                        weight = np.zeros(len(at))
                    else:
                        weight = best[at, i - size] + self.weight[piece[at]]
                        better = weight > top[at]
                        at, weight = at[better], weight[better]
                    top[at] = weight
                    back[at, i] = piece[at]
                best[:, i] = top
        out = np.full((n, length), -1, np.int64)
        at, row = np.full(n, length), np.arange(n)
        count = np.zeros(n, np.int64)
        for step in range(length):
            going = row[at > 0]
            if not len(going):
                break
            out[going, length - 1 - step] = back[going, at[going]]
            at[going] -= self.lengths[back[going, at[going]]]
            count[going] += 1
        return out[out >= 0], count

    def _windowed(self, points: np.ndarray) -> np.ndarray:
        """Pieces of one long stretch, from windows that overlap, all worked on together.

        Pieces of which merging keeps each two neighbours are what merging makes of the whole, so two
        windows are joined where both have a cut and the pieces on its sides keep apart. Where no cut
        in an overlap does, the stretch is merged piece by piece.
        """
        starts = np.append(np.arange(0, len(points) - WINDOW, WINDOW - OVERLAP), len(points) - WINDOW)
        found: list[np.ndarray] = []
        step = max(1, GROUP_CHARS // WINDOW)
        for s in range(0, len(starts), step):
            pieces, number = self._viterbi(points[starts[s : s + step, None] + np.arange(WINDOW)])
            found += np.split(pieces, np.cumsum(number)[:-1])
        out, at = [], 0  # at: where the next piece of this window that counts begins
        for k, (begin, own) in enumerate(zip(starts.tolist(), found, strict=True)):
            ends = begin + np.cumsum(self.lengths[own])
            first = int(np.searchsorted(ends - self.lengths[own], at))
            if k + 1 == len(starts):
                out.append(own[first:])
                break
            then = found[k + 1]
            then_begin = starts[k + 1] + _ends(self.lengths[then])[:-1]
            cut, i, j = np.intersect1d(ends[first:], then_begin, return_indices=True)
            i += first
            able = np.flatnonzero(self.fits(own[i], then[j])) if len(cut) else cut
            if not len(able):
                text = points.astype("<u4").tobytes().decode("utf-32-le")
                return np.array([self.by_text.get(p, self.free) for p in self.merged(text)], np.int64)
            middle = able[len(able) // 2]
            out.append(own[first : i[middle] + 1])
            at = int(cut[middle])
        return np.concatenate(out)

    def _stretches(self, names: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the stretches in a row, their bounds); ``mark`` goes before each."""
        known = self.known[mark]
        new = [name for name in names if name not in known]
        if len(known) + len(new) > MOST_KNOWN:
            known = self.known[mark] = {}
            new = names
        pool, cuts = self._merge_stretches([mark + name for name in new])
        data, cuts = pool.tobytes(), (cuts * 4).tolist()
        known.update(zip(new, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        pieces = [known[name] for name in names]
        return np.frombuffer(b"".join(pieces), np.int32), _ends(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4)

    def _merge_stretches(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not names:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        size = np.fromiter(map(len, names), np.int64, len(names))
        points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        begin = _ends(size)
        # marks in a row have pieces of equal score, which only merging itself tells apart
        apart = np.zeros(len(names), bool)
        if self.kind == BPE:
            apart[:] = [name.startswith(MARK * 2) for name in names]
        apart |= size == 0
        groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        long = (size > LONG) & ~apart if self.kind == BPE else np.zeros(len(names), bool)
        for k in np.flatnonzero(long):
            own = self._windowed(points[begin[k] : begin[k + 1]])
            groups.append((np.array([k]), own, np.array([len(own)])))
        for length in np.unique(size[~apart & ~long]):
            same = np.flatnonzero((size == length) & ~apart & ~long)
            step = max(1, GROUP_CHARS // int(length))
            for s in range(0, len(same), step):
                some = same[s : s + step]
                groups.append((some, *self._viterbi(points[begin[some][:, None] + np.arange(length)])))
        for k in np.flatnonzero(apart):
            own = np.array([self.by_text.get(p, self.free) for p in self.merged(names[k])] if names[k] else [], np.int64)
            groups.append((np.array([k]), own, np.array([len(own)])))
        count = np.zeros(len(names), np.int64)
        for some, _, number in groups:
            count[some] = number
        ends = _ends(count)
        flat = np.empty(ends[-1], np.int64)
        for some, found, number in groups:
            flat[np.repeat(ends[some] - _ends(number)[:-1], number) + np.arange(len(found))] = found
        free = np.flatnonzero(flat == self.free)
        if not len(free):
            return flat.astype(np.int32), _ends(count)
        # characters without a piece become the pieces of their UTF-8 bytes
        owner = np.repeat(np.arange(len(names)), count)
        start = _ends(self.lengths[flat])[:-1] - np.repeat(_ends(np.bincount(owner, self.lengths[flat], len(names)))[:-1].astype(np.int64), count)
        spelt = {int(k): self.byte_ids[list(names[owner[k]][start[k]].encode())] for k in free}
        split = [spelt[k] if k in spelt else flat[k : k + 1] for k in range(len(flat))]
        wide = np.ones(len(flat), np.int64)
        wide[free] = [len(spelt[int(k)]) for k in free]
        return np.concatenate(split).astype(np.int32), _ends(np.bincount(owner, wide, len(names)).astype(np.int64))

    @cached_property
    def _cut(self) -> str:
        """A pattern that cuts a word after its leading letters, before punctuation that no piece holds after a letter."""
        after = {b for piece in self.pieces for a, b in zip(piece, piece[1:], strict=False) if re.match(f"[{LETTERS}]", a)}
        free = "".join(re.escape(c) for c in "!\"#$%&()*+,./:;<=>?@[]^_{|}~" if c not in after)
        return f"(?s)^(?P<word>[{LETTERS}]+)(?P<rest>[{free}].*)$" if free else "^(?P<word>x)(?P<rest>y)z"

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, their bounds); each has the mark before it. No piece reaches across a cut, so the parts' ids in a row are the word's."""
        cut = pc.extract_regex(words, self._cut)
        heads = pc.if_else(cut.is_valid(), pc.struct_field(cut, "word").cast(words.type), words).dictionary_encode()
        rests = pc.fill_null(pc.struct_field(cut, "rest"), "").dictionary_encode()
        one, one_cuts = self._stretches(heads.dictionary.to_pylist(), MARK)
        other, other_cuts = self._stretches(rests.dictionary.to_pylist(), "")
        begin = np.concatenate((one_cuts[:-1], other_cuts[:-1] + len(one)))
        size = np.concatenate((np.diff(one_cuts), np.diff(other_cuts)))
        place = np.column_stack((heads.indices.to_numpy(), rests.indices.to_numpy() + len(one_cuts) - 1)).ravel()
        ids, ends = _gathered(np.concatenate((one, other)), begin[place], size[place])
        return ids, ends[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text's ids); a null or empty text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = np.flatnonzero(pc.match_substring_regex(texts, f"(?s)^ | $|  |{MARK}").to_numpy(zero_copy_only=False))
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        bounds = bounds.astype(np.int64)
        flat = pc.list_flatten(parts)
        if len(odd):
            lists, at = [], 0
            cut = re.compile(f"{MARK}+[^{MARK}]*").findall
            size = np.diff(bounds)
            for k in odd:
                own = cut(MARK + texts[int(k)].as_py().replace(" ", MARK))
                lists += [flat.slice(at, bounds[k] - at), pa.array([s[1:] for s in own], flat.type)]
                at, size[k] = bounds[k + 1], len(own)
            flat = pa.concat_arrays([*lists, flat.slice(at)])
            bounds = _ends(size)
        coded = flat.dictionary_encode()
        pool, cuts = self._words(coded.dictionary)
        place = coded.indices.to_numpy()
        empty = np.flatnonzero(pc.binary_length(texts).to_numpy() == 0)
        counts = np.diff(cuts)[place]
        counts[bounds[empty]] = 0
        ids, ends = _gathered(pool, cuts[:-1][place], counts)
        return ids, ends[bounds]

    # -- decoding

    @cached_property
    def _spelling(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces in a row, their bounds); control pieces have none."""
        spelt = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            if kind == BYTE:
                spelt.append(bytes([int(piece[3:5], 16)]))
            else:
                spelt.append({CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(MARK, " ").encode()))
        return np.frombuffer(b"".join(spelt), np.uint8), _ends(np.array([len(s) for s in spelt]))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each row of ids; the first space mark is left out, bytes that are no UTF-8 become U+FFFD."""
        pool, cuts = self._spelling
        data, ends = _gathered(pool, cuts[:-1][ids], np.diff(cuts)[ids])
        data, at = data.tobytes(), ends[bounds]
        return [data[a + (a < b and data[a] == 0x20) : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _CHAR(points):
    """A 64-bit number per code point."""
    return mixed(np.asarray(points).astype(np.uint64) + _U(1))


#: One model per worker process and path.
_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(storage.read_range(path, 0, storage.file_size(path)))
    return _models[path]


def _portions(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``RUN_BYTES`` bytes; a longer text is one of its own."""
    ends = _ends(pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_numpy())
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + RUN_BYTES, side="right")) - 1)
        yield column.slice(i, j - i)
        i = j


def encoded(documents: DataFrame, model: str, verify: bool = True) -> DataFrame:
    """``documents`` with ``ids`` (array of int), ``n_tokens`` and, with ``verify``, ``decoded``; columns of those names are replaced.

    ``model`` is the path of a model file. Texts are encoded whole. A null or empty text has no
    ids. ``decoded`` says whether decoding the ids gives the text back (of null: an empty text);
    it does unless a text holds the space mark itself. Repeated rows are encoded alike; an empty
    table gives an empty result; other columns are carried.
    """
    kept = documents.drop("ids", "n_tokens", "decoded")
    shown = kept.withColumn("ids", F.lit(None).cast("array<int>")).withColumn("n_tokens", F.lit(0).cast("long"))
    shown = shown.withColumn("decoded", F.lit(True)) if verify else shown
    at, names = kept.columns.index("text"), shown.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model)
        for batch in batches:
            done = 0
            for texts in _portions(batch.column(at)):
                ids, bounds = own.encode(texts)
                extra = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(np.diff(bounds))]
                if verify:
                    extra.append(pa.array([a == (b or "") for a, b in zip(own.decode(ids, bounds), texts.to_pylist(), strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.slice(done, len(texts)).columns, *extra], names=names)
                done += len(texts)

    return kept.mapInArrow(tidy(encode), shown.schema)


def decoded(rows: DataFrame, model: str, name: str = "text") -> DataFrame:
    """``rows`` with the text of each row's ``ids`` in column ``name``, which is replaced; null ids give null."""
    kept = rows.drop(name)
    at = kept.columns.index("ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model)
        for batch in batches:
            ids = batch.column(at)
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
            texts = own.decode(np.asarray(ids.flatten(), np.int64), _ends(size))
            texts = [None if null else t for t, null in zip(texts, ids.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return kept.mapInArrow(tidy(decode), kept.withColumn(name, F.lit("")).schema)
