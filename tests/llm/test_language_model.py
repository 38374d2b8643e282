"""Seating against listed partitions, the model against a dictionary sampler, base scores against counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import packets, pitman_yor, seating

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


def test_packets_come_back():
    rng = np.random.default_rng(1)
    arrays = [np.zeros(0, np.int64), np.array([0, 255, 256]), np.array([-1, 5]), rng.integers(0, 2**40, 500), np.array([7], np.uint8)]
    found = packets.unpack(packets.pack(*arrays))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, found, strict=True))
    rising = np.sort(rng.integers(0, 2**63, 50, dtype=np.uint64))
    assert (np.cumsum(packets.steps(rising)) == rising).all()


def partitions(n):
    """Table sizes of all ways to seat n customers, each customer's table listed."""
    ways = [[]]
    for _ in range(n):
        ways = [[*w[:k], w[k] + 1, *w[k + 1 :]] for w in ways for k in range(len(w))] + [[*w, 1] for w in ways]
    return ways


def exact_tables(n, opening, discount, num, den, step):
    """P(tables) by adding up every seating's weight, a customer at a time."""
    weight = defaultdict(float)
    for sizes in partitions(n):
        w = math.prod(math.prod(j - discount for j in range(1, size)) for size in sizes)
        for i in range(1, len(sizes)):
            w *= (opening + discount * i) * (num + step * i) / (den + step * i)
        weight[len(sizes)] += w
    total = sum(weight.values())
    return np.array([weight[t] / total for t in range(1, n + 1)])


@pytest.mark.parametrize("step", [0.0, 1.0])
def test_tables_are_drawn_from_their_distribution(step):
    rng, n, draws = np.random.default_rng(2), 6, 40_000
    opening, discount, num, den = 2.5, 0.6, 0.3, 4.0
    one = np.ones(draws)
    tables = seating.tables_of(np.full(draws, n), one * opening, discount, one * num, one * den, step, seating.log_ways(discount), rng)
    assert np.bincount(tables, minlength=n + 1)[1:] / draws == pytest.approx(exact_tables(n, opening, discount, num, den, step), abs=0.012)


@pytest.mark.parametrize(("discount", "chance", "step"), [(0.75, 0.02, 0.0), (0.5, 0.3, 1.0), (0.9, 0.001, 0.0), (0.8, 0.9, 0.0)])
def test_saddle_point_agrees_with_listing(discount, chance, step):
    rng, n, draws, opening = np.random.default_rng(3), 200, 4000, 30.0
    one = np.ones(draws)
    args = (one * opening, discount, one * chance * 50, one * 50, step)
    listed = seating._listed(np.full(draws, n), seating.log_ways(discount, n), *args, rng)
    smooth = seating.tables_of(np.full(draws, n), *args, seating.log_ways(discount), rng)
    assert smooth.mean() == pytest.approx(listed.mean(), abs=5 * listed.std() / draws**0.5 + 0.02 * listed.mean() + 0.05)
    assert smooth.std() == pytest.approx(listed.std(), rel=0.15, abs=0.1)


def test_dishes_of_all_sizes_are_drawn_in_one_call():
    """Whatever their order, and whether weights are multiplied or their logarithms added."""
    rng, draws, discount = np.random.default_rng(8), 3000, 0.6
    sizes = [2, 3, 5, 8, 9, 30, 64, 100]
    customers = rng.permutation(np.repeat(sizes, draws))
    one = np.ones(len(customers))
    tables = seating.tables_of(customers, one * 2.5, discount, one * 0.3, one * 4.0, 1.0, seating.log_ways(discount), rng)
    for n in sizes:
        log = seating.log_ways(discount, n)[n, 1:] + np.concatenate(([0], np.cumsum([math.log((2.5 + discount * i) * (0.3 + i) / (4.0 + i)) for i in range(1, n)])))
        p, t, own = np.exp(log - log.max()) / np.exp(log - log.max()).sum(), np.arange(1, n + 1), tables[customers == n]
        std = (p @ t**2 - (p @ t) ** 2) ** 0.5
        assert own.min() >= 1 and own.max() <= n
        assert n > seating.LISTED or own.mean() == pytest.approx(p @ t, abs=5 * std / draws**0.5)


def test_turns_of_contexts_are_dealt_once(monkeypatch):
    """Their customers are trigrams' counts, which stay; those of the nearer words change with every sweep."""
    calls, turns_of = [], seating.turns_of
    monkeypatch.setattr(seating, "turns_of", lambda group: calls.append(len(group)) or turns_of(group))
    n = 3 * np.ones(40, np.int64)
    here = pitman_yor.Contexts([[packets.steps(np.repeat([2, 3], 20)), np.tile(np.arange(2, 22), 2), np.full(40, 4), n]])
    here.averaged(np.full(len(here.names), 0.05), np.random.default_rng(9))
    assert len(calls) == 1 + pitman_yor.BURN_IN + pitman_yor.SAMPLES


def spread(slices=1, hot=(), parts=()):
    return pitman_yor.Spread(slices, np.array(hot, np.int64), np.array(parts, np.int64))


def test_trigrams_of_a_block():
    ids, bounds = np.array([5, 6, 5, 6, 7, 5, 6]), np.array([0, 4, 5, 7])
    (near, token, far), place, cuts = spread(4, [5], [3]).trigrams(ids, bounds)
    want = [(1, 5, 1), (5, 6, 1), (6, 5, 5), (5, 6, 6), (1, 7, 1), (1, 5, 1), (5, 6, 1)]
    assert [(int(near[p]), int(token[p]), int(far[p])) for p in place] == want
    assert len(near) == len(set(want)) and cuts[0] == 0 and cuts[-1] == len(near)


def test_probabilities_add_up_to_one():
    """Over all known tokens and the unknown one, after seen, half seen and unseen contexts."""
    rng = random.Random(4)
    n = Counter()
    for _ in range(300):
        n[rng.randint(2, 5), rng.randint(2, 9), rng.randint(2, 4)] += 1
    vocabulary = [0, *range(2, 10)]
    rows = sorted({(a, w, c) for a in (2, 3, 77) for w in vocabulary for c in (2, 4, 55)} | set(n))
    columns = [np.array(x) for x in zip(*rows, strict=True)]
    asked = [packets.steps(columns[0]), columns[1], columns[2], np.array([n.get(r, 0) for r in rows])]
    here = pitman_yor.Contexts([asked])
    root = np.full(len(here.names), 1 / len(vocabulary))
    p = here.averaged(root, np.random.default_rng(5))[here.code]
    for a in (2, 3, 77):
        for c in (2, 4, 55):
            own = [x for x, r in zip(p, rows, strict=True) if (r[0], r[2]) == (a, c)]
            assert len(own) == len(vocabulary) and sum(own) == pytest.approx(1)
    assert [x for x, r in zip(p, rows, strict=True) if (r[0], r[2]) == (77, 55)] == pytest.approx([1 / 9] * 9)


class Restaurant:
    """A plain Chinese restaurant: lists of table sizes per dish, customers seated and unseated one at a time."""

    def __init__(self, discount, concentration, parent):
        self.discount, self.concentration, self.parent = discount, concentration, parent
        self.sizes, self.customers = defaultdict(list), 0

    def p(self, dish):
        sizes, tables = self.sizes.get(dish, []), sum(map(len, self.sizes.values()))
        above = self.parent.p(dish) if isinstance(self.parent, Restaurant) else self.parent
        return (sum(sizes) - self.discount * len(sizes) + (self.concentration + self.discount * tables) * above) / (self.concentration + self.customers)

    def add(self, dish, rnd):
        sizes, tables = self.sizes[dish], sum(map(len, self.sizes.values()))
        above = self.parent.p(dish) if isinstance(self.parent, Restaurant) else self.parent
        weights = [s - self.discount for s in sizes] + [(self.concentration + self.discount * tables) * above]
        k = rnd.choices(range(len(weights)), weights)[0]
        self.customers += 1
        if k < len(sizes):
            sizes[k] += 1
        else:
            sizes.append(1)
            if isinstance(self.parent, Restaurant):
                self.parent.add(dish, rnd)

    def remove(self, dish, rnd):
        sizes = self.sizes[dish]
        k = rnd.choices(range(len(sizes)), sizes)[0]
        self.customers -= 1
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            if isinstance(self.parent, Restaurant):
                self.parent.remove(dish, rnd)


def test_sampling_agrees_with_a_plain_sampler():
    """Two levels with given discounts and concentrations: predictive probabilities of a sampler that moves one customer at a time."""
    rnd = random.Random(6)
    n = Counter()
    for _ in range(260):
        n[rnd.choice([2, 3, 3]), rnd.choice([2, 2, 2, 3, 4, 5, 6, 7]), rnd.choice([2, 2, 3, 4])] += 1
    rows = sorted(n)
    columns = [np.array(x) for x in zip(*rows, strict=True)]
    here = pitman_yor.Contexts([[packets.steps(columns[0]), columns[1], columns[2], np.array([n[r] for r in rows])]])
    discounts, concentrations, base, rng = (0.4, 0.5), (1.5, 0.8), 1 / 7, np.random.default_rng(7)
    mean = np.zeros(len(rows))
    for sweep in range(420):
        for level, d, c in ((here.upper, discounts[0], concentrations[0]), (here.lower, discounts[1], concentrations[1])):
            level.discount, level.concentration = d, c
        level_discount = seating.discount_of
        try:
            seating.discount_of = lambda customers: discounts[0]
            here.sweep(np.full(len(here.names), base), rng)
        finally:
            seating.discount_of = level_discount
        for level, c in ((here.upper, concentrations[0]), (here.lower, concentrations[1])):
            level.concentration = c
        if sweep >= 20:
            mean += here.lower.predicted(here.upper.predicted(np.full(len(here.token), base))[here.of])[here.code] / 400
    heads, leaves = {}, {}
    seats = [r for r in rows for _ in range(n[r])]
    for a, _, c in rows:
        heads.setdefault(a, Restaurant(discounts[0], concentrations[0], base))
        leaves.setdefault((a, c), Restaurant(discounts[1], concentrations[1], heads[a]))
    for a, w, c in seats:
        leaves[a, c].add(w, rnd)
    plain = np.zeros(len(rows))
    for sweep in range(170):
        for a, w, c in rnd.sample(seats, len(seats)):
            leaves[a, c].remove(w, rnd)
            leaves[a, c].add(w, rnd)
        if sweep >= 20:
            plain += np.array([leaves[a, c].p(w) for a, w, c in rows]) / 150
    assert np.abs(mean - plain).max() < 0.02 and np.abs(np.log(mean / plain)).mean() < 0.04


def test_root_masses_add_up():
    mass, lost, concentration = pitman_yor.root_masses(np.array([1, 1, 2, 5, 900]), 1, 5, 0, 0)
    assert mass.sum() + lost == pytest.approx(909) and concentration > 0


def corpus(seed=3):
    rnd = random.Random(seed)
    nouns, verbs = [f"noun{k}" for k in range(30)], [f"verb{k}" for k in range(20)]
    follows = {x: rnd.choices(verbs, k=2) for x in nouns}
    rows = []
    for k in range(300):
        text = " ".join(f"The {x} {rnd.choice(follows[x])}" for x in rnd.choices(nouns, k=rnd.randint(1, 12)))
        rows.append((k, text))
    return [*rows, (900, None), (901, ""), (902, " \t\n"), (None, rows[0][1]), (903, "never-seen words HERE"), (904, "the " * 20_000), (905, rows[3][1]), (3, rows[3][1])]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 3000)  # many blocks
    rows = corpus()
    data = [(k, k is not None and zlib.crc32(str(k).encode()) % 5 != 1, t, 0.5) for k, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, train boolean, text string, score double").repartition(3)
    found = pitman_yor.scored(docs).collect()
    assert len(found) == len(rows)
    train = Counter(w for (_, t), d in zip(rows, data, strict=True) if d[1] for w in tokens_of(t))
    n, v = sum(train.values()), len(train)
    want = sorted((k if k is not None else -1, len(tokens_of(t)), sum(train[w] > 0 for w in tokens_of(t)), round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens_of(t)), 6)) for k, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert {r.train_tokens for r in found} == {n} and all(r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in found)
    per = lambda rs: sum(r.score for r in rs) / sum(r.n_tokens for r in rs)
    held = [r for r in found if not r.train and r.n_tokens > 3]
    assert per(held) > sum(r.base_score for r in held) / sum(r.n_tokens for r in held) + 0.5
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.score)
    assert all(len(x) == 1 for x in by.values()) and by[900] == by[901] == by[902]
    again = pitman_yor.scored(docs.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in found)


def test_trigrams_of_a_block_are_found_once(spark, monkeypatch, tmp_path):
    seen = str(tmp_path / "seen")

    class Counting(pitman_yor.Spread):
        def trigrams(self, ids, bounds):
            with open(seen, "a") as out:
                out.write(f"{len(ids)}\n")
            return super().trigrams(ids, bounds)

    monkeypatch.setattr(pitman_yor, "Spread", Counting)
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 3000)
    docs = spark.createDataFrame([(k, k is not None and k % 5 != 1, t) for k, t in corpus(7)], "doc_id long, train boolean, text string")
    found = pitman_yor.scored(docs.repartition(3)).collect()
    with open(seen) as lines:
        assert sum(map(int, lines)) == sum(r.n_tokens for r in found)


def test_slices_change_little(spark, monkeypatch):
    """Many slices and several restaurants of frequent words: the same counts, and a model about as good."""
    docs = spark.createDataFrame([(k, k % 5 != 1, t) for k, t in corpus(5) if k is not None], "doc_id long, train boolean, text string")
    one = pitman_yor.scored(docs).toPandas()
    monkeypatch.setattr(pitman_yor, "SLICE_TOKENS", 900)
    monkeypatch.setattr(pitman_yor, "TOKEN_BYTES", 40_000)
    monkeypatch.setattr(pitman_yor, "HOT", 400)
    several = pitman_yor.scored(docs).toPandas()
    assert (one.sort_values("doc_id").n_known.to_numpy() == several.sort_values("doc_id").n_known.to_numpy()).all()
    per = lambda d: d[~d.train & (d.n_tokens > 3)].score.sum() / d[~d.train & (d.n_tokens > 3)].n_tokens.sum()
    assert per(several) == pytest.approx(per(one), abs=0.1)


def test_without_rows(spark):
    docs = spark.createDataFrame([(1, True, "a b"), (2, None, None)], "doc_id long, train boolean, text string")
    assert pitman_yor.scored(docs.where("false")).count() == 0
    untrained = {r.doc_id: r for r in pitman_yor.scored(docs.withColumn("train", F.lit(False))).collect()}
    assert untrained[1].n_known == 0 and untrained[1].train_tokens == 0 and untrained[1].score == pytest.approx(0, abs=1e-9)
