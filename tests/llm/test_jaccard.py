"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from placestat.llm import jaccard
from placestat.llm.jaccard import jaccard_components, prefix_length


def shingle_sets(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent=80):
    sets = [shingle_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(df, **kw).collect())


@pytest.fixture(scope="module")
def mutated():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (4, 5, 6, 9, 30, 60, 200, 700):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for k in range(6):
                t = list(base)
                for _ in range(k * size // 120 + (k > 3)):
                    at = rng.randrange(len(t))
                    if rng.random() < 0.5:
                        t[at] = rng.choice(vocabulary)
                    else:
                        t[at : at + rng.randrange(4)] = []
                rows.append((n, ("  " if k else " ").join(t) if k != 2 else " ".join(t).upper()))
                n += 1
    return rows


@pytest.mark.parametrize("percent", [80, 55])
def test_same_components_as_all_pairs(spark, mutated, percent):
    assert result(spark, mutated, percent=percent) == brute(mutated, percent)


def test_shared_passages_and_frequent_windows(spark):
    """A passage that all hold makes hot elements; only texts that are little else are linked."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, passage + " " + " ".join(f"t{i}x{j}" for j in range(rng.choice([2, 8, 9, 12, 13, 60])))) for i in range(60)]
    assert result(spark, rows) == brute(rows)


def test_nulls_blanks_repeats_and_ids(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(7, text), (7, text), (3, text + " more"), (None, text), (7, "other words than those of that text"), (5, None), (4, ""), (9, " \t\n"), (8, "one"), (6, "One"), (None, "alone here"), (2, "one two three four")]
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 3, 4), (2, "a b c d e f", 5, 6)], "doc_id long, text string, n long, component_id long")
    assert sorted(map(tuple, jaccard_components(df).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_very_long_text(spark):
    long = " ".join(f"v{i % 30011}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, long[:600_000])]
    assert result(spark, rows) == brute(rows)


def test_prefixes_hold_a_common_element():
    for n in range(1, 300):
        assert n - prefix_length(n, 80) + 1 >= 0.8 * n - 1e-9


def test_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(7)
    for n in (1, 30, 400, 5000):
        a = rng.integers(-(2**63), 2**63 - 1, n)
        b = np.concatenate([a[: n * 3 // 4], rng.integers(-(2**63), 2**63 - 1, n // 3)])
        apart = sum(int(x).bit_count() for x in (jaccard.parity_sketch(a) ^ jaccard.parity_sketch(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_a_family_below_the_similarity_makes_few_candidates(spark, monkeypatch):
    """Each two have 172 common elements of 228, 75 %, and more common prefix elements than the bound by number asks for."""
    base, rows = [f"b{i}" for i in range(204)], []
    for i in range(12):
        t = list(base)
        for at in (16 * i + 4, 16 * i + 12):
            t[at : at + 3] = [f"own{i}x{at}x{k}" for k in range(3)]
        rows.append((i, " ".join(t)))
    seen, real = [], jaccard.rest_pairs
    monkeypatch.setattr(jaccard, "rest_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    assert result(spark, rows) == brute(rows)
    assert seen[0].count() <= 6


@pytest.mark.parametrize("rounds", [0, 3])
def test_a_family_around_the_similarity_is_joined_in_rounds(spark, rounds):
    rng = random.Random(9)
    base, rows = [f"b{i}" for i in range(100)], []
    for i in range(120):
        t = list(base)
        for at in rng.sample(range(100), rng.choice([0, 1, 2, 3])):
            t[at] = f"own{i % 7}x{at}"
        rows.append((i, " ".join(t)))
    assert result(spark, rows, rounds=rounds) == brute(rows)
