"""Near duplicates, decontamination and the pipeline against plain Python."""

import random
from collections import Counter, defaultdict

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placestat.llm import decontaminate, simhash

DOC = "doc_id long, text string, lang string, source string"


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(nodes, edges):
    parent = {n: n for n in nodes}
    for a, b in edges:
        ra, rb = find(parent, a), find(parent, b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(parent, n) for n in nodes}


def plain_fingerprint(text):
    w = [] if text is None else text.encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([b" ".join(w)] if w else [])
    bits = Counter(b for x in s for b in range(64) if xxhash.xxh64_intdigest(x, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(s))


def test_simhash_components_match_all_pairs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-1, None, None, None), (-2, "", None, None), (-3, " \t\n", None, None), (-4, "one", None, None), (-5, "one", None, None), (-4, "one", None, None)], DOC)
    rows = simhash.simhash_components(d.union(odd).withColumn("fp", F.lit("clash"))).collect()
    texts = [(r.doc_id, r.text) for r in d.union(odd).collect()]
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    want = {i: plain_fingerprint(t) for i, t in texts}
    assert all(int(r.fingerprint, 16) == want[r.doc_id] and len(r.fingerprint) == 16 for r in rows)
    ids = sorted(want)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (want[a] ^ want[b]).bit_count() <= 4]
    comp = components(ids, edges)
    assert all(r.component_id == comp[r.doc_id] for r in rows)
    assert len(edges) > 10
    assert simhash.simhash_components(d.limit(0)).count() == 0


def test_links_find_every_pair_within_the_radius(spark):
    rng = random.Random(3)
    fps = {}
    for _ in range(60):
        base = rng.getrandbits(64)
        for flips in (0, 1, 2, 3, 4, 5, 6):
            fps[len(fps)] = base ^ sum(1 << b for b in rng.sample(range(64), flips))
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()]
    df = spark.createDataFrame(signed, "n long, fp long")
    for radius in (1, 3, 4, 5):
        got = [(r.src, r.dst) for r in simhash.links(df, "n", "fp", radius).collect()]
        want = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def shingle_set(t):
    return set(simhash.shingles(simhash.words(t), 5))


def test_near_duplicate_survivors(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    rows, n = [], 0
    for g in range(30):
        base = [word() for _ in range(300)]
        copies = [base]
        for _ in range(3):
            c = list(base)
            for p in rng.sample(range(300), 2):
                c[p] = word()
            copies.append(c)
        for c in copies:
            rows.append((n, " ".join(c), "en", f"s{g}"))
            n += 1
    rows += [(n, rows[0][1], "en", "exact"), (n + 1, None, None, None), (n + 2, "", "en", "x"), (n + 3, "", "en", "y"), (None, "no id", "en", "z"), (n + 4, "twice", "en", "z"), (n + 4, "twice", "en", "z")]
    d = spark.createDataFrame(rows, DOC)
    out = simhash.near_duplicate_survivors(d)
    assert out.columns == d.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(k for k in kept if k is not None and k < n) == [4 * g for g in range(30)]
    assert n not in kept and n + 1 in kept and n + 2 in kept and n + 3 not in kept and None in kept and kept.count(n + 4) == 1
    sets = {i: shingle_set(t) for i, t, _, _ in rows[:8]}
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8


def block_edits(rng, base, word):
    """Copies of a text with words appended, cut off or replaced in one block."""
    n = len(base)
    return {
        "appended": base + [word() for _ in range(rng.randint(n // 20, n // 5))],
        "truncated": base[: rng.randint(n - n // 6, n - n // 20)],
        "replaced": base[: n // 3] + [word() for _ in range(n // 15)] + base[n // 3 + n // 15 :],
    }


def test_near_duplicates_with_block_edits_are_all_found(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=4))
    common = [word() for _ in range(40)]
    rows, want, n = [], [], 0
    for g in range(60):
        base = [word() for _ in range(rng.choice((60, 200, 700)))]
        base = base + common if g % 3 == 0 else base
        edited = [c for c in block_edits(rng, base, word).values() if plain_jaccard(base, c) >= 0.8]
        want.append(n)
        for c in [base, *edited]:
            rows.append((n, " ".join(c), "en", "s"))
            n += 1
    assert n > 150
    kept = [r.doc_id for r in simhash.near_duplicate_survivors(spark.createDataFrame(rows, DOC)).collect()]
    assert sorted(kept) == want


def plain_jaccard(a, b):
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    return len(x & y) / len(x | y)


def test_prefix_pairs_hold_every_similar_pair(spark):
    rng = random.Random(13)
    sets = {}
    for g in range(40):
        base = rng.sample(range(1000 * g, 1000 * g + 900), rng.choice((1, 2, 4, 5, 9, 10, 50, 100)))
        for drop in (0, 1, 2, 5, 10, 20):
            sets[len(sets)] = set(base[drop % len(base) :]) | {1000 * g + 900 + i for i in range(drop % 7)}
    rows = [(i, len(s), sorted(s)[: simhash.prefix_length(len(s), 0.8)], i) for i, s in sets.items()]
    got = simhash.prefix_pairs(spark.createDataFrame(rows, "id long, n int, prefix array<long>, grp long"), 0.8).collect()
    found = {frozenset((r.src, r.dst)) for r in got}
    near = {frozenset((i, j)) for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert len(near) > 50 and near <= found


def plain_tiles(doc, item, least):
    """Greedy tiling by its definition: scan all pairs for the longest unmarked match, mark, repeat."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and d + k not in used_d and i + k not in used_i:
                    k += 1
                if k > best[2]:
                    best = (d, i, k)
        if best[2] < least:
            return out
        d, i, k = best
        out.append(best)
        used_d |= set(range(d, d + k))
        used_i |= set(range(i, i + k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=25))
def test_tiles_match_the_definition(doc, item):
    assert sorted(decontaminate.greedy_tiles(doc, item, 3)) == sorted(plain_tiles(doc, item, 3))


def test_tiling_a_long_item_with_a_changed_word_is_quick():
    item = list(range(1, 20_001))
    doc = [50_000 + i % 7 for i in range(3000)] + item[:9000] + [60_000] + item[9001:] + item[100:140]
    assert sorted(decontaminate.greedy_tiles(doc, item, 5)) == [(3000, 0, 9000), (12001, 9001, 10999)]
    assert decontaminate.greedy_tiles([1] * 300, [1] * 120, 5) == [(0, 0, 120)]


def plain_tiles(doc, item, least):
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_d[d + n] and free_i[i + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (d, i, n)
        if best is None:
            return tiles
        d, i, n = best
        tiles.append(best)
        free_d[d : d + n] = free_i[i : i + n] = [False] * n


def test_tiles_match_plain_python():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 40))]
        doc = [rng.randrange(1, 6) for _ in range(20)] + item[: rng.randrange(1, 40)] + [9] + item[rng.randrange(0, 20) :]
        for least in (2, 5):
            assert decontaminate.greedy_tiles(doc, item, least) == plain_tiles(doc, item, least)


def test_cutting_down_to_seeds_keeps_the_tiles():
    rng = random.Random(9)
    for _ in range(60):
        item = [str(rng.randint(0, 5)) for _ in range(20)]
        doc = [str(rng.randint(0, 9)) for _ in range(60)]
        at = rng.randint(0, 40)
        doc[at : at + 12] = item[4:16]
        whole = plain_tiles(doc, item, 5)
        cut = decontaminate.greedy_tiles(*decontaminate._near_seeds(doc, item, 5), 5)
        assert sum(t[2] for t in whole) == sum(t[2] for t in cut)


def test_contaminated_pairs(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    w = item.split()
    rows = [
        (1, "before it " + item.upper() + "! after it", None, None),
        (2, " ".join(w[6:]) + " and then much later " + " ".join(w[:6]), None, None),
        (3, " ".join(w[:6]) + " only half of it", None, None),
        (4, None, None, None),
        (5, "", None, None),
        (6, "wholly clean text here with nothing in common", None, None),
        (None, item, None, None),
        (7, "noise " * 20000 + item, None, None),
        (7, "noise " * 20000 + item, None, None),
    ]
    d = spark.createDataFrame(rows, DOC).withColumn("item_id", F.lit(5))
    b = spark.createDataFrame([(9, item), (10, "too short"), (11, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated_pairs(d, b).collect()}
    assert set(got) == {(1, 9), (2, 9), (7, 9)}
    assert got[(1, 9)].coverage == 1.0 and got[(2, 9)].n_tiles == 2
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {3, 4, 5, 6, None}
    shuffled = decontaminate.contaminated_pairs(d, b, max_broadcast_seeds=0).collect()
    assert {(r.doc_id, r.item_id) for r in shuffled} == set(got)
    assert decontaminate.contaminated_pairs(d.limit(0), b).count() == 0 and decontaminate.contaminated_pairs(d, b.limit(0)).count() == 0


def test_decontamination_matches_plain_python(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    toks = {r.doc_id: r.w for r in d.select("doc_id", decontaminate.tokens(F.col("text")).alias("w")).collect()}
    items = {r.item_id: r.w for r in b.select("item_id", decontaminate.tokens(F.col("text")).alias("w")).collect()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    want = set()
    for i, w in toks.items():
        mine = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for j, g in grams.items():
            if mine & g:
                tiles = decontaminate.greedy_tiles(*decontaminate._near_seeds(w, items[j], 5), 5)
                if sum(t[2] for t in tiles) >= 0.8 * len(items[j]):
                    want.add((i, j))
    assert want
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(d, b).collect()} == want


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, columns = docs.count(), docs.columns
    assert [n for n, _ in c.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixture"]
    sizes = [start]
    for k, (_, stage) in enumerate(c.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema if k < 4 else None) if k < 4 else stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    whole = c.run(spark, sf)
    assert sorted((r.doc_id, r.copy) for r in whole.collect()) == sorted((r.doc_id, r.copy) for r in docs.collect())
    kept = defaultdict(set)
    for r in whole.collect():
        kept[r.doc_id].add(r.n_copies)
    assert all(len(v) == 1 for v in kept.values())
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, sf).count() == 0
