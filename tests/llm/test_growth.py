"""How operators grow: what is broadcast, and what is written between steps."""

import random

from pyspark.sql import functions as F

from placestat.llm import simhash


def test_keys_are_not_broadcast_however_few_fingerprints_there_are(spark):
    rng = random.Random(4)
    fps = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(500)], "fp long")
    found = simhash.links(fps.groupBy("fp").agg(F.count("*").alias("n")), "fp", "fp", 4)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_texts_stay_where_they_are_if_ids_are_unique(spark):
    rows = [(i, f"one two three four five six {i // 2}", "en") for i in range(20)]
    out = simhash.near_duplicate_survivors(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 20, 2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("Initial Plan")[0]


def test_sketches_let_similar_pairs_through_and_few_others(spark):
    rng = random.Random(8)
    sets, close, apart = {}, [], []
    for g in range(60):
        base = [rng.getrandbits(63) for _ in range(rng.randint(1, 400))]
        for k, share in enumerate((0.0, 0.08, 0.5)):
            new = round(share * len(base))
            sets[3 * g + k] = {*base[new:], *(rng.getrandbits(63) for _ in range(new))}
        for a, b in ((3 * g, 3 * g + 1), (3 * g, 3 * g + 2)):
            similar = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            (close if similar else apart).append((a, b))
    sketch = lambda x: simhash.parity_sketch(simhash.np.array(sorted(x), dtype="int64")).tolist()
    sketches = spark.createDataFrame([(i, len(x), sketch(x)) for i, x in sets.items()], "id long, n int, sketch array<long>")
    got = {tuple(r) for r in simhash._likely(spark.createDataFrame(close + apart, "src long, dst long"), sketches, 0.8).collect()}
    assert set(close) <= got and len(close) > 50
    assert len(got & set(apart)) < len(apart) / 4
