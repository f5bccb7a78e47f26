"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson-distributed number of times. The draw inverts the distribution at a
number hashed from the seed and the document's id, so it needs no state, comes out the same after a lost
executor, and a third of all rows in one source costs nothing special.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.llm.common import let, sized_broadcast

#: Larger means are split into equal parts of at most this, drawn apart and added.
PART = 500.0


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that ``df`` doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def source_rates(
    docs: DataFrame, source_col: str, weights: dict[str | None, float] | None, power: float, total: float | None
) -> DataFrame:
    """(source, docs, weight, rate): target weight of each source and mean repetitions of its documents."""
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("__n"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.pow("__n", F.lit(float(power))))
    else:
        w = F.lit(float(weights.get(None, 0.0)))
        for name, x in weights.items():
            w = F.when(F.col("__source") == name, float(x)).otherwise(w) if name is not None else w
        sizes = sizes.withColumn("__w", F.when(F.col("__source").isNull(), float(weights.get(None, 0.0))).otherwise(w))
    all_of = sizes.agg(F.sum("__w").alias("__sum"), F.sum("__n").alias("__all"))
    goal = F.lit(float(total)) if total is not None else F.col("__all")
    return sizes.join(F.broadcast(all_of), F.lit(True)).select(
        "__source", "__n", (F.col("__w") / F.col("__sum")).alias("__weight"),
        F.when(F.col("__sum") > 0, F.col("__w") / F.col("__sum") * goal / F.col("__n")).otherwise(0.0).alias("__rate"),
    )


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is nothing, for a Poisson mean of at most PART."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"), (acc["c"] + acc["p"] * mean / k).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * mean / k)).alias("all")
    )
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def poisson_mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    power: float = 0.5,
    total: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Documents repeated so that sources reach their target weights, in a globally shuffled order.

    Targets are ``weights`` (a source not named: weight 0; None: the null source) or the ``power`` of the
    sources' sizes; rows are counted, so repeated rows count each. The mean repetition of a document is
    weight * total / documents of its source, ``total`` being the number of rows by default. Adds copy
    (from 1), n_copies and shuffle_key (rows are sorted by it, then by id and copy). Null ids draw one
    number among them. Empty input gives empty output. Columns named like a new one are replaced.
    """
    of, parts, cdf = free_names(docs, "source", "parts", "cdf")
    rates = source_rates(docs, source_col, weights, power, total).withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__rate") / PART)))
    rates = rates.select(F.col("__source").alias(of), F.col("__parts").alias(parts), cumulative(F.col("__rate") / F.col("__parts")).alias(cdf))
    joined = docs.join(sized_broadcast(rates, 10_000), F.col(source_col).eqNullSafe(F.col(of)))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    draws = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col(parts).cast("long")),
        lambda part: let(unit_hash(F.lit(str(seed)), part.cast("string"), ident), lambda u: F.size(F.filter(cdf, lambda c: c <= u))),
    )
    copies = F.aggregate(draws, F.lit(0).cast("long"), lambda a, x: a + x)
    out = joined.withColumn("n_copies", copies).where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), ident, F.col("copy").cast("string"))))
    return out.drop(of, parts, cdf).orderBy("shuffle_key", id_col, "copy")
