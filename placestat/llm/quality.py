"""Quality rules whose thresholds follow the corpus.

Five integer features (thousandths) of a text are counted in log-linear quantile sketches, one for each
language, source and feature. Values below 64 have a bin of their own; above, the leading six bits are kept
(relative error under 1/32). A sketch is a table (group, bin, count): two sketches merge by adding counts, so
Spark builds them with map-side sums and a hot source costs no more than any other. A group's threshold lies
``spread`` times the distance from its median to its ninth decile beyond that decile, so it follows the
group's own level and scatter. Merged sketches give the same for a language and for all texts, and the
thresholds of small groups are shrunk towards their language's, those towards all texts', by group size
(``prior`` texts count as much as the group itself). They are joined back and texts beyond one are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.llm.common import WORD, let, sized_broadcast, text_words
from placestat.operators.graph import checkpoint

SYMBOLS = "#*$%&|<>"
FEATURES = ("symbols", "dup_lines", "repeats", "long_words", "short_words")
SUB = 32


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that are found twice or more in the array, first ones included."""

    def covered(keys: Column) -> Column:
        ranked = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(r: Column) -> Column:
            hit = F.filter(
                r,
                lambda x, j: (F.try_element_at(r, j + 2)["k"].eqNullSafe(x["k"]))
                | ((j > 0) & F.try_element_at(r, F.greatest(j, F.lit(1)))["k"].eqNullSafe(x["k"])),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(ranked, starts))

    def of(w: Column) -> Column:
        keys = F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
        )
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(keys, covered))

    return let(words, of).cast("long")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null or blank text has zeros and fails. Everything is worked out within the row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = docs.withColumns(
        {
            "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "word_chars": F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(text_words(F.col(text_col))),
            "n_lines": let(lines, F.size).cast("long"),
        }
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def features(counted: DataFrame) -> DataFrame:
    """``counted`` with the array ``__feature`` of the five integer features, in the order of FEATURES."""
    per_mille = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return counted.withColumn(
        "__feature",
        F.array(
            per_mille("n_symbols", "word_chars"),
            per_mille("n_dup_lines", "n_lines"),
            per_mille("n_repeat_words", "n_words"),
            per_mille("word_chars", "n_words"),
            per_mille("n_words", "word_chars"),
        ),
    )


def sketch_bin(x: Column) -> Column:
    """Bin of a non-negative integer: itself below 64, else its exponent and its leading six bits."""
    e = F.length(F.bin(x)) - 6
    return F.when(x < 2 * SUB, x).otherwise(e * SUB + F.shiftright(x, 0) / F.pow(F.lit(2), e)).cast("long")


def bin_top(b: Column) -> Column:
    """Largest value in a bin."""
    e = F.floor((b - SUB) / SUB)
    return F.when(b < 2 * SUB, b).otherwise(((b - e * SUB + 1) * F.pow(F.lit(2), e)).cast("long") - 1)


def build_sketches(df: DataFrame, keys: list[str], feature_col: str = "__feature") -> DataFrame:
    """(keys, feature, bin, n): mergeable sketches, built with map-side sums."""
    binned = df.select(*keys, F.posexplode(feature_col).alias("feature", "value"))
    return binned.groupBy(*keys, "feature", sketch_bin(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, by adding counts."""
    return sketches.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], spread: float, scatter: dict[str, int]) -> DataFrame:
    """(keys, feature, texts, fence): ninth decile plus ``spread`` times its distance from the median.

    A distance below the feature's entry in ``scatter`` counts as that: a group whose texts are all but equal
    says little about what is unusual.
    """
    s = sketches.groupBy(*keys, "feature").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("s"), F.sum("n").alias("texts"))

    def decile(num: int) -> Column:
        below = F.aggregate(
            "s",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at")),
            lambda acc, x: F.when(acc["at"] >= 0, acc).otherwise(
                F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(10 * (acc["seen"] + x["n"]) >= num * F.col("texts"), x["bin"]).otherwise(F.lit(-1).cast("long")).alias("at"))
            ),
            lambda acc: acc["at"],
        )
        return bin_top(below)

    least = F.create_map(*[F.lit(x) for k, name in enumerate(FEATURES) for x in (k, scatter[name])])[F.col("feature")]
    return s.select(*keys, "feature", "texts", decile(5).alias("mid"), decile(9).alias("high")).select(
        *keys, "feature", "texts", (F.col("high") + spread * F.greatest(F.col("high") - F.col("mid"), least)).alias("fence")
    )


#: Least distances from median to ninth decile, in thousandths.
SCATTER = {"symbols": 25, "dup_lines": 100, "repeats": 75, "long_words": 250, "short_words": 10}

GROUP = ["__lang", "__source"]


def count_features(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with the base counts, ``__feature`` and the group keys; a null group is one of its own."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return features(base_counts(docs, text_col)).withColumns({"__lang": key(lang_col), "__source": key(source_col)})


def thresholds(counted: DataFrame, spread: float, scatter: dict[str, int], prior: int) -> DataFrame:
    """(language, source, __fences): of the texts that pass the base rules, by group, shrunk towards the coarser groups."""
    fine = checkpoint(build_sketches(counted.where(~F.col("base_failed")).select(*GROUP, "__feature"), GROUP))
    by_lang = merge_sketches(fine, GROUP[:1])
    mine, lang, everyone = (
        fences(sketches, keys, spread, scatter).select(*keys, "feature", F.col("texts").alias(f"n{i}"), F.col("fence").alias(f"f{i}"))
        for i, (keys, sketches) in enumerate(((GROUP, fine), (GROUP[:1], by_lang), ([], merge_sketches(by_lang, []))))
    )
    shrunk = lambda n, own, parent: (F.col(n) * F.col(own) + prior * F.col(parent)) / (F.col(n) + prior)
    lang = lang.join(everyone, "feature").withColumn("f1", shrunk("n1", "f1", "f2")).select(*GROUP[:1], "feature", "f1")
    mine = mine.join(lang, [*GROUP[:1], "feature"]).withColumn("f0", shrunk("n0", "f0", "f1"))
    return mine.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("feature", F.col("f0").alias("fence")))).alias("f")).select(*GROUP, F.col("f.fence").alias("__fences"))


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` joined with its thresholds: ``reasons`` (features beyond one) and ``kept``."""
    zipped = F.arrays_zip(F.col("__feature"), F.col("__fences"), F.array(*map(F.lit, FEATURES)).alias("name"))
    over = F.filter(F.transform(zipped, lambda z: F.when(z["__feature"] > z["__fences"], z["name"])), lambda x: x.isNotNull())
    return (
        counted.join(sized_broadcast(limits), GROUP, "left")
        .withColumn("reasons", F.when(~F.col("base_failed"), over).otherwise(F.array().cast("array<string>")))
        .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
        .drop("__fences", "__feature", *GROUP)
    )


def adaptive_verdict(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    spread: float = 3.0,
    prior: int = 200,
    scatter: dict[str, int] | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``reasons`` and ``kept``.

    Texts that fail the base rules are not in the sketches. Null languages and sources are groups of their
    own; a null or blank text fails. Repeated rows each count and each give a row. Empty input gives empty
    output; an input column named like a new one is replaced. Without ``keep_text`` the text is dropped and
    the counts, a few bytes a row, are written once and read twice; with it they are worked out twice.
    """
    counted = count_features(docs, text_col, lang_col, source_col)
    if not keep_text:
        counted = checkpoint(counted.drop(text_col))
    return judge(counted, thresholds(counted, spread, SCATTER | (scatter or {}), prior))


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they are.

    The counts are worked out once, without carrying the texts along; the verdicts come back by id and
    digest of the text, so rows that share an id keep verdicts of their own.
    """
    digest = F.md5(F.col(text_col).cast("binary"))
    small = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__l"), F.col(source_col).alias("__s"))
    small = small.withColumn("__digest", F.md5(F.col("__text").cast("binary")))
    good = adaptive_verdict(small, "__text", "__l", "__s", keep_text=False, **options).where("kept").select("__id", "__digest").distinct()
    return docs.join(good, F.col(id_col).eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_semi")
