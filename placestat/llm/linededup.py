"""Line dedup by content-defined chunks.

A text is a run of lines: what ends with a line feed or, inside a long line, with a sentence or clause mark
and a blank, so that a passage pasted into the middle of a line still has lines of its own. Each line is
hashed; a rolling hash covers the last two line hashes; a chunk ends where the rolling hash is lower than
both of its neighbours. A boundary depends on four lines around it only, so text put in or cut elsewhere
doesn't move it, and chunks have two lines at least but at the ends of a text. Where a chunk turns up again,
the repeat is followed line by line into the two chunks on either side, so that it goes up to its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placestat.llm.common import WORD, let
from placestat.operators.graph import checkpoint

LINE = r"(?s).*?(?:\n|[.,;:!?] |\z)"
ENDS = ("\n", ". ", ", ", "; ", ": ", "! ", "? ")
CUT = "\u0001"


def text_lines(text: Column) -> Column:
    """Array of the lines, which joined give the text; empty for null or empty text."""
    whole = F.coalesce(text, F.lit(""))
    marked = whole
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + CUT))
    found = F.when(whole.contains(CUT), F.regexp_extract_all(whole, F.lit(f"({LINE})"), F.lit(1))).otherwise(F.split(marked, CUT, -1))
    return F.filter(found, lambda x: x != "")


def rolling(hashes: Column) -> Column:
    """Buzhash over each line hash and the one before it."""

    def at(h: Column, i: Column) -> Column:
        before = F.coalesce(F.try_element_at(hashes, F.when(i > 0, i)), F.lit(0))
        return h.bitwiseXOR(F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63)))

    return F.transform(hashes, at)


def bounds(hashes: Column) -> Column:
    """Line numbers at which chunks begin, from 0, and the number of lines at the end. Bind ``hashes`` first."""

    def minima(roll: Column) -> Column:
        inner = F.filter(
            F.sequence(F.lit(1), F.size(roll)),
            lambda i: (i > 1)
            & (i < F.size(roll))
            & (F.element_at(roll, i) < F.element_at(roll, F.greatest(i - 1, F.lit(1))))
            & (F.element_at(roll, i) < F.element_at(roll, F.least(i + 1, F.size(roll)))),
        )
        return F.concat(F.array(F.lit(0)), inner, F.array(F.size(roll)))

    return F.when(F.size(hashes) == 0, F.array().cast("array<int>")).otherwise(let(rolling(hashes), minima))


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def _count(bs: Column) -> Column:
    """Chunk numbers from 1; empty without lines."""
    return F.when(F.size(bs) > 1, F.sequence(F.lit(1), F.size(bs) - 1)).otherwise(F.array().cast("array<int>"))


def _line_at(bs: Column, k: Column) -> Column:
    """Line at which chunk k (from 1) begins, k cut to what exists."""
    return F.element_at(bs, F.greatest(F.lit(1), F.least(k, F.size(bs))))


def _between(lines: Column, low: Column, high: Column) -> Column:
    return F.slice(lines, low + 1, F.greatest(high - low, F.lit(0)))


def signatures(text: Column) -> Column:
    """Array of (lines, h) of the chunks; h is a 64-bit hash of the chunk's line hashes."""

    def of(hs: Column, bs: Column) -> Column:
        at = lambda k: (F.element_at(bs, k), F.element_at(bs, k + 1))
        return F.transform(_count(bs), lambda k: F.struct((at(k)[1] - at(k)[0]).alias("lines"), F.xxhash64(_between(hs, *at(k))).alias("h")))

    return let(_hashes(text_lines(text)), lambda hs: let(bounds(hs), lambda bs: of(hs, bs)))


def with_surroundings(text: Column, wanted: Column) -> Column:
    """Array of (h, parts, body, before, after) for an array of (at, h, parts): the chunk, and the lines of
    two chunks to each side, nearest first."""

    def of(ls: Column, bs: Column) -> Column:
        def one(o: Column) -> Column:
            k = o["at"] + 1
            return F.struct(
                o["h"].alias("h"),
                o["parts"].alias("parts"),
                F.array_join(_between(ls, _line_at(bs, k), _line_at(bs, k + 1)), "").alias("body"),
                F.reverse(_between(ls, _line_at(bs, k - 2), _line_at(bs, k))).alias("before"),
                _between(ls, _line_at(bs, k + 1), _line_at(bs, k + 3)).alias("after"),
            )

        return F.transform(wanted, one)

    return let(text_lines(text), lambda ls: let(let(_hashes(ls), bounds), lambda bs: of(ls, bs)))


def _same(mine: Column, theirs: Column) -> Column:
    """How many first elements two arrays of lines have in common."""
    return F.array_position(F.concat(F.zip_with(mine, theirs, lambda a, b: a.eqNullSafe(b)), F.array(F.lit(False))), F.lit(False)).cast("int") - 1


def without(text: Column, gone: Column, min_words: int) -> Column:
    """(text, removed): the text rid of the chunks in ``gone`` (array of at, body, before, after, by at) that
    are byte for byte the same, and of the equal lines next to them; the number of those chunks. A null
    before or after says that the chunk on that side is in ``gone`` as well, from the same place."""

    def of(ls: Column, bs: Column) -> Column:
        def run(e: Column) -> Column:
            k = e["at"] + 1
            low, high = _line_at(bs, k), _line_at(bs, k + 1)
            begin = low - F.coalesce(_same(F.reverse(_between(ls, _line_at(bs, k - 2), low)), e["before"]), F.lit(0))
            end = high + F.coalesce(_same(_between(ls, high, _line_at(bs, k + 3)), e["after"]), F.lit(0))
            inside = e["before"].isNull() | e["after"].isNull()
            words = lambda r: F.regexp_count(F.array_join(_between(ls, r["begin"], r["end"]), ""), F.lit(WORD))
            long = lambda r: F.when(inside | (words(r) >= min_words), r)
            return F.when(F.array_join(_between(ls, low, high), "") == e["body"], let(F.struct(begin.alias("begin"), end.alias("end")), long))

        def rest(runs: Column) -> Column:
            # a run reaches into two chunks to either side, so only three neighbours can overlap it
            at = lambda j, side, other: F.coalesce(F.try_element_at(runs, F.when((j >= 1) & (j <= F.size(runs)), j))[side], other)
            ended = lambda j: F.greatest(*[at(j - back, "end", F.lit(0)) for back in (1, 2, 3)])
            begins = lambda j: F.least(*[at(j + on, "begin", F.size(ls)) for on in (0, 1, 2)])
            pieces = F.transform(F.sequence(F.lit(1), F.size(runs) + 1), lambda j: F.array_join(_between(ls, ended(j), begins(j)), ""))
            return F.struct(F.array_join(pieces, "").alias("text"), F.size(runs).alias("removed"))

        return let(F.filter(F.transform(gone, run), lambda r: r.isNotNull()), rest)

    return let(text_lines(text), lambda ls: let(let(_hashes(ls), bounds), lambda bs: of(ls, bs)))


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, rows_a_part: int = 1000) -> DataFrame:
    """``docs`` with the text rid of runs of lines seen elsewhere, and n_chunks_removed and n_chars_removed.

    A chunk of two lines or more that occurs more than once in the corpus stays only where it first stands in
    the text with the least id. Candidates are found by 64-bit hash and removed only if they are byte for
    byte the chunk that stays; equal lines next to it, in the two chunks on either side, go with it. A run of
    one chunk and fewer than ``min_words`` words stays: two short clauses are common in clean texts. A line goes only if it
    stays in an earlier place, so one copy of everything is left. A text may become empty; its row stays.
    Null texts, and rows with a null id, are left as they are and not counted. Rows with the same id and text
    share decisions; rows with the same id and other texts have their own. Input columns named like a new one
    are replaced.

    Only hashes are shuffled to find candidates; then the texts of the chunks that stay go to the documents
    that repeat them. A chunk that a third of all texts share is counted with map-side sums, and its text is
    sent in one copy for each ``rows_a_part`` repeats, so that no task gets them all.
    """
    usable = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    whole, digest = docs.where(usable), F.xxhash64(text_col)
    rows = whole.select(F.col(id_col).alias("id"), digest.alias("digest"), F.posexplode(signatures(F.col(text_col))).alias("at", "c")).where("c.lines >= 2")
    sig = checkpoint(rows.select("id", "digest", "at", F.col("c.h").alias("h")))
    mine = F.struct("id", "digest", "at")
    seen = sig.groupBy("h").agg(F.count("*").alias("n"), F.min(mine).alias("first")).where("n > 1")
    found = checkpoint(sig.join(seen, "h").withColumn("parts", F.ceil(F.col("n") / rows_a_part).cast("int")))
    stays = found.where(mine == F.col("first")).select("id", "digest", "at", "h", "parts").distinct()
    per_owner = stays.groupBy(F.col("id").alias("__own")).agg(F.collect_list(F.struct("digest", "at", "h", "parts")).alias("own"))
    own = let(digest, lambda d: F.filter("own", lambda o: o["digest"] == d))
    held = whole.join(per_owner, F.col(id_col) == F.col("__own")).select(F.explode(with_surroundings(F.col(text_col), own)).alias("x"))
    held = held.select("x.h", "x.body", "x.before", "x.after", F.explode(F.sequence(F.lit(0), F.col("x.parts") - 1)).alias("part")).dropDuplicates(["h", "part"])
    again = found.where(mine != F.col("first"))
    near = lambda by: F.coalesce(F.lag(F.struct("at", "first"), by).over(Window.partitionBy("id", "digest").orderBy("at")), F.struct(F.lit(-9).alias("at"), F.col("first")))
    goes_on = lambda x, by: (x["at"] == F.col("at") - by) & (x["first"] == F.struct("first.id", "first.digest", (F.col("first.at") - by).alias("at")))
    again = again.withColumns({"inside": goes_on(near(1), 1), "goes_on": goes_on(near(-1), -1)})
    again = again.select("id", "digest", "at", "h", "inside", "goes_on", F.pmod(F.xxhash64("id", "at"), F.col("parts").cast("long")).cast("int").alias("part"))
    gone = again.join(held, ["h", "part"]).groupBy(F.col("id").alias("__id"))
    sides = (F.when(~F.col("inside"), F.col("before")).alias("before"), F.when(~F.col("goes_on"), F.col("after")).alias("after"))
    gone = gone.agg(F.collect_set(F.struct("digest", "at", "body", *sides)).alias("__gone"))

    out = whole.join(gone, F.col(id_col) == F.col("__id"), "left").drop("__id").unionByName(docs.where(~usable), allowMissingColumns=True)
    listed = let(digest, lambda d: F.array_sort(F.filter("__gone", lambda e: e["digest"] == d)))
    rest = F.when(F.col("__gone").isNotNull(), let(listed, lambda g: without(F.col(text_col), g, min_words)))
    out = out.withColumn("__rest", rest).withColumn("__text", F.coalesce(F.col("__rest.text"), F.col(text_col)))
    out = out.withColumn("n_chunks_removed", F.coalesce(F.col("__rest.removed"), F.lit(0)).cast("long"))
    lost = F.char_length(F.coalesce(F.col(text_col), F.lit(""))) - F.char_length(F.coalesce("__text", F.lit("")))
    out = out.withColumn("n_chars_removed", lost.cast("long"))
    return out.withColumn(text_col, F.col("__text")).drop("__text", "__rest", "__gone")
