"""Mixing of sources to target weights by entropy balancing, with DataFrame functions only.

A document's rate is how often it is taken, on average. Of all rates between 0
and ``limit`` that give every source its target of words, entropy balancing
takes those closest to 1: they are exponentially tilted by size,

    rate = limit * e / (limit - 1 + e),   e = exp(tilt * size / mean size of the source),

with one ``tilt`` per source, the minimum of a convex dual. Newton steps find it
for all sources at once: each step is one aggregation over (source, size)
counts, kept inside a bracket that every step narrows.

Rates become copies by systematic rounding: along the sizes of a source that have
as many binary digits, the fractions of copies add up, and each time they pass a
whole number the size at hand gets one copy more. Where counting starts shifts the
words taken a little. From the longest documents down, each such class takes that of
``STARTS`` starts which best makes up for what rounding left over above it. Inside a
size the documents of smallest hash get the extra copies. All sums are of whole or
decimal numbers, so a rerun gives the same copies.

Defined results: a null or empty text has size 0, no words to take and no copies;
a null source is a source of its own, last in order; rows of one id are mixed as
documents each; an empty table gives an empty table; a source without words has
target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.rows import WORD, quoted, unpacked
from logweir.session import settle

#: Places where the rounding of a class of sizes may start.
STARTS = 64
#: Groups by hash that the documents of one (source, size) are ranked in.
SLICES = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], limit: int) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``, one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn. A target
    stops at ``limit`` times the source's size, the excess is shared again: with
    sources sorted by that limit per weight, the first ones stop and the others
    share the rest. Both windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    shared = (
        per.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(limit))
        .withColumn("total", F.sum("source_size").over(everything))
        # Words per weight if this source and all after it share what those before leave.
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
            / F.sum("weight").over(onward),
        )
        .withColumn("open", F.col("most") >= F.col("level") * F.col("weight"))
        # The first source that stays below its limit sets the level of all after it; from
        # there on levels only fall.
        .withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    )
    most = F.col("most").cast("double")
    target = F.least(most, F.coalesce(F.col("level") * F.col("weight"), most))
    return shared.select(
        _key(F.col("source")).alias("key"), "source_size", target.alias("target")
    )


def _key(source: Column) -> Column:
    """A source's name for joins; null has one that no other source has."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def _whole_sum(value: Column) -> Column:
    """A sum of doubles to six decimals that does not depend on their order."""
    return (F.sum(F.round(value * 1e6).cast("decimal(38,0)")).cast("double")) / 1e6


def tilts(
    cells: DataFrame, targets: DataFrame, limit: int, rounds: int = 60, close: float = 1e-9
) -> DataFrame:
    """``(key, target, mean, tilt)``: the dual solution for ``cells (key, size, docs)``.

    A source whose target is its limit, or without words, has no finite tilt: null.
    """
    mean = cells.groupBy("key").agg(
        (F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean")
    )
    most = F.col("source_size") * F.lit(float(limit))
    state = settle(
        targets.join(mean, "key").select(
            "key",
            "target",
            "mean",
            F.when((F.col("target") > 0) & (F.col("target") < most), 0.0).alias("tilt"),
            F.lit(-1e3).alias("low"),
            F.lit(1e3).alias("high"),
        )
    )
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        r = rate(F.col("tilt"), x, limit)
        words = F.col("size") * F.col("docs") * r
        met = cells.join(state.where(F.col("tilt").isNotNull()), "key")
        sums = met.groupBy("key").agg(
            _whole_sum(words).alias("words"), _whole_sum(words * x * (1 - r / limit)).alias("slope")
        )
        state = settle(_step(state, sums))
        worst = state.agg(F.max("gap")).first()[0]
        state = state.drop("gap")
        if worst is None or worst <= close:
            break
    return state.select("key", "target", "mean", "tilt")


def _step(state: DataFrame, sums: DataFrame) -> DataFrame:
    """One Newton step for every source; outside the bracket its middle is taken."""
    gap = F.col("words") - F.col("target")
    low = F.when(gap < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
    high = F.when(gap > 0, F.least("high", "tilt")).otherwise(F.col("high"))
    newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
    inside = newton.isNotNull() & (newton > F.col("new_low")) & (newton < F.col("new_high"))
    middle = (F.col("new_low") + F.col("new_high")) / 2
    stepped = (
        state.join(sums, "key", "left")
        .withColumn("new_low", low)
        .withColumn("new_high", high)
    )
    tilt = F.when(gap == 0, F.col("tilt")).when(inside, newton).otherwise(middle)
    return stepped.select(
        "key",
        "target",
        "mean",
        F.when(F.col("words").isNotNull(), tilt).alias("tilt"),
        F.col("new_low").alias("low"),
        F.col("new_high").alias("high"),
        (F.abs(gap) / F.col("target")).alias("gap"),
    )


def rate(tilt: Column, x: Column, limit: int) -> Column:
    """limit * e^(tilt x) / (limit - 1 + e^(tilt x)), without overflow on either side."""
    return F.lit(float(limit)) / (1 + F.lit(limit - 1.0) * F.exp(-F.least(tilt * x, F.lit(700.0))))


def copies_of_sizes(cells: DataFrame, solved: DataFrame, limit: int) -> DataFrame:
    """``(key, size, docs, copies)``: whole copies for all documents of a source and size.

    The window of a source runs over its distinct sizes, never over its documents.
    """
    r = F.coalesce(
        rate(F.col("tilt"), F.col("size") / F.col("mean"), limit),
        F.when(F.col("target") > 0, F.lit(float(limit))),
        F.lit(0.0),
    )
    due = F.when(F.col("size") > 0, F.round(F.col("docs") * r, 9)).otherwise(0.0)
    down = Window.partitionBy("key", "class").orderBy(F.desc("size"))
    cut = (
        cells.join(solved, "key")
        .withColumn("class", F.length(F.bin("size")))
        .withColumn("due", due.cast("decimal(28,9)"))
        .withColumn("whole", F.floor("due").cast("long"))
        .withColumn("part", F.col("due") - F.col("whole"))
        .withColumn("upto", F.sum("part").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .select("key", "class", "size", "docs", "whole", "part", "upto")
    )
    cut = settle(cut)
    begin = (F.col("start") / F.lit(float(STARTS))).cast("decimal(10,9)")
    more = (
        F.floor(F.col("upto") + begin) - F.floor(F.col("upto") - F.col("part") + begin)
    ).cast("long")
    off = F.sum(F.col("size") * (more - F.col("part"))).cast("double")
    starts = cut.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    # At most 63 classes of STARTS numbers for a source.
    by_class = (
        starts.groupBy("key", "class", "start")
        .agg(off.alias("off"))
        .groupBy("key", "class")
        .agg(F.collect_list(F.struct("off", "start")).alias("offs"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("class")).alias("down"), "offs"))).alias("all"))
    )
    chosen = "array<struct<class:int,start:int>>"

    def take(done: Column, at: Column) -> Column:
        tried = F.transform(
            at["offs"],
            lambda x: F.struct(
                F.abs(done["left"] + x["off"]).alias("far"),
                x["start"].alias("start"),
                (done["left"] + x["off"]).alias("left"),
            ),
        )
        best = F.array_min(tried)
        own = F.struct((-at["down"]).alias("class"), best["start"].alias("start"))
        starts_ = F.concat(done["starts"], F.array(own).cast(chosen))
        return F.struct(best["left"].alias("left"), starts_.alias("starts"))

    nothing = F.struct(F.lit(0.0).alias("left"), F.array().cast(chosen).alias("starts"))
    best = by_class.select(
        "key", F.inline(F.aggregate("all", nothing, take, lambda done: done["starts"]))
    )
    return cut.join(best, ["key", "class"]).select(
        "key", "size", "docs", (F.col("whole") + more).alias("copies")
    )


def mix(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: list[int] | None = None,
    limit: int = 3,
    carry: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, all where not given) with the copies the mix takes.

    Adds ``size``, ``source_size``, ``target`` (of the source) and ``copies`` (0 to ``limit``).
    """
    weights = weights or [1, 2, 3]
    carry = docs.columns if carry is None else carry
    mark = F.xxhash64(F.lit(7), F.col(row_id))
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in carry]).alias("row"),
        F.col(source).alias("source"),
        _key(F.col(source)).alias("key"),
        word_count(F.col(text)).alias("size"),
        mark.alias("mark"),
        F.pmod(F.shiftright(mark, 20), F.lit(SLICES)).alias("slice"),
    )
    # Counts by source, size and slice: all that the solution and the ranks need.
    slices = settle(
        rows.groupBy("source", "key", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    )
    targets = settle(
        source_targets(
            slices.select("source", (F.col("size") * F.col("n")).alias("size")), weights, limit
        )
    )
    cells = settle(slices.groupBy("key", "size").agg(F.sum("n").alias("docs")))
    copies = copies_of_sizes(cells, tilts(cells, targets, limit), limit)
    before = Window.partitionBy("key", "size").orderBy("slice")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    base = F.floor(F.col("copies") / F.col("docs"))
    shares = (
        slices.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(copies, ["key", "size"])
        .join(targets, "key")
        .select(
            "key",
            "size",
            "slice",
            "source_size",
            "target",
            base.alias("base"),
            # How many documents of this slice get one copy more.
            (F.col("copies") - base * F.col("docs") - F.col("before")).alias("more"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("mark"))
    found = rows.withColumn("rank", rank).join(shares, ["key", "size", "slice"])
    taken = F.col("base") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    return unpacked(
        found,
        carry,
        size=F.col("size"),
        source_size=F.col("source_size"),
        target=F.col("target"),
        copies=taken.cast("int"),
    )
