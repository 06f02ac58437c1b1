"""The five kinds of retrieval, each for a whole table of queries.

Hits are ``(query_id, log_id, score, pos)``; ``pos`` is the place in the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.text import query_tokens
from logweir.functions.timestamps import token_date
from logweir.functions.vectors import embed
from logweir.operators.lexical_search import lexical_top_k
from logweir.operators.vector_search import vector_top_k
from logweir.schema import LOG_SCHEMA
from logweir.session import is_small, join_on_hot_keys, settle, top_k_per_group

#: What a hit shows: the stored record without vector and template.
CONTENT = sorted(
    set(LOG_SCHEMA.names) - {"log_id", "ts_defaulted", "attrs", "semantic_template", "log_vector"}
)


def understand(queries: DataFrame, text: str = "query") -> DataFrame:
    """Add ``tokens`` (supplied ones are kept) and the time range of the dates among them."""
    own = query_tokens(F.col(text))
    if "tokens" in queries.columns:
        given = F.col("tokens")
        own = F.when(F.size(given) > 0, given).otherwise(own)
    dates = F.filter(F.transform(own, token_date), lambda d: d.isNotNull())
    return queries.withColumns(
        {"tokens": own, "lo": F.array_min(dates), "hi": F.array_max(dates)}
    )


def parse_plans(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add ``no_search``, ``search_query``, ``tokens``, ``lo`` and ``hi`` to plan responses.

    A response is a JSON object or the bare phrase ``NO_SEARCH_NEEDED``; any
    other text is the search query itself. Malformed tokens or dates are empty.
    """
    text = F.regexp_replace(F.col(response), r"(?U)^\s+|\s+$", "")
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    parsed = F.when(
        text.rlike(r"(?s)^\{.*\}\z"), F.from_json(text, "map<string,string>", strict)
    )
    plan = responses.withColumn("_text", text).withColumn("_plan", parsed)
    value = {
        name: F.try_element_at(F.col("_plan"), F.lit(name))
        for name in ("NO_SEARCH_NEEDED", "search_query", "tokens", "date_range")
    }
    is_plan = F.col("_plan").isNotNull()
    flagged = ~F.coalesce(value["NO_SEARCH_NEEDED"], F.lit("")).isin(
        "", "false", "0", "0.0", "[]", "{}"
    )
    listed = value["tokens"].rlike(r"(?s)^\s*\[")
    tokens = F.when(listed, F.from_json(value["tokens"], "array<string>"))
    span = F.from_json(value["date_range"], "map<string,string>")
    ends = [token_date(F.try_element_at(span, F.lit(name))) for name in ("from", "to")]
    both = ends[0].isNotNull() & ends[1].isNotNull()
    phrase = F.upper("_text") == "NO_SEARCH_NEEDED"
    no_search = F.when(is_plan, flagged).otherwise(phrase)
    asked = F.when(is_plan, F.coalesce(value["search_query"], F.lit(""))).otherwise(F.col("_text"))
    search = ~F.col("no_search")
    return (
        plan.withColumn("no_search", no_search)
        .withColumns(
            {
                "search_query": F.when(search, asked),
                "tokens": F.when(search & is_plan, F.coalesce(tokens, F.array())).otherwise(
                    F.array()
                ).cast("array<string>"),
                "lo": F.when(search & both, F.least(*ends)),
                "hi": F.when(search & both, F.greatest(*ends)),
            }
        )
        .drop("_text", "_plan")
    )


def token_rows(queries: DataFrame) -> DataFrame:
    """One row per query token, with the time range of its query."""
    return queries.select(
        "query_id", "lo", "hi", F.posexplode("tokens").alias("token_no", "token")
    )


def _in_ranges(logs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(query_id, log_id, timestamp)`` of the logs inside each inclusive ``lo`` to ``hi``.

    Days fall in blocks of 2^level of them. A range takes the lowest level at which it
    touches at most two blocks, so it is one or two rows whatever its length; a log has one
    block on each level in use, of which there are no more than bits in a number of days.
    Days outside of all ranges are left out at the scan, as whole partitions where the
    logs have ``log_date``. A range that ends before it starts holds nothing.
    """
    day = lambda time: F.unix_date(F.to_date(time))
    apart = day("hi") - day("lo")
    level = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart))).cast("int")
    block = lambda number: F.call_function("shiftright", number, F.col("level"))
    blocks = F.array_distinct(F.array(block(day("lo")), block(day("hi"))))
    ranges = (
        ranges.where(F.col("lo") <= F.col("hi"))
        .withColumn("level", level)
        .select("query_id", "lo", "hi", "level", F.explode(blocks).alias("block"))
    )
    asked = ranges.agg(F.min("lo"), F.max("hi"), F.sort_array(F.collect_set("level"))).first()
    first, last, levels = asked
    inside = F.col("timestamp").between(F.lit(first), F.lit(last))
    if "log_date" in logs.columns:
        inside &= F.col("log_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    placed = (
        logs.where(inside)
        .select(
            "log_id",
            "timestamp",
            F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"),
        )
        .withColumn("block", block(day("timestamp")))
    )
    return (
        join_on_hot_keys(placed, ranges, ["level", "block"], "log_id")
        .where(F.col("timestamp").between(F.col("lo"), F.col("hi")))
        .select("query_id", "log_id", "timestamp")
    )


def _newest_hits(logs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits of queries without tokens: by date range alone, or simply the newest logs.

    Ranges are joined with logs by blocks of days, see ``_in_ranges``.
    """
    newest = [F.col("timestamp").desc(), F.col("log_id").asc()]
    bare = queries.where(F.size("tokens") == 0)
    ranged = bare.where(F.col("lo").isNotNull())
    dated = _in_ranges(logs, ranged).withColumn("score", F.lit(0.0))
    dated = top_k_per_group(dated, ["query_id"], newest, k, spread="log_id", rank="pos")
    top = (
        logs.select("log_id", "timestamp")
        .orderBy(*newest)
        .limit(k)
        .agg(F.collect_list(F.struct(F.col("timestamp"), F.col("log_id"))).alias("top"))
    )
    order = lambda a, b: (
        F.when(a["timestamp"] > b["timestamp"], -1)
        .when(a["timestamp"] < b["timestamp"], 1)
        .when(a["log_id"] < b["log_id"], -1)
        .otherwise(1)
    )
    any_time = (
        bare.where(F.col("lo").isNull())
        .select("query_id", F.lit(1).alias("one"))
        .join(top.select(F.array_sort("top", order).alias("top"), F.lit(1).alias("one")), "one")
        .select("query_id", F.posexplode("top").alias("at", "hit"))
        .select(
            "query_id",
            "hit.log_id",
            F.lit(1.0).alias("score"),
            (F.col("at") + 1).alias("pos"),
        )
    )
    return dated.select("query_id", "log_id", "score", "pos").unionByName(any_time)


def lexical(logs: DataFrame, queries: DataFrame, k: int, match_all: bool = True) -> DataFrame:
    """Lexical hits; with ``match_all`` a query without tokens asks for the newest logs."""
    hits = lexical_top_k(logs, token_rows(queries), k).withColumnRenamed("rank", "pos")
    if match_all:
        hits = hits.unionByName(_newest_hits(logs, queries, k))
    return hits


def vectors(
    logs: DataFrame,
    queries: DataFrame,
    k: int,
    text: str = "query",
    model: Callable[[Column], Column] | None = None,
    ranged: bool = False,
) -> DataFrame:
    """Vector hits of the embedded query text, optionally inside its time range."""
    columns = ["query_id", embed(F.col(text), model).alias("query_vector")]
    asked = queries.select(*columns, *(["lo", "hi"] if ranged else []))
    return vector_top_k(logs, asked, k).withColumnRenamed("rank", "pos")


def union_hits(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Union by log: place of the first occurrence, score of the last."""
    both = first.unionByName(second.withColumn("pos", F.col("pos") + k))
    return both.groupBy("query_id", "log_id").agg(
        F.max_by("score", "pos").alias("score"), F.min("pos").alias("pos")
    )


def renumber(hits: DataFrame, size: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """First ``size`` hits of each query, places counted from 1."""
    ranked = top_k_per_group(
        hits.withColumnRenamed("pos", "_pos"), list(keys), [F.col("_pos")], size, "log_id", rank="pos"
    )
    return ranked.drop("_pos")


def with_content(hits: DataFrame, logs: DataFrame) -> DataFrame:
    """Hits with the columns they show; a checked-small hit list is what gets broadcast.

    The hits are computed once, for the check and for the join.
    """
    hits = settle(hits)
    shown = logs.select("log_id", *[c for c in CONTENT if c in logs.columns])
    return shown.join(F.broadcast(hits) if is_small(hits) else hits, "log_id")


def content_json(df: DataFrame) -> Column:
    """JSON of what a hit shows, names in order; missing values are written as null."""
    shown = [c for c in CONTENT if c in df.columns]
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})


def dedupe_content(
    rows: DataFrame, keys: list[str], content: Column, order: str = "pos"
) -> DataFrame:
    """Keep the first of rows with equal content, by a partial aggregate on its digest."""
    others = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.col(order))
    digest = F.sha2(content, 256).alias("_digest")
    return (
        rows.groupBy(*keys, digest)
        .agg(first.alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
    )


def hybrid_union(
    logs: DataFrame,
    queries: DataFrame,
    k: int = 100,
    size: int | None = None,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``k`` lexical and ``k`` vector hits, merged by log, equal contents dropped.

    ``size`` is an optional cut of the merged list; by default all is returned.
    """
    asked = understand(queries)
    hits = union_hits(lexical(logs, asked, k), vectors(logs, asked, k, model=model), k)
    unique = dedupe_content(with_content(hits, logs), ["query_id"], content_json(logs))
    return renumber(unique, size or 2 * k)


def hybrid_top(
    logs: DataFrame,
    queries: DataFrame,
    size: int = 5,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``size`` lexical and ``size`` vector hits, cut to ``size`` before equal contents go."""
    asked = understand(queries).withColumns(
        {"lo": F.lit(None).cast("timestamp"), "hi": F.lit(None).cast("timestamp")}
    )
    words = lexical(logs, asked, size, match_all=False)
    hits = renumber(union_hits(words, vectors(logs, asked, size, model=model), size), size)
    unique = dedupe_content(with_content(hits, logs), ["query_id"], content_json(logs))
    return renumber(unique, size)


def lexical_else_vector(
    logs: DataFrame,
    plans: DataFrame,
    k: int = 100,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Hits for parsed plans: lexical, and vectors only where no word was found.

    Plans with dates but no tokens are answered by the dates alone.
    """
    asked = plans.where(~F.col("no_search"))
    found = settle(lexical(logs, asked, k))
    dates_only = (F.size("tokens") == 0) & F.col("lo").isNotNull()
    unanswered = asked.where(~dates_only).join(
        found.select("query_id").distinct(), "query_id", "left_anti"
    )
    near = vectors(logs, unanswered, k, text="search_query", model=model, ranged=True)
    hits = found.unionByName(near)
    unique = dedupe_content(with_content(hits, logs), ["query_id"], content_json(logs))
    return renumber(unique, k)
