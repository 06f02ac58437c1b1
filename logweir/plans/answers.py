"""Text made of hits, anomalies and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.text import capitalise
from logweir.functions.timestamps import index_timestamp
from logweir.operators.reports import recent_anomalies
from logweir.plans.retrieval import CONTENT
from logweir.schema import ANOMALY_THRESHOLD


def joined(rows: DataFrame, keys: list[str], order: str, text: Column, sep: str) -> DataFrame:
    """Texts of a group in order, as one text; for groups of bounded size."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(pairs, lambda p: p["t"]), sep).alias("text")
    )


def _or(name: str, missing: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))


def hit_line(rank: str = "pos") -> Column:
    """``i. [time] LEVEL | Score: 0.00 | Anomaly: YES/no`` and the message below."""
    flag = F.when(F.col("anomaly_score") >= ANOMALY_THRESHOLD, "YES").otherwise("no")
    return F.format_string(
        "%d. [%s] %s | Score: %.2f | Anomaly: %s\n   %s",
        F.col(rank),
        F.coalesce(index_timestamp(F.col("timestamp")), F.lit("?")),
        _or("level", "?"),
        F.coalesce("score", F.lit(0.0)),
        flag,
        _or("message", "?"),
    )


def of_queries(texts: DataFrame, queries: DataFrame | None, column: str) -> DataFrame:
    """``texts`` with an empty text for each of ``queries`` that has none."""
    if queries is None:
        return texts
    return (
        queries.select("query_id")
        .distinct()
        .join(texts, "query_id", "left")
        .select("query_id", F.coalesce(column, F.lit("")).alias(column))
    )


def hits_as_text(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One text per query of its hits; with ``queries`` an empty one for those without hits."""
    return of_queries(joined(hits, ["query_id"], "pos", hit_line(), "\n"), queries, "text")


def answer_text(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Similar logs of each query with source and time, or that there are none."""
    line = F.format_string(
        "%d. [%s] %s\n   Source: %s, Timestamp: %s\n",
        F.col("pos"),
        F.col("level"),
        F.col("message"),
        F.col("source"),
        index_timestamp(F.col("timestamp")),
    )
    found = joined(hits, ["query_id"], "pos", line, "").join(
        hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("count")), "query_id"
    )
    text = F.format_string("Found %d logs matching your query:\n\n%s", F.col("count"), F.col("text"))
    return (
        queries.select("query_id")
        .join(found, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("text").isNull(), "No matching logs found.").otherwise(text).alias("text"),
        )
    )


def anomaly_lines(
    logs: DataFrame, threshold: float = ANOMALY_THRESHOLD, size: int = 5
) -> DataFrame:
    """Newest anomalies, one text each; ``size`` rows at most are numbered in one task."""
    newest = recent_anomalies(logs, threshold, size)
    rank = F.row_number().over(Window.orderBy(F.desc("timestamp"), "log_id"))
    line = F.format_string(
        "%d. [%s] %s\n   Score: %.4f, Source: %s\n   Timestamp: %s\n",
        F.col("rank"),
        F.col("level"),
        F.col("message"),
        F.col("anomaly_score"),
        F.col("source"),
        index_timestamp(F.col("timestamp")),
    )
    return newest.withColumn("rank", rank).select("rank", "log_id", line.alias("text"))


def anomaly_report(
    logs: DataFrame, threshold: float = ANOMALY_THRESHOLD, size: int = 5
) -> DataFrame:
    """One text on the newest anomalies, or that there are none."""
    lines = anomaly_lines(logs, threshold, size)
    pairs = F.sort_array(F.collect_list(F.struct("rank", "text")))
    body = F.array_join(F.transform(pairs, lambda p: p["text"]), "\n")
    head = F.format_string("Found %d anomalies in the logs:\n\n", F.count(F.lit(1)))
    return lines.agg(
        F.when(F.count(F.lit(1)) == 0, "No anomalies detected.")
        .otherwise(F.concat(head, body))
        .alias("report")
    )


def hit_json(hits: DataFrame) -> DataFrame:
    """What each hit shows as JSON, time in index format."""
    shown = [
        index_timestamp(F.col(c)).alias(c) if c == "timestamp" else F.col(c)
        for c in CONTENT
        if c in hits.columns
    ]
    text = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    return hits.select("query_id", "log_id", "pos", text.alias("json"))


def context_text(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """JSON lines of the hits of each query, in order: ``(query_id, context)``."""
    text = joined(hit_json(hits), ["query_id"], "pos", F.col("json"), "\n")
    return of_queries(text.withColumnRenamed("text", "context"), queries, "context")


def transcripts(turns: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """``Role: text`` lines of each conversation: ``(conv_id, transcript)``.

    ``turns`` is ``(conv_id, turn, role, text)``; ``current`` ``(conv_id,
    message)`` is added as a user turn unless it is the last turn already. The
    result is one text per conversation, so the longest one must fit a row.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    if current is not None:
        last = turns.groupBy("conv_id").agg(
            F.max("turn").alias("turn"),
            F.max_by(F.struct("role", "text"), "turn").alias("last"),
        )
        same = (F.col("last.role") == "user") & (F.col("last.text") == F.col("message"))
        added = (
            current.join(last, "conv_id", "left")
            .where(~F.coalesce(same, F.lit(False)))
            .select(
                "conv_id",
                (F.coalesce("turn", F.lit(-1)) + 1).alias("turn"),
                F.lit("user").alias("role"),
                F.col("message").alias("text"),
            )
        )
        rows = rows.unionByName(added)
    line = F.concat(capitalise(F.col("role")), F.lit(": "), F.col("text"), F.lit("\n"))
    text = joined(rows, ["conv_id"], "turn", line, "")
    return text.withColumnRenamed("text", "transcript")


# Our own wording: facts in, one instruction, the talk so far.
SEARCH_PROMPT = (
    "You help people read logs. Question: '%s'\nSearch used: '%s'\nMatching logs:\n%s\n\n"
    "Answer briefly from these logs alone and say so when they do not suffice.\n\n"
    "Talk so far:\n%sAssistant: "
)
PLAIN_PROMPT = (
    "You help people read logs. Question: '%s'\n\nAnswer briefly; no logs were searched, "
    "so mention none.\n\nTalk so far:\n%sAssistant: "
)


def prompt_rows(
    plans: DataFrame,
    contexts: DataFrame,
    talks: DataFrame,
    search_prompt: str = SEARCH_PROMPT,
    plain_prompt: str = PLAIN_PROMPT,
) -> DataFrame:
    """One prompt per query, for batch inference elsewhere: ``(query_id, prompt)``.

    ``plans`` has ``query_id``, ``message``, ``no_search`` and ``search_query``,
    ``contexts`` the context per query and ``talks`` the transcript per query.
    """
    rows = plans.join(contexts, "query_id", "left").join(talks, "query_id", "left")
    context = F.coalesce("context", F.lit(""))
    talk = F.coalesce("transcript", F.lit(""))
    searched = F.format_string(search_prompt, F.col("message"), F.col("search_query"), context, talk)
    plain = F.format_string(plain_prompt, F.col("message"), talk)
    return rows.select(
        "query_id", F.when(F.col("no_search"), plain).otherwise(searched).alias("prompt")
    )
