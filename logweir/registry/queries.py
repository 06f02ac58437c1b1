"""One query per operator over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.corpora import event_lines, event_messages, order_lines, spread_table, table
from logweir.functions.text import expand_abbreviations, replace_all
from logweir.functions.timestamps import index_timestamp, index_timestamp_text
from logweir.functions.vectors import embed, hash_embedding, is_zero
from logweir.operators import anomaly, features, parse, reports, similar, templates
from logweir.operators.lexical_search import KEYWORD_FIELDS, TEXT_FIELDS, lexical_hits, lexical_top_k
from logweir.operators.lookup import lookup_or_compute, report_lookup
from logweir.operators.vector_search import vector_top_k
from logweir.operators.word_index import append_index, index_hits, index_top_k
from logweir.plans import answers, retrieval
from logweir.session import prepare, scratch, settle
from logweir.sources.files import scan_log_dir, with_log_ids
from logweir.sources.store import write_csv
from logweir.streaming.ingest import start_ingest, stream_bucket_means

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

INGEST = "2030-01-01 00:00:00"
TS_TEXT = "yyyy-MM-dd HH:mm:ss"

ORDER_QUERIES = [
    (1, "what happened to order ORD000123"),
    (2, "urgent orders of CUST000037 please"),
    (3, "trace a1d0c6e8-3f02-7327-d846-1063f4ac58a6"),
    (4, "all fine?"),
    (5, "specified since 19980101"),
]
WORD_TOKENS = [(1, 0, "thesened"), (1, 1, "the with"), (2, 0, "nation"), (3, 0, "error"), (3, 1, "in")]
ORDER_TOKENS = [
    (1, 0, "ORD000123"),
    (2, 0, "urgent"),
    (2, 1, "CUST000037"),
    (3, 0, "a1d0c6e8-3f02-7327-d846-1063f4ac58a6"),
    (4, 0, "not specified"),
    (5, 0, "specified not"),
]
PLANS = [
    (1, "find order", '{"search_query": "order ORD000123", "tokens": ["ORD000123"]}'),
    (2, "hello", "NO_SEARCH_NEEDED"),
    (3, "dates", '{"search_query": "", "tokens": [], "date_range": {"from": "1998-01-01", "to": "1998-01-03"}}'),
    (4, "vague", '{"search_query": "Order ORD is URGENT", "tokens": ["zzzzzz"]}'),
    (5, "vague in time", '{"search_query": "Order is LOW", "tokens": ["qqqqqq"], '
     '"date_range": {"from": "1998-01-01T00:00:00.000+0000", "to": "1998-02-01T00:00:00.000+0000"}}'),
]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as logs: type as source, value as score."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("source"),
        F.expr(
            "case event_id % 3 when 0 then 'INFO' when 1 then 'ERROR' else 'WARNING' end"
        ).alias("level"),
        F.concat_ws(" ", F.lit("user"), "user_id", F.lit("did"), "event_type").alias("message"),
        F.col("value").alias("anomaly_score"),
        F.col("user_id"),
    )


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed order lines."""
    return parse.parse_logs(order_lines(spark, sf_dir), F.lit(INGEST).cast("timestamp"))


def stored_orders(spark: SparkSession, sf_dir: str, *columns: str | F.Column) -> DataFrame:
    """Columns of the parsed order lines, written out so that a line is parsed once.

    Rows stay in their partitions: where directions tie, those that a detector finds depend on it.
    """
    return settle(order_logs(spark, sf_dir).select(*columns))


def searchable_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed order lines with a vector per message, written out as a log table is."""
    path = scratch(spark)
    logs = order_logs(spark, sf_dir).withColumn("log_vector", embed(F.col("message")))
    logs.drop("attrs").write.parquet(path)
    return spark.read.parquet(path)


def _text(ts: str = "timestamp", pattern: str = TS_TEXT) -> F.Column:
    return F.date_format(ts, pattern).alias("ts")


def _order_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ORDER_QUERIES, "query_id long, query string")


# -- parsing -----------------------------------------------------------------


@query
def parse_log4j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_logs(spark, sf_dir).select(
        "log_id",
        _text(),
        "message",
        "source",
        "level",
        "trace_id",
        "order_number",
        "customer_id",
        "order_status",
        "amount",
        "order_lines",
        "hold_reason",
    )


@query
def parse_mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse.parse_logs(event_lines(spark, sf_dir), F.lit(INGEST).cast("timestamp"))
    return logs.select(
        "log_id",
        "format",
        _text(),
        "ts_defaulted",
        "message",
        "source",
        "level",
        "customer_id",
        "order_status",
        "order_lines",
        "shipping_provider",
        F.col("attrs")["host"].alias("host"),
        F.col("attrs")["ip"].alias("ip"),
        F.col("attrs")["request"].alias("request"),
        F.col("attrs")["size"].alias("size"),
    )


@query
def parse_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").selectExpr(
        "event_id as log_id",
        "'bad.log' as file_name",
        """case event_id % 3
             when 0 then concat('{"svc": "', event_type, '", "details": ', user_id, '}')
             when 1 then concat('{"svc": "', event_type, '", "details": null, "n": ', user_id, '}')
             else concat('{"svc": "', event_type, '", "details": "cut off') end as line""",
    )
    return parse.parse_logs(lines, F.lit(INGEST).cast("timestamp")).select(
        "log_id", "format", "level", "source", "message", "semantic_template"
    )


@query
def parse_prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").selectExpr(
        "event_id as log_id",
        """case event_id % 4
             when 0 then concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), ' ERROR ', event_type, ' of ', user_id)
             when 1 then concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), ' NOTE ', event_type)
             when 2 then concat('job warning ', event_type, ' of ', user_id)
             else concat('nothing special about ', event_type) end as line""",
    )
    part = parse.split_prefix(F.col("line"))
    return lines.select("log_id", part.alias("p")).select(
        "log_id",
        F.date_format("p.timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"),
        F.col("p.level").alias("level"),
        F.col("p.message").alias("message"),
    )


@query
def parse_format_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").selectExpr(
        "event_id as log_id",
        """case when event_id % 10 = 9 then concat('no fit ', event_type)
             else concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' WARN ', event_type, ': user ',
                         user_id, ' took ', event_id % 1000, ' ms') end as line""",
    )
    loaded = parse.parse_with_format(lines, "<Date> <Time> <Level> <Component>: <Content>")
    content = replace_all(F.col("Content"), [(r"\d+", "<num>")])
    return loaded.select(
        "log_id",
        "fits",
        F.col("Date").alias("day"),
        F.col("Time").alias("clock"),
        F.col("Level").alias("level"),
        F.col("Component").alias("component"),
        content.alias("content"),
        F.when(F.col("fits"), F.size(F.split(content, " "))).cast("long").alias("tokens"),
    )


@query
def index_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(
        F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    now = F.lit(INGEST).cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        index_timestamp(F.col("ts").cast("timestamp")).alias("from_time"),
        index_timestamp_text(F.coalesce(text, F.lit("no time")), now).alias("from_text"),
    )


@query
def expand_abbreviation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('DB conn err for usr ', user_id, ': Req ', event_id, ' resp ', event_type, "
        "' subdb msg=temp_1, dest-src QA ADD') as line",
    )
    return lines.select("event_id", expand_abbreviations(F.col("line")).alias("line"))


@query
def scan_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    lines = order_lines(spark, sf_dir).select("line")
    lines.write.text(f"{root}/day/one")
    lines.union(lines.select(F.lit(" ").alias("line"))).write.option("quote", "").csv(f"{root}/csv")
    found = parse.parse_logs(with_log_ids(scan_log_dir(spark, root)))
    return found.select(
        F.length("log_id").cast("long").alias("id_length"),
        _text(),
        "order_number",
        "level",
        "source",
        "message",
    )


# -- filters, lists, counts --------------------------------------------------


@query
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = reports.recent_logs(event_logs(spark, sf_dir), 100)
    return logs.select("log_id", index_timestamp(F.col("timestamp")).alias("ts"), "source", "message")


@query
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_messages(event_logs(spark, sf_dir), 10).select("log_id", "message")


@query
def anomalies_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = reports.recent_anomalies(event_logs(spark, sf_dir), threshold=150.0, size=100)
    return logs.select("log_id", "source", "anomaly_score")


@query
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.anomaly_report(event_logs(spark, sf_dir), threshold=150.0, size=5)


@query
def date_range_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = [dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 10, 6), dt.datetime(2024, 1, 11)]
    logs = reports.date_range_logs(event_logs(spark, sf_dir), dates, size=100)
    return logs.select("log_id", index_timestamp(F.col("timestamp")).alias("ts"), "source")


@query
def info_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return reports.info_last_day(event_logs(spark, sf_dir), as_of).select("log_id", "source", "level")


@query
def logs_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.logs_per_source(parse.parse_logs(event_lines(spark, sf_dir)))


@query
def top_hits_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = reports.newest_per_source(event_logs(spark, sf_dir), 5)
    return logs.select("source", F.col("rank").cast("long").alias("rank"), "log_id", "message")


@query
def context_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    found = reports.context_messages(event_logs(spark, sf_dir), as_of, 20, buckets=3)
    return found.select("source", F.col("rank").cast("long").alias("rank"), "log_id", "message")


@query
def bucket_mean_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = reports.bucket_means(event_logs(spark, sf_dir), "anomaly_score")
    return reports.flag_buckets(means).select(
        _text("bucket"),
        F.round("mean", 9).alias("mean"),
        "count",
        F.coalesce("past_buckets", F.lit(0)).alias("past_buckets"),
        F.round("past_mean", 9).alias("past_mean"),
        "anomalous",
    )


@query
def bucket_mean_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    stored = table(spark, sf_dir, "events")
    stream = (
        spark.readStream.schema(stored.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select(F.col("ts").cast("timestamp").alias("timestamp"), "value")
    )
    # complete mode: all buckets are compared, also those the watermark holds back
    running = (
        reports.bucket_means(stream, "value")
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/means"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{root}/means").select(
        _text("bucket"), F.round("mean", 9).alias("mean"), "count"
    )


@query
def bucket_mean_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed buckets only: events come in two deliveries, the second with late ones.

    The first has the first half of the month without its errors; those come with the
    second, too late for buckets that ended ten minutes before the last event seen.
    """
    root = scratch(spark)
    events = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), "value", "event_type"
    )
    early = F.expr("timestamp < timestamp '2024-01-16' and event_type <> 'error'")
    for delivery in (early, ~F.coalesce(early, F.lit(False))):
        events.where(delivery).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        (
            stream_bucket_means(stream, "value")
            .writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", f"{root}/checkpoint")
            .option("path", f"{root}/means")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    means = spark.read.schema("bucket timestamp, mean double, count long").parquet(f"{root}/means")
    return means.select(_text("bucket"), F.round("mean", 9).alias("mean"), "count")


# -- search ------------------------------------------------------------------


@query
def query_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as query_id",
        """concat('why did ORD', o_orderkey, ' of cust', o_custkey, ' fail after ',
             date_format(o_orderdate, 'yyyyMMdd'), ' or ', date_format(o_orderdate, 'yyyy-MM-dd'),
             '? see ', regexp_replace(md5(cast(o_orderkey as string)),
               '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5'), ' ', o_orderpriority) as query""",
    )
    return retrieval.understand(asked).select(
        "query_id",
        F.array_join("tokens", "|").alias("tokens"),
        F.date_format("lo", TS_TEXT).alias("lo"),
        F.date_format("hi", TS_TEXT).alias("hi"),
    )


@query
def phrase_any_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = spark.createDataFrame(ORDER_TOKENS, "query_id long, token_no int, token string")
    logs = stored_orders(spark, sf_dir, "log_id", *TEXT_FIELDS, *KEYWORD_FIELDS)
    return lexical_hits(logs, tokens).select("query_id", "log_id")


@query
def lexical_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text").selectExpr(
        "doc_id as log_id", "text as message"
    )
    tokens = spark.createDataFrame(WORD_TOKENS, "query_id long, token_no int, token string")
    return lexical_top_k(docs, tokens, 20).select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "log_id",
        F.round("score", 6).alias("score"),
    )


@query
def indexed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = spark.createDataFrame(ORDER_TOKENS, "query_id long, token_no int, token string")
    path = scratch(spark)
    append_index(order_logs(spark, sf_dir), path)
    return index_hits(spark, path, tokens).select("query_id", "log_id")


@query
def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index takes the documents of one language, then all; known ones stay as they are."""
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text", "lang").selectExpr(
        "doc_id as log_id", "text as message", "lang"
    )
    tokens = spark.createDataFrame(WORD_TOKENS, "query_id long, token_no int, token string")
    path = scratch(spark)
    append_index(docs.where("lang = 'en'"), path)
    append_index(docs, path)
    return index_top_k(spark, path, tokens, 20).select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "log_id",
        F.round("score", 6).alias("score"),
    )


@query
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", hash_embedding(F.col("text")).alias("v")
    )
    return (
        turns.select("conv_id", "turn", is_zero(F.col("v")).alias("zero"), F.posexplode("v"))
        .select(
            "conv_id",
            "turn",
            "zero",
            F.col("pos").cast("long").alias("cell"),
            F.round("col", 6).alias("value"),
        )
    )


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with a time each, and the mean vector of every label as query."""
    stored = table(spark, sf_dir, "embeddings")
    logs = stored.select(
        F.col("vec_id").alias("log_id"),
        F.col("embedding").alias("log_vector"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("vec_id").cast("int"))).alias(
            "timestamp"
        ),
    )
    means = (
        stored.select("label", F.posexplode("embedding"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("value"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("cells"))
        .select(
            F.col("label").cast("long").alias("query_id"),
            F.transform("cells", lambda c: c["value"]).alias("query_vector"),
        )
    )
    return logs, means


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, means = _vectors(spark, sf_dir)
    return vector_top_k(logs, means, 10).select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "log_id",
        F.round("score", 6).alias("score"),
    )


@query
def vector_topk_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, means = _vectors(spark, sf_dir)
    start = F.lit("2024-01-02").cast("timestamp")
    asked = means.withColumn(
        "lo", start + F.make_dt_interval(hours=F.col("query_id").cast("int"))
    ).withColumn("hi", F.col("lo") + F.expr("INTERVAL 5 DAYS"))
    return vector_top_k(logs, asked, 10).select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "log_id",
        F.round("score", 6).alias("score"),
    )


def _hits(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id",
        F.col("pos").cast("long").alias("pos"),
        "log_id",
        F.round("score", 6).alias("score"),
    )


@query
def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.hybrid_union(searchable_orders(spark, sf_dir), _order_queries(spark), k=100)
    return reports.with_count(_hits(hits), ["query_id"])


@query
def hybrid_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(
        retrieval.hybrid_top(searchable_orders(spark, sf_dir), _order_queries(spark), size=5)
    )


def _plans(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PLANS, "query_id long, message string, response string")
    return retrieval.parse_plans(rows)


@query
def lexical_else_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(
        retrieval.lexical_else_vector(searchable_orders(spark, sf_dir), _plans(spark), k=20)
    )


@query
def hits_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.hybrid_top(searchable_orders(spark, sf_dir), _order_queries(spark), size=5)
    return answers.hits_as_text(hits.withColumn("anomaly_score", F.col("log_id") % 2 + F.lit(0.0)))


@query
def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = searchable_orders(spark, sf_dir)
    asked = _order_queries(spark)
    hits = retrieval.with_content(retrieval.vectors(logs, asked, 10), logs)
    return answers.answer_text(hits, asked)


@query
def dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return retrieval.dedupe_content(docs, ["lang"], F.col("text"), order="doc_id").select(
        "doc_id", "lang"
    )


@query
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed(
        "doc_id", "id"
    )
    return similar.near_duplicates(docs).select("id", "leader", F.round("ratio", 6).alias("ratio"))


@query
def similar_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = similar.similar_pairs(turns.join(later, ["conv_id", "turn"]), "text", "reply")
    return pairs.select("conv_id", "turn", "similar", F.round("ratio", 6).alias("ratio"))


# -- templates and lookups ---------------------------------------------------


@query
def message_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = settle(templates.distinct_messages(event_messages(spark, sf_dir)))
    found = templates.mine_templates(messages)
    return templates.template_sizes(messages, found).select("template", "messages", "logs")


@query
def attached_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = event_messages(spark, sf_dir)
    found = templates.mine_templates(settle(templates.distinct_messages(logs)))
    return templates.attach_templates(logs, found).select("log_id", "semantic_template")


@query
def template_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = event_messages(spark, sf_dir)
    stored = (
        logs.where(F.startswith("message", F.lit("user")))
        .select("message")
        .distinct()
        .withColumn("template", F.lit("stored"))
    )

    def mine(missing: DataFrame) -> DataFrame:
        return templates.mine_templates(missing.withColumn("first_id", F.col("message")))

    named, _ = lookup_or_compute(logs, stored, mine, "template")
    return named.select("log_id", "template")


@query
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("log_id"), F.col("text").alias("message"), "role"
    )
    one = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), 383)).cast("array<float>")
    stored = logs.where(F.col("role") == "user").select("message").distinct()
    stored = stored.withColumn("log_vector", one)

    def compute(missing: DataFrame) -> DataFrame:
        return missing.withColumn("log_vector", embed(F.col("message")))

    named, _ = lookup_or_compute(logs, stored, compute, "log_vector")
    return named.select("log_id", F.round(F.col("log_vector")[0].cast("double"), 5).alias("cell"))


@query
def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    reported = events.where("value > 100").select(
        F.concat_ws(" ", "event_type", "user_id").alias("message"),
        F.concat(F.lit("report "), "event_id").alias("llm_report"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    logs = events.select(
        F.col("event_id").alias("log_id"), F.concat_ws(" ", "event_type", "user_id").alias("message")
    )
    return report_lookup(logs, reported).select("log_id", "message", "llm_report")


# -- features and anomalies --------------------------------------------------


@query
def tfidf_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    model = features.fit_tfidf(docs, "text")
    listed = features.terms_of(model)
    term = F.element_at(F.array(*[F.lit(t) for t in listed]), F.col("pos") + 1)
    return (
        features.tfidf(model, docs)
        .select("doc_id", F.posexplode(vector_to_array("tfidf")))
        .where(F.col("col") > 0)
        .select("doc_id", term.alias("term"), F.round("col", 6).alias("weight"))
    )


@query
def pca_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = features.level_and_message(F.col("level"), F.col("message")).alias("message")
    logs = stored_orders(spark, sf_dir, "log_id", text)
    scored = anomaly.fit_detector(logs).score(logs)
    return scored.select("log_id", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly_label")


@query
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id as log_id", "embedding as features")
    return anomaly.isolation_forest(vectors).select(
        "log_id", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly_label"
    )


@query
def sequence_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    judged = anomaly.sequence_anomalies(
        events, "user_id", "ts", "event_id", "event_type", h=2, top=3
    )
    return judged.select("event_id", F.array_join("history", ",").alias("history"), "anomalous")


# -- plans, contexts, prompts ------------------------------------------------


@query
def plan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.to_json(
        F.struct(
            F.col("text").alias("search_query"),
            F.array("role", F.concat(F.lit("ORD"), "conv_id")).alias("tokens"),
            F.struct(
                F.lit("2024-01-05T00:00:00.000+0000").alias("from"),
                F.lit("2024-01-03").alias("to"),
            ).alias("date_range"),
        )
    )
    broken = F.to_json(
        F.struct(F.col("text").alias("search_query"), F.col("role").alias("tokens"), F.lit("x").alias("date_range"))
    )
    response = (
        F.when(F.col("turn") % 5 == 0, asked)
        .when(F.col("turn") % 5 == 1, F.lit(" no_search_needed "))
        .when(F.col("turn") % 5 == 2, F.lit('{"NO_SEARCH_NEEDED": true, "search_query": "x"}'))
        .when(F.col("turn") % 5 == 3, broken)
        .otherwise(F.concat(F.lit("look for "), "role"))
    )
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", response.alias("response")
    )
    return retrieval.parse_plans(rows).select(
        "conv_id",
        "turn",
        "no_search",
        "search_query",
        F.array_join("tokens", "|").alias("tokens"),
        F.date_format("lo", TS_TEXT).alias("lo"),
        F.date_format("hi", TS_TEXT).alias("hi"),
    )


def _newest_order_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest orders of each source, as the hits of one query per source."""
    logs = reports.newest_per_source(order_logs(spark, sf_dir), 20)
    return logs.withColumn("query_id", F.col("source")).withColumnRenamed("rank", "pos")


@query
def context_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.context_text(_newest_order_hits(spark, sf_dir))


@query
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.transcripts(table(spark, sf_dir, "conversations"))


@query
def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    current = turns.select("conv_id").distinct().withColumn("message", F.lit("what broke?"))
    talks = answers.transcripts(turns, current)
    plans = current.select(
        F.col("conv_id").alias("query_id"),
        "message",
        (F.col("conv_id") % 3 == 0).alias("no_search"),
        F.lit("broken orders").alias("search_query"),
    )
    sources = F.array(*[F.lit(f"{s}-service") for s in ("order", "payment", "inventory", "shipping")])
    context = answers.context_text(_newest_order_hits(spark, sf_dir)).withColumnRenamed(
        "query_id", "source"
    )
    contexts = plans.select(
        "query_id", sources[(F.col("query_id") % 4).cast("int")].alias("source")
    ).join(context, "source")
    return answers.prompt_rows(
        plans,
        contexts.select("query_id", "context"),
        talks.select(F.col("conv_id").alias("query_id"), "transcript"),
    )


@query
def parse_json_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that look like JSON stay; inside real JSON two names of one meaning become one."""
    line = F.format_string(
        '{"time": "%s", "details": "{\\"status\\": %d}", "items": [{"price": 1, "total": %d}]}',
        F.date_format("ts", TS_TEXT),
        F.col("user_id").cast("long"),
        F.col("event_id").cast("long"),
    )
    lines = spread_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), F.lit("f.log").alias("file_name"), line.alias("line")
    )
    return parse.parse_logs(lines).select("log_id", "message", "order_lines")


@query
def parse_nested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one meaning become one at any depth of a nested value."""
    line = F.format_string(
        '{"time": "%s", "items": [{"a": {"b": [{"c": {"price": 1, "d": {"price": 2, "total": %d}, "total": %d}}]}}]}',
        F.date_format("ts", TS_TEXT),
        F.col("event_id").cast("long"),
        F.col("user_id").cast("long"),
    )
    lines = spread_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), F.lit("f.log").alias("file_name"), line.alias("line")
    )
    return parse.parse_logs(lines).select("log_id", "order_lines")


# -- ingest ------------------------------------------------------------------


@query
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    lines = order_lines(spark, sf_dir).select("line")
    lines.write.text(f"{root}/logs")
    places = {name: f"{root}/{name}" for name in ("table", "templates", "alerts")}
    # the second run has a checkpoint of its own and meets all files again
    for run in ("first", "second"):
        stream = start_ingest(
            spark, f"{root}/logs", checkpoint=f"{root}/{run}", every=None, **places
        )
        stream.awaitTermination()
    return spark.read.parquet(places["table"]).select(
        _text(),
        "order_number",
        "level",
        "source",
        "message",
        F.date_format("log_date", "yyyy-MM-dd").alias("log_date"),
        F.size("log_vector").cast("long").alias("vector_size"),
        "anomaly_score",
        F.col("anomaly_label").cast("long").alias("anomaly_label"),
    )


@query
def scored_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    logs = stored_orders(spark, sf_dir, "log_id", "message", "source")
    detector = anomaly.fit_detector(logs)
    detector.save(spark, f"{root}/model")
    scored = anomaly.Detector.load(spark, f"{root}/model").score(logs)
    write_csv(scored, f"{root}/csv")
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .schema("log_id long, message string, source string, anomaly_score double, anomaly_label int")
        .csv(f"{root}/csv")
        .withColumn("anomaly_score", F.round("anomaly_score", 6))
    )
