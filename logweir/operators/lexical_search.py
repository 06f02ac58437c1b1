"""Phrase search with BM25 scores for a table of query tokens.

Each query token is a phrase of one or more words. Words of the two analysed
fields are joined by position, so a phrase is a run of matching positions and
no text travels with the postings. Identifier fields match as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.text import words
from logweir.session import is_small, join_on_hot_keys, settle, top_k_per_group

# BM25 parameters.
K1 = 1.2
B = 0.75

TEXT_FIELDS = ["message", "customer_id"]
KEYWORD_FIELDS = ["trace_id", "order_number"]


def _fields(logs: DataFrame, names: list[str]) -> list[str]:
    return [name for name in names if name in logs.columns]


def _range(tokens: DataFrame) -> list[str]:
    return ["lo", "hi"] if {"lo", "hi"} <= set(tokens.columns) else []


def carried_columns(logs: DataFrame, tokens: DataFrame) -> list[str]:
    return ["timestamp"] if _range(tokens) and "timestamp" in logs.columns else []


def _in_range(carried: list[str]) -> Column:
    """Time filter of the query; it bounds the hits, not the term statistics."""
    if not carried:
        return F.lit(True)
    ts = F.col("timestamp")
    after = F.col("lo").isNull() | (ts >= F.col("lo"))
    return after & (F.col("hi").isNull() | (ts <= F.col("hi")))


def query_words(tokens: DataFrame) -> DataFrame:
    """One row per word of a token: ``phrase_words``, ``word_no`` and ``word``."""
    split = tokens.withColumn("_words", words(F.col("token")))
    return split.select(
        "query_id",
        "token_no",
        *_range(tokens),
        F.size("_words").alias("phrase_words"),
        F.posexplode("_words").alias("word_no", "word"),
    )


def _texts(logs: DataFrame, carried: list[str]) -> DataFrame:
    """One row per log and analysed field, with its words."""
    pairs = [
        F.struct(F.lit(name).alias("field"), words(F.col(name)).alias("words"))
        for name in _fields(logs, TEXT_FIELDS)
    ]
    return (
        logs.select("log_id", *carried, F.explode(F.array(*pairs)).alias("f"))
        .select("log_id", *carried, "f.field", "f.words")
        .where(F.col("words").isNotNull())
    )


#: Asked words up to which the plan lists them; more are told apart by the join alone.
LISTED_WORDS = 1000


def _bm25_idf() -> Column:
    df, docs = F.col("df"), F.col("docs")
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def _text_hits(logs: DataFrame, tokens: DataFrame, small: bool) -> DataFrame:
    carried = carried_columns(logs, tokens)
    asked = query_words(tokens)
    texts = _texts(logs, carried)
    sizes = texts.groupBy("field").agg(
        F.count(F.lit(1)).alias("docs"), F.avg(F.size("words")).alias("mean_length")
    )
    vocabulary = asked.select("word").distinct()
    place = F.transform("words", lambda w, at: F.struct(at.alias("position"), w.alias("word")))
    if small:
        # Words nobody asked for are left out before the texts become rows.
        wanted = [r.word for r in vocabulary.limit(LISTED_WORDS + 1).collect()]
        if len(wanted) <= LISTED_WORDS:
            place = F.filter(place, lambda p: p["word"].isin(wanted))
    postings = texts.select(
        "log_id",
        *carried,
        "field",
        F.size("words").alias("length"),
        F.inline(place),
    )
    # Texts are read twice only, for their sizes and for the asked words. Those
    # few postings are written out, as weights and matches both read them.
    seen = settle(
        join_on_hot_keys(postings, vocabulary, ["word"], "log_id", small_known=small)
        .groupBy("field", "word", "log_id", *carried, "length")
        .agg(F.collect_list("position").alias("positions"))
    )
    return text_scores(seen, sizes, asked, carried, small)


def text_scores(
    seen: DataFrame, sizes: DataFrame, asked: DataFrame, carried: list[str], small: bool
) -> DataFrame:
    """Scores of phrases from the postings ``seen`` of their words.

    ``seen`` has a row per field, word and log with ``length`` and ``positions``;
    ``sizes`` has ``docs`` and ``mean_length`` of each field.
    """
    df = seen.groupBy("field", "word").agg(F.count(F.lit(1)).alias("df"))
    word_idf = df.join(F.broadcast(sizes), "field").select(
        "field", "word", _bm25_idf().alias("idf"), "mean_length"
    )
    weights = (
        asked.drop("lo", "hi")
        .join(word_idf, "word")
        .groupBy("query_id", "token_no", "field", "phrase_words", "mean_length")
        .agg(F.sum("idf").alias("idf"), F.count(F.lit(1)).alias("known"))
        .where(F.col("known") == F.col("phrase_words"))
        .drop("known", "phrase_words")
    )
    matched = join_on_hot_keys(seen, asked, ["word"], "log_id", small_known=small)
    matched = matched.where(_in_range(carried))
    keys = ["query_id", "token_no", "field", "log_id", "length"]
    single = matched.where(F.col("phrase_words") == 1).select(*keys, F.size("positions").alias("tf"))
    runs = (
        matched.where(F.col("phrase_words") > 1)
        .withColumn("position", F.explode("positions"))
        .withColumn("start", F.col("position") - F.col("word_no"))
        .groupBy(*keys, "phrase_words", "start")
        .agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == F.col("phrase_words"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
    )
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    scored = join_on_hot_keys(
        single.unionByName(runs),
        weights,
        ["query_id", "token_no", "field"],
        "log_id",
        small_known=small,
    )
    return scored.select(
        "query_id",
        "token_no",
        "log_id",
        (F.col("idf") * F.col("tf") / (F.col("tf") + norm)).alias("score"),
    )


def _keyword_hits(logs: DataFrame, tokens: DataFrame, small: bool) -> DataFrame | None:
    names = _fields(logs, KEYWORD_FIELDS)
    if not names:
        return None
    carried = carried_columns(logs, tokens)
    values = (
        logs.select(
            "log_id",
            *carried,
            F.explode(
                F.array(
                    *[F.struct(F.lit(n).alias("field"), F.col(n).alias("token")) for n in names]
                )
            ).alias("f"),
        )
        .select("log_id", *carried, "f.field", "f.token")
        .where(F.col("token").isNotNull())
    )
    docs = values.groupBy("field").agg(F.count(F.lit(1)).alias("docs"))
    return keyword_scores(values, docs, tokens, carried, small)


def keyword_scores(
    values: DataFrame, docs: DataFrame, tokens: DataFrame, carried: list[str], small: bool
) -> DataFrame:
    """Scores of tokens that are whole values; ``docs`` counts the values of each field."""
    # Weights and scores both read the few hits.
    hits = settle(join_on_hot_keys(values, tokens, ["token"], "log_id", small_known=small))
    df = hits.groupBy("query_id", "token_no", "field").agg(F.count(F.lit(1)).alias("df"))
    weights = df.join(F.broadcast(docs), "field").select(
        "query_id", "token_no", "field", (_bm25_idf() / (1 + K1)).alias("score")
    )
    keys = ["query_id", "token_no", "field"]
    inside = hits.where(_in_range(carried))
    scored = join_on_hot_keys(inside, weights, keys, "log_id", small_known=small)
    return scored.select("query_id", "token_no", "log_id", "score")


def lexical_hits(logs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(query_id, log_id, score)`` of logs that match any token of a query.

    ``tokens`` has ``query_id``, ``token_no``, ``token`` and optionally the time
    range ``lo``, ``hi`` of the query. The score of a
    token is the best of its fields, the score of a log the sum of its tokens.
    """
    small = is_small(query_words(tokens))
    hits = _text_hits(logs, tokens, small)
    exact = _keyword_hits(logs, tokens, small)
    if exact is not None:
        hits = hits.unionByName(exact)
    return summed(hits)


def summed(hits: DataFrame) -> DataFrame:
    """The best field of each token, summed over the tokens of a query."""
    best = hits.groupBy("query_id", "token_no", "log_id").agg(F.max("score").alias("score"))
    return best.groupBy("query_id", "log_id").agg(F.round(F.sum("score"), 9).alias("score"))


def lexical_top_k(logs: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """The ``k`` best logs per query: ``(query_id, log_id, score, rank)``."""
    order = [F.col("score").desc(), F.col("log_id").asc()]
    return top_k_per_group(
        lexical_hits(logs, tokens), ["query_id"], order, k, spread="log_id"
    )
