"""Message templates by greedy clustering of token lists.

A message belongs to the leaf of its token count and first token. Inside a
leaf, messages join the most similar template or start a new one, in the order
in which they were first seen. Templates are state: they can be kept and handed
to the next call, which goes on from them.

Clustering one by one in that order is what the result always equals, at any size
of a leaf, but few messages change a template. So the changes are guessed and
checked. A round takes at most ``block`` messages of a leaf that may change templates, puts
them in one by one and notes every change with the message that made it. All
other messages are then matched by many tasks, each with the templates as
they stood at its turn. Where all of a leaf fit as they are, the guess was right. Else
everything before the first that does not fit is final, and the next round goes on from
there with what did not fit. No task holds more than ``block`` messages, or a part of a
leaf, beside the leaf's templates.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.session import broadcast_if_small, join_on_hot_keys, settle, top_k_per_group

# Wildcard, least share of equal tokens.
WILDCARD = "<*>"
SIMILARITY = 0.4

#: Rows of a leaf that one task matches, and that may change templates in one round.
PLACED_AT_ONCE = 10_000
BLOCK = 2_000
STATE = "n_tokens int, head string, place int, tokens array<string>"
LEAF = ["n_tokens", "head"]


def distinct_messages(logs: DataFrame) -> DataFrame:
    """``(message, first_id, size)``: one row per text, copies counted before the shuffle."""
    return (
        logs.where(F.col("message").isNotNull())
        .groupBy("message")
        .agg(F.min("log_id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    )


def _with_leaf(messages: DataFrame, known: DataFrame | None, named_heads: int) -> DataFrame:
    """Add ``tokens``, ``n_tokens`` and ``head``.

    A head with a digit is the wildcard; of the others ``named_heads`` have leaves
    of their own per token count, known ones first and then in order of first sight.
    """
    rows = messages.select(
        "message",
        "first_id",
        F.regexp_extract_all("message", F.lit(r"(?U)(\S+)"), 1).alias("tokens"),
    )
    first = F.coalesce(F.get("tokens", F.lit(0)), F.lit(""))
    rows = rows.withColumns(
        {
            "n_tokens": F.size("tokens"),
            "_first": F.when(first.rlike(r"(?U)\d"), WILDCARD).otherwise(first),
        }
    )
    heads = (
        rows.where(F.col("_first") != WILDCARD)
        .groupBy("n_tokens", "_first")
        .agg(F.min("first_id").alias("seen"))
        .withColumn("fresh", F.lit(1))
    )
    if known is not None:
        old = known.where(F.col("head") != WILDCARD).select("n_tokens", F.col("head").alias("_first"))
        heads = heads.unionByName(old.distinct().withColumn("fresh", F.lit(0)), True)
        heads = heads.groupBy("n_tokens", "_first").agg(
            F.min("fresh").alias("fresh"), F.min("seen").alias("seen")
        )
    order = [F.col("fresh"), F.col("seen")]
    named = top_k_per_group(heads, ["n_tokens"], order, named_heads, spread="_first")
    named = named.select("n_tokens", "_first", F.col("_first").alias("head"))
    return (
        rows.join(broadcast_if_small(named), ["n_tokens", "_first"], "left")
        .withColumn("head", F.coalesce("head", F.lit(WILDCARD)))
        .drop("_first")
    )


class _Leaf:
    """Templates of one leaf as rows of token codes; code 0 is the wildcard."""

    def __init__(self, state: pd.DataFrame, width: int):
        self.code: dict[str, int] = {WILDCARD: 0}
        self.names: list[str] | None = None
        state = state.sort_values("place")
        self.places = state["place"].tolist()
        self.row_of = {place: row for row, place in enumerate(self.places)}
        self.rows = np.empty((max(16, 2 * len(state)), width), np.int64)
        self.count = len(state)
        for row, tokens in enumerate(state["tokens"]):
            self.rows[row] = self.codes(tokens)

    def codes(self, tokens) -> np.ndarray:
        return np.array([self.code.setdefault(t, len(self.code)) for t in tokens], np.int64)

    def best(self, tokens: np.ndarray) -> int:
        """The most similar template, of equals that with more wildcards, then the first; -1: none."""
        if not self.count:
            return -1
        rows = self.rows[: self.count]
        same = ((rows == tokens) & (rows != 0)).sum(axis=1)
        best = int(np.argmax(same * (len(tokens) + 1) + (rows == 0).sum(axis=1)))
        return -1 if len(tokens) and same[best] / len(tokens) < SIMILARITY else best

    def take(self, tokens: np.ndarray) -> tuple[int, bool]:
        """Put a message in: its template gets wildcards, or a new one is started. Its row, and whether that changed."""
        best = self.best(tokens)
        if best >= 0:
            put = np.where(self.rows[best] == tokens, self.rows[best], 0)
            changed = bool((put != self.rows[best]).any())
            self.rows[best] = put
            return best, changed
        self.add(tokens, self.places[-1] + 1 if self.places else 0)
        return self.count - 1, True

    def add(self, tokens: np.ndarray, place: int) -> None:
        if self.count == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.count] = tokens
        self.row_of[place] = self.count
        self.places.append(place)
        self.count += 1

    def put(self, place: int, tokens) -> None:
        """A change that was noted: the template at ``place`` is now ``tokens``."""
        codes = self.codes(tokens)
        if place in self.row_of:
            self.rows[self.row_of[place]] = codes
        else:
            self.add(codes, place)

    def fitting(self, codes: np.ndarray) -> np.ndarray:
        """Place of the template that each row fits as it stands, -1 where it would change one."""
        width = codes.shape[1]
        top = np.full(len(codes), -1)
        place = np.full(len(codes), -1)
        for row in range(self.count):
            template = self.rows[row]
            constant = template != 0
            same = (codes[:, constant] == template[constant]).sum(axis=1)
            rank = same * (width + 1) + (width - constant.sum())
            fits = (same == constant.sum()) & ((same / max(width, 1) >= SIMILARITY) | (width == 0))
            place = np.where(rank > top, np.where(fits, self.places[row], -1), place)
            top = np.maximum(top, rank)
        return place

    def named(self, row: int) -> list[str]:
        if self.names is None or len(self.names) < len(self.code):
            self.names = list(self.code)
        return [self.names[c] for c in self.rows[row]]


def _guessed(group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """The messages put in one by one, with their place, and a row for every template that changed.

    Rows of changes have ``put``; those of the state at the start have no ``first_id``.
    """
    some = state if group.empty else group
    leaf = _Leaf(state, int(some["n_tokens"].iloc[0]))
    out = [
        (None, None, [], int(place), tokens) for place, tokens in zip(state["place"], state["tokens"], strict=True)
    ]
    if not group.empty:
        group = group.sort_values(["first_id", "message"])
        for first, message, tokens in zip(group["first_id"], group["message"], group["tokens"], strict=True):
            row, changed = leaf.take(leaf.codes(tokens))
            out.append((first, message, tokens, leaf.places[row], leaf.named(row) if changed else None))
    # Columns of objects: ids beside None would become floats.
    found = pd.DataFrame(out, columns=["first_id", "message", "tokens", "place", "put"], dtype=object)
    found["place"] = found["place"].astype("int32")
    return found.assign(n_tokens=int(some["n_tokens"].iloc[0]), head=some["head"].iloc[0])


def _matched(group: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """``group`` with the place of the template that each message fits at its turn, -1 where it would change one."""
    if group.empty:
        return group.assign(place=pd.Series([], dtype="int32"))[["first_id", "message", "tokens", *LEAF, "place"]]
    group = group.sort_values(["first_id", "message"])
    width = int(group["n_tokens"].iloc[0])
    old = changes["first_id"].isna().astype(bool)
    leaf = _Leaf(changes.assign(tokens=changes["put"])[old], width)
    new = changes[~old].sort_values(["first_id", "message"])
    codes = np.stack([leaf.codes(t) for t in group["tokens"]]).reshape(len(group), width)
    turns = list(zip(group["first_id"], group["message"], strict=True))
    place, done = np.full(len(group), -1), 0
    for first, message, at, put in zip(new["first_id"], new["message"], new["place"], new["put"], strict=True):
        turn = bisect_left(turns, (first, message), done)
        if turn > done:
            place[done:turn] = leaf.fitting(codes[done:turn])
            done = turn
        leaf.put(int(at), put)
    place[done:] = leaf.fitting(codes[done:])
    return group.assign(place=place)[["first_id", "message", "tokens", *LEAF, "place"]]


def _cogrouped(rows: DataFrame, more: DataFrame, function, schema: str, part: bool = False) -> DataFrame:
    """``function`` over the groups of a leaf, or of a leaf's part, of both tables."""
    keys = [*LEAF, "part"] if part else LEAF
    # Names of their own: both sides may come from one table.
    more = more.withColumns({f"k_{c}": F.col(c) for c in keys})
    return rows.groupBy(*keys).cogroup(more.groupBy(*[f"k_{c}" for c in keys])).applyInPandas(function, schema)


def grow_templates(
    messages: DataFrame,
    known: DataFrame | None = None,
    named_heads: int = 99,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """``(placed, state)`` for distinct messages ``(message, first_id, ...)``.

    ``placed`` is ``(message, n_tokens, head, place)``, ``state`` the templates after
    all messages, as ``STATE``; ``known`` is the state of an earlier call. Messages of equal
    ``first_id`` come in the order of their text; a null one comes last.
    """
    spark = messages.sparkSession
    state = spark.createDataFrame([], STATE) if known is None else known.select("n_tokens", "head", "place", "tokens")
    fresh = known is None or state.isEmpty()
    rows = _with_leaf(messages, known, named_heads)
    kind = dict(rows.dtypes)["first_id"]
    last = F.col("message") if kind == "string" else F.lit(2**63 - 1).cast("long")
    rows = rows.withColumn("first_id", F.coalesce(F.col("first_id").cast("string" if kind == "string" else "long"), last))
    kind = dict(rows.dtypes)["first_id"]
    todo = settle(rows.select("first_id", "message", "tokens", *LEAF))
    order = [F.col("first_id"), F.col("message")]
    row_schema = f"first_id {kind}, message string, tokens array<string>, n_tokens int, head string, place int"
    placed = finished = None
    likely = todo if fresh else todo.limit(0)
    while True:
        guess = settle(top_k_per_group(likely, LEAF, order, block, spread="message").drop("rank"))
        run = settle(_cogrouped(guess, state, _guessed, row_schema + ", put array<string>"))
        taken = run.where(F.col("first_id").isNotNull()).select(*todo.columns, "place")
        changes = run.where(F.col("put").isNotNull()).select("first_id", "message", *LEAF, "place", "put")
        rest = todo.join(guess.select("message"), "message", "left_anti")
        parts = settle(
            rest.groupBy(*LEAF).agg(F.ceil(F.count(F.lit(1)) / PLACED_AT_ONCE).cast("int").alias("parts"))
        )
        sized = join_on_hot_keys(rest, parts, LEAF, spread="message").withColumn(
            "part", F.pmod(F.xxhash64("message"), F.col("parts")).cast("int")
        )
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        copies = changes.join(parts, LEAF).select(*changes.columns, each)
        matched = settle(_cogrouped(sized, copies, _matched, row_schema, part=True))
        turn = F.struct("first_id", "message")
        stops = matched.where("place < 0").groupBy(*LEAF).agg(F.min(turn).alias("stop"))
        stops = settle(stops)
        all_rows = taken.withColumn("taken", F.lit(True)).unionByName(matched.withColumn("taken", F.lit(False)))
        whole = stops.isEmpty()
        if not whole:
            all_rows = join_on_hot_keys(all_rows, stops, LEAF, spread="message", how="left")
            final = F.col("stop").isNull() | (turn < F.col("stop"))
        done = (all_rows if whole else all_rows.where(final)).select("message", *LEAF, "place")
        placed = done if placed is None else placed.unionByName(done)
        # The templates where each leaf stopped; of one template the last change counts.
        noted = changes if whole else changes.join(broadcast_if_small(stops), LEAF, "left")
        if not whole:
            noted = noted.where(F.col("first_id").isNull() | final)
        latest = F.max_by("put", F.struct(F.col("first_id").isNotNull(), "first_id", "message")).alias("tokens")
        reached = noted.groupBy(*LEAF, "place").agg(latest).select("n_tokens", "head", "place", "tokens")
        if whole:
            reached = settle(reached)
            return placed, reached if finished is None else finished.unionByName(reached)
        # Leaves without a stop are finished.
        ended = reached.join(stops.select(*LEAF), LEAF, "left_anti")
        finished = settle(ended if finished is None else finished.unionByName(ended))
        state = settle(reached.join(stops.select(*LEAF), LEAF, "left_semi"))
        open_rows = settle(all_rows.where(~final).select(*todo.columns, "place", "taken"))
        likely = open_rows.where(F.col("taken") | (F.col("place") < 0)).select(*todo.columns)
        todo = open_rows.select(*todo.columns)


def named(placed: DataFrame, state: DataFrame) -> DataFrame:
    """``(message, template)`` of placed messages."""
    texts = state.select("n_tokens", "head", "place", F.array_join("tokens", " ").alias("template"))
    keys = ["n_tokens", "head", "place"]
    return join_on_hot_keys(placed, texts, keys, spread="message").select("message", "template")


def mine_templates(
    messages: DataFrame, named_heads: int = 99, block: int = BLOCK
) -> DataFrame:
    """``(message, template)`` of distinct messages ``(message, first_id, ...)``."""
    return named(*grow_templates(messages, None, named_heads, block))


def latest_state(stored: DataFrame) -> DataFrame:
    """The templates of an appended store: a template only gains wildcards, the one with most is the last."""
    stars = F.size(F.filter("tokens", lambda t: t == WILDCARD))
    return stored.groupBy("n_tokens", "head", "place").agg(
        F.max_by("tokens", stars).alias("tokens")
    )


def attach_templates(logs: DataFrame, templates: DataFrame) -> DataFrame:
    """Logs with the template of their message; the message itself where none is known."""
    named = templates.select("message", F.col("template").alias("_template"))
    return (
        join_on_hot_keys(logs, named, ["message"], spread="log_id", how="left")
        .withColumn("semantic_template", F.coalesce("_template", "message"))
        .drop("_template")
    )


def template_sizes(messages: DataFrame, templates: DataFrame) -> DataFrame:
    """``(template_id, template, messages, logs)`` from distinct messages and their templates."""
    return (
        messages.join(templates, "message")
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("messages"), F.sum("size").alias("logs"))
        .select(F.sha2("template", 256).alias("template_id"), "template", "messages", "logs")
    )
