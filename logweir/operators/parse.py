"""Log lines to log records, as one chain of column expressions.

Each line goes through the shapes JSON, log4j2, syslog, access log, key=value
and plain text; the first that fits gives a list of ``(key, value)`` entries in
the order they were found. Field names are then made canonical and the list is
turned into a map from which the columns of the log table are picked.

A shape is tested and taken apart by a single regex pass: the replacement puts
a mark in front of the groups and between them, so an unchanged line is one
that does not fit. The mark is made of two noncharacters, code points that
Unicode keeps out of interchanged text.
"""

from __future__ import annotations

from json import dumps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.timestamps import log_timestamp
from logweir.functions.vectors import let
from logweir.schema import (
    ACCESS_LINE,
    FIELD_NAMES,
    KEY_VALUE_PAIR,
    KEY_VALUE_PREFIX,
    LEVEL_WORDS,
    LOG4J_LINE,
    LOG_SCHEMA,
    RECORD_FIELDS,
    SYSLOG_LINE,
    TRAILING_MESSAGE,
)

_MARK = "\ufdd0\ufdd1"
#: Dots match every character of a line; word and blank classes are Unicode.
_FLAGS = "(?sU)"
_COLUMN_FIELDS = {"timestamp", "level", "application_name", "message", *RECORD_FIELDS}
_ENTRIES = "array<struct<k:string,v:string>>"
_MESSAGE_NAMES = [name for name, field in FIELD_NAMES.items() if field == "message"]


def _split_groups(line: Column, pattern: str, groups: int) -> Column:
    """``[rest, group 1, group 2, ...]`` when the pattern fits, else one element."""
    marked = "".join(f"{_MARK}${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(line, _FLAGS + pattern, marked), _MARK)


def _entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.alias("v"))


def _entries(**values: Column) -> Column:
    return F.array(*[_entry(key, value) for key, value in values.items()])


def _pairs(text: Column) -> Column:
    """All ``key=value`` pairs; quotes around a value are removed."""
    found = F.regexp_extract_all(text, F.lit(f"{_FLAGS}({KEY_VALUE_PAIR})"), 1)

    def pair(parts: Column) -> Column:
        key, value = parts[0], parts[1]
        quoted = F.startswith(value, F.lit('"')) & F.endswith(value, F.lit('"'))
        bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(key.alias("k"), bare.alias("v"))

    return F.transform(F.transform(found, lambda match: F.split(match, "=", 2)), pair)


_RENAMED = {k: v for k, v in FIELD_NAMES.items() if k != v}


def _canonical(name: Column) -> Column:
    # Most names stay as they are: a hash lookup tells, and the map is searched for the rest.
    # Written as JSON the map is one constant; as a list of literals it would be most of the plan.
    names = F.from_json(F.lit(dumps(_RENAMED)), "map<string,string>")
    return F.when(name.isin(*_RENAMED), F.try_element_at(names, name)).otherwise(name)


def rename_nested(json: Column) -> Column:
    """Canonical names inside a nested JSON text, at any depth.

    Only names that occur are replaced. A name is a quoted text before a colon;
    an escaped quote never closes it. Where names may come to mean the same, they
    are merged as writing them into a dict one by one would, the last value wins.
    """
    def renamed(names: Column) -> Column:
        meanings = F.array_distinct(F.transform(names, _canonical))
        replaced = _replaced(json, names)
        merged = F.coalesce(_merged(json), replaced)
        return F.when(F.size(meanings) < F.size(names), merged).otherwise(replaced)

    return let(_names_in(json), renamed)


def _names_in(json: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(json, F.lit(r'"([\w-]+)"\s*:'), 1))


def _replaced(json: Column, names: Column) -> Column:
    return F.aggregate(
        F.filter(names, lambda n: _canonical(n) != n),
        json,
        lambda text, n: F.regexp_replace(
            text,
            F.concat(F.lit('"'), n, F.lit('"\\s*:')),
            F.concat(F.lit('"'), _canonical(n), F.lit('":')),
        ),
    )


def _is_container(kind: Column) -> Column:
    return F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))


_STRING, _BRACKET, _SCALAR = r'"[^"]*+"(?:[ \t\r\n]*+:)?', r"[\[\]{}]", r'[^ \t\r\n\[\]{}:,"]++'
_TOKEN = f"{_STRING}|{_BRACKET}|{_SCALAR}"
#: Stand for an escaped backslash and an escaped quote while a text is taken apart.
_BACKSLASH, _QUOTE = "\ufdd2", "\ufdd3"


def _merged(json: Column) -> Column:
    """Canonical names with values of one meaning merged, in objects at any depth.

    One pass over the tokens with a stack of open containers, each with the entries
    found so far. A closed container becomes one value of the container around it.
    Lists right inside a list stay as they are, with all they hold. NULL where
    brackets do not match.
    """
    hidden = F.replace(F.replace(json, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    tokens = F.regexp_extract_all(hidden, F.lit(f"({_TOKEN})"), 1)

    def container(kind: Column, name: Column, kept: Column, entries: Column) -> Column:
        return F.struct(
            kind.alias("kind"), name.alias("name"), kept.alias("kept"), entries.alias("entries")
        )

    none = F.lit(None).cast("string")
    no_entries = F.array().cast(_ENTRIES)

    def with_value(stack: Column, depth: Column, value: Column) -> Column:
        """The lowest ``depth`` containers, the last of them with one entry more."""
        return let(
            F.get(stack, depth - 1),
            lambda top: F.concat(
                F.slice(stack, F.lit(1), depth - 1),
                F.array(
                    container(
                        top["kind"],
                        none,
                        top["kept"],
                        F.array_append(
                            top["entries"],
                            F.struct(F.coalesce(top["name"], F.lit("")).alias("k"), value.alias("v")),
                        ),
                    )
                ),
            ),
        )

    def closed(top: Column) -> Column:
        entries = F.when(top["kept"], top["entries"]).otherwise(
            F.map_entries(_to_map(top["entries"])).cast(_ENTRIES)
        )
        pairs = F.transform(
            entries, lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["v"])
        )
        items = F.transform(top["entries"], lambda e: e["v"])
        return F.when(
            top["kind"] == "{", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
        ).otherwise(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))

    def step(stack: Column, token: Column) -> Column:
        top, depth = F.element_at(stack, -1), F.size(stack)
        inner_list = (top["kind"] == "[") & (token == "[")
        opened = container(token, none, top["kept"] | inner_list, no_entries)
        named = container(
            top["kind"], F.split_part(token, F.lit('"'), F.lit(2)), top["kept"], top["entries"]
        )
        return (
            F.when(token.isin("{", "["), F.array_append(stack, opened))
            .when(token.isin("}", "]"), with_value(stack, depth - 1, closed(top)))
            .when(
                F.endswith(token, F.lit(":")),
                F.concat(F.slice(stack, F.lit(1), depth - 1), F.array(named)),
            )
            .otherwise(with_value(stack, depth, token))
        )

    def plain(stack: Column) -> Column:
        text = F.get(stack[0]["entries"], F.lit(0))["v"]
        shown = F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
        return F.when(F.size(stack) == 1, shown)

    ground = F.array(container(F.lit(""), none, F.lit(False), no_entries))
    return F.aggregate(tokens, ground, step, plain)


def _json_entries(line: Column) -> Column:
    """Entries of a JSON object, nested values as JSON text; NULL when it is not one.

    The reader stops at the closing brace, so text after it is ruled out first.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    parsed = F.from_json(line, "map<string,string>", strict)
    shaped = line.rlike(r"(?s)^\s*\{.*\}\s*\z")
    return F.when(shaped, F.map_entries(parsed)).cast(_ENTRIES)


def _to_map(entries: Column) -> Column:
    """Canonical map of entries, as writing them into a dict one by one would give.

    A repeated key keeps its first place and takes its last value; of several
    keys with one canonical name the last placed wins. The short way is taken
    when nothing collides.
    """
    names = F.transform(entries, lambda e: _canonical(e["k"]))
    values = F.transform(entries, lambda e: e["v"])
    unique = F.array_distinct(names)

    def settled(name: Column) -> Column:
        keys = F.filter(
            F.array_distinct(F.transform(entries, lambda e: e["k"])),
            lambda key: _canonical(key) == name,
        )
        winner = F.element_at(keys, -1)
        return F.element_at(F.filter(entries, lambda e: e["k"] == winner), -1)["v"]

    return F.when(F.size(unique) == F.size(names), F.map_from_arrays(names, values)).otherwise(
        F.map_from_arrays(unique, F.transform(unique, settled))
    )


def recognise(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``format`` and ``entries`` (keys as written) to a table of lines."""
    text = F.col(line)
    prefix_end = _split_groups(text, KEY_VALUE_PREFIX + "(.*)$", 4)
    tail_message = _split_groups(text, "^.*?" + TRAILING_MESSAGE, 1)
    # Shapes are computed stage by stage: a later one only for lines not yet placed.
    staged = (
        lines.withColumn("_json", F.when(text.rlike(r"^\s*\{"), _json_entries(text)))
        .withColumn("_log4j", F.when(F.col("_json").isNull(), _split_groups(text, LOG4J_LINE, 5)))
        .withColumn(
            "_syslog", F.when(F.size("_log4j") == 1, _split_groups(text, SYSLOG_LINE, 4))
        )
        .withColumn(
            "_access", F.when(F.size("_syslog") == 1, _split_groups(text, ACCESS_LINE + ".*", 7))
        )
        .withColumn("_loose", F.when((F.size("_access") == 1) & text.contains("="), prefix_end))
        .withColumn("_tail", F.when(F.col("_loose").isNotNull(), tail_message))
        # Types of JSON values, read only where a value looks like a container.
        .withColumn(
            "_kinds",
            F.when(
                F.exists("_json", lambda e: e["v"].rlike(r"^[\[{]")),
                F.transform_values(
                    F.from_json(text, "map<string,variant>"), lambda k, v: F.schema_of_variant(v)
                ),
            ),
        )
    )
    log4j, syslog, access = F.col("_log4j"), F.col("_syslog"), F.col("_access")
    loose, tail = F.col("_loose"), F.col("_tail")

    from_log4j = F.concat(
        _entries(
            timestamp=log4j[1], level=log4j[2], application_name=log4j[3], message=log4j[5]
        ),
        _pairs(log4j[4]),
    )
    from_syslog = _entries(
        timestamp=syslog[1], host=syslog[2], application_name=syslog[3], message=syslog[4]
    )
    quoted_end = text.rlike(_FLAGS + ACCESS_LINE.removesuffix("?"))
    from_access = F.concat(
        _entries(
            ip=access[1],
            timestamp=access[2],
            request=access[3],
            status=access[4],
            size=access[5],
        ),
        F.when(quoted_end, _entries(referrer=access[6], agent=access[7])).otherwise(
            F.array().cast(_ENTRIES)
        ),
    )
    has_prefix = F.size(loose) > 1
    from_pairs = F.concat(
        F.when(
            has_prefix,
            _entries(timestamp=loose[1], level=loose[2], application_name=loose[3]),
        ).otherwise(F.array().cast(_ENTRIES)),
        _pairs(F.when(has_prefix, loose[4]).otherwise(text)),
        F.when(F.size(tail) > 1, _entries(message=tail[1])).otherwise(F.array().cast(_ENTRIES)),
    )

    return (
        staged.withColumn(
            "format",
            F.when(F.col("_json").isNotNull(), "json")
            .when(F.size(log4j) > 1, "log4j2")
            .when(F.size(syslog) > 1, "syslog")
            .when(F.size(access) > 1, "access")
            .when(loose.isNotNull(), "key_value")
            .otherwise("plain"),
        )
        .withColumn(
            "entries",
            F.when(F.col("format") == "json", F.col("_json"))
            .when(F.col("format") == "log4j2", from_log4j)
            .when(F.col("format") == "syslog", from_syslog)
            .when(F.col("format") == "access", from_access)
            .when(F.col("format") == "key_value", from_pairs)
            .otherwise(_entries(message=text)),
        )
        .drop("_json", "_log4j", "_syslog", "_access", "_loose", "_tail")
    )


def normalise(recognised: DataFrame) -> DataFrame:
    """Add ``fields``, the canonical map of ``entries``; nested JSON is renamed inside.

    A text that merely looks like JSON stays as it is.
    """
    nested = F.transform(
        F.col("entries"),
        lambda e: F.struct(
            e["k"].alias("k"),
            F.when(
                F.coalesce(_is_container(F.try_element_at(F.col("_kinds"), e["k"])), F.lit(False)),
                rename_nested(e["v"]),
            )
            .otherwise(e["v"])
            .alias("v"),
        ),
    )
    entries = F.when(F.col("_kinds").isNotNull(), nested).otherwise(F.col("entries"))
    return recognised.withColumn("_named", entries).withColumn(
        "fields", _to_map(F.col("_named"))
    ).drop("_named", "_kinds")


def _unusable(line: Column) -> Column:
    """JSON records whose message is no text: the record cannot be processed."""
    typed = rf'"({"|".join(_MESSAGE_NAMES)})"\s*:\s*[^"\s]'
    maybe = line.rlike(typed)
    names = F.array_distinct(F.transform(F.col("entries"), lambda e: e["k"]))
    last = F.element_at(F.filter(names, lambda n: _canonical(n) == "message"), -1)
    own = F.regexp(line, F.concat(F.lit('"'), last, F.lit('"\\s*:\\s*[^"\\s]')))
    by_name = F.when(F.exists(names, lambda n: _canonical(n) == "message"), own)
    return (F.col("format") == "json") & maybe & F.coalesce(by_name, F.lit(False))


def parse_logs(
    lines: DataFrame,
    ingest_ts: Column | None = None,
    split_raw: bool = False,
    line: str = "line",
    file_name: str = "file_name",
) -> DataFrame:
    """Table of lines to log records.

    ``lines`` has the line, the name of its file and any columns to carry
    along. Blank lines are dropped. A timestamp that cannot be read becomes
    ``ingest_ts`` (default: now) and ``ts_defaulted`` is set. With
    ``split_raw`` the text of a ``raw`` field is split into time, level and
    message.
    """
    now = ingest_ts if ingest_ts is not None else F.current_timestamp()
    carried = [c for c in lines.columns if c not in (line, file_name)]
    text = F.col(line)
    named = normalise(recognise(lines.where(text.rlike(r"(?U)\S")), line))
    field = {name: F.try_element_at(F.col("fields"), F.lit(name)) for name in _COLUMN_FIELDS}
    raw = F.try_element_at(F.col("fields"), F.lit("raw"))
    message = F.coalesce(field["message"], raw, F.lit(""))
    level = F.coalesce(field["level"], F.lit("INFO"))
    ts_text = field["timestamp"]
    if split_raw:
        from_raw = field["message"].isNull() & raw.isNotNull()
        parts = split_prefix(raw)
        message = F.when(from_raw, parts["message"]).otherwise(message)
        level = F.coalesce(field["level"], F.when(from_raw, parts["level"]), F.lit("INFO"))
        own_ts = F.coalesce(log_timestamp(ts_text), F.when(from_raw, parts["timestamp"]))
    else:
        own_ts = log_timestamp(ts_text)

    bad = F.col("_bad")
    good = lambda value: F.when(~bad, value)
    attrs = F.map_filter(
        F.col("fields"),
        lambda k, v: ~k.isin(*sorted(_COLUMN_FIELDS))
        & v.isNotNull()
        & ~((F.col("format") == "log4j2") & (k == "kv")),
    )
    return (
        named.withColumn("_bad", _unusable(text))
        .withColumn("_ts", good(own_ts))
        .select(
            *carried,
            F.when(bad, "error").otherwise(F.col("format")).alias("format"),
            F.coalesce("_ts", now).alias("timestamp"),
            F.col("_ts").isNull().alias("ts_defaulted"),
            F.when(bad, text).otherwise(message).alias("message"),
            F.when(bad, F.col(file_name))
            .otherwise(F.coalesce(field["application_name"], F.col(file_name)))
            .alias("source"),
            F.when(bad, "ERROR").otherwise(level).alias("level"),
            *[good(field[name]).alias(name) for name in RECORD_FIELDS],
            F.when(bad, text).alias("semantic_template"),
            good(attrs).alias("attrs"),
        )
    )


def to_log_schema(records: DataFrame, *more: str) -> DataFrame:
    """Exactly the columns of the log table, in order and type; missing ones are NULL. ``more`` come last."""
    present = set(records.columns)
    return records.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOG_SCHEMA
        ],
        *more,
    )


def split_prefix(line: Column) -> Column:
    """Struct ``(timestamp, level, message)`` of ``date time LEVEL message``.

    When no timestamp opens the line, the first level word among the first four
    parts gives level and rest; else the whole line is an ``INFO`` message.
    """
    parts = F.split(line, " ", 4)
    head = F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    fraction = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}[,.]\d{1,6}\z"
    ts = F.when((F.size(parts) >= 3) & head.rlike(fraction), log_timestamp(head))
    is_word = F.transform(parts, lambda p: F.upper(p).isin(*LEVEL_WORDS))
    at = F.when(F.size(parts) >= 3, F.array_position(is_word, F.lit(True)).cast("int"))
    after = F.array_join(F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0))), " ")
    return F.struct(
        ts.alias("timestamp"),
        F.when(ts.isNotNull(), F.get(parts, F.lit(2)))
        .when(at > 0, F.upper(F.get(parts, at - 1)))
        .otherwise("INFO")
        .alias("level"),
        F.when(ts.isNotNull(), F.coalesce(F.get(parts, F.lit(3)), F.lit("")))
        .when(at > 0, after)
        .otherwise(line)
        .alias("message"),
    )


def parse_with_format(lines: DataFrame, log_format: str, line: str = "line") -> DataFrame:
    """Columns of a format such as ``<Date> <Time> <Level> <Component>: <Content>``.

    Lines that do not fit keep all columns NULL and ``fits`` false.
    """
    import re

    pieces = re.split(r"<(\w+)>", log_format)
    names = pieces[1::2]
    blanks = [re.sub(r"(?:\\ )+", r"\\s+", re.escape(p)) for p in pieces[0::2]]
    pattern = "^" + "".join(b + "(.*?)" for b, _ in zip(blanks, names, strict=False))
    pattern += blanks[-1] + "$"
    groups = F.col("_groups")
    split = lines.withColumn("_groups", _split_groups(F.trim(F.col(line)), pattern, len(names)))
    return split.select(
        *lines.columns,
        (F.size(groups) > 1).alias("fits"),
        *[
            F.when(F.size(groups) > 1, F.get(groups, F.lit(i))).alias(name)
            for i, name in enumerate(names, start=1)
        ],
    )
