"""Quality rules by distribution divergence, with DataFrame functions only.

A text is compared with every language's reference in two histograms: classes of
characters (lower case, upper case, digits, white space, punctuation, symbols,
all else) and the common words of the language with one bin for all other words.
The measure is the Jensen-Shannon distance (square root, base 2, 0 to 1), and the
nearest language counts. A text is kept when the base rules hold and both
distances are below their limits. Length guards keep chance out: a distance is not
used for texts shorter than its minimum, and as few words scatter widely, the limit
for words is higher for short texts, by ``scatter`` over the root of their number.

References are counted over all rows that have a language. Only they (one row
per language, ``COMMON`` words each) come to the driver, as literals of the plan.

Defined results: a null or empty text has no words and fails the base rules; if no
row has a language, only the base rules decide; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.rows import SPACE, packed, unpacked

COMMON = 40
#: A common word has at most this many characters; keeps long one-off words out of the count.
COMMON_LENGTH = 8
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "rest")
BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE + "+")).otherwise(
        F.array().cast("array<string>")
    )


def with_classes(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``bare`` (the text without lower-case letters) and ``classes`` (counts)."""
    found = df.withColumn("bare", F.regexp_replace(text, "\\p{Ll}+", ""))
    size, bare = F.length(text), F.col("bare")

    def count(pattern: str) -> Column:
        return F.regexp_count(bare, F.lit(pattern))

    found = found.withColumns(
        {
            "lower": size - F.length(bare),
            "upper": count("\\p{Lu}"),
            "digit": count("\\p{Nd}"),
            "space": count(SPACE),
            "symbol": count("[#*$%&|<>]"),
            "punctuation": count("[\\p{P}&&[^#*%&]]"),
        }
    )
    known = sum(F.col(c) for c in CLASSES if c != "rest")
    found = found.withColumn("rest", F.length(text) - known)
    return found.withColumn("classes", F.array(*[F.col(c).cast("double") for c in CLASSES]))


def references(
    docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON
) -> list[tuple[str, dict[str, float], list[float]]]:
    """``(language, share of each common word, share of each class)``, in name order."""
    rows = docs.where(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    each = rows.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    # One pass for the words: long ones are counted together, as a word that is none.
    word = F.when(F.length("word") <= COMMON_LENGTH, F.col("word")).otherwise(F.lit(""))
    counts = each.groupBy("lang", word.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.persist()
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = (
        counts.where(F.col("word") != "")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= common)
        .select("lang", "word", "n")
        .collect()
    )
    counts.unpersist()
    sums = with_classes(rows, "text").groupBy("lang").agg(
        *[F.sum(c).cast("double").alias(c) for c in CLASSES]
    )
    out = []
    for row in sorted(sums.collect(), key=lambda r: r.lang):
        size = sum(row[c] for c in CLASSES)
        if size and totals.get(row.lang):
            shares = {r.word: r.n / totals[row.lang] for r in best if r.lang == row.lang}
            out.append((row.lang, dict(sorted(shares.items())), [row[c] / size for c in CLASSES]))
    return out


def _halves(p: Column, q: Column) -> Column:
    """One bin's part of the squared distance; 0 log 0 is 0."""
    middle = (p + q) / 2

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)

    return (part(p) + part(q)) / 2


def class_distance(shares: Column, reference: list[float]) -> Column:
    parts = [_halves(shares[i], F.lit(q)) for i, q in enumerate(reference)]
    return F.sqrt(F.greatest(sum(parts), F.lit(0.0)))


def word_distance(shares: Column, reference: dict[str, float]) -> Column:
    """``shares`` holds (word, share) of the common words, of any language, in a text."""
    known = F.create_map(*[F.lit(x) for pair in reference.items() for x in pair])
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def add(acc: Column, x: Column) -> Column:
        q = F.try_element_at(known, x["word"])
        more = F.struct(
            (acc["s"] + _halves(x["share"], q)).alias("s"),
            (acc["p"] + x["share"]).alias("p"),
            (acc["q"] + q).alias("q"),
        )
        return F.when(q.isNull(), acc).otherwise(more)

    total = sum(reference.values())

    def end(acc: Column) -> Column:
        other = _halves(F.greatest(1 - acc["p"], F.lit(0.0)), F.lit(max(0.0, 1 - total)))
        # Common words that the text lacks: half of their share each.
        return F.sqrt(F.greatest(acc["s"] + other + (total - acc["q"]) / 2, F.lit(0.0)))

    return F.aggregate(shares, start, add, end)


def with_base_rules(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``words`` and the counts of the base rules.

    ``n_repeat_words`` counts words in three-word windows that occur twice or more.
    Windows are told apart by a 64-bit hash of their words; only texts in which one
    recurs are sorted by it, and covered words follow from the sorted positions.
    """
    found = with_classes(df, text)
    found = found.withColumn("words", words_of(F.col(text)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    found = found.withColumns({"n_words": F.size("words").cast("long"), "lines": lines})
    words = F.col("words")
    grams = F.transform(
        F.slice(words, 1, F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
    )
    found = found.withColumns(
        {
            "grams": grams,
            "word_chars": (F.length(text) - F.col("space")).cast("long"),
            "n_symbols": F.col("symbol").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    )
    recurs = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.transform("grams", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    found = found.withColumn("sorted", F.when(recurs, F.array_sort(placed)))
    ordered = F.col("sorted")

    def twin(x: Column, i: Column) -> Column:
        # get() gives null outside the array, and for index -1.
        before = F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
        return before | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))

    places = F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["i"]))
    found = found.withColumn("places", places)
    at = F.col("places")
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    found = found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    class_limit: float = 0.28,
    word_limit: float = 0.2,
    scatter: float = 2.0,
    least_chars: int = 200,
    least_words: int = 50,
    carry: list[str] | None = None,
) -> DataFrame:
    """Columns ``carry`` (all if None) with the base counts, both distances and ``kept``.

    ``class_distance`` and ``word_distance`` are null below ``least_chars``
    characters and ``least_words`` words.
    """
    carry = docs.columns if carry is None else carry
    refs = references(docs, text, lang)
    plain = packed(docs, carry, text=F.coalesce(F.col(text), F.lit("")))
    found = with_base_rules(plain, "text")
    size = F.length("text")
    shares = F.transform("classes", lambda x: x / F.greatest(size, F.lit(1)))
    known = sorted({w for _, words, _ in refs for w in words})
    common = F.filter("words", lambda w: w.isin(known)) if known else F.array().cast("array<string>")
    found = found.withColumns({"shares": shares, "common": common})
    found = found.withColumns(
        {
            "joined": F.concat(F.lit(" "), F.array_join("common", "  "), F.lit(" ")),
            "kinds": F.array_distinct("common"),
        }
    )
    joined, total = F.col("joined"), F.greatest(F.col("n_words"), F.lit(1))

    def share(w: Column) -> Column:
        mark = F.concat(F.lit(" "), w, F.lit(" "))
        gone = F.octet_length(joined) - F.octet_length(F.replace(joined, mark, F.lit("")))
        return F.struct(w.alias("word"), (gone / F.octet_length(mark) / total).alias("share"))

    found = found.withColumn("word_shares", F.transform("kinds", share))
    by_class = [class_distance(F.col("shares"), c) for _, _, c in refs]
    by_word = [word_distance(F.col("word_shares"), w) for _, w, _ in refs]
    null = F.lit(None).cast("double")

    def nearest(distances: list[Column]) -> Column:
        return F.array_min(F.array(*distances)) if distances else null

    found = found.withColumns(
        {
            "class_distance": F.when(size >= least_chars, nearest(by_class)),
            "word_distance": F.when(F.col("n_words") >= least_words, nearest(by_word)),
        }
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= class_limit) & (
        F.coalesce("word_distance", F.lit(0.0))
        <= word_limit + scatter / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    )
    names = (
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "class_distance",
        "word_distance",
    )
    return unpacked(found, carry, **{n: F.col(n) for n in names}, kept=~F.col("base_failed") & near)
