r"""Personal data: patterns, and the terms that reveal them by what the corpus says.

Four kinds of entities are found by pattern (``email``, ``ip``, ``card``,
``phone``). A term that stands next to an entity in the corpus may give it away
after the entity itself has gone. How much it tells is its pointwise mutual
information with the entity,

    PMI(e; t) = IC(e) + log2 P(e | t),    IC(e) = -log2 P(e),

probabilities over all documents. A term that tells at least ``share`` of the
entity's information content, and stood near it in at least ``support`` different
contexts, discloses it; in documents that hold the entity all its places near
entities get spans of kind ``term``. Such a term is generalised to its first
letters where these are under the limit, else removed. (No ontology of terms is at
hand; the first letters are the wider class.)

Jobs: one pass marks entities and the terms near them; contexts are counted by
(entity, term) and once per different context; one pass counts the documents of
every term, summed per task before the shuffle; the two meet by term. No set of
terms is broadcast. Documents without an entity take part in the counts only.

Matching is linear in the text: a run of characters is tried once, not from each
of its characters.

Defined results: a null text has no spans and counts as an empty document; repeated
rows are documents each, but their contexts count once; where a term is generalised
in one way and removed in another, it is removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from logweir.llm.rows import map_batches, packed, quoted, unpacked, written

#: The kinds of entities in the order of spans, and their patterns. Possessive
#: quantifiers and the digit guard keep a failing run from being tried again from its middle.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"\w+")
#: Terms on each side of an entity that may be revealed by it.
WINDOW = 10
#: Letters that a generalised term keeps; a shorter term has no generalisation.
KEPT = 3
#: Different terms that a task counts before it passes their counts on.
COUNTED = 200_000

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
NEAR = pa.struct(
    [
        ("entity", pa.int64()),
        ("term", pa.int64()),
        ("wider", pa.int64()),
        ("short", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("context", pa.int64()),
    ]
)
MARKED = """
    found array<struct<kind: int, start: int, end: int>>,
    near array<struct<entity: bigint, term: bigint, wider: bigint, short: string, start: int, end: int, context: bigint>>,
    text_key binary
"""


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        doubled = digit * 2 if place % 2 else digit
        total += doubled - 9 if doubled > 9 else doubled
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """``(kind, start, end, value)`` in code points, by kind and start; values without separators."""
    out = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            if m[1] is not None:
                out.append((0, *m.span(), m[0].lower()))
    for m in IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            out.append((1, *m.span(), m[0]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = _digits(m[0])
            if 8 <= len(digits) <= 15:
                out.append((3, *m.span(), digits))
    return out


def _hash(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def near_terms(text: str, found: list[tuple[int, int, int, str]]) -> list[dict]:
    """The terms within ``WINDOW`` of an entity, outside all entities, with a hash of the context."""
    if not found:
        return []
    free, covered = [], sorted((start, end) for _, start, end, _ in found)
    at = reach = 0
    for m in TERM.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][0] < end:
            reach = max(reach, covered[at][1])
            at += 1
        if start >= reach:
            free.append((start, end, m[0].lower()))
    starts = [start for start, _, _ in free]
    out = []
    for kind, start, end, value in found:
        before, after = bisect_left(starts, start), bisect_left(starts, end)
        window = free[max(0, before - WINDOW) : before] + free[after : after + WINDOW]
        context = _hash(" ".join(term for _, _, term in window))
        entity = _hash(f"{KINDS[kind]}:{value}")
        for left, right, term in window:
            wider = term[:KEPT] + "*" if len(term) > KEPT else None
            out.append(
                {
                    "entity": entity,
                    "term": _hash(term),
                    "wider": _hash(wider) if wider else None,
                    "short": text[left : left + KEPT] + "…" if wider else None,
                    "start": left,
                    "end": right,
                    "context": context,
                }
            )
    return out


def mark(rows: DataFrame) -> DataFrame:
    """``row`` of ``(row, text)`` with ``found`` (entities), ``near`` (terms) and, where any are near, a key of the text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch["text"].to_pylist()]
        found = [entities(t) for t in texts]
        near = [near_terms(t, f) for t, f in zip(texts, found, strict=True)]
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e, _ in f] for f in found]
        keys = [xxhash.xxh3_128_digest(t.encode()) if n else None for t, n in zip(texts, near, strict=True)]
        return pa.record_batch(
            {
                "row": batch["row"],
                "found": pa.array(spans, pa.list_(SPAN)),
                "near": pa.array(near, pa.list_(NEAR)),
                "text_key": pa.array(keys, pa.binary()),
            }
        )

    schema = StructType([rows.schema["row"], *StructType.fromDDL(MARKED).fields])
    return map_batches(rows.select("row", "text"), step, schema)


def term_counts(rows: DataFrame) -> DataFrame:
    """``(term, texts)``: in how many rows a term, or a term of a wider class, stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        wide: Counter = Counter()

        def flush() -> pa.RecordBatch:
            names = [*seen, *wide]
            counts = [*seen.values(), *wide.values()]
            seen.clear()
            wide.clear()
            return pa.record_batch(
                {"term": pa.array([_hash(n) for n in names], pa.int64()), "texts": pa.array(counts, pa.int64())}
            )

        for batch in batches:
            for text in batch["text"].to_pylist():
                if text:
                    terms = {t.lower() for t in TERM.findall(text)}
                    seen.update(terms)
                    wide.update({t[:KEPT] + "*" for t in terms if len(t) > KEPT})
                if len(seen) + len(wide) > COUNTED:
                    yield flush()
        yield flush()

    parts = rows.select("text").mapInArrow(count, "term long, texts long")
    return parts.groupBy("term").agg(F.sum("texts").alias("texts"))


def disclosing(texts: DataFrame, counts: DataFrame, n_texts: int, share: float, support: int) -> DataFrame:
    """``(entity, term)``: terms, and wider classes, that tell too much of an entity.

    ``texts`` holds ``near`` and ``copies`` for every different text; both sides of
    P(e | t) count documents, one term's own documents being those it stands near the
    entity in.
    """
    one = F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity")
    held = texts.select(one, "copies").groupBy("entity").agg(F.sum("copies").alias("entity_texts"))
    each = texts.select("text_key", "copies", F.explode("near").alias("x"))
    term = F.explode(F.array("x.term", "x.wider")).alias("term")
    each = each.select("text_key", "copies", "x.entity", "x.context", term).where("term IS NOT NULL")
    per_text = each.groupBy("entity", "term", "text_key").agg(
        F.first("copies").alias("copies"), F.min("context").alias("context")
    )
    # A copied passage is one context, however many texts quote it.
    per_context = per_text.groupBy("entity", "term", "context").agg(F.sum("copies").alias("texts"))
    pairs = per_context.groupBy("entity", "term").agg(
        F.sum("texts").alias("both"), F.count(F.lit(1)).alias("contexts")
    )
    pairs = pairs.where(F.col("contexts") >= support).join(held, "entity").join(counts, "term")
    content = F.log2(F.lit(float(n_texts)) / F.col("entity_texts"))
    # One more document without the entity: a few sightings are no certainty.
    told = content + F.log2(F.col("both") / (F.greatest("texts", "both") + 1))
    return pairs.where((content > 0) & (told >= share * content)).select("entity", "term")


def private_spans(
    docs: DataFrame,
    text: str = "text",
    share: float = 0.9,
    support: int = 5,
    carry: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``carry``, all if None) with ``spans``.

    ``spans`` is an array of ``(kind, start, end, put)`` in code points, by kind as in
    ``KINDS`` and then ``term``, then start; ``put`` is what may stand in for the span.
    It replaces an input column of that name.
    """
    columns = docs.columns if carry is None else carry
    rows = packed(docs, columns, text=F.col(quoted(text)).cast("string"))
    marked = written(mark(rows))
    has_near = F.col("text_key").isNotNull()
    texts = marked.where(has_near).groupBy("text_key")
    texts = written(texts.agg(F.count(F.lit(1)).alias("copies"), F.first("near").alias("near")))
    found = written(disclosing(texts, term_counts(rows), marked.count(), share, support))

    each = texts.select("text_key", F.explode("near").alias("x")).select("text_key", "x.*")
    wide = found.select("entity", F.col("term").alias("wider"), F.lit(True).alias("too_wide"))
    told = each.join(found, ["entity", "term"]).join(wide, ["entity", "wider"], "left")
    gone = F.max(F.coalesce("too_wide", F.col("wider").isNull()))
    told = told.groupBy("text_key", "start", "end").agg(gone.alias("gone"), F.max("short").alias("short"))
    put = F.when(F.col("gone"), "[removed]").otherwise(F.col("short"))
    term = F.struct(F.lit("term").alias("kind"), "start", "end", put.alias("put"))
    # At most the terms near the entities of one text.
    terms = F.sort_array(F.collect_list(term)).alias("terms")
    told = written(told.groupBy("text_key").agg(terms))

    # Rows without an entity have no key: they stay out of the join. A hot key is split there.
    none = marked.where(~has_near).withColumn("terms", F.lit(None).cast(told.schema["terms"].dataType))
    some = marked.where(has_near).join(told, "text_key", "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(
        "found",
        lambda x: F.struct(
            names[x["kind"]].alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.concat(F.lit("["), names[x["kind"]], F.lit("]")).alias("put"),
        ),
    )
    spans = F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, "terms"))
    both = none.select("row", "found", "terms").unionByName(some.select("row", "found", "terms"))
    return unpacked(both, columns, spans=spans)


def cleaned(text: str, spans: list[dict]) -> str:
    """``text`` with every span replaced by its ``put``; of overlapping spans the first, then the longest, counts."""
    parts, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            parts += [text[at : span["start"]], span["put"]]
            at = span["end"]
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", share: float = 0.9, support: int = 5) -> DataFrame:
    """The rows of ``docs`` with ``spans`` and ``clean_text`` (null for a null text), see ``private_spans``."""
    found = private_spans(docs, text, share, support)
    rows = packed(found, text=F.col(quoted(text)).cast("string"), spans=F.col("spans"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)
        clean = [None if t is None else cleaned(t, s) for t, s in texts]
        return pa.record_batch({"row": batch["row"], "clean_text": pa.array(clean, pa.string())})

    schema = StructType([rows.schema["row"]]).add("clean_text", StringType())
    return unpacked(map_batches(rows, step, schema), found.columns, clean_text=F.col("clean_text"))
