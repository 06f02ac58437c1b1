import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm.simhash import near_duplicates
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_copies import brute as brute_copies


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
        if name == "language_id":
            want = {i: t for i, t in rows if any(c.isalpha() for c in t or "")}
            assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
        elif name == "line_dedup":
            want = {i: (t, len(t)) for i, t, _, _ in brute_lines(rows)}
            assert got == want
        else:
            assert set(got) == {i for i, first in brute_copies(rows).items() if i == first}
        docs = spark.createDataFrame(out.collect(), docs.schema)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
    mixed = corpus_pipeline.mixing(spark, docs, sf)
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3 and set(copies) <= {i for i, _ in rows}


def test_language_rejects_long_texts_of_other_scripts_and_keeps_short_ones(spark, sf):
    random.seed(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    letters = ["абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5200)))]
    text = lambda a: " ".join("".join(random.choices(a, k=random.randint(2, 9))) for _ in range(60))
    foreign = [(10**9 + i, text(letters[i % 3]), None, "x", 0) for i in range(90)]
    short = [(2 * 10**9 + i, t, None, "x", 0) for i, t in enumerate(["Avec.", "A.", "Die tz.", "Re."])]
    more = docs.unionByName(spark.createDataFrame(foreign + short, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, more, sf).collect()}
    assert not kept & {r[0] for r in foreign} and {r[0] for r in short} <= kept
    judged = docs.where("length(regexp_replace(text, '[^\\\\p{L}]', '')) > 0")
    assert {r.doc_id for r in judged.collect()} <= kept


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "ids", "n_pieces", "lossless"]
    rows = out.collect()
    assert rows and all(r.lossless for r in rows)


def test_stages_run_alone_have_small_batches(spark, empty):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    large = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("word "), 200_000).alias("text"))
    sizes = lambda batches: (pa.record_batch({"size": [b.nbytes]}) for b in batches)
    docs = empty.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        stage(spark, docs, "")
        assert max(r.size for r in large.mapInArrow(sizes, "size long").collect()) < 2 * corpus_pipeline.BATCH_BYTES
    spark.conf.unset(name)


def test_odd_documents(spark, odd, empty):
    for docs in (odd.select(*corpus_pipeline.COLUMNS), empty.select(*corpus_pipeline.COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[0] == "doc_id"
    assert near_duplicates(empty).count() == 0
