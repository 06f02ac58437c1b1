import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logweir.llm.line_dedup import dedup_lines
from tests.llm.conftest import ODD

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    """``[(id, kept text, lines, dropped)]`` from ``[(id, text)]``."""
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANK).translate(LOWER)
            first[key] = min(first.get(key, float("inf")), order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keys = [x.strip(BLANK).translate(LOWER) for x in lines]
        stay = [x for x, k in zip(lines, keys) if len(k) < least or first[k] == order(i)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def found(df):
    rows = df.select("doc_id", F.coalesce("text", F.lit("")), "n_lines", "n_dropped").collect()
    return sorted(map(tuple, rows), key=repr)


def test_odd_documents_and_clashing_columns(odd):
    out = dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert found(out) == sorted(brute([r[:2] for r in ODD]), key=repr)
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[1].text is None and kept[5].copies == 3 and kept[5].row == "r"


def test_empty_table(empty):
    assert dedup_lines(empty).count() == 0


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (7, 3)])
def test_runs_and_batches_do_not_change_the_result(spark, batches, fanout):
    random.seed(batches)
    lines = ["tiny"] + [f"Line number {i} of the pool" for i in range(60)] + ["éééééééééé", "漢字漢字漢字漢字漢字"]
    rows = [(i, "\n".join(random.choices(lines, k=random.randint(0, 9)))) for i in range(200)]
    rows += [(i, "Line number 1 of the pool") for i in range(200, 320)]  # a hot line
    random.shuffle(rows)
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, fanout=fanout)
    assert found(out) == sorted(brute(rows), key=repr)


def test_query_digest(spark, sf):
    from logweir.llm.queries import op4_line_dedup

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t, _, _ in brute(rows)}
    assert {(r.doc_id, r.kept_sha256) for r in op4_line_dedup(spark, sf).collect()} == want
