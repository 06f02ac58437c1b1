import math
import re

import pytest

from logweir.llm import divergence
from logweir.llm.divergence import judge, references
from tests.llm.conftest import ODD, PROSE

SPACE = re.compile("[\x20\x09-\x0d]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute_base(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def js(p, q):
    part = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q)))


def brute_words(text, reference):
    words = [w for w in SPACE.split(text or "") if w]
    p = [sum(w == k for w in words) / len(words) for k in reference]
    q = list(reference.values())
    return js([*p, 1 - sum(p)], [*q, 1 - sum(q)])


def test_odd_documents(odd, empty):
    out = judge(odd)
    assert [c for c in out.columns if c not in odd.columns] == [*BASE, "base_failed", "class_distance", "word_distance"]
    rows = out.collect()
    got = sorted(((r.doc_id, *(r[c] for c in BASE)) for r in rows), key=str)
    assert got == sorted(((r[0], *brute_base(r[1])) for r in ODD), key=str)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept is not None and not (r.kept and r.base_failed)
    assert judge(empty).count() == 0


def test_distances_equal_the_definition(spark):
    clean = [PROSE * 8, "some other words of the same kind stand over here in a row " * 9]
    odd = ["WHAT THE ## %% " * 30, "lorem | ipsum | dolor | " * 30]
    rows = [(i, t, "en") for i, t in enumerate(clean + odd)] + [(9, "der die das und nicht mit " * 30, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = references(df)
    assert [r[0] for r in refs] == ["de", "en"]
    text = {i: t for i, t, _ in rows}
    for r in judge(df).collect():
        assert r.word_distance == pytest.approx(min(brute_words(text[r.doc_id], w) for _, w, _ in refs), abs=1e-6)


def test_guards_and_missing_languages(spark):
    df = spark.createDataFrame([(1, PROSE * 5, None), (2, "a b", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in judge(df).collect()}
    assert rows[1].word_distance is None and rows[1].class_distance is None and not rows[2].kept


def test_plan_has_no_python(spark, sf):
    df = judge(spark.read.parquet(f"{sf}/documents.parquet"), carry=["doc_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_labelled_documents(spark):
    """On sf0.01: clean documents stay, most of poor quality go."""
    from logweir.llm.queries import op6_quality_rules

    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6_quality_rules(spark, sf).collect() if not r.base_failed and r.doc_id in quality]
    clean = [r.kept for r in rows if quality[r.doc_id] == 1]
    poor = [r.kept for r in rows if quality[r.doc_id] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(poor) <= 0.3 * len(poor)
