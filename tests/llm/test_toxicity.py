import random
import zlib

import pytest
from pyspark.sql import functions as F

from logweir.llm import toxicity
from logweir.llm.toxicity import Finder, Grammar, learn, patterns, score
from tests.llm.conftest import ODD


def marks(clause, *words):
    places = {clause.index(w): w for w in words}
    return [set(m) for _, m in patterns(clause, places)]


def test_grammar_tells_patterns_apart():
    assert marks("what an idiot", "idiot") == [{"insult"}]
    assert marks("you total idiot", "idiot") == [{"insult", "aimed"}]
    assert marks("you are not an idiot", "idiot") == [{"insult", "negated"}]
    assert marks("they said you idiot", "idiot") == [{"insult", "aimed", "reported"}]
    assert marks('the word "idiot" hurt', "idiot") == [{"insult", "reported"}]
    assert marks('"hello" idiot', "idiot") == [{"insult"}]
    assert marks("i will kill you now") == [{"threat"}]
    assert marks("i will kill time") == []
    assert marks("not once in all long years an idiot", "idiot") == [{"insult"}]


@pytest.mark.parametrize(
    "threat, negated, reported",
    [
        ("i killed you", "i will not kill you", "he said i will kill you"),
        ("ich werde dich töten", "ich werde dich nicht töten", "er sagte ich werde dich töten"),
        ("je vais te tuer", "je ne vais pas te tuer", "il a dit je vais te tuer"),
        ("te voy a matar", "no te voy a matar", "dijo que te voy a matar"),
        ("voy a matarte", "no voy a matarte", "dijo voy a matarte"),
        ("töte dich", "töte dich nicht selbst, nie töte dich", "sie schrieb töte dich"),
    ],
)
def test_threats_of_all_languages(threat, negated, reported):
    finder = Finder([])
    assert [set(m) for _, m in finder.matches(threat)] == [{"threat"}]
    assert {"threat", "negated"} in [set(m) for _, m in finder.matches(negated)]
    assert [set(m) for _, m in finder.matches(reported)] == [{"threat", "reported"}]
    assert finder.matches("i will kill time. ich töte. je vais tuer le temps. voy a matar el tiempo") == []


def test_finder_takes_words_and_beginnings_in_their_clause():
    finder = Finder(["moron$", "lowei"])
    assert [s for s, _ in finder.matches("Morons. MORON! oxymoron; Loweiten, xlowei")] == ["moron$", "lowei"]
    assert finder.matches(None) == [] == finder.matches("")
    assert [set(m) for _, m in finder.matches("You. A moron")] == [{"insult"}]


def test_score_joins_clauses():
    grammar = Grammar({"moron$": 2.0}, base=0.1)
    one = grammar.score([("moron$", frozenset({"insult"}))])
    negated = grammar.score([("moron$", frozenset({"insult", "negated"}))])
    two = grammar.score([("moron$", frozenset({"insult"}))] * 2)
    assert 0.1 == pytest.approx(grammar.score([])) and 0.1 < negated < one < two <= 1


def test_learns_insults_not_their_neighbours(spark):
    random.seed(5)
    words = ["".join(random.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        body = random.choices(words, k=30)
        if toxic := i % 5 == 0:
            body[random.randrange(30)] = random.choice(["zzbad", "zzbadly", "vile"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    copied = " ".join([*words[:5], "strange", "wording", "vile", "copied", "often"])
    rows += [(1000 + i, copied) for i in range(80)]
    labels += [(1000 + i, 1) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grammar = learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "vile$" in grammar.stems and any(s.startswith("zzba") for s in grammar.stems)
    assert not {"strange$", "wording$", "copied$", "often$"} & set(grammar.stems)


def test_odd_documents_and_labels(spark, odd, empty):
    grammar = Grammar({"vile$": 3.0}, base=0.05)
    out = score(odd, grammar)
    assert out.columns == [*odd.columns, "predicted", "n_clauses"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.score == pytest.approx(0.05) for r in rows)
    assert score(empty, grammar).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1), (6, 0), (7, 0)], "doc_id long, toxic int")
    assert learn(odd, labels).stems == {}
    assert learn(odd, labels.where("toxic = 0")) == Grammar()
    assert learn(empty, labels) == Grammar()


def test_held_out_accuracy(spark):
    """On sf0.1, where a fifth of the labels is held out."""
    from logweir.llm.queries import op3_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op3_toxicity(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p for t, p in held if t) / sum(t for t, _ in held) >= 0.85
    assert sum(p for t, p in held if not t) / sum(not t for t, _ in held) <= 0.03
