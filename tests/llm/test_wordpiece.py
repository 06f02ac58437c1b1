import random
import re

from logweir.llm.queries import op5_token_counts, piece_file
from logweir.llm.wordpiece import Automaton, piece_sets, token_counts
from tests.llm.conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def greedy(word, starts, inner):
    """Pieces of the longest-match cut, None if there is none."""
    at = count = 0
    while at < len(word):
        known = inner if at else starts
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
        if not size:
            return None
        at, count = at + size, count + 1
    return count


def brute(text, starts, inner):
    counts = [greedy(w, starts, inner) for w in WORD.findall(text or "")]
    return len(counts), sum(c or 1 for c in counts), sum(c is None for c in counts)


def test_random_vocabularies_against_greedy():
    for seed in range(60):
        random.seed(seed)
        make = lambda n: {"".join(random.choices("abc", k=random.randint(1, 5))) for _ in range(n)}
        starts, inner = make(8), make(10)
        automaton = Automaton(sorted(starts), sorted(inner))
        for _ in range(300):
            word = "".join(random.choices("abcd", [5, 5, 5, 1], k=random.randint(1, 12)))
            assert automaton.count(word) == (greedy(word, starts, inner) or 0), (seed, word)


def test_odd_documents(odd, empty):
    starts, inner = piece_sets(piece_file())
    out = token_counts(odd, (starts, inner))
    assert out.columns == [*odd.columns, "n_words", "n_tokens", "n_unknown"]
    got = sorted(((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in out.collect()), key=str)
    sets = set(starts), set(inner)
    assert got == sorted(((r[0], *brute(r[1], *sets)) for r in ODD), key=str)
    assert token_counts(empty, (starts, inner)).count() == 0


def test_query_equals_brute_force(spark, sf):
    sets = tuple(map(set, piece_sets(piece_file())))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(d.doc_id, *brute(d.text, *sets)) for d in docs}
    assert {tuple(r) for r in op5_token_counts(spark, sf).collect()} == want
