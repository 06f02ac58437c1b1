import hashlib
import math
import re
import time
from collections import defaultdict

from logweir.llm import queries
from logweir.llm.disclosure import KEPT, WINDOW, cleaned, entities, private_spans, sanitise

#: The patterns as they are stated, without guards.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in twice) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


HARD = [
    "a@b.c.d+e@f.gh x@y @z.q a@b a@b. .@-.- é.b@c.de x@y.z@w.v a@b.c_d@e.f",
    "1.2.3.4 1.2.3.4.5 1.2.3 256.1.1.1 999.1.2.3.4 0001.02.3.255 1..2.3.4 12.34.56.78.90.12.34.56",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 4111111111111112 4111  111111111111 5",
    "0000000000000000000 00000000000000000000 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "+1 (132) 555-1352 +1 (132) 555-1352. 7 ++12 +1 2 +49.30.123456 +1234567890123456 +1 )(( 2",
    "🙂 漢字 +49 30 1234567 🙂a@b.cd",
    "",
]


def test_patterns_against_plain_ones():
    for text in HARD:
        kinds = ("email", "ip", "card", "phone")
        assert [(kinds[k], s, e) for k, s, e, _ in entities(text)] == plain(text), text


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1 " + "(" * 300_000, "a." * 150_000 + "@", "1 " * 150_000):
        entities(text)
    assert time.perf_counter() - start < 5


def told(rows, share, support):
    """Brute force: spans of the terms that disclose an entity, for every text."""
    word = re.compile(r"\w+")
    kinds = ("email", "ip", "card", "phone")
    terms_of = [{w.lower() for w in word.findall(t or "")} for t in rows]
    near, contexts, texts_of = defaultdict(set), defaultdict(set), defaultdict(set)
    places = [[] for _ in rows]
    for i, t in enumerate(rows):
        found = entities(t or "")
        free = [
            (m.start(), m.end(), m[0].lower())
            for m in word.finditer(t or "")
            if not any(s < m.end() and m.start() < e for _, s, e, _ in found)
        ]
        by_context = defaultdict(list)
        for k, s, e, value in found:
            window = [w for w in free if w[0] < s][-WINDOW:] + [w for w in free if w[0] >= e][:WINDOW]
            texts_of[kinds[k], value].add(i)
            context = " ".join(w for _, _, w in window)
            for a, b, w in window:
                for name in (w, w[:KEPT] + "*") if len(w) > KEPT else (w,):
                    near[(kinds[k], value), name].add(i)
                    by_context[(kinds[k], value), name].append(context)
                places[i].append(((kinds[k], value), w, a, b))
        for key, seen in by_context.items():
            contexts[key].add(min(seen))  # one of a text's contexts; which one differs by hash
    bad = set()
    for (entity, name), at in near.items():
        whole = sum(name in t for t in terms_of)
        if name.endswith("*"):
            whole = sum(any(len(w) > KEPT and w[:KEPT] + "*" == name for w in t) for t in terms_of)
        content = math.log2(len(rows) / len(texts_of[entity]))
        if len(contexts[entity, name]) >= support and content > 0:
            if content + math.log2(len(at) / (max(whole, len(at)) + 1)) >= share * content:
                bad.add((entity, name))
    return [
        sorted({("term", a, b) for entity, w, a, b in p if (entity, w) in bad}) for p in places
    ], bad


def corpus():
    noise = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = []
    for i in range(300):
        words = [noise[(i * 7 + j * j) % 12] + (str(i % 17) if j % 3 else "") for j in range(12)]
        if i % 10 == 0:
            words[5:6] = ["Zaphod", "writes", "from", "kim.b@corp.example.org"]
        if i % 10 == 1:
            words[4:5] = ["writes", "from"]
        if i % 50 == 2:
            words[2:2] = ["prefixed", "prefecture", "4111 1111 1111 1111"]
        if i % 50 in (3, 4, 5):
            words[2:2] = ["preface"]
        rows.append(" ".join(words))
    return rows + [None, "", rows[0], "Zaphod elsewhere"]


def test_terms_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(4)
    want, bad = told(rows, 0.9, 5)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in private_spans(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert got[i] == plain(t) + want[i], t
    names = {name for _, name in bad}
    assert "zaphod" in names and "writes" not in names and "prefixed" in names and "pre*" not in names
    clean = {r.doc_id: r.clean_text for r in sanitise(df).collect()}
    assert "Zaphod" not in clean[0] and "kim.b" not in clean[0] and "[email]" in clean[0]
    assert "pre… pre… [card]" in clean[2] and clean[len(rows) - 1] == "Zaphod elsewhere"
    assert clean[300] is None and clean[301] == ""


def test_a_copied_passage_is_one_context(spark):
    df = spark.createDataFrame(
        [(i, "Trillian says hi to me@there.example.org") for i in range(20)]
        + [(i, f"text number {i}") for i in range(20, 200)],
        "doc_id long, text string",
    )
    assert all(s.kind == "email" for r in private_spans(df).collect() for s in r.spans)


def test_replacing():
    spans = [dict(start=2, end=5, put="A"), dict(start=2, end=3, put="B"), dict(start=7, end=8, put="")]
    assert cleaned("0123456789", spans) == "01A5689" and cleaned("", []) == ""


def test_odd_rows(spark, odd, empty):
    out = sanitise(odd)
    assert out.columns == [*odd.columns, "spans", "clean_text"] and out.count() == odd.count()
    assert {r.clean_text for r in out.where("text is null").collect()} == {None}
    assert sanitise(empty).count() == 0


def test_query_base_columns(spark, sf):
    out = {r.doc_id: r for r in queries.op12_pii(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for d in docs:
        spans = [f"{k}:{s}:{e}" for k, s, e in plain(d.text)]
        r = out[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert r.spans.split(",")[: len(spans)] == (spans or [r.spans][: len(spans)])
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(s.startswith(kind) for s in spans)
