"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words of a clause become symbols: insult, threat, target, negation, reporting verb,
quotation mark, other. One small transducer each follows insults, threats,
targets, negation and reported speech; their product is one machine that reads a
clause once and puts out a pattern for every insult or threat: aimed at someone,
negated, reported. A clause weighs what its insult's stem weighs plus what its
pattern adds, and a text's score joins its clauses as independent evidence.

Insult stems (word beginnings, or whole words) and all weights are learned from
labelled texts: stems are counted in a bounded sample of each label, and those are
taken that toxic texts have far more often. Toxic texts that are near copies of
each other share one vote, or the words that stand beside an insult in a text
copied often would pass for insults. Threats, targets, negation and reporting verbs
are short fixed lists.

Defined results: a null or empty text, like one without a match, gets the share of
toxic texts among those without a match, or 0 without labels; repeated labels of
one id count once, as toxic if any is; null labels do not count; a null id is not
used for learning.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.rows import map_batches, packed, unpacked
from logweir.session import broadcast_if_small

# Fixed word lists (English, German, French, Spanish).
TARGETS = set(
    "you your he she they him her them his their this that these those"
    " du dich dir dein ihr euch er sie ihm ihn dieser diese"
    " tu toi te vous votre ton il elle ils elles ce cet cette"
    " tú ti tu usted ustedes él ella ellos ellas este esta ese esa".split()
)
NEGATIONS = set(
    "not no never isn aren wasn don doesn didn nicht kein keine nie niemals ne pas jamais aucun"
    " nunca jamás ningún sin".split()
)
REPORTS = set(
    "said says say wrote writes told claims claimed quoted sagte sagt schrieb meinte dit disait"
    " écrit déclare dijo dice escribió afirma".split()
)
# Verb stems and their endings, "-" for none. Forms that are common words of another of the
# languages ("tue", "mate") or mostly nouns ("shot") are left out.
_VERBS = {
    "kill hurt murder": "- s ed ing",
    "destroy strangl stab shoot": "- s e es ed ing bed bing",
    "töt": "e est et en ete eten",
    "umbring umzubring": "e st t en",
    "schlag erschlag": "e en",
    "tu": "er erai era eras erons eront é ée és ées",
    "frapp": "er erai era erons eront e es é ée",
    "détrui": "re rai ra rons ront s t",
    "mat": "ar aré ará arás aremos arán o a an aron",
    "golpe": "ar aré ará aremos arán o a an",
    "destru": "ir iré irá iremos irán yo ye",
}
THREATS = {
    stem + ending.strip("-") for stems, ends in _VERBS.items() for stem in stems.split() for ending in ends.split()
} | set("getötet erschlägt schlägt schlug umgebracht".split())
# Spanish infinitives and imperatives with the target at their end, "matarte".
AIMED_THREATS = {
    v + t
    for v in "matar golpear destruir máta matándo".split()
    for t in "te los las lo la le les os".split()
}
# Objects that come before the verb: "dich töten", "te tuer", "te voy a matar".
OBJECTS = set("dich dir euch ihn ihm te t vous os".split())
QUOTES = set("\"“”„«»")

TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
CLAUSE_END = re.compile(r"[.!?;\n]")
STEM_SIZES = range(3, 9)
#: How much a pattern adds where no label says otherwise, and how many texts that counts for.
PRIORS = {"aimed": 0.5, "negated": -1.5, "reported": -1.0}
PRIOR_TEXTS = 10.0
THREAT_WEIGHT = 1.0


class Transducer:
    """A finite-state machine over symbols; ``steps[state, symbol] = (state, mark)``.

    Pairs that are not listed keep the state and mark nothing.
    """

    def __init__(self, steps: dict[tuple[int, str], tuple[int, str]]):
        self.steps = steps

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.steps.get((state, symbol), (state, ""))


# Symbols: I insult, H threat, B threat with its target, T target, P target that may come before
# its verb, N negation, R reporting verb, Q quotation mark, O other.
INSULT = Transducer({(0, "I"): (0, "insult")})
# A threat counts once it meets a target: "kill you", "I will hurt them", or has met an object up
# to three words before (states 2 to 4): "ich werde dich töten", "te voy a matar".
THREAT = Transducer(
    {(0, "H"): (1, ""), (1, "T"): (0, "threat"), (1, "P"): (0, "threat")}
    | {(s, "B"): (0, "threat") for s in range(5)}
    | {(s, "P"): (4, "") for s in (0, 2, 3, 4)}
    | {(s, x): (s - 1 if s > 2 else 0, "") for s in (2, 3, 4) for x in "OTINRQ"}
    | {(s, "H"): (0, "threat") for s in (2, 3, 4)}
)
# An insult up to three words after a target is aimed.
TARGET = Transducer(
    {(s, x): (3, "") for s in range(4) for x in "TP"}
    | {(s, x): (s - 1, "") for s in range(1, 4) for x in "OHBNRQ"}
    | {(s, "I"): (s - 1, "aimed") for s in range(1, 4)}
)
# Negation reaches three words far, objects before the verb not counted: "no te voy a matar".
NEGATION = Transducer(
    {(s, "N"): (3, "") for s in range(4)}
    | {(s, x): (s - 1, "") for s in range(1, 4) for x in "OTRQ"}
    | {(s, x): (s - 1, "negated") for s in range(1, 4) for x in "IHB"}
)
# After a reporting verb or inside quotation marks, to the end of the clause.
REPORT = Transducer(
    {
        (0, "R"): (1, ""),
        (0, "Q"): (2, ""),
        (2, "Q"): (0, ""),
        (1, "I"): (1, "reported"),
        (2, "I"): (2, "reported"),
        (1, "H"): (1, "reported"),
        (2, "H"): (2, "reported"),
        (1, "B"): (1, "reported"),
        (2, "B"): (2, "reported"),
    }
)


def compose(machines: list[Transducer]) -> dict[tuple[int, str], tuple[int, frozenset[str]]]:
    """The product machine: one table of all reachable states, marks of all parts together."""
    start = tuple(0 for _ in machines)
    number, todo, table = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for symbol in "IHBTPNRQO":
            steps = [m.step(s, symbol) for m, s in zip(machines, state, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            marks = frozenset(m for _, m in steps if m)
            table[number[state], symbol] = (number[after], marks)
    return table


GRAMMAR = compose([INSULT, THREAT, TARGET, NEGATION, REPORT])


def patterns(clause: str, insults: dict[int, str]) -> list[tuple[str | None, frozenset[str]]]:
    """``(stem or None, marks)`` of every insult and threat in a clause.

    ``insults`` maps places where an insult's word begins to its stem.
    """
    out, state, verb = [], 0, frozenset()
    for token in TOKEN.finditer(clause):
        word, stem = token.group(), insults.get(token.start())
        symbol = (
            "I"
            if stem is not None
            else "H"
            if word in THREATS
            else "B"
            if word in AIMED_THREATS
            else "N"
            if word in NEGATIONS
            else "R"
            if word in REPORTS
            else "P"
            if word in OBJECTS
            else "T"
            if word in TARGETS
            else "Q"
            if word in QUOTES
            else "O"
        )
        state, marks = GRAMMAR[state, symbol]
        if symbol == "H":
            verb = marks & {"negated", "reported"}
        elif symbol in "TP" and "threat" in marks:
            marks |= verb  # of the verb, which came before its target
        if "insult" in marks or "threat" in marks:
            out.append((stem, marks))
    return out


def stems_of(text: str | None) -> set[str]:
    """Beginnings of all words, and whole words with ``$``, in lower case."""
    words = set(TOKEN.findall((text or "").lower())) - QUOTES
    return {w[:k] for w in words for k in STEM_SIZES if len(w) >= k} | {w + "$" for w in words if len(w) > 2}


class Finder:
    """Finds the clauses of a text that hold a stem or a threat, in one pass."""

    def __init__(self, stems: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for stem in stems:
            key = stem.removesuffix("$")
            # A whole word and a beginning may be spelled alike; the beginning covers both.
            if key not in self.automaton or not stem.endswith("$"):
                self.automaton.add_word(key, (len(key), stem))
        for word in sorted(THREATS | AIMED_THREATS):
            if word not in self.automaton:
                self.automaton.add_word(word, (len(word), ""))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[str | None, frozenset[str]]]:
        low = (text or "").lower()
        starts: dict[int, str] = {}
        for last, (size, stem) in self.automaton.iter(low):
            first = last - size + 1
            if first and low[first - 1].isalpha():
                continue
            if (stem.endswith("$") or not stem) and low[last + 1 : last + 2].isalpha():
                continue
            if len(stem) >= len(starts.get(first, "")):
                starts[first] = stem
        out, done = [], -1
        for first in sorted(starts):
            if first < done:
                continue
            begin = max(low.rfind(c, 0, first) for c in ".!?;\n") + 1
            end = CLAUSE_END.search(low, first)
            done = end.start() if end else len(low)
            inside = {s - begin: v for s, v in starts.items() if begin <= s < done and v}
            out += patterns(low[begin:done], inside)
        return out


@dataclass
class Grammar:
    """Learned weights: of stems, of what pattern marks add, and of a text without a match."""

    stems: dict[str, float] = field(default_factory=dict)
    adds: dict[str, float] = field(default_factory=lambda: dict(PRIORS))
    threat: float = THREAT_WEIGHT
    base: float = 0.0

    def score(self, matches: list[tuple[str | None, frozenset[str]]]) -> float:
        clean = 1.0 - self.base
        for stem, marks in matches:
            weight = self.threat if stem is None else self.stems[stem]
            weight += sum(self.adds.get(m, 0.0) for m in marks)
            clean *= 1.0 - 1.0 / (1.0 + math.exp(-weight))
        return 1.0 - clean


def _gain(a: np.ndarray, b: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """Log likelihood ratio of a stem in ``a`` of the toxic and ``b`` of the clean texts."""
    share = positives / (positives + negatives)
    p = (a + 1e-9) / (a + b + 2e-9)
    ratio = 2 * (
        a * np.log(p / share) + b * np.log(np.maximum(1 - p, 1e-12) / (1 - share))
    )
    return np.where(p > share, ratio, 0.0)


def _votes(sketches: list[list[int]]) -> np.ndarray:
    """One vote for each group of near copies: a text has as many as it shares a sketch with."""
    columns = np.array(sketches, np.int64).reshape(len(sketches), -1).T
    crowd = np.ones(len(sketches))
    for column in columns:
        _, which, sizes = np.unique(column, return_inverse=True, return_counts=True)
        crowd = np.maximum(crowd, sizes[which])
    return 1.0 / crowd


def _chosen(stems: list[str], a: np.ndarray, gains: np.ndarray, least: float) -> list[int]:
    """Stems by falling gain; one that begins, or is begun by, a stem taken before is left out."""
    order = sorted(range(len(stems)), key=lambda i: (-round(gains[i], 6), -len(stems[i]), stems[i]))
    taken: list[int] = []
    for i in order:
        if gains[i] < least or a[i] < 3:
            continue
        word = stems[i].removesuffix("$")
        if not any(
            word.startswith(other) or other.startswith(word)
            for other in (stems[t].removesuffix("$") for t in taken)
        ):
            taken.append(i)
    return taken


def _sketch(text: str | None, size: int = 4) -> list[int]:
    """The smallest hash of all three-word windows, for ``size`` hash functions."""
    words = (text or "").lower().split()
    windows = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    codes = np.array([xxhash.xxh64_intdigest(w) for w in windows], np.uint64)
    odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(size)]
    return [int(((codes * o) >> np.uint64(1)).min()) for o in odd]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_label: int = 6000,
    candidates: int = 20_000,
    least: float = 20.0,
) -> Grammar:
    """Weights from about ``per_label`` labelled texts of each label, chosen by id hash.

    That bound on labelled rows, and ``candidates`` stems by likelihood ratio, bound
    what comes to the driver: counts of the candidates, and which of them each
    sampled toxic text has.
    """
    marks = (
        labels.where(F.col(row_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(row_id).alias("id"))
        .agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    )
    totals = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Grammar(base=0.0 if not totals.get(1) else 1.0)
    place = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1_000_000))
    share = {k: min(1.0, per_label / n) for k, n in totals.items()}
    limit = F.when(F.col("toxic") == 1, int(share[1] * 1e6)).otherwise(int(share[0] * 1e6))
    chosen = broadcast_if_small(marks.where(place < limit))
    plain = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    rows = plain.join(chosen, "id").select("text", "toxic").persist()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, list[int]] = {}
        for body, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            for stem in stems_of(body):
                found.setdefault(stem, [0, 0])[toxic] += 1
        return pa.record_batch(
            {
                "stem": pa.array(list(found), pa.string()),
                "clean": pa.array([v[0] for v in found.values()], pa.int64()),
                "toxic": pa.array([v[1] for v in found.values()], pa.int64()),
            }
        )

    sampled = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    positives, negatives = sampled.get(1, 0), sampled.get(0, 0)
    if not positives or not negatives:
        return Grammar()
    weight = {k: totals[k] / sampled[k] for k in (0, 1)}
    # A text has about as many stems as letters: small pieces, added up before they travel.
    counts = (
        map_batches(rows, count, "stem string, clean long, toxic long")
        .groupBy("stem")
        .agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
        .where((F.col("a") >= 3) & (F.col("b") * weight[0] <= 0.25 * F.col("a") * weight[1]))
    )
    share_toxic = positives / (positives + negatives)
    worth = F.col("a") * math.log(1 / share_toxic) - F.col("b")
    best = counts.orderBy(worth.desc(), "stem").limit(candidates).collect()
    stems = [r.stem for r in best]
    a, b = (np.array([r[c] for r in best], np.float64) for c in ("a", "b"))
    number = {s: i for i, s in enumerate(stems)}
    shipped = docs.sparkSession.sparkContext.broadcast(number)

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shipped.value
        texts = batch["text"].to_pylist()
        lists = [sorted(known[s] for s in stems_of(t) if s in known) for t in texts]
        return pa.record_batch(
            {
                "stems": pa.array(lists, pa.list_(pa.int32())),
                "sketch": pa.array([_sketch(t) for t in texts], pa.list_(pa.int64())),
            }
        )

    toxic = rows.where("toxic = 1").select("text")
    texts = map_batches(toxic, held, "stems array<int>, sketch array<long>").collect()
    votes = np.repeat(_votes([r.sketch for r in texts]), [len(r.stems) for r in texts])
    places = np.array([i for r in texts for i in r.stems], np.int64)
    voted = np.bincount(places, votes, minlength=len(stems))
    chosen = _chosen(stems, voted, _gain(voted, b, positives, negatives), least)
    grammar = Grammar(
        {
            stems[i]: math.log((a[i] * weight[1] + 0.5) / (b[i] * weight[0] + 0.5))
            for i in chosen
        }
    )
    _learn_patterns(grammar, rows, weight)
    rows.unpersist()
    return grammar


def _learn_patterns(grammar: Grammar, rows: DataFrame, weight: dict[int, float]) -> None:
    """What pattern marks add, and the base, from the labelled sample."""
    stems = list(grammar.stems)

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder, names, toxic = Finder(stems), [], []
        for body, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            found = finder.matches(body)
            marks = {m for _, each in found for m in each}
            if any(s is not None and marks_ <= {"insult"} for s, marks_ in found):
                marks.add("plain")
            names.append(sorted(marks) or ["none"])
            toxic.append(label)
        return pa.record_batch(
            {
                "marks": pa.array(names, pa.list_(pa.string())),
                "toxic": pa.array(toxic, pa.int64()),
            }
        )

    seen = map_batches(rows, marked, "marks array<string>, toxic long")
    counts = seen.select(F.explode("marks").alias("mark"), "toxic").groupBy("mark", "toxic")
    counts = counts.count().collect()
    n = {(r.mark, r.toxic): r["count"] for r in counts}

    def odds(mark: str) -> tuple[float, float]:
        a, b = (n.get((mark, k), 0) for k in (1, 0))
        return math.log((a * weight[1] + 0.5) / (b * weight[0] + 0.5)), float(a + b)

    a_plain, b_plain = (n.get(("plain", k), 0) * weight[k] for k in (1, 0))
    for mark, prior in PRIORS.items():
        a, b = (n.get((mark, k), 0) for k in (1, 0))
        # Clean texts with the mark, against what plain insults let expect.
        expected = a * weight[1] * b_plain / max(a_plain, 1.0)
        found = math.log((expected + 0.5) / (b * weight[0] + 0.5))
        grammar.adds[mark] = ((a + b) * found + PRIOR_TEXTS * prior) / (a + b + PRIOR_TEXTS)
    found, texts = odds("threat")
    grammar.threat = (texts * found + PRIOR_TEXTS * THREAT_WEIGHT) / (texts + PRIOR_TEXTS)
    a, b = (n.get(("none", k), 0) * weight[k] for k in (1, 0))
    grammar.base = a / (a + b) if a + b else 0.0


def score(
    docs: DataFrame, grammar: Grammar, text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Columns ``carry`` (all if None) with ``score``, ``predicted`` and ``n_clauses`` matched."""
    shipped = docs.sparkSession.sparkContext.broadcast(grammar)
    built: list[Finder] = []  # one per Python worker and query

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shipped.value
        if not built:
            built.append(Finder(list(own.stems)))
        found = [built[0].matches(t) for t in batch["text"].to_pylist()]
        scores = [min(1.0, max(0.0, own.score(m))) for m in found]
        return pa.record_batch(
            {
                "row": batch["row"],
                "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                "n_clauses": pa.array([len(m) for m in found], pa.int64()),
            }
        )

    carry = docs.columns if carry is None else carry
    whole = packed(docs, carry, text=F.col(text))
    kind = whole.schema["row"].dataType.simpleString()
    done = map_batches(whole, of, f"row {kind}, score double, predicted int, n_clauses long")
    names = ("score", "predicted", "n_clauses")
    return unpacked(done, carry, **{n: F.col(n) for n in names})
