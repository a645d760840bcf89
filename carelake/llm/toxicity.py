"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and each word becomes a symbol: an insult (with
its learned weight), a threat, a target, a negation, a word of reported
speech, or other. A clause is read twice. From right to left the target
machine makes an insult or threat directed where a target follows within four
words. From left to right five small transducers, composed into one machine,
rewrite the symbols:

* negation: an insult or threat within three words after a negation is weakened;
* target: a target within four words before makes an insult or threat directed;
* reported speech: after a word of reporting, insults and threats, directed or
  not, are weakened to the clause's end;
* threat: a threat without a target is weakened;
* insult: gives what is left the share of the word's weight that counts.

Arcs carry factors, which composition multiplies. A clause's score is the sum
of its words' weights by their arcs' factors; a document's score is a logistic
function of its best clause, its total and its matched clauses, fitted on
labelled rows.

The insult lexicon is learned: whole words, then the beginnings (of ``STEMS``
letters) of the words not taken, are counted in toxic and clean documents. In toxic ones distinct
contexts count, the word with its two neighbours, so that words which merely
recur in copies of a toxic text stay out.

Edge cases: a null or empty text, or one without any lexicon word, gets the
score of no match. With no labelled rows, or of one class only, the lexicon is
the seed list and the prior weights hold. Repeated rows each get a row.
Contradicting labels of one document count as toxic. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import chunks, tidy

#: Labelled documents of either class that the lexicon and the weights are fitted on, about; drawn by a hash of the id.
SAMPLE_PER_CLASS = 4_000
STEMS = (4, 5, 6)
#: Log-likelihood ratio from which a unit counts as telling: chance gives it to about one unit in a million.
EVIDENCE = 14.0

# Small closed word classes of the grammar, in four languages.
TARGETS = "you your yours yourself they them their he him his she her we us everyone people du dich dir ihr euch euer sie tu te toi vous ton ta votre tú ti usted ustedes vosotros".split()
THREAT_BASES = "kill hurt destroy beat burn shoot stab punch attack crush töten schlagen verletzen tuer frapper brûler matar golpear quemar".split()
#: Endings with which a threat's base, or its stem without a last e, en, er or ar, is the same threat.
THREAT_ENDINGS = ["", "s", "ed", "d", "ing", "er", "en", "t", "st", "ez", "ons", "ar", "as", "an", "o"]
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says wrote writes quoted claimed reported called sagte schrieb dit écrit dijo escribió".split()
SEED_INSULTS = "idiot moron stupid loser".split()

_clause = re.compile(r"[^.!?;:\n]+")
_words = re.compile(r"\w+(?:'\w+)?").findall

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SOFT, DIRECT, DIRECT_THREAT = range(9)


@dataclass(frozen=True)
class Transducer:
    """Deterministic: arcs[state, symbol] = (next state, output symbol, factor). State 0 is the start."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        """(output, factor) for each symbol."""
        state, out = 0, []
        for s in symbols:
            state, o, factor = self.arcs[state, s]
            out.append((o, factor))
        return out


def _arcs(states: int, rules) -> Transducer:
    return Transducer({(s, x): (*rules(s, x), 1.0)[:3] for s in range(states) for x in range(9)})


_HARM = (INSULT, THREAT, DIRECT, DIRECT_THREAT)

#: State: words that the negation still reaches.
NEGATION_RULE = _arcs(4, lambda s, x: (3, x) if x == NEGATION else (max(s - 1, 0), SOFT if s and x in _HARM else x))
#: State: words that a target still reaches.
TARGET_RULE = _arcs(5, lambda s, x: (4, x) if x == TARGET else (max(s - 1, 0), {INSULT: DIRECT, THREAT: DIRECT_THREAT}.get(x, x) if s else x))
#: State: 1 after a word of reporting.
REPORT_RULE = _arcs(2, lambda s, x: (1, x) if x == REPORT else (s, SOFT if s and x in _HARM else x))
#: Without memory: a threat without a target is weak speech.
THREAT_RULE = _arcs(1, lambda s, x: (0, SOFT if x == THREAT else x))
#: Without memory: the share of a word's weight that counts.
INSULT_RULE = _arcs(1, lambda s, x: (0, x, {INSULT: 1.0, DIRECT: 1.4, DIRECT_THREAT: 1.4, SOFT: 0.4}.get(x, 0.0)))


def compose(*machines: Transducer) -> Transducer:
    """One machine that feeds each machine's output to the next; its states are the reachable tuples."""
    number, arcs, todo = {(0,) * len(machines): 0}, {}, [(0,) * len(machines)]
    while todo:
        states = todo.pop()
        for symbol in range(9):
            out, after, factor = symbol, [], 1.0
            for machine, state in zip(machines, states, strict=True):
                state, out, own = machine.arcs[state, out]
                after.append(state)
                factor *= own
            if tuple(after) not in number:
                number[tuple(after)] = len(number)
                todo.append(tuple(after))
            arcs[number[states], symbol] = (number[tuple(after)], out, factor)
    return Transducer(arcs)


GRAMMAR = compose(NEGATION_RULE, TARGET_RULE, REPORT_RULE, THREAT_RULE, INSULT_RULE)
THREAT_WEIGHT = 2.0


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        got = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                got = max(got, self.stems.get(word[:n], 0.0))
        return got


def _threat_forms() -> set[str]:
    forms = set()
    for base in THREAT_BASES:
        stem = base.removesuffix("en") if base.endswith("en") else base.removesuffix("e").removesuffix("er").removesuffix("ar")
        last = base[-1] if base in ("stab", "hit") else ""  # doubled before a vowel
        forms |= {base + e for e in THREAT_ENDINGS}
        if len(stem) > 2:
            forms |= {stem + last + e for e in THREAT_ENDINGS if e}
    return forms


THREATS = _threat_forms()
_CLOSED = {w: s for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}


def clause_score(words: list[str], weight: dict[str, float]) -> float:
    """Weight of a clause's path: the target machine from right to left, then the composed one."""
    symbols = [INSULT if weight.get(w) else _CLOSED.get(w, OTHER) for w in words]
    directed = [o for o, _ in TARGET_RULE.run(symbols[::-1])][::-1]
    found = zip(GRAMMAR.run(directed), symbols, words, strict=True)
    return sum(factor * (weight[w] if s == INSULT else THREAT_WEIGHT) for (_, factor), s, w in found if s in (INSULT, THREAT))


def features(text: str, lexicon: Lexicon) -> tuple[float, float, float]:
    """Best clause, total, and matched clauses of a whole text."""
    low = text.lower()
    known = {w: lexicon.weight(w) for w in set(_words(low))}
    weight = {w: x for w, x in known.items() if x}
    threats = not weight and not THREATS.isdisjoint(known)
    if not weight and not threats:
        return 0.0, 0.0, 0.0
    best = total = hits = 0.0
    for part in _clause.findall(low):
        words = _words(part)
        if any(w in weight for w in words) or any(_CLOSED.get(w) == THREAT for w in words):
            got = clause_score(words, weight)
            best, total, hits = max(best, got), total + got, hits + (got > 0)
    return best, total, hits


def _units(text: str, taken: dict[str, float] | None = None) -> dict[str, int]:
    """The words of a text, or with ``taken`` the beginnings of its words that aren't taken, each with a hash of its first context."""
    words = _words(text.lower())
    out: dict[str, int] = {}
    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        if len(word) > 2 and (taken is None and word not in out or taken is not None and word not in taken):
            context = zlib.crc32(f"{before} {word} {after}".encode())
            for unit in [word] if taken is None else [word[:n] for n in STEMS if len(word) > n]:
                out.setdefault(unit, context)
    return out


def telling(counted: pd.DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Weights of the units that tell the classes apart. ``counted``: unit, n_toxic (distinct contexts in toxic
    documents) and n_clean (clean documents).

    A unit is taken if it does so beyond what chance gives among so many units (a log-likelihood ratio
    against the share of toxic documents); its weight is its smoothed log odds."""
    t, c = counted["n_toxic"].to_numpy(float), counted["n_clean"].to_numpy(float)
    share = toxic / max(toxic + clean, 1)
    ratio = t * np.log(np.maximum(t / np.maximum((t + c) * share, 1e-9), 1e-9)) + c * np.log(np.maximum(c / np.maximum((t + c) * (1 - share), 1e-9), 1e-9))
    rate = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    return {unit: float(r) for unit, r, good in zip(counted["unit"], rate, (ratio > EVIDENCE) & (rate > 2), strict=True) if good}


@dataclass(frozen=True)
class Scorer:
    lexicon: Lexicon
    weights: tuple[float, ...]  # of 1 and the three features

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-float(np.dot(self.weights, _design([features(text, self.lexicon)])[0])))))


#: Weights where there is nothing to learn them from.
PRIOR = (-3.0, 1.0, 1.0, 1.0)


def _design(rows) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(-1, 3)
    return np.column_stack([np.ones(len(x)), np.minimum(x[:, 0], 20) / 4, np.log1p(x[:, 1]), np.log1p(x[:, 2])])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 30) -> np.ndarray:
    """Newton's steps for a ridge-penalised logistic regression."""
    w = np.array(PRIOR)
    penalty = np.diag([1e-3, ridge, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        gradient = x.T @ ((p - y)) + penalty @ w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w = w - step.clip(-2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Scorer:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text).

    The sample is about ``per_class`` documents of each class at most, whatever the tables hold, so what the
    driver gets, postings of the units that tell classes apart, is bounded too."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Scorer(Lexicon(dict.fromkeys(SEED_INSULTS, 4.0), {}), PRIOR)
    share = F.when(F.col("toxic") == 1, F.lit(per_class / sizes[1])).otherwise(F.lit(per_class / sizes[0]))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # at most about two times per_class rows of two numbers
    sample = docs.join(F.broadcast(drawn), "doc_id").where("text is not null").select("toxic", "text", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold"))

    n = {c: min(sizes[c], per_class) for c in sizes}

    def learn(taken: dict[str, float] | None) -> list[dict[str, float]]:
        """Telling units of all the sample, and of what lies outside of either half."""

        def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for piece in chunks(pdf):
                    found = [_units(t, taken) for t in piece["text"]]
                    m = [len(f) for f in found]
                    if not any(m):
                        continue
                    yield pd.DataFrame({
                        "unit": [u for f in found for u in f], "context": [x for f in found for x in f.values()],
                        "toxic": np.repeat(piece["toxic"].to_numpy(), m), "fold": np.repeat(piece["fold"].to_numpy(), m),
                    })

        counted = (
            sample.mapInPandas(tidy(units), "unit string, context long, toxic int, fold int")
            .groupBy("unit", F.when(F.col("toxic") == 1, F.col("context")).alias("context"), "fold").agg(F.sum(1 - F.col("toxic")).alias("n"))
            .groupBy("unit").agg(
                *[F.count(F.when(F.col("fold") == f, F.col("context"))).alias(f"toxic_{f}") for f in (0, 1)],
                *[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"clean_{f}") for f in (0, 1)],
            )
            .where("toxic_0 + toxic_1 >= 4 and (clean_0 + clean_1) * 4 <= toxic_0 + toxic_1").toPandas()
        )
        whole = counted.assign(n_toxic=counted["toxic_0"] + counted["toxic_1"], n_clean=counted["clean_0"] + counted["clean_1"])
        return [telling(whole, n[1], n[0])] + [telling(counted.assign(n_toxic=counted[f"toxic_{1 - f}"], n_clean=counted[f"clean_{1 - f}"]), n[1] // 2, n[0] // 2) for f in (0, 1)]

    words = learn(None)
    # beginnings stand for words too rare to be taken themselves
    lexicon, *halves = [Lexicon(w, s) for w, s in zip(words, learn(words[0]), strict=True)]
    if not lexicon.words and not lexicon.stems:
        return Scorer(Lexicon(dict.fromkeys(SEED_INSULTS, 4.0), {}), PRIOR)

    # the weights are fitted on matches of a lexicon that was learned on the other half: on its own half it matches too well
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [features(t, halves[f]) for t, f in zip(pdf["text"], pdf["fold"], strict=True)]
            yield pd.DataFrame(rows, columns=["best", "total", "hits"]).assign(toxic=pdf["toxic"].to_numpy())

    seen = sample.mapInPandas(tidy(measured), "best double, total double, hits double, toxic int").toPandas()
    if seen["toxic"].nunique() < 2:
        return Scorer(lexicon, PRIOR)
    return Scorer(lexicon, tuple(_logistic(_design(seen[["best", "total", "hits"]].to_numpy()), seen["toxic"].to_numpy(float)).tolist()))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, predicted, best_clause, total and matched_clauses for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for pdf in batches:
            rows = np.array([features(t or "", s.lexicon) for t in pdf["text"]], np.float64).reshape(-1, 3)
            p = 1 / (1 + np.exp(-(_design(rows) @ np.array(s.weights)).clip(-30, 30)))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32),
                "best_clause": rows[:, 0], "total": rows[:, 1], "matched_clauses": rows[:, 2].astype(np.int32),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(tidy(run), f"doc_id {kind}, score double, predicted int, best_clause double, total double, matched_clauses int")
