"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech); small transducers read the
symbols of a clause and are composed by running side by side. A matched clause gets the weight of its
insult or threat, raised when it is aimed at a target and lowered when it is negated or reported. The
lexicon of insults and the weights of the patterns are learned from labelled texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

FIT_ROWS = 8000  # most labelled rows the model is fitted on, those with the smallest digests
UNITS = 4000  # most entries of the learned lexicon, those with the largest weights
LEAST_WEIGHT = 1.5  # least log odds of a unit
PREFIXES = (4, 5, 6, 7, 8, 9)  # lengths of word beginnings that are units beside whole words

#: Fixed word lists of the closed classes, by language: English, German, French, Spanish.
TARGETS = "you your yours he him his she her they them their du dich dir dein er ihn sie ihr ihnen tu te toi ton vous votre il elle ils elles tú ti usted ustedes él ella ellos ellas"
NEGATIONS = "not no never nobody nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna"
REPORTS = "said says say wrote writes called calls quoted claimed sagte sagt schrieb nannte behauptete dit écrit appelé prétend dijo dice escribió llamó"
THREATS = "kill hurt destroy beat stab shoot murder burn töten umbringen schlagen verletzen vernichten tuer frapper détruire brûler matar golpear destruir quemar"

WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;\n]")


# --- transducers ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """Weighted finite-state transducer over symbols.

    ``arcs`` maps (state, symbol) to (next state, weight, mark); symbols without an arc lead to
    ``other`` of the state. A mark is what the arc writes.
    """

    arcs: dict[tuple[int, str], tuple[int, float, str]]
    other: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, float, str]:
        return self.arcs.get((state, symbol), (self.other.get(state, 0), 0.0, ""))


def within(opener: str, closer: str, reach: int, mark: str) -> Transducer:
    """Writes ``mark`` at a closer at most ``reach`` symbols after an opener."""
    arcs = {(0, opener): (1, 0.0, "")}
    for s in range(1, reach + 1):
        arcs[s, opener] = (1, 0.0, "")
        arcs[s, closer] = (s + 1 if s < reach else 0, 1.0, mark)
    return Transducer(arcs, {s: s + 1 if s < reach else 0 for s in range(1, reach + 1)})


def after(opener: str, closer: str, mark: str) -> Transducer:
    """Writes ``mark`` at every closer that follows an opener in the clause."""
    return Transducer({(0, opener): (1, 0.0, ""), (1, opener): (1, 0.0, ""), (1, closer): (1, 1.0, mark)}, {0: 0, 1: 1})


class Grammar:
    """Transducers composed by running side by side; marks fall on insults and threats."""

    def __init__(self):
        self.parts = [
            within("target", "insult", 4, "targeted"),
            within("insult", "target", 4, "aims"),
            within("target", "threat", 4, "targeted"),
            within("threat", "target", 4, "aims"),
            within("negation", "insult", 3, "negated"),
            within("negation", "threat", 3, "negated"),
            after("report", "insult", "reported"),
            after("report", "threat", "reported"),
        ]

    def read(self, symbols: list[tuple[str, float]]) -> list[tuple[str, float, set[str]]]:
        """(insult or threat, weight, marks) of a clause."""
        states = [0] * len(self.parts)
        found: list[tuple[str, float, set[str]]] = []
        for symbol, weight in symbols:
            marks = set()
            for k, part in enumerate(self.parts):
                states[k], _, mark = part.step(states[k], symbol)
                if mark:
                    marks.add(mark)
            if symbol in ("insult", "threat"):
                found.append((symbol, weight, marks))
            elif symbol == "target" and "aims" in marks and found:
                found[-1][2].add("targeted")
        return found


# --- model ------------------------------------------------------------------------------------

FEATURES = ("plain", "negated", "reported", "targeted", "threat", "repeated", "length")
#: Prior of the pattern weights: what the fit is drawn to where labels say nothing.
PRIOR = np.array([1.0, 0.6, 0.6, 0.3, 0.5, 0.3, 0.3])


@dataclass
class Model:
    lexicon: dict[str, float]  # unit (``word`` or ``begin*``) to weight
    weights: np.ndarray
    bias: float


class Scorer:
    """Scores whole texts; only clauses in which a lexicon unit or a threat occurs are read."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.grammar = model, Grammar()
        self.classes: dict[str, str] = {}
        for symbol, listed in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)):
            self.classes.update(dict.fromkeys(listed.split(), symbol))
        self.finder = ahocorasick.Automaton()
        for unit in {*(u.rstrip("*") for u in model.lexicon), *THREATS.split()}:
            self.finder.add_word(unit, len(unit))
        self.finder.make_automaton()

    def weight(self, word: str) -> float:
        lex = self.model.lexicon
        return max([lex.get(word, 0.0), *(lex.get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) >= n)])

    def symbol(self, word: str) -> tuple[str, float]:
        if w := self.weight(word):
            return "insult", w
        return self.classes.get(word, "word"), 0.0

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        low = text.lower()
        done = 0  # end of the last clause that was read
        total = 0.0
        for last, size in self.finder.iter(low):
            first = last - size + 1
            if first < done or (first and (low[first - 1].isalnum() or low[first - 1] == "_")):
                continue
            start = max((low.rfind(c, done, first) + 1 for c in ".!?;\n"), default=0)
            end = CLAUSE.search(low, first)
            start, done = max(start, done), end.start() if end else len(low)
            symbols = [self.symbol(w) for w in WORD.findall(low[start:done])]
            for kind, w, marks in self.grammar.read(symbols):
                if kind == "threat":
                    out[4] = max(out[4], 1.0 if "targeted" in marks and not marks & {"negated", "reported"} else 0.0)
                    continue
                k = 2 if "reported" in marks else 1 if "negated" in marks else 0
                out[k] = max(out[k], w)
                if "targeted" in marks and not k:
                    out[3] = max(out[3], w)
                total += w
        # the strongest clause counts once, under its weakest reading
        if out[0] >= max(out[1], out[2]):
            out[1] = out[2] = 0.0
        elif out[1] >= out[2]:
            out[0] = out[2] = 0.0
        else:
            out[0] = out[1] = 0.0
        out[5] = math.log1p(max(0.0, total - out[:3].max()))
        out[6] = -math.log1p(len(text) / 2000)  # a chance match is likelier in a long text
        return out

    def score(self, text: str | None) -> float:
        z = float(self.features(text or "") @ self.model.weights) + self.model.bias
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


# --- fitting ------------------------------------------------------------------------------------


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from; a null id counts as not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _units(text: str) -> list[str]:
    words = set(WORD.findall(text.lower()))
    out = {w for w in words if len(w) >= 3}
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) >= n)
    return sorted(out)


def _fingerprints(text: str) -> list[int]:
    """Three smallest hashes of word five-grams: near copies share one."""
    import zlib

    w = WORD.findall(text.lower())
    grams = {zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))}
    return [min((g * a + b) % 4294967291 for g in grams) for a, b in ((1, 0), (2654435761, 97), (40503, 12345))]


def fit_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled documents that are not held out, one per id."""
    ids = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter("id is not null and label is not null")
        .filter(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    ids = ids.withColumn("digest", F.xxhash64("id")).orderBy("digest", "id").limit(rows).drop("digest")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    # at most ``rows`` ids, so they may be broadcast
    return texts.join(F.broadcast(ids), "id").dropDuplicates(["id"])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS
) -> Model:
    """Learns the lexicon and the pattern weights from at most ``rows`` labelled documents.

    Copies and near copies count once, so words that only copies share are not taken for insults. A
    unit enters the lexicon if it is frequent among toxic texts and rare among others. Without toxic
    labels the lexicon is empty, and every score is low.
    """

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prints = [_fingerprints(t) for t in b["text"]]
            yield pd.DataFrame({
                "id": b["id"].astype(str), "label": b["label"], "prints": prints, "units": [_units(t) for t in b["text"]],
            })

    sample = fit_rows(docs, labels, id_col, text_col, label_col, rows)
    sample = sample.persist()
    seen = sample.repartition(16).mapInPandas(described, "id string, label int, prints array<long>, units array<string>").persist()
    try:
        firsts = seen.select("id", "label", F.posexplode("prints").alias("k", "print"))
        firsts = firsts.groupBy("label", "k", "print").agg(F.min("id").alias("id"))
        chosen = firsts.groupBy("id").agg(F.count("*").alias("n")).filter("n = 3").select("id")
        single = seen.join(F.broadcast(chosen), "id")  # at most ``rows`` ids
        counts = {r["label"]: r["n"] for r in single.groupBy("label").agg(F.count("*").alias("n")).collect()}
        toxic, clean = counts.get(1, 0), counts.get(0, 0)
        least = max(4, math.ceil(0.02 * toxic))
        per = single.select("label", F.explode("units").alias("unit")).groupBy("unit").agg(
            F.sum((F.col("label") == 1).cast("long")).alias("t"), F.sum((F.col("label") == 0).cast("long")).alias("c")
        )
        weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
        kept = (
            per.filter((F.col("t") >= least) & (F.col("t") >= F.col("c")))
            .withColumn("weight", weight)
            .filter(F.col("weight") >= LEAST_WEIGHT)
            .orderBy(F.desc("weight"), "unit")
            .limit(UNITS)
        )
        model = Model({r["unit"]: round(r["weight"], 6) for r in kept.collect()}, PRIOR.copy(), -4.0)

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(model)
            for b in batches:
                rows = np.array([scorer.features(t) for t in b["text"]]).reshape(len(b), len(FEATURES))
                yield pd.DataFrame({"label": b["label"], **{n: rows[:, k] for k, n in enumerate(FEATURES)}})

        ddl = "label int, " + ", ".join(f"{n} double" for n in FEATURES)
        points = sample.mapInPandas(measured, ddl).toPandas()  # at most ``rows`` rows of eight numbers
    finally:
        seen.unpersist()
        sample.unpersist()
    if toxic and clean:
        points = points.sort_values(list(points.columns))  # the same sums in every run
        model.weights, model.bias = logistic(points[list(FEATURES)].to_numpy(), points["label"].to_numpy())
    return model


def logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton steps for logistic weights drawn to ``PRIOR``, never below zero."""
    full = np.column_stack([x, np.ones(len(x))])
    prior = np.append(PRIOR, -4.0)
    w = prior.copy()
    pull = np.append(np.full(x.shape[1], strength), 0.05)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (p - y) + pull * (w - prior)
        hessian = (full * (p * (1 - p))[:, None]).T @ full + np.diag(pull)
        move = np.linalg.solve(hessian, gradient)
        w -= np.clip(move, -1.0, 1.0)
        if np.abs(move).max() < 1e-8:
            break
    return np.maximum(np.round(w[:-1], 6), 0.0), round(float(w[-1]), 6)


# --- scoring ------------------------------------------------------------------------------------


def score_documents(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, held_out, score, predicted) of every document, with the columns of ``keep``.

    Whole texts are scored; null and empty texts get the score of a text without any match; repeated
    rows stay as many; an empty table gives an empty result. Nothing but the text enters the score.
    """

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    others = [c for c in keep if c != id_col]
    return (
        docs.select(id_col, *others, scores(F.col(text_col)).alias("_score"))
        .select(id_col, *others, held_out(F.col(id_col)).alias("held_out"), F.col("_score").alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
