"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts.

Folding lower-cases, maps homoglyphs to Latin letters and digits or signs beside letters, inside
words or at their ends, to the letters they stand for. Lexicon entries are whole words or word beginnings with a weight, learned
as smoothed log odds from a bounded, balanced sample of labelled texts; longer entries override
shorter ones at the same place, so exception phrases are entries of weight 0. The weights found are
summed, normalised by length, and turned to a probability by a logistic regression, whose bias is
set back to the class ratio of all labels.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_texts
from textquarry.session import discard, materialize

#: Cyrillic and Greek letters that look like Latin ones, and the letters they look like.
HOMOGLYPHS = dict(zip("абвгеікмнорстухѕјԁһ" + "αβεικνορτυχ", "a6breikmhopctyxsjdh" + "abeiknoptux"))
#: Digits and signs in words, and the letters they stand for.
DIGITS = dict(zip("013457@$", "oieastas"))
FULL_WIDTH = {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: chr(48 + i) for i in range(10)}
TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | FULL_WIDTH | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
odd_letters = re.compile(f"[{''.join(map(re.escape, map(chr, TABLE)))}]").search
#: Runs of such digits and signs that touch a letter, before or after it: inside words and at their ends.
inside = re.compile(r"(?<=[^\W\d_])[013457@$]+|[013457@$]+(?=[^\W\d_])").sub
LETTERS = str.maketrans(DIGITS)
between = re.compile(r"[\W\d_]+").sub


@dataclass(frozen=True)
class ToxicParams:
    per_class: int = 2500  #: expected labelled texts of each class in the training sample; bounds it
    prefix: tuple[int, int] = (3, 8)  #: lengths of word beginnings
    min_texts: int = 3  #: toxic training texts that must hold an entry
    min_odds: float = 2.5  #: least log odds of an entry
    folds: int = 5  #: parts of the sample, each measured by the lexicon of the others
    exceptions: tuple[str, ...] = field(default=())  #: phrases that are never toxic


def fold_text(text: str | None) -> str:
    """Folded words, each with one space before and after it."""
    if not text:
        return " "
    t = text.lower()
    if not t.isascii() and odd_letters(t):
        t = t.translate(TABLE)
    return f" {between(' ', inside(lambda m: m[0].translate(LETTERS), t)).strip()} "


def features(folded: str, prefix: tuple[int, int]) -> set[str]:
    out = set()
    for w in {*folded.split()}:
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(prefix[0], min(prefix[1], len(w)) + 1))
    return out


@dataclass
class ToxicModel:
    weights: dict[str, float]
    coef: tuple[float, float, float]  #: bias, of log1p of the weight sum, of the weight per 100 words


def measures(folded: str, automaton) -> tuple[float, float]:
    """Weight found, and weight for each 100 words, both damped."""
    total = 0.0
    if automaton is not None:
        for _, w in automaton.iter_long(folded.replace(" ", "  ")):
            total += w
    n = folded.count(" ")
    return math.log1p(max(total, 0.0)), math.log1p(100 * max(total, 0.0) / (n + 20))


def build_automaton(weights: dict[str, float]):
    """Matches don't overlap, so words stand two spaces apart in scanned texts and phrases: one for the entry before, one for the next."""
    import ahocorasick

    if not weights:
        return None
    a = ahocorasick.Automaton()
    for k, w in weights.items():
        a.add_word(k[:1] + k[1:-1].replace(" ", "  ") + k[1:][-1:], w)
    a.make_automaton()
    return a


def choose_entries(counts: list[tuple[str, int, int]], n: tuple[int, int], params: ToxicParams = ToxicParams()) -> dict[str, float]:
    """Entry -> weight from (entry, clean texts, toxic texts) of n = (clean, toxic) texts; exceptions have weight 0."""
    odds = lambda c, t: math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
    weights = {e: odds(c, t) for e, c, t in sorted(counts) if t >= params.min_texts and odds(c, t) >= params.min_odds}
    for e in sorted(weights, key=len):  # the shortest beginning that tells as much stands for longer ones
        if any(weights.get(e[:k], -1) >= weights[e] - 0.7 for k in range(2, len(e))):
            weights.pop(e)
    stems = tuple(weights)
    for e, c, t in counts:  # clean words that begin as an entry does are exceptions
        if c > t and odds(c, t) <= 0 and e.endswith(" ") and e.startswith(stems):
            weights[e] = 0.0
    return weights | {fold_text(x): 0.0 for x in params.exceptions}


def regress(found: list[tuple[int, float, float]], n: tuple[int, int], full: tuple[int, int] | None = None) -> tuple[float, float, float]:
    """Weights of the logistic regression over (label, the two measures) of n = (clean, toxic) sample texts.

    full: (clean, toxic) of all labels that the sample stands for. The sample's class ratio isn't theirs,
    which shifts the log odds of every text by the same amount; the bias takes that back.
    """
    base = n[1] / max(sum(n), 1)
    x = np.array([[1.0, a, b] for _, a, b in found]).reshape(-1, 3)
    y = np.array([k for k, _, _ in found], float)
    w = np.array([math.log((base + 1e-3) / (1 - base + 1e-3)), 0.0, 0.0])
    if len(y) and 0 < y.mean() < 1:
        for _ in range(60):  # Newton with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2]) * len(y) / 100 + np.eye(3) * 1e-6
            g = x.T @ (p - y) + np.array([0.0, 1e-2, 1e-2]) * len(y) / 100 * w
            step = np.linalg.solve(h, g)
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
    if full and min(*full, *n) > 0:
        w[0] += math.log(full[1] / full[0] * n[0] / n[1])
    return tuple(map(float, w))


def fit(df: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_where=None) -> ToxicModel:
    """Learn from a sample of the labelled rows: about `per_class` texts of each label, by a hash of the id.

    Entries are chosen by evidence alone, and exceptions are all clean words that begin as an entry
    does, so that the sample bounds both. Texts stay with the workers, whatever their length: these count entries, of which the strong ones
    come to the driver, and then measure the sample, which gives three numbers a text. A text is
    measured by the lexicon of the other folds, so that the regression doesn't take chance entries of
    its own texts for good ones. Null labels are not used; a document with several label rows counts
    with the highest.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    if train_where is not None:
        marks = marks.where(train_where(F.col("__id")))
    n = {r["__y"]: r["n"] for r in marks.where("__y in (0, 1)").groupBy("__y").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64(F.col("__id").cast("string"), F.lit("toxicity")).cast("double") / 2.0**64 + 0.5
    picked = F.lit(False)
    for y in (0, 1):
        share = min(1.0, params.per_class / max(n.get(y, 0), 1))
        picked = picked | ((F.col("__y") == y) & ((draw < share) if share < 1 else F.lit(True)))
    sample = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(marks.where(picked)), "__id").select("__id", "__y", "__t")

    folded = map_texts(sample, lambda: lambda texts: [[fold_text(t) for t in texts]], "folded string", "__id", "__t", ("__y",))
    folded = materialize(folded.withColumn("__f", F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("fold")), F.lit(params.folds)).cast("int")), "toxic")
    held = {(r["__f"], r["__y"]): r["n"] for r in folded.groupBy("__f", "__y").agg(F.count("*").alias("n")).collect()}
    sizes = tuple(sum(k for (_, y), k in held.items() if y == label) for label in (0, 1))

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        found: dict[tuple[int, int], Counter] = {}
        for b in batches:
            for f, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found.setdefault((f, y), Counter()).update(features(t, params.prefix))
        for (f, y), c in found.items():
            keys = [*c]
            for at in range(0, len(keys), 10_000):
                part = keys[at : at + 10_000]
                yield pa.RecordBatch.from_pydict({"e": part, "f": [f] * len(part), "y": [y] * len(part), "n": [c[k] for k in part]}, pa.schema([("e", pa.string()), ("f", pa.int32()), ("y", pa.int32()), ("n", pa.int64())]))

    of = lambda y, f: F.sum(F.when((F.col("y") == y) & (F.col("f") == f), F.col("n")).otherwise(0))
    total = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    counts = folded.select("__f", "__y", "folded").mapInArrow(count, "e string, f int, y int, n long").groupBy("e").agg(
        total(0).alias("c"), total(1).alias("t"), F.array(*[F.struct(of(0, f).alias("c"), of(1, f).alias("t")) for f in range(params.folds)]).alias("by")
    )
    counts = materialize(counts, "entries")
    # entries five times as frequent among toxic texts, a wider bound than min_odds, as a fold's lexicon leaves texts out
    strong = counts.where((F.col("t") >= params.min_texts) & (F.col("t") * (sizes[0] + 1.0) >= 5 * (F.col("c") + 0.5) * (sizes[1] + 1.0)))
    rows = strong.orderBy("e").collect()
    lefts = [tuple(sizes[y] - held.get((f, y), 0) for y in (0, 1)) for f in range(params.folds)]
    every = lambda found: [([(r.e, r.c, r.t) for r in found], sizes)] + [([(r.e, r.c - r.by[f].c, r.t - r.by[f].t) for r in found], lefts[f]) for f in range(params.folds)]
    stems = {e for some, left in every(rows) if min(left) > 0 for e in choose_entries(some, left, params)}
    if stems:  # clean words that begin as one of them does
        begins = df.sparkSession.createDataFrame([(e,) for e in sorted(stems)], "stem string")
        clean = counts.where((F.col("c") > F.col("t")) & F.col("e").endswith(" ") & (F.col("c") >= 2))
        prefixes = clean.select("e", F.explode(F.transform(F.sequence(F.lit(2), F.length("e")), lambda k: F.substr("e", F.lit(1), k))).alias("stem"))
        rows += clean.join(prefixes.join(begins, "stem").select("e").distinct(), "e").orderBy("e").collect()
    (some, _), *by_fold = every(rows)
    weights = choose_entries(some, sizes, params)
    without = [choose_entries(some, left, params) if min(left) > 0 else {} for some, left in by_fold]  # for each fold, the lexicon of the others

    def factory():
        automata: dict[int, object] = {}

        def f(texts):
            out = []
            for t in texts:
                fold, text = int(t[: t.index("\n")]), t[t.index("\n") + 1 :]
                if fold not in automata:
                    automata[fold] = build_automaton(without[fold])
                out.append(measures(text, automata[fold]))
            return [*zip(*out)]

        return f

    marked = folded.select("__id", "__y", F.concat_ws("\n", F.col("__f").cast("string"), "folded").alias("__t"))
    measured = [(r["__y"], r.a, r.b) for r in map_texts(marked, factory, "a double, b double", "__id", "__t", ("__y",)).collect()]
    discard(folded, counts)
    return ToxicModel(weights, regress(sorted(measured), sizes, (n.get(0, 0), n.get(1, 0))))


def score(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: the id, score (0 to 1), predicted (1 if score >= 0.5), hits.

    A null or empty text has no hits and gets the score of a text without any. Whole texts are
    scanned; repeated rows are scored each. A model of an empty table scores 0.5 at most.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = held.value
        automaton, (b, u, v) = build_automaton(m.weights), m.coef

        def f(texts):
            scores, hits = [], []
            for t in texts:
                x, d = measures(fold_text(t), automaton)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b + u * x + v * d)))))
                hits.append(x > 0)
            return [scores, [int(s >= 0.5) for s in scores], hits]

        return f

    return map_texts(df, factory, "score double, predicted int, hits boolean", id_col, text_col, extra)
