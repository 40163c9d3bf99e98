"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word is its bracketed self and its character 3- and 4-grams, each hashed to a row of an embedding
table; a text is the mean of the rows of all its words' subwords; a linear softmax over the mean
gives the language. Both layers are trained by stochastic gradient descent in numpy on a bounded
sample of labelled texts; a part of the sample that isn't trained on sets the temperature of the
probabilities and the level below which a prediction is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_texts, trim

WORD_ENTRIES, WORD_LENGTH = 250_000, 48
find_words = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class LangParams:
    per_language: int = 300  #: expected texts of each language in the training sample; bounds it
    most_texts: int = 60_000  #: expected texts of all languages together; with more than 200 languages each gives fewer
    buckets: int = 1 << 16
    dim: int = 16
    epochs: int = 4
    rate: float = 0.4
    batch: int = 16
    calibration: float = 0.2  #: share of the sample for temperature and rejection
    reject_quantile: float = 0.01  #: share of right calibration predictions that rejection may lose
    seed: int = 7


def subwords(word: str, buckets: int) -> list[int]:
    w = f"<{word}>"
    grams = [w] + [w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1) if n < len(w)]
    return [crc32(g.encode("utf-8", "surrogatepass")) & (buckets - 1) for g in grams]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Numerals that aren't decimal digits, such as fractions and Roman numerals, are no letters."""
    if not text:
        return []
    words = find_words(text.lower())
    odd = {w for w in {*words} if not w.isalpha()}
    if not odd:
        return words
    parts = {w: "".join(c if c.isalpha() else " " for c in w).split() for w in odd}
    return [x for w in words for x in (parts[w] if w in odd else (w,))]


def text_features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of a text and how often each occurs: at most `buckets` of them, however long the text."""
    total: dict[int, int] = {}
    for w, n in Counter(words_of(text)).items():
        for b in subwords(w, buckets):
            total[b] = total.get(b, 0) + n
    ids = sorted(total)
    return np.array(ids, np.int64), np.array([total[b] for b in ids], np.float32)


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  #: a row of logits for each bucket: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], params: LangParams = LangParams()) -> LangModel:
    """rows: (lang, buckets, counts) of training texts. Without rows the model knows no language and predicts `und`."""
    rows = sorted(((la, ids, n) for la, ids, n in rows if len(ids)), key=lambda r: (r[0], len(r[1]), r[1].tolist(), r[2].tolist()))
    langs = sorted({r[0] for r in rows})
    if not langs:
        return LangModel([], np.zeros((params.buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(params.seed)
    slot = {la: i for i, la in enumerate(langs)}
    feats, y = [(ids, (n / n.sum()).astype(np.float32)) for _, ids, n in rows], np.array([slot[r[0]] for r in rows])
    order = rng.permutation(len(rows))
    n_cal = int(len(rows) * params.calibration) if len(rows) >= 20 else 0
    cal, fit = order[:n_cal], order[n_cal:]
    emb = rng.normal(0, 0.1, (params.buckets, params.dim)).astype(np.float32)
    out, bias = np.zeros((params.dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(params.epochs):
        rate = params.rate * (1 - epoch / params.epochs)
        for at in range(0, len(fit), params.batch):
            part = rng.permutation(fit)[: params.batch] if at == 0 else fit[at : at + params.batch]
            x = np.stack([v @ emb[ids] for ids, v in (feats[i] for i in part)])
            z = x @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = p @ out.T
            out -= rate * x.T @ p
            bias -= rate * p.mean(0)
            for i, g in zip(part, back):
                ids, v = feats[i]
                emb[ids] -= (rate * 20) * v[:, None] * g
        fit = rng.permutation(fit)
    table = (emb @ out).astype(np.float32)

    def logits(index):
        return np.stack([v @ table[ids] for ids, v in (feats[i] for i in index)]) + bias

    use = cal if len(cal) else np.arange(len(rows))
    z = logits(use)

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(use)), y[use]] - np.log(np.exp(s).sum(1))).mean())

    temperature = min(np.geomspace(0.2, 5, 41), key=loss)
    s = z / temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == y[use]
    level = float(np.quantile(p.max(1)[right], params.reject_quantile)) if right.any() else 0.0
    return LangModel(langs, table, bias, float(temperature), min(level, 0.9))


def training_sample(df: DataFrame, label_col: str, id_col: str, text_col: str, params: LangParams) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, counts) of about `per_language` labelled texts of each language, chosen by a hash of the id: the model's bounded sample.

    Every language is sampled, whatever its part of the table. Texts become counts of subword buckets
    in the workers, so that a long text takes no more of the driver than `buckets` numbers.
    """
    labelled = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")).alias("h")
    )
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    total = sizes.agg(F.count("*").alias("k")).first()["k"]
    if not total:
        return []
    each = min(params.per_language, params.most_texts / total)
    share = F.broadcast(sizes.select("lang", (F.lit(float(each)) / F.col("n")).alias("share")))  # a row a language
    draw = F.col("h").cast("double") / 2.0**64 + 0.5
    sample = labelled.join(share, "lang").where((F.col("share") >= 1) | (draw < F.col("share"))).select("lang", "text")

    def factory():
        def f(texts):
            found = [text_features(t, params.buckets) for t in texts]
            return [[ids for ids, _ in found], [n for _, n in found]]

        return f

    rows = map_texts(sample, factory, "ids array<int>, n array<float>", "lang", "text").toArrow()
    return [(la, np.array(ids, np.int64), np.array(n, np.float32)) for la, ids, n in zip(rows["lang"].to_pylist(), rows["ids"].to_pylist(), rows["n"].to_pylist())]


def predict(df: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: the id, lang_pred, score, accepted.

    The whole text is used. lang_pred is `und` with score 0 if the text is null or has no letter,
    or the model knows no language; else the likeliest learned language (ties: the first by name),
    with its calibrated probability. accepted is false for `und` and below the level of rejection.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        m, rows, index = held.value, [], {}
        width = len(m.langs)
        table = np.zeros((1 << 12, width), np.float32)
        sizes = np.zeros(1 << 12, np.float32)
        buckets = len(m.table)

        def f(texts):
            nonlocal table, sizes
            pred, score, accepted = [], [], []
            for t in texts:
                words = words_of(t)
                if not words or not width:
                    pred.append("und"), score.append(0.0), accepted.append(False)
                    continue
                if len(index) > WORD_ENTRIES:
                    index.clear()
                long = []
                for w in {*words}.difference(index):
                    ids = subwords(w, buckets)
                    if len(w) > WORD_LENGTH:
                        long.append((m.table[ids].sum(0) * (n := words.count(w)), len(ids) * n))
                        continue
                    k = index[w] = len(index)
                    if k >= len(table):
                        table, sizes = np.concatenate([table, np.zeros_like(table)]), np.concatenate([sizes, np.zeros_like(sizes)])
                    table[k], sizes[k] = m.table[ids].sum(0), len(ids)
                at = np.fromiter([index[w] for w in words if len(w) <= WORD_LENGTH] if long else map(index.__getitem__, words), np.int64)
                total = table[at].sum(0, dtype=np.float64) + sum(a for a, _ in long)
                z = (total / max(sizes[at].sum(dtype=np.float64) + sum(n for _, n in long), 1) + m.bias) / m.temperature
                p = np.exp(z - z.max())
                p /= p.sum()
                best = int(p.argmax())
                pred.append(m.langs[best]), score.append(float(p[best])), accepted.append(bool(p[best] >= m.reject_below))
            return [pred, score, accepted]

        return f

    return map_texts(df, factory, "lang_pred string, score double, accepted boolean", id_col, text_col, extra)
