"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is coded as its words (A-Z folded), each with a closing space, then one end byte. A byte is
eight binary decisions; each node of that decision tree has a context tree over the previous `depth`
bytes of the text, whatever word they are in; before the start stand spaces. Every context keeps the
Krichevsky-Trofimov estimate of its counts; bottom up, a context's weighted probability is half its
own estimate and half the product of its children's; top down, this gives the predictive mixture over
all depths. A context that training never saw hands the decision to the deepest one that it did see.

Counts, weights and mixtures are tables keyed by (context, node) in 64-bit integers, one level a
group-by. A text's code length is the sum of the costs of its grams (context and byte).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_texts
from textquarry.session import discard, materialize

END = 0x0A  #: byte of the end token; no word holds it


@dataclass(frozen=True)
class CtwParams:
    depth: int = 5  #: context bytes, six at most
    head_words: int = 300_000  #: most frequent words whose counts go to every worker; others meet theirs in a join
    head_length: int = 48  #: longest of them, bytes
    most_grams: int = 2_000_000  #: most gram costs that go to every worker, in a table of 64 MB; the rarer ones meet texts in a join
    block_bytes: int = 4_000_000  #: bytes of texts whose grams are packed at once


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def packed(pieces: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of each byte after the first `depth` of each piece, packed in 64 bits, and where each piece's begin.

    The pieces lie in one buffer, of which eight bytes at every place are read as a big-endian integer;
    the windows that reach over the end of a piece are left out.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    buf = b"".join([*pieces, b"\0" * 8])
    n = int(sizes.sum())
    key = np.ndarray((n,), ">u8", buf, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (7 - depth))
    whole = np.ones(n, bool)
    whole[(np.cumsum(sizes)[:, None] - 1 - np.arange(depth)).ravel()] = False
    return key[whole].view(np.int64), np.cumsum(sizes - depth) - (sizes - depth)


def text_blocks(texts, depth: int, size: int):
    """Grams of coded texts, about `size` bytes at once: keys, where each piece's begin, the text of each piece. Longer texts go by pieces that begin with their context."""
    pieces, owners, n = [], [], 0
    for i, t in enumerate(texts):
        coded = b" " * depth + b" ".join([*tokens_of(t), bytes([END])])
        for at in range(0, len(coded) - depth, size):
            pieces.append(coded[at : at + size + depth] if len(coded) > size else coded), owners.append(i)
            n += len(pieces[-1])
            if n >= size:
                yield *packed(pieces, depth), np.array(owners)
                pieces, owners, n = [], [], 0
    if pieces:
        yield *packed(pieces, depth), np.array(owners)


class CostTable:
    """Costs by key in an open table of linear probing: two arrays, built and searched without a loop over keys."""

    FREE = np.int64(-1)  #: no gram: the byte 0xFF is in no UTF-8 text
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        self.bits = max(int(len(keys) * 2 - 1).bit_length(), 4)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        n = np.arange(len(keys))
        at = np.maximum.accumulate(slot[order] - n) + n if len(keys) else n  # each key at its slot or right after the one before
        self.keys = np.full(max((1 << self.bits), int(at[-1]) + 1 if len(at) else 0) + 1, self.FREE)
        self.costs = np.zeros(len(self.keys))
        self.keys[at], self.costs[at] = keys[order], costs[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs, 0 where a key isn't held, and the places of those keys."""
        at = self._slot(keys)
        there = self.keys[at]
        cost = np.where(there == keys, self.costs[at], 0.0)
        missing = [np.flatnonzero(there == self.FREE)]
        left = np.flatnonzero((there != keys) & (there != self.FREE))
        at = at[left]
        while len(left):
            at = at + 1
            there = self.keys[at]
            hit = there == keys[left]
            cost[left[hit]] = self.costs[at[hit]]
            free = there == self.FREE
            missing.append(left[free])
            on = ~(hit | free)
            left, at = left[on], at[on]
        return cost, np.concatenate(missing)


def _ln_gamma(x: Column) -> Column:
    """For x >= 0.5: Stirling's series after a shift by seven."""
    z = x + 7
    s = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return s - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6))


def ln_kt(a: Column, b: Column) -> Column:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones in any one order."""
    return _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - _ln_gamma(a + b + 1.0) - math.log(math.pi)


def _ln_mix(own: Column, children: Column) -> Column:
    """Log of half of each."""
    top = F.greatest(own, children)
    return top + F.log(F.exp(own - top) + F.exp(children - top)) - math.log(2)


def count_tokens(df: DataFrame, trained: Column, text_col: str, flush: int = 200_000) -> DataFrame:
    """(word, c_train, c_all) over all texts; the end token is the empty word, once a text."""

    def count(batches):
        import pyarrow as pa

        out = pa.schema([("word", pa.binary()), ("t", pa.int64()), ("n", pa.int64())])
        both = {True: Counter(), False: Counter()}

        def drain():
            keys = [*{*both[True], *both[False]}]
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                t = [both[True][k] for k in part]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(t, pa.int64()), pa.array([x + both[False][k] for x, k in zip(t, part)], pa.int64())], schema=out)
            both[True].clear(), both[False].clear()

        for b in batches:
            for mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = both[bool(mark)]
                c.update(tokens_of(text))
                c[b""] += 1
                if len(c) > flush:
                    yield from drain()
        yield from drain()

    rows = df.select(trained.alias("m"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(count, "word binary, t long, n long").groupBy("word").agg(F.sum("t").alias("c_train"), F.sum("n").alias("c_all"))


def count_grams(df: DataFrame, trained: Column, text_col: str, params: CtwParams) -> DataFrame:
    """(key, n, n_all): each gram of the coded texts, how often in trained and in all of them. Blocks are sorted and counted in the workers."""
    depth, size = params.depth, params.block_bytes

    def count(batches):
        import pyarrow as pa

        out = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("n_all", pa.int64())])
        texts = {True: [], False: []}
        held = dict.fromkeys(texts, 0)

        def drain(mark):
            for key, _, _ in text_blocks(texts[mark], depth, size):
                ids, n = np.unique(key, return_counts=True)
                for at in range(0, len(ids), 200_000):
                    part = n[at : at + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 200_000]), pa.array(part * mark), pa.array(part)], schema=out)
            texts[mark].clear()
            held[mark] = 0

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for mark, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    mark = bool(mark)
                    texts[mark].append(text)
                    held[mark] += len(text or "")
                    if held[mark] >= size:
                        yield from drain(mark)
        for mark in texts:
            yield from drain(mark)

    rows = df.select(trained.alias("m"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(count, "key long, n long, n_all long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def gram_costs(seen: DataFrame, depth: int) -> DataFrame:
    """(key, cost) for each (key, n): the tree of the counts n, and minus log10 of each gram's probability in it."""
    steps = seen.select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).select(
        "key", "n",
        F.expr("(key & ~255L) | (1L << j) | ((key & 255L) >> (8 - j))").alias("nk"),
        F.expr("((key & 255L) >> (7 - j)) & 1L").alias("bit"),
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    leaf = steps.groupBy("nk").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    levels = {depth: materialize(leaf.select("nk", "n0", "n1", ln_kt(n0, n1).alias("own")).withColumn("lw", F.col("own")), "level")}
    for d in range(depth - 1, -1, -1):
        up = levels[d + 1].groupBy(F.col("nk").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1)).alias("nk")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("children"))
        up = up.select("nk", "n0", "n1", ln_kt(n0, n1).alias("own"), "children")
        levels[d] = materialize(up.select("nk", "n0", "n1", "own", F.when(n0 + n1 > 0, _ln_mix(F.col("own"), F.col("children"))).otherwise(0.0).alias("lw")), "level")
    kt = (n1 + 0.5) / (n0 + n1 + 1)
    weight = F.exp(F.least(F.col("own") - F.col("lw") - math.log(2), F.lit(0.0)))
    state = levels[0].select("nk", (weight * kt).alias("a"), (1 - weight).alias("r"), kt.alias("p"))
    held: list[DataFrame] = []
    for d in range(1, depth + 1):
        above = state.select(F.col("nk").alias("parent"), "a", "r", "p")
        here = levels[d].withColumn("parent", F.col("nk").bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(above, "parent")
        w = weight if d < depth else F.lit(1.0)
        state = here.select(
            "nk", F.when(n0 + n1 > 0, F.col("a") + F.col("r") * w * kt).otherwise(F.col("a")).alias("a"), F.when(n0 + n1 > 0, F.col("r") * (1 - w)).otherwise(F.col("r")).alias("r"),
            F.when(n0 + n1 > 0, F.col("a") + F.col("r") * kt).otherwise(F.col("p")).alias("p"),
        )
        state = materialize(state, "state")
        discard(levels[d - 1], *held)
        held = [state]
    cost = F.when(F.col("bit") == 1, -F.log10("p")).otherwise(-F.log10(1 - F.col("p")))
    return steps.select("key", "nk", "bit").join(state.select("nk", "p"), "nk").groupBy("key").agg(F.sum(cost).alias("cost"))


def _most(df: DataFrame, count: str, limit: int) -> Column:
    """Whether a row's count is above one that leaves at most `limit` rows; counts meet in 16 classes an octave, a thousand at most."""
    octave = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    left, least = limit, None
    for r in df.groupBy(octave.alias("o")).agg(F.count("*").alias("k")).orderBy(F.desc("o")).limit(1024).collect():
        left -= r.k
        if left < 0:
            break
        least = r.o
    return octave >= least if least is not None else F.lit(False)


def score(df: DataFrame, trained: Column, params: CtwParams = CtwParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: the id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    `trained` marks the rows to learn from. Tokens are the words and one end. base_score is the
    smoothed unigram log10 probability; score is the model's log10 probability of the text. Null and
    empty texts are one end token. Repeated rows are scored each, and train as often as they stand
    there. If nothing is trained, every decision has probability 1/2. The counts of frequent words
    and the costs of frequent grams are held by every worker up to a fixed number; all others are
    met in joins, so that no size changes a result.
    """
    p, spark = params, df.sparkSession
    vocabulary = materialize(count_tokens(df, trained, text_col), "vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("c_train"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c_train") > 0).cast("long")), F.lit(0)).alias("v")).first()
    n, v = total["n"], total["v"]
    seen = materialize(count_grams(df, trained, text_col, p), "grams")
    grams = materialize(gram_costs(seen.select("key", "n"), p.depth).join(seen.select("key", "n_all"), "key"), "costs")
    discard(seen)
    top = grams.where(_most(grams, "n_all", p.most_grams)).select("key", "cost").toArrow()
    held_grams = spark.sparkContext.broadcast(CostTable(top["key"].to_numpy(), top["cost"].to_numpy()))
    del top
    short = vocabulary.where(F.length("word") <= p.head_length)
    head = short.where(_most(short, "c_all", p.head_words)).select("word", "c_train").toArrow()
    held = spark.sparkContext.broadcast((head["word"].combine_chunks(), head["c_train"].to_numpy()))
    del head
    base_of = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    uid = F.monotonically_increasing_id()

    def factory():
        words, counts = held.value
        table, costs = dict(zip(words.to_pylist(), counts.tolist())), held_grams.value

        def of_grams(texts):
            """Log10 probability from the grams held, and the grams that aren't."""
            total, missing = np.zeros(len(texts)), [[] for _ in texts]
            for key, starts, owner in text_blocks(texts, p.depth, p.block_bytes):
                cost, absent = costs.find(key)
                np.subtract.at(total, owner, np.add.reduceat(cost, starts))
                of = owner[np.searchsorted(starts, absent, "right") - 1]
                for i, k in zip(of.tolist(), key[absent].tolist()):
                    missing[i].append(k)
            return total.tolist(), missing

        def f(texts):
            cols = [[] for _ in range(6)]
            for t in texts:
                words = tokens_of(t)
                base, known, rest, left = 0.0, 0, [], []
                found = Counter(words)
                found[b""] = 1  # the end
                for w, k in found.items():
                    if (c := table.get(w)) is None:
                        rest.append(w), left.append(k)
                        continue
                    base += k * logs(c)
                    known += k * (c > 0)
                for c, x in zip(cols, (len(words) + 1, known, base, sum(map(len, words)) + len(words) + 1, rest, left)):
                    c.append(x)
            ctw, missing = of_grams(texts)
            return [*cols, ctw, missing]

        known_logs: dict[int, float] = {}

        def logs(c):
            if (x := known_logs.get(c)) is None:
                x = known_logs[c] = base_of(c)  # as many as there are counts of held words
            return x

        return f

    rows = df.select(F.col(id_col), F.col(text_col)).withColumn("__uid", uid)
    first = materialize(map_texts(rows, factory, "n_tokens long, known long, base double, bytes long, rest array<binary>, left array<long>, ctw double, grams array<long>", id_col, text_col, ("__uid",)), "first")
    pairs = first.where(F.size("rest") > 0).select("__uid", F.explode(F.arrays_zip("rest", "left")).alias("x")).select("__uid", F.col("x.rest").alias("word"), F.col("x.left").alias("k"))
    base = F.log10((F.col("c_train") + 0.1) / F.lit(n + 0.1 * (v + 1)))
    rest = pairs.join(vocabulary.select("word", "c_train"), "word").groupBy("__uid").agg(F.sum(F.col("k") * base).alias("b"), F.sum(F.when(F.col("c_train") > 0, F.col("k")).otherwise(0)).alias("w"))
    far = first.select("__uid", F.explode("grams").alias("key")).join(grams.select("key", "cost"), "key").groupBy("__uid").agg(F.sum(-F.col("cost")).alias("g"))
    out = first.drop("rest", "left", "grams").join(rest, "__uid", "left").join(far, "__uid", "left")
    zero = F.lit(0.0)
    final = F.col("ctw") + F.coalesce("g", zero)
    return out.select(
        id_col, "n_tokens", (F.col("known") + F.coalesce("w", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), final.alias("score"), (-final / math.log10(2) / F.col("bytes")).alias("bits_per_byte"),
    )
