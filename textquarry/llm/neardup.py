"""Near-duplicate components by MinHash bands, odd sketches and exact verification.

1. Each text becomes its set of word shingles (64-bit hashes), a digest of the set, MinHash bands
   and an odd sketch: its MinHash samples folded into a parity bitmap.
2. Texts with equal sets are one class, represented by the smallest id.
3. Representatives that share a band value form a bucket; each bucket names its smallest id as
   centre, and the members of all buckets of a centre form a group.
4. Groups are compared block by block (operators/groups.py): the population count of the XOR of two odd
   sketches estimates their similarity, and pairs that may reach the threshold are verified on
   their full sets, unless links found before already join them.
5. Components of the links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import kept, map_texts, trim
from textquarry.operators.groups import centred, group_components, linker
from textquarry.operators.joins import hot_join
from textquarry.operators.setjoin import shingled
from textquarry.session import discard, materialize

WORD_ENTRIES = 400_000  #: hashes of words, kept for a worker's later tasks
WORDS = "hashes of words"


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5  #: words
    percent: int = 80  #: least similarity: 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 5  #: with 32 bands, a pair at 0.8 shares none with probability 3e-6
    sketch_bits: int = 1024
    sketch_slack: float = 0.2  #: an estimate so far below the threshold rules a pair out; five standard deviations
    block: int = 128
    rest_block: int = 256  #: larger across blocks: members are repeated once for each block they meet


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII spaces only


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if shorter; empty without words."""
    import xxhash

    words = _words(text) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    known = kept(WORDS, dict)
    for w in {*words}.difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    a = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    trim(known, WORD_ENTRIES)
    return shingled(a, k)


class Sketcher:
    def __init__(self, p: NearDupParams):
        rng = np.random.default_rng(20240607)
        self.p, self.k = p, p.bands * p.rows
        self.a = (rng.integers(0, 1 << 63, self.k, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
        self.mix = rng.integers(0, 1 << 63, (1, p.rows), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.band = rng.integers(0, 1 << 63, p.bands, dtype=np.uint64)
        self.sample = rng.integers(0, 1 << 63, self.k, dtype=np.uint64)

    def minhash(self, s: np.ndarray) -> np.ndarray:
        out = np.full(self.k, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 1024):
            np.minimum(out, (self.a * s[None, at : at + 1024]).min(1), out=out)
        return out

    def bands_of(self, m: np.ndarray) -> np.ndarray:
        x = ((m.reshape(self.p.bands, self.p.rows) ^ (m.reshape(self.p.bands, self.p.rows) >> np.uint64(31))) * self.mix).sum(1, dtype=np.uint64) ^ self.band
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return (x ^ (x >> np.uint64(33))).view(np.int64)

    def odd_sketch(self, m: np.ndarray) -> bytes:
        x = (m ^ self.sample) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        at = (x >> np.uint64(40)) % np.uint64(self.p.sketch_bits)
        return np.packbits((np.bincount(at.astype(np.int64), minlength=self.p.sketch_bits) & 1).astype(np.uint8)).tobytes()


def estimate(xor_count: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches of k samples each."""
    return 1 + bits / (4 * k) * np.log(np.maximum(1 - 2 * xor_count / bits, 1e-9))


def signatures(df: DataFrame, p: NearDupParams, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    def factory():
        import xxhash

        sk = Sketcher(p)

        def f(texts):
            n, digest, bands, sketch = [], [], [], []
            for t in texts:
                s = shingle_set(t, p.shingle)
                n.append(len(s))
                if not len(s):
                    digest.append(None), bands.append(None), sketch.append(None)
                    continue
                m = sk.minhash(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(sk.bands_of(m))
                sketch.append(sk.odd_sketch(m))
            return [n, digest, bands, sketch]

        return f

    return map_texts(df, factory, "n_shingles long, digest binary, bands array<long>, sketch binary", id_col, text_col, extra, keeps=WORDS)


def _candidates(p: NearDupParams):
    """Pairs of a block whose sketches may reach the threshold, by their estimates."""
    k = p.bands * p.rows
    least = p.percent / 100 - p.sketch_slack

    def found(pdf: pd.DataFrame, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1), axis=1).astype(np.float32)
        ones = bits.sum(1)
        est = estimate(ones[:, None] + ones[None, :] - 2 * bits @ bits.T, k, p.sketch_bits)
        i, j = np.nonzero(np.triu(est >= least, 1) & (probe[:, None] | probe[None, :]))
        order = np.argsort(-est[i, j], kind="stable")
        return i[order], j[order]

    return found


def near_duplicates(df: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: the id, n_shingles, component_id (smallest id reachable over links, itself included), kept.

    Texts without words, and null texts, have no shingles, link with nothing and are kept. Rows that
    repeat an id are one document: of one text they are the same row twice, and if their texts
    differ, what one of them links with is linked with the others. A null id is its own component
    and kept. Ties can't occur: the smallest id stands for a class and a component. An empty table
    gives an empty one.
    """
    p = params
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    sig = materialize(signatures(named, p, "id", "text", ("th",)), "sig")
    known = sig.where("digest is not null and id is not null")
    rep = F.min(F.struct("id", "th"))
    classes = known.groupBy("digest").agg(rep.alias("r"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select("digest", F.col("r.id").alias("rep"), F.col("r.th").alias("th"), "bands", "sketch"), "classes")
    found = materialize(centred(classes.select(F.explode("bands").alias("key"), "rep")), "members")
    several = known.groupBy("id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi").select("id")
    same = known.select("id", "digest").join(several, "id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    sketches = classes.select(F.col("rep").alias("id"), "th", "sketch")
    link = linker(_candidates(p), lambda text: shingle_set(text, p.shingle), p.percent)
    labels = group_components(found, sketches, named.where("id is not null and text is not null"), same, link, p.block, p.rest_block)
    discard(found)

    placed = classes.select("digest", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("of_class"))
    out = hot_join(sig.select("id", "n_shingles", "digest"), materialize(placed, "placed"), "digest", "left")
    component = F.coalesce("of_class", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
