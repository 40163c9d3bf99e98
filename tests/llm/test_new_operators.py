"""The source audit, vector codes and the n-gram join, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import divergence, gramjoin, neardup, vectorcode


def brute_audit(rows, p):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows, every term and pair one by one."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    docs, counts, groups = {}, {}, sorted({r[:2] for r in rows})
    for lang, source, text in rows:
        docs.setdefault(lang, Counter()).update({*terms(text)})
        counts.setdefault((lang, source), Counter()).update(terms(text))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= p.min_docs]
        v, whole = len(kept), sum((counts[g] for g in groups if g[0] == lang), Counter())
        share = lambda c, kept=kept, v=v: {t: 1 + p.scale * (c[t] + p.prior) // (sum(c[k] for k in kept) + p.prior * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        x, y = share(counts[lang, source]), share(whole)
        pairs = [(sum(f(x[t], z[t]) for t in kept), s) for g, s in groups if g == lang and s != source for z in [share(counts[lang, s])]]
        lifted = [(f(x[t], y[t]), t) for t in kept if counts[lang, source][t] and x[t] > y[t]]
        for part, found in (("pair", pairs), ("term", lifted)):
            found.sort(key=lambda z: (-z[0], z[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < p.top_terms]
    return sorted(out)


def test_source_audit_as_brute_force(spark):
    rng = random.Random(3)
    words = ["Haus", "éa", "ÄB", "abc", "x1y", "don't", "日本", "zz", "Q", "İi", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(rng.choice(["de", "fr", None, ""]), rng.choice(["s1", "s2", "é", None, "s3"]), " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 30)))) for _ in range(400)]
    rows += [("de", "s9", None), ("de", "s8", ""), ("xx", "alone", "one two"), ("yy", "a", "few words"), ("yy", "b", "here"), ("de", "s1", "rare " * 50)] + [("de", "s1", "same text")] * 12
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("n", "a", "b", "term", "at", "rank")})
    for p in (divergence.DivergenceParams(), divergence.DivergenceParams(min_docs=3, top_terms=4, held=20)):
        got = [tuple(r) for r in divergence.audit_sources(df.repartition(5), p).collect()]
        assert sorted(got) == brute_audit(rows, p)
    assert divergence.audit_sources(df.limit(0)).count() == 0
    assert [tuple(r) for r in divergence.audit_sources(df.where("lang = 'yy'")).orderBy("source").collect()] == [("yy", "a", "pair", "b", 0, 1), ("yy", "b", "pair", "a", 0, 1)]


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_STRETCH", 7)
    text = "one TWO three-four éé" + "x" * 30 + " five" * 5
    assert [t for part in divergence.stretches(text.encode()) for t in part] == [b"one", b"two", b"three", b"four", "éé".encode() + b"x" * 30] + [b"five"] * 5
    assert [*divergence.stretches(b"")] == []


def test_joint_histograms_hold_every_kept_term(spark):
    rng = random.Random(5)
    kept = [("l", f"t{i}", sorted((s, rng.randint(1, 4)) for s in rng.sample("abcde", rng.randint(1, 5)))) for i in range(60)]
    df = spark.createDataFrame([(lang, t, sum(n for _, n in at), at) for lang, t, at in kept], "lang string, term string, n long, at array<struct<source:string,n:long>>")
    sizes = spark.createDataFrame([("l", s, len(kept)) for s in "abcdef"], "lang string, source string, v long")
    got = {tuple(r)[1:5]: r.m for r in divergence.joint_histograms(df, sizes).collect() if r.m}
    want = Counter((a, b, dict(at).get(a, 0), dict(at).get(b, 0)) for a in "abcdef" for b in "abcdef" if a < b for _, _, at in kept)
    assert got == want


def brute_codes(x, parts, entries, rounds):
    """Codes, errors and codebooks of whole vectors (n, width), in the order of ids, every distance worked out."""
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        at = d.argmin(2)
        if r < rounds:
            for j in range(parts):
                for k in range(books.shape[1]):
                    if len(own := x[at[:, j] == k, j]):
                        books[j, k] = own.sum(0) // len(own)
    return at, d.min(2).sum(1), books


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_vector_codes_as_a_full_search(spark, kind):
    rng, p = np.random.default_rng(7), vectorcode.CodeParams(parts=4, entries=12, rounds=3)
    n = 5 if kind == "few" else 700
    v = rng.integers(-2, 3, (n, 8)) / 256 if kind == "ties" else rng.normal(0, 0.3, (n, 8))
    rows = [(i, [float(np.float32(c)) for c in v[i]], None if i % 7 == 0 else i % 3) for i in range(n)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [1.0, None] + [0.0] * 6, 1), (1003, [math.nan] * 8, 1), (1004, [math.inf] * 8, 1), (1005, [1.0] * 4, 1), (1006, [0.5] * 6, 1), (1007, [-0.001] * 8, 2), (1008, [1e30] * 8, 2), (None, [0.1] * 8, 0), (3, rows[3][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id int, embedding array<float>, label int").withColumns({c: F.lit("c") for c in ("code", "error", "id", "x", "key")})
    coded, books = vectorcode.encode_vectors(df.repartition(6), p)
    kept = sorted((r for r in rows + odd if r[1] and len(r[1]) == 8 and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[min(max(math.floor(256 * float(np.float32(c))), -(1 << 26)), 1 << 26) for c in r[1]] for r in kept], np.int64)
    at, error, want = brute_codes(x, 4, 12, 3)
    assert (books == want).all()
    by_label = Counter()
    for r, e in zip(kept, error.tolist()):
        by_label[r[2]] += e
    got = sorted((repr(r.vec_id), bytes(r.code), r.error, r.label, r.label_error) for r in coded.collect())
    assert got == sorted((repr(r[0]), bytes(a.tolist()), e, r[2], by_label[r[2]]) for r, a, e in zip(kept, at, error.tolist()))


def test_vector_codes_of_empty_tables_and_pruning(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = vectorcode.encode_vectors(df)
    assert coded.count() == 0 and coded.columns == ["vec_id", "label", "code", "error", "label_error"] and vectorcode.books_digest(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    rng = np.random.default_rng(1)
    x, books = rng.integers(-300, 300, (2000, 4)), rng.integers(-300, 300, (64, 4))
    at, best, upper, done = vectorcode.Elkan(books, None).assign(x, np.zeros(2000, np.int64), np.full(2000, np.inf, np.float32), lower := np.zeros((2000, 64), np.float32))
    full = vectorcode.squared(x[:, None], books[None])
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all()
    assert (lower.astype(np.float64) <= np.sqrt(full)).all() and (upper.astype(np.float64) >= np.sqrt(best)).all()
    moved = books + rng.integers(-3, 4, books.shape)
    again = vectorcode.Elkan(moved, books).assign(x, at, upper, lower)
    full = vectorcode.squared(x[:, None], moved[None])
    assert (again[0] == full.argmin(1)).all() and (lower.astype(np.float64) <= np.sqrt(full)).all() and again[3] < 2000 * 8  # of 64 entries


def brute_join(texts, k, percent):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) for t in texts]
    sets = [{tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in words]
    root = [*range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("k, percent", [(3, 90), (2, 80), (5, 95), (3, 100)])
def test_gram_join_as_brute_force(spark, k, percent):
    rng, texts = random.Random(k * percent), [None, "", " \n", "a", "A", "a b", "one two three", "One  two\tthree"]
    vocab = [f"v{i}" for i in range(60)]
    for _ in range(30):
        base = rng.choices(vocab, k=rng.choice([4, 9, 12, 14, 30, 80, 200, 500]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(base) // 40), max(1, len(base) // 20)])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 1))
                copy = copy or ["x"]
            texts.append(" ".join(copy))
    texts += [" ".join(f"g{i}" for i in range(40) if i != j) for j in range(50)]  # a group of several blocks
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id int, text string, point string, cells int")
    p = gramjoin.GramJoinParams(shingle=k, percent=percent, block=16, rest_block=16)
    sizes, root = brute_join(texts, k, percent)
    assert [tuple(r) for r in gramjoin.join_components(df.repartition(5), p).orderBy("doc_id").collect()] == list(zip(range(len(texts)), sizes, root))


def test_gram_join_of_odd_tables(spark, odd, empty):
    got = gramjoin.join_components(odd, gramjoin.GramJoinParams(shingle=3, percent=90)).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id == 4} == {4} and [r.component_id for r in got if r.doc_id == 5] == [4]
    assert gramjoin.join_components(empty).count() == 0
    rows = [(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t"), (3, "a b c d e f g h i j"), (3, "k l m n o p q r s t")]
    got = gramjoin.join_components(spark.createDataFrame(rows, "doc_id long, text string"), gramjoin.GramJoinParams(shingle=3)).collect()
    assert [r.component_id for r in got] == [1] * 4


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linking_sets_share_a_cell(percent):
    rng = np.random.default_rng(percent)
    sections = gramjoin.Sections(gramjoin.GramJoinParams(percent=percent))
    for _ in range(400):
        n = int(rng.choice([1, 4, 9, 10, 11, 13, 14, 19, 20, 40, 100, 450, 3000]))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 8 + 2))
        b = np.r_[a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 2)), dtype=np.uint64)]
        both = len(np.intersect1d(a, b))
        x, y = np.unique(a), np.unique(b)
        if len(y) and (x.shape != y.shape or (x != y).any()) and 100 * both >= percent * (len(x) + len(y) - both):
            assert len(np.intersect1d(sections.cells(x), sections.cells(y))), (n, gone)


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 8, 9, 64, 65, 300):
        counts = rng.poisson(rng.choice([1.0, 4.0], (n, 1)), (n, 16)).astype(np.int64)
        if n > 10:
            counts[n // 2 :] = counts[: n - n // 2] + (rng.random((n - n // 2, 16)) < 0.04)
        i, j, bound = gramjoin.CountTree(counts, 90, 4).pairs() if n else (np.zeros(0), np.zeros(0), None)
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
        sizes = counts.sum(1)
        want = {(a, b) for a in range(n) for b in range(a + 1, n) if 190 * np.minimum(counts[a], counts[b]).sum() >= 90 * (sizes[a] + sizes[b]) and 100 * min(sizes[a], sizes[b]) >= 90 * max(sizes[a], sizes[b])}
        assert got == want and len(got) == len(i)


def test_both_joins_find_the_same(spark):
    rng, vocab = random.Random(4), [f"w{i}" for i in range(500)]
    base = [rng.choices(vocab, k=60) for _ in range(40)]
    texts = [" ".join(rng.choice(vocab) if rng.random() < 0.01 else w for w in rng.choice(base)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    a = gramjoin.join_components(df, gramjoin.GramJoinParams(shingle=3, percent=80)).select("doc_id", "n_shingles", "component_id").collect()
    b = neardup.near_duplicates(df, neardup.NearDupParams(shingle=3, percent=80)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(a) == sorted(b)
