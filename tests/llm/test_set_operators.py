import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import chatrotate, decontam, neardup


def brute_components(rows, k, percent):
    def shingles(t):
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("params", [neardup.NearDupParams(shingle=4), neardup.NearDupParams(shingle=4, block=4, rest_block=2)])
def test_near_duplicates_as_brute_force(spark, params):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(240):
        w = [*base[i % 8 if i % 3 else 0]]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, (" ".join(w).upper() if i % 7 == 0 else " ".join(w)) if i % 11 else rng.choice(["", None, "one two", "One  two"])))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, params).collect()}
    assert got == brute_components(rows, 4, 80)


def test_near_duplicates_of_odd_tables(spark, odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r.kept == (r.component_id == r.doc_id) for r in got if r.doc_id is not None)
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 4 and by[0].n_shingles == by[2].n_shingles == 0 and by[0].kept and by[None].kept
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(11)
    a, b, c = (" ".join(rng.choice("abcdefghijkl") * 2 + str(rng.randrange(99)) for _ in range(50)) for _ in range(3))
    rows = [(5, a), (5, b), (3, a + " end"), (9, b), (9, b), (7, c), (4, "end " + c), (8, None), (8, c)]
    got = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {(5, True): (3, False), (3, True): (3, True), (9, True): (3, False), (7, True): (4, False), (4, True): (4, True), (8, True): (4, False), (8, False): (8, True)}


def test_odd_sketch_estimates(spark):
    p = neardup.NearDupParams()
    sk, rng = neardup.Sketcher(p), np.random.default_rng(1)
    for j in (0.7, 0.8, 0.9, 1.0):
        errors = []
        for _ in range(40):
            n = 600
            both = int(round(2 * n * j / (1 + j)))
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = x[:n], x[n - both :]
            s, t = (np.unpackbits(np.frombuffer(sk.odd_sketch(sk.minhash(np.sort(v))), np.uint8)) for v in (a, b))
            errors.append(neardup.estimate(np.array((s ^ t).sum()), p.bands * p.rows, p.sketch_bits) - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def brute_decontam(docs, items, window):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, of in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= {*range(k, k + len(win))}
                    ids |= of
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [60_000, 3])
def test_decontamination_as_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "MOST_HASHES", most)
    rng, vocab = random.Random(8), ["a", "be", "See", "É", "d4", "x"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(14)), (20, text(30)), (3, "only three words"), (4, None), (5, ""), (6, "ß"), (7, text(10)), (7, text(11)), (8, "five words make one window")]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 40))
        if i % 4 == 0:
            t += " " + (rng.choice(items)[1] or "") + " " + text(rng.randint(0, 8))
        docs.append((i, t))
    docs += [(60, None), (61, ""), (0, docs[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = decontam.find_contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute_decontam(docs, items, 10)
    left = decontam.decontaminate(d, b, most_share=0.99)
    again = decontam.find_contamination(left, b)
    clean = {r.doc_id for r in decontam.find_contamination(d, b).where("not contaminated").collect()}
    assert clean <= {r.doc_id for r in left.collect()} and left.columns == d.columns
    texts = {i: t for i, t in docs}
    assert all(r.text == texts[r.doc_id] for r in left.collect() if r.doc_id in clean)
    assert again.where("n_hit >= 10").count() == 0


def test_long_spans_are_cut_out_by_place(spark):
    items = [(1, " ".join(f"Word{i}" for i in range(25_000)))]
    long = "Start here, " + ", ".join(f"wORD{i}" for i in range(20_000)) + "; and the rest " + " ".join(f"tail{i}" for i in range(30_000)) + "!"
    docs = [(1, long), (2, "\n" + items[0][1]), (3, "a b  c"), (4, "word5-word6 word7 word8 word9/word10 word11 word12 word13 word14 'word15' x y z u v w r s t q p")]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(d, b).collect()}
    assert got == {1: "Start here,  " + long[long.index("; and") :], 3: "a b  c", 4: " ' x y z u v w r s t q p"}
    spans = F.expr("array(named_struct('at', 2, 'len', 2), named_struct('at', 5, 'len', 1))")
    cut = spark.createDataFrame([("-a, b c;d (e) f.",), ("a b c d e",)], "t string").select(decontam.remove_spans(F.col("t"), spans).alias("t")).collect()
    assert [r.t for r in cut] == ["-a,  ;d ( ) f.", "a   d  "]


def test_decontamination_of_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again")], "item_id int, text string")
    got = decontam.find_contamination(odd, items)
    assert got.count() == odd.count() and {r.doc_id for r in got.where("contaminated").collect()} == {4, 5}
    assert decontam.find_contamination(empty, items).count() == 0
    assert decontam.find_contamination(odd, items.limit(0)).where("contaminated").count() == 0
    plan = decontam.find_contamination(odd, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def brute_rotation(rows, turns=64):
    name = lambda r: (r or "").strip(" \t\n\x0b\f\r") or None
    escape = lambda t: t.replace("<|", "<\\|")
    out = []
    for c in {r[0] for r in rows}:
        said = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest()))
        for p in {name(r[2]) for r in said} - {None, "system"}:
            for at in range(0, len(said), turns):
                text, masks = "", []
                for _, _, role, x in said[at : at + turns]:
                    who = name(role)
                    speaker = "assistant" if who == p else "system" if who == "system" else "user:" + escape(who or "unknown").replace("|>", "|\\>")
                    text += f"<|{speaker}|>\n"
                    a = len(text)
                    text += f"{escape(x or '')}<|end|>\n"
                    masks += [(a, len(text))] if who == p else []
                out.append((c, p, at // turns, len(said[at : at + turns]), text, masks))
    return sorted(out, key=repr)


def test_every_participant_is_the_assistant_once(spark):
    rng = random.Random(21)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, 0, None, "ghost"), (3, 1, " ", "y"), (3, None, "eve", "z")]
    rows += [(4, 0, "unknown", "I am <|end|>\n<|system|>"), (4, 1, None, "no <|"), (4, 2, "a<|b", "é😀"), (4, 3, "a|>b", "x|>"), (4, 4, "\t", "tab"), (4, 5, "<|>\n", "y")]
    rows += [(5, rng.choice([None, *range(90)]), rng.choice(["ann", " bob ", None, "system"]), rng.choice(["a", "b", None, ""])) for _ in range(700)] + [(6, 1, "ann", "same")] * 300
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    for params in (chatrotate.ChatParams(), chatrotate.ChatParams(turns=3)):
        got = [(r.conv_id, r.perspective, r.part, r.n_turns, r.text, [(m.a, m.b) for m in r.masks]) for r in chatrotate.rotate(df.repartition(5), params).collect()]
        assert sorted(got, key=repr) == brute_rotation(rows, params.turns)
    assert chatrotate.rotate(df.limit(0)).count() == 0 and chatrotate.rotate(df.withColumns({"perspective": F.lit(1), "of": F.lit(2), "pos": F.lit(3), "part": F.lit("x")})).count() == len(brute_rotation(rows))
    plan = chatrotate.rotate(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("clash", [{}, {"spans": "array(1)", "predicted": "0", "score": "'s'", "__th": "1", "hits": "2", "masked_text": "'m'", "id": "7", "go": "true", "kept": "false", "rows": "3", "Links": "'x'"}])
def test_pipeline_stages(spark, tmp_path, clash):
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    vocab = [word() for _ in range(300)]
    text = lambda n=60: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i, text() + (" moron scum" if i % 4 == 0 else ""), "en", "s", 1) for i in range(80)]
    passage, long = text(40), text(60_000)
    docs += [(100, docs[1][1], "en", "s", 1), (101, docs[1][1] + " end", "en", "s", 1), (102, f"{text()} {passage} {text()}", "en", "s", 1), (103, passage, "en", "s", 1), (104, f'{text()} token = "0123456789abcdefghij" x', "en", "s", 1), (105, None, None, None, None)]
    docs += [(106, "", "en", "s", 0), (107, long, "en", "s", 1), (108, long + " more", "en", "s", 1)] + [(109, text(), "en", "s", 1)] * 2 + [(110, text(), "en", "s", 1), (110, text(), "de", "s", 2), (None, text(), None, None, None), (None, None, None, None, None)]
    made = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.expr(e) for c, e in clash.items()})
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen, rows = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, now, str(tmp_path)).write.parquet(out)
        columns, now = now.columns, spark.read.parquet(out)
        rows[name] = now.collect()
        seen[name] = {r["doc_id"]: r for r in rows[name]}
        assert k + 1 == len(corpus_pipeline.STAGES) or now.columns == columns
        if k + 1 < len(corpus_pipeline.STAGES):
            assert all(r[c] == made.first()[c] for r in rows[name] for c in clash)
    assert {*seen["toxicity"]} == {d[0] for d in docs if d[0] is None or d[0] % 4 or d[0] >= 100}
    assert len(rows["toxicity"]) == len(docs) - 20
    # copies of 1, the longer 108, the second rows of 109 and 110 go; rows without an id stay
    assert {100, 101, 108} & {*seen["near_duplicates"]} == set() and len(rows["near_duplicates"]) == len(rows["toxicity"]) - 5
    assert 103 not in seen["decontamination"] and passage[20:80] not in seen["decontamination"][102].text and seen["decontamination"][1].text == docs[1][1] and seen["decontamination"][107].text == long
    assert "0123456789abcdefghij" not in seen["secrets"][104].text and "[secret]" in seen["secrets"][104].text and seen["secrets"][105].text is None and len(rows["secrets"]) == len(rows["decontamination"])
    assert {*seen["encoding"]} == {*seen["secrets"]} and seen["encoding"][105].n_tokens == 0
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id is not None}
    assert whole == {k: r.ids_sha256 for k, r in seen["encoding"].items() if k is not None}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
