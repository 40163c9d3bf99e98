"""Failures that must not look like results, and results that no cap may cut."""

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textquarry import catalog, catalog_plans  # noqa: F401
from textquarry.operators import dataset
from textquarry.plans import agent, retrieval


def test_a_failed_job_is_no_outcome_of_its_queries(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, asked string")
    torn = agent.Tool("torn", "asked string", "n int", lambda d: d.select("query_id", F.raise_error(F.lit("disk")).cast("int").alias("n")))
    lost = agent.Tool("lost", "asked string", "n int", lambda d: open("/nowhere/at/all"))
    for strict in (False, True):
        tools = agent.Registry([torn, lost], strict)
        with pytest.raises(PySparkException):
            tools.invoke("torn", rows).collect()
        with pytest.raises(OSError):
            tools.invoke("lost", rows)


def test_a_strict_registry_raises_what_would_pass_for_an_abstention(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "query_id int, asked string")
    one = F.lit(1).alias("n")

    def crash(_):
        raise KeyError("x")

    def refuse(_):
        raise agent.ToolFailure("external_service_error")

    tools = agent.Registry([
        agent.Tool("crash", "", "n int", crash), agent.Tool("wrong", "", "n int", lambda d: d.select("query_id", F.lit("x").alias("n"))), agent.Tool("few", "", "n int", lambda d: d.where("query_id = 1").select("query_id", one)),
        agent.Tool("slow", "", "n int", lambda d: d.select("query_id", one), timeout_seconds=0.0), agent.Tool("good", "asked string", "n int", lambda d: d.select("query_id", one, F.when(F.col("query_id") == 2, F.lit("model_error")).alias("error"))), agent.Tool("refuse", "", "n int", refuse),
    ], strict=True)
    for name in ("crash", "wrong", "few", "slow", "absent"):
        with pytest.raises((KeyError, agent.ToolFailure)):
            tools.invoke(name, rows, "n int")
    assert {r.query_id: r.error for r in tools.invoke("good", rows).collect()} == {1: None, 2: "model_error", 3: "invalid_input"}
    assert {r.error for r in tools.invoke("refuse", rows).collect()} == {"external_service_error"}


def test_answers_over_a_broken_search_fail(spark, monkeypatch):
    def broken(*_):
        raise ValueError("no index")

    monkeypatch.setattr(retrieval, "search", broken)
    with pytest.raises(ValueError, match="no index"):
        catalog.queries()["agent_answers"](spark, "/root/testdata/sf0.001").collect()


def groups_by_hand(docs, threshold=0.92):
    import re

    norms = {i: re.sub(r"[\W_]+", " ", (t or "").lower()).strip() for i, t in docs}
    sets = {i: {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {n} for i, n in norms.items() for w in [n.split(" ")]}
    root = {i: i for i in norms}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in norms:
        for b in norms:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in norms}


def test_groups_hold_all_near_duplicates_of_any_number_and_length(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    base, long = [*rng.choice(words, 60)], [*rng.choice(words, 700)]
    docs = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(260)]  # each anchor is in more than 200 texts
    docs += [(1000 + i, " ".join(f"odd{i}" if k % 160 == 80 else w for k, w in enumerate(long))) for i in range(4)]  # twelve shingles of one text only
    docs += [(2000 + i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(1, 40, 60))]
    docs += [(3000 + i, " ".join([*base[:k], "x", *base[k + 1 :]])) for i, k in enumerate((0, 5, 20, 30, 58))]
    docs += [(4000, None), (4001, ""), (4002, " . "), (4003, "a b"), (4004, "A, b!"), (4005, "a b c")]
    got = {r.id: r.group_id for r in dataset.duplicate_groups(spark.createDataFrame(docs, "id long, t string"), "id", "t").collect()}
    assert got == groups_by_hand(docs) and {got[i] for i in range(260)} == {0} and {got[1000 + i] for i in range(4)} == {1000} and got[4002] == 4000


def test_groups_at_the_threshold_itself(spark):
    # 25 and 50 shingles of which 2 and 4 differ: 23 of 25, at 0.92; and one less
    whole = [f"u{k}" for k in range(27)]
    docs = [(1, " ".join(whole)), (2, " ".join(whole[2:])), (3, " ".join(whole[3:])), (None, "x y z"), (4, "x y z")]
    df = spark.createDataFrame(docs, "id long, t string")
    assert {r.id: r.group_id for r in dataset.duplicate_groups(df, "id", "t").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, None: None}
    assert {r.id: r.group_id for r in dataset.duplicate_groups(df.where("id <> 2"), "id", "t").collect()} == {1: 1, 3: 3, 4: 4}
    assert {r.id: r.group_id for r in dataset.duplicate_groups(df, "id", "t", 0.925).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, None: None}


def test_the_sql_of_groups_has_no_cap():
    sql = catalog.oracle_sql()["duplicate_groups"]
    assert "<= 200" not in sql and "r <= 8" not in sql
    db = duckdb.connect()
    base = " ".join(f"b{k}" for k in range(59))
    db.execute("CREATE TABLE documents AS SELECT i AS doc_id, ? || ' end' || i AS text FROM range(201) t(i)", [base])
    assert db.execute(f"SELECT count(DISTINCT group_id) FROM ({sql})").fetchone() == (1,)


def test_classes_of_shingles_are_freed_one_after_the_other(spark):
    import os

    (folder,) = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}
    words = [f"w{k}" for k in range(50)]
    docs = [(i, " ".join([*words[i % 7 :], *words[: i % 7], "end" * (i % 2)])) for i in range(40)] + [(90, "a b"), (91, "c")]
    df = spark.createDataFrame(docs, "id long, t string")
    norm = df.select(dataset.normalise_question(F.col("t")).alias("norm")).distinct()
    parts = norm.select(dataset._shingles(F.col("norm")).alias("all"), *[dataset._shingles(F.col("norm"), k).alias(f"k{k}") for k in range(dataset.ROUNDS)]).collect()
    assert all(sorted(r["all"]) == sorted(s for k in range(dataset.ROUNDS) for s in r[f"k{k}"]) for r in parts)
    before = files()
    pairs = dataset.near_pairs(df, "id", "t")
    assert files() <= before and pairs.count() > 0 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
