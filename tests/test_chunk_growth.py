"""Chunking that counts a text once, and a census that reads the chunks once."""

import random
import re

from textquarry.operators import chunking, diagnostics
from textquarry.operators.parsing import document_blocks

TOKEN = re.compile(r"\w+|[^\w\s]")


def windows_by_hand(text, most, overlap):
    spans, out, at = [m.span() for m in TOKEN.finditer(text)], [], 0
    while at < len(spans):
        own = spans[at : at + most]
        out.append(text[own[0][0] : own[-1][1]])
        if at + most >= len(spans):
            break
        at += most - overlap
    return out


def test_counts_and_windows_equal_those_of_single_tokens():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("ab_é ́1.,; \n\t𝒳\x1c​") for _ in range(rng.randrange(400)))
        assert chunking.count_tokens(text) == len(TOKEN.findall(text))
        for most, overlap in ((384, 50), (64, 0), (3, 2), (1, 0)):
            assert chunking.split_tokens(text, most, overlap) == windows_by_hand(text, most, overlap)


def test_chunks_are_those_of_a_counter_of_whole_texts():
    rng = random.Random(6)
    lines = ["Điều {}. Tên", "1. khoản {} abc", "a) điểm {}", "Chương II", "chữ, thường; {} !!", "x | y | {}", "PHẦN I", "Điều {}", "một hai ba bốn năm {}"]
    whole = lambda text: len(TOKEN.findall(text))  # noqa: E731 - another counter, which is asked for whole texts
    for k in range(60):
        blocks = document_blocks(str(k), "\n".join(rng.choice(lines).format(rng.randrange(30)) for _ in range(rng.randrange(1, 80))))
        for p in (chunking.ChunkParams(), chunking.ChunkParams(20, 30, 3), chunking.ChunkParams(4, 9, 1)):
            assert chunking.chunk_document(str(k), "tựa", blocks, p) == chunking.chunk_document(str(k), "tựa", blocks, p, whole)


def test_a_block_is_counted_once(monkeypatch):
    seen = []
    count = chunking.count_tokens

    def counted(text):
        seen.append(text)
        return count(text)

    monkeypatch.setattr(chunking, "count_tokens", counted)
    text = "Điều 1. Tên\n" + "\n".join(f"{i}. khoản dài {i} " + "chữ " * 50 for i in range(1, 40))
    made = chunking.chunk_document("d", None, document_blocks("d", text), count=counted)
    assert len(made) > 3 and max(seen.count(x) for x in seen if "khoản dài" in x) == 1


def test_census_reads_the_chunks_once_and_shuffles_no_text(spark):
    docs = spark.createDataFrame([(1, "Điều 1. Tên\nmột hai"), (2, "Điều 1. Tên\nmột hai"), (3, "chữ " * 900), (4, None)], "i int, t string")
    census = diagnostics.chunk_census(chunking.chunk_documents(docs, "i", "t"))
    assert census._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.strategy: r for r in census.collect()}
    assert (got["article"].chunks, got["article"].repeated, got["article"].with_article) == (2, 1, 2)
    assert got["token_fallback"].chunks == 3 and abs(sum(r.share for r in got.values()) - 1) < 1e-12
