import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from textquarry.llm import bytebpe

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(VOCABULARY)


def test_new_words_of_many_texts_are_encoded_in_one_call(monkeypatch, ranks):
    rng, made, calls = random.Random(8), {}, []
    monkeypatch.setattr(bytebpe, "map_texts", lambda df, factory, *a, **k: made.update(f=factory))
    bytebpe.encode_texts(None, VOCABULARY, PATTERN, with_ids=False)
    f, encode = made["f"](), sentencepiece.SentencePieceProcessor.encode
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda self, x, **k: calls.append(len(x)) or encode(self, x, **k))
    texts = [" ".join("".join(rng.choice("bcdfghaeé,") for _ in range(8)) for _ in range(40)) for _ in range(400)]
    n, ids, decoded = f([*texts, None])[:3]
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [lib.encode_ordinary(t) for t in [*texts, ""]]
    assert np.asarray(n).tolist() == [*map(len, want)]
    assert ids == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in want]
    assert decoded == [hashlib.sha256(t.encode()).hexdigest() for t in [*texts, ""]]
    assert len(calls) <= 4  # one a text before


def test_texts_together_are_encoded_as_alone(ranks):
    lib, rng = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), random.Random(9)
    bits = ["a", "the", "Le", " ", " ", " ", "  ", "\n", "\t", "é", "🙂", "'s", "1", ".", "\0", "␀", "\xff", "\x1c", "　", "日本", "<|endoftext|>", "x" * 60]
    bpe = bytebpe.ByteBPE(ranks, PATTERN)
    assert bpe.whole and bpe.spaced
    for k in range(300):
        few = bits if k % 3 else [x for x in bits if x == " " or not x.isspace() and x != "\0"]  # the last also without what keeps runs from being joined
        texts = ["".join(rng.choice(few) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 12))]
        got = bpe.encode_all(texts)
        assert got.to_pylist() == [lib.encode_ordinary(t) for t in texts]
        assert bpe.joined(got, bpe.raw_at, b"") == [t.encode() for t in texts]
    assert max(map(len, [*bpe.runs, *bpe.cache])) <= bytebpe.CACHE_LENGTH
    assert [x for t in bytebpe.together(["a" * (bytebpe.TOGETHER + 1), None, "b"]) for x in t] == ["a" * (bytebpe.TOGETHER + 1), "", "b"]


def test_halves_of_surrogate_pairs_and_missing_entries(ranks):
    bpe = bytebpe.ByteBPE(ranks, PATTERN)
    assert bpe.decode(bpe.encode("a b \ud800 c")) == "a b \ud800 c".encode("utf-8", "surrogatepass")
    fewer = {k: v for k, v in ranks.items() if k != b"q"}
    short = bytebpe.ByteBPE(fewer, PATTERN)
    assert not short.whole and short.encode("a the house") == bpe.encode("a the house")
    with pytest.raises(ValueError):
        short.encode("a xqx")
