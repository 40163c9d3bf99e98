"""Byte-level BPE through a sentencepiece model that is written directly from a rank vocabulary.

Method: every byte string of the vocabulary becomes a piece of printable characters, one for each
byte, scored by its negative rank, in a BPE model with identity normalisation; texts are cut by the
pre-token pattern, each pre-token is encoded as its byte characters, and ids decode by the inverse
mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textquarry.llm.common import kept, map_texts, trim

#: Pre-tokens, and runs between single spaces, that a worker's tables keep; their longest length there.
CACHE_ENTRIES, RUN_ENTRIES, CACHE_LENGTH = 125_000, 200_000, 48
#: Characters of the texts that are encoded in one call; bounds the memory of a worker, not what is encoded.
TOGETHER = 1 << 18
#: Stands between pre-tokens and is no character of a byte, so that nothing is merged across it.
MARK = "\u2400"


def byte_characters() -> list[str]:
    """A distinct character for each byte that is neither white space nor a control: itself if printable, else 256 and up."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, x: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(x)) + x


def serialise_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The model's protobuf bytes, and the rank of each model id (-1: unknown)."""
    chars = byte_characters()
    order = sorted(ranks.items(), key=lambda x: x[1])
    pieces = [_bytes(1, _bytes(1, "<unknown piece>".encode()) + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))]
    for raw, rank in order:
        pieces.append(_bytes(1, _bytes(1, "".join(chars[b] for b in raw).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _bytes(1, b"identity") + _bytes(2, b"") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser), [-1, *(rank for _, rank in order)]


class ByteBPE:
    """encode(text) -> ids, encode_all(texts) -> their ids, decode(ids) -> bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        model, rank_of = serialise_model(ranks)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.rank_of = np.array(rank_of, np.int32)
        self.raw = {rank: raw for raw, rank in ranks.items()}
        every = range(max(self.raw, default=-1) + 1)
        self.raw_at = pa.array(map(self.raw.get, every), pa.large_binary())
        self.shown_at = pa.array(map(str, every), pa.large_binary())
        self.table = dict(enumerate(byte_characters()))
        self.marked_table = {**self.table, 0: MARK}
        # whether all bytes are entries, and the encoder gives every entry as that entry
        spelled = [raw.decode("latin-1").translate(self.table) for raw in ranks]
        self.whole = all(bytes([i]) in ranks for i in range(256)) and [rank_of[i[0]] if len(i) == 1 else -1 for i in self.sp.encode(spelled, num_threads=1)] == [*ranks.values()]
        self.cache: dict[str, bytes] = {}  # ids as _packed gives them
        self.runs: dict[str, bytes] = {}
        probe = ["a", "1", ".", "'s", "\n", "\t.", "é1", "x\n"]
        self.spaced = all(self.find(z + x + " " + y) == self.find(z + x) + self.find(" " + y) for z in ("", " ") for x in probe for y in probe if not (x[-1].isspace() and y[0].isspace()))
        self.space_runs = regex.compile(r"\s \s|^ | $").search
        blank = regex.compile(r"\s").match
        self.before_space = [(c, c + " ") for c in map(chr, range(0x3001)) if c.isspace() or blank(c)]  # no white space is above U+3000

    def _packed(self, found: list[list[int]], marked: bool = False) -> list[bytes]:
        """Lists of model ids as ranks of four bytes each, without the ids of marks."""
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        if not marked and not ids.all():
            raise ValueError("the vocabulary lacks a byte of the text")
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        keep = ids != 0
        ends = np.concatenate(([0], np.cumsum(keep)))[ends] * 4 if len(ids) else ends
        packed, ends = self.rank_of[ids[keep]].tobytes(), ends.tolist()
        return [packed[i:j] for i, j in zip([0, *ends], ends)]

    def _add(self, new: list[str]) -> dict[str, bytes]:
        found, rest = {}, []
        for x in new:
            raw = x.encode("utf-8", "surrogatepass")
            if raw in self.ranks:
                found[x] = self.ranks[raw].to_bytes(4, sys.byteorder)
            else:
                rest.append((x, raw.decode("latin-1").translate(self.table)))
        if rest:
            found.update(zip([x for x, _ in rest], self._packed(self.sp.encode([m for _, m in rest], num_threads=1))))
        return found

    def _has_space_runs(self, text: str) -> bool:
        """As the pattern says, which is slow and looked at only if white space stands before a space or a space at an end."""
        may = text.startswith(" ") or text.endswith((" ", " \n")) or any(c in text and pair in text for c, pair in self.before_space)
        return may and self.space_runs(text) is not None

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """The ids of each run with the space before it: all are searched, and spelled for the encoder, as one string, unless they do not fall apart at the spaces."""
        joined = " ".join(runs)
        if self.whole and "\0" not in joined and not self._has_space_runs(joined):
            marked = "\0".join(self.find(" " + joined)).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.marked_table)
            spelled = marked.replace(MARK + self.table[32], "\n" + self.table[32]).split("\n")
            if len(spelled) == len(runs):
                return self._packed(self.sp.encode(spelled, num_threads=1), marked=True)
        cuts = [self.find(" " + x) for x in runs]
        known = self._add([*{*chain.from_iterable(cuts)}])
        return [b"".join(map(known.__getitem__, ws)) for ws in cuts]

    def encode_all(self, texts: list[str]) -> pa.LargeListArray:
        """The ids of each text; what was not kept before is encoded in one call for all.

        A single space before another character starts a pre-token, so that runs between single spaces are encoded apart and kept.
        """
        cache, runs = self.cache, self.runs
        plain = [self.spaced and not self._has_space_runs(t) for t in texts]
        try:
            split = pc.split_pattern(pa.array([t if p else "" for t, p in zip(texts, plain)], pa.large_string()), " ")
        except UnicodeEncodeError:  # halves of surrogate pairs
            plain = [False] * len(texts)
            split = pc.split_pattern(pa.array([""] * len(texts), pa.large_string()), " ")
        first, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        is_run = np.zeros(len(distinct), bool)
        is_run[np.delete(codes, first[:-1])] = True
        distinct = [*compress(distinct, is_run.tolist())]
        heads = [self.find(t[: t.find(" ")] if p and " " in t else t) for t, p in zip(texts, plain)]
        words, new = [*{*chain.from_iterable(heads)}.difference(cache)], [x for x in distinct if x not in runs]
        cache.update(self._add(words))
        runs.update(zip(new, self._encode_runs(new) if new else ()))
        # each distinct run, then the head of each text, and their places in the texts
        parts = [*map(runs.__getitem__, distinct), *(b"".join(map(cache.__getitem__, h)) for h in heads)]
        codes = (np.cumsum(is_run) - 1)[codes]
        codes[first[:-1]] = np.arange(len(distinct), len(parts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        taken, begin = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        ends = np.cumsum(taken)
        ids = np.frombuffer(b"".join(parts), np.int32)[np.repeat(begin - ends + taken, taken) + np.arange(taken.sum())]
        for table, added, limit in ((cache, words, CACHE_ENTRIES), (runs, new, RUN_ENTRIES)):
            for x in added:
                if len(x) > CACHE_LENGTH:
                    del table[x]
            trim(table, limit)
        return pa.LargeListArray.from_arrays(np.concatenate(([0], ends))[first], ids)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].as_py()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def joined(self, ids: pa.LargeListArray, of: pa.Array, by: str | bytes) -> list[bytes]:
        """For each list of ids, what `of` has at them, joined."""
        return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, of.take(ids.values)), pa.scalar(by, of.type)).to_pylist()


def together(texts: list[str | None]) -> Iterator[list[str]]:
    """All texts in their order, null as empty, in lists that end with the text that brings them to TOGETHER characters."""
    some, size = [], 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: the id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the bytes that the ids
    decode to. A null text counts as the empty text: no ids, and the digests of nothing. White
    space, very long runs and invalid sequences are ordinary bytes. An empty table gives an empty
    table; repeated rows are encoded each; other columns are not read.
    `vocabulary` is the path of a rank file that every worker can read.
    """

    key = ("byte BPE", vocabulary, pattern)

    def factory():
        bpe = kept(key, lambda: ByteBPE(read_ranks(vocabulary), pattern))  # a worker's later tasks find its tables filled
        sha = hashlib.sha256

        def f(texts):
            n, a, b, every = [], [], [], []
            for ids in map(bpe.encode_all, together(texts)):
                n.append(ids.value_lengths())
                a += [sha(x).hexdigest() for x in bpe.joined(ids, bpe.shown_at, b" ")]
                b += [sha(x).hexdigest() for x in bpe.joined(ids, bpe.raw_at, b"")]
                if with_ids:
                    every.append(ids)
            n, every = pa.concat_arrays(n), pa.concat_arrays(every) if with_ids else None
            return [n, a, b, every][: 3 + with_ids]

        return f

    return map_texts(df, factory, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, id_col, text_col, extra, keeps=key)
