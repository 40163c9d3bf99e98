"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

Each chunk of a text starts as a linked list of characters; the adjacent pair whose joined string is
the best-ranked piece is popped from a heap and merged until none is left. The count is the initial
symbols less the merges, where a character that is no piece counts as its UTF-8 bytes.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from textquarry.llm.common import map_texts, trim

#: Runs between spaces, and parts of them, that a worker's tables keep; their longest length there.
RUN_ENTRIES, CACHE_ENTRIES, CACHE_LENGTH = 400_000, 400_000, 48
_LOADED: dict[str, PieceCounter] = {}  # a worker's later tasks find its tables filled
SPACE = "▁"


class PieceCounter:
    """count(text): the tokens of a text under a sentencepiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model_file: str):
        import re

        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece goes on after white space: chunks can't be counted apart")
        letter = r"[^\W\d_]"
        # no merge crosses between a letter and a character that is beside a letter in no piece
        beside = {c for p in self.rank for m in re.finditer(rf"(?=({letter}[\W\d_]|[\W\d_]{letter}))", p) for c in m[1]}
        marks = "".join(re.escape(c) for c in map(chr, range(128)) if not c.isalpha() and c not in beside and c != " ")
        self.parts = re.compile(rf"(?<={letter})(?=[{marks}])|(?<=[{marks}])(?={letter})" if marks else "(?!)").split
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.cache: dict[str, int] = {}
        self.runs: dict[str, int] = {}

    def merge_count(self, chunk: str) -> int:
        rank, n = self.rank, len(chunk)
        total = sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in chunk)
        if n < 2:
            return total
        left, right = [*range(-1, n - 1)], [*range(1, n), -1]
        symbol: list[str | None] = [*chunk]
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := chunk[i : i + 2]) in rank]
        heapify(heap)
        while heap:
            _, i, piece = heappop(heap)
            j = right[i]
            if symbol[i] is None or j < 0 or symbol[i] + symbol[j] != piece:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = piece, None
            total -= 1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (p := piece + symbol[k]) in rank:
                    heappush(heap, (rank[p], i, p))
            if (h := left[i]) >= 0 and (p := symbol[h] + piece) in rank:
                heappush(heap, (rank[p], h, p))
        return total

    def _count_parts(self, chunk: str) -> int:
        total, cache = 0, self.cache
        for part in self.parts(chunk):
            n = cache.get(part)
            if n is None:
                n = self.merge_count(part)
                if len(part) <= CACHE_LENGTH:
                    cache[part] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """No piece goes on after white space, so that each run between spaces is counted apart and kept."""
        if not text:
            return 0
        line = text.replace(SPACE, " ")
        if "  " in line or line[0] == " " or line[-1] == " ":
            chunks = self.chunks(SPACE + line.replace(" ", SPACE))
        else:
            chunks = [SPACE + x for x in line.split(" ")]
        runs = self.runs
        if new := [x for x in {*chunks} if x not in runs]:
            fresh = {x: self._count_parts(x) for x in new}
            total = sum([fresh[c] if c in fresh else runs[c] for c in chunks])
            runs.update((k, v) for k, v in fresh.items() if len(k) <= CACHE_LENGTH)
            trim(runs, RUN_ENTRIES)
            trim(self.cache, CACHE_ENTRIES)
            return total
        return sum(map(runs.__getitem__, chunks))


def count_tokens(df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as the empty text (0 tokens). Special strings inside a text are ordinary
    text. Very long chunks are merged in O(n log n). Equal ranks merge from the left. An empty
    table gives an empty table; repeated rows are counted each; other columns are not read.
    """

    def factory():
        counter = _LOADED.get(model_file) or _LOADED.setdefault(model_file, PieceCounter(model_file))

        def f(texts):
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            counts = [counter.count(t or "") for t in texts]
            return [sizes, counts, [n > limit for n in counts]]

        return f

    return map_texts(df, factory, "n_bytes long, n_tokens long, over_limit boolean", id_col, text_col, extra)
