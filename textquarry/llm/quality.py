"""Quality rules by distribution divergence.

A language's references are the histograms of its character classes and of its common words over
all its documents. A document's histograms are held against each reference by Jensen-Shannon
distance; it is rejected if it is far from every language, or repeats itself. Short texts are not
judged by words.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_texts

CLASSES = ["space", "line", "lower", "upper", "digit", "letter", "point", "symbol", "other"]
WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    common_share: float = 0.002  #: a word this frequent in a language is common; at most 1/share words a language
    language_words: int = 5_000  #: words that make a stable histogram, ten of the least common word; languages with fewer give no reference and their texts no distances
    max_class_distance: float = 0.2
    max_word_distance: float = 0.335
    min_chars: int = 40  #: below, classes are not judged
    min_words: int = 100  #: below, words are not judged


def _class_table() -> bytes:
    """A class number for each Latin-1 code; used on texts whose other code points are folded first."""
    out = bytearray()
    for b in range(256):
        c = chr(b)
        out.append(
            0 if c in " \t" else 1 if c in "\n\r\x0b\x0c" else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if c.isdigit() and b < 128
            else 5 if c.isalpha() else 6 if c in ".,;:!?'\"()-" else 7 if c in SYMBOLS or (32 < b < 127) else 8
        )
    return bytes(out)


CLASS_OF = _class_table()
not_latin = re.compile(r"[^\x00-\xff]").sub


def class_counts(text: str) -> np.ndarray:
    latin = text.encode("latin-1", "ignore") if text.isascii() else not_latin(lambda m: "\xe0" if m[0].isalpha() else "\x80", text).encode("latin-1")
    return np.bincount(np.frombuffer(latin.translate(CLASS_OF), np.uint8), minlength=len(CLASSES)).astype(float)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1; 1 if either histogram is empty."""
    if p.sum() <= 0 or q.sum() <= 0:
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0)))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # exactly the six ASCII white-space bytes
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 4:
        windows = [*zip(words, words[1:], words[2:])]
        if len({*windows}) < n - 2:
            counts, to = Counter(windows), 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(i, to)
                    to = i + 3
    return n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeat


def word_key(word: bytes) -> bytes:
    """The word; beyond 64 bytes its beginning and a hash of the whole, so that long words stay apart."""
    return word if len(word) <= 64 else word[:64] + hashlib.blake2b(word, digest_size=16).digest()


def language_references(df: DataFrame, lang_col: str = "lang", text_col: str = "text", params: QualityParams = QualityParams()) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """lang -> class histogram, slot of each common word, word histogram (last slot: other words), over all documents.

    Words are counted in the workers, combined before the shuffle and summed by (lang, word). Only
    words above `common_share` of a language of `language_words` or more come to the driver: at most
    1/common_share words a language, however small its part of the table.
    """

    def count(batches):
        import pyarrow as pa

        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def flush(everything=False):
            for la in [*words]:
                if everything or len(words[la]) > 150_000:
                    c = words.pop(la)
                    yield pa.RecordBatch.from_pydict({"lang": [la] * len(c), "word": [*c], "n": [*c.values()]}, out)

        out = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for la, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(la, Counter()).update(w if len(w) <= 64 else word_key(w) for w in t.lower().encode("utf-8", "surrogatepass").split())
                classes[la] = classes.get(la, 0) + class_counts(t)
            yield from flush()
        yield from flush(True)
        for la, c in classes.items():  # class totals as words that hold white space
            yield pa.RecordBatch.from_pydict({"lang": [la] * len(c), "word": [f" {i}".encode() for i in range(len(c))], "n": [int(x) for x in c]}, out)

    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    counts = rows.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    from textquarry.session import materialize

    counts = materialize(counts, "words")
    is_class = F.substring("word", 1, 1) == F.lit(b" ")
    totals = counts.where(~is_class).groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= params.language_words).collect()
    kept = {r.lang: r["n"] for r in sorted(totals, key=lambda r: (-r["n"], r.lang))}
    if not kept:
        return {}
    totals = df.sparkSession.createDataFrame([*kept.items()], "lang string, total long")
    common = counts.join(F.broadcast(totals), "lang").where(is_class | (F.col("n") >= params.common_share * F.col("total")))
    refs: dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]] = {}
    found: dict[str, list[tuple[bytes, int]]] = {}
    for r in common.select("lang", "word", "n").collect():
        found.setdefault(r.lang, []).append((bytes(r.word), r["n"]))
    for la, n in kept.items():
        mine = sorted(found[la])
        classes = np.array([next((k for w, k in mine if w == f" {i}".encode()), 0) for i in range(len(CLASSES))], float)
        words = [(w, k) for w, k in mine if w[:1] != b" "]
        histogram = np.array([k for _, k in words] + [n - sum(k for _, k in words)], float)
        refs[la] = classes, {w: i for i, (w, _) in enumerate(words)}, histogram
    return refs


def judge(df: DataFrame, references: dict, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), lang_col: str = "lang") -> DataFrame:
    """One row for each row of df: the id, the base counts, base_failed, class_distance, word_distance, kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept is
    false if base_failed, else whether the distances to the nearest reference are within the
    limits. A null text has no words. A distance that the length guards leave out is null, as with
    no reference at all or none of the text's language (where df names one), and then doesn't reject.
    Whole texts are counted.
    """
    held = df.sparkSession.sparkContext.broadcast((references, params))

    def factory():
        refs, p = held.value

        def one(t):
            n, chars, symbols, dup, repeat = base_counts(t)
            failed = n < 50 or 100 * repeat > 50 * n
            dc = dw = None
            if t and refs:
                if len(t) >= p.min_chars:
                    c = class_counts(t)
                    dc = min(js_distance(c, r[0]) for r in refs.values())
                if n >= p.min_words:
                    counts = Counter(w if len(w) <= 64 else word_key(w) for w in t.lower().encode("utf-8", "surrogatepass").split())
                    best = 1.0
                    for _, slots, ref in refs.values():
                        h = np.zeros(len(slots) + 1)
                        for w in counts.keys() & slots.keys():
                            h[slots[w]] = counts[w]
                        h[-1] = n - h.sum()
                        best = min(best, js_distance(h, ref))
                    dw = best
            kept = not failed and (dc is None or dc <= p.max_class_distance) and (dw is None or dw <= p.max_word_distance)
            return n, chars, symbols, dup, repeat, failed, dc, dw, kept

        return lambda texts: [*zip(*map(one, texts))]

    named = F.col(lang_col).cast("string") if lang_col in df.columns else F.lit(None).cast("string")
    out = map_texts(df.withColumn("__lang", named), factory, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean", id_col, text_col, (*extra, "__lang"))
    strange = F.col("__lang").isNotNull() & ~F.col("__lang").isin([*references]) if references else F.lit(False)
    return out.withColumns({
        "kept": F.when(strange, ~F.col("base_failed")).otherwise(F.col("kept")),
        "class_distance": F.when(~strange, F.col("class_distance")), "word_distance": F.when(~strange, F.col("word_distance")),
    }).drop("__lang")
