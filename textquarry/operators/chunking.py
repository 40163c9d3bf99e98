"""Token-budgeted chunks of parsed documents."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textquarry.operators.parsing import STRUCTURE, document_blocks

_token = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class ChunkParams:
    max_tokens: int = 384
    max_search_tokens: int = 448
    overlap: int = 50


@cache
def _run(most: int, least: int = 0) -> re.Pattern:
    """From `least` up to `most` tokens in a row, with the white space before each."""
    return re.compile(rf"(?>\s*+(?:\w++|[^\w\s])){{{least},{most}}}+")


def count_tokens(text: str) -> int:
    """Tokens are counted 64 at a time, and the rest one by one."""
    n, at, many = 0, 0, _run(64, 64)
    while found := many.match(text, at):
        n, at = n + 64, found.end()
    return n + len(_token.findall(text, at))


def split_tokens(text: str, most: int, overlap: int) -> list[str]:
    """Windows of at most `most` tokens, `overlap` shared with the one before; pieces of the text itself."""
    out, first = [], _token.search(text)
    while first:
        end = _run(most).match(text, first.start()).end()
        out.append(text[first.start() : end])
        if not _token.search(text, end):
            break
        first = _token.search(text, _run(most - overlap).match(text, first.start()).end())
    return out


def split_exact(text: str, most: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    """The same under a model's own count of a piece, which may differ from the number of tokens here: each window is the longest that fits.

    A single token beyond `most` is refused. `count` must not fall as a piece grows.
    """
    spans = [m.span() for m in _token.finditer(text)]
    if not spans:
        return []
    if count(text) <= most:
        return [text.strip()]
    out, at = [], 0
    while True:
        size = lambda end: count(text[spans[at][0] : spans[end - 1][1]])  # noqa: B023, E731 - used in this round only
        end = at + bisect_right(range(at + 1, len(spans) + 1), most, key=size)
        if end == at:
            raise ValueError("one token exceeds the model's window")
        out.append(text[spans[at][0] : spans[end - 1][1]])
        if end == len(spans):
            return out
        at = max(at + 1, end - overlap)


def chunk_id(document_id: str, strategy: str, ids: list[str], split: int, text: str) -> str:
    return "chunk_" + hashlib.sha256("\0".join([document_id, strategy, *ids, str(split), text]).encode("utf-8", "surrogatepass")).hexdigest()[:24]


def _joined(blocks) -> str:
    return "\n".join(b["text"] for b in blocks)


def merged_structure(blocks: list[dict]) -> dict:
    """Levels of the first block inside an article (else of the first), with all clause and point numbers; the path ends in them if there is one each."""
    base = next((b["structure"] for b in blocks if b["structure"]["article_number"] is not None), blocks[0]["structure"])
    numbers = {k: [*dict.fromkeys(n for b in blocks for n in b["structure"][k])] for k in ("clause_numbers", "point_numbers")}
    path = [x for x in base["structure_path"] if not x.lower().startswith(("khoản ", "điểm "))]
    for k, label in (("clause_numbers", "Khoản"), ("point_numbers", "Điểm")):
        if len(numbers[k]) == 1:
            path.append(f"{label} {numbers[k][0]}")
    return {**base, **numbers, "structure_path": path}


def search_text(title: str | None, structure: dict, text: str, most: int, count: Callable[[str], int] = count_tokens, tokens: int | None = None) -> str:
    """Headers, taken from the most specific to the least while the budget holds, then the text, which has `tokens` if they are known."""
    heads = [f"Văn bản: {title}"] if title else []
    heads += [structure[k] for k in ("part", "chapter", "section", "subsection") if structure[k]]
    if structure["article_number"]:
        heads.append(f"Điều {structure['article_number']}" + (f": {structure['article_title']}" if structure["article_title"] else ""))
    heads += [f"{label}: {', '.join(structure[k])}" for k, label in (("clause_numbers", "Khoản"), ("point_numbers", "Điểm")) if structure[k]]
    body, kept, used = f"Nội dung:\n{text}", [], 0
    used = count(body) if tokens is None or count is not count_tokens else count(body[: -len(text) or None]) + tokens  # no token goes over a line's end
    for h in reversed(heads):
        if used + count(h) <= most:
            kept.append(h)
            used += count(h)
    return "\n".join([*reversed(kept), body])


HEADS = ("part", "chapter", "section", "subsection")


def _units(blocks: Iterable[dict]) -> Iterator[list[dict]]:
    """A block with all below it if it is an article, else alone, as they come: what lies below an article follows it."""
    unit: list[dict] = []
    held: set[str] = set()
    for b in blocks:
        if unit and unit[0]["block_type"] == "article" and b["parent_block_id"] in held:
            unit.append(b)
            held.add(b["block_id"])
            continue
        if unit:
            yield unit
        unit, held = [b], {b["block_id"]}
    if unit:
        yield unit


def _article_parts(unit: list[dict], heads: list[dict]) -> list[list[dict]]:
    """The article's own block behind its headings, with its first child; then each other child with all below it."""
    parts: list[list[dict]] = [[*heads, unit[0]]]
    for b in unit[1:]:
        if b["parent_block_id"] == unit[0]["block_id"]:
            parts.append([])
        parts[-1].append(b)
    return [parts[0] + parts[1], *parts[2:]] if len(parts) > 1 else parts


def chunk_stream(document_id: str, title: str | None, blocks: Iterable[dict], p: ChunkParams = ChunkParams(), count: Callable[[str], int] = count_tokens) -> Iterator[dict]:
    """The chunks of a document whose blocks come in order: no more than an article and the headings before it is held.

    An article with all below it is one chunk if it fits, else its parts are packed in order; headings
    wait for the unit that follows them. Tokens here don't go over a line's end, so that each block is
    counted once; a model's own count is asked for the whole text each time.
    """
    counts: dict[str, int] = {}

    def size(unit: list[dict], text: str | None = None) -> int:
        if count is not count_tokens:
            return count(_joined(unit) if text is None else text)
        for b in unit:
            if b["block_id"] not in counts:
                counts[b["block_id"]] = count(b["text"])
        return sum(counts[b["block_id"]] for b in unit)

    def windows(unit):
        pieces = split_tokens(_joined(unit), p.max_tokens, p.overlap)
        return [("token_fallback", unit, t, k, len(pieces)) for k, t in enumerate(pieces)]

    fits = lambda unit: size(unit) <= p.max_tokens
    whole = lambda strategy, unit: [(strategy, unit, _joined(unit), 0, 1)]

    def article(unit, heads):
        if fits([*heads, *unit]):
            yield from whole("article", [*heads, *unit])
            return
        pack: list[dict] = []
        for part in _article_parts(unit, heads):
            if fits(part) and (not pack or fits(pack + part)):
                pack = pack + part
                continue
            if pack:
                yield from whole("clause_group", pack)
            pack = part if fits(part) else []
            if not pack:
                yield from windows(part)
        if pack:
            yield from whole("clause_group", pack)

    def drafts():
        heads: list[dict] = []
        for unit in _units(blocks):
            if unit[0]["block_type"] in HEADS:
                heads = [*heads, *unit]
                continue
            if unit[0]["block_type"] == "article":
                yield from article(unit, heads)
            else:
                yield from whole("standalone_block", [*heads, *unit]) if fits([*heads, *unit]) else windows([*heads, *unit])
            heads = []
        if heads:
            yield from whole("standalone_block", heads) if fits(heads) else windows(heads)

    for k, (strategy, unit, text, split, splits) in enumerate(drafts()):
        structure = merged_structure(unit)
        ids = [b["block_id"] for b in unit]
        if strategy != "token_fallback":
            tokens = size(unit, text)
        else:
            tokens = p.max_tokens if split < splits - 1 and count is count_tokens else count(text)  # windows but the last are full
        for i in ids if split == splits - 1 else ():  # what is chunked isn't asked for again
            counts.pop(i, None)
        yield {
            "chunk_id": chunk_id(document_id, strategy, ids, split, text), "document_id": document_id, "chunk_index": k, "text": text, "search_text": search_text(title, structure, text, p.max_search_tokens, count, tokens),
            "token_count": tokens, "strategy": strategy, "split_index": split, "split_count": splits, "source_block_ids": ids, "structure": structure,
        }


def chunk_document(document_id: str, title: str | None, blocks: list[dict], p: ChunkParams = ChunkParams(), count: Callable[[str], int] = count_tokens) -> list[dict]:
    return [*chunk_stream(document_id, title, blocks, p, count)]


CHUNK_SCHEMA = f"chunk_id string, document_id string, chunk_index int, text string, search_text string, token_count int, strategy string, split_index int, split_count int, source_block_ids array<string>, structure struct<{STRUCTURE.replace(' string', ':string').replace(' array', ':array')}>"


def chunk_documents(df: DataFrame, id_col: str, text_col: str, title_col: str | None = None, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Parse and chunk in one pass over the documents, without a shuffle."""

    schema = to_arrow_schema(T._parse_datatype_string(CHUNK_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = [c for r in batch.slice(at, 200).to_pylist() if r["t"] for c in chunk_document(r["i"], r["title"], document_blocks(r["i"], r["t"]), params)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    title = F.col(title_col).cast("string") if title_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), title.alias("title")).mapInArrow(run, CHUNK_SCHEMA)


def chunk_blocks(blocks: DataFrame, documents: DataFrame, params: ChunkParams = ChunkParams(), most: int = 512) -> DataFrame:
    """The chunks of stored blocks and their documents(document_id, title): the same as of one pass over the texts.

    Both sides come to a document's task sorted, the title before the blocks, and are merged as Arrow
    batches pass by: of a document of any size an article is held, and `most` chunks. Blocks of
    unknown documents are chunked without a title; documents without blocks have no chunk; of
    several titles of a document the first by order counts.
    """
    columns = [f.name for f in blocks.schema.fields]
    titles = documents.select(F.col("document_id").cast("string").alias("document_id"), F.lit(-1).alias("order_index"), F.col("title").cast("string").alias("title"))
    both = blocks.withColumn("document_id", F.col("document_id").cast("string")).withColumn("__block", F.lit(True)).unionByName(titles.withColumnRenamed("title", "__title"), allowMissingColumns=True)
    both = both.where("document_id is not null").repartition("document_id").sortWithinPartitions("document_id", "order_index", F.asc_nulls_last("__title"))

    schema = to_arrow_schema(T._parse_datatype_string(CHUNK_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby, islice

        rows = (r for batch in batches for r in batch.to_pylist())
        for document, found in groupby(rows, lambda r: r["document_id"]):
            first = next(found)
            title = None if first["__block"] else first["__title"]
            own = ({c: r[c] for c in columns} for part in ([first], found) for r in part if r["__block"])
            made = chunk_stream(document, title, own, params)
            while some := [*islice(made, most)]:
                yield pa.RecordBatch.from_pylist(some, schema)

    return both.mapInArrow(run, CHUNK_SCHEMA)


def chunk_problems(documents: DataFrame, blocks: DataFrame, chunks: DataFrame, params: ChunkParams = ChunkParams(), min_tokens: int = 1, inherited: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, problem, ref) over documents(document_id), blocks and chunks: ids, budgets, texts, sources, order, coverage.

    `inherited` are columns that chunks take from their documents; null equals null. Counts are taken
    from the texts again by the Arrow counter that chunking uses.
    """
    own = chunks.withColumn("__t", _counts(F.col("text"))).withColumn("__s", _counts(F.col("search_text")))
    say = lambda rows, problem, ref: rows.select("document_id", F.lit(problem).alias("problem"), F.col(ref).cast("string").alias("ref"))
    ids = F.coalesce("source_block_ids", F.array().cast("array<string>"))
    sources = chunks.select("chunk_id", "document_id", F.posexplode(ids).alias("pos", "block_id"))
    held = sources.join(blocks.select("block_id", F.col("document_id").alias("__of"), F.col("text").alias("__text")), "block_id", "left")
    whole = held.groupBy("chunk_id").agg(F.every(F.col("__of").isNotNull()).alias("__known"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__text"))), lambda x: F.coalesce(x["__text"], F.lit(""))), "\n").alias("__joined"))
    texts = chunks.join(whole, "chunk_id").where("__known")
    splits = texts.where("strategy = 'token_fallback'").groupBy("document_id", "source_block_ids").agg(
        F.min("chunk_id").alias("chunk_id"), F.first("__joined").alias("__joined"), F.array_sort(F.collect_list(F.struct("split_index", "text"))).alias("__pieces"), F.min("split_count").alias("__lo"), F.max("split_count").alias("__hi")
    )
    pieces = _windows_of(params.max_tokens, params.overlap)(F.col("__joined"))
    split_bad = (F.transform("__pieces", lambda x: x["text"]) != pieces) | (F.transform("__pieces", lambda x: x["split_index"]) != F.sequence(F.lit(0), F.size("__pieces") - 1)) | (F.col("__lo") != F.size("__pieces")) | (F.col("__hi") != F.size("__pieces"))
    out = [
        say(chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id")).where("n > 1"), "duplicate_chunk_id", "chunk_id"),
        say(chunks.join(documents.select("document_id"), "document_id", "left_anti"), "unknown_document", "chunk_id"),
        say(chunks.where(F.coalesce(F.trim("text"), F.lit("")) == ""), "empty_text", "chunk_id"),
        say(own.where("token_count <> __t"), "token_count_mismatch", "chunk_id"),
        say(chunks.where(F.col("token_count") > params.max_tokens), "over_budget", "chunk_id"),
        say(chunks.where(F.col("token_count") < min_tokens), "below_minimum", "chunk_id"),
        say(own.where(F.col("__s") > params.max_search_tokens), "search_text_over_budget", "chunk_id"),
        say(chunks.where(~F.col("search_text").endswith(F.col("text"))), "text_not_in_search_text", "chunk_id"),
        say(chunks.where(F.size(ids) == 0), "missing_source_blocks", "chunk_id"),
        say(held.where("__of is null"), "unknown_block", "block_id"),
        say(held.where("__of <> document_id"), "foreign_block", "block_id"),
        say(texts.where("strategy <> 'token_fallback' and text <> __joined"), "text_differs_from_blocks", "chunk_id"),
        say(splits.where(split_bad), "windows_differ_from_blocks", "chunk_id"),
        say(chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("m"), F.countDistinct("chunk_index").alias("d"), F.lit(None).cast("string").alias("r")).where("m + 1 <> n or d <> n"), "index_gap", "r"),
        say(blocks.join(sources.select("block_id"), "block_id", "left_anti"), "uncovered_block", "block_id"),
        say(documents.join(chunks, "document_id", "left_anti").join(blocks.select("document_id"), "document_id", "left_semi").withColumn("r", F.lit(None).cast("string")), "no_chunks", "r"),
    ]
    if inherited:
        of = documents.select("document_id", *[F.col(c).alias(f"__{c}") for c in inherited])
        differs = F.lit(False)
        for c in inherited:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        out.append(say(chunks.join(of, "document_id").where(differs), "metadata_differs", "chunk_id"))
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found


@F.pandas_udf(T.IntegerType())
def _counts(s: pd.Series) -> pd.Series:
    return s.map(count_tokens, na_action="ignore").astype("Int32")


def _windows_of(most: int, overlap: int):
    @F.pandas_udf("array<string>")
    def windows(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_tokens(t or "", most, overlap))

    return windows


def block_problems(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, problem): repeated ids, unknown documents, gaps in the order, parents that don't come before."""
    parents = blocks.select(F.col("block_id").alias("p"), F.col("order_index").alias("po"), F.col("document_id").alias("pd"))
    late = blocks.where("parent_block_id is not null").join(parents, F.col("parent_block_id") == F.col("p"), "left").where("po is null or po >= order_index or pd <> document_id")
    return (
        blocks.groupBy("block_id").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id")).where("n > 1").select("document_id", F.lit("duplicate_block_id").alias("problem"))
        .union(blocks.join(documents, "document_id", "left_anti").select("document_id", F.lit("unknown_document")))
        .union(late.select("document_id", F.lit("parent_not_before")))
        .union(blocks.groupBy("document_id").agg((F.max("order_index") + 1 != F.count("*")).alias("gap")).where("gap").select("document_id", F.lit("order_gap")))
    )
