"""Question files, context folders, ZIP archives and JSON-lines artifacts."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of a published table's manifest, which Spark's readers of the table pass over.
MANIFEST = "_manifest"
CONTEXT_SCHEMA = "context_id string, title string, source_url string, passage string"


class InvalidSource(ValueError):
    """A source that does not follow its format."""


def read_questions(spark: SparkSession, path: str, require_answers: bool = False) -> DataFrame:
    """(question_id, question, reference_answer, pos) of a file that holds one object {id: {question, answer?}}; file order in pos.

    Repeated keys, blank ids, missing questions, unknown fields and, where wanted, missing answers are refused.
    """
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())), {"mode": "PERMISSIVE"})
    rows = raw.select(F.posexplode(F.map_entries(entries)).alias("pos", "e")).select("pos", F.trim("e.key").alias("question_id"), F.col("e.value").alias("f"))
    rows = rows.select("question_id", F.col("f")["question"].alias("question"), F.col("f")["answer"].alias("reference_answer"), "pos", F.size(F.array_except(F.map_keys("f"), F.array(F.lit("question"), F.lit("answer")))).alias("unknown"))
    bad = F.when(F.col("question_id") == "", F.lit("blank id")).when(F.trim(F.coalesce("question", F.lit(""))) == "", F.lit("missing question")).when(F.col("unknown") > 0, F.lit("unknown field"))
    if require_answers:
        bad = bad.when(F.trim(F.coalesce("reference_answer", F.lit(""))) == "", F.lit("missing answer"))
    first = rows.withColumn("bad", bad).where("bad is not null").select("bad").first()
    if first or rows.isEmpty() or not rows.groupBy("question_id").count().where("count > 1").isEmpty():
        raise InvalidSource(first[0] if first else "no questions or a repeated id")
    return rows.drop("unknown")


def canonical_id(value: object) -> str:
    """A non-negative integer or a non-blank string as a string; anything else is refused."""
    if isinstance(value, bool) or not isinstance(value, (int, str)) or (isinstance(value, int) and value < 0) or not str(value).strip():
        raise InvalidSource(f"bad id: {value!r}")
    return str(value).strip()


def canonical_id_column(raw: Column) -> Column:
    """The same for a column of raw JSON values; null where refused."""
    text = F.when(raw.startswith('"'), F.trim(F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]))
    return F.when(raw.rlike(r"^\d+$"), raw).when(text != "", text)


def _strict(pairs):
    keys = [k for k, _ in pairs]
    if len({*keys}) != len(keys):
        raise InvalidSource("repeated key")
    return dict(pairs)


def parse_context(data: bytes, name: str) -> tuple[str, str | None, str, str]:
    x = json.loads(data.decode("utf-8"), object_pairs_hook=_strict)
    if not isinstance(x, dict) or not {"id", "link", "passage"} <= x.keys() <= {"id", "name", "link", "passage"}:
        raise InvalidSource(f"{name}: fields {sorted(x) if isinstance(x, dict) else type(x).__name__}")
    title = (x.get("name") or "").strip() or None
    return canonical_id(x["id"]), title, x["link"], x["passage"]


def zip_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Members context_*.json of an archive, by name, read without extraction; unsafe paths, encrypted members and repeated names are refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names: set[str] = set()
        for info in sorted(z.infolist(), key=lambda i: i.filename.rsplit("/", 1)[-1]):
            base = info.filename.rsplit("/", 1)[-1]
            if info.filename.startswith("/") or ".." in info.filename.split("/"):
                raise InvalidSource(f"unsafe path {info.filename}")
            if info.flag_bits & 1:
                raise InvalidSource(f"encrypted member {info.filename}")
            if info.is_dir() or not (base.startswith("context_") and base.endswith(".json")):
                continue
            if base in names:
                raise InvalidSource(f"repeated name {base}")
            names.add(base)
            yield base, z.read(info)


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(context_id, title, source_url, passage) of a folder of context_*.json files or of a ZIP archive; repeated ids are refused."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                members = zip_members(data) if name.lower().endswith(".zip") else [(name, data)]
                rows = [parse_context(d, n) for n, d in members]
                if rows:
                    yield pd.DataFrame(rows, columns=["context_id", "title", "source_url", "passage"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip" if path.lower().endswith(".zip") else "context_*.json").load(path)
    contexts = files.select("path", "content").mapInPandas(run, CONTEXT_SCHEMA)
    if not contexts.groupBy("context_id").count().where("count > 1").isEmpty():
        raise InvalidSource("repeated context id")
    return contexts


def source_revision(files: list[tuple[str, bytes]]) -> str:
    """SHA-256 over length and name, length and bytes of each file in the order of names."""
    h = hashlib.sha256()
    for name, data in sorted(files):
        for x in (name.encode(), data):
            h.update(len(x).to_bytes(8, "big") + x)
    return h.hexdigest()


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of each file: what a load compares before and after."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def to_documents(contexts: DataFrame, dataset: str) -> DataFrame:
    """Contexts as documents; no metadata is inferred."""
    nulls = ["document_number", "document_type", "issuance_date", "effective_date", "expiry_date", "effect_status", "issuing_authority", "legal_field"]
    return contexts.select(F.col("context_id").alias("document_id"), "title", "source_url", F.col("passage").alias("clean_text"), F.lit(dataset).alias("source_dataset"), *[F.lit(None).cast("string").alias(c) for c in nulls])


def _store(spark: SparkSession, path: str):
    """Hadoop's Path constructor and the file system of a path."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of, of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_artifact(df: DataFrame, path: str, fmt: str = "json") -> DataFrame:
    """Publish a table once, never over what exists, with a manifest (records and a checksum of the row digests); gives the manifest.

    Data and manifest are written to a staging folder beside the path, whose renaming is what
    publishes: readers see all of it or nothing, and what a stopped writer left is in no reader's
    and no later writer's way. Of two writers at once the first to rename wins.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    of, fs = _store(spark, path)
    if fs.exists(of(path)):
        raise InvalidSource(f"{path} exists already")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.format(fmt).save(staging)
    manifest = artifact_manifest(spark.read.schema(df.schema).format(fmt).load(staging))
    manifest.coalesce(1).write.json(f"{staging}/{MANIFEST}")
    if fs.exists(of(path)) or not fs.rename(of(staging), of(path)):
        fs.delete(of(staging), True)
        raise InvalidSource(f"{path} exists already")
    if fs.exists(inside := of(path, of(staging).getName())):  # another one was first, and a folder moves into the one that is there
        fs.delete(inside, True)
        raise InvalidSource(f"{path} exists already")
    return spark.read.schema("records long, checksum string").json(f"{path}/{MANIFEST}")


def discard_staging(spark: SparkSession, path: str) -> int:
    """Delete what stopped writers of `path` left; gives how many. Only while none is at work."""
    of, fs = _store(spark, path)
    left = fs.globStatus(of(f"{path.rstrip('/')}.staging-*")) or []
    for x in left:
        fs.delete(x.getPath(), True)
    return len(left)


def artifact_manifest(df: DataFrame) -> DataFrame:
    """(records, checksum): the checksum is a sum of row digests, so that it doesn't hang on the order or on one task."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("records"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("checksum"))


def read_artifact(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Read with a fixed schema; refused if records or checksum differ from the manifest."""
    df = spark.read.schema(schema).format(fmt).load(path)
    want = spark.read.schema("records long, checksum string").json(f"{path.rstrip('/')}/{MANIFEST}").first()
    have = artifact_manifest(df).first()
    if (want.records, want.checksum) != (have.records, have.checksum):
        raise InvalidSource(f"{path}: {have.records} records, not as in its manifest")
    return df


def submission_zip(answers: DataFrame, questions: DataFrame) -> bytes:
    """{id: {answer}} in the order of the questions, as one deterministic archive; ids must be the same."""
    ordered = questions.select("question_id", "pos").join(answers.select("question_id", "answer"), "question_id", "full").orderBy("pos").toLocalIterator()
    out: dict[str, dict[str, str]] = {}
    for r in ordered:
        if r.pos is None or r.answer is None:
            raise InvalidSource(f"{r.question_id}: answered and asked ids differ")
        out[r.question_id] = {"answer": r.answer}
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("results.json", (1980, 1, 1, 0, 0, 0)), json.dumps(out, ensure_ascii=False, indent=2))
    return buf.getvalue()


def read_benchmark(spark: SparkSession, path: str, schema: str, manifest: str | None = None) -> DataFrame:
    """Evaluation cases of a JSON-lines file with `file_sha256`; refused if empty, if a line or an id is bad, or if bytes, number or kinds differ from the manifest.

    schema names the cases' columns, case_id and target_granularity among them. The manifest is one
    object with benchmark_sha256, case_count and target_granularities.
    """
    file = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("file_sha256"))
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("c")).select("c.*")
    cases = parsed.crossJoin(F.broadcast(file))  # one row
    counts = cases.agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("ids"), F.array_sort(F.collect_set("target_granularity")).alias("kinds"), F.first("file_sha256").alias("sha")).first()
    if not counts.n or counts.ids != counts.n:
        raise InvalidSource(f"{path}: empty, or a bad or repeated case")
    if manifest is not None:
        want = spark.read.text(manifest, wholetext=True).select(F.from_json("value", "benchmark_sha256 string, case_count long, target_granularities array<string>").alias("m")).select("m.*").first()
        if want is None or (want.benchmark_sha256, want.case_count, sorted(want.target_granularities or [])) != (counts.sha, counts.n, counts.kinds):
            raise InvalidSource(f"{path} doesn't match its manifest")
    return cases
