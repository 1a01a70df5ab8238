"""Sources: document graphs, raw documents, corrections, vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schemas
from factloom.lineage import cut

# Ids that name no document, for folders and for the commands.
GENERIC_IDS = ("", "unknown", "cli_input", "doc_001")
COMMAND_GENERIC_IDS = ("", "unknown", "cli_input")


@dataclass(frozen=True)
class Bundle:
    """documents, facts and deps of a folder, and the files that could not be read."""

    documents: DataFrame
    facts: DataFrame
    deps: DataFrame
    errors: DataFrame


def read_graphs(spark: SparkSession, folder: str, pattern: str = "*.json", matter_field: str = "matter", max_source_text: int = 0, generic_ids: tuple[str, ...] = GENERIC_IDS) -> Bundle:
    """A folder of JSON graphs in order of file name.

    A generic or colliding id falls back to the file's stem; a single party becomes a list. A file
    that is no JSON, lacks its lists or has another major version is an error, not a failure: each
    file is in documents or in errors, whichever columns a plan reads, since every column comes from
    one reading of the file's text with one schema.
    """
    schema = schemas.DOCUMENT if matter_field == "matter" else schemas.DOCUMENT.replace("matter string", f"`{matter_field}` string")
    texts = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("content").cast("string").alias("value"), F.col("_metadata.file_name").alias("file_name"))
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    raw = texts.select("file_name", (F.trim("value") == "").alias("_empty"), parsed.alias("j")).select("file_name", "_empty", "j.*").withColumnRenamed(matter_field, "matter")
    major = F.split(F.coalesce("schema_version", F.lit("1")), r"\.")[0]
    broken = F.col("_corrupt").isNotNull() | F.col("_empty")
    bad = broken | F.col("facts").isNull() | F.col("dependencies").isNull() | (major != "1")
    raw = raw.withColumn("error", F.when(broken, "not JSON").when(major != "1", "unknown schema version").when(bad, "facts or dependencies are missing"))
    errors = raw.where(F.col("error").isNotNull()).select("file_name", "error").union(_empty_files(spark, folder, pattern))
    # Ids and places come from names alone, so no text is shuffled for them.
    names = raw.where(F.col("error").isNull()).select("file_name", F.coalesce("document_id", F.lit("")).alias("given"))
    repeated = names.groupBy("given").agg(F.count("*").alias("n")).where("n > 1")
    named = names.join(repeated, "given", "left").select(
        F.col("file_name").alias("_name"),
        F.when(F.col("given").isin(*generic_ids) | F.col("n").isNotNull(), F.regexp_replace("file_name", r"\.[^.]*$", "")).otherwise(F.col("given")).alias("doc_id"),
        F.row_number().over(Window.orderBy("file_name")).alias("doc_pos"),
    )
    good = raw.where(F.col("error").isNull()).join(named, F.col("file_name") == F.col("_name")).drop("_name")
    listed = F.when(F.trim("parties").startswith("["), F.from_json("parties", "array<string>")).when(F.col("parties").isNotNull(), F.array("parties"))
    good = good.withColumn("parties", listed)
    text = F.coalesce("source_text", F.lit(""))
    documents = good.select(
        "doc_id", "doc_pos", F.coalesce("document_type", F.lit("legal")).alias("document_type"),
        (F.substring(text, 1, max_source_text) if max_source_text else text).alias("source_text"), F.nullif(F.trim("matter"), F.lit("")).alias("matter"),
        F.filter(F.coalesce("parties", F.array().cast("array<string>")), lambda p: F.trim(p) != "").alias("parties"), F.col("source_text_sha256").alias("source_sha256"), "file_name",
    )
    facts = good.select("doc_id", F.posexplode("facts").alias("fact_pos", "f")).select(
        "doc_id", "fact_pos", F.col("f.id").alias("fact_id"), "f.entity", "f.role", "f.value", F.coalesce("f.raw_text", F.lit("")).alias("raw_text"),
        F.coalesce("f.timex_type", F.lit("DATE")).alias("timex_type"), F.coalesce("f.sentence", F.lit("")).alias("sentence"),
        F.try_to_timestamp(F.coalesce("f.date_parsed", F.when(F.col("f.value").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("f.value"))), F.lit("yyyy-MM-dd")).cast("date").alias("date_parsed"),
        "f.duration_days", F.coalesce("f.start_char", F.lit(0)).alias("start_char"), F.coalesce("f.end_char", F.lit(0)).alias("end_char"),
        F.coalesce("f.confidence", F.lit(0.9)).alias("confidence"), "f.signal_verb", "f.signal_prep", "f.is_duplicate_of", F.coalesce("f.temporal_content", F.lit(True)).alias("temporal_content"),
    )
    deps = good.select("doc_id", F.posexplode("dependencies").alias("dep_pos", "d")).select(
        "doc_id", "dep_pos", "d.from_id", "d.to_id", "d.constraint_type", F.coalesce("d.constraint_expr", F.lit("")).alias("constraint_expr"), "d.delta_days",
        F.coalesce("d.confidence", F.lit(0.85)).alias("confidence"), F.coalesce("d.verified", F.lit(False)).alias("verified"), "d.allen_relation",
        F.coalesce("d.corroboration_count", F.lit(1)).alias("corroboration_count"),
    )
    return Bundle(documents, facts, deps, errors)


def _empty_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """file_name, error of the files without a byte, which no file source gives as rows; from the folder's listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path) or []
    names = [(x.getPath().getName(), "not JSON") for x in found if x.isFile() and x.getLen() == 0]
    return spark.createDataFrame(names, "file_name string, error string")


def validate(bundle: Bundle) -> DataFrame:
    """doc_id and message for each rule that a graph breaks."""
    facts, deps = bundle.facts, bundle.deps
    ids = facts.select("doc_id", F.col("fact_id").alias("known")).distinct()
    message = lambda df, text: df.select("doc_id", text.alias("message"))
    out = message(facts.where(~F.col("role").isin(*schemas.ROLES) | F.col("role").isNull()), F.format_string("fact %s: role %s", "fact_id", "role"))
    out = out.union(message(facts.where(F.col("fact_id").isNull() | F.col("entity").isNull()), F.format_string("fact %s: id and entity are required", F.col("fact_pos").cast("string"))))
    out = out.union(message(deps.where(~F.col("constraint_type").isin(*schemas.CONSTRAINTS)), F.format_string("dependency %s: type %s", F.col("dep_pos").cast("string"), "constraint_type")))
    for side in ("from_id", "to_id"):
        lost = deps.join(ids, (deps.doc_id == ids.doc_id) & (deps[side] == ids.known), "left_anti")
        out = out.union(message(lost, F.format_string(f"dependency %s: {side} %s is no fact", F.col("dep_pos").cast("string"), side)))
    lost = facts.where(F.col("is_duplicate_of").isNotNull()).join(ids, (facts.doc_id == ids.doc_id) & (F.col("is_duplicate_of") == ids.known), "left_anti")
    return out.union(message(lost, F.format_string("fact %s: is_duplicate_of %s is no fact", "fact_id", "is_duplicate_of"))).union(bundle.errors.select("file_name", "error"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, text, error for .txt and .md files; names that start with README are skipped."""
    files = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_name").alias("file_name"), "content")
    known = F.lower("file_name").rlike(r"\.(txt|md|pdf|docx)$") & ~F.upper("file_name").startswith("README")
    plain = F.lower("file_name").rlike(r"\.(txt|md)$")
    return files.where(known).select(
        "file_name", F.when(plain, F.try_validate_utf8(F.col("content").cast("string"))).alias("strict"), F.when(plain, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"),
        F.when(~plain, F.lit("no reader for this format")).alias("error"),
    ).drop("strict")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """The correction log in order; version 1 only. A log that does not exist is empty."""
    fields = ", ".join(c.replace(" ", ":", 1) for c in schemas.CORRECTION.split(", "))
    if not _exists(spark, path):
        return spark.createDataFrame([], f"pos int, {schemas.CORRECTION}")
    raw = spark.read.schema(f"version int, corrections array<struct<{fields}>>").option("multiLine", True).json(path)
    checked = raw.where(F.when(F.coalesce("version", F.lit(1)) == 1, F.lit(True)).otherwise(F.raise_error(F.lit("unknown version of the correction log")).cast("boolean")))
    log = checked.select(F.posexplode("corrections").alias("pos", "c")).select("pos", "c.*")
    return log.where(F.when(F.col("op").isin(*schemas.CORRECTION_OPS), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown correction: "), F.coalesce("op", F.lit("null")))).cast("boolean")))


def save_corrections(log: DataFrame, path: str) -> None:
    """The log as one JSON document of version 1, in order. A log is what people typed, so it is small."""
    fields = [c for c in log.columns if c != "pos"]
    ordered = log.agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("c"))
    entries = F.transform("c", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    cut(ordered.select(F.to_json(F.struct(F.lit(1).alias("version"), entries.alias("corrections"))).alias("value"))).write.mode("overwrite").text(path)


def append_corrections(log: DataFrame, more: DataFrame, path: str) -> None:
    """The log with more corrections behind it; each of the new ones that states no time gets the present one."""
    last = log.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    stamped = more.withColumn("ts", F.coalesce("ts", now)) if "ts" in more.columns else more.withColumn("ts", now)
    placed = stamped.join(F.broadcast(last), F.lit(True)).withColumn("pos", (F.col("pos") + F.col("last") + 1).cast("int")).drop("last")  # one row
    save_corrections(log.unionByName(placed, allowMissingColumns=True), path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """An override file of the older shape (force_merge: lists of [document, fact], split: [document, fact]) as corrections."""
    raw = spark.read.schema("force_merge array<array<array<string>>>, split array<array<string>>").option("multiLine", True).json(path)
    kinds = F.concat(
        F.transform(F.coalesce("force_merge", F.array().cast("array<array<array<string>>>")), lambda keys: F.struct(F.lit("merge").alias("op"), keys.alias("keys"))),
        F.transform(F.coalesce("split", F.array().cast("array<array<string>>")), lambda key: F.struct(F.lit("split").alias("op"), F.array(key).alias("keys"))),
    )
    return raw.select(F.posexplode(kinds).alias("pos", "c")).select("pos", "c.op", "c.keys")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Kind, concept, term of a rule pack's aliases file. Nothing global: pass it on."""
    shape = "anchor_aliases map<string, struct<plain: array<string>, end_role_only: array<string>>>, action_cues array<string>, procedural_noise array<string>, entity_boilerplate array<string>"
    raw = spark.read.schema(shape).option("multiLine", True).json(path)
    aliases = raw.select(F.explode("anchor_aliases").alias("concept", "a"))
    listed = lambda df, kind, concept, terms: df.select(F.lit(kind).alias("kind"), concept.alias("concept"), F.explode(terms).alias("term"))
    none = F.lit(None).cast("string")
    out = listed(aliases, "plain", F.col("concept"), F.col("a.plain")).union(listed(aliases, "end_role_only", F.col("concept"), F.col("a.end_role_only")))
    for kind in ("action_cues", "procedural_noise", "entity_boilerplate"):
        out = out.union(listed(raw, kind, none, F.col(kind)))
    return out.dropDuplicates(["kind", "concept", "term"])


def source_hash(text: Column | str) -> Column:
    """S19."""
    return F.sha2(F.encode(text, "UTF-8"), 256)
