"""Text and JSON tables, file ledgers, and write-once sinks."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import uuid
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactError, ContractError, ProvenanceError, no_labels, require_unique
from ..runtime import shared_dir


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool = True) -> DataFrame:
    """All columns as text, with quoted values; absent values are empty strings.

    A quoted value may hold a line feed, so a file is read by one task; multiline
    False lets large files be split where no value holds one.
    """
    names = columns or next(csv.reader([spark.read.text(path).first()[0]], delimiter="\t"))
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"', multiLine=multiline).csv(path).na.fill("")


def read_constructs(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, construct_sha256, sequence) of every row, from either of the two table layouts.

    In a table with roles there must be reference rows, none with a label, and the
    supervised rows are taken.
    """
    t = read_tsv(spark, path)
    for names in (("construct_group_id", "construct_sha256", "construct_sequence"), ("series_id", "target_sequence_sha256", "target_sequence")):
        if set(names) <= set(t.columns):
            if "role" in t.columns:
                references = t.where("role = 'site_reference_only'")
                if not references.limit(1).count():
                    raise ContractError("no reference rows")
                no_labels(references, *(c for c in ("pKd", "value_nm") if c in t.columns))
                t = t.where("role = 'supervised_s0'")
            return t.select(*(F.col(n).alias(o) for n, o in zip(names, ("group_id", "construct_sha256", "sequence"))))
    raise ContractError(f"no construct columns among {t.columns}")


def constructs(rows: DataFrame) -> DataFrame:
    """One row a group, sorted, from (group_id, construct_sha256, sequence) rows.

    Rows of a group must agree, digests must be those of the sequences, and these
    hold capital letters only; a row that does not fails the query.
    """
    fail = lambda c, say: F.when(c, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(say + ": "), "group_id")).cast("boolean"))
    one = rows.groupBy("group_id").agg(F.count_distinct("construct_sha256", "sequence").alias("__n"), F.first("construct_sha256").alias("construct_sha256"), F.first("sequence").alias("sequence"))
    same = F.sha2("sequence", 256) == F.col("construct_sha256")
    plain = F.col("sequence").rlike(r"^\p{L}+$") & (F.col("sequence") == F.upper("sequence"))
    checked = one.where(fail(F.col("__n") == 1, "inconsistent construct")).where(fail(same, "digest of another sequence")).where(fail(plain, "no canonical sequence"))
    return checked.drop("__n").orderBy("group_id")


def load_json(path: str | Path) -> dict:
    """A JSON document that must be an object."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ProvenanceError(f"{path} holds no JSON object")
    return value


def load_yaml(path: str | Path, version: int = 1) -> dict:
    """A YAML configuration: a mapping whose schema_version is the one known here."""
    import yaml

    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ContractError(f"{path} holds no mapping")
    if value.get("schema_version") != version:
        raise ContractError(f"{path} has an unknown schema_version")
    return value


def read_items(spark: SparkSession, path: str | list[str], field: str, schema: str) -> DataFrame:
    """The objects of one array field of JSON documents."""
    whole = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(path)
    return whole.select(F.explode(field).alias("d")).select("d.*")


def available_predictions(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The records of a prediction manifest that are available; schema must name status."""
    return read_items(spark, path, "records", schema).where("status = 'available'")


def load_views(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """The eligible S1, S2 and S3 views of several manifests, sorted; a series has each view once."""
    rows = read_items(spark, paths, "views", schema).where((F.col("status") == "eligible") & F.col("view").isin("S1", "S2", "S3"))
    require_unique(rows, "series_id", "view")
    return rows.orderBy("series_id", "view")


def file_ledger(spark: SparkSession, root: str, skip: str = "__pycache__") -> DataFrame:
    """(path below root, bytes, sha256) of the files under root, without those in folders named skip."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    top = Path(root.split(":", 1)[-1] if "://" in root or root.startswith("file:") else root)
    prefix = "/" + str(top.resolve()).strip("/") + "/"
    named = files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    named = named.withColumn("path", F.when(F.startswith("path", F.lit(prefix)), F.substr("path", F.lit(len(prefix) + 1))).otherwise(F.raise_error(F.concat(F.lit("outside of root: "), "path")).cast("string")))
    return named.where(~F.array_contains(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), skip))


def snapshot_ledger(ledger: DataFrame, allowed: list[str], checkpoint: str, digest: str) -> DataFrame:
    """The allowed files of a model's folder in the order of their names; the checkpoint must be there with the pinned digest."""
    kept = ledger.where(F.col("path").isin(allowed))
    if kept.where((F.col("path") == checkpoint) & (F.lower("sha256") == digest.lower())).limit(1).count() != 1:
        raise ProvenanceError(f"{checkpoint} is missing or has another digest")
    return kept.orderBy("path")


def tree_sha256(ledger: list[tuple[str, str]]) -> str:
    """Digest of (path, hex digest) rows in the order of the paths' parts."""
    h = hashlib.sha256()
    for path, digest in sorted(ledger, key=lambda x: x[0].split("/")):
        h.update(path.encode() + b"\0" + bytes.fromhex(digest))
    return h.hexdigest()


def tree_digest(ledger: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """(by, tree_sha256, files) of (by, path, sha256) rows, in the plan: each tree's rows are gathered in the order of the paths' parts."""
    item = F.struct(F.split("path", "/").alias("order"), F.concat(F.encode("path", "utf-8"), F.unhex(F.lit("00")), F.unhex("sha256")).alias("bytes"))
    parts = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.hex(x["bytes"]))
    return ledger.groupBy(*by).agg(F.sha2(F.unhex(F.array_join(parts, "")), 256).alias("tree_sha256"), F.count("*").alias("files"))


def missing_downloads(wanted: DataFrame, landed_files: DataFrame) -> DataFrame:
    """The (path, url) rows whose path is not landed yet, once each; two addresses for one path are an error."""
    need = wanted.select("path", "url").distinct()
    require_unique(need, "path")
    return need.join(landed_files.select("path"), "path", "left_anti")


#: Shuffle files of a write go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def landed(df: DataFrame) -> DataFrame:
    """df written as Parquet in the folder that the cluster shares, and read back: one use of its lineage, safe from lost executors.

    The shuffle files of the write are given back when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def stable_json_bytes(value) -> bytes:
    """Sorted keys, indent 2, ASCII, one line feed at the end; NaN is refused."""
    return (json.dumps(value, sort_keys=True, indent=2, allow_nan=False) + "\n").encode()


def immutable_write(path: str | Path, payload: bytes) -> str:
    """Write once: the same bytes again are no change, other bytes an error, and so is a write that was broken off."""
    path, digest = Path(path), hashlib.sha256(payload).hexdigest()
    if path.exists():
        if hashlib.sha256(path.read_bytes()).hexdigest() != digest:
            raise ArtifactError(f"{path} holds other bytes")
        return digest
    partial = path.with_name(f".{path.name}.partial")
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        with partial.open("xb") as f:
            f.write(payload)
            f.flush()
            os.fsync(f.fileno())
    except FileExistsError:
        raise ArtifactError(f"left over: {partial}") from None
    os.replace(partial, path)
    return digest


def preserve_timestamp(path: str | Path, manifest: dict, field: str) -> None:
    """Take over the time that an earlier manifest states, so that a rerun gives the same bytes."""
    if Path(path).exists():
        old = json.loads(Path(path).read_text())
        if field not in old:
            raise ArtifactError(f"{path} has no {field}")
        manifest[field] = old[field]


def tsv_bytes(df: DataFrame, order: list[str]) -> bytes:
    """A small table as text with values quoted where they need it; an empty one is an error."""
    rows = df.orderBy(*order).collect()
    if not rows:
        raise ContractError("no rows to write")
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter="\t", lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(["" if x is None else x for x in r] for r in rows)
    return out.getvalue().encode()


def write_tsv(df: DataFrame, path: str) -> None:
    """A table of any size as one folder of text files, values quoted where they need it."""
    if not df.limit(1).count():
        raise ContractError("no rows to write")
    df.write.mode("errorifexists").options(sep="\t", header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def ca_pdb_text(lines: DataFrame, by: list[str], minimum: int = 4) -> DataFrame:
    """(by, text, ca_count, sha256) of the record lines (by, serial, line); a chain with too few fails the query."""
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("serial", "line"))), lambda x: x["line"]), "\n"), F.lit("\nTER\nEND\n"))
    out = lines.groupBy(*by).agg(text.alias("text"), F.count("*").alias("ca_count"))
    enough = F.when(F.col("ca_count") >= minimum, F.lit(True)).otherwise(F.raise_error(F.lit("too few CA atoms")).cast("boolean"))
    return out.where(enough).withColumn("sha256", F.sha2("text", 256))


def npy_bytes(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


def array_sha256(a: np.ndarray) -> str:
    """Digest with a JSON header, a NUL and the bytes."""
    a = np.ascontiguousarray(a)
    head = json.dumps({"dtype": str(a.dtype), "shape": list(a.shape)}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(head.encode() + b"\0" + a.tobytes()).hexdigest()


def plain_array_sha256(a: np.ndarray) -> str:
    """Digest of the type's text, the shape and the bytes; never equal to array_sha256."""
    a = np.ascontiguousarray(a)
    return hashlib.sha256(str(a.dtype).encode() + json.dumps(list(a.shape), separators=(",", ":")).encode() + a.tobytes()).hexdigest()
