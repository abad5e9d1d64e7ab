"""Records of remote services after they have landed: picks, flattening, completeness and acquisition status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractError, require_none, require_unique
from ..functions import exprs as e
from ..functions import vocab as v

PREDICTION = "uniprotAccession string, isUniProt boolean, isComplex boolean, latestVersion int, modelCreatedDate string, entryId string, cifUrl string, sequence string, uniprotSequence string"
#: The nested fields of an entry that the work reads.
ENTRY = (
    "rcsb_id string, rcsb_accession_info struct<deposit_date:string,initial_release_date:string,revision_date:string>, exptl array<struct<method:string>>, rcsb_entry_info struct<resolution_combined:array<double>>, "
    "polymer_entities array<struct<rcsb_id:string,entity_poly:struct<pdbx_seq_one_letter_code_can:string,rcsb_entity_polymer_type:string>,"
    "rcsb_polymer_entity_container_identifiers:struct<entity_id:string,asym_ids:array<string>,auth_asym_ids:array<string>,reference_sequence_identifiers:array<struct<database_accession:string,database_name:string>>>>>, "
    "nonpolymer_entities array<struct<rcsb_id:string>>"
)


def is_exact(accession: Column) -> Column:
    """Whether a prediction record belongs to that very accession and is no complex; an absent isComplex counts as none."""
    return (F.col("uniprotAccession") == accession) & F.coalesce(F.col("isUniProt"), F.lit(False)) & ~F.coalesce(F.col("isComplex"), F.lit(False))


def latest(records: DataFrame, by: list[str]) -> DataFrame:
    """The record with the highest version, then date, then entry id; version 0 counts as unknown, as an absent one does."""
    rank = F.struct(F.coalesce(F.nullif("latestVersion", F.lit(0)), F.lit(-1)), F.coalesce("modelCreatedDate", F.lit("")), F.coalesce("entryId", F.lit("")))
    rest = [c for c in records.columns if c not in by]
    return records.groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*by, "r.*")


def predictions(accessions: DataFrame, answers: DataFrame) -> DataFrame:
    """(accession, status, entry_id, latest_version, sequence, cif_url): one row an accession, from landed answers (accession, records array).

    An accession without an answer is api_unavailable, one without an exact record
    exact_canonical_accession_unavailable. A picked record without a file or a
    sequence fails the query.
    """
    asked = accessions.select("accession").distinct()
    items = answers.select("accession", F.explode("records").alias("r")).select("accession", "r.*")
    best = latest(items.where(is_exact(F.col("accession"))), ["accession"])
    sequence = F.coalesce(F.nullif("sequence", F.lit("")), F.nullif("uniprotSequence", F.lit("")))
    best = best.select("accession", F.col("entryId").alias("entry_id"), F.col("latestVersion").alias("latest_version"), sequence.alias("sequence"), F.nullif("cifUrl", F.lit("")).alias("cif_url"))
    whole = F.col("sequence").isNotNull() & F.col("cif_url").isNotNull()
    best = best.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("incomplete record: "), "accession")).cast("boolean"))).withColumn("__exact", F.lit(True))
    answered = answers.select("accession").distinct().withColumn("__answered", F.lit(True))
    status = F.when(F.col("__answered").isNull(), "api_unavailable").when(F.col("__exact").isNull(), "exact_canonical_accession_unavailable").otherwise("available")
    return asked.join(answered, "accession", "left").join(best, "accession", "left").withColumn("status", status).drop("__answered", "__exact")


def identifiers(result_set: Column) -> Column:
    """Sorted distinct identifiers in capitals of a JSON array that holds texts or objects with an identifier."""
    items = F.from_json(result_set, "array<string>")
    one = lambda x: F.upper(F.coalesce(F.when(F.startswith(F.ltrim(x), F.lit("{")), F.get_json_object(x, "$.identifier")), x))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(items, one))), F.array().cast("array<string>"))


def searched(answers: DataFrame) -> DataFrame:
    """(accession, identifiers) from landed answers (accession, total_count, result_set); a count that differs from the identifiers fails the query.

    An absent count is taken from the identifiers, an absent set is empty.
    """
    ids = answers.select("accession", "total_count", identifiers(F.col("result_set")).alias("identifiers"))
    whole = F.coalesce("total_count", F.size("identifiers")) == F.size("identifiers")
    return ids.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("incomplete search: "), "accession")).cast("boolean"))).drop("total_count")


def all_identifiers(found: DataFrame) -> DataFrame:
    """The identifiers of all accessions, once each."""
    return found.select(F.explode("identifiers").alias("pdb_id")).distinct()


def missing(requested: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """The requested ids that did not come back."""
    return requested.select(key).join(returned.select(key), key, "left_anti")


def entries_of(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(accession, pdb_id, entry): the entries of each accession's identifiers; one that is not there is an error, an accession without any gives no row."""
    wanted = found.select("accession", F.explode_outer("identifiers").alias("pdb_id")).where("pdb_id is not null")
    have = entries.select(F.upper("rcsb_id").alias("pdb_id"), F.struct(*entries.columns).alias("entry")).groupBy("pdb_id").agg(F.max_by("entry", F.col("entry.rcsb_id")).alias("entry"))
    require_none(missing(wanted.distinct(), have, "pdb_id"), "entries that a search named are missing", 20)
    return wanted.join(have, "pdb_id")


def resolution(entry: str = "entry") -> Column:
    """The least resolution that is stated, else null."""
    return F.array_min(F.filter(F.col(f"{entry}.rcsb_entry_info.resolution_combined"), lambda x: x.isNotNull()))


def release_date(entry: str = "entry") -> Column:
    return F.coalesce(F.col(f"{entry}.rcsb_accession_info.initial_release_date"), F.lit(""))


def without_nonpolymers(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Entries of a search for none; one that has a nonpolymer entity fails the query."""
    none = F.coalesce(F.size(F.col(f"{entry}.nonpolymer_entities")), F.lit(0)) <= 0
    return entries.where(F.when(none, F.lit(True)).otherwise(F.raise_error(F.lit("a search for no nonpolymers gave an entry with one")).cast("boolean")))


def protein_entities(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """One row for each protein entity that carries the row's accession: entity_id, asym_ids and its sequence in capitals, letters only."""
    ids = "rcsb_polymer_entity_container_identifiers"
    same = lambda r: (F.upper(F.coalesce(r["database_name"], F.lit(""))) == "UNIPROT") & (F.upper(F.coalesce(r["database_accession"], F.lit(""))) == F.upper("accession"))
    fits = lambda p: (p["entity_poly"]["rcsb_entity_polymer_type"] == "Protein") & F.coalesce(F.exists(p[ids]["reference_sequence_identifiers"], same), F.lit(False))
    out = entries.withColumn("__p", F.explode(F.filter(F.col(f"{entry}.polymer_entities"), lambda p: F.coalesce(fits(p), F.lit(False)))))
    sequence = e.normalised_sequence(F.col("__p.entity_poly.pdbx_seq_one_letter_code_can"))
    named = {"entity_id": F.coalesce(F.col(f"__p.{ids}.entity_id"), F.lit("")), "asym_ids": F.coalesce(F.col(f"__p.{ids}.asym_ids"), F.array().cast("array<string>")), "sequence": sequence}
    return out.withColumns(named).drop("__p").where(F.col("sequence").rlike(r"^\p{L}+$"))


def candidates(found: DataFrame, entries: DataFrame, cap: float = v.RESOLUTION_CAP) -> DataFrame:
    """(accession, pdb_id, entity_id, asym_ids, sequence, resolution, release_date) of entries within the resolution cap."""
    near = entries_of(found, entries).withColumn("resolution", resolution()).where(F.col("resolution") <= cap).withColumn("release_date", release_date())
    return protein_entities(without_nonpolymers(near)).drop("entry")


def acquisition_counts(records: DataFrame) -> dict:
    """Counts for a manifest: accessions asked for, available, and not."""
    n, ok = records.agg(F.count("*"), F.count_if(F.col("status") == "available")).first()
    return {"requested_accessions": n, "available": ok, "unavailable": n - ok}


def batches_answered(requested: DataFrame, answered: DataFrame) -> DataFrame:
    """(batch, requested, returned) of batched ids (batch, pdb_id) and landed entries (batch, rcsb_id)."""
    require_unique(requested, "pdb_id")
    back = answered.groupBy("batch").agg(F.count("rcsb_id").alias("returned"))
    return requested.groupBy("batch").agg(F.count("*").alias("requested")).join(back, "batch", "left").fillna(0, ["returned"])


def parsed(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON objects by an explicit schema; a text that is no object is an error."""
    out = texts.withColumn(column, F.from_json(column, schema, {"mode": "FAILFAST"}))
    if out.where(F.col(column).isNull()).limit(1).count():
        raise ContractError("a text is no JSON object")
    return out
