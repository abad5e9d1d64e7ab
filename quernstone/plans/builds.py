"""Builds made of the operators: pocket views, predicted views, structural edges, unoccupied views and their manifests.

All of them take and give DataFrames. Sites, picked chains, pocket atoms and
features are used several times, so a build lands them as Parquet in the shared
folder; give it resolved atoms that have been landed too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractError, ViewError, disjoint, mandatory, no_labels, require_none
from ..functions import exprs as e
from ..functions import vocab as v
from ..operators import align, features, mapping, tables
from ..operators import atoms as A
from ..sources.files import ca_pdb_text, landed, utc_now

COPY = ["pdb_id", "entity_id", "asym_id"]


def _copies(rows: DataFrame, key: str, side: str) -> DataFrame:
    """(pdb_id, entity_id, asym_id, key): the chains that each row names for the protein or the ligand."""
    return rows.select("pdb_id", F.col(f"{side}_entity_id").alias("entity_id"), F.explode(e.split_ids(F.col(f"{side}_asym_ids"))).alias("asym_id"), F.col(key).alias("__key"))


def _keyed(atoms: DataFrame, chains: DataFrame) -> DataFrame:
    """Atoms of the named chains, with the row's key in the place of the structure's name."""
    return atoms.join(chains, COPY).withColumn("pdb_id", F.col("__key")).drop("__key")


def reference_rows(pilot: DataFrame, order: str) -> DataFrame:
    """The last reference row of each group; a label on any reference row is an error."""
    refs = pilot.where("role = 'site_reference_only'")
    no_labels(refs, "pKd", "value_nm")
    return tables.last_wins(refs, ["construct_group_id"], [order])


def site_definitions(references: DataFrame, atoms: DataFrame, cutoff: float = v.CONTACT_CUTOFF) -> tuple[DataFrame, DataFrame]:
    """Sites (construct_group_id, reference_*, positions, contacts) and their expected names (pdb_id as group, seq_id, expected_name).

    A group whose ligand touches too few positions fails the query.
    """
    key = "construct_group_id"
    heavy = atoms.where(e.heavy())
    protein = _keyed(heavy.where("seq_id is not null"), _copies(references, key, "protein"))
    component = references.select(F.col(key).alias("pdb_id"), F.col("ligand_comp_id").alias("residue_name"))
    ligand = _keyed(heavy, _copies(references, key, "ligand")).join(component, ["pdb_id", "residue_name"], "left_semi")
    best = landed(A.pick_site(A.contact_pairs(protein, ligand, cutoff)).withColumnRenamed("pdb_id", key))
    known = references.select(key, F.col("pdb_id").alias("reference_pdb_id"), F.col("protein_entity_id").alias("reference_protein_entity_id"), F.col("ligand_comp_id").alias("reference_ligand_comp_id"))
    sites = mandatory(known, best, [key], "reference site has too few positions")
    wanted = best.select(F.col(key).alias("pdb_id"), F.col("protein_asym_id").alias("asym_id"), F.explode("positions").alias("seq_id"))
    names = A.modal_residues(protein.join(wanted, ["pdb_id", "asym_id", "seq_id"], "left_semi"), ["pdb_id"])
    return landed(sites), landed(names.select("pdb_id", "seq_id", F.col("residue_name").alias("expected_name")))


def extract(chains: DataFrame, atoms: DataFrame, expected: DataFrame, minimum: float) -> tuple[DataFrame, DataFrame]:
    """The picked chain of each key with its gate, and the heavy atoms of that chain's pocket; pdb_id holds the key."""
    inside = _keyed(atoms.where(e.heavy()), chains)
    picked = landed(A.coverage_gate(A.pick_chain(inside, expected, chains.select(F.col("__key").alias("pdb_id"), "asym_id")), minimum))
    pocket = inside.join(picked.select("pdb_id", "asym_id"), ["pdb_id", "asym_id"], "left_semi").join(expected.select("pdb_id", "seq_id"), ["pdb_id", "seq_id"], "left_semi")
    return picked, landed(pocket)


def _view(picked: DataFrame, pocket: DataFrame) -> DataFrame:
    """(key, feature_protein_asym_id, position lists, features)"""
    joined = {f"{n}_positions_label_seq_id": F.array_join(c, ";") for n, c in (("pocket", "expected_positions"), ("present", "present_positions"), ("missing", "missing_positions"))}
    f = features.pocket_features(pocket, picked.select("pdb_id", "coverage"), ["pdb_id"])
    return landed(picked.select("pdb_id", F.col("asym_id").alias("feature_protein_asym_id"), *(c.alias(n) for n, c in joined.items())).join(f, "pdb_id").withColumnRenamed("pdb_id", "__key"))


def pocket_views(pilot: DataFrame, atoms: DataFrame, order: str = "ord", cutoff: float = v.CONTACT_CUTOFF, minimum: float = v.MINIMUM_COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(views, sites): an S0 and an S1 row for every supervised row of the pilot table.

    S1 features belong to the group's reference and are made once a group. All
    pockets must pass; else the first failures are named in the error.
    """
    key = "construct_group_id"
    references, rows = landed(reference_rows(pilot, order)), pilot.where("role = 'supervised_s0'")
    if not references.limit(1).count() or not rows.limit(1).count():
        raise ContractError("the pilot table needs reference rows and supervised rows")
    require_none(rows.join(references, key, "left_anti").select("observation_id", key), "groups without a site")
    disjoint(rows, references, [key, "pdb_id"], "a site reference is among the supervised structures")
    sites, expected = site_definitions(references, atoms, cutoff)
    fixed = sites.select(F.col("reference_pdb_id").alias("pdb_id"), F.col("reference_protein_entity_id").alias("entity_id"), F.col("protein_asym_id").alias("asym_id"), F.col(key).alias("__key"))
    s1, s1_atoms = extract(fixed, atoms, expected, 1.0)
    named = rows.select("observation_id", F.col(key).alias("pdb_id")).join(expected, "pdb_id").select(F.col("observation_id").alias("pdb_id"), "seq_id", "expected_name")
    s0, s0_atoms = extract(_copies(rows, "observation_id", "protein"), atoms, named, minimum)
    for picked in (s1, s0):
        require_none(picked.where("gate <> 'pass'").select("pdb_id", "gate", "coverage", "mismatches"), "mapped pockets failed")
    base = rows.select(
        "observation_id", key, "construct_sha256", "uniprot_accession", F.col("pdb_id").alias("query_pdb_id"), F.col("protein_entity_id").alias("query_protein_entity_id"),
        F.col("ligand_comp_id").alias("query_ligand_comp_id"), "inchikey", "canonical_smiles", "pKd",
    )
    base = mandatory(base, sites.select(key, F.col("reference_pdb_id").alias("site_reference_pdb_id"), F.col("reference_ligand_comp_id").alias("site_reference_ligand_comp_id"), "reference_protein_entity_id"), [key], "no site")

    def tier(name: str, on: str, view: DataFrame, structure: str, entity: str, source: str) -> DataFrame:
        told = {
            "view_id": F.concat("observation_id", F.lit(":" + name)), "mapping_tier": F.lit(name), "feature_structure_pdb_id": F.col(structure), "feature_protein_entity_id": F.col(entity),
            "receptor_conformation_source": F.lit(source), "query_holo_receptor_privilege": F.lit(name == "S0"),
            "historical_reference_ligand_used_only_for_site": F.lit(True), "query_ligand_coordinates_read": F.lit(False),
        }
        return mandatory(base.withColumns(told), view.withColumnRenamed("__key", on), [on], "no pocket").drop("reference_protein_entity_id", "query_protein_entity_id")

    out0 = tier("S0", "observation_id", _view(s0, s0_atoms), "query_pdb_id", "query_protein_entity_id", "query_holo_receptor")
    out1 = tier("S1", key, _view(s1, s1_atoms), "site_reference_pdb_id", "reference_protein_entity_id", "fixed_historical_reference_receptor")
    return out0.unionByName(out1), sites


def structure_pairs(views: DataFrame, measured: DataFrame, modes: list[str], whole: tuple[float, int, float], pocket: tuple[float, int, float, float]) -> DataFrame:
    """The jobs of eligible views (construct_group_id, view, status) with their figures, and whether each is an edge.

    measured holds the aligner's figures of every job: left_construct_group_id,
    right_construct_group_id, view, region, mode, tm_1, tm_2, length_1, length_2,
    aligned, rmsd; a job without them fails the query. It is read twice. whole and pocket are the
    least score, aligned positions and fraction, and for pockets the largest RMSD.
    """
    on = ["left_construct_group_id", "right_construct_group_id", "view", "region", "mode"]
    groups = views.where("status = 'eligible'").select("construct_group_id", "view").distinct()
    jobs = tables.measured_jobs(groups, measured, "construct_group_id", "view", modes)
    if jobs is None:  # a job has several rows or none
        jobs = mandatory(tables.with_modes(tables.all_pairs(groups, "construct_group_id", "view"), modes), measured, on, "a job has no measurement")
    edge: Column = F.when(F.col("region") == "global", tables.is_edge(*whole, float("inf"))).otherwise(tables.is_edge(*pocket))
    return tables.pair_metrics(jobs).withColumn("edge", edge)


def structure_edges(views: DataFrame, measured: DataFrame, modes: list[str], whole: tuple[float, int, float], pocket: tuple[float, int, float, float]) -> tuple[DataFrame, DataFrame]:
    """(pairs, edges) of eligible views: structure_pairs, and its edges rolled up by pair; only evidence is shuffled."""
    pairs = structure_pairs(views, measured, modes, whole, pocket)
    evidence = pairs.where("edge")
    return pairs, tables.or_blank(tables.edge_rollup(evidence, ["left_construct_group_id", "right_construct_group_id"], ["aligned", "aligned_fraction"]), evidence)


def ranked_candidates(candidates: DataFrame, cap: float, then: list[str]) -> tuple[DataFrame, list[Column]]:
    """Candidates whose resolution is stated and within the cap, and their order: resolution, date (a blank one last), then the columns named."""
    date = F.coalesce(F.nullif(F.col("release_date"), F.lit("")), F.lit("9999-99-99"))
    return candidates.where(F.col("resolution") <= cap).withColumn("__date", date), [F.col(c) for c in ("resolution", "__date", *then)]


def unoccupied_views(candidates: DataFrame, atoms: DataFrame, expected: DataFrame, radius: float, minimum: float = v.MINIMUM_COVERAGE, cap: float = v.RESOLUTION_CAP) -> tuple[DataFrame, DataFrame]:
    """(selected, attempts): the first candidate chain of each group whose pocket is whole and has no foreign atom near.

    candidates: construct_group_id, pdb_id, entity_id, asym_ids (array), resolution,
    release_date; expected: pdb_id as group, seq_id, expected_name. Candidates go by
    resolution, date (a blank one last), structure and entity, chains by their place.
    """
    group = "construct_group_id"
    near, order = ranked_candidates(candidates, cap, ["pdb_id", "entity_id", "place"])
    tries = near.select("*", F.posexplode("asym_ids").alias("place", "asym_id")).drop("asym_ids")
    tries = tries.withColumn("__key", F.to_json(F.struct(group, "pdb_id", "entity_id", "asym_id")))
    chains = tries.select(*COPY, "__key").distinct()
    named = tries.select("__key", F.col(group).alias("pdb_id")).distinct().join(expected, "pdb_id").select(F.col("__key").alias("pdb_id"), "seq_id", "expected_name")
    picked, pocket = extract(chains, atoms, named, minimum)
    own = chains.select("pdb_id", "__key", F.col("entity_id").alias("__entity"), F.col("asym_id").alias("__asym"))
    others = atoms.where(e.heavy() & ~F.col("residue_name").isin(*v.WATERS) & F.col("group").isin("ATOM", "HETATM")).join(own, "pdb_id")
    others = others.where((F.col("entity_id") != F.col("__entity")) | (F.col("asym_id") != F.col("__asym"))).withColumn("pdb_id", F.col("__key"))
    free = A.least_foreign_distance(pocket, others, ["pdb_id"], radius)
    judged = picked.select("pdb_id", "gate", "coverage", "mismatches").join(free, "pdb_id", "left").withColumnRenamed("pdb_id", "__key")
    ok = F.coalesce((F.col("gate") == "pass") & F.col("unoccupied"), F.lit(False))
    told = tries.join(judged, "__key", "left").withColumn("ok", ok)
    done = [x.drop("__key", "__date") for x in (tables.first_fit(told, [group], order, "ok"), tables.attempts(told, [group], order, "ok"))]
    return done[0], done[1]


def groups_of(pilot: DataFrame, order: str) -> DataFrame:
    """The first supervised row of each group: its construct and accession."""
    rows = pilot.where("role = 'supervised_s0'").select("construct_group_id", "construct_sha256", "construct_sequence", "uniprot_accession", order)
    return tables.first_wins(rows, ["construct_group_id"], [order]).drop(order)


def ca_files(chain: DataFrame, pocket: DataFrame, view: str) -> DataFrame:
    """(construct_group_id, view, region, text, ca_count, sha256) of whole chains and pockets; both hold the group as pdb_id."""
    out = None
    for region, own in (("global", chain), ("pocket", pocket)):
        text = ca_pdb_text(A.pdb_lines(A.first_ca(own, ["ord"])), A.CHAIN).select(F.col("pdb_id").alias("construct_group_id"), F.lit(view).alias("view"), F.lit(region).alias("region"), "text", "ca_count", "sha256")
        out = text if out is None else out.unionByName(text)
    return out


def predicted_views(
    pilot: DataFrame, sites: DataFrame, expected: DataFrame, atoms: DataFrame, records: DataFrame, predicted_atoms: DataFrame, views: DataFrame,
    construct_coverage: float, identity: float, site_coverage: float, site_identity: float, plddt: float, order: str = "ord",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(view records, S2 rows, CA files) of each group: its fixed view S1 and, where a prediction can carry the site, S2.

    sites and expected come from site_definitions; records are available predictions
    (uniprot_accession, entry_id, sequence, cif_sha256), whose atoms hold the entry id
    as pdb_id; views are the pocket views whose S1 rows are the templates. A group has
    one record of each view, whose status is the first reason why it is not eligible.
    A group without a site, an S1 pocket that fails, and no S2 row at all are errors.
    """
    key = "construct_group_id"
    site = sites.select(key, "positions", "reference_pdb_id", "reference_protein_entity_id", F.col("protein_asym_id").alias("reference_asym_id"))
    group = landed(mandatory(groups_of(pilot, order), site, [key], "a group without a site"))
    fixed = group.select(F.col("reference_pdb_id").alias("pdb_id"), F.col("reference_protein_entity_id").alias("entity_id"), F.col("reference_asym_id").alias("asym_id"), F.col(key).alias("__key"))
    s1, s1_pocket = extract(fixed, atoms, expected, v.MINIMUM_COVERAGE)
    require_none(s1.where("gate <> 'pass'").select("pdb_id", "gate"), "fixed pockets failed")
    files = ca_files(_keyed(atoms.where("group = 'ATOM'"), fixed), s1_pocket, "S1")

    record = records.select("uniprot_accession", "entry_id", "sequence", "cif_sha256").withColumn("has_record", F.lit(True))
    found = group.join(record, "uniprot_accession", "left").withColumn("has_record", F.coalesce("has_record", F.lit(False)))
    aligned = mapping.with_site(found.where("has_record").withColumn("alignment", align.aligned(F.col("construct_sequence"), F.col("sequence"))))
    aligned = landed(aligned.withColumn("mapped", mapping.mapping_gate(construct_coverage, identity, site_coverage, site_identity)))
    passed = aligned.where("mapped")
    best = A.longest_chain(predicted_atoms).select(F.col("pdb_id").alias("entry_id"), "entity_id", "asym_id")
    picked_chain = landed(mandatory(passed.select(key, "entry_id"), best, ["entry_id"], "a prediction without a protein chain"))
    chains = picked_chain.select(F.col("entry_id").alias("pdb_id"), "entity_id", "asym_id", F.col(key).alias("__key"))
    s2, s2_pocket = extract(chains, predicted_atoms, mapping.target_names(passed, key), site_coverage)
    mean = A.mean_plddt(A.first_ca(s2_pocket, ["ord"]), ["pdb_id"])
    judged = s2.join(mean, "pdb_id", "left").withColumnRenamed("pdb_id", key).join(picked_chain.select(key, F.col("entity_id").alias("protein_entity_id")), key)
    every = found.select(key, "construct_sha256", "uniprot_accession", "has_record", F.col("entry_id").alias("source_id"), "cif_sha256").join(
        aligned.select(key, "mapped", "site_coverage", "site_identity", "site_map", mapping.metrics().alias("mapping")), key, "left"
    ).join(judged.select(key, "gate", "mean_plddt", "protein_entity_id", F.col("asym_id").alias("protein_asym_id"), "expected_positions", "present_positions", "missing_positions"), key, "left")
    status = mapping.view_status(F.col("has_record"), F.coalesce("mapped", F.lit(False)), F.col("gate"), F.col("mean_plddt"), plddt)
    every = landed(every.withColumn("status", status))

    good = every.where("status = 'eligible'")
    if not good.limit(1).count():
        raise ViewError("no predicted view is eligible")
    own = s2_pocket.join(good.select(F.col(key).alias("pdb_id")), "pdb_id", "left_semi")
    files = files.unionByName(ca_files(_keyed(predicted_atoms.where("group = 'ATOM'"), chains).join(good.select(F.col(key).alias("pdb_id")), "pdb_id", "left_semi"), own, "S2"))
    made = features.pocket_features(own, s2.select("pdb_id", "coverage"), ["pdb_id"]).withColumnRenamed("pdb_id", key)
    view = good.select(
        key, F.col("source_id").alias("structure_id"), F.col("cif_sha256").alias("structure_sha256"), F.col("protein_entity_id").alias("entity_id"), F.col("protein_asym_id").alias("asym_id"),
        F.col("expected_positions").alias("expected"), F.col("present_positions").alias("present"), F.col("missing_positions").alias("missing"),
    ).join(made, key)
    rows = mapping.override(mapping.fixed_rows(views), view, key, "S2", "alphafold_db_predicted_fixed_per_construct", v.FEATURE_NAMES)

    shape = [key, "construct_sha256", "uniprot_accession", "view", "status", "source_id", "protein_entity_id", "protein_asym_id", "site_positions", "site_coverage", "site_identity", "mean_plddt"]
    told1 = group.withColumns(
        {"view": F.lit("S1"), "status": F.lit("eligible"), "source_id": F.col("reference_pdb_id").cast("string"), "protein_entity_id": F.col("reference_protein_entity_id"), "protein_asym_id": F.col("reference_asym_id"),
         "site_positions": F.col("positions"), "site_coverage": F.lit(None).cast("double"), "site_identity": F.lit(None).cast("double"), "mean_plddt": F.lit(None).cast("double")}
    ).select(*shape)
    told2 = every.withColumns({"view": F.lit("S2"), "site_positions": F.col("expected_positions")}).select(*shape)
    return told1.unionByName(told2), rows, files


def view_counts(views: DataFrame) -> dict[str, int]:
    """How many records each view and status has, as view:status; at most as many as there are statuses."""
    return {f"{r['view']}:{r['status']}": r["count"] for r in views.groupBy("view", "status").count().orderBy("view", "status").collect()}


def manifest(kind: str, counts: dict, inputs: dict[str, str], outputs: dict[str, bytes], parameters: dict, now: str | None = None) -> dict:
    """What a build states about itself: counts, parameters, digests of what it read and wrote, and the feature schema.

    inputs are digests by name; outputs are the bytes that are written by name.
    """
    import hashlib

    digest = lambda x: hashlib.sha256(x).hexdigest()
    return {
        "schema_version": 1,
        "kind": kind,
        "created_utc": now or utc_now(),
        "counts": counts,
        "parameters": parameters,
        "inputs": {k: {"sha256": x} for k, x in sorted(inputs.items())},
        "outputs": {k: {"sha256": digest(x), "bytes": len(x)} for k, x in sorted(outputs.items())},
        "feature_schema": list(v.FEATURE_NAMES),
        "feature_schema_sha256": digest("\n".join(v.FEATURE_NAMES).encode()),
        "information_boundary": {"site_definition_reads": "historical reference ligand coordinates only", "query_ligand_coordinates_read": False},
    }


def pocket_counts(views: DataFrame, sites: DataFrame) -> dict[str, int]:
    """Counts for the manifest of pocket views, in two aggregates."""
    tiers = tables.tier_counts(views, "mapping_tier", ["S0", "S1"]).first()
    return {"S0_views": tiers["S0_views"], "S1_views": tiers["S1_views"], "supervised_observations": views.select("observation_id").distinct().count(), "site_definitions": sites.count()}
