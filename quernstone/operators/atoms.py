"""Operators on atom tables: (pdb_id, entity_id, asym_id, seq_id, atom_name, alt_id, residue_name, element, x, y, z, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as e
from ..functions import vocab as v
from ..sources.files import landed

CHAIN = ["pdb_id", "entity_id", "asym_id"]


def resolve_altlocs(atoms: DataFrame, order: list[str]) -> DataFrame:
    """One atom of each place: blank alternate first, then occupancy, then the alternate's name, then the source order."""
    place = Window.partitionBy(*CHAIN, "seq_id", "atom_name").orderBy((F.col("alt_id") == "").desc(), F.desc("occupancy"), "alt_id", *order)
    return atoms.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def in_text_order(atoms: DataFrame) -> DataFrame:
    return atoms.orderBy("pdb_id", "entity_id", "asym_id", F.coalesce(F.col("seq_id").cast("string"), F.lit("None")), "atom_name")


def is_protein(entity: str, chains: list[str]) -> Column:
    return e.heavy() & (F.col("entity_id") == entity) & F.col("asym_id").isin(chains) & F.col("seq_id").isNotNull()


def is_ligand(entity: str, chains: list[str], component: str) -> Column:
    return e.heavy() & (F.col("entity_id") == entity) & F.col("asym_id").isin(chains) & (F.col("residue_name") == component)


def is_foreign(entity: str, asym: str) -> Column:
    own = (F.col("entity_id") == entity) & (F.col("asym_id") == asym)
    return ~own & ~F.col("residue_name").isin(*v.WATERS) & e.heavy() & F.col("group").isin("ATOM", "HETATM")


def protein_atoms(atoms: DataFrame, entity: str, chains: list[str]) -> DataFrame:
    return atoms.where(is_protein(entity, chains))


def ligand_atoms(atoms: DataFrame, entity: str, chains: list[str], component: str) -> DataFrame:
    return atoms.where(is_ligand(entity, chains, component))


def foreign_atoms(atoms: DataFrame, entity: str, asym: str) -> DataFrame:
    return atoms.where(is_foreign(entity, asym))


def modal_residues(atoms: DataFrame, by: list[str] = CHAIN) -> DataFrame:
    """The most frequent residue name of each position, the smallest one in ties."""
    return atoms.where("seq_id is not null").groupBy(*by, "seq_id").agg(F.mode("residue_name", True).alias("residue_name"), F.count("*").alias("atoms"))


def near(left: DataFrame, right: DataFrame, on: list[str], cutoff: float, sides: int = 1) -> DataFrame:
    """Pairs of atoms within the cutoff: an equi-join on grid cells and their neighbours, then the exact distance.

    left has x, y, z and right rx, ry, rz; the cost follows the atoms and contacts, not their product.
    A cell is so many cutoffs wide. A right atom goes to the cells that the cutoff reaches from
    its place: up to 27 with one, two on average with eight, which takes less disk and more comparisons.
    """
    cell = lambda p, by=0.0: F.floor((p + by) / (cutoff * sides))
    wide = cutoff * (1 + 1e-9)  # distances are rounded
    reach = lambda a: F.explode(F.sequence(cell(F.col(a), -wide), cell(F.col(a), wide)))
    spread = right
    for a in "xyz":
        spread = spread.withColumn("c" + a, reach("r" + a))
    joined = left.withColumns({"c" + a: cell(F.col(a)) for a in "xyz"}).join(spread, [*on, "cx", "cy", "cz"]).drop("cx", "cy", "cz")
    return joined.withColumn("d", e.distance(*((F.col(a), F.col("r" + a)) for a in "xyz"))).where(F.col("d") <= cutoff)


def contact_pairs(protein: DataFrame, ligand: DataFrame, cutoff: float = v.CONTACT_CUTOFF) -> DataFrame:
    """One row per structure, protein chain and ligand chain: positions in contact, contacts, least distance, ligand atoms."""
    r = ligand.select("pdb_id", F.col("asym_id").alias("ligand_asym_id"), *(F.col(a).alias("r" + a) for a in "xyz"))
    p = protein.select("pdb_id", F.col("asym_id").alias("protein_asym_id"), "seq_id", "x", "y", "z")
    hits = near(p, r, ["pdb_id"], cutoff).groupBy("pdb_id", "protein_asym_id", "ligand_asym_id").agg(
        F.array_sort(F.collect_set("seq_id")).alias("positions"), F.count("*").alias("contact_atom_pairs"), F.min("d").alias("minimum_distance_angstrom")
    )
    pairs = p.select("pdb_id", "protein_asym_id").distinct().join(r.groupBy("pdb_id", "ligand_asym_id").agg(F.count("*").alias("ligand_heavy_atom_count")), "pdb_id")
    out = pairs.join(hits, ["pdb_id", "protein_asym_id", "ligand_asym_id"], "left")
    return out.withColumns({"positions": F.coalesce("positions", F.array().cast("array<int>")), "contact_atom_pairs": F.coalesce("contact_atom_pairs", F.lit(0).cast("long"))})


def pick_site(pairs: DataFrame, minimum: int = v.MINIMUM_RESIDUES) -> DataFrame:
    """The best chain pair of each structure with enough positions."""
    best = Window.partitionBy("pdb_id").orderBy(F.size("positions").desc(), F.desc("contact_atom_pairs"), F.asc_nulls_last("minimum_distance_angstrom"), "protein_asym_id", "ligand_asym_id")
    return pairs.withColumn("__n", F.row_number().over(best)).where((F.col("__n") == 1) & (F.size("positions") >= minimum)).drop("__n")


def pick_chain(atoms: DataFrame, expected: DataFrame, chains: DataFrame) -> DataFrame:
    """For each structure the candidate chain with most positions, fewest mismatches, most atoms, smallest name.

    expected: (pdb_id, seq_id, expected_name); chains: (pdb_id, asym_id) candidates, which stay even without atoms.
    Adds coverage and missing positions, and the first gate that fails: coverage comes before mismatch.
    """
    inside = atoms.where(e.heavy()).join(expected.select("pdb_id", "seq_id"), ["pdb_id", "seq_id"], "left_semi")
    names = modal_residues(inside, ["pdb_id", "asym_id"]).join(expected, ["pdb_id", "seq_id"])
    found = names.groupBy("pdb_id", "asym_id").agg(
        F.count("*").alias("present"), F.sum((e.one_letter(F.col("residue_name")) != e.one_letter(F.col("expected_name"))).cast("long")).alias("mismatches"),
        F.sum("atoms").alias("atoms"), F.array_sort(F.collect_list("seq_id")).alias("present_positions"),
    )
    whole = expected.groupBy("pdb_id").agg(F.array_sort(F.collect_set("seq_id")).alias("expected_positions"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("present", "mismatches", "atoms")}
    all_ = chains.select("pdb_id", "asym_id").distinct().join(whole, "pdb_id").join(found, ["pdb_id", "asym_id"], "left").withColumns(zero)
    best = Window.partitionBy("pdb_id").orderBy(F.desc("present"), "mismatches", F.desc("atoms"), "asym_id")
    one = all_.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    return one.withColumn("missing_positions", F.array_except("expected_positions", F.coalesce("present_positions", F.array().cast("array<int>")))).withColumn("coverage", F.col("present") / F.size("expected_positions"))


def coverage_gate(picked: DataFrame, minimum: float = v.MINIMUM_COVERAGE) -> DataFrame:
    return picked.withColumn("gate", F.when(F.col("coverage") < minimum, "coverage").when(F.col("mismatches") > 0, "mismatch").otherwise("pass"))


def longest_chain(atoms: DataFrame) -> DataFrame:
    n = atoms.groupBy(*CHAIN).agg(F.count_distinct(F.when((F.col("atom_name") == "CA") & (F.col("group") == "ATOM"), F.col("seq_id"))).alias("positions")).where("positions > 0")
    best = Window.partitionBy("pdb_id").orderBy(F.desc("positions"), "entity_id", "asym_id")
    return n.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def first_ca(atoms: DataFrame, order: list[str]) -> DataFrame:
    first = Window.partitionBy(*CHAIN, "seq_id").orderBy(*order)
    return atoms.where("atom_name = 'CA' and seq_id is not null").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def mean_plddt(ca: DataFrame, by: list[str]) -> DataFrame:
    return ca.groupBy(*by).agg(F.coalesce(F.avg(F.when(~F.isnan("b_factor") & (F.abs("b_factor") < float("inf")), F.col("b_factor"))), F.lit(float("nan"))).alias("mean_plddt"))


def pdb_lines(ca: DataFrame) -> DataFrame:
    """CA-only records of each chain, renumbered from 1 in chain A; a B-factor that is not finite is written as 0."""
    n = F.row_number().over(Window.partitionBy(*CHAIN).orderBy("seq_id")).alias("serial")
    b = F.when(F.isnan("b_factor") | (F.abs("b_factor") == float("inf")), 0.0).otherwise(F.col("b_factor"))
    fixed = {a: F.bround(a, 3) for a in "xyz"} | {"occupancy": F.bround("occupancy", 2), "b_factor": F.bround(b, 2)}
    line = F.format_string("ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f           C", "serial", F.substring("residue_name", 1, 3), "serial", "x", "y", "z", "occupancy", "b_factor")
    return ca.select("*", n).withColumns(fixed).select(*CHAIN, "serial", line.alias("line"))


def least_foreign_distance(pocket: DataFrame, foreign: DataFrame, by: list[str], radius: float, rounds: int = 12) -> DataFrame:
    """Least distance and number of foreign atoms of each pocket; unoccupied if there are none or none is nearer than the radius.

    The least distance itself is reported even beyond the radius. Pockets look for
    neighbours by grid cells; those that find none look again at twice the distance.
    What is left after the rounds (4,096 times the radius) is compared in full. Each
    round reads the foreign atoms of the structures that are left.
    """
    f = landed(foreign.select(*by, *(F.col(a).alias("r" + a) for a in "xyz")))
    own = landed(pocket.select(*by, "x", "y", "z"))
    n = f.groupBy(*by).agg(F.count("*").alias("foreign"))
    found, left, reach = None, own.join(n.select(*by), by, "left_semi"), float(radius)
    for k in range(rounds + 1):
        if k < rounds:
            pairs = near(left, f, by, reach, 8)
        else:
            pairs = left.join(f, by).withColumn("d", e.distance(*((F.col(a), F.col("r" + a)) for a in "xyz")))
        got = landed(pairs.groupBy(*by).agg(F.min("d").alias("minimum")))
        found = got if found is None else found.unionByName(got)
        left, reach = landed(left.join(got, by, "left_anti")), reach * 2
        if not left.limit(1).count():
            break
        f = f.join(left.select(*by).distinct(), by, "left_semi")
    out = own.select(*by).distinct().join(n, by, "left").join(found, by, "left").withColumn("foreign", F.coalesce("foreign", F.lit(0).cast("long")))
    return out.withColumn("unoccupied", F.col("minimum").isNull() | (F.col("minimum") >= radius))


def dense_backbone(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Every position from the first to the last with its N, CA and C places, or gaps."""
    inside = atoms.where("group = 'ATOM' and seq_id is not null and atom_name in ('N', 'CA', 'C')")
    place = {n: F.max(F.when(F.col("atom_name") == n, F.struct("x", "y", "z"))).alias(n) for n in ("N", "CA", "C")}
    got = inside.groupBy(*by, "seq_id").agg(*place.values())
    span = got.groupBy(*by).agg(F.min("seq_id").alias("lo"), F.max("seq_id").alias("hi")).select(*by, F.explode(F.sequence("lo", "hi")).alias("seq_id"))
    out = span.join(got, [*by, "seq_id"], "left")
    return out.withColumn("complete", F.col("N").isNotNull() & F.col("CA").isNotNull() & F.col("C").isNotNull())


def chain_atoms(atoms: DataFrame, entity: str, asym: str) -> DataFrame:
    """ATOM records of one chain, whatever their element."""
    return atoms.where((F.col("entity_id") == entity) & (F.col("asym_id") == asym) & (F.col("group") == "ATOM"))


def site_backbone(backbone: DataFrame, sites: DataFrame, by: list[str], minimum: float = 0.0) -> DataFrame:
    """Sites on a dense backbone, positions kept in the order in which a site lists them.

    sites: by and positions (array). Adds the listed positions that the chain has and
    that are complete, and their share of all listed ones; a site that touches no
    position of its chain, or whose share is below the minimum, fails the query.
    """
    listed = sites.select(*by, F.posexplode("positions").alias("place", "seq_id"))
    inside = listed.join(backbone.select(*by, "seq_id", "complete"), [*by, "seq_id"])
    got = inside.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("complete"), F.struct("place", "seq_id")))).alias("p"))
    rows = backbone.groupBy(*by).agg(F.min("seq_id").alias("first"), F.max("seq_id").alias("last"), F.count("*").alias("rows"), F.count_if("complete").alias("complete_rows"))
    out = sites.join(got, by, "left").join(rows, by, "left").withColumn("complete_positions", F.transform("p", lambda x: x["seq_id"]))
    share = F.size("complete_positions") / F.size("positions")
    good = F.col("p").isNotNull() & (share >= minimum)
    return out.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("too little of a site has a backbone")).cast("boolean"))).withColumn("complete_fraction", share).drop("p")


def centred(backbone: DataFrame, by: list[str], atoms: tuple[str, ...] = ("N", "CA", "C")) -> DataFrame:
    """Backbone places moved so that the mean of those that are there is the origin, rounded half to even at 4 places, as floats.

    The 10,000fold is rounded, which is what array libraries do; a decimal rounding differs where a value ends in a 5.
    """
    flat = backbone.select(*by, "seq_id", F.explode(F.array(*(F.struct(F.lit(a).alias("atom"), F.col(a).alias("p")) for a in atoms))).alias("a")).select(*by, "seq_id", "a.atom", "a.p.*")
    centre = flat.groupBy(*by).agg(*(F.avg(a).alias("m" + a) for a in "xyz"))
    return flat.join(centre, by).select(*by, "seq_id", "atom", *((F.rint((F.col(a) - F.col("m" + a)) * 10000) / 10000).cast("float").alias(a) for a in "xyz"))


def moved(points: DataFrame, rotation: list[list[float]], shift: list[float]) -> DataFrame:
    """Points turned and shifted."""
    return points.withColumns({a: sum((F.lit(float(r)) * F.col(b) for r, b in zip(row, "xyz")), F.lit(float(t))) for a, row, t in zip("xyz", rotation, shift)})
