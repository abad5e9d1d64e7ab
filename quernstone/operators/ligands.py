"""Relational part of the ligand boundary: strict input, atom mapping and the released vector.

Canonicalisers and encoders are external and injected; what they say is checked here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LigandError
from ..runtime import ship

#: Why a molecule's text is refused, in the order in which it is looked at.
REASONS = ("cxsmiles", "atom_map", "isotope")


def precheck(smiles: Column, extensions: bool = True, maps: bool = True, isotopes: bool = True) -> Column:
    """The first reason to refuse a text, else null: an extension block, an atom with a map number, or one with an isotope.

    Only bracket atoms can carry these; a number 0 says nothing. Text carries no
    conformers, so that check of parsed molecules is the canonicaliser's.
    """
    out = F.when(F.lit(extensions) & F.contains(smiles, F.lit("|")), REASONS[0])
    out = out.when(F.lit(maps) & smiles.rlike(r"\[[^\]]*:0*[1-9][0-9]*\]"), REASONS[1])
    return out.when(F.lit(isotopes) & smiles.rlike(r"\[0*[1-9][0-9]*[A-Za-z*]"), REASONS[2])


def strict(df: DataFrame, column: str, **policy: bool) -> DataFrame:
    """df; a refused text fails the query."""
    reason = precheck(F.col(column), **policy)
    return df.where(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("refused: "), reason)).cast("boolean")))


def output_order(text: Column) -> Column:
    """A list or tuple of integers as text; anything else is null."""
    good = text.rlike(r"^\s*[\[(]\s*(-?[0-9]+\s*(,\s*-?[0-9]+\s*)*,?)?\s*[\])]\s*$")
    return F.when(good, F.transform(F.split(F.regexp_replace(text, r"[\[\]()\s]|,\s*[\])]", ""), ","), lambda x: x.cast("int")))


def identity(prefix: str = "") -> Column:
    """What must agree between an atom and its image: element, charge, isotope, aromaticity."""
    return F.struct(*(F.col(prefix + c) for c in ("atomic_number", "charge", "isotope", "aromatic")))


def mapping_status(molecules: DataFrame, atoms: DataFrame, canonical_atoms: DataFrame, bonds: DataFrame, canonical_bonds: DataFrame) -> DataFrame:
    """(molecule_id, status, canonical_to_input, input_to_canonical) of stated output orders.

    molecules: molecule_id, output_order (text); atoms: molecule_id, index and what
    identity() names; bonds: molecule_id, first, last, type. The first that does not
    hold names the status: order, permutation, atoms, bonds; else mapped.

    All sides grow with the molecules, so joins are sort-merge joins: a shuffled side
    can be small in bytes and still fill the driver as a broadcast table.
    """
    apart = lambda df: df.hint("merge")
    key = "molecule_id"
    n = canonical_atoms.groupBy(key).agg(F.count("*").alias("n"))
    known = molecules.select(key, output_order(F.col("output_order")).alias("to_input")).join(apart(n), key, "left").fillna(0, ["n"])
    whole = (F.size("to_input") == F.col("n")) & (F.array_sort("to_input") == F.when(F.col("n") > 0, F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    known = known.withColumn("whole", F.coalesce(whole, F.lit(False)))
    pairs = known.where("whole").select(key, F.posexplode("to_input").alias("index", "image"))
    image = atoms.select(key, F.col("index").alias("image"), identity().alias("there"))
    wrong = pairs.join(apart(canonical_atoms.select(key, "index", identity().alias("here"))), [key, "index"], "left").join(apart(image), [key, "image"], "left")
    wrong_atoms = wrong.where(~F.col("here").eqNullSafe(F.col("there")) | F.col("there").isNull()).select(key).distinct().withColumn("wrong_atoms", F.lit(True))
    ends = pairs.select(key, F.col("index").alias("first"), F.col("image").alias("a")), pairs.select(key, F.col("index").alias("last"), F.col("image").alias("b"))
    carried = canonical_bonds.select(key, "first", "last", "type").join(apart(ends[0]), [key, "first"]).join(apart(ends[1]), [key, "last"]).select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "type")
    there = bonds.select(key, F.least("first", "last").alias("a"), F.greatest("first", "last").alias("b"), "type")
    wrong_bonds = carried.join(apart(there), [key, "a", "b", "type"], "left_anti").select(key).distinct().withColumn("wrong_bonds", F.lit(True))
    status = F.when(F.col("to_input").isNull(), "order").when(~F.col("whole"), "permutation").when(F.col("wrong_atoms"), "atoms").when(F.col("wrong_bonds"), "bonds").otherwise("mapped")
    back = F.transform(F.array_sort(F.transform("to_input", lambda x, i: F.struct(x.alias("v"), i.alias("i")))), lambda s: s["i"])
    out = known.join(apart(wrong_atoms), key, "left").join(apart(wrong_bonds), key, "left").withColumn("status", status)
    ok = F.col("status") == "mapped"
    return out.select(key, "status", F.when(ok, F.col("to_input")).alias("canonical_to_input"), F.when(ok, back).alias("input_to_canonical"))


def canonical_mapping(smiles: DataFrame, describe: Callable[[str], dict]) -> DataFrame:
    """Atom mappings of (molecule_id, smiles, canonical_smiles) by an injected describer.

    describe(text) gives canonical_smiles, output_order, atoms and bonds of a text; it
    runs on the workers, once for the input and once for the canonical text. A
    canonical text that differs from the accepted one is an error.
    """
    ship(smiles.sparkSession)
    atom = "array<struct<index:int,atomic_number:int,charge:int,isotope:int,aromatic:boolean>>"
    bond = "array<struct<first:int,last:int,type:string>>"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, text, accepted in zip(pdf["molecule_id"], pdf["smiles"], pdf["canonical_smiles"]):
                here = describe(text)
                if here["canonical_smiles"] != accepted:
                    raise LigandError(f"canonical text of {text!r} differs from {accepted!r}")
                there = describe(accepted)
                rows.append((i, here["output_order"], here["atoms"], there["atoms"], here["bonds"], there["bonds"]))
            yield pd.DataFrame(rows, columns=["molecule_id", "output_order", "atoms", "canonical_atoms", "bonds", "canonical_bonds"])

    told = smiles.select("molecule_id", "smiles", "canonical_smiles").mapInPandas(run, f"molecule_id long, output_order string, atoms {atom}, canonical_atoms {atom}, bonds {bond}, canonical_bonds {bond}")
    flat = lambda c: told.select("molecule_id", F.explode(c).alias("x")).select("molecule_id", "x.*")
    return mapping_status(told.select("molecule_id", "output_order"), flat("atoms"), flat("canonical_atoms"), flat("bonds"), flat("canonical_bonds"))


def released_vector(graph: DataFrame, nodes: DataFrame, key: str, mean: list[float], scale: list[float], weight: float) -> DataFrame:
    """(key, vector): the graph's vector followed by the mean of its nodes', calibrated by mean and scale, the second part weighted.

    graph: key, vector; nodes: key, vector. A vector of another length than the
    calibration's, or one that is not finite, fails the query.
    """
    flat = nodes.select(key, F.posexplode("vector").alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p")).select(key, F.transform("p", lambda s: s["x"]).alias("nodes"))
    both = graph.select(key, F.transform("vector", lambda x: x.cast("double")).alias("graph")).join(means, key)
    raw = F.concat("graph", "nodes")
    m, s = (F.array(*(F.lit(float(x)) for x in xs)) for xs in (mean, scale))
    scaled = F.zip_with(F.zip_with(raw, m, lambda x, y: x - y), s, lambda x, y: x / y)
    out = F.transform(scaled, lambda x, i: F.when(i >= F.size("graph"), x * weight).otherwise(x))
    good = (F.size(raw) == len(mean)) & F.forall(out, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return both.select(key, F.when(good, out).otherwise(F.raise_error(F.lit("a released vector breaks its contract")).cast("array<double>")).alias("vector"))


def compared(left: DataFrame, right: DataFrame, key: str, metrics: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Metrics of two encodings (key, canonical_smiles, vector); different canonical texts under one key fail the query."""
    other = right.select(key, F.col("canonical_smiles").alias("__c"), F.col("vector").alias("__v"))
    both = left.join(other, key).where(F.when(F.col("canonical_smiles") == F.col("__c"), F.lit(True)).otherwise(F.raise_error(F.lit("encodings of different molecules")).cast("boolean")))
    return both.select(key, *(x.alias(n) for n, x in metrics(F.col("vector"), F.col("__v")).items()))
