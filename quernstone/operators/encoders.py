"""Boundary to external programs: encoders, the structural aligner, their identity and their audits.

An encoder is made by an injected factory, once for each Python worker, so that a model
is loaded once and batches stream through it.
"""

from __future__ import annotations

import importlib.util
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import EncoderError, ViewError, finite_array
from ..functions import exprs as e
from ..runtime import ship
from .tables import global_rank, overlap_average_vectors


def windows(sequences: DataFrame, size: int, overlap: int, sequence: str = "sequence") -> DataFrame:
    """One row for each window of each sequence: start and segment; the windows cover every residue."""
    starts = e.window_starts(F.length(sequence), size, overlap)
    return sequences.withColumn("start", F.explode(starts)).withColumn("segment", F.substring(F.col(sequence), F.col("start") + 1, F.lit(size)))


def states(segments: DataFrame, key: str, factory: Callable[[], Callable[[str], np.ndarray]], dim: int) -> DataFrame:
    """(key, start, states array<array<double>>) of the segments, by an encoder that gives one row of dim numbers a residue."""
    ship(segments.sparkSession)
    kind = segments.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        encode = factory()
        for pdf in batches:
            out = []
            for text in pdf["segment"]:
                x = np.asarray(encode(text), np.float64)
                if x.shape != (len(text), dim):
                    raise EncoderError(f"states of shape {x.shape} for {len(text)} residues")
                if not np.isfinite(x).all():
                    raise EncoderError("states that are not finite")
                out.append(x.tolist())
            yield pd.DataFrame({key: pdf[key], "start": pdf["start"], "states": out})

    return segments.select(key, "start", "segment").mapInPandas(run, f"{key} {kind}, start int, states array<array<double>>")


def encode_sequences(sequences: DataFrame, key: str, factory: Callable[[], Callable[[str], np.ndarray]], dim: int, size: int, overlap: int) -> DataFrame:
    """(key, vector): residues of several windows are averaged first, then all residues with equal weight."""
    out = overlap_average_vectors(states(windows(sequences, size, overlap), key, factory, dim), [key])
    return out.withColumn("vector", finite_array("vector", dim))


def encode_structures(sites: DataFrame, backbone: DataFrame, by: list[str], factory: Callable[[], Callable[[np.ndarray], np.ndarray]], dim: int) -> DataFrame:
    """(by, pooled): states of the listed site positions, as mean and population deviation of each component.

    backbone: by, seq_id, atom, x, y, z, centred; sites: by, complete_positions. One
    structure is one group; its coordinates fit a task.
    """
    import pandas as pd

    ship(backbone.sparkSession)
    names = ("N", "CA", "C")
    both = backbone.join(sites.select(*by, "complete_positions"), by)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        encode = factory()
        at = {p: i for i, p in enumerate(sorted(set(pdf["seq_id"])))}
        xyz = np.full((len(at), 3, 3), np.nan, np.float32)
        for p, a, x, y, z in zip(pdf["seq_id"], pdf["atom"], pdf["x"], pdf["y"], pdf["z"]):
            xyz[at[p], names.index(a)] = (x, y, z)
        out = np.asarray(encode(xyz), np.float64)
        if out.shape != (len(at), dim):
            raise EncoderError(f"states of shape {out.shape} for {len(at)} positions")
        own = out[[at[p] for p in pdf["complete_positions"].iloc[0]]]
        pooled = np.concatenate([own.mean(0), own.std(0)])
        if not np.isfinite(pooled).all():
            raise EncoderError("a pooled vector that is not finite")
        return pd.DataFrame([[*key, pooled.tolist()]], columns=[*by, "pooled"])

    kinds = ", ".join(f"{c} {backbone.schema[c].dataType.simpleString()}" for c in by)
    return both.groupBy(*by).applyInPandas(run, f"{kinds}, pooled array<double>")


def encode_ligands(molecules: DataFrame, key: str, text: str, factory: Callable[[], Callable[[str], tuple[list[float], list[list[float]]]]]) -> tuple[DataFrame, DataFrame]:
    """(graph, nodes) vectors of molecules by an encoder that gives a graph's vector and one for each atom; see ligands.released_vector."""
    ship(molecules.sparkSession)
    kind = molecules.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        encode = factory()
        for pdf in batches:
            got = [encode(x) for x in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "vector": [list(g) for g, _ in got], "nodes": [[list(v) for v in n] for _, n in got]})

    out = molecules.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>, nodes array<array<double>>")
    return out.select(key, "vector"), out.select(key, F.explode("nodes").alias("vector"))


def length_figures(sequences: DataFrame, size: int, sequence: str = "sequence") -> DataFrame:
    """One row: least and largest length, and how many sequences take several windows."""
    n = F.length(sequence)
    return sequences.agg(F.min(n).cast("long").alias("minimum_length"), F.max(n).cast("long").alias("maximum_length"), F.count_if(n > size).alias("multi_window"))


def panel(df: DataFrame, key: str) -> DataFrame:
    """The first, middle and last row by a unique key, which an audit encodes again."""
    n = df.count()
    return global_rank(df, key).where(F.col("rank").isin(sorted({0, n // 2, n - 1})))


def largest_delta(a: Column, b: Column) -> Column:
    """Largest absolute difference of two arrays of one length; else the query fails."""
    d = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), F.coalesce(d, F.lit(0.0))).otherwise(F.raise_error(F.lit("arrays of different length")).cast("double"))


def audit(checks: dict[str, Column]) -> list[Column]:
    """The checks as columns, unknown ones as failed, and PASS or FAIL."""
    known = {k: F.coalesce(x, F.lit(False)) for k, x in checks.items()}
    whole = F.lit(True)
    for x in known.values():
        whole = whole & x
    return [*(x.alias(k) for k, x in known.items()), F.when(whole, "PASS").otherwise("FAIL").alias("verdict")]


def identity_violations(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(name, expected, observed) of pinned values that differ or are not there; values are compared as text."""
    e_, o = expected.selectExpr("name", "cast(value as string) as expected"), observed.selectExpr("name", "cast(value as string) as observed")
    return e_.join(o, "name", "left").where(~F.col("expected").eqNullSafe(F.col("observed")) | F.col("observed").isNull())


def require_identity(expected: dict, observed: dict) -> None:
    """Pinned revision, clean tree, file digests, dimensions and steps of a model; any difference is an error."""
    bad = {k: (v, observed.get(k)) for k, v in expected.items() if k not in observed or observed[k] != v}
    if bad:
        raise EncoderError(f"model identity differs: {bad}")


def source_revision(root: str | Path, watched: tuple[str, ...] = ()) -> tuple[str, bool]:
    """(revision, whether watched files differ from it) of a checked-out source."""
    try:
        say = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, text=True).stdout.strip()
        return say("rev-parse", "HEAD"), bool(say("status", "--porcelain", "--untracked-files=no", "--", *watched))
    except (OSError, subprocess.CalledProcessError) as error:
        raise EncoderError(f"no revision of {root}: {error}") from error


def load_plugin(root: str | Path, relative: str, name: str):
    """A module from a pinned source tree; a file outside of it, or a name that is taken by another file, is an error."""
    root = Path(root).resolve()
    path = (root / relative).resolve()
    if not path.is_relative_to(root) or not path.is_file():
        raise EncoderError(f"{relative} is not in {root}")
    held = sys.modules.get(name)
    if held is not None:
        if Path(getattr(held, "__file__", "") or "").resolve() != path:
            raise EncoderError(f"{name} is loaded from elsewhere")
        return held
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    try:
        spec.loader.exec_module(module)
    except BaseException:
        del sys.modules[name]
        raise
    return module


#: Fields of the aligner's table, by their place from the third on.
ALIGNER_FIELDS = ("tm_1", "tm_2", "rmsd", "identity_1", "identity_2", "identity_aligned", "length_1", "length_2", "aligned")


def aligner_row(df: DataFrame, column: str = "stdout") -> DataFrame:
    """Add the figures of the last line that is no comment: fields between tabs, or between white space if there are too few.

    Output without such a line, or with fewer than 11 fields, fails the query.
    """
    lines = F.filter(F.split(column, r"\r\n|\n|\r"), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(F.raise_error(F.lit("the aligner gave no row")).cast("string"))
    tabs, spaces = F.split(last, "\t"), F.split(F.trim(F.regexp_replace(last, r"\s+", " ")), " ")
    fields = F.when(F.size(tabs) >= 11, tabs).when(F.size(spaces) >= 11, spaces).otherwise(F.raise_error(F.concat(F.lit("unexpected aligner output: "), last)).cast("array<string>"))
    out = df.withColumn("__f", fields)
    kinds = ["double"] * 6 + ["int"] * 3
    return out.withColumns({n: F.trim(F.col("__f")[i + 2]).cast(k) for i, (n, k) in enumerate(zip(ALIGNER_FIELDS, kinds))}).withColumn("fields", F.size("__f")).drop("__f")


def run_aligner(jobs: DataFrame, command: Callable[[str, str, str], list[str]], timeout: float = 180.0) -> DataFrame:
    """Jobs (left_path, right_path, mode, other columns) with the aligner's figures and the digest of what it said.

    command(left, right, mode) is the program's call; it runs on the workers, which
    need the program and the files. A call that fails or takes too long fails the job.
    """
    ship(jobs.sparkSession)
    schema = StructType([*jobs.schema.fields, StructField("stdout", StringType())])

    def run(batches):
        for pdf in batches:
            said = []
            for left, right, mode in zip(pdf["left_path"], pdf["right_path"], pdf["mode"]):
                try:
                    said.append(subprocess.run(command(left, right, mode), check=True, capture_output=True, text=True, timeout=timeout).stdout)
                except (OSError, subprocess.SubprocessError) as error:
                    raise ViewError(f"the aligner failed on {left} and {right}: {error}") from error
            yield pdf.assign(stdout=said)

    return aligner_row(jobs.mapInPandas(run, schema)).withColumn("stdout_sha256", F.sha2("stdout", 256)).drop("stdout")
