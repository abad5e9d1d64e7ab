"""mmCIF atom tables: plain or gzip files to rows."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContractError
from ..functions import exprs as e
from ..functions.vocab import ATOM_TAGS
from ..runtime import ship

_TOKEN = re.compile(r"""'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|"((?:[^"\n]|"(?=\S))*)"(?=\s|$)|(#[^\n]*)|([^\s]+)""")


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, was quoted) of a file; lines that begin with ; hold a text block."""
    block: list[str] | None = None
    for line in text.splitlines():
        if line.startswith(";"):
            if block is None:
                block = [line[1:]]
                continue
            yield "\n".join(block), True
            block, line = None, line[1:]
        if block is not None:
            block.append(line)
            continue
        for m in _TOKEN.finditer(line):
            if m[3] is None:
                yield (m[4], False) if m[4] is not None else (m[1] if m[1] is not None else m[2], True)
    if block is not None:
        raise ContractError("a text block does not end")


def atom_rows(content: bytes) -> list[list[str]]:
    """The 16 columns of the only data block's atom loop, as text; a column that is not there is blank."""
    try:
        text = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode()
    except (OSError, EOFError, zlib.error, UnicodeDecodeError) as error:
        raise ContractError(f"a structure file is damaged: {error}") from error
    names: list[str] = []
    rows: list[list[str]] = []
    state, blocks, row = "", 0, []
    wanted = ["_atom_site." + t.lower() for t in ATOM_TAGS]
    for token, quoted in tokens(text):
        low = token.lower()
        if not quoted and low.startswith("data_"):
            blocks += 1
            state = ""
        elif not quoted and low == "loop_":
            state, names, row = "names", [], []
        elif not quoted and token.startswith("_") and state in ("names", ""):
            if state == "names":
                names.append(low)
        elif not quoted and token.startswith("_"):
            state = ""
        elif state in ("names", "values"):
            state = "values"
            if names and names[0].startswith("_atom_site."):
                row.append(token)
                if len(row) == len(names):
                    rows.append([row[names.index(w)] if w in names else "." for w in wanted])
                    row = []
    if blocks != 1:
        raise ContractError(f"{blocks} data blocks; one is expected")
    if not rows:
        raise ContractError("no atom rows")
    return rows


_RAW = ", ".join(f"`{t}` string" for t in ATOM_TAGS)


def read_atoms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ord, atom columns) of model 1 of each file; land the result as Parquet before repeated use."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                out = pd.DataFrame(atom_rows(bytes(content)), columns=list(ATOM_TAGS))
                out.insert(0, "ord", range(len(out)))
                out.insert(0, "path", path)
                yield out

    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    raw = files.mapInPandas(run, f"path string, ord long, {_RAW}")
    c = F.col
    return raw.where(e.clean_token(c("pdbx_PDB_model_num")).isin("", "1")).select(
        "path", "ord", c("group_PDB").alias("group"), F.upper("type_symbol").alias("element"), c("label_atom_id").alias("atom_name"),
        e.clean_token(c("label_alt_id")).alias("alt_id"), F.upper("label_comp_id").alias("residue_name"), c("label_asym_id").alias("asym_id"), c("label_entity_id").alias("entity_id"),
        e.optional_int(c("label_seq_id")).alias("seq_id"), *(c(f"Cartn_{a}").cast("double").alias(a) for a in "xyz"),
        e.optional_double(c("occupancy"), 1.0).alias("occupancy"), e.optional_double(c("B_iso_or_equiv"), float("nan")).alias("b_factor"),
        e.clean_token(c("auth_asym_id")).alias("auth_asym_id"), e.clean_token(c("auth_seq_id")).alias("auth_seq_id"),
    )
