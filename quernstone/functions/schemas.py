"""The record types of the data model, and how a table is held to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from ..errors import ContractError
from . import vocab as v


def _type(**columns: DataType) -> StructType:
    """A record type; no text is parsed, as that takes a session, which an import on a driver or worker has not."""
    return StructType([StructField(n, t) for n, t in columns.items()])


_S, _I, _L, _D = StringType(), IntegerType(), LongType(), DoubleType()
_IS, _DS, _SS = ArrayType(_I), ArrayType(_D), ArrayType(_S)

ATOM = _type(
    pdb_id=_S, entity_id=_S, asym_id=_S, seq_id=_I, atom_name=_S, alt_id=_S, residue_name=_S, element=_S, group=_S, occupancy=_D, b_factor=_D,
    x=_D, y=_D, z=_D, auth_asym_id=_S, auth_seq_id=_S, ord=_L,
)
POCKET = _type(
    pdb_id=_S, entity_id=_S, asym_id=_S, expected_positions=_IS, present_positions=_IS, missing_positions=_IS, coverage=_D, expected_names=MapType(_I, _S), present_names=MapType(_I, _S),
)
CONSTRUCT = _type(group_id=_S, construct_sha256=_S, sequence=_S)
ATOM_MAPPING = _type(canonical_to_input=_IS, input_to_canonical=_IS, input_atom_symbols=_SS, canonical_atom_symbols=_SS)
ENCODING = _type(
    input_smiles=_S, canonical_smiles=_S, molecule_hash=_S, canonical_to_input=_IS, node_features=ArrayType(_DS), edge_index=ArrayType(_IS), edge_features=ArrayType(_DS),
    node_vectors=ArrayType(_DS), graph_vector=_DS, released_vector=_DS, provenance=MapType(_S, _S),
)
FILE = _type(source_id=_S, path=_S, bytes=_L, sha256=_S)
FEATURES = _type(**{n: _D for n in v.FEATURE_NAMES})


def conform(df: DataFrame, schema: StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns of a record type in its order and types; others go.

    A column that is missing and not optional is an error; a value that cannot be
    cast fails the query.
    """
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in optional]
    if missing:
        raise ContractError(f"columns are missing: {missing}")
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
