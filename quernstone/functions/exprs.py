"""Column functions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v


def clean_token(c: Column) -> Column:
    return F.when(c.isin(".", "?"), F.lit("")).otherwise(F.coalesce(c, F.lit("")))


def optional_int(c: Column) -> Column:
    """Null for a blank token; any other text that is no integer fails the query."""
    return F.nullif(clean_token(c), F.lit("")).cast("int")


def optional_double(c: Column, blank: float) -> Column:
    return F.coalesce(F.nullif(clean_token(c), F.lit("")).cast("double"), F.lit(blank))


def split_ids(c: Column, sep: str = ";") -> Column:
    """Sorted distinct non-empty parts; an empty list fails the query."""
    parts = F.array_sort(F.array_distinct(F.filter(F.split(c, sep), lambda x: x != "")))
    return F.when(F.size(parts) > 0, parts).otherwise(F.raise_error(F.lit("expected at least one id")).cast("array<string>"))


def distance(*pairs: tuple[Column, Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in pairs[1:]), (pairs[0][0] - pairs[0][1]) * (pairs[0][0] - pairs[0][1])))


def one_letter(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in v.AA3_TO_1.items() for x in kv))
    return F.coalesce(table[name], F.lit("X"))


def three_letter(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in v.AA1_TO_3.items() for x in kv))
    return F.coalesce(table[code], F.lit("UNK"))


def element_class(e: Column) -> Column:
    return F.when(e.isin(*v.ELEMENT_ORDER[:-1]), e).otherwise(F.lit("OTHER"))


def heavy(e: Column = None) -> Column:
    return ~(F.col("element") if e is None else e).isin(*v.HYDROGENS)


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of fixed windows over a sequence of n; the last one ends with the sequence."""
    if not size > overlap >= 0:
        raise ValueError("window size must exceed the overlap, which must not be negative")
    many = F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), n - size, F.lit(size - overlap)), F.array(n - size))))
    return F.when(n <= size, F.array(F.lit(0))).otherwise(many.cast("array<int>"))


def normalised_sequence(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s", ""))


def is_sequence(c: Column) -> Column:
    return c.rlike("^[A-Za-z]+$")


#: Eigenvalues of a symmetric 3 x 3 matrix (xx, yy, zz, xy, xz, yz), largest first, as SQL text over those columns.
EIGEN_STEPS = (
    {"q": "(xx+yy+zz)/3", "p1": "xy*xy+xz*xz+yz*yz"},
    {"p": "sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*p1)/6)"},
    {"r": "CASE WHEN p = 0 THEN 0e0 ELSE greatest(-1e0, least(1e0, ((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*p*p*p))) END"},
    {"e1": "q+2*p*cos(acos(r)/3)", "e3": "q+2*p*cos(acos(r)/3+2*pi()/3)"},
    {"std_large": "sqrt(greatest(e1,0e0))", "std_mid": "sqrt(greatest(3*q-e1-e3,0e0))", "std_small": "sqrt(greatest(e3,0e0))"},
)


def with_eigen(df, steps=EIGEN_STEPS):
    for step in steps:
        df = df.withColumns({k: F.expr(x) for k, x in step.items()})
    return df


def array_metrics(a: Column, b: Column) -> dict[str, Column]:
    """Largest absolute difference, relative L2 and cosine of two arrays; a zero norm gives cosine 1."""
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    x, y = (F.transform(z, lambda t: t.cast("double")) for z in (a, b))
    dot, nx, ny = add(F.zip_with(x, y, lambda p, q: p * q)), F.sqrt(add(F.transform(x, lambda t: t * t))), F.sqrt(add(F.transform(y, lambda t: t * t)))
    diff = F.sqrt(add(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))
    return {
        "exact": a == b,
        "max_abs": F.array_max(F.zip_with(x, y, lambda p, q: F.abs(p - q))),
        "relative_l2": F.when(nx > 0, diff / nx).otherwise(diff),
        "cosine": F.when((nx > 0) & (ny > 0), dot / (nx * ny)).otherwise(F.lit(1.0)),
    }


def inverse_permutation(p: Column) -> Column:
    """Inverse of an array that holds 0..n-1; anything else fails the query."""
    pairs = F.array_sort(F.transform(p, lambda x, i: F.struct(x.cast("int").alias("v"), i.alias("i"))))
    good = F.array_sort(F.transform(p, lambda x: x.cast("int"))) == F.sequence(F.lit(0), F.size(p) - 1)
    return F.when(good, F.transform(pairs, lambda s: s["i"])).otherwise(F.raise_error(F.lit("not a permutation")).cast("array<int>"))
