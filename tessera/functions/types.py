"""The type lattice: names, kinds, limits, casting and promotion, and the Spark
type that stands for each."""

from __future__ import annotations

import numpy as np

# Types in order of rank, with their size in bytes and the Spark type that holds them.
TYPES = (
    ("bool", 1, "boolean"), ("int8", 1, "tinyint"), ("int16", 2, "smallint"), ("int32", 4, "int"), ("int64", 8, "bigint"),
    ("uint8", 1, "smallint"), ("uint16", 2, "int"), ("uint32", 4, "bigint"), ("uint64", 8, "decimal(20,0)"), ("bigint", 0, "decimal(38,0)"),
    ("float16", 2, "float"), ("float32", 4, "float"), ("float64", 8, "double"), ("longdouble", 16, "double"),
    ("complex64", 8, "struct<re:double,im:double>"), ("complex128", 16, "struct<re:double,im:double>"), ("clongdouble", 32, "struct<re:double,im:double>"),
    ("datetime64", 8, "date"), ("string", 0, "string"), ("unicode", 0, "string"), ("void", 0, "binary"), ("object", 0, "binary"),
)
RANK = {name: k for k, (name, _, _) in enumerate(TYPES)}
CHARS = dict(zip(("bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "longdouble", "complex64", "complex128", "clongdouble", "datetime64", "string", "unicode", "void", "object"), "?bhilBHILefdgFDGMSUVO", strict=True))


def kind(t: str) -> str:
    for prefix, k in (("bool", "b"), ("uint", "u"), ("int", "i"), ("bigint", "i"), ("float", "f"), ("longdouble", "f"), ("complex", "c"), ("clongdouble", "c"), ("datetime", "M")):
        if t.startswith(prefix):
            return k
    return "O"


def dtype_size(t: str) -> int:
    return TYPES[RANK[t]][1]


def spark_type(t: str) -> str:
    return TYPES[RANK[t]][2]


def from_spark(t: str) -> str:
    """The first type that the Spark type stands for."""
    return next(name for name, _, s in TYPES if s == t)


def dtype_is_complex(t: str) -> bool:
    return kind(t) == "c"


def dtype_is_floating(t: str) -> bool:
    return kind(t) == "f"


def dtype_is_integer(t: str) -> bool:
    return kind(t) in "iu"


def dtype_is_signed(t: str) -> bool:
    return kind(t) == "i"


def dtype_is_unsigned(t: str) -> bool:
    return kind(t) == "u"


def dtype_is_bool(t: str) -> bool:
    return t == "bool"


def promote_types(a: str, b: str) -> str:
    """The one of higher rank."""
    return max(a, b, key=RANK.__getitem__)


def result_type(*types: str) -> str:
    return max(types, key=RANK.__getitem__)


find_common_type = common_type = result_type


def can_cast(source: str, target: str, casting: str = "safe") -> bool:
    a, b = kind(source), kind(target)
    if casting in ("no", "equiv"):
        return source == target
    if casting == "unsafe":
        return True
    safe = source == target or source == "bool" or (RANK[target] >= RANK[source] and (a == b or (a in "iu" and b in "fc") or (a, b) == ("u", "i") or (a, b) == ("f", "c")))
    if casting == "safe":
        return safe
    if casting == "same_kind":
        return safe or a == b
    raise ValueError(f"casting {casting!r}")


def min_scalar_type(value: int | float) -> str:
    if isinstance(value, float):
        return "float32" if value != value or float(np.float32(value)) == value else "float64"
    names = ("uint8", "uint16", "uint32", "uint64") if value >= 0 else ("int8", "int16", "int32", "int64")
    return next((t for t in names if np.iinfo(t).min <= value <= np.iinfo(t).max), "bigint")


def issubdtype(t: str, group: str) -> bool:
    groups = {"integer": "iu", "signedinteger": "i", "unsignedinteger": "u", "floating": "f", "complexfloating": "c", "inexact": "fc", "number": "iufc", "bool": "b", "generic": "biufcMO"}
    return kind(t) in groups[group] if group in groups else t == group


def isdtype(t: str, what: str) -> bool:
    names = {"bool": "bool", "signed integer": "signedinteger", "unsigned integer": "unsignedinteger", "integral": "integer", "real floating": "floating", "complex floating": "complexfloating", "numeric": "number"}
    return issubdtype(t, names.get(what, what))


def sctype2char(t: str) -> str:
    return CHARS[t]


def finfo(t: str = "float64"):
    return np.finfo({"longdouble": np.longdouble}.get(t, t))


def iinfo(t: str):
    return np.iinfo(t)


def format_parser(formats: str) -> list[str]:
    """Comma-separated type codes as Spark types: ``f8, i4, S10``."""
    out = []
    for code in (c.strip() for c in formats.split(",")):
        d = np.dtype(code)
        out.append({"f": "float" if d.itemsize <= 4 else "double", "i": "int" if d.itemsize <= 4 else "bigint", "u": "bigint", "b": "boolean", "S": "string", "U": "string", "M": "date", "c": "struct<re:double,im:double>"}[d.kind])
    return out
