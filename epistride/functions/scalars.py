"""Row-level expressions; each one stays inside generated JVM code.

A value that breaks its contract becomes null, so a caller can count the nulls
as violations or reject them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistride.columns import named

INFINITY = float("inf")


def strict_bool(value: Column) -> Column:
    """Boolean or numeric flag that is exactly 0 or 1."""
    number = value.cast("double")
    return F.when(number == 1, F.lit(True)).when(number == 0, F.lit(False))


def strict_bool_token(token: Column) -> Column:
    """The same for the text of a JSON value; quoted strings are refused."""
    number = F.when(token.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), token).cast("double")
    return (
        F.when(token == "true", F.lit(True))
        .when(token == "false", F.lit(False))
        .when(number == 1, F.lit(True))
        .when(number == 0, F.lit(False))
    )


def strict_long(value: Column) -> Column:
    """A number that is finite and exactly an integer; integers pass unchanged."""
    whole = value.try_cast("long")
    return F.when(value == whole, whole)


def strict_long_token(token: Column) -> Column:
    """Integer keys written as text."""
    return F.when(F.trim(token).rlike(r"^[+-]?\d+$"), F.trim(token)).try_cast("long")


def strict_long_number(token: Column) -> Column:
    """The integer that a JSON number's text stands for, however it is written."""
    return strict_long(token.try_cast("decimal(38,12)"))


def is_finite(value: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(INFINITY)), F.lit(False))


def all_finite(values: Column) -> Column:
    return F.coalesce(F.forall(values, is_finite), F.lit(False))


def only_element(values: Column) -> Column:
    """The element of a one-element array."""
    return F.when(F.size(values) == 1, F.get(values, 0))


def clean_text(text: Column) -> Column:
    """Text without surrounding white space; null when nothing is left."""
    stripped = F.regexp_replace(text.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(stripped) > 0, stripped)


def clean_task(df: DataFrame, name: str) -> Column:
    """One instruction from a string, binary or one-element array column."""
    kind = df.schema[name].dataType
    value = named(name)
    if isinstance(kind, T.ArrayType):
        value, kind = only_element(value), kind.elementType
    if isinstance(kind, T.BinaryType):
        value = F.decode(value, "UTF-8")
    return clean_text(value)


def scalar_cell(df: DataFrame, name: str) -> Column:
    """A cell that must hold one value, stored bare or as a one-element array."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return only_element(named(name))
    return named(name)


def canonical_return(df: DataFrame, name: str) -> Column:
    """Return target as one float per frame."""
    return scalar_cell(df, name).cast("float")


def clip(value: Column, low: float, high: float) -> Column:
    # greatest and least skip nulls, so a null must be kept out of them.
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def affine(value: Column, low: Column, high: Column, to_low: float = -1.0, to_high: float = 1.0) -> Column:
    """Map [low, high] to [to_low, to_high]; a collapsed range gives zero."""
    spread = high - low
    scaled = F.lit(to_low) + F.lit(to_high - to_low) * (value - low) / spread
    return F.when(value.isNull(), F.lit(None).cast("double")).when(spread < 1e-8, F.lit(0.0)).otherwise(scaled)


def is_close(left: Column, right: Column, tolerance: float) -> Column:
    return F.abs(left - right) <= F.lit(tolerance)


def positive_or_null(value: Column) -> Column:
    return F.when(is_finite(value) & (value > 0), value)


def first_positive(*candidates: Column) -> Column:
    """First positive finite candidate."""
    return F.coalesce(*[positive_or_null(c.cast("double")) for c in candidates])


def standardise(values: Column, mean: Column, std: Column) -> Column:
    """Per-dimension ``(x - mean) / std``; null when dimensions differ."""
    centred = F.zip_with(values, mean, lambda x, m: x - m)
    scaled = F.zip_with(centred, std, lambda x, s: x / s)
    return F.when((F.size(values) == F.size(mean)) & (F.size(mean) == F.size(std)), scaled)


def squared_distance(left: Column, right: Column) -> Column:
    """Sum of squared differences over the dimensions of two vectors."""
    pairs = F.zip_with(left, right, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def sample_id(episode: Column, frame: Column) -> Column:
    return F.concat_ws(":", episode.cast("string"), frame.cast("string"))


def chunk_of(ordinal: Column, files: int = 1000) -> Column:
    return F.floor(ordinal / F.lit(files)).cast("long")


def file_of(ordinal: Column, files: int = 1000) -> Column:
    return F.pmod(ordinal, F.lit(files)).cast("long")


def shard_path(kind: str, chunk: Column, file: Column, suffix: str) -> Column:
    return F.format_string(f"{kind}/chunk-%03d/file-%03d.{suffix}", chunk, file)


def episode_path(pattern: str, episode: Column) -> Column:
    """Fill ``{episode_id}`` or ``{episode_id:0Nd}`` in a path pattern."""
    import re

    pieces = re.split(r"(\{episode_id(?::0?\d+d)?\})", pattern)
    filled = []
    for piece in pieces:
        if piece.startswith("{episode_id"):
            width = re.search(r":0?(\d+)d", piece)
            filled.append(F.format_string(f"%0{width.group(1)}d" if width else "%d", episode))
        elif "{" in piece or "}" in piece:
            raise ValueError(f"unknown field in path pattern {pattern!r}")
        elif piece:
            filled.append(F.lit(piece))
    return F.concat(*filled)


def json_safe(df: DataFrame) -> DataFrame:
    """Replace every non-finite number, nested ones too, by null."""
    return df.select(
        *[_json_safe(named(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def _json_safe(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(is_finite(value), value)
    if isinstance(kind, T.ArrayType) and _has_float(kind.elementType):
        return F.transform(value, lambda item: _json_safe(item, kind.elementType))
    if isinstance(kind, T.MapType) and _has_float(kind.valueType):
        return F.transform_values(value, lambda _, item: _json_safe(item, kind.valueType))
    if isinstance(kind, T.StructType) and _has_float(kind):
        fields = [_json_safe(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_float(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_float(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_float(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))
