"""One uniform cell type, so that results of any schema fit one long table.

A cell is ``struct<kind, num, txt>``. Cells are equal exactly when their values
are: all numbers share the kind ``#`` and keep their value in ``num``, with the
digits in ``txt`` only where a double cannot hold them; texts (s), dates (d),
timestamps (t) and nested values (j) live in ``txt``. NULL and NaN are one cell
of kind ``~``, which sorts after all others.

The kind of a whole column, its ``tag``, also tells floating (f), whole (n),
decimal (m) and boolean (b) numbers apart; it is kept once per result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = "struct<kind:string,num:double,txt:string>"
NUMBER, MISSING = "#", "~"
NUMERIC_TAGS = ("f", "n", "m", "b")
# Nulls of these tags are held as missing floats and differ from each other
# where frames are compared position by position.
UNEQUAL_NULL_TAGS = ("f", "n", "m", "t")
# The relative and absolute tolerance of the subset comparison.
RTOL = 1e-5
ATOL = 1e-8


def tag_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "f"
    if isinstance(dtype, T.IntegralType):
        return "n"
    if isinstance(dtype, T.DecimalType):
        return "m"
    if isinstance(dtype, T.BooleanType):
        return "b"
    if isinstance(dtype, T.DateType):
        return "d"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "t"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "j"
    return "s"


def round_half_even(value: Column, decimals: int | None) -> Column:
    """Round on the scaled value, halves to the even neighbour; 0 or None keeps it."""
    if not decimals:
        return value
    scale = F.lit(10.0 ** decimals)
    return F.rint(value * scale) / scale


def cell_parts(value: Column, dtype: T.DataType, decimals: int | None = None) -> tuple[Column, Column | None, Column | None]:
    """Kind, number and text of a typed column; a part the type never has is None."""
    tag = tag_of(dtype)
    num = txt = None
    if tag == "f":
        num = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
        num = round_half_even(num, decimals) + F.lit(0.0)
    elif tag in ("n", "m"):
        num = value.cast("double")
        if tag == "m" or isinstance(dtype, T.LongType):
            exact = num.try_cast("decimal(20,0)" if tag == "n" else dtype.simpleString()) == value
            txt = F.when(~F.coalesce(exact, F.lit(False)), value.cast("string"))
    elif tag == "b":
        num = value.cast("int").cast("double")
    elif tag == "t":
        txt = F.date_format(value.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif tag == "j":
        txt = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
    elif isinstance(dtype, T.BinaryType):
        txt = F.hex(value)
    else:
        txt = value.cast("string")
    present = num.isNotNull() if num is not None else txt.isNotNull()
    kind = F.when(present, F.lit(NUMBER if tag in NUMERIC_TAGS else tag)).otherwise(F.lit(MISSING))
    return kind, num, txt


def cell(value: Column, dtype: T.DataType, decimals: int | None = None) -> Column:
    """The uniform cell of a typed column."""
    kind, num, txt = cell_parts(value, dtype, decimals)
    return F.struct(
        kind.alias("kind"),
        (F.lit(None).cast("double") if num is None else num).alias("num"),
        (F.lit(None).cast("string") if txt is None else txt).alias("txt"),
    )


def is_missing(c: Column) -> Column:
    return c["kind"] == MISSING


def sort_cell(c: Column, descending: Column) -> Column:
    """A cell that sorts ascending with nulls last.

    With ``descending`` true the null marker comes first, so that reading the
    ascending order backwards gives a descending one with nulls last.
    """
    marker = F.when(~is_missing(c), F.lit(0)).when(descending, F.lit(-1)).otherwise(F.lit(1))
    return F.struct(marker.alias("nul"), c["num"].alias("num"), c["txt"].alias("txt"))


def is_close(a: Column, b: Column) -> Column:
    """Symmetric relative or absolute closeness of two non-null doubles; an infinity is close to itself only."""
    widest = F.greatest(F.abs(a), F.abs(b))
    near = F.abs(a - b) <= F.greatest(F.lit(RTOL) * widest, F.lit(ATOL))
    return (a == b) | ((widest < F.lit(float("inf"))) & near)


def exact_hundredths(value: Column) -> Column:
    """A finite double below 2**53 in hundredths, rounded from its exact binary value, ties to even.

    The fraction times 2**60 is a whole number wherever it can matter (a fraction
    with smaller bits is less than half a hundredth), so decimals hold it exactly.
    """
    scale = 1 << 60
    size = F.abs(value)
    whole = F.floor(size).cast("decimal(38,0)")
    bits = ((size - F.floor(size)) * float(scale)).cast("bigint").cast("decimal(38,0)") * 100
    cents = F.floor(bits / F.lit(scale).cast("decimal(38,0)")).cast("decimal(38,0)")
    cents = F.expr("cast(0 as decimal(38,0))") + cents
    rest = bits - cents * F.lit(scale).cast("decimal(38,0)")
    total = whole * 100 + cents
    up = (rest > scale // 2) | ((rest == scale // 2) & (total % 2 == 1))
    return total + up.cast("int")


def two_decimals(value: Column) -> Column:
    """The text of a double with two decimals, from its exact binary value."""
    cents = exact_hundredths(value)
    sign = F.when(value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("int").cast("string"), 2, "0"))
    odd = F.abs(value) >= float(1 << 53)
    special = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), special).when(odd, F.format_string("%.2f", value)).otherwise(text)


# The 126 bits of two hashes, cut into six parts whose sums cannot overflow a
# BIGINT before 2**42 rows.
_PART_BITS = 21


def content_sums(columns: list[str], prefix: str) -> list[Column]:
    """Six order-free sums that identify the multiset of rows of the named columns."""
    sums = []
    for seed in range(2):
        hashed = f"xxhash64({seed * 7919 + 17}, {', '.join(columns)})"
        for part in range(3):
            piece = f"shiftrightunsigned({hashed}, {part * _PART_BITS}) & {(1 << _PART_BITS) - 1}L"
            sums.append(F.expr(f"coalesce(sum({piece}), 0L) AS {prefix}{seed}{part}"))
    return sums


def digest(columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes that together stand for the named columns of a row.

    Cells hash without ambiguity, as each begins with its kind. Shuffling the
    digest in place of the row keeps the set comparison of wide results narrow.
    """
    return [F.expr(f"xxhash64({seed * 7919 + 17}, {', '.join(columns)}) AS d{seed}") for seed in range(2)]
