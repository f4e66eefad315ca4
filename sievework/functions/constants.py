"""Integer constants and 64-bit arithmetic of conditions, as column expressions. Null means an error or an unknown value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer(text: Column) -> Column:
    """Value of a hexadecimal (0x), octal (0...) or decimal constant with u and l suffixes; null above 63 bits or if it is none."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "(u|l|ul|lu|ull|llu|ll)$", "")
    in_base = lambda digits, base, most: F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= most, F.conv(digits, base, 10).try_cast("long"))
    return (
        F.when(F.rlike(bare, F.lit("^0x[0-9a-f]+$")), in_base(F.substring(bare, 3, 64), 16, 16))
        .when(F.rlike(bare, F.lit("^0[0-7]*$")), in_base(bare, 8, 21))
        .when(F.rlike(bare, F.lit("^[1-9][0-9]*$")), bare.try_cast("long"))
    )


#: What the escape letters of character constants stand for.
ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "\\": 92, "'": 39, '"': 34, "?": 63}


def character(text: Column) -> Column:
    """Value of a character constant 'x': one or more bytes, packed from the left; a single byte is signed, four or fewer make an int."""
    body = F.regexp_extract(F.trim(text), r"^'(.+)'$", 1)
    parts = F.regexp_extract_all(body, F.lit(r"(\\x[0-9a-fA-F]{1,2}|\\[0-7]{1,3}|\\.|[^\\])"), F.lit(1))
    named = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])
    byte = lambda p: (
        F.when(F.startswith(p, F.lit("\\x")), F.conv(F.substring(p, 3, 8), 16, 10).cast("long"))
        .when(F.rlike(p, F.lit(r"^\\[0-7]")), F.conv(F.substring(p, 2, 8), 8, 10).cast("long") % 256)
        .when(F.startswith(p, F.lit("\\")), F.element_at(named, F.substring(p, 2, 1)).cast("long"))
        .otherwise(F.ascii(p).cast("long"))
    )
    packed = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: (a * 256 + byte(p)) % (1 << 32))
    signed = F.when(F.size(parts) == 1, F.when(packed > 127, packed - 256).otherwise(packed)).otherwise(F.when(packed >= 1 << 31, packed - (1 << 32)).otherwise(packed))
    return F.when((body != "") & (F.array_join(parts, "") == body), signed)


def unary(operator: str, value: Column) -> Column:
    if operator == "-":
        return F.try_subtract(F.lit(0).cast("long"), value)
    return {"+": value, "~": F.bitwise_not(value), "!": (value == 0).cast("long")}[operator]


def binary(operator: str, a: Column, b: Column) -> Column:
    """Signed 64-bit results; null on overflow, for a zero divisor, and for a null side."""
    least = F.lit(-(1 << 63)).cast("long")
    compared = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
    if operator in compared:
        return compared[operator].cast("long")
    if operator in ("/", "%"):
        fine = (b != 0) & ~((a == least) & (b == -1))
        x, y = F.when(fine, a), F.when(fine, b)
        whole = F.call_function("div", x, F.coalesce(y, F.lit(1).cast("long")))
        return whole if operator == "/" else x - whole * y
    return {
        "+": lambda: F.try_add(a, b), "-": lambda: F.try_subtract(a, b), "*": lambda: F.try_multiply(a, b),
        "&": lambda: a.bitwiseAND(b), "|": lambda: a.bitwiseOR(b), "^": lambda: a.bitwiseXOR(b),
    }[operator]()


def shift(left: Column, count: Column, to_left: bool = True) -> Column:
    """Arithmetic shifts: a negative count turns the direction, a right shift of 63 or more leaves the sign, a left shift that loses bits is null."""
    by = F.when(F.lit(to_left), count).otherwise(-count)
    right = F.call_function("shiftright", left, F.least(-by, F.lit(63)).cast("int"))
    moved = F.call_function("shiftleft", left, F.least(by, F.lit(63)).cast("int"))
    fits = (by < 64) & (F.call_function("shiftright", moved, F.least(by, F.lit(63)).cast("int")) == left)
    return F.when(by <= 0, right).when(left == 0, F.lit(0).cast("long")).when(fits, moved)


def based_value(digits: Column, base: Column) -> Column:
    """Value of digits in base b, o, d or h; null if they hold x, z or ? or anything else that is no digit."""
    bare = F.lower(F.replace(digits, F.lit("_"), F.lit("")))
    of = lambda pattern, number: F.when(F.rlike(bare, F.lit(pattern)), F.conv(bare, number, 10).try_cast("long"))
    return F.when(F.lower(base) == "b", of("^[01]{1,63}$", 2)).when(F.lower(base) == "o", of("^[0-7]{1,20}$", 8)).when(F.lower(base) == "h", of("^[0-9a-f]{1,15}$", 16)).when(F.lower(base) == "d", bare.try_cast("long"))


def sized_constant(text: Column) -> Column:
    """(value, width) of a constant like 4'b1010 or 12: width null without a size, value null if it is not constant."""
    t = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    size, base, digits = (F.regexp_extract(t, r"^([0-9]*)'[sS]?([bBoOdDhH])([0-9a-fA-FxXzZ?]+)$", i) for i in (1, 2, 3))
    plain = F.when(F.rlike(t, F.lit("^[0-9]+$")), t.try_cast("long"))
    return F.struct(F.when(base != "", based_value(digits, base)).otherwise(plain).alias("value"), F.when(size != "", size.try_cast("long")).alias("width"))


def has_edge(control: Column) -> Column:
    """Whether an event control waits for an edge."""
    return F.coalesce(F.rlike(control, F.lit(r"\b(posedge|negedge|edge)\b")), F.lit(False))
