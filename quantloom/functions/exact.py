"""Exact numbers: scaled integers, canonical texts, hashes and a counter-based generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(value: Column) -> Column:
    """A number above zero and finite, else null."""
    number = value.cast("string").try_cast("double")
    return F.when((number > 0) & (number < float("inf")), number)


def percentage_change(previous: Column, current: Column) -> Column:
    """100 * (current - previous) / previous in decimals; null without a previous value."""
    p, c = previous.cast("decimal(18,8)"), current.cast("decimal(18,8)")
    return F.when(p != 0, (c - p) * 100 / p)


def threshold_met(change: Column, threshold: float) -> Column:
    """Inclusive, on the absolute change."""
    return F.abs(change) >= F.lit(threshold)


def parse_scaled(text: Column, digits: int = 8) -> Column:
    """Decimal text, exponent forms too, as an integer times 10**digits; null if it has more digits than that."""
    kind = f"decimal(38,{min(20, digits + 10)})"
    wide = text.try_cast(kind)
    scaled = wide.try_cast(f"decimal(38,{digits})")
    factor = F.lit("1" + "0" * digits).cast("decimal(20,0)")
    return F.when(wide == scaled.cast(kind), (scaled.cast(f"decimal(28,{digits})") * factor).cast("decimal(38,0)"))


def render_scaled(value: Column, digits: int = 8) -> Column:
    """The canonical text of a scaled integer: no trailing zeros, no trailing point."""
    sign = F.when(value < 0, "-").otherwise("")
    body = F.lpad(F.abs(value.cast("decimal(38,0)")).cast("string"), 40, "0")
    whole = F.regexp_replace(F.substring(body, 1, 40 - digits), "^0+(?=.)", "")
    rest = F.regexp_replace(F.substring(body, 41 - digits, digits), "0+$", "")
    return F.concat(sign, whole, F.when(F.length(rest) > 0, F.concat(F.lit("."), rest)).otherwise(""))


def half_even(value: Column, places: int) -> Column:
    """Rounded half to even on the decimal text of a double."""
    return F.bround(value.cast("string").cast("decimal(38,12)"), places)


def to_scaled(value: Column, digits: int = 8) -> Column:
    """A double as a scaled integer, half to even."""
    return (half_even(value, digits).cast(f"decimal(28,{digits})") * F.lit("1" + "0" * digits).cast("decimal(20,0)")).cast("decimal(38,0)")


def ratio_text(numerator: Column, denominator: Column) -> Column:
    """``n/d`` in lowest terms with a positive denominator."""
    n, d = numerator.cast("long"), denominator.cast("long")
    step = F.struct(n.alias("a"), d.alias("b"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(step["a"]).alias("a"), F.abs(step["b"]).alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b"))),
    )
    by = F.greatest(steps["a"], F.lit(1)) * F.signum(d).cast("long")
    return F.concat_ws("/", (n / by).cast("long").cast("string"), (d / by).cast("long").cast("string"))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the columns' canonical JSON, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def row_hash(*columns: Column, separator: str = "|") -> Column:
    """MD5 of the columns' texts; null is written as an empty text, so that positions stay."""
    return F.md5(F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def counter_words(seed: Column, stream: Column, block: Column) -> Column:
    """Four unsigned 64-bit words as decimals: the big-endian quarters of sha256("seed|stream|block")."""
    digest = F.sha2(F.concat_ws("|", seed.cast("string"), stream, block.cast("string")), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)") for k in range(4)])


def signal_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def neutral_csv(cell: Column) -> Column:
    """A report cell that no spreadsheet takes for a formula."""
    return F.when(cell.rlike(r"^[=+@\-]"), F.concat(F.lit("'"), cell)).otherwise(cell)
