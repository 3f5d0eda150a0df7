"""Number expressions: rounding that engines agree on, safe ratios, parsing of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half up by floor; ``round`` differs between engines near halves."""
    scale = float(10**digits)
    return F.floor(x * scale + F.lit(0.5)) / F.lit(scale)


def deviation(price: Column, reference: Column) -> Column:
    """(price - reference) / reference; null unless the reference is positive."""
    return F.when(reference > 0, (price - reference) / reference)


def alert(dev: Column, yellow: Column, red: Column) -> Column:
    """normal, yellow or red by the size of a deviation; both bounds belong to the milder level, null is normal."""
    size = F.abs(dev)
    return F.when(dev.isNull() | (size <= yellow), "normal").when(size <= red, "yellow").otherwise("red")


def import_number(cell: Column) -> Column:
    """A number of an imported sheet: commas are decimal points, other signs are dropped; null if it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(cell.cast("string"), "[,，]", "."), r"[^0-9.\-]", "")
    return _try_double(plain)


def extraction_number(cell: Column) -> Column:
    """A number of an extracted document: commas part thousands and are removed, as are all other signs."""
    return _try_double(F.regexp_replace(cell.cast("string"), r"[^0-9.\-]", ""))


def _try_double(plain: Column) -> Column:
    return F.when(plain.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), plain.try_cast("double"))


def positive(x: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x), x)


def line_total(price: Column, quantity: Column, given: Column | None = None) -> Column:
    total = rounded(price * quantity, 4)
    return total if given is None else F.coalesce(given, total)


def checked_line(price: Column, quantity: Column, total: Column) -> Column:
    """Share of the total by which price times quantity misses it."""
    return F.when(total != 0, F.abs(price * quantity - total) / total)


def suggested_price(price: Column, quantity: Column, total: Column) -> Column:
    """struct(kind, unit_price) where a unit price looks like a line total of more than one piece, else null.

    unit_is_total: it is the given total, give or take a twentieth; swap_total_to_unit:
    no total is given, and the price is all but a multiple of the quantity, twice it at least.
    """
    cents = lambda x: F.floor(x * 100 + F.lit(0.5)) / F.lit(100.0)
    ratio, each = price / F.when(total > 0, total), price / F.when(quantity > 1, quantity)
    even = F.abs(price % F.when(quantity > 1, quantity) / price) < 0.01
    is_total = (quantity > 1) & (total > 0) & (ratio > 0.95) & (ratio < 1.05)
    swapped = total.isNull() & (price > 0) & (quantity >= 2) & (each > 1) & (price >= quantity * 2) & (cents(each) != price) & even
    kind = F.when(is_total, "unit_is_total").when(swapped, "swap_total_to_unit")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(is_total, cents(total / quantity)).otherwise(cents(each)).alias("unit_price")))


def percent(x: Column) -> Column:
    """+5.0%, -3.2%; a dash for null."""
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.format_string("%+.1f%%", x * 100))


def folded_alert(raw: Column) -> Column:
    """Levels of older data: blue is red, green and unknown ones are normal."""
    return F.when(raw.isin("red", "blue"), "red").when(raw == "yellow", "yellow").otherwise("normal")
