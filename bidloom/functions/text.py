"""Text expressions: canonical names, specifications, synonyms, categories.

Everything but the compatibility form (NFKC), which has no built-in, is a built-in
expression; ``canonical`` runs an Arrow-batched UDF, best applied to distinct names.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .constants import CATEGORIES, DN_BY_INCH, DN_BY_OUTER, DN_IN_USE, SUBCATEGORY_RULES, SYNONYMS


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def canonical(name: Column) -> Column:
    """Compatibility form, white space to single spaces, no control or format characters, ASCII capitals."""
    spaced = F.regexp_replace(nfkc(name), r"(?U)\s", " ")
    plain = F.regexp_replace(spaced, r"[\p{Cc}\p{Cf}]", "")
    upper = F.translate(plain, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.trim(F.regexp_replace(upper, " +", " "))


def clean_cell(cell: Column) -> Column:
    trimmed = F.trim(cell)
    return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), trimmed)


def dimensions(name: Column) -> Column:
    return F.regexp_replace(name, r"([0-9]+)\s*[*xX]\s*([0-9]+)", "$1×$2")


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it: nested steps would else grow by powers."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _first_by_table(name: Column, pattern: str, table: dict) -> Column:
    """The first match of ``pattern`` replaced by DN and its number's entry in ``table``, if it has one."""
    entries = F.create_map(*[F.lit(x) for k, v in table.items() for x in (str(k), str(v))])

    def swapped(found: Column) -> Column:
        entry, at = F.element_at(entries, F.regexp_extract(found, pattern, 1)), F.position(found, name)
        new = F.concat(F.substring(name, F.lit(1), at - 1), F.lit("DN"), entry, F.substring(name, at + F.length(found), F.length(name)))
        return F.when((found != "") & entry.isNotNull(), new).otherwise(name)

    return bound(F.regexp_extract(name, pattern, 0), swapped)


def nominal_diameter(name: Column) -> Column:
    """Outer diameters (Φ108), inches (4寸, 1/2寸) and bare millimetres (100mm) to DN; the first of each kind."""
    bare = lambda x: F.when(x.rlike("DN[0-9]"), x).otherwise(_first_by_table(x, r"(?i)(?<![×X*0-9])([0-9]+)\s*mm(?!\s*[×X*])", {n: n for n in DN_IN_USE}))
    inch = lambda x: bound(_first_by_table(x, r"([0-9]+(?:[./][0-9]+)?)\s*寸", DN_BY_INCH), bare)
    return bound(name, lambda n: bound(_first_by_table(n, r"[Φφ]\s*([0-9]+)", DN_BY_OUTER), inch))


def synonyms(name: Column) -> Column:
    for pattern, put in SYNONYMS:
        name = F.regexp_replace(name, pattern, put)
    return name


def standardised(name: Column) -> Column:
    """struct(original, standardized, changes): what each step changed; blank names are returned as given.

    Dimensions come before diameters: in 300 * 150mm both numbers are sides of one size.
    """
    labels = ("canonical", "dimensions", "diameter", "synonyms")

    def result(*steps: Column) -> Column:
        before = [name, *steps[:-1]]
        changes = [F.when(~b.eqNullSafe(s), F.concat_ws(" → ", F.lit(label), s)) for label, s, b in zip(labels, steps, before, strict=True)]
        blank = name.isNull() | (F.trim(name) == "")
        return F.struct(
            name.alias("original"),
            F.when(blank, name).otherwise(steps[-1]).alias("standardized"),
            F.when(blank, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*changes))).alias("changes"),
        )

    return bound(canonical(name), lambda c: bound(dimensions(c), lambda m: bound(nominal_diameter(m), lambda d: bound(synonyms(d), lambda s: result(c, m, d, s)))))


def sub_category(name: Column, category: Column) -> Column:
    """By the category's rules, first match; others 其他, null names 未分类."""
    out = F.when(name.isNull(), "未分类")
    for cat, rules in SUBCATEGORY_RULES.items():
        for pattern, label in rules:
            out = out.when((category == cat) & F.trim(name).rlike(f"(?i){pattern}"), label)
    return out.otherwise("其他")


def clean_brand(brand: Column) -> Column:
    """Without white space; numbers and blanks are no brands."""
    plain = F.regexp_replace(brand, r"(?U)\s", "")
    return F.when((plain != "") & plain.try_cast("double").isNull(), plain)


def dates_in(remark: Column) -> Column:
    return F.regexp_extract_all(remark, F.lit(r"20[0-9]{2}[./][0-9]{1,2}[./][0-9]{1,2}"), F.lit(0))


def date_key(day: Column) -> Column:
    """Sorts 2025.1.3 and 2025/10/3 by their numbers."""
    return F.transform(F.split(day, "[./]"), lambda x: x.cast("int"))


def categories_in(name: Column) -> Column:
    """Categories a name mentions, in declared order: the name itself, else a token of three characters or more, or one of two at the start or after a non-Chinese character."""
    token = [F.when(name.contains(c) if len(c) >= 3 else name.rlike(f"(^|[^㐀-䶿一-鿿]){c}"), c) for c in CATEGORIES]
    # A category that another character follows to make another word (止回阀门 for 阀门) has one before it.
    return F.when(name.isin(CATEGORIES), F.array(name)).otherwise(F.array_compact(F.array(*token)))


def first_category(name: Column) -> Column:
    return F.coalesce(*[F.when(name.contains(c), c) for c in CATEGORIES])


def tolerant_json(reply: Column) -> Column:
    """The outermost braces of a model's reply, without fences and thoughts."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?s)^.*</think>", ""), "```(?:json)?", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
