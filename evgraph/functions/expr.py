"""Column expressions that the operators share. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(c: Column) -> Column:
    """An identifier as trimmed text; blank is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def project_key(c: Column, mode: str = "remove_hyphen_space") -> Column:
    """A project number in one of three forms: raw_trim_upper, remove_spaces, remove_hyphen_space."""
    text = F.upper(F.trim(c.cast("string")))
    drop = {"raw_trim_upper": "", "remove_spaces": " ", "remove_hyphen_space": " -"}[mode]
    return F.nullif(F.translate(text, drop, "") if drop else text, F.lit(""))


def year_in_text(c: Column) -> Column:
    """The first run of four digits."""
    return F.nullif(F.regexp_extract(c.cast("string"), "([0-9]{4})", 1), F.lit("")).try_cast("int")


def year(c: Column, low: int = 1000, high: int = 3000) -> Column:
    """A year given as a number (decimals are dropped) or as a date; out of bounds is null."""
    text = key(c)
    number = text.try_cast("double").try_cast("int")
    dated = F.coalesce(*(F.year(F.try_to_timestamp(text, F.lit(f))) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy/MM/dd", "MMMM yyyy")))
    value = F.coalesce(number, dated)
    return F.when(value.between(low, high), value)


def number(*cs: Column, default: float | None = 0.0, kind: str = "double") -> Column:
    """The first of the columns that reads as a number, else the default."""
    read = [c.cast("string").try_cast("double") for c in cs]
    value = F.coalesce(*read, F.lit(default).cast("double")) if default is not None else F.coalesce(*read)
    return F.round(value).cast(kind) if kind in ("int", "bigint") else value


def token(c: Column) -> Column:
    """Lower-case text with runs of white space, underscores and hyphens as one hyphen."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"[\s_-]+", "-"), F.lit(""))


def alias(c: Column, names: dict[str, str]) -> Column:
    """A token's canonical name where names has one."""
    t = token(c)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), t), t) if names else t


def grounded(c: Column, ungrounded: str = "CUI-LESS") -> Column:
    """True for an identifier that names an entity."""
    return F.coalesce(F.upper(key(c)) != ungrounded, F.lit(False))


def term_pattern(c: Column) -> Column:
    """A regular expression that finds a term as whole words, with any white space or hyphens between its parts."""
    return F.concat(F.lit("(^|[^a-z0-9])"), F.regexp_replace(F.lower(F.trim(c)), r"[ -]+", r"[\\s-]+"), F.lit("([^a-z0-9]|$)"))


def label(*cs: Column) -> Column:
    """The first column that isn't blank."""
    return F.coalesce(*(key(c) for c in cs))


def unit_id(*parts: Column, prefix: str = "ku", algorithm: str = "md5") -> Column:
    """Prefix and the first 16 hex digits of a hash of the parts joined by ||."""
    joined = F.concat_ws("||", *parts)
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(joined) if algorithm == "md5" else F.sha1(joined), 1, 16))


def pair_weight(a: Column, b: Column, mode: str = "sqrt_product") -> Column:
    """The weight of an entity pair from the mention counts of its sides."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.lit(0.0)
    return {
        "sqrt_product": F.sqrt(F.greatest(a, zero) * F.greatest(b, zero)),
        "min": F.least(a, b),
        "product": a * b,
        "sum": a + b,
        "mean": (a + b) / 2,
    }[mode]


def oriented(type_a: Column, type_b: Column, first: Column, second: Column, pair_types: list[tuple[str, str]]) -> Column:
    """The two sides in the order of the first pair type that fits, same-type pairs by value; null where none fits or the sides are equal."""
    out = F.lit(None)
    for x, y in reversed(pair_types):
        straight = (type_a == x) & (type_b == y)
        crossed = (type_a == y) & (type_b == x)
        kept, swapped = F.struct(first.alias("a"), second.alias("b")), F.struct(second.alias("a"), first.alias("b"))
        if x == y:
            out = F.when(straight, F.when(first <= second, kept).otherwise(swapped)).otherwise(out)
        else:
            out = F.when(straight, kept).when(crossed, swapped).otherwise(out)
    return F.when(first != second, out)


def unordered_pair_key(pair_type: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("::", pair_type, F.least(a, b), F.greatest(a, b))


def evidence_pattern(flags: dict[str, Column]) -> Column:
    """The letters of the modalities that a unit has, or none."""
    joined = reduce(lambda x, y: F.concat(x, y), (F.when(f, F.lit(k)).otherwise(F.lit("")) for k, f in flags.items()))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("none"))


def bucket(c: Column, edges: list[int], names: list[str]) -> Column:
    """The name of the range that a count falls in: below edges[0], edges[0] to edges[1] - 1, and so on."""
    out = F.lit(names[-1])
    for edge, name in zip(reversed(edges), reversed(names[:-1]), strict=True):
        out = F.when(c < edge, name).otherwise(out)
    return out


def column_kind(name: Column) -> Column:
    """Identifier, date, year, text or other, by a column's name."""
    n = F.lower(name)
    return (
        F.when(n.rlike("(^|_)(id|key|pmid|number)$|key$|id$"), "id")
        .when(n.rlike("date|(^|_)ts$|time"), "date")
        .when(n.rlike("year"), "year")
        .when(n.rlike("title|text|abstract|name|comment|html"), "text")
        .otherwise("other")
    )


def semantic_key(name: Column, families: dict[str, str]) -> Column:
    """The family of the first pattern that a column's name matches."""
    out = F.lit(None).cast("string")
    for family, pattern in reversed(families.items()):
        out = F.when(F.lower(name).rlike(pattern), family).otherwise(out)
    return out


def split_of(cutoff: Column, splits: dict[str, list[int]], unused: str = "unused") -> Column:
    """The split whose list holds the cutoff."""
    out = F.lit(unused)
    for name, values in reversed(splits.items()):
        out = F.when(cutoff.isin(values), name).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_interval(*cs: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in cs))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
