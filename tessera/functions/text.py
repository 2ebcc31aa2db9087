"""Measures and rewritings of text, as Column functions.

All are native expressions but ``decomposed``, which has no built-in form.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that counts as blank, as a regular-expression class.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)

WIDE = r"[\p{IsHangul}\p{IsHan}]"
MARKS = r"[\x{300}-\x{36F}]"

NEWLINE_UNITS, WIDE_UNITS, GUIDANCE_ITEM_UNITS = 60, 2, 20


def computed(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that are computed once a row, however often they are read.

    ``inline`` over a single struct keeps the optimiser from writing their
    expressions into each place that reads them.
    """
    made = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return df.select(*[c for c in df.columns if c not in values], F.inline(made))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True for null and for text of white space alone."""
    return text.isNull() | ~text.rlike(NOT_SPACE)


def layout_units(text: Column) -> Column:
    """Layout size: 60 a newline, 2 a Hangul or Han character, 1 any other; 0 for null."""
    wide = F.length(text) - F.length(F.regexp_replace(text, WIDE, ""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.coalesce(F.length(text) + (NEWLINE_UNITS - 1) * lines + (WIDE_UNITS - 1) * wide, F.lit(0))


def guidance_units(items: Column) -> Column:
    """Layout size of a guidance list: each item costs its units and a fixed margin."""
    return F.coalesce(F.aggregate(items, F.lit(0), lambda a, x: a + layout_units(x) + GUIDANCE_ITEM_UNITS), F.lit(0))


def longest_token(text: Column) -> Column:
    """Code points of the longest run without white space; 0 for null."""
    return F.coalesce(F.array_max(F.transform(F.split(text, SPACE + "+"), F.length)), F.lit(0))


def canonical(text: Column) -> Column:
    """Upper case, with all but A-Z and 0-9 dropped."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "")


def split_guidance(text: Column) -> Column:
    """Lines that aren't blank, untrimmed; null if none is left."""
    items = F.filter(F.split(text, "\r?\n"), lambda x: ~is_blank(x))
    return F.when(F.size(items) > 0, items)


@F.pandas_udf(T.StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD); there is no built-in for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens; may be empty.

    Pure ASCII text skips the Python function's work: it is passed a null there.
    """
    plain = ~text.rlike(r"[^\x00-\x7F]")
    base = F.coalesce(F.when(plain, text), decomposed(F.when(~plain, text)))
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(base, MARKS, "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_slug(text: Column) -> Column:
    return F.coalesce(text.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def padded(number: Column, width: int = 2) -> Column:
    """Zero-padded to at least ``width`` digits, never cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def counted(n: Column, singular: str, plural: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, singular).otherwise(plural))


def last_word(text: Column) -> Column:
    """(lead, tail): the text up to and with its last space, and the rest."""
    at = F.length(text) - F.coalesce(F.length(F.substring_index(text, " ", -1)), F.lit(0))
    return F.struct(F.substring(text, F.lit(1), at).alias("lead"), F.substring_index(text, " ", -1).alias("tail"))


def milliseconds(value: Column) -> Column:
    """Seconds with two decimals from 1000 on, else whole milliseconds; halves round up."""
    return F.when(value >= 1000, F.format_string("%.2f s", value / 1000)).otherwise(F.concat(F.floor(value + 0.5).cast("string"), F.lit(" ms")))


def two_decimals(value: Column) -> Column:
    """A double with two decimals as C's ``%.2f`` has it: its exact binary value is rounded, ties to even.

    ``format_string`` rounds the shortest decimal and ties up: 15.625 is 15.63 there and 15.62 here.
    """
    return F.call_function("format_number", value.cast("double"), F.lit("0.00"))


def megabytes(value: Column) -> Column:
    return F.concat(two_decimals(value / (1024 * 1024)), F.lit(" MB"))


def safe_folder(name: Column, otherwise: str = "Workbook") -> Column:
    clean = trimmed(F.regexp_replace(name, r'[\\/:*?"<>|]', "-"))
    return F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit(otherwise)), 1, 90)


def base64_size(size: Column) -> Column:
    """Length of ``size`` bytes in base64."""
    return (F.ceil(size / 3) * 4).cast("long")


def has_warning(log: Column) -> Column:
    return F.coalesce(log.rlike("(?im)^warning:"), F.lit(False))


def first_prefix(path: Column, areas: list[tuple[str, str]], otherwise: str) -> Column:
    """The area of the first prefix that fits, in the order given."""
    out = F.lit(otherwise)
    for prefix, area in reversed(areas):
        out = F.when(path.startswith(prefix), area).otherwise(out)
    return out


#: Areas of a published bundle by path prefix.
AREAS = [("vendor/", "compiler"), ("project/assets/fonts/", "fonts"), ("project/", "templates and logos"), ("fixtures/", "workbook content")]
OTHER_AREA = "preview page"


def area_of(path: Column) -> Column:
    return first_prefix(path, AREAS, OTHER_AREA)


def register(spark: SparkSession) -> None:
    """Make the scalar functions callable from SQL by name, for this session."""
    spark.udf.register("decomposed", decomposed)
    quoted = lambda x: x.replace("\\", "\\\\")
    made = [
        ("layout_units", "int", f"coalesce(length(t) + {NEWLINE_UNITS - 1} * (length(t) - length(replace(t, chr(10), ''))) + length(t) - length(regexp_replace(t, '{quoted(WIDE)}', '')), 0)"),
        ("canonical_text", "string", "regexp_replace(upper(t), '[^A-Z0-9]+', '')"),
        ("is_blank_text", "boolean", f"t is null or not t rlike '{quoted(NOT_SPACE)}'"),
        ("slug_text", "string", f"regexp_replace(regexp_replace(lower(regexp_replace(decomposed(t), '{quoted(MARKS)}', '')), '[^a-z0-9]+', '-'), '^-+|-+$', '')"),
    ]
    areas = " ".join(f"when startswith(t, '{prefix}') then '{area}'" for prefix, area in AREAS)
    made.append(("area_of_path", "string", f"case {areas} else '{OTHER_AREA}' end"))
    for name, kind, body in made:
        spark.sql(f"create or replace temporary function {name}(t string) returns {kind} return {body}")
    spark.sql(f"create or replace temporary function guidance_items(t string) returns array<string> return nullif(filter(split(t, '\\r?\\n'), x -> x rlike '{quoted(NOT_SPACE)}'), cast(array() as array<string>))")
    spark.sql("create or replace temporary function milliseconds_text(v double) returns string return if(v >= 1000, format_string('%.2f s', v / 1000), concat(cast(floor(v + 0.5) as string), ' ms'))")
    spark.sql("create or replace temporary function megabytes_text(v double) returns string return concat(format_number(v / (1024 * 1024), '0.00'), ' MB')")
