"""Text and JSON expressions over pages and listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions.numbers import as_col

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
MARKUP = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<[a-z/!?][^>]*>"
SPACES = " \u00a0\u202f\t\n\r"
REFERENCE = r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def blank_to_null(col: Column) -> Column:
    """Empty text is "not found". Apply to a column, not to a costly expression:
    the operand is evaluated twice."""
    return F.when(col != "", col)


def first_group(text, pattern: str, group: int = 1) -> Column:
    """First match's group, empty when there is no match (reads as null once parsed)."""
    return F.regexp_extract(as_col(text), pattern, group)


def parse_number(value) -> Column:
    """Number from text: spaces dropped, comma as point; null when unreadable."""
    plain = F.translate(F.translate(as_col(value).cast("string"), SPACES, ""), ",", ".")
    return F.regexp_extract(plain, NUMBER, 0).try_cast("double")


def parse_int(value, default: int | None = 0) -> Column:
    number = parse_number(value).try_cast("bigint")
    return number if default is None else F.coalesce(number, F.lit(default))


def parse_float(value, default: float | None = 0.0) -> Column:
    number = parse_number(value)
    return number if default is None else F.coalesce(number, F.lit(default))


def positive(col: Column) -> Column:
    """Zero and below mean "not found"."""
    return F.when(col > 0, col)


def district_from_code(code) -> Column:
    return F.pmod(parse_int(code), F.lit(100)).cast("int")


def decoded(text: Column) -> Column:
    """Character references of a text decoded once: decimal, hexadecimal, and the
    names of ``C.REFERENCES``; what is none of these stays as it is."""
    known = F.create_map(*[F.lit(x) for pair in C.REFERENCES.items() for x in pair])

    def piece(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, REFERENCE, 1)
        digits = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7))
        number = digits.try_cast("bigint")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.coalesce(F.try_element_at(known, name), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))
        rest = F.substr(p, F.length(name) + 2)
        return F.when(i == 0, p).otherwise(F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), p)))

    return F.array_join(F.transform(F.split(text, "&", -1), piece), "")


def visible_text(html) -> Column:
    """Text of a page: scripts, styles, comments and tags removed in one scan,
    references decoded, no-break and thin spaces as blanks, runs of white space collapsed."""
    out = decoded(F.regexp_replace(as_col(html), MARKUP, " "))
    return F.trim(F.regexp_replace(F.translate(out, C.ODD_BLANKS, "   "), r"[ \t\r\n\f]+", " "))


def meta_tags(html) -> Column:
    """All meta tags of a page, found in one scan."""
    return F.regexp_extract_all(as_col(html), F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))


def meta_content(tags: Column, name: str) -> Column:
    """``content`` of the first of some meta tags with a property or name."""
    named = F.filter(tags, lambda t: t.rlike(rf"""(?i)(?:property|name)=["']{name}["']"""))
    return F.trim(F.regexp_extract(F.try_element_at(named, F.lit(1)), r'(?is)content="([^"]*)"', 1))


def page_title(html) -> Column:
    return F.trim(decoded(first_group(html, r"(?is)<title[^>]*>(.*?)</title>")))


def largest_number(text, low: int, high: int) -> Column:
    """Largest whole number strictly between two limits, spaces in numbers ignored."""
    joined = F.translate(as_col(text), SPACES, "")
    numbers = F.transform(F.regexp_extract_all(joined, F.lit(r"(\d+)")), lambda x: x.try_cast("bigint"))
    return F.array_max(F.filter(numbers, lambda x: (x > low) & (x < high)))


def host_source(url) -> Column:
    u = F.lower(as_col(url))
    return (
        F.when(u.contains("seloger.com"), "SeLoger")
        .when(u.contains("leboncoin.fr"), "LeBonCoin")
        .when(u.contains("pap.fr"), "PAP")
        .when(u.contains("bienici.com"), "BienIci")
        .otherwise("Inconnu")
    )


def days_since(date_text, as_of: Column) -> Column:
    """Whole days from an ISO date to ``as_of``: never negative, null if ten years old.

    Wall-clock times on both sides, so the session's time zone plays no part.
    """
    stamp = F.substring(as_col(date_text), 1, 19).try_cast("timestamp_ntz")
    days = F.extract(F.lit("DAY"), as_of.cast("timestamp_ntz") - stamp)
    return F.when(days < C.MAX_LISTING_AGE_DAYS, F.greatest(days, F.lit(0))).cast("int")


def words_found(lowered, words: list[str]) -> Column:
    """Which of some words occur in a text given in lower case."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(as_col(lowered), w))


def ordinal_district(district) -> Column:
    d = as_col(district).cast("int")
    return F.concat(d.cast("string"), F.when(d == 1, "er").otherwise("e"))


def address_label(number, street, district) -> Column:
    return F.concat_ws(
        " ",
        as_col(number).try_cast("double").try_cast("int").cast("string"),
        F.initcap(as_col(street)),
        F.concat(F.lit("Paris "), ordinal_district(district)),
    )


def iso_day(date) -> Column:
    return F.date_format(as_col(date), "yyyy-MM-dd")


def top_contributions(contributions, k: int) -> Column:
    """The ``k`` entries largest in absolute value, per row."""
    keyed = F.transform(
        as_col(contributions),
        lambda c: F.struct((-F.abs(c["value"])).alias("w"), c["feature"].alias("feature"), c["value"].alias("value"), c["display"].alias("display")),
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, k),
        lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value"), c["display"].alias("display")),
    )


def explanation(price_m2, contributions, district, distance_km) -> Column:
    """Sentence naming the two strongest factors on either side."""
    def listed(keep, sign: str) -> Column:
        chosen = F.slice(F.filter(as_col(contributions), keep), 1, 2)
        parts = F.transform(
            chosen, lambda c: F.concat(F.lit("**"), c["display"], F.lit(f"** ({sign}"), F.format_number(c["value"], 0), F.lit(" €/m²)"))
        )
        return F.array_join(parts, ", ")

    plus, minus = listed(lambda c: c["value"] > 0, "+"), listed(lambda c: c["value"] < 0, "")
    head = F.concat(
        F.lit("Ce bien dans le "), ordinal_district(district), F.lit(" arrondissement (à "),
        F.format_string("%.1f", as_col(distance_km)), F.lit(" km du centre) est estimé à **"),
        F.format_number(as_col(price_m2), 0), F.lit(" €/m²**."),
    )
    return F.concat_ws(
        " ",
        head,
        F.when(plus != "", F.concat(F.lit("Facteurs valorisants : "), plus, F.lit("."))),
        F.when(minus != "", F.concat(F.lit("Facteurs pénalisants : "), minus, F.lit("."))),
    )
