"""Functions on printed values: precision, uncertainties, spin-parity texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchengine.schema import CONFIG, SPIN_OPTIONS


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used; inside
    lambdas Spark evaluates a repeated expression again at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number_in(text: Column, kind: str) -> Column:
    """The number a text gives, null for none.  Empty texts, as of patterns that are not
    there, are told apart first: a failing ``try_cast`` costs an exception a row."""
    return F.nullif(text, F.lit("")).try_cast(kind)


def _digits_after_point(number: Column) -> Column:
    return F.length(F.regexp_extract(number, r"\.([0-9]*)", 1))


def _ten_to(n: Column) -> Column:
    """10 to an integer power, exactly as decimal text says."""
    return F.concat(F.lit("1E"), n.cast("string")).cast("double")


def _exponent(text: Column) -> Column:
    return number_in(F.regexp_extract(text, r"^[^E]*E([+-]?[0-9]+)$", 1), "int")


def uncertainty_from_precision(text: Column, default: float = CONFIG.default_uncertainty) -> Column:
    """Five units of the last printed digit; ``default`` where there is none."""
    number = F.upper(F.trim(text))
    decimals = _digits_after_point(F.regexp_extract(number, r"^([^E]*)", 1))
    scientific = F.when(_exponent(number).isNull(), F.lit(default)).otherwise(5 * _ten_to(_exponent(number) - decimals))
    plain = F.when(number.contains("."), 5 * _ten_to(-decimals)).otherwise(F.lit(default))
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit(default)).when(number.contains("E"), scientific).otherwise(plain)


def absolute_uncertainty(value: Column, uncertainty: Column) -> Column:
    """Uncertainty printed in units of the value's last digit; empty is 0."""
    number = F.upper(F.trim(value))
    decimals = _digits_after_point(F.regexp_extract(number, r"^([^E]*)", 1))
    shift = F.coalesce(_exponent(number), F.lit(0)) - decimals
    return F.when(F.coalesce(F.trim(uncertainty), F.lit("")) == "", F.lit(0.0)).otherwise(number_in(F.trim(uncertainty), "double") * _ten_to(shift))


def energy_uncertainty(value: Column, uncertainty: Column) -> Column:
    """Struct (value, type): printed, or inferred from precision, 0 at energy 0."""
    given = F.coalesce(F.trim(uncertainty), F.lit("")) != ""
    inferred = F.when(number_in(F.trim(value), "double") == 0, F.lit(0.0)).otherwise(uncertainty_from_precision(value))
    return F.struct(F.when(given, absolute_uncertainty(value, uncertainty)).otherwise(inferred).alias("value"), F.when(given, F.lit("symmetric")).otherwise(F.lit("inferred")).alias("type"))


def intensity_uncertainty(value: Column, uncertainty: Column) -> Column:
    given = F.coalesce(F.trim(uncertainty), F.lit("")) != ""
    positive = F.coalesce(number_in(F.trim(value), "double"), F.lit(0.0)) > 0
    size = F.when(given, absolute_uncertainty(value, uncertainty)).when(positive, uncertainty_from_precision(value)).otherwise(F.lit(0.0))
    return F.struct(F.when(size > 0, size).alias("value"), F.when(size > 0, F.lit("symmetric")).otherwise(F.lit("unreported")).alias("type"))


def evaluator_input(value: Column, uncertainty: Column) -> Column:
    return F.concat_ws(" ", F.trim(value), F.nullif(F.trim(uncertainty), F.lit("")))


def parse_spin_parity(text: Column) -> Column:
    """Options of a spin-parity text as an array; empty where nothing parses."""
    none = F.array().cast(SPIN_OPTIONS)
    body = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.$", "")
    low, high = (number_in(F.regexp_extract(body, r"^([0-9]+):([0-9]+)$", k), "int") for k in (1, 2))
    spans = F.transform(F.sequence(low, high), lambda k: F.struct((2 * k).alias("twoTimesSpin"), F.lit(False).alias("isTentativeSpin"), F.lit(None).cast("string").alias("parity"), F.lit(False).alias("isTentativeParity")))
    whole = body.rlike(r"^\(.*,.*\)$")
    inner = F.when(whole, F.regexp_extract(body, r"^\((.*)\)$", 1)).otherwise(body)

    def option(part: Column) -> Column:
        parity = F.when(part.contains("+"), F.lit("+")).when(part.contains("-"), F.lit("-"))
        tentative = whole | part.contains("(") | part.contains(")")
        spin = F.trim(F.regexp_replace(part, r"[-+()]", ""))
        top = number_in(F.regexp_extract(spin, r"^([0-9]+)(?:/[0-9]+)?$", 1), "int")
        under = F.coalesce(number_in(F.regexp_extract(spin, r"^[0-9]+/([0-9]+)$", 1), "int"), F.lit(1))
        return F.struct(F.when(under > 0, F.floor(2 * top / F.nullif(under, F.lit(0)))).cast("int").alias("twoTimesSpin"), tentative.alias("isTentativeSpin"), parity.alias("parity"), (tentative & parity.isNotNull()).alias("isTentativeParity"))

    options = F.filter(F.transform(F.split(inner, ","), option), lambda x: x["twoTimesSpin"].isNotNull())
    return F.when(F.lower(body).isin("", "unknown", "none"), none).when(low.isNotNull() & (low <= high), spans).when(body.contains(":"), none).otherwise(options).cast(SPIN_OPTIONS)


def level_id(dataset: Column, energy: Column) -> Column:
    return F.concat(dataset, F.lit("_"), energy.cast("long").cast("string"))


def tag_marker(tag: Column) -> Column:
    """Text in the parentheses after a cross-reference tag."""
    return F.regexp_extract(tag, r"\(([^)]*)", 1)


def short_label(label: Column, most: int = 30) -> Column:
    return F.when(F.length(label) > most, F.split(label, " ")[0]).otherwise(label)


def fixed_line(text: Column, width: int = 80) -> Column:
    return F.rpad(text, width, " ")


def wrap_line(text: Column, width: int = 80) -> Column:
    """Lines of at most ``width`` characters, broken between words."""
    folded = F.aggregate(
        F.split(text, " +"),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line")),
        lambda acc, w: F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line")))
        .when(F.length(acc["line"]) + 1 + F.length(w) <= width, F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.lit(" "), w).alias("line")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(acc["line"])).alias("done"), w.alias("line"))),
        lambda acc: F.concat(acc["done"], F.array(acc["line"])),
    )
    return folded


def tag_order(tag: Column) -> Column:
    """Sort key of cross-reference tags: digits before letters."""
    return F.concat(F.when(tag.rlike("^[0-9]"), F.lit("0")).otherwise(F.lit("1")), tag)


def nuclide(folder: Column) -> Column:
    """Mass number and symbol of a folder name like ``34S``."""
    return F.struct(number_in(F.regexp_extract(folder, r"^([0-9]+)", 1), "int").alias("mass"), F.initcap(F.regexp_extract(folder, r"^[0-9]+_?([A-Za-z]{1,2})", 1)).alias("symbol"))


def rounded_like(value: Column, printed: Column) -> Column:
    """``value`` as text with as many decimals as ``printed`` shows, without
    separators; halves go away from zero."""
    decimals = _digits_after_point(printed)
    # Text rather than a double is shifted: 1.005 has no exact double.
    exact = value.cast("string").try_cast("decimal(38,18)")
    unit = F.concat(F.lit("1E"), decimals.cast("string")).cast("decimal(38,0)")
    scaled = F.round(exact * unit, 0).cast("decimal(38,0)").cast("string")
    digits = F.lpad(F.regexp_replace(scaled, "^-", ""), F.greatest(F.length(F.regexp_replace(scaled, "^-", "")), decimals + 1), "0")
    whole = F.substring(digits, F.lit(1), F.length(digits) - decimals)
    shown = F.when(decimals > 0, F.concat(whole, F.lit("."), F.right(digits, decimals))).otherwise(digits)
    return F.concat(F.when(scaled.startswith("-"), "-").otherwise(""), shown).alias("rounded")


def message_line(column: Column, text: Column, kind: Column) -> Column:
    """A mark under a column of an 80-column record, then the message."""
    return F.concat(F.repeat(F.lit(" "), column), F.lit("*"), F.repeat(F.lit(" "), 81 - column), F.lit("<"), kind, F.lit(">"), text)


#: Units that may stand between a value and its uncertainty.
UNITS = ("Y", "D", "H", "M", "S", "MS", "US", "NS", "PS", "FS", "AS", "EV", "KEV", "MEV", "%")


def printed_value(text: Column) -> Column:
    """Struct (x, up, down, unit) of a printed value: ``12.34(5)``, ``12.34 5``,
    ``320 FS 40``, ``1.2 PS +4-3`` and ``1.2(+4-3) PS``; uncertainties are in units of
    the last digit.  Null up and down: none printed; a null x: no value."""
    units = "|".join(UNITS)

    def uncertainties(number: Column, unit: Column, bare: Column) -> Column:
        up = F.regexp_extract(bare, r"^\+\s*([0-9]+)\s*-\s*[0-9]+$", 1)
        down = F.regexp_extract(bare, r"^\+\s*[0-9]+\s*-\s*([0-9]+)$", 1)
        both = F.regexp_extract(bare, r"^([0-9]+)$", 1)
        side = lambda one: once(F.concat(one, both), lambda given: F.when(given != "", absolute_uncertainty(number, given)))
        return F.struct(number_in(number, "double").alias("x"), side(up).alias("up"), side(down).alias("down"), F.nullif(unit, F.lit("")).alias("unit"))

    def parts(number: Column, rest: Column) -> Column:
        unit = F.regexp_extract(rest, rf"(?:^|[\s)])({units})(?=$|[\s(])", 1)
        bare = F.trim(F.regexp_replace(F.regexp_replace(rest, rf"(^|[\s)])(?:{units})(?=$|[\s(])", "$1 "), "[()]", " "))
        return once(F.struct(unit.alias("unit"), bare.alias("bare")), lambda s: uncertainties(number, s["unit"], s["bare"]))

    def split(plain: Column) -> Column:
        first = F.regexp_extract(plain, r"^([-+]?[0-9]+(?:\.[0-9]+)?(?:E[-+]?[0-9]+)?)(?![0-9.])", 1)
        rest = lambda number: F.trim(F.substring(plain, F.length(number) + 1, F.lit(1_000_000)))
        return once(first, lambda number: once(rest(number), lambda r: parts(number, r)))

    return once(F.regexp_replace(F.upper(F.trim(text)), r"\{I([^}]*)\}", "($1)"), split)


def comment_values(body: Column, keyword: str) -> Column:
    """Values with uncertainties listed after ``keyword=`` in a comment, as (x, dx,
    label, up, down, unit).

    The list ends at the first sentence end outside brackets; items are parted
    by commas or ``and`` outside brackets; ``{I12}`` marks an uncertainty, and
    ``+4-3`` one that is not symmetric, whose mean is dx; -1 for none.
    """
    listed = F.regexp_extract(body, keyword + r"\s*=\s*((?:\([^)]*\)|\{[^}]*\}|[^().;]|\.(?=[0-9]))*)", 1)
    plain = F.regexp_replace(listed, r"\{I([^}]*)\}", "($1)")
    items = F.split(plain, r",(?![^(]*\))|\s+and\s+(?![^(]*\))")

    def item(part: Column) -> Column:
        # The value up to what is not a number, a unit or an uncertainty.
        head = F.regexp_extract(part, r"([-+]?[0-9]+(?:\.[0-9]+)?(?:\s*\((?:[0-9]+|\+[0-9]+\s*-\s*[0-9]+)\)|\s+(?:[A-Za-z]{1,3}|%)(?![A-Za-z])|\s+\+[0-9]+\s*-\s*[0-9]+)*)", 1)
        label = F.trim(F.regexp_extract(part, r"\(([0-9]{4}[A-Za-z]{2}[^)]*)\)", 1))
        error = lambda found: F.coalesce((found["up"] + found["down"]) / 2, F.lit(-1.0))
        return once(printed_value(head), lambda found: F.struct(found["x"].alias("x"), error(found).alias("dx"), label.alias("label"), found["up"].alias("up"), found["down"].alias("down"), found["unit"].alias("unit")))

    return F.filter(F.transform(items, item), lambda v: v["x"].isNotNull())


#: A value as printed, alone or with its uncertainty in units of the last digit.
_PRINTED = r"^[-+]?[0-9]+(\.[0-9]+)?(\([0-9]+\))?$"


def printed_values(words: Column) -> Column:
    """The words that are values, as (text, x, dx): ``1.25(3)`` has its uncertainty
    printed, ``1.25`` one inferred from its last digit.  Stops after a word are not
    part of it."""
    plain = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[.,;:!?]+$", "")), lambda w: w.rlike(_PRINTED))

    def value(word: Column) -> Column:
        number, printed = F.regexp_extract(word, r"^([^(]*)", 1), F.regexp_extract(word, r"\(([0-9]+)\)$", 1)
        return F.struct(word.alias("text"), number_in(number, "double").alias("x"), energy_uncertainty(number, printed)["value"].alias("dx"))

    return F.transform(plain, value)


def value_text(x: Column, dx: Column, limit: int = 35, most: int = 6) -> Column:
    """Value with its uncertainty in units of the last digit, as many digits as
    keep the uncertainty at most ``limit``: 12.34(5)."""
    decimals = F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.log10(F.lit(float(limit)) / dx)))).cast("int")
    scaled = F.round(x * F.pow(F.lit(10.0), decimals)).cast("long")
    unit = F.pow(F.lit(10.0), decimals).cast("long")
    whole, part = F.abs(scaled) % unit, (F.abs(scaled) - F.abs(scaled) % unit) / unit
    shown = F.concat(F.when(scaled < 0, "-").otherwise(""), part.cast("long").cast("string"), F.when(decimals > 0, F.concat(F.lit("."), F.lpad(whole.cast("string"), decimals, "0"))).otherwise(""))
    return F.concat(shown, F.lit("("), F.round(dx * F.pow(F.lit(10.0), decimals)).cast("long").cast("string"), F.lit(")"))
