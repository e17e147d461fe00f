"""Selection rules and conversions of nuclear data (published formulas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchengine.functions import text as tx

#: hbar in eV s.
HBAR = 6.582119569e-16


def coupled_spins(two_j_target: Column, two_j: Column) -> Column:
    """Twice the spins that two angular momenta couple to."""
    return F.sequence(F.abs(two_j_target - two_j), two_j_target + two_j, F.lit(2))


def transferred_parity(parity: Column, l_transfer: Column) -> Column:
    flip = F.pmod(l_transfer, F.lit(2)) == 1
    return F.when(flip, F.when(parity == "+", F.lit("-")).when(parity == "-", F.lit("+"))).otherwise(parity)


def multipolarities(two_j1: Column, p1: Column, two_j2: Column, p2: Column, most: int = 5) -> Column:
    """E and M multipolarities that take one state to the other, lowest first."""
    low, high = F.greatest(F.abs(two_j1 - two_j2), F.lit(2)), F.least(two_j1 + two_j2, F.lit(2 * most))
    orders = F.when(low <= high, F.sequence(low, high, F.lit(2))).otherwise(F.array().cast("array<int>"))
    same = p1 == p2
    # Electric radiation of order L changes parity as (-1)^L.
    return F.transform(orders, lambda k: F.concat(F.when(same == (F.pmod(k / 2, F.lit(2)) == 0), F.lit("E")).otherwise(F.lit("M")), (k / 2).cast("int").cast("string")))


# Units of half-lives in seconds.
HALF_LIFE_UNITS = {"Y": 31_556_926.0, "D": 86_400.0, "H": 3_600.0, "M": 60.0, "S": 1.0, "MS": 1e-3, "US": 1e-6, "NS": 1e-9, "PS": 1e-12, "FS": 1e-15, "AS": 1e-18}


def half_life_seconds(text: Column) -> Column:
    """Seconds of a half-life such as ``5 NS``; null for another text."""
    number = tx.number_in(F.regexp_extract(F.upper(text), r"^\s*([0-9.]+(?:E[-+]?[0-9]+)?)\s+[A-Z]+", 1), "double")
    unit = F.regexp_extract(F.upper(text), r"^\s*[0-9.]+(?:E[-+]?[0-9]+)?\s+([A-Z]+)", 1)
    scale = F.lit(None).cast("double")
    for name, seconds in HALF_LIFE_UNITS.items():
        scale = F.when(unit == name, F.lit(seconds)).otherwise(scale)
    return number * scale


def half_lives_differ(a: Column, b: Column) -> Column:
    """Whether two half-lives are not the same: ``5 NS`` is ``5000 PS``, and other
    texts must be equal."""
    x, y = half_life_seconds(a), half_life_seconds(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) > 1e-9 * F.abs(y)).otherwise(F.trim(a) != F.trim(b))


def multipolarity_parts(mult: Column) -> Column:
    """The multipolarities that a text names, without brackets: ``M1(+E2)``,
    ``(M1+E2)``, ``[M1,E2]`` all give M1 and E2."""
    plain = F.regexp_replace(F.upper(F.coalesce(mult, F.lit(""))), r"[\[\]()\s]", "")
    return F.array_distinct(F.filter(F.split(plain, "[+,]"), lambda m: m != ""))


# Orders of dipole, quadrupole and octupole radiation.
ORDERS = {"D": 1, "Q": 2, "O": 3}
def mult_unexpected(mult: Column, expected: Column) -> Column:
    """Whether a text names a multipolarity that the spins do not allow, in a mixture
    or as an alternative.  ``expected`` are E and M names; D, Q and O stand for either
    of their order.  No expected ones (a spin is unknown) allow everything."""
    letters = F.filter(F.array(*[F.when(F.arrays_overlap(expected, F.array(F.lit(f"E{n}"), F.lit(f"M{n}"))), F.lit(m)) for m, n in ORDERS.items()]), lambda m: m.isNotNull())
    return F.coalesce((F.size(expected) > 0) & (F.size(F.array_except(multipolarity_parts(mult), F.concat(expected, letters))) > 0), F.lit(False))


#: What a transition of unknown multipolarity may be.
USUAL = ("E1", "M1", "E2")


def _part(name: Column) -> Column:
    """(l, changes) of one multipolarity; null for another text."""
    order = tx.number_in(F.regexp_extract(name, "^[EM]([0-9])$", 1), "int")
    for letter, number in ORDERS.items():
        order = F.when(name == letter, F.lit(number)).otherwise(order)
    # Electric radiation of order L changes parity as (-1)^L, magnetic the other way.
    changes = F.when(name.rlike("^[EM]"), (F.pmod(order, F.lit(2)) == 1) == name.startswith("E"))
    return F.when(order.isNotNull(), F.struct(order.alias("l"), changes.alias("changes")))


def transitions(mult: Column) -> Column:
    """What a multipolarity allows, as alternatives, each an array of (l, changes)
    that all take part: ``M1+E2`` is one of two parts, ``E1,M2`` two of one.  A part
    in parentheses inside, as in ``M1(+E2)``, need not take part.  Unknown ones, and
    those in square brackets, which were taken from the levels themselves, are any of
    E1, M1 and E2."""
    text = F.regexp_replace(F.upper(F.coalesce(mult, F.lit(""))), r"\s", "")
    whole = F.regexp_replace(text, r"^\(([^()]*)\)$", "$1")
    firm = F.regexp_replace(F.regexp_replace(whole, r"\(\+?[^()]*\)", ""), r"^\+|\+$", "")
    listed = F.transform(F.split(firm, ","), lambda a: F.filter(F.transform(F.split(a, r"\+"), _part), lambda p: p.isNotNull()))
    known = F.filter(listed, lambda a: F.size(a) > 0)
    usual = F.transform(F.array(*map(F.lit, USUAL)), lambda m: F.array(_part(m)))
    return F.when(text.startswith("[") | (F.size(known) == 0), usual).otherwise(known)


def half_life_from_width(width_ev: Column, branching: Column | None = None) -> Column:
    """Half-life in seconds of a level of the given width."""
    whole = width_ev / branching if branching is not None else width_ev
    return F.when(whole > 0, HBAR * 0.6931471805599453 / whole)


def total_width(value: Column, kind: Column, factor: Column, branching: Column) -> Column:
    """The width of a level from what was measured: ``G`` the width itself, ``G0`` that
    to the ground state, ``G02/G`` its square over the width, each with ``g`` in front
    where the spin factor is part of it.  ``branching`` is that to the ground state;
    null where it is needed and not positive."""
    bare = F.when(kind.startswith("g"), value / F.nullif(factor, F.lit(0.0))).otherwise(value)
    known = F.when(branching > 0, branching)
    form = F.regexp_replace(kind, "^g", "")
    return F.when(form == "G", bare).when(form == "G0", bare / known).when(form == "G02/G", bare / (known * known))


def spin_factor(two_jx: Column, two_j0: Column) -> Column:
    return (two_jx + 1) / (two_j0 + 1)


def ti_to_branching(ti: Column, cc: Column) -> Column:
    return ti / (1 + cc)


def _log_ft_width(log_ft: Column, unc: Column) -> Column:
    """Uncertainty of a log ft value; a fifth of it where none is given."""
    return F.coalesce(unc, 0.2 * log_ft)


def _forbidden_log_ft(log_ft: Column, unc: Column, limit: Column) -> Column:
    """Whether a log ft is high enough for a first-forbidden unique transition;
    ``limit`` is the text of a limit, such as GT."""
    return (log_ft - _log_ft_width(log_ft, unc) >= 8.5) | ((log_ft >= 8.5) & F.coalesce(limit, F.lit("")).startswith("G"))


def log_ft_unlikely(dj: Column, parity_change: Column) -> Column:
    return F.when((dj > 2) | ((dj == 2) & ~parity_change), "decay branch is less likely")


def log_ft_conflict(log_ft: Column, unc: Column, limit: Column, dj: Column, parity_change: Column, unique: Column) -> Column:
    """Message where a log ft value does not fit the spins; null if it does."""
    allowed = ((log_ft > 3.6) & (log_ft + _log_ft_width(log_ft, unc) < 5.9)) | ((log_ft < 5.9) & F.coalesce(limit, F.lit("")).startswith("L"))
    forbidden = (F.upper(F.coalesce(unique, F.lit(""))) == "1U") & _forbidden_log_ft(log_ft, unc, limit)
    parity = F.when(allowed, parity_change).when(forbidden, ~parity_change)
    spin = F.when(allowed, dj > 1).when(forbidden, dj > 2)
    return F.when(parity & spin, "log ft does not fit the parity and spin change").when(parity, "log ft does not fit the parity change").when(spin, "log ft does not fit the spin change")


def unique_flag_missing(log_ft: Column, unc: Column, limit: Column, dj: Column, parity_change: Column, unique: Column) -> Column:
    """Message where a first-forbidden unique transition lacks its flag."""
    return F.when(_forbidden_log_ft(log_ft, unc, limit) & (dj == 2) & parity_change & (F.upper(F.coalesce(unique, F.lit(""))) != "1U"), "flag 1U is missing")


def zero_to_zero_conflict(log_ft: Column, unc: Column, zero_to_zero: Column) -> Column:
    """Message for 0+ to 0+ with a log ft inside the window, as the reference tells it."""
    return F.when(zero_to_zero & (log_ft > 3.6) & (log_ft + _log_ft_width(log_ft, unc) < 6.4), "log ft between 3.6 and 6.4 for 0+ to 0+")


def hindrance_conflict(hf: Column, unc: Column, limit: Column, odd_mass: Column, same_jpi: Column, natural_parity: Column) -> Column:
    """Message where a hindrance factor does not fit the spins; a fifth of it is
    its uncertainty where none is given, ``limit`` the text of a limit."""
    low = (hf + F.coalesce(unc, 0.2 * hf) < 4) | ((hf < 4) & F.coalesce(limit, F.lit("")).startswith("L"))
    return F.when(odd_mass & low & ~same_jpi, "hindrance factor below 4 needs equal spin and parity").when(~odd_mass & ~natural_parity, "alpha decay of an even nucleus goes to natural parity only")


def hindrance_spread(hf: Column, unc: Column, alpha: Column, alpha_unc: Column) -> Column:
    """Message where the relative uncertainties of a hindrance factor and of the
    branch that it comes from differ; none where one of them is zero."""
    share = F.try_divide(unc, hf)
    off = F.abs(F.try_divide(share, F.try_divide(alpha_unc, alpha)) - 1)
    return F.when((alpha_unc > 0) & ((off > 0.2) | ((off > 0.1) & (share > 0.1))), "relative uncertainties of hindrance factor and branching differ")


def zero_to_zero_gamma(two_ji: Column, two_jf: Column, parity_change: Column) -> Column:
    """Message for a gamma between spins 0; null where the parities are unknown."""
    return F.when((two_ji == 0) & (two_jf == 0), F.when(parity_change, "0 to 0 with a change of parity is not allowed").when(~parity_change, "0 to 0 is an E0 transition"))


def mult_differs(mult: Column, adopted: Column) -> Column:
    """Whether two multipolarities differ; the order of a mixed one does not
    count, and assumed ones, in brackets, are not compared."""
    parts = lambda m: F.array_sort(F.split(F.trim(m), "[+,]"))
    told = ~mult.contains("[") & ~adopted.contains("[")
    return told & ((parts(mult) != parts(adopted)) | (mult.contains(",") != adopted.contains(",")))


# Coefficients (of Z^4, Z^3, Z^2, Z, 1) of the gamma energy above
# which conversion is negligible, by multipolarity and conversion coefficient.
ICC_LIMITS = {
    ("E1", 0.005): (6.0e-6, -0.0004, 0.0157, 6.2482, 33.83),
    ("M1", 0.005): (0.0001, -0.0199, 1.4884, -33.671, 371.11),
    ("E2", 0.005): (6e-05, -0.0087, 0.533, -4.934, 227.78),
    ("M2", 0.005): (2.0e-04, -0.0365, 2.6047, -59.947, 700.11),
    ("E1", 0.01): (0.00001, -0.0017, 0.1078, 2.0458, 57.72),
    ("M1", 0.01): (0.0001, -0.0199, 1.4884, -33.671, 371.11),
    ("E2", 0.01): (4e-05, -0.0073, 0.441, -4.2227, 196.33),
    ("M2", 0.01): (6e-05, -0.0098, 0.719, -9.2396, 186.78),
}


def icc_energy(z: Column, multipolarity: str, coefficient: float) -> Column:
    """Energy above which internal conversion need not be given."""
    total = F.lit(0.0)
    for c in ICC_LIMITS[multipolarity, coefficient]:
        total = total * z + F.lit(c)
    return total


def icc_missing(energy: Column, z: Column, dj: Column, parity_change: Column, questionable: Column) -> Column:
    """Message for a gamma of so low an energy that its conversion counts (by the
    lowest multipolarity; half the limit for a questionable gamma)."""
    limit = lambda high, low: F.when(dj >= 2, icc_energy(z, high, 0.01)).otherwise(icc_energy(z, low, 0.01))
    upto = F.when(parity_change, limit("M2", "E1")).when(~parity_change, limit("E2", "M1"))
    return F.when((energy > 0) & (energy < F.when(questionable, upto / 2).otherwise(upto)), "conversion may not be negligible")


# Match probability at a z-score where nothing is vetoed.
Z_TABLE = (
    (0.0, 1.00), (0.5, 0.99), (1.0, 0.98), (1.5, 0.95), (1.8, 0.90), (2.0, 0.80), (2.2, 0.70), (2.5, 0.60), (2.8, 0.55),
    (3.0, 0.50), (3.2, 0.40), (3.5, 0.20), (4.0, 0.10), (5.0, 0.01), (10.0, 0.00), (20.0, 0.00), (100.0, 0.00),
)


def table_probability(z: Column, veto: Column) -> Column:
    """Probability by linear interpolation of the table; 0 under a veto."""
    chain = F.lit(0.0)
    for (z0, p0), (z1, p1) in reversed(list(zip(Z_TABLE, Z_TABLE[1:], strict=False))):
        chain = F.when(z < z1, F.lit(p0) + (z - z0) * F.lit((p1 - p0) / (z1 - z0))).otherwise(chain)
    return F.when(veto, F.lit(0.0)).otherwise(chain)
