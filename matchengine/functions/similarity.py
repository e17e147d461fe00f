"""Similarity of two records, field by field."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchengine.schema import CONFIG, MatchConfig


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def z_score(a: Column, sa: Column, b: Column, sb: Column) -> Column:
    spread = F.sqrt(sa * sa + sb * sb)
    return F.abs(a - b) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def energy_similarity(a: Column, sa: Column, b: Column, sb: Column, c: MatchConfig = CONFIG) -> Column:
    z = z_score(a, sa, b, sb)
    return F.coalesce(F.exp(-c.sigma_scale * z * z), F.lit(0.0))


def best_option(a: Column, b: Column, score) -> Column:
    """Highest score of any option of ``a`` with any of ``b``; null if none."""
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: score(x, y)))))


def spin_similarity(a: Column, b: Column, c: MatchConfig = CONFIG) -> Column:
    def score(x: Column, y: Column) -> Column:
        loose = x["isTentativeSpin"] | y["isTentativeSpin"]
        apart = F.abs(x["twoTimesSpin"] - y["twoTimesSpin"])
        return (
            F.when(apart == 0, F.when(loose, c.spin_match_tentative).otherwise(c.spin_match_firm))
            .when(apart == 2, F.when(loose, c.spin_adjacent_tentative).otherwise(c.spin_adjacent_firm))
            .when(apart.isNotNull(), F.lit(c.spin_far))
        )

    return F.coalesce(best_option(a, b, score), F.lit(c.neutral))


def parity_similarity(a: Column, b: Column, c: MatchConfig = CONFIG) -> Column:
    def score(x: Column, y: Column) -> Column:
        loose = x["isTentativeParity"] | y["isTentativeParity"]
        same = F.when(loose, c.parity_match_tentative).otherwise(c.parity_match_firm)
        other = F.when(loose, c.parity_mismatch_tentative).otherwise(c.parity_mismatch_firm)
        return F.when(x["parity"] == y["parity"], same).when(x["parity"] != y["parity"], other)

    return F.coalesce(best_option(a, b, score), F.lit(c.neutral))


def specificity(n1: Column, n2: Column, form: str = CONFIG.specificity, alpha: float = CONFIG.specificity_alpha) -> Column:
    """How much a match of n1 x n2 options can tell."""
    m = (F.greatest(n1, F.lit(1)) * F.greatest(n2, F.lit(1))).cast("double")
    forms = {"sqrt": 1 / F.sqrt(m), "linear": 1 / m, "log": 1 / (1 + F.log10(m)), "tunable": 1 / (1 + alpha * (m - 1))}
    if form not in forms:
        raise ValueError(f"no specificity form {form!r}; there are {', '.join(forms)}")
    return forms[form]


def positive_gammas(gammas: Column) -> Column:
    return F.filter(gammas, lambda g: g["energy"] > 0)


def strongest(gammas: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(gammas, lambda g: g["intensity"])), F.lit(0.0))


def normalise_intensities(gammas: Column) -> Column:
    """Lines scaled to a strongest intensity of 100; unscaled without one."""
    return once(
        strongest(gammas),
        lambda top: F.transform(
            gammas,
            lambda g: F.struct(
                g["energy"].alias("energy"),
                g["energy_uncertainty"].alias("energy_uncertainty"),
                F.when(top > 0, g["intensity"] * 100 / F.when(top > 0, top)).otherwise(g["intensity"]).alias("intensity"),
                F.when(top > 0, g["intensity_uncertainty"] * 100 / F.when(top > 0, top)).otherwise(g["intensity_uncertainty"]).alias("intensity_uncertainty"),
            ),
        ),
    )


def _matched(a: Column, b: Column, cut: float, gain, by_z: bool) -> Column:
    """Sum of gains of a greedy one-to-one match of two line lists: each line of
    ``a`` in turn takes the nearest (or first) free line of ``b`` within the cut."""

    def take(acc: Column, x: Column) -> Column:
        ranked = F.transform(b, lambda y, i: F.struct(z_score(x["energy"], x["energy_uncertainty"], y["energy"], y["energy_uncertainty"]).alias("z"), i.alias("i"), y.alias("line")))
        free = F.filter(ranked, lambda r: (r["z"] <= cut) & ~F.array_contains(acc["used"], r["i"]))
        key = F.transform(free, lambda r: F.struct((r["z"] if by_z else r["i"].cast("double")).alias("k"), r["i"].alias("i"), r["line"].alias("line")))
        return once(F.array_min(key), lambda best: F.when(best.isNull(), acc).otherwise(F.struct(F.array_append(acc["used"], best["i"]).alias("used"), (acc["total"] + gain(x, best["line"])).alias("total"))))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("total"))
    return F.aggregate(a, start, take, lambda acc: acc["total"])


def greedy_matches(a: Column, b: Column, cut: float) -> Column:
    """Lines of ``a`` that take a free line of ``b`` within ``cut`` sigmas, each
    the nearest, in turn."""
    return _matched(a, b, cut, lambda x, y: F.lit(1.0), True)


def gamma_similarity(g1: Column, g2: Column, c: MatchConfig = CONFIG) -> Column:
    """Overlap of two line patterns that a subset of lines cannot lower."""
    a, b = positive_gammas(g1), positive_gammas(g2)

    def overlap(x: Column, y: Column) -> Column:
        near = z_score(x["intensity"], x["intensity_uncertainty"], y["intensity"], y["intensity_uncertainty"]) <= c.intensity_z
        return F.when(near, (x["intensity"] + y["intensity"]) / 2).otherwise(F.least(x["intensity"], y["intensity"]))

    total = lambda g: F.aggregate(g, F.lit(0.0), lambda s, x: s + x["intensity"])
    weighed = once(F.struct(normalise_intensities(a).alias("a"), normalise_intensities(b).alias("b")), lambda n: once(F.least(total(n["a"]), total(n["b"])), lambda least: F.when(least <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), _matched(n["a"], n["b"], c.energy_z, overlap, True) / F.when(least > 0, least)))))
    counted = _matched(a, b, c.energy_z, lambda x, y: F.lit(1.0), False) / F.least(F.size(a), F.size(b))
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(empty, F.lit(c.neutral)).when((strongest(a) > 0) & (strongest(b) > 0), weighed).otherwise(counted)


# Uncertainties of lines that have none in the older variant, its least and
# relative one of intensities, and its limit of intensities that agree.
OLD_ENERGY_ERROR, OLD_INTENSITY_ERROR, OLD_INTENSITY_SHARE, OLD_INTENSITY_Z = 1.0, 0.5, 0.1, 2.0


def old_gamma_similarity(g1: Column, g2: Column, c: MatchConfig = CONFIG) -> Column:
    """``gamma_similarity`` with the older variant's uncertainties and limit."""

    def filled(g: Column) -> Column:
        energy = F.when(g["energy_uncertainty"] > 0, g["energy_uncertainty"]).otherwise(F.lit(OLD_ENERGY_ERROR))
        least = F.when(g["intensity"] > 0, F.greatest(F.lit(OLD_INTENSITY_ERROR), OLD_INTENSITY_SHARE * g["intensity"])).otherwise(F.lit(0.0))
        return g.withField("energy_uncertainty", energy).withField("intensity_uncertainty", F.when(g["intensity_uncertainty"] > 0, g["intensity_uncertainty"]).otherwise(least))

    return gamma_similarity(F.transform(g1, filled), F.transform(g2, filled), replace(c, intensity_z=OLD_INTENSITY_Z))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def bray_curtis(a: Column, b: Column) -> Column:
    """2 x shared amount over the sum of both amounts."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return 2 * total(F.zip_with(a, b, lambda p, q: F.least(p, q).cast("double"))) / F.nullif(total(a) + total(b), F.lit(0.0))


def confidence(score: Column, c: MatchConfig = CONFIG) -> Column:
    return F.when(score == c.neutral, F.lit(c.neutral_confidence)).otherwise(score)


def physics_label(energy: Column, spin: Column, parity: Column, spec: Column, gamma: Column, c: MatchConfig = CONFIG) -> Column:
    """Match probability of a feature vector by rule."""
    veto = (spin <= c.spin_veto) | (parity <= c.parity_veto)
    agreeing = ((spin >= c.correlation_threshold) & (parity >= c.correlation_threshold)) | (gamma >= c.correlation_threshold)
    base = F.when(agreeing, F.pow(energy, F.lit(c.correlation_exponent))).otherwise(energy)
    label = base * F.sqrt(confidence(spin, c) * confidence(parity, c) * confidence(gamma, c)) * spec
    return F.when(veto, F.lit(0.0)).otherwise(F.least(F.greatest(label, F.lit(0.0)), F.lit(c.most)))


def snapped(gamma: Column, c: MatchConfig = CONFIG) -> Column:
    """Largest grid value not above ``gamma``."""
    chain = F.lit(c.gamma_grid[0])
    for value in c.gamma_grid[1:]:
        chain = F.when(gamma >= value, F.lit(value)).otherwise(chain)
    return chain


def filled_uncertainty(dx: Column, default: float = 10.0) -> Column:
    return F.coalesce(dx, F.lit(default))


def legacy_veto(spin1: Column, spin2: Column, parity1: Column, parity2: Column) -> Column:
    differ = lambda x, y: F.coalesce(x != y, F.lit(False))
    return differ(spin1, spin2) | differ(parity1, parity2)


def is_tentative(options: Column) -> Column:
    return F.exists(options, lambda o: o["isTentativeSpin"])


def options_overlap(a: Column, b: Column) -> Column:
    """Whether some option of both lists has the same spin and parity."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["twoTimesSpin"] == y["twoTimesSpin"]) & (x["parity"] == y["parity"])))


def options_close(a: Column, b: Column, most: int) -> Column:
    """Whether some options differ by at most ``most`` in spin."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x["twoTimesSpin"] - y["twoTimesSpin"]) <= 2 * most))
