"""Quantities recorded in different units: exact conversion of text, and a mixture model where units are missing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.lineage import cut
from foliant.plans.skew import attach

# Units of time as powers of ten of a second, of frequency as powers of ten of a hertz.
TIME_UNITS = {"ps": -12, "psec": -12, "picosecond": -12, "ns": -9, "nsec": -9, "nanosecond": -9, "us": -6, "usec": -6, "microsecond": -6, "ms": -3, "msec": -3, "millisecond": -3, "s": 0, "sec": 0, "second": 0}
FREQUENCY_UNITS = {"hz": 0, "hertz": 0, "khz": 3, "kilohertz": 3, "mhz": 6, "megahertz": 6, "ghz": 9, "gigahertz": 9}
#: Powers of ten of the common units: amounts are picoseconds and hertz.
BASE = {"time": -12, "frequency": 0}
UNITS = {u: ("time", e) for u, e in TIME_UNITS.items()} | {u: ("frequency", e) for u, e in FREQUENCY_UNITS.items()}
UNITS |= {u + "s": v for u, v in UNITS.items() if u.endswith("second")}

_ANY = "|".join(sorted(UNITS, key=len, reverse=True))
_POWER = r"10 ?\^ ?([-+]?\d{1,2})"
_UNIT = rf"(?:(?:[x*] ?)?{_POWER} ?)?({_ANY})"
_NUMBER = r"\d+(?:[ ,]+\d+)*(?:\.(?:\d+(?: \d+)*)?)?|(?<![a-z\d])\.\d+(?: \d+)*"
_FOOTNOTE = r"(?: *(?:(?<=[ a-z%])\d{1,2}\)|\*+|[†‡§¶]+|\[[^\]]*\]|\( *(?:notes?\.? *)?[\d, ]+\)|[¹²³⁴⁵⁶⁷⁸⁹⁰]+))+ *$"
#: sign, mantissa, power of ten (written out, or after e), and what follows.
CELL = rf"^(?:(?![^0-9]*(?:note|see |fig|table|sect|page|ref))[^0-9]*?)([-+]?) *({_NUMBER}) ?(?:[x*] ?{_POWER}|e([-+]?\d{{1,2}}))? *([^ ].*)?$"


def _plain(c: Column) -> Column:
    """Lower case, one kind of blank, minus, multiplication sign and micro; powers of ten written with ^."""
    c = F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " ")
    c = F.translate(c, "−–—×·∙μµ", "---xxxuu")
    raised = F.regexp_replace(c, "(10) ?([⁻⁺]?)([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", "$1^$2$3")
    return F.trim(F.when(c.rlike("10 ?[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]"), F.translate(raised, "⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹", "-+0123456789")).otherwise(c))


#: A unit as one number: its power of ten, with FREQUENCY added for hertz.
FREQUENCY = 1000


def _code(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for u, (kind, e) in UNITS.items() for x in (u, e + FREQUENCY * (kind == "frequency"))])
    return F.try_element_at(table, unit)


def _unit(c: Column, pattern: str) -> Column:
    """The code of the unit that ``pattern`` (groups: power of ten, unit) finds; null if none."""
    return _code(F.regexp_extract(c, pattern, 2)) + F.coalesce(F.regexp_extract(c, pattern, 1).try_cast("int"), F.lit(0))


def _column_unit(plain: Column) -> Column:
    """The unit that a cell of a unit column consists of, in brackets or after "in" or not."""
    return _unit(plain, rf"^[(\[]?(?:in |unit:? )?[(\[]?{_UNIT}[)\]]?\.?$")


def _text_unit(plain: Column) -> Column:
    """The unit that a text mentions as one: in brackets, after a comma, slash or colon, or after "in"."""
    return _unit(plain, rf"(?:[(\[,/:;=]|\bin\b|\bunits?\b) ?{_UNIT}(?![a-z0-9^])")


def _names_other_unit(plain: Column) -> Column:
    return F.coalesce(plain.rlike(r"^[(\[]?(?:in )?[(\[]?(?:%|per ?cent|ui|unit intervals?|t?cycles?|clk|clocks?|clock cycles?|tck|tp?clk|lsb|ppm)[)\]]?$"), F.lit(False))


def parse_cells(df: DataFrame, cell: str) -> DataFrame:
    """``df`` with v_number, v_negative, v_digits, v_power, v_unit and v_other; v_number is false without a number of its own.

    The value is digits · 10^power, exactly. v_unit is the code of the cell's unit or null; v_other is true if something follows
    that is no unit of time or frequency. A comma before exactly three digits groups, any other is a decimal mark; blanks group.
    Each step is a projection of its own and nothing is filtered here: a filter would be pushed down with copies of every step.
    """
    out = df.columns
    part = lambda i: F.get("__parts", F.lit(i))
    df = df.withColumn("__cell", _plain(F.col(cell)))
    df = df.withColumn("__cell", F.trim(F.regexp_replace("__cell", _FOOTNOTE, "")))
    df = df.withColumn("__parts", F.split(F.regexp_replace("__cell", CELL, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001"))
    df = df.withColumn("__number", F.regexp_replace(F.regexp_replace(F.regexp_replace(part(1), r",(?=\d{3}(?!\d))", ""), " +", ""), ",", "."))
    df = df.withColumns({"__split": F.split("__number", r"\."), "v_unit": _unit(part(4), rf"^{_UNIT}\.?$")})
    df = df.withColumn("__decimals", F.coalesce(F.get("__split", F.lit(1)), F.lit("")))
    return df.select(
        *out,
        F.coalesce((F.size("__parts") == 5) & (F.size("__split") < 3), F.lit(False)).alias("v_number"),
        (part(0) == "-").alias("v_negative"),
        F.regexp_replace(F.concat(F.get("__split", F.lit(0)), "__decimals"), "^0+(?=.)", "").alias("v_digits"),
        (F.coalesce(part(2).try_cast("int"), part(3).try_cast("int"), F.lit(0)) - F.length("__decimals")).alias("v_power"),
        "v_unit",
        (F.col("v_unit").isNull() & (part(4) != "")).alias("v_other"),
    )


def _barrier(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, below which no later filter is pushed."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__row")).select("__row.*")


def scaled(digits: Column, power: Column, negative: Column) -> Column:
    """digits · 10^power as an exact bigint; null if it isn't whole or doesn't fit."""
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    made = (
        F.when(digits.rlike("^0*$"), "0")
        .when(power >= 0, F.when(F.length(digits) + power <= 18, F.concat(digits, F.repeat(F.lit("0"), F.greatest(F.lit(0), power.cast("int"))))))
        .when(zeros >= -power, F.substring(digits, F.lit(1), F.greatest(F.lit(0), F.length(digits) + power)))
    )
    value = made.try_cast("bigint")
    return F.when(negative, -value).otherwise(value)


def quantities(df: DataFrame, record_id: str, fields: Sequence[str], unit: str, name: str, description: str) -> DataFrame:
    """One row for each value cell with a number that may be a time or a frequency.

    (record_id, field, name, kind, amount, origin, log10, bare): origin says where the unit was found (cell, unit, name or description,
    in this order of precedence) or is null, and then kind and amount are null. bare is the number as it stands, log10 its size (null for
    zero and negative ones). Numbers in clock cycles, per cent or unit intervals, by the cell or its unit column, and cells without a
    number give no row; so do amounts that are not whole picoseconds or hertz. A record delivered again counts once; null ids give no
    rows. Everything is one scan of JVM expressions and one distinct.
    """
    base = df.select(F.col(f"`{record_id}`").alias("record_id"), *[F.col(f"`{c}`").cast("string").alias(f"__{i}") for i, c in enumerate([*fields, unit, name, description])]).filter("record_id IS NOT NULL").distinct()
    k = len(fields)
    base = base.withColumns({"u": _plain(F.col(f"__{k}")), "n": _plain(F.col(f"__{k + 1}")), "d": _plain(F.col(f"__{k + 2}"))})
    base = base.withColumns({"in_unit": _column_unit(F.col("u")), "no_unit": _names_other_unit(F.col("u")), "in_name": _text_unit(F.col("n")), "in_text": _text_unit(F.col("d"))})
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{i}").alias("cell")) for i, f in enumerate(fields)]))
    rows = base.select("record_id", F.col(f"__{k + 1}").alias("name"), "in_unit", "no_unit", "in_name", "in_text", cells.alias("c")).select("record_id", "name", "in_unit", "no_unit", "in_name", "in_text", "c.field", "c.cell")
    rows = parse_cells(rows, "cell")
    origin = F.when(F.col("v_unit").isNotNull(), "cell").when(F.col("in_unit").isNotNull(), "unit").when(F.col("in_name").isNotNull(), "name").when(F.col("in_text").isNotNull(), "description")
    rows = rows.withColumns({"origin": origin, "code": F.coalesce("v_unit", "in_unit", "in_name", "in_text")})
    kind = F.when(F.col("code") > FREQUENCY // 2, "frequency").when(F.col("code").isNotNull(), "time")
    shift = F.col("v_power") + F.when(F.col("code") > FREQUENCY // 2, F.col("code") - FREQUENCY - BASE["frequency"]).otherwise(F.col("code") - BASE["time"])
    used = F.col("v_number") & ~F.col("v_other") & (F.col("v_unit").isNotNull() | ~F.col("no_unit"))
    rows = rows.withColumns({"kind": kind, "shift": shift, "used": used})
    digits = F.col("v_digits").cast("double")
    log10 = F.when(~F.col("v_negative"), F.log10(digits) + F.col("v_power"))
    bare = F.when(F.col("v_negative"), -digits).otherwise(digits) * F.pow(F.lit(10.0), F.col("v_power").cast("double"))
    out = rows.select("used", "record_id", "field", "name", "kind", scaled(F.col("v_digits"), F.col("shift"), F.col("v_negative")).alias("amount"), "origin", log10.alias("log10"), bare.alias("bare"))
    return _barrier(out).filter("used AND (origin IS NULL OR amount IS NOT NULL)").drop("used")


# Units that a missing one may be: kind and power of ten.
CANDIDATES = [("time", -12), ("time", -9), ("time", -6), ("time", -3), ("time", 0), ("frequency", 0), ("frequency", 3), ("frequency", 6), ("frequency", 9)]
#: Sizes are counted in bins of so many parts of a power of ten.
BINS = 20
#: Width in bins of the kernel that smooths a parameter's density, and cells that its broad background counts for.
_WIDTH, _BACKGROUND = 3, 2.0
#: Where a kind's sizes lie that nothing is known of: mean and spread of log10 in seconds and hertz.
_BROAD = {"time": (-7.5, 3.0), "frequency": (6.5, 3.0)}


class _Density:
    """The density of one kind's sizes on the grid of bins: counts under a smooth kernel, over a broad normal background."""

    def __init__(self, kind: str, low: int, high: int):
        self.kind, self.low, self.grid = kind, low - 5 * _WIDTH, np.arange(low - 5 * _WIDTH, high + 5 * _WIDTH + 1)
        kernel = np.exp(-0.5 * (np.arange(-4 * _WIDTH, 4 * _WIDTH + 1) / _WIDTH) ** 2)
        self.kernel = kernel / kernel.sum()
        self.value = self._normal(*_BROAD[kind])

    def _normal(self, mean: float, spread: float) -> np.ndarray:
        return np.exp(-0.5 * ((self.grid / BINS - mean) / spread) ** 2) / (spread * BINS * np.sqrt(2 * np.pi))

    def fit(self, y: np.ndarray, n: np.ndarray) -> None:
        counts = np.bincount(y - self.low, weights=n, minlength=len(self.grid))
        total = counts.sum()
        mean, spread = _BROAD[self.kind]
        if total > 2:
            mean = float(counts @ self.grid) / total / BINS
            spread = max(1.0, 1.5 * float(np.sqrt(counts @ (self.grid / BINS - mean) ** 2 / total)))
        self.value = (np.convolve(counts, self.kernel, "same") + _BACKGROUND * self._normal(mean, spread)) / (total + _BACKGROUND)

    def at(self, y: np.ndarray) -> np.ndarray:
        return self.value[y - self.low]


def _fit(name: str, hist: pd.DataFrame, rounds: int = 30) -> pd.DataFrame:
    """The mixture of one parameter, fitted by EM, and what it makes of each of its sizes.

    ``hist`` counts cells by kind and power of their written unit (null without one) and bin of their size (null for zero and negative
    numbers). All components of a kind are one density of true sizes, offset by the known factors; a component's weight is its
    share of the parameter's cells. A kind that is written nowhere, where another one is, hardly counts. Returned are kind, power and bin as
    given, and the likeliest kind (as), power (by) and posterior; a written unit is the only candidate.
    """
    kind, power, size, n = hist["kind"].to_numpy(object), hist["power"].to_numpy(float), hist["bin"].to_numpy(float), hist["n"].to_numpy(float)
    written = np.array([k is not None and k == k for k in kind], dtype=bool)
    known, free, bare = written & ~np.isnan(power) & ~np.isnan(size), ~written & ~np.isnan(size), ~written & np.isnan(size)
    kinds, offsets = np.array([k for k, _ in CANDIDATES]), np.array([p * BINS for _, p in CANDIDATES])
    true = (size[known] + power[known] * BINS).astype(int)
    shifted = size[free].astype(int)[:, None] + offsets[None, :]
    every = np.concatenate([true, shifted.ravel(), [0]])
    density = {k: _Density(k, int(every.min()), int(every.max())) for k in _BROAD}
    seen = {k: float(n[written & (kind == k)].sum()) for k in _BROAD}
    prior = np.array([1e-3 if sum(seen.values()) and not seen[k] else 0.5 for k in kinds])
    counted = np.array([n[known & (kind == k) & (power == p)].sum() for k, p in CANDIDATES])
    weight = (counted + prior) / (counted + prior).sum()
    for k in _BROAD:
        at = kind[known] == k
        density[k].fit(true[at], n[known][at])
    post = np.zeros(shifted.shape)
    for _ in range(rounds if free.any() else 0):
        like = weight * np.stack([density[k].at(shifted[:, i]) for i, k in enumerate(kinds)], axis=1)
        post = like / like.sum(1, keepdims=True)
        mass = post * n[free][:, None]
        weight = counted + mass.sum(0) + prior
        weight /= weight.sum()
        for k in _BROAD:
            at, mine = kind[known] == k, kinds == k
            density[k].fit(np.concatenate([true[at], shifted[:, mine].ravel()]), np.concatenate([n[known][at], mass[:, mine].ravel()]))
    out = pd.DataFrame({"name_key": name, "kind": hist["kind"], "power": hist["power"], "bin": hist["bin"], "n": hist["n"], "as": kind, "by": power, "posterior": 1.0})
    for rows, p in ((free, post), (bare, np.tile(weight, (int(bare.sum()), 1)))):
        best = p.argmax(1)
        out.loc[rows, "as"], out.loc[rows, "by"], out.loc[rows, "posterior"] = kinds[best], offsets[best] / BINS, p[np.arange(len(best)), best]
    return out


def name_key(c: Column) -> Column:
    """What a parameter's name says without its unit and spelling."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(c, r"^\s*([^\s,(\[/]*)", 1)), r"[^\p{L}\p{N}]", ""), F.lit(""))


def _bin(log10: Column) -> Column:
    return F.round(log10 * BINS).cast("int")


def unit_posteriors(rows: DataFrame) -> DataFrame:
    """(name_key, kind, power, bin, n, as, by, posterior): for each parameter's cells of one written unit (or none) and size, the likeliest unit.

    Sizes are counted in bins of log10, so a parameter's group is bounded by bins and units however many rows it has.
    """
    hist = rows.groupBy("name_key", "kind", "power", "bin").agg(F.count(F.lit(1)).alias("n"))
    schema = "name_key string, kind string, power int, bin int, n bigint, as string, by int, posterior double"
    return hist.groupBy("name_key").applyInPandas(lambda key, h: _fit(key[0], h), schema)


def common_units(df: DataFrame, record_id: str, fields: Sequence[str], unit: str, name: str, description: str, sure: float = 0.95) -> DataFrame:
    """Every number of ``quantities`` in picoseconds or hertz, with units inferred where none is written.

    (record_id, field, kind, amount, origin, posterior, uncertain). Each number's unit is the candidate of the highest posterior under its
    parameter's mixture: a written unit is the only candidate, of posterior 1, and its amount is exact; where none is written anywhere,
    origin is "inferred" and the amount is rounded to whole units. ``uncertain`` flags a posterior below ``sure``.
    Zero and negative numbers without a unit have no size: zero is zero in the likeliest kind, a negative amount goes by the likeliest unit.
    Rows meet what the mixture says of their size through ``attach``, so a frequent parameter is not one task's.
    """
    q = quantities(df, record_id, fields, unit, name, description)
    base = F.when(F.col("kind") == "time", BASE["time"]).otherwise(0)
    amount_log = F.when(F.col("amount") > 0, F.log10(F.col("amount").cast("double")) + base)
    q = q.withColumns({"name_key": name_key(F.col("name")), "power": F.round(amount_log - F.col("log10")).cast("int"), "bin": _bin(F.col("log10"))})
    cell = F.concat_ws("|", "name_key", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("kind", "power", "bin")])
    q = cut(q.withColumn("cell", cell))
    said = unit_posteriors(q).select(cell.alias("cell"), "n", "as", "by", "posterior")
    rows = attach(q, said, ["cell"], "n")
    size = F.when(F.col("log10").isNotNull(), F.pow(F.lit(10.0), F.col("log10"))).otherwise(F.col("bare"))
    shift = F.col("by") - F.when(F.col("as") == "time", BASE["time"]).otherwise(0)
    sized = F.round(size * F.pow(F.lit(10.0), shift.cast("double")))
    amount = F.when(F.col("origin").isNotNull(), F.col("amount")).when(F.abs(sized) < 9e18, sized.cast("bigint"))
    return rows.select("record_id", "field", F.col("as").alias("kind"), amount.alias("amount"), F.coalesce("origin", F.lit("inferred")).alias("origin"), "posterior", (F.col("posterior") < sure).alias("uncertain"))
