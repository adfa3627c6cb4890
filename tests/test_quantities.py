import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import quantities as Q
from tests.conftest import rows

FIELDS = ("min_value", "max_value", "typical_value")
ROW = "param_id bigint, name string, min_value string, max_value string, typical_value string, unit string, description string"


def table(spark, *data):
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], ROW)


def one(spark, cell, unit=None, name="tX", description="A time."):
    got = Q.quantities(table(spark, (name, cell, None, None, unit, description)), "param_id", FIELDS, "unit", "name", "description").collect()
    return (got[0].kind, got[0].amount, got[0].origin) if got else None


CASES = [
    ("5 ns", 5_000), ("1.66usec", 1_660_000), ("−1.66usec", -1_660_000), ("- 9.9 ns", -9_900), ("+341 ps", 341), ("48 × 10^-6 s", 48_000_000), ("0.000082 * 10^-3 s", 82_000), ("1.4e2ps", 140), ("1,234 ns", 1_234_000),
    ("1,23 ns", 1_230), ("1,234.5 ns", 1_234_500), ("59 500 ns", 59_500_000), ("59 500\xa0ns", 59_500_000), (".5 ms", 500_000_000), ("typ. .5 ms", 500_000_000), ("max 360 nsec", 360_000), ("≤ 3 ns", 3_000), ("ca. 9.84 µs", 9_840_000), ("9.84 μs", 9_840_000),
    ("472 NS 1)", 472_000), ("4,85 ns (note 2)", 4_850), ("53.1 ns [3]", 53_100), ("53.1 ns *", 53_100), ("53.1 ns †", 53_100), ("0 s", 0), ("24.6S", 24_600_000_000_000), ("2.5 × 10⁻⁹ s", 2_500), ("7 milliseconds", 7_000_000_000), ("1 second", 10**12),
]


def test_cells(spark):
    df = table(spark, *[("tX", c, None, None, "GHz", None) for c, _ in CASES])
    got = {r.record_id: (r.kind, r.amount, r.origin) for r in Q.quantities(df, "param_id", FIELDS, "unit", "name", "description").collect()}
    assert got == {i: ("time", a, "cell") for i, (_, a) in enumerate(CASES)}


def test_no_cases(spark):
    for cell in ("TBD", "see note 3", "n/a", "-", "–", "", None, "50 %", "0.5 UI", "3 tCK", "2 × tPCLK", "4 cycles", "not tested", "5 V", "1.2.3 ns", "0.1 ps"):
        assert one(spark, cell, "ns") is None or cell == "0.1 ps", cell
    assert one(spark, "0.1 ps") is None  # not whole
    assert one(spark, "5", "cycles") is None and one(spark, "5", "%") is None


@pytest.mark.parametrize(
    ("cell", "unit", "name", "description", "want"),
    [
        ("5 ns", "ms", "tX (s)", "", ("time", 5_000, "cell")), ("5", "[ns]", "tX (s)", "", ("time", 5_000, "unit")), ("5", "in MHz", "f", None, ("frequency", 5_000_000, "unit")), ("5", "10^-3 s", "t", None, ("time", 5 * 10**9, "unit")),
        ("5", "-", "tX / usec", "All figures in s.", ("time", 5_000_000, "name")), ("5", "", "tX, 10^-6 s", None, ("time", 5_000_000, "name")), ("5", None, "fX", "Clock, values in kHz.", ("frequency", 5_000, "description")),
        ("5", None, "tX", "Delay; unit: usec", ("time", 5_000_000, "description")), ("5 1)", "ns", "tX", "Setup (ms).", ("time", 5_000, "unit")), ("1.233 x 10^6", "KHz", None, None, ("frequency", 1_233_000_000, "unit")), ("5", None, "tX", "In use.", (None, None, None)),
    ],
)
def test_unit_precedence(spark, cell, unit, name, description, want):
    assert one(spark, cell, unit, name, description) == want


def brute(cell, unit, name, description):
    """An independent reading of the definition, by hand on exact fractions."""
    def plain(s):
        return re.sub(r"\s+", " ", (s or "").lower().replace("−", "-").replace("×", "x").replace("μ", "u").replace("µ", "u")).strip()

    def find(s, whole):
        s = plain(s)
        units = "|".join(sorted(Q.UNITS, key=len, reverse=True))
        core = rf"(?:10 ?\^ ?(-?\d+) ?)?({units})"
        m = re.fullmatch(rf"[\[(]?(?:in )?{core}[\])]?", s) if whole else re.search(rf"(?:[\[(,/:]|\bin\b) ?{core}(?![a-z0-9])", s)
        return m and (Q.UNITS[m[2]][0], Q.UNITS[m[2]][1] + int(m[1] or 0))

    s = re.sub(r"( \d\)|\*|†|\[\d+\]|\(note \d+\)| )+$", "", plain(cell))
    m = re.match(r"^([^\d]*?)([-+]?) ?((?:\d[\d ,]*)?\.?\d[\d ]*|\d+)\s*(?:(?:x|\*) ?10\^(-?\d+)|e([-+]?\d+))? ?(.*)$", s)
    if not m or "note" in m[1]:
        return None
    number = re.sub(r",(?=\d{3}(?!\d))", "", m[3].strip()).replace(" ", "").replace(",", ".")
    rest = find(m[6], True) if m[6] else None
    if m[6] and not rest:
        return None
    found = rest or find(unit, True) or find(name, False) or find(description, False)
    if not found:
        return None
    power = int(m[4] or m[5] or 0) + found[1] - Q.BASE[found[0]]
    amount = Fraction(number) * Fraction(10) ** power * (-1 if m[2] == "-" else 1)
    return (found[0], int(amount)) if amount.denominator == 1 else None


def test_against_brute_force(spark, folder):
    t = spark.read.parquet(f"{folder}/timing_parameters.parquet")
    got = rows(Q.quantities(t, "param_id", FIELDS, "unit", "name", "description").filter("origin IS NOT NULL"), "record_id", "field", "kind", "amount")
    want = {(r.param_id, f, *b) for r in t.collect() for f in FIELDS if r[f] is not None and (b := brute(r[f], r.unit, r.name, r.description))}
    assert got == sorted(want, key=repr)


def test_inferred_units(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(600):
        ns = 10 ** rng.normal(2, 0.3)
        unit, scale = [("ns", 1), ("ps", 1e-3), ("us", 1e3)][i % 3]
        data.append(("tSU", f"{ns / scale:.6f}", None, None, unit if i % 2 else None, None))
    df = table(spark, *data)
    got = {r.record_id: r for r in Q.common_units(df, "param_id", FIELDS, "unit", "name", "description").collect()}
    right = [got[i].kind == "time" and abs(got[i].amount / (float(d[1]) * [1e3, 1, 1e6][i % 3]) - 1) < 1e-3 for i, d in enumerate(data) if d[4] is None]
    assert len(right) == 300 and sum(right) / len(right) > 0.97
    assert all(not r.uncertain or r.posterior < 0.95 for r in got.values())


def test_edge_rows(spark):
    df = table(spark, ("tX", "1 ns", None, None, None, None)).unionByName(table(spark, ("tX", "1 ns", None, None, None, None)))
    assert Q.quantities(df, "param_id", FIELDS, "unit", "name", "description").count() == 1
    for empty in (df.limit(0), table(spark, (None,) * 6)):
        assert Q.common_units(empty, "param_id", FIELDS, "unit", "name", "description").count() == 0
    clash = df.selectExpr("*", "1 AS u", "2 AS c", "3 AS kind", "4 AS __0", "5 AS amount")
    assert Q.common_units(clash, "param_id", FIELDS, "unit", "name", "description").count() == 1
    assert one(spark, "9" * 30 + " ns") is None
    assert one(spark, "x" * 10000 + "5 ns")[1] == 5_000


def hidden_units(spark, folder):
    """(posterior, right, uncertain) of the cells whose unit column is hidden, and which have no other unit."""
    t = spark.read.parquet(f"{folder}/timing_parameters.parquet")
    true = {(r.record_id, r.field): r for r in Q.common_units(t, "param_id", FIELDS, "unit", "name", "description").filter("origin = 'unit'").collect()}
    hidden = t.withColumn("unit", F.when(F.col("param_id") % 3 != 0, F.col("unit")))
    got = Q.common_units(hidden, "param_id", FIELDS, "unit", "name", "description").filter("origin = 'inferred'").collect()
    out = []
    for r in got:
        w = true.get((r.record_id, r.field))
        if w is not None and w.amount:
            out.append((r.posterior, r.kind == w.kind and abs(r.amount / w.amount - 1) < 1e-3, r.uncertain))
    return out


def test_hidden_units_and_reliability(spark):
    """Of the table's own cells: right as often as the posterior says, in bins, and nearly always where it isn't flagged."""
    out = hidden_units(spark, "/root/testdata/sf0.01")
    assert len(out) > 100
    assert np.mean([right for _, right, _ in out]) > 0.8
    sure = [right for _, right, uncertain in out if not uncertain]
    assert len(sure) > 0.4 * len(out) and np.mean(sure) > 0.95
    for low, high in ((0, 0.7), (0.7, 0.9), (0.9, 0.99), (0.99, 1.01)):
        part = [(p, right) for p, right, _ in out if low <= p < high]
        if len(part) >= 20:
            assert abs(np.mean([p for p, _ in part]) - np.mean([right for _, right in part])) < 0.15


def test_hot_name_and_unsized_parameters(spark):
    hot = [("tSU", f"{10 + i % 90}", None, None, "ns" if i % 2 else None, None) for i in range(900)]
    rare = [("tZ", "0", None, None, None, None), ("tN", "-5", None, None, None, None), (None, "7", None, None, None, None)]
    got = {r.record_id: r for r in Q.common_units(table(spark, *hot, *rare), "param_id", FIELDS, "unit", "name", "description").collect()}
    assert len(got) == 903 and all(got[i].kind == "time" and got[i].amount == (10 + i % 90) * 1000 for i in range(900))
    assert got[900].kind in ("time", "frequency") and got[901].uncertain and got[902].uncertain
