from fractions import Fraction as Q

import pytest

from skein.operators import units

SCHEMA = "id string, value string, unit string, text string, kind string, dimension string, n int"

CASES = [
    (("a", None, None, "≈ 240 angstroms"), ("LENGTH", 24000)),
    (("b", "24", "нм", "≈ 240 angstroms"), ("LENGTH", 24000)),
    (("c", "2.5E-02volts", None, "at 0.025 volts"), ("VOLTAGE", 25000)),
    (("d", None, None, "0.002 to 0.01 V"), None),
    (("e", None, None, "-20 … 20 deg C"), None),
    (("f", None, None, "-40–0 °F"), None),
    (("g", "0,0092", "volt", "held at 0,0092 V"), ("VOLTAGE", 9200)),
    (("h", None, None, "about 5 100 000 microvolts"), ("VOLTAGE", 5100000)),
    (("i", None, None, "~10'000'000 ppb"), ("CONCENTRATION", 10000000)),
    (("j", None, None, "ca. 8·10⁻³ millivolts"), ("VOLTAGE", 8)),
    (("k", None, None, "при 4 × 10^-1 mV"), ("VOLTAGE", 400)),
    (("l", None, None, "636 ± 2℃"), ("TEMPERATURE", 909150)),
    (("m", None, None, "bei −2.2e1°F"), ("TEMPERATURE", 243150)),
    (("n", "716", "F", None), ("TEMPERATURE", 653150)),
    (("o", "36", '"', None), ("LENGTH", 914400000000)),
    (("p", "6000", "n/a", "≈ 6000.0 megohms"), ("RESISTANCE", 6000000000000)),
    (("q", None, "K", None), None),
    (("r", None, None, "room temperature"), None),
    (("s", "85", None, "85 % RH"), None),
    (("t", "80", "samples", "80 samples"), None),
    (("u", "12", "n/a", "ca. twelve pascals"), ("PRESSURE", 12000)),
    (("v", None, None, "1 atm"), ("PRESSURE", 101325000)),
    (("w", None, None, "5 mPa"), ("PRESSURE", 5)),
    (("x", None, None, "5 MPa"), ("PRESSURE", 5000000000)),
    (("y", "2", "ч", None), ("DURATION", 7200000)),
    (("z", "15", "10^6 Ω", None), ("RESISTANCE", 15000000000)),
    (("aa", "0.0785", None, None), None),
    (("ab", "", "", ""), None),
    (("ac", None, None, None), None),
    (("ad", None, None, "40 %", "HUMIDITY"), None),
    (("ae", None, None, "40 %", "conc."), ("CONCENTRATION", 400000000)),
    (("af", None, None, "6.5 Gohm"), ("RESISTANCE", 6500000000000)),
    (("ag", "2", "km", None), ("LENGTH", 2000000000000000)),
    (("ah", None, None, "9000 km"), ("LENGTH", 9000000000000000000)),
    (("ai", None, None, "20000 km"), None),
    (("aj", "384400", "km", None), None),
    (("ak", None, None, "1e20 km"), None),
    (("al", None, None, "1e99 km"), None),
    (("am", None, None, "0.4 ppb"), None),
    (("an", None, None, "0.0 ppb"), ("CONCENTRATION", 0)),
]
REASONS = {"d": "unknown unit", "q": "no single number", "t": "unknown unit", "ac": "no single number", "ad": "other percentage", "ai": "out of range", "aj": "out of range", "ak": "out of range", "al": "out of range", "am": "below the base unit"}


def test_records_without_a_value_have_a_reason(spark):
    df = spark.createDataFrame([(*(c if len(c) == 5 else (*c, None)), None, 1) for c, _ in CASES] + [(None, "1", "K", None, None, None, 1)], SCHEMA)
    got = {r.id: (r.base_value, r.reason) for r in units.judged_quantities(df, "id", "value", "unit", "text", "kind").collect()}
    assert {k: (None, v) for k, v in REASONS.items()}.items() <= got.items()
    assert all((reason is None) == (want is not None) for (c, want) in CASES for reason in [got[c[0]][1]])


def test_every_notation(spark):
    rows = [(*(c if len(c) == 5 else (*c, None)), None, 1) for c, _ in CASES]
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], "clash", 1) for r in rows] * 2, SCHEMA)
    got = {r.id: (r.dimension, r.base_value) for r in units.canonical_quantities(df, "id", "value", "unit", "text", "kind").collect()}
    assert got == {c[0]: want for c, want in CASES if want}
    assert units.canonical_quantities(df.limit(0), "id", "value", "unit", "text", "kind").count() == 0


def test_compositions_agree_on_every_path():
    ways = units.compositions()
    assert ways["hour"] == ("DURATION", Q(3_600_000), 0)
    dimension, a, b = ways["fahrenheit"]
    assert dimension == "TEMPERATURE" and 32 * a + b == 273_150 and 212 * a + b == 373_150
    assert {u for names in (units.EXACT, units.ANY_CASE) for u in names} <= set(ways)


def test_a_wrong_edge_is_found_by_its_cycle():
    with pytest.raises(units.InconsistentUnits):
        units.compositions([*units.EDGES, ("hour", "millisecond", Q(3_599_999), Q(0))])


def test_spellings_are_unambiguous():
    exact = [s for names in units.EXACT.values() for s in names]
    folded = [s for names in units.ANY_CASE.values() for s in names]
    assert len(exact) == len(set(exact)) and len(folded) == len(set(folded))
    assert all(s == s.lower() for s in folded)
