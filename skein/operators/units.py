"""Quantities recorded in different units.

Method. Units are nodes of a graph, conversions are edges with affine functions (target = a * source + b, exact
fractions). The shortest composition from every unit to the canonical unit of its dimension is computed once on the
driver, and every cycle is checked to compose to the identity. The result, one row for each spelling of a unit, is a table
of fixed size that the parsed values are equi-joined with on the source unit. Parsing is one pass of a pattern over each text;
arithmetic is on exact decimals and never fails: what can't be converted comes out with a reason.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from fractions import Fraction as Q

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical unit of each dimension.
CANONICAL = {
    "TEMPERATURE": "millikelvin",
    "CONCENTRATION": "part per billion",
    "DURATION": "millisecond",
    "LENGTH": "picometre",
    "PRESSURE": "millipascal",
    "RESISTANCE": "milliohm",
    "VOLTAGE": "microvolt",
}

#: Conversions: source, target, a, b with target = a * source + b. Fixed values.
EDGES: list[tuple[str, str, Q, Q]] = [
    ("kelvin", "millikelvin", Q(1000), Q(0)),
    ("celsius", "kelvin", Q(1), Q(27315, 100)),
    ("fahrenheit", "celsius", Q(5, 9), Q(-160, 9)),
    ("fahrenheit", "kelvin", Q(5, 9), Q(45967, 180)),
    ("part per million", "part per billion", Q(1000), Q(0)),
    ("percent", "part per million", Q(10_000), Q(0)),
    ("per mille", "part per million", Q(1000), Q(0)),
    ("per mille", "percent", Q(1, 10), Q(0)),
    ("microsecond", "millisecond", Q(1, 1000), Q(0)),
    ("second", "millisecond", Q(1000), Q(0)),
    ("minute", "second", Q(60), Q(0)),
    ("hour", "minute", Q(60), Q(0)),
    ("hour", "second", Q(3600), Q(0)),
    ("day", "hour", Q(24), Q(0)),
    ("week", "day", Q(7), Q(0)),
    ("angstrom", "picometre", Q(100), Q(0)),
    ("nanometre", "picometre", Q(1000), Q(0)),
    ("nanometre", "angstrom", Q(10), Q(0)),
    ("micrometre", "nanometre", Q(1000), Q(0)),
    ("millimetre", "micrometre", Q(1000), Q(0)),
    ("centimetre", "millimetre", Q(10), Q(0)),
    ("metre", "centimetre", Q(100), Q(0)),
    ("metre", "millimetre", Q(1000), Q(0)),
    ("kilometre", "metre", Q(1000), Q(0)),
    ("inch", "millimetre", Q(254, 10), Q(0)),
    ("inch", "centimetre", Q(254, 100), Q(0)),
    ("pascal", "millipascal", Q(1000), Q(0)),
    ("hectopascal", "pascal", Q(100), Q(0)),
    ("kilopascal", "pascal", Q(1000), Q(0)),
    ("megapascal", "kilopascal", Q(1000), Q(0)),
    ("gigapascal", "megapascal", Q(1000), Q(0)),
    ("millibar", "hectopascal", Q(1), Q(0)),
    ("bar", "millibar", Q(1000), Q(0)),
    ("bar", "kilopascal", Q(100), Q(0)),
    ("atmosphere", "pascal", Q(101_325), Q(0)),
    ("torr", "atmosphere", Q(1, 760), Q(0)),
    ("microohm", "milliohm", Q(1, 1000), Q(0)),
    ("ohm", "milliohm", Q(1000), Q(0)),
    ("kiloohm", "ohm", Q(1000), Q(0)),
    ("megohm", "kiloohm", Q(1000), Q(0)),
    ("gigaohm", "megohm", Q(1000), Q(0)),
    ("nanovolt", "microvolt", Q(1, 1000), Q(0)),
    ("millivolt", "microvolt", Q(1000), Q(0)),
    ("volt", "millivolt", Q(1000), Q(0)),
    ("kilovolt", "volt", Q(1000), Q(0)),
    ("megavolt", "kilovolt", Q(1000), Q(0)),
]

#: Spellings that mean a unit only in this letter case. Fixed values.
EXACT = {
    "celsius": ["C", "°C"],
    "fahrenheit": ["F", "°F"],
    "kelvin": ["K", "°K"],
    "angstrom": ["A", "Å"],
    "metre": ["m", "м"],
    "millimetre": ["mm", "MM", "мм"],
    "megapascal": ["MPa", "MPA", "МПа"],
    "millipascal": ["mPa", "мПа"],
    "megohm": ["MΩ", "MOhm", "Mohm", "МОм"],
    "milliohm": ["mΩ", "mOhm", "mohm", "мОм"],
    "megavolt": ["MV", "МВ"],
    "millivolt": ["mV", "мВ"],
    "second": ["s", "S", "с"],
    "volt": ["V", "В", "v"],
    "hour": ["h", "H", "ч"],
    "day": ["d"],
}

#: Spellings in any letter case, written in lower case, blanks squeezed. Fixed values.
ANY_CASE = {
    "millikelvin": ["mk", "millikelvin"],
    "kelvin": ["k", "kelvin", "kelvins", "deg k", "degk", "град. k", "к"],
    "celsius": ["°c", "° c", "º c", "ºc", "deg c", "degc", "deg. c", "cel", "celsius", "degree celsius", "degrees celsius", "град. c", "град. с", "°с", "grad c", "grad celsius"],
    "fahrenheit": ["°f", "° f", "º f", "ºf", "deg f", "degf", "deg. f", "fahrenheit", "degree fahrenheit", "degrees fahrenheit", "град. f", "grad f", "grad fahrenheit"],
    "part per billion": ["ppb", "ppbv", "part per billion", "parts per billion", "nl/l"],
    "part per million": ["ppm", "ppmv", "part per million", "parts per million", "µl/l", "ul/l", "ml/m3"],
    "per mille": ["‰", "per mille"],
    "percent": ["%", "percent", "per cent", "prozent", "vol%", "vol.%", "vol.-%", "vol %", "vol. %", "vol-%", "% v/v", "% (v/v)", "%v/v", "% vol", "% vol.", "percent by volume", "percent v/v", "volume percent", "об.%", "об. %", "% об."],
    "microsecond": ["µs", "us", "usec", "µsec", "microsecond", "microseconds", "мкс"],
    "millisecond": ["ms", "msec", "millisecond", "milliseconds", "millisekunde", "millisekunden", "мс"],
    "second": ["sec", "secs", "sec.", "second", "seconds", "sek", "sek.", "sekunde", "sekunden", "сек", "сек."],
    "minute": ["min", "min.", "mins", "minute", "minutes", "minuten", "мин", "мин."],
    "hour": ["hr", "hrs", "hr.", "hrs.", "hour", "hours", "std", "std.", "stunde", "stunden", "час", "часа", "часов"],
    "day": ["day", "days", "tag", "tage", "сут", "сут.", "дн", "дней", "д"],
    "week": ["week", "weeks", "woche", "wochen", "нед", "нед."],
    "picometre": ["pm", "picometre", "picometres", "picometer", "picometers", "пм"],
    "angstrom": ["å", "angstrom", "angstroms", "ångström", "ångstrom", "ангстрем"],
    "nanometre": ["nm", "nanometre", "nanometres", "nanometer", "nanometers", "нм"],
    "micrometre": ["µm", "um", "micron", "microns", "micrometre", "micrometres", "micrometer", "micrometers", "мкм"],
    "millimetre": ["millimetre", "millimetres", "millimeter", "millimeters"],
    "centimetre": ["cm", "centimetre", "centimetres", "centimeter", "centimeters", "см"],
    "metre": ["metre", "metres", "meter", "meters"],
    "kilometre": ["km", "kilometre", "kilometres", "км"],
    "inch": ["in", "in.", "inch", "inches", '"', "″", "”", "''", "zoll"],
    "pascal": ["pa", "pascal", "pascals", "па"],
    "hectopascal": ["hpa", "hectopascal", "hectopascals", "гпа"],
    "kilopascal": ["kpa", "kilopascal", "kilopascals", "кпа"],
    "megapascal": ["megapascal", "megapascals"],
    "gigapascal": ["gpa", "gigapascal", "gigapascals"],
    "millibar": ["mbar", "millibar", "millibars", "мбар"],
    "bar": ["bar", "bars", "бар"],
    "atmosphere": ["atm", "atm.", "atmosphere", "atmospheres", "атм", "атм."],
    "torr": ["torr", "торр"],
    "microohm": ["µω", "µohm", "uohm", "microohm", "microohms"],
    "milliohm": ["milliohm", "milliohms"],
    "ohm": ["ω", "ohm", "ohms", "ом"],
    "kiloohm": ["kω", "kohm", "kohms", "kiloohm", "kiloohms", "kilohm", "kilohms", "ком", "x1000 ohm", "10^3 ω", "10^3 ohm"],
    "megohm": ["megohm", "megohms", "megaohm", "megaohms", "10^6 ω", "10^6 ohm"],
    "gigaohm": ["gω", "gohm", "gohms", "gigaohm", "gigaohms", "гом", "10^9 ω", "10^9 ohm"],
    "nanovolt": ["nv", "nanovolt", "nanovolts", "нв"],
    "microvolt": ["µv", "uv", "microvolt", "microvolts", "мкв"],
    "millivolt": ["millivolt", "millivolts", "10^-3 v", "10^-3 volt"],
    "volt": ["volt", "volts", "vdc", "vac", "v dc", "v ac", "вольт"],
    "kilovolt": ["kv", "kilovolt", "kilovolts", "кв", "10^3 v"],
    "megavolt": ["megavolt", "megavolts"],
}

#: Qualifier types for which a bare percentage isn't a concentration.
OTHER_PERCENT = ["HUMIDITY"]
BARE_PERCENT = ["%", "percent", "per cent", "prozent"]


class InconsistentUnits(ValueError):
    """Two ways through the graph give different conversions."""


def compositions(edges: list[tuple[str, str, Q, Q]] = EDGES, canonical: dict[str, str] = CANONICAL) -> dict[str, tuple[str, Q, Q]]:
    """unit -> (dimension, a, b): the shortest composition to the canonical unit, after a check of every cycle.

    Breadth-first search from each canonical unit over edges in both directions finds fewest-edge paths. An edge that
    isn't on the tree closes a cycle; it must agree with the compositions of its ends, else InconsistentUnits is raised.
    """
    near: dict[str, list[tuple[str, Q, Q]]] = {}
    for source, target, a, b in edges:
        near.setdefault(target, []).append((source, a, b))
        near.setdefault(source, []).append((target, 1 / a, -b / a))
    out: dict[str, tuple[str, Q, Q]] = {}
    for dimension, root in canonical.items():
        out[root] = (dimension, Q(1), Q(0))
        queue = deque([root])
        while queue:
            at = queue.popleft()
            _, a1, b1 = out[at]
            for source, a, b in near.get(at, ()):  # at = a * source + b
                way = (dimension, a1 * a, a1 * b + b1)
                if source not in out:
                    out[source] = way
                    queue.append(source)
                elif out[source] != way:
                    raise InconsistentUnits(f"{source}: {out[source]} and {way}")
    return out


def conversion_rows() -> list[tuple[str, bool, str, int, int, int]]:
    """spelling, any letter case, dimension, multiplier, offset, divisor: canonical = (value * multiplier + offset) / divisor."""
    ways, rows = compositions(), []
    for names, any_case in ((EXACT, False), (ANY_CASE, True)):
        for unit, spellings in names.items():
            dimension, a, b = ways[unit]
            divisor = (a.denominator * b.denominator) // _gcd(a.denominator, b.denominator)
            rows += [(s, any_case, dimension, int(a * divisor), int(b * divisor), divisor) for s in spellings]
    return rows


def _gcd(x: int, y: int) -> int:
    while y:
        x, y = y, x % y
    return x


def conversion_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(conversion_rows(), "spelling string, any_case boolean, dimension string, multiplier long, offset long, divisor long")


#: Numbers in words up to ninety-nine; the parts are fixed values.
_ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: i for i, w in enumerate(_ONES, 1)} | {t: 10 * i for i, t in enumerate(_TENS, 2)} | {f"{t}-{o}": 10 * i + j for i, t in enumerate(_TENS, 2) for j, o in enumerate(_ONES[:9], 1)}

_DIGITS = r"(?:\d{1,3}(?:[ ']\d{3})+|\d+)(?:[.,]\d+)?"
_POWER = r"(?:[eE][-+]?\d+|\s*[x×·*]\s*10\s*\^?\s*[-+]?\d+)?"
_TOLERANCE = r"(?:\s*(?:±|\+/-|\+-)\s*\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)?"
#: words before the number; the number; its power of ten; a tolerance; the rest, which must be a unit as a whole.
QUANTITY = rf"^([^\d+-]*)([-+]?{_DIGITS})({_POWER}){_TOLERANCE}\s*(\D.*)?$"


def plain(text: Column) -> Column:
    """℃ and ℉ as two characters, digits above the line, minus signs, micro, ohm and angstrom signs and blanks in one form."""
    blanks = "".join(map(chr, [0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000]))
    special = F.replace(F.replace(text, F.lit("℃"), F.lit("°C")), F.lit("℉"), F.lit("°F"))
    special = F.regexp_replace(special, r"10\s*(?=[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹])", "10^")
    special = F.translate(special, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−" + blanks + "μΩÅK％’", "0123456789-+-" + " " * len(blanks) + "µΩÅK%'")
    text = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(special)
    return F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))


def _digits_for_words(text: Column) -> Column:
    """A number word in digits, in a text without digits."""
    words = "|".join(sorted(NUMBER_WORDS, key=lambda w: -len(w)))
    word = F.lower(F.regexp_extract(text, rf"(?i)(?:^|[\s~≈:])({words})(?=\s)", 1))
    value = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, str(n))])[word]
    spoken = F.when(word == "", text).otherwise(F.concat(value, F.regexp_extract(text, rf"(?i)(?:^|[\s~≈:])(?:{words})(\s.*)$", 1)))
    return F.when(text.rlike("[0-9]"), text).otherwise(spoken)


_MARK = "\x01"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once. As a lambda it also stays out of whole-stage code, where these patterns
    made methods too large for the JVM to compile."""
    return F.transform(F.array(value), then)[0]


def number_and_unit(text: Column) -> Column:
    """struct(number as text, unit or empty) of a text with a single quantity, else null.

    A range has a second number where the unit should be, so what is left of it names no unit.
    """
    marked = lambda t: F.split(F.regexp_replace(t, QUANTITY, f"{_MARK}$2{_MARK}$3{_MARK}$4"), _MARK)
    return _let(text, lambda raw: _let(plain(raw), lambda t: _let(_digits_for_words(t), lambda d: _let(marked(d), lambda parts: F.when(F.size(parts) == 4, _number_of(parts))))))


def _number_of(parts: Column) -> Column:
    digits, power = F.translate(parts[1], ",'+ ", "."), F.regexp_extract(parts[2], r"([-+]?\d+)$", 1)
    return F.struct(F.when(parts[2] == "", digits).otherwise(F.concat(digits, F.lit("e"), power)).alias("number"), F.trim(parts[3]).alias("unit"))


def _looked_up(df: DataFrame, name: Column, out: str, conversions: DataFrame) -> DataFrame:
    """df with the conversion of a unit's name, null if no unit is spelled so: equi-joins with the spellings of fixed letter
    case and, where those have none, with the others. Both tables are of fixed size."""
    conversion = F.struct("dimension", "multiplier", "offset", "divisor", "spelling")
    df = df.withColumn("_name", name).withColumn("_folded", F.lower("_name"))
    for any_case, key in ((False, "_name"), (True, "_folded")):
        known = F.broadcast(conversions.where(F.col("any_case") == any_case).select(F.col("spelling").alias(f"_key_{key}"), conversion.alias(f"_unit_{key}")))
        df = df.join(known, F.col(key) == F.col(f"_key_{key}"), "left")
    return df.withColumn(out, F.coalesce("_unit__name", "_unit__folded")).drop("_name", "_folded", "_key__name", "_key__folded", "_unit__name", "_unit__folded")


def judged_quantities(records: DataFrame, key: str, value: str, unit: str, text: str, qualifier: str) -> DataFrame:
    """key, dimension, base_value, reason: what every record states, in the canonical unit, or why there is no value.

    The text counts first if it has both a number and a unit, then the value with a unit of its own, then the value with
    the unit field, then the number of the text with the unit field. Nulls in any column make that source empty. reason is
    null beside a value, else 'no single number', 'unknown unit', 'other percentage', 'out of range' (beyond 64 bits or
    exact decimals) or 'below the base unit' (not zero, but rounded to it). Null keys give no row; repeated rows give one.
    """
    conversions = conversion_table(records.sparkSession)
    known = records.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(qualifier).alias("_q"), F.col(value).alias("_v"), F.col(unit).alias("_u"), number_and_unit(F.col(text)).alias("_t"))
    known = _looked_up(known, F.col("_t.unit"), "_c0", conversions)
    open_ = F.col("_c0").isNull()
    known = known.withColumn("_n", F.when(open_, number_and_unit(F.col("_v")))).withColumn("_p", _let(F.when(open_, F.col("_u")), plain))
    known = _looked_up(known, F.col("_n.unit"), "_c1", conversions)
    known = _looked_up(known, F.col("_p"), "_c2", conversions)
    choice = lambda number, c: F.struct(number.alias("n"), F.col(c).alias("c"))
    picked = (
        F.when(~open_, choice(F.col("_t.number"), "_c0"))
        .when(F.col("_c1").isNotNull(), choice(F.col("_n.number"), "_c1"))
        .when(F.col("_c2").isNotNull() & (F.col("_n.unit") == ""), choice(F.col("_n.number"), "_c2"))
        .when(F.col("_c2").isNotNull() & (F.col("_t.unit") == ""), choice(F.col("_t.number"), "_c2"))
    )
    counted = F.col("_t").isNotNull() | F.col("_n").isNotNull()
    at = known.select("_k", "_q", counted.alias("counted"), picked.alias("x")).select("_k", "_q", "counted", "x.n", "x.c.*")
    number = F.col("n").try_cast("decimal(38,12)")
    scaled = F.try_add(F.try_multiply(number, F.col("multiplier").cast("decimal(16,0)")), F.col("offset").cast("decimal(16,0)"))
    base = F.round(F.try_divide(scaled, F.col("divisor").cast("decimal(6,0)")), 0).try_cast("long")
    humid = F.coalesce(F.upper(F.trim("_q")).isin(OTHER_PERCENT) & F.col("spelling").isin(BARE_PERCENT), F.lit(False))
    at = at.withColumn("base", base)
    reason = (
        F.when(~F.col("counted"), "no single number").when(F.col("spelling").isNull(), "unknown unit").when(humid, "other percentage").when(F.col("base").isNull(), "out of range")
        .when((F.col("base") == 0) & (F.col("offset") == 0) & F.col("n").rlike("^[^eE]*[1-9]"), "below the base unit")
    )
    at = at.withColumn("reason", reason)
    return at.select(F.col("_k").alias(key), "dimension", F.when(F.col("reason").isNull(), F.col("base")).alias("base_value"), "reason").distinct()


def canonical_quantities(records: DataFrame, key: str, value: str, unit: str, text: str, qualifier: str) -> DataFrame:
    """key, dimension, base_value: every record that states a single value of a known dimension, in the canonical unit; see
    judged_quantities for the order of the sources and for the records left out."""
    return judged_quantities(records, key, value, unit, text, qualifier).where("reason is null").drop("reason")
