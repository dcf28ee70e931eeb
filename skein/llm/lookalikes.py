"""Visually identical text made of different characters.

Method. A value is brought to its compatibility form, ignorable characters are deleted, and blanks and hyphens get one form.
Every character left that has look-alikes in other scripts opens a lattice column of those that occur in reference names. A Viterbi search picks the
path with the best score under a character trigram model of the reference names, in which a change of script inside a word
costs extra; accents are characters of their own between the columns and are never changed, nor is letter case. The path
found is the value's consistent form, and values meet the reference names in an equi-join on it.

The model is the table of trigram counts of the reference names, whose size the alphabets bound, not the number of names; it
is counted in Spark, checked and sent to the tasks.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that look the same, by shape. Fixed values.
SHAPES = (
    "AАΑᎪ BВΒᏴ CСϹᏟ DᎠ EЕΕᎬ FϜ GԌᏀ HНΗᎻ IІΙӀ JЈͿᎫ KКΚᏦ LᏞ MМΜᎷ NΝ OОΟՕ PРΡᏢ QԚ RᎡ SЅՏᏚ TТΤᎢ UՍ VѴᏙ WԜᎳ XХΧ YҮΥУ ZΖᏃ ГΓ ПΠ ФΦ "
    "aа cсϲ dԁ eе hһհ iі jјϳյ lӏ nո oоοօ pрρ qԛզ sѕ uս vνѵ wԝ xх yу gɡց"
).split()
#: Hyphens that look like the plain one.
HYPHENS = "‐‑‒−﹣－"
#: Characters without a shape of their own, beside format characters (category Cf). Fixed values.
IGNORABLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Trigrams that may be sent to the tasks.
MAX_TRIGRAMS = 2_000_000
#: Log cost of a change of script inside a word.
SCRIPT_CHANGE = 4.0

_COLUMN = {c: shape for shape in SHAPES for c in shape}
_EDGE = "\x02"


def compatible(text: str) -> str:
    """Compatibility form without ignorable characters, with plain blanks and hyphens, decomposed."""
    text = unicodedata.normalize("NFKC", text)
    text = "".join("-" if c in HYPHENS else c for c in text if unicodedata.category(c) != "Cf" and ord(c) not in IGNORABLE)
    return unicodedata.normalize("NFD", " ".join(re.split(r"\s+", text)).strip())


@lru_cache(maxsize=100_000)
def script_of(c: str) -> str:
    """Script of a letter by its Unicode name, empty for anything else."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


class TrigramModel:
    """Character trigrams with interpolated shorter contexts."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, self.one = counts, {}, {}
        context: dict[str, int] = {}
        for gram, n in counts.items():
            self.two[gram[1:]] = self.two.get(gram[1:], 0) + n
            self.one[gram[2]] = self.one.get(gram[2], 0) + n
            context[gram[:2]] = context.get(gram[:2], 0) + n
        middle: dict[str, int] = {}
        for gram, n in self.two.items():
            middle[gram[0]] = middle.get(gram[0], 0) + n
        self.context, self.middle, self.total = context, middle, max(1, sum(self.one.values()))
        self.memo: dict[str, float] = {}
        # a character of no name can't lead to a name, so only the one in the text stays beside those of the names
        self.columns = {c: "".join(o for o in shape if o == c or o in self.one) for c, shape in _COLUMN.items()}

    def score(self, gram: str) -> float:
        """log P(third character | first two)."""
        known = self.memo.get(gram)
        if known is None:
            p = (
                0.90 * self.three.get(gram, 0) / max(1, self.context.get(gram[:2], 0))
                + 0.08 * self.two.get(gram[1:], 0) / max(1, self.middle.get(gram[1], 0))
                + 0.0199 * self.one.get(gram[2], 0) / self.total
                + 1e-6
            )
            known = self.memo[gram] = math.log(p)
        return known

    def best(self, text: str) -> str:
        """The best path through the lattice of a text in the form of compatible()."""
        # state: the last two characters and the script of the word so far
        states: dict[tuple[str, str], tuple[float, str]] = {(_EDGE * 2, ""): (0.0, "")}
        for c in text:
            following: dict[tuple[str, str], tuple[float, str]] = {}
            for option in self.columns.get(c, c):
                script = script_of(option)
                for (last, word), (score, path) in states.items():
                    change = SCRIPT_CHANGE if script and word and script != word else 0.0
                    s = score + self.score(last + option) - change
                    key = (last[1] + option, "" if option == " " else script or word)
                    if key not in following or s > following[key][0]:
                        following[key] = (s, path + option)
            states = following
        ends = [(score + self.score(last + _EDGE), path) for (last, _), (score, path) in states.items()]
        return max(ends)[1] if ends else ""


@F.pandas_udf(T.StringType())
def compatible_form(values: pd.Series) -> pd.Series:
    codes, words = pd.factorize(values)
    forms = pd.Series([compatible(w) for w in words] + [None], dtype=object)
    return pd.Series(forms.to_numpy()[codes])


def trigram_counts(names: Column, df: DataFrame) -> dict[str, int]:
    """Counts of the trigrams of names in their compatible form, with edges."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, int] = {}
            for name in batch["n"]:
                text = _EDGE * 2 + compatible(name) + _EDGE
                for i in range(len(text) - 2):
                    found[text[i : i + 3]] = found.get(text[i : i + 3], 0) + 1
            yield pd.DataFrame({"gram": list(found), "n": list(found.values())})

    counts = df.select(names.alias("n")).where("n is not null").mapInPandas(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.limit(MAX_TRIGRAMS + 1).collect()
    if len(rows) > MAX_TRIGRAMS:
        raise ValueError(f"more than {MAX_TRIGRAMS} trigrams in the reference names")
    return {r.gram: r.n for r in rows}


def consistent_form(model: TrigramModel):
    """A column function: the consistent form of each value, decomposed; null for null."""
    three = model.three
    memo: dict[str, TrigramModel] = {}

    def form(values: pd.Series) -> pd.Series:
        if "m" not in memo:
            memo["m"] = TrigramModel(three)
        codes, words = pd.factorize(values)
        forms = pd.Series([memo["m"].best(compatible(w)) for w in words] + [None], dtype=object)
        return pd.Series(forms.to_numpy()[codes])

    return F.pandas_udf(form, T.StringType())


def meant_names(values: DataFrame, value: str, names: DataFrame, name: str, name_id: str) -> DataFrame:
    """The rows of values with the name_id of the reference name that a reader sees in them, if they differ from it in code points.

    Null values and values that look like no name give no row; a value that looks like several equal names gives one row
    each. Repeated rows stay repeated. Without names there are no rows.
    """
    model = TrigramModel(trigram_counts(F.col(name), names))
    reference = names.where(F.col(name).isNotNull()).select(F.col(name_id).alias("_id"), F.col(name).alias("_name"), compatible_form(name).alias("_form")).distinct()
    formed = values.where(F.col(value).isNotNull()).withColumn("_form", consistent_form(model)(value))
    return formed.join(reference, "_form").where(F.col(value) != F.col("_name")).withColumnRenamed("_id", name_id).drop("_form", "_name")
