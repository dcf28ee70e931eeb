"""Rules over records as violation rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: a row for every rule a record breaks. A rule that can't be told (null) isn't broken. One pass for all rules."""
    broken = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def first_reason(reasons: list[tuple[str, Column]], fine: str = "OK") -> Column:
    """The name of the first condition that holds."""
    out = None
    for name, c in reasons:
        c = F.coalesce(c, F.lit(False))
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(fine)


def endpoint_violations(edges: DataFrame, source_label: str, kind: str, target_label: str, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """Edges whose kind doesn't allow their pair of labels; unknown labels and kinds aren't allowed."""
    table = edges.sparkSession.createDataFrame(allowed, f"{source_label} string, {kind} string, {target_label} string")
    return edges.join(F.broadcast(table), [source_label, kind, target_label], "left_anti")  # fixed size: the rule list


def probabilities_valid(p: Column, labels: list[str], predicted: Column) -> Column:
    """Whether a map has exactly the labels, finite values in [0, 1], a sum within 0.01 of 1, and its maximum at the predicted label."""
    values = F.map_values(p)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return F.coalesce((F.array_sort(F.map_keys(p)) == F.array(*[F.lit(x) for x in sorted(labels)])) & sound & (F.abs(total - 1) <= 0.01) & (F.element_at(p, predicted) == F.array_max(values)), F.lit(False))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(0.0)).otherwise(x)


#: Answers that contradict each other, then what an answer means, the strongest first; c: contradicts, a: supports all, s:
#: supports some, r: is relevant. Fixed values.
RELATION_RULES = [
    ("INVALID", "c is null or a is null or s is null or r is null"), ("CONTRADICTION_AND_SUPPORT", "c and (a or s)"), ("ALL_WITHOUT_SOME", "a and not s"), ("SOME_WITHOUT_RELEVANCE", "s and not r"),
    ("conflicting", "c"), ("full", "a"), ("partial", "s"), ("uncertain", "r"),
]


def relation_of(answers: dict[str, Column]) -> Column:
    """The relation that four yes-or-no answers amount to, or in capitals why they can't all be true; 'none' if all are no."""
    c, a, s, r = (answers[k] for k in "casr")
    unknown = c.isNull() | a.isNull() | s.isNull() | r.isNull()
    return first_reason([("INVALID", unknown), ("CONTRADICTION_AND_SUPPORT", c & (a | s)), ("ALL_WITHOUT_SOME", a & ~s), ("SOME_WITHOUT_RELEVANCE", s & ~r), ("conflicting", c), ("full", a), ("partial", s), ("uncertain", r)], "none")


# What two names may not hold one each.
#: Whatever else the names hold.
VETOES = [
    ("CARRIER_POLARITY", r"\bn\s*[- ]?type\b", r"\bp\s*[- ]?type\b"),
    ("OXIDATION_REDUCTION", r"\boxid(?:ation|iz(?:e|ed|ing))\b", r"\breduction\b"),
    ("ANALYTE", r"\bno\s*2\b", r"\bnh\s*3\b"),
]
#: If the names are equal without these.
CONTRASTS = [(r"\bhigh\b", r"\blow\b"), (r"\bincrease(?:d|s)?\b", r"\bdecrease(?:d|s)?\b"), (r"\bwith\b", r"\bwithout\b"), (r"\bpositive\b", r"\bnegative\b")]


def veto_reason(a: Column, b: Column) -> Column:
    """Why two names may never merge, or null: they hold two sides of an opposition in any order and letter case. Some hold
    whatever else the names say, some only between names that are equal, and not empty, without them."""
    a, b = F.lower(a), F.lower(b)

    def opposed(left: str, right: str) -> Column:
        return (a.rlike(left) & b.rlike(right)) | (a.rlike(right) & b.rlike(left))

    def rest(x: Column, left: str, right: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(x, f"{left}|{right}", " "), r"[^\p{L}\p{N}_]+", " "))

    absolute = {code: opposed(left, right) for code, left, right in VETOES}
    contrast = F.lit(False)
    for left, right in CONTRASTS:
        contrast |= opposed(left, right) & (rest(a, left, right) != "") & (rest(a, left, right) == rest(b, left, right))
    return (
        F.when(absolute["CARRIER_POLARITY"], "CARRIER_POLARITY").when(absolute["OXIDATION_REDUCTION"], "OXIDATION_REDUCTION").when(contrast, "QUALIFIER").when(absolute["ANALYTE"], "ANALYTE")
    )


def masked(text: Column) -> Column:
    """Bearer tokens and values of secret-looking keys in JSON text replaced by a mark."""
    text = F.regexp_replace(text, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[masked]")
    return F.regexp_replace(text, r'(?i)("[^"]*(?:token|secret|password|api_?key|authorization|cookie)[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}\]\s]+)', '$1"[masked]"')


_ANCHOR = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("code", T.StringType())])


@F.pandas_udf(_ANCHOR)
def reanchored(text: pd.Series, surface: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """The reported span if the text reads so there, else the only place where it does, else a reason."""
    rows = []
    for t, s, a, b in zip(text, surface, start, end):
        if not isinstance(t, str):
            rows.append((None, None, "TEXT_MISSING"))
        elif not isinstance(s, str) or not s:
            rows.append((None, None, "SURFACE_EMPTY"))
        elif a == a and b == b and a is not None and b is not None and 0 <= a < b and t[int(a) : int(b)] == s:
            rows.append((int(a), int(b), "REPORTED"))
        else:
            at = t.find(s)
            again = t.find(s, at + 1) if at >= 0 else -1
            rows.append((None, None, "NOT_FOUND") if at < 0 else (None, None, "AMBIGUOUS") if again >= 0 else (at, at + len(s), "RECOVERED"))
    return pd.DataFrame(rows, columns=["start", "end", "code"]).astype({"start": "Int32", "end": "Int32"})
