"""Splitting oversized items at natural boundaries.

Method. One regular expression with bounded quantifiers takes a text apart: alternatives in the order of boundary strength
(blank line, line break, sentence end, clause mark, white space) each consume as much as the limit allows up to such a
boundary, first in the second half of what may be taken, then anywhere behind the overlap, then anywhere; the last takes
characters. The first piece may take the whole limit, the others what the overlap leaves. The matches cover the text without gaps. Every piece but the first looks back over the end of its predecessors
for the overlap. All of it is built-in array functions over code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What a piece may end with, the strongest first.
BOUNDARIES = [
    r"\r?\n\r?\n",
    r"\n",
    r"(?:[.!?…]['\"”’»)\]]?\s|[。！？．।]['\"”’»」』)\]]?)",
    r"(?:[;:,]\s|[；：，、])",
    r"\s",
]


def boundary_pattern(least: int, most: int, overlap: int) -> str:
    """Alternatives ordered by boundary strength: pieces of least to most code points, of more than the overlap, and, since
    only the first piece must hold the overlap alone, of any size behind it. The last alternative has no boundary."""
    inner = [f".{{{least - 1},{most - 4}}}", f".{{{overlap},{most - 4}}}"]
    short = min(overlap - 1, most - 5)
    if short >= 0:
        inner.append(rf"(?!\A)\s{{0,{most - 5 - short}}}\S.{{0,{short}}}")
    ends = [rf"{i}{b}" for i in inner for b in BOUNDARIES]
    return "|".join([rf".{{1,{most}}}\z", *ends, rf".{{1,{most}}}"])


def cutting_pattern(limit: int, overlap: int) -> str:
    """The first piece may take the whole limit; those behind it look back over the overlap and take the rest of it."""
    later = limit - overlap
    first = boundary_pattern(max(overlap, limit // 2), limit, overlap)
    return rf"(?s)(?:\A(?:{first})|(?!\A)(?:{boundary_pattern(max(overlap, later // 2), later, overlap)}))"


def cut_text(text: Column, limit: int = 1200, overlap: int = 100) -> Column:
    """array of struct(text, start): the pieces of a text, null for null."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("start")))
    cores = F.regexp_extract_all(text, F.lit(cutting_pattern(limit, overlap)), F.lit(0))
    return F.when(F.char_length(text) <= limit, whole).when(text.isNotNull(), F.transform(F.array(cores), lambda c: _with_overlap(c, overlap))[0])


def _with_overlap(cores: Column, overlap: int) -> Column:
    """Each core behind the end of those before it, and where that begins."""
    sizes = F.transform(cores, F.char_length)
    # one running sum: the end of every core
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    # a core shorter than the overlap leaves the rest of it to those before
    shorter = lambda i: F.array_join(F.slice(cores, F.greatest(F.lit(1), i - overlap), F.least(i, F.lit(overlap + 1))), "")
    before = lambda i: F.when(F.char_length(F.get(cores, i - 1)) >= overlap, F.get(cores, i - 1)).otherwise(shorter(i))
    text = lambda core, i: F.when(i == 0, core).otherwise(F.concat(F.right(before(i), F.lit(overlap)), core))
    start = lambda bound, i: F.when(i == 0, 0).otherwise(F.get(bound, i) - overlap)
    pieces = lambda bound: F.transform(cores, lambda core, i: F.struct(text(core, i).alias("text"), start(bound, i).alias("start")))
    return F.transform(F.array(ends), pieces)[0]


def pieces_of(items: DataFrame, key: str, text: str, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """What split_items gives, once for every row of items, without a shuffle."""
    cut = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), cut_text(F.col(text), limit, overlap).alias("c"))
    rows = cut.select("k", F.size("c").alias("n"), F.posexplode("c").alias("i", "x"))
    return rows.select(F.col("k").alias(key), F.col("i").alias("piece"), F.col("n").alias("pieces"), F.col("x.start").alias("start"), F.col("x.text").alias("text"))


def split_items(items: DataFrame, key: str, text: str, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """key, piece (0-based), pieces, start, text: every item with a text, whole.

    A text within the limit is one piece. Otherwise no piece is longer than limit code points, each after the first starts
    overlap code points before the end of its predecessor, and without those overlaps the pieces are the text. start is a
    0-based code-point offset. A null key or text gives no row, an empty text one empty piece. Repeated rows of one key and
    text give one set of pieces; rows of one key with another text give theirs as well.
    """
    return pieces_of(items.select(key, text).distinct(), key, text, limit, overlap)
