"""Sentence units with exact spans, across languages and scripts.

Method. Blank lines cut a text into blocks. Inside a block every end mark with the closing marks behind it is a candidate
boundary. A semi-Markov dynamic program picks the whole sentence spans with the best sum of scores, where a span is scored
by its length, its opening word, its closing word and whether quotation marks and brackets are balanced in it, all at once.
Abbreviations, ordinals, list numbers, decimals, initials and quoted sentences are thus weighed against what follows them.
Scripts without letter case or blanks are scored by the particles that can't begin a sentence.

The claimed language of a record may be wrong or missing and a text may mix languages, so an abbreviation is judged in the
language of the words around it. What it counts for depends on its kind and on what follows: some are always followed by
something, some only by a number, some may close a sentence if the next word is one that opens sentences. Offsets are
half-open code-point spans.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import dealt

# Abbreviations by language in lower case, without the last period.
#: Something always follows these.
ALWAYS = {
    "en": "e.g i.e cf vs viz approx ca std dr mr mrs ms prof",
    "de": "z z.b b d d.h bzw vgl inkl evtl ggf sog bd hr fr dr prof ca tel",
    "fr": "p.ex ex env c.-à-d m mm mme mlle cf réf av dr",
    "ru": "т т.е т.к т.н см напр т.д ср ул проф им тел",
    "hi": "मि मि.ग्रा ग्रा डॉ सं कि.मी से.मी कि से श्री प्रो पृ",
}
#: A number, a label or a symbol follows these.
NUMBERED = {
    "en": "fig figs eq eqs sec secs tab tabs ref refs no nos vol ch p pp ed eds art pat ser appl jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "abb abschn nr mind kap gl tab str art bd max min jan feb mär apr aug sept okt nov dez",
    "fr": "fig no tab chap éq art tél p janv févr avr juil sept oct nov déc",
    "ru": "рис разд табл п пп гл стр кв д ок г гг",
    "hi": "",
}
#: These close a sentence if a word follows that opens sentences.
MAY_CLOSE = {"en": "resp al dev st incl max min", "de": "h b str inkl std", "fr": "", "ru": "", "hi": ""}
#: What is an abbreviation in another language only, and here a word like any other.
ORDINARY = {
    "en": set("mind str tel env bd b h m p c z d mar".split()),
    "de": set("no fig art".split()),
    "fr": set("sec dev mind max".split()),
}
#: Units of time behind a number.
TIMES = {"min", "sec", "std", "hr", "hrs"}
ABBREVIATIONS: dict[str, dict[str, str]] = {}
for _kind, _lists in (("always", ALWAYS), ("numbered", NUMBERED), ("may_close", MAY_CLOSE)):
    for _lang, _words in _lists.items():
        for _word in _words.split():
            ABBREVIATIONS.setdefault(_word, {})[_lang] = _kind
#: Words by which the language of a passage is told.
FUNCTION_WORDS = {
    "en": set("the of and is was to in for with at by this that it from are were has be an on as after".split()),
    "de": set("der die das und ist war wird von mit bei in im zur zum nach nicht ein eine dem den auf aus des als für wurde sind".split()),
    "fr": set("le la les de des et est du une un dans par pour avec sur au en pas ce cette sont l'art".split()),
}
#: Capitalized words that open a sentence more likely than they go on with one.
OPENERS = set(
    """the this these that those it its he she they we you i there here in on at for from with when where while if as after before since because although however thus therefore moreover then a an our all each some no both what why how who does did is are
    die der das den dem ein eine es er sie wir ich danach dann dort hier im am bei nach vor wenn als da weil jedoch daher somit alle jede diese dieser dieses was wie warum wer ist sind
    le la les un une il elle ils elles nous ce cette ces dans en sur pour par avec quand si car ainsi puis alors ensuite est
    в на из при по для это эта этот эти он она оно они мы я если когда затем потом после однако поэтому все каждый что как почему""".split()
)
#: A sentence may end in these.
MAY_BE_LAST = set("etc usw др пр т.п т.д inc ltd corp co u.s u.k s.a a.u r.h r.p.m a.c d.c a.m p.m г гг в д jr sr ph.d u.a u.ä i.d.r с.-р min sec".split())
#: Words before an ordinal number.
BEFORE_ORDINAL = set("am der die das den dem des vom zum im bis seit ab und einen ein eine beim jeder jede jedes".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
#: Characters that can't begin a Chinese or Japanese sentence.
PARTICLES = set("的と、，はがをにでもへのや；：")
END = ".!?…。！？．।॥｡"
WIDE_END = "。！？．।॥｡"
CLOSING = "”\"»’'」』)]）】›］〉》"
OPEN_TO_CLOSE = {"“": "”", "„": "“", "«": "»", "»": "«", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "‹": "›", "《": "》"}
CLOSE = set("”“»«」』)]）】›》")

_MARKS = re.compile("[\"" + re.escape("".join({*OPEN_TO_CLOSE, *CLOSE})) + "]")
_BLANK_LINE = re.compile(r"\r?\n[^\S\r\n]*\r?\n\s*|\x0c+| +")
_ENDS = re.compile(rf"[{re.escape(END)}]+")
_TOKEN = re.compile(r"\S*$")
_MIXED_START = re.compile(r"^[a-zα-ω]{1,2}-?[A-Z]")
_LAST_PART = re.compile(r"[^.!?…]*$")
_NUMBER = re.compile(r"^\(?\d{1,3}$")
_AMOUNT = re.compile(r"(?:^|[\s(])\d[\d.,]*\s*$")
_INITIALS = re.compile(r"(?:[A-Z]\.-?)+[A-Z]$")
_ROMAN = re.compile(r"[IVX]{2,5}$")
_ELISION = re.compile(r"^(?:[ldcjmnst]|qu)['’](?=\w)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")


def _quote_depth(block: str) -> np.ndarray:
    """Depth of matched quotation marks and brackets behind each place."""
    stack: list[tuple[str, int]] = []
    pairs = []
    for m in _MARKS.finditer(block):
        i, c = m.start(), m.group()
        if c == '"':
            if any(s[0] == '"' for s in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                pairs.append((stack.pop()[1], i))
            else:
                stack.append((c, i))
        elif c in CLOSE and any(OPEN_TO_CLOSE.get(s[0]) == c for s in stack):
            while OPEN_TO_CLOSE.get(stack[-1][0]) != c:
                stack.pop()
            pairs.append((stack.pop()[1], i))
        elif c in OPEN_TO_CLOSE and not (c == "»" and i and not block[i - 1].isspace()):
            stack.append((c, i))
    step = np.zeros(len(block) + 1, dtype=np.int32)
    for a, b in pairs:
        step[a + 1] += 1
        step[b + 1] -= 1
    return np.cumsum(step)


def _language(block: str, mark: int, end: int) -> str:
    """The language in Latin letters of the words around a mark, empty if they don't tell."""
    around = block[max(0, mark - 120) : mark].lower().split()[1:-1] + block[end : end + 60].lower().split()[:-1]
    counts = sorted(((sum(w in words for w in around), lang) for lang, words in FUNCTION_WORDS.items()), reverse=True)
    return counts[0][1] if counts[0][0] > counts[1][0] else ""


def _abbreviation_score(block: str, mark: int, end: int, word: str) -> float | None:
    """How well a sentence closes with an abbreviation, by its kind and what follows; None for an ordinary word."""
    kinds = ABBREVIATIONS[word]
    if set(kinds) <= {"ru", "hi"}:
        kind = next(iter(kinds.values()))
    else:
        lang = _language(block, mark, end)
        if lang not in kinds and word in ORDINARY.get(lang, ()):
            return None
        # in another language the strictest of the kinds counts
        kind = kinds.get(lang) or min(kinds.values())
    following = block[end : end + 30].split(None, 1)
    bare = following[0].strip("([{«„“\"'‘.,;:)") if following else ""
    if kind == "always":
        return -8.0
    opens = _opens(following[0]) if following else False
    if kind == "may_close":
        return 2.0 if opens else -8.0
    if bare[:1].isupper() and bare[1:].islower() and (opens or len(bare) > 3) and not any(c.isdigit() for c in bare):
        return 2.0 if opens else -2.0
    return -8.0


def _opens(token: str) -> bool:
    """Whether a capitalized word opens a sentence more likely than it goes on with one."""
    bare = token.strip("([{«„“\"'‘.,;:)")
    abbreviated = token.endswith(".") and bare.lower() in ABBREVIATIONS
    return bare[:1].isupper() and len(bare) > 1 and bare.lower() in OPENERS and not abbreviated


def _closing_score(block: str, mark: int, end: int) -> float:
    """How well a sentence closes with the word before the mark at `mark`; closing marks end at `end`."""
    run = block[mark:end].rstrip(CLOSING)
    if any(c in run for c in "!?！？") or run[-1] in "。｡।॥":
        return 3.0
    if run[-1] == "．":
        return -9.0 if block[mark - 1 : mark].isdigit() and block[end : end + 1].isdigit() else 3.0
    if run[0] == "…" or len(run) > 1:
        return 0.5
    word = _TOKEN.search(block[max(0, mark - 40) : mark]).group().lstrip("([{«„“\"'‘「（")
    low = word.lower()
    before = block[max(0, mark - len(word) - 30) : mark - len(word)]
    if _NUMBER.match(word):
        start = before.rstrip(" \t\r\n\xa0\u3000\u2009(")
        previous = _TOKEN.search(start).group().lower()
        # a number alone at the beginning, or behind a sentence, opens a list entry
        unit = re.search(r"(?:^|[\s(])\d[\d.,]*\s*\w{1,2}\.$", start)
        if not start or (start[-1] in END + CLOSING + "“" and (unit or previous.rstrip(".") not in ABBREVIATIONS) and not previous.endswith((")", "]"))):
            return -8.0
        if previous in BEFORE_ORDINAL:
            return -3.0
        return 1.5
    core = _ELISION.sub("", low.rstrip("."))
    if len(core) <= 2 and core.isalpha() and _AMOUNT.search(before):
        return 2.0  # a unit behind its number
    if core == "д" and before.rstrip().endswith("т."):
        return 0.5  # and so on
    if core in TIMES and _AMOUNT.search(before):
        return 2.0
    known = core if core in ABBREVIATIONS else "bzw" if core.endswith("-bzw") else "str" if core.endswith("str") and len(core) > 5 else ""
    if not known:
        last = _LAST_PART.search(core).group()
        if len(core) > len(last) > 1 and last in ABBREVIATIONS:
            known = last  # glued to the sentence before
    if known:
        score = _abbreviation_score(block, mark, end, known)
        if score is not None:
            return score
    following = block[end : end + 30].split(None, 1)
    if _INITIALS.match(word):
        # letters of a country or a name: followed by a name or a noun, unless a word opens a sentence
        return 1.5 if following and _opens(following[0]) else -3.0 if following and following[0][:1].isupper() and "-" not in word else -5.0 if "-" in word else 0.5
    if core in MAY_BE_LAST:
        return 0.5
    if _ROMAN.match(word) and (not before.strip() or before.rstrip()[-1] in END):
        return -5.0
    tail = core.rsplit(".", 1)[-1]
    if len(tail) == 1 and tail.isalpha() and "." in core:
        return 0.0
    if len(word) == 1 and word.isalpha():
        return -5.0 if word.isupper() or ord(word) > 127 else -4.0
    return 2.5


def _opening_score(block: str, mark: int, end: int, start: int) -> float:
    """How well a sentence opens at `start` behind the closing marks that end at `end`."""
    following = block[start : start + 24]
    word = following.split(None, 1)[0] if following.strip() else ""
    c = word[:1]
    quoted = any(q in "”»’」』“\"" for q in block[mark:end])
    glued = start == end
    wide = block[mark] in WIDE_END
    if wide and (_CJK.search(block[max(0, mark - 8) : mark + 8]) or block[mark] in "。｡．"):
        return -9.0 if c in PARTICLES or c in ",)）" else 1.0
    if block[mark] in "।॥":
        if quoted and (_DEVANAGARI.match(c) or c.islower()):
            return -6.0
        return 1.0
    bare = word.lstrip("([{«„“\"'‘「（¿¡")
    if not bare:
        return -2.0 if word else 1.0
    c = bare[0]
    if glued:
        # without a blank only a capitalized word or a long preceding word makes a boundary likely
        if c.isupper() and len(bare) > 1 and (bare[1].islower() or bare[1].isspace()) or (c.isupper() and len(bare) == 1):
            before = _TOKEN.search(block[max(0, mark - 40) : mark]).group()
            unit = re.search(r"\d\s*\w{1,2}$", block[max(0, mark - 12) : mark])
            return 0.0 if len(before) > 2 or unit or block[mark - 1 : mark].isdigit() else -6.0
        if _CJK.match(c) and block[mark] in "!?":
            return 0.5
        if c.isdigit() or c.isalpha():
            before = re.search(r"[^\W\d_]*$", block[max(0, mark - 40) : mark]).group()
            return -1.5 if len(before) >= 4 and (c.isdigit() or c.isupper()) and not block[mark + 1 : mark + 2].islower() else -9.0
        return -9.0
    if bare.rstrip(".,").lower() in MONTHS:
        return -4.0
    if c.isupper():
        return 1.0
    if c.isdigit():
        return 0.5
    if c.islower():
        if _MIXED_START.match(bare) or re.search(r"[ऀ-ॿ぀-ヿ㐀-鿿]", block[max(0, mark - 12) : mark]):
            return 0.5
        return -2.5 if "Ͱ" <= c <= "Ͽ" else -7.0
    if c.isalpha():  # scripts without letter case
        return 0.0
    return -1.0 if c in "-–—,;:)%" else 0.0


#: Mild preference for spans of some tens of characters; next to nothing is no sentence.
LENGTH_WEIGHT, USUAL_LENGTH = 0.12, 80.0
#: Cost of a mark that isn't outside of all quotation marks and brackets.
UNBALANCED = 9.0


def _program(starts: list[int], ends: list[int], opening: list[float], closing: list[float], deep: list[int]) -> list[int]:
    """Where the best span that ends at each candidate begins.

    The length term lies between 0 and -bound for spans of two characters and more, so a start that trails another by more
    than the bound can't win for any later end, and is dropped; few starts stay, whatever the number of candidates.
    """
    bound = LENGTH_WEIGHT * max(abs(math.log(2 / USUAL_LENGTH)), abs(math.log(max(2, ends[-1]) / USUAL_LENGTH)))
    back = [0]
    alive = [(opening[0] - UNBALANCED * (deep[0] != 0), 0)]
    for j in range(1, len(ends) + 1):
        end = ends[j - 1]
        top, at = -math.inf, 0
        for value, i in alive:
            n = end - starts[i]
            score = value + (-LENGTH_WEIGHT * abs(math.log(n / USUAL_LENGTH)) if n >= 2 else -8.0)
            if score > top:
                top, at = score, i
        back.append(at)
        if j == len(ends):
            break
        following = ends[j]
        alive.append((top + closing[j - 1] - UNBALANCED * (deep[j] != 0) + opening[j] - UNBALANCED * (deep[j] != 0), j))
        if len(alive) > 4:
            least = max((v for v, i in alive if following - starts[i] >= 2), default=-math.inf) - bound
            alive = [a for a in alive if a[0] >= least]
    return back


def _block_spans(block: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a block that neither starts nor ends with white space."""
    depth = _quote_depth(block)
    ends, starts, closing, opening, deep = [], [0], [], [0.0], [0]
    for m in _ENDS.finditer(block):
        end = m.end()
        if m.group() == "." and block[end : end + 1].isdigit() and block[m.start() - 1 : m.start()].isdigit():
            continue  # part of a number
        while end < len(block) and (block[end] in CLOSING or (block[end] == "“" and depth[end + 1] < depth[end])):
            end += 1
        # a blank before a closing guillemet
        if end + 1 < len(block) and block[end].isspace() and block[end + 1] == "»" and depth[end + 2] < depth[end + 1]:
            end += 2
        if end >= len(block):
            break
        start = end
        while start < len(block) and block[start].isspace():
            start += 1
        if ends and ends[-1] >= end:
            continue
        mark = m.end() - 1 if len(m.group()) == 1 else m.start()
        ends.append(end)
        starts.append(start)
        closing.append(_closing_score(block, mark, end))
        opening.append(_opening_score(block, mark, end, start))
        deep.append(int(depth[end]))
    ends.append(len(block))
    closing.append(0.0)
    deep.append(0)
    n = len(ends)
    if n == 1:
        return [(0, len(block))]
    back = _program(starts, ends, opening, closing, deep)
    spans, j = [], n
    while j:
        i = back[j]
        spans.append((starts[i], ends[j - 1]))
        j = i
    return spans[::-1]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Half-open spans of the sentence units of a text. A text of white space has none."""
    spans, at = [], 0
    borders = [(m.start(), m.end()) for m in _BLANK_LINE.finditer(text)] + [(len(text), len(text))]
    for stop, following in borders:
        block = text[at:stop]
        lead = len(block) - len(block.lstrip())
        block = block.strip()
        if block:
            spans += [(at + lead + a, at + lead + b) for a, b in _block_spans(block)]
        at = following
    return spans


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def spans_of(texts: pd.Series) -> pd.Series:
    codes, words = pd.factorize(texts)
    found = [[{"start": a, "end": b} for a, b in sentence_spans(w)] for w in words]
    return pd.Series([found[c] for c in codes], dtype=object)


def sentence_units(records: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_offset, end_offset: the sentence units of each record's text, whole, each once.

    Null keys, null texts and texts of white space give no rows. Repeated rows of one key and text give one set of units;
    if a key has several texts, the units of all of them come. Rows are dealt by key and text, so that the texts of a key
    are neither gathered nor in one task; its spans are made distinct afterwards.
    """
    whole = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    units = dealt(whole, "k", "t").distinct().select("k", F.explode(spans_of("t")).alias("s"))
    return units.select(F.col("k").alias(key), F.col("s.start").alias("start_offset"), F.col("s.end").alias("end_offset")).distinct()
