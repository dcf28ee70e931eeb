"""Evaluation texts that leak into a corpus.

Texts become streams of letters and digits: compatibility forms, case, punctuation, spacing and line breaks are gone, while
the places where words began are kept. Words of an item are its blank-separated words; Chinese items count single
characters.

Method. Every shard of the corpus (an Arrow batch of whole documents) gets a suffix array over all its symbols. Suffixes are
ordered by their first DEPTH symbols at once; a bucket of suffixes that are alike so far is ordered by the next DEPTH symbols
when a search enters it, and so on without end, so that every search sees the order of whole suffixes and no time goes into
buckets that nobody enters. Every suffix of every item that begins a word is searched by binary search, first all at once,
then bucket by bucket, up to its longest verbatim match that can matter.

A run with at most one change in ten has Item.least unchanged words in a row, wherever its changes are. A document is a
candidate if it holds so many words of the item verbatim; shorter matches, however frequent, cost nothing but the search.
From the matches of a candidate the item is aligned with the text on both sides, word by word, a changed word against the one
word in its place; where the alignment meets another match, about as much text may stand in between. A run counts if at most
one word in ten is changed and it holds at least the given share of the item's words.

Items go to the tasks in blocks of at most about ITEM_BLOCK characters, one broadcast each, and all blocks are searched in a
shard before the next; the corpus is only scanned, once, and never shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import spread

#: Characters of the items in one broadcast, about.
ITEM_BLOCK = 8_000_000
#: Symbols by which suffixes are ordered at once, four to an integer.
DEPTH = 12
#: Common prefix of the further matches of a candidate, for items of words and of Chinese characters; less where fewer are left.
SEED, SEED_CHARS = 12, 7
#: Symbols of text that may stand before a match in the place of one changed word, of one changed character. A single word
#: in the place of a changed one may have any length.
GAP, GAP_CHARS = 40, 3
#: One word in so many may be changed.
CHANGED_PER = 10
#: Symbols of corpus text that one suffix array covers.
SHARD = 2_000_000

_ALONE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


_OTHER = re.compile(r"[\W_]+")
_HYPHENS, _BREAKS = [ord(c) for c in "-\u00ad\u2010"], [ord(c) for c in "\n\r\u2028"]


def stream(text: str) -> tuple[str, list[int]]:
    """(letters and digits in a row, the positions in it where words or lone characters begin)."""
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    parts, starts, at = [], [], 0
    for word in (text.lower() if plain else text).split():
        kept = word if word.isalnum() else _OTHER.sub("", word)
        if not kept:
            continue
        if not plain and not kept.isascii() and _ALONE.search(kept):
            starts += [at + i for i, c in enumerate(kept) if i == 0 or _ALONE.match(c) or _ALONE.match(kept[i - 1])]
        else:
            starts.append(at)
        parts.append(kept)
        at += len(kept)
    return "".join(parts), starts


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: letter or digit, white space, character that stands alone."""
    every = [chr(c) for c in range(0x110000)]
    return tuple(np.array([f(c) for c in every]) for f in (str.isalnum, str.isspace, lambda c: bool(_ALONE.match(c))))


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The streams of many texts behind each other, each closed by a 0: (symbols, the places where words begin, the place behind each text)."""
    return _streams(texts)[:3]


def _streams(texts: list[str]) -> tuple[np.ndarray, ...]:
    """What streams gives, the places that surely divide words, and by place whether a word may begin or end there.

    A line break behind a hyphen need not divide words; dropped punctuation may. A word of more than GAP symbols has lost
    its spacing, so words may begin and end anywhere in it.
    """
    whole = "\0".join(t.replace("\0", "\x01") for t in texts) + "\0"
    if not whole.isascii():
        whole = unicodedata.normalize("NFKC", whole).casefold()
    codes = _codes(unicodedata.normalize("NFKC", whole.lower() if whole.isascii() else whole))
    letter, space, alone = _kinds()
    border = codes == 0
    kept = np.flatnonzero(letter[codes] | border)
    symbols = codes[kept]
    gaps = np.cumsum(space[codes])[kept]
    single, closing = alone[symbols], border[kept]
    starts = np.ones(len(symbols), dtype=bool)
    starts[1:] = (gaps[1:] != gaps[:-1]) | single[1:] | single[:-1] | closing[:-1]
    broken = np.zeros(len(symbols), dtype=bool)
    behind = np.concatenate([codes, [0, 0]])
    broken[1:] = np.isin(behind[kept[:-1] + 1], _HYPHENS) & np.isin(behind[kept[:-1] + 2], _BREAKS) & ~closing[:-1]
    hard = np.flatnonzero(starts & ~broken | closing)
    free = starts | closing
    free[1:] |= kept[1:] - kept[:-1] > 1
    sure = np.flatnonzero(free)
    for k in np.flatnonzero(np.diff(sure) > GAP):
        free[sure[k] : sure[k + 1]] = True
    return symbols, np.flatnonzero(starts & ~closing), np.concatenate([[0], np.flatnonzero(closing) + 1]), hard, free


@dataclass
class Item:
    item_id: int
    text: str
    starts: list[int]  # where its words begin
    ends: list[int]
    chars: bool

    @classmethod
    def of(cls, item_id: int, text: str, lang: str | None) -> "Item":
        symbols, starts = stream(text)
        chars = (lang or "").lower()[:2] in ("zh", "ja", "cn") or len(_ALONE.findall(symbols)) > len(symbols) / 3
        if chars:
            starts = list(range(len(symbols)))
        return cls(item_id, symbols, starts, [*starts[1:], len(symbols)], chars)

    def least(self, share: float) -> int:
        """Unchanged words in a row that every long enough run has, wherever its changes are."""
        total = len(self.starts)
        runs = range(max(1, _needed(total, share)), total + 1)
        return min((-(-(n - n // CHANGED_PER) // (n // CHANGED_PER + 1)) for n in runs), default=total + 1)

    def stretches(self, share: float) -> list[tuple[int, int]]:
        """(place, symbols) of the stretches of words one of which is unchanged in every long enough run."""
        least = self.least(share)
        return [(q, self.ends[k + least - 1] - q) for k, q in enumerate(self.starts[: len(self.starts) - least + 1])]

    def seeds(self, share: float) -> list[tuple[int, int]]:
        """(place, symbols) of the prefixes of further matches."""
        most = SEED_CHARS if self.chars else SEED
        return [(q, min(most, n)) for q, n in self.stretches(share)]


def _needed(total: int, share: float) -> int:
    """The fewest of so many words that are the share."""
    return math.ceil(share * total - 1e-9)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _keys(codes: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """The symbols behind each position, four 16-bit symbols in an integer, most significant first."""
    out = []
    for w in range(words):
        key = np.zeros(len(at), dtype=np.uint64)
        for i in range(4):
            key = (key << np.uint64(16)) | codes[at + 4 * w + i].astype(np.uint64)
        out.append(key)
    return out


def _pack(rows: np.ndarray) -> np.ndarray:
    """Rows of DEPTH symbols as rows of integers."""
    x = rows.astype(np.uint64) & np.uint64(0xFFFF)
    return (x[:, 0::4] << np.uint64(48)) | (x[:, 1::4] << np.uint64(32)) | (x[:, 2::4] << np.uint64(16)) | x[:, 3::4]


def _bound(keys: list[np.ndarray], wanted: np.ndarray, mask: np.ndarray, after: bool) -> np.ndarray:
    """The first row of sorted keys not below (after: above) each wanted prefix: binary search of all at once."""
    n = len(keys[0])
    lo = np.zeros(len(wanted), dtype=np.int64)
    hi = np.full(len(wanted), n, dtype=np.int64)
    while n and (open_ := lo < hi).any():
        middle = np.minimum((lo + hi) // 2, n - 1)
        below, equal = np.zeros(len(wanted), dtype=bool), np.ones(len(wanted), dtype=bool)
        for w, column in enumerate(keys):
            here = column[middle] & mask[:, w]
            below |= equal & (here < wanted[:, w])
            equal &= here == wanted[:, w]
        forward = (below | equal if after else below) & open_
        lo = np.where(forward, middle + 1, lo)
        hi = np.where(~forward & open_, middle, hi)
    return lo


class SuffixArray:
    """The suffixes of a text in order; a bucket is ordered beyond DEPTH symbols when a search enters it."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        # a symbol above 65,535 keeps its low bits; matches are compared by whole symbols later
        self.codes = np.concatenate([symbols, np.zeros(DEPTH + 1, dtype=np.uint32)])
        keys = _keys(self.codes & 0xFFFF, starts, DEPTH // 4)
        order = np.lexsort(keys[::-1])
        self.at = starts[order]
        self.keys = [k[order] for k in keys]

    def ranges(self, patterns: list[np.ndarray]) -> list[tuple[int, int]]:
        """For each pattern the rows of the suffixes that begin with it: first all suffixes are searched by DEPTH symbols,
        then all buckets that patterns go on in are ordered and searched by the next DEPTH symbols, until none goes on."""
        sizes = np.array([len(p) for p in patterns], dtype=np.int64)
        padded = np.zeros((len(patterns), -(-int(sizes.max(initial=1)) // DEPTH) * DEPTH), dtype=np.uint32)
        for i, p in enumerate(patterns):
            padded[i, : len(p)] = p
        los, his = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), len(self.at), dtype=np.int64)
        active, depth = np.arange(len(patterns)), 0
        while len(active):
            mask = _pack(np.where(np.arange(depth, depth + DEPTH)[None, :] < sizes[active, None], 0xFFFF, 0))
            wanted = _pack(padded[active, depth : depth + DEPTH])
            if depth == 0:
                keys, shift = self.keys, np.zeros(len(active), dtype=np.int64)
            else:
                buckets, of = np.unique(np.stack([los[active], his[active]], axis=1), axis=0, return_inverse=True)
                of = of.ravel()
                lengths = buckets[:, 1] - buckets[:, 0]
                offset = np.cumsum(lengths) - lengths
                which = np.repeat(np.arange(len(buckets)), lengths)
                rows = np.arange(len(which)) - offset[which] + buckets[which, 0]
                places = np.minimum(self.at[rows] + depth, len(self.codes) - DEPTH - 1)
                keys = [which.astype(np.uint64), *_keys(self.codes & 0xFFFF, places, DEPTH // 4)]
                order = np.lexsort(keys[::-1])
                self.at[rows] = self.at[rows][order]
                keys = [k[order] for k in keys]
                wanted = np.concatenate([of[:, None].astype(np.uint64), wanted], axis=1)
                mask = np.concatenate([np.full((len(active), 1), ~np.uint64(0)), mask], axis=1)
                shift = buckets[of, 0] - offset[of]
            los[active], his[active] = _bound(keys, wanted, mask, False) + shift, _bound(keys, wanted, mask, True) + shift
            depth += DEPTH
            active = active[(los[active] < his[active]) & (sizes[active] > depth)]
        return list(zip(los.tolist(), his.tolist()))


def _common(text: str, at: int, other: str, start: int) -> int:
    """Length of the common prefix of two suffixes, by halving."""
    lo, hi = 0, min(len(text) - at, len(other) - start)
    if text[at : at + hi] == other[start : start + hi]:
        return hi
    while lo < hi:
        middle = (lo + hi + 1) // 2
        if text[at + lo : at + middle] == other[start + lo : start + middle]:
            lo = middle
        else:
            hi = middle - 1
    return lo


@dataclass
class Page:
    """One document of a shard as items are aligned with it."""

    text: str  # the symbols of the shard
    begin: int
    end: int
    hard: list[int]  # places in it that divide words
    free: list[int]  # places where words may begin or end
    chars: bool

    def __post_init__(self) -> None:
        self.may = set(self.free)

    def divides(self, at: int) -> bool:
        return self.chars or at in self.may

    def beyond(self, at: int, step: int) -> list[int]:
        """Places where the word that begins (step -1: ends) here may be over."""
        if at == (self.end if step > 0 else self.begin):
            return []
        if self.chars:
            return [at + step]
        if step > 0:
            k, h = bisect_right(self.free, at), bisect_right(self.hard, at)
            border = self.hard[h] if h < len(self.hard) else self.end
            within = self.free[k : bisect_right(self.free, min(border, at + GAP))]
            return within if border <= at + GAP else [*within, border]
        k, h = bisect_left(self.free, at), bisect_left(self.hard, at)
        border = self.hard[h - 1] if h else self.begin
        within = self.free[bisect_left(self.free, max(border, at - GAP)) : k]
        return within if border >= at - GAP else [*within, border]


def _spans(item: Item, page: Page, matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int, int, bool]]:
    """The whole words of verbatim matches (place in the document, place in the item, length): first and last word, where
    they begin and end in the document, and whether they may be the seed of a run."""
    out = set()
    for p, q, length in matches:
        a = bisect_left(item.starts, q)
        b = bisect_right(item.ends, q + length) - 1
        seed = b - a + 1 >= least
        place = lambda at: p + at - q
        # a word that goes on in the document is another word, unless the spacing is lost on its other side, too
        if a <= b and not page.divides(place(item.ends[b])) and page.divides(place(item.starts[b])):
            b -= 1
        if a <= b and not page.divides(place(item.starts[a])) and page.divides(place(item.ends[a])):
            a += 1
        if a <= b:
            out.add((a, b, place(item.starts[a]), place(item.ends[b]), seed))
    return sorted(out, key=lambda s: (s[2], s[0]))


def _reach(item: Item, page: Page, spans: list[tuple[int, int, int, int, bool]], word: int, place: int, step: int) -> dict[int, int]:
    """The most words that a run gains behind a word border (step -1: before it), by number of changes; its last is unchanged."""
    words = len(item.starts) - word if step > 0 else word
    most, gap = len(item.starts) // CHANGED_PER, GAP_CHARS if item.chars else GAP
    if step > 0:
        jumps = [(a - word, b + 1 - word, begin, end) for a, b, begin, end, _ in spans if b >= word and end > place]
    else:
        jumps = [(word - 1 - b, word - a, end, begin) for a, b, begin, end, _ in spans if a < word and begin < place]
    gained, at = {0: 0}, {0: {place: 0}}

    def reached(t: int, p: int, cost: int) -> None:
        known = at.setdefault(t, {})
        if cost < known.get(p, most + 1):
            known[p] = cost

    for t in range(words):
        k = word + t if step > 0 else word - 1 - t
        first, last = item.starts[k], item.ends[k]
        wanted = item.text[first:last]
        for p, cost in at.pop(t, {}).items():
            e = p + step * len(wanted)
            if page.begin <= e <= page.end and page.text.startswith(wanted, min(p, e)) and page.divides(e):
                reached(t + 1, e, cost)
                gained[cost] = max(gained.get(cost, 0), t + 1)
            if cost == most:
                continue
            for e in page.beyond(p, step):
                reached(t + 1, e, cost + 1)
            for begins, ends, near, far in jumps:
                if ends <= t:
                    continue
                lost = max(0, begins - t)
                if begins < t:  # the match counts from the next word
                    near += first - item.starts[word + begins] if step > 0 else last - item.ends[word - 1 - begins]
                between = step * (near - p)
                if (lost or between) and 0 <= between <= gap * max(1, lost) and cost + max(1, lost) <= most:
                    reached(ends, far, cost + max(1, lost))
                    gained[cost + max(1, lost)] = max(gained.get(cost + max(1, lost), 0), ends)
    return gained


def holds(item: Item, page: Page, matches: list[tuple[int, int, int]], share: float) -> bool:
    """Whether a long enough run lies around one of the verbatim matches (place in the document, place in the item, length).

    A run starts and ends with unchanged words; at most one of CHANGED_PER of its words may be changed. A word is changed
    if another single word stands in its place. Before a match any text of up to GAP symbols for each changed word may
    stand in their place, and text in the document without a counterpart in the item counts as one change.
    """
    needed = max(1, _needed(len(item.starts), share))
    spans = _spans(item, page, matches, item.least(share))
    for a, b, begin, end, seed in spans:
        if not seed:
            continue
        if b - a + 1 >= needed:
            return True
        behind, before = _reach(item, page, spans, b + 1, end, 1), _reach(item, page, spans, a, begin, -1)
        for c, n in behind.items():
            for d, m in before.items():
                run = b - a + 1 + n + m
                if run >= needed and (c + d) * CHANGED_PER <= run:
                    return True
    return False


def _matches(item: Item, seeds: list[tuple[int, int]], whole: str, begin: int, end: int) -> list[tuple[int, int, int]]:
    """(place in the shard, place in the item, length) of the verbatim matches in one document, widened behind."""
    out: list[tuple[int, int, int]] = []
    reached: dict[int, int] = {}  # by diagonal, how far in the item the last match goes
    for q, n in seeds:
        seed = item.text[q : q + n]
        p = whole.find(seed, begin, end)
        while p >= 0:
            # a match that lies in a longer one on the same diagonal was widened already
            if q >= reached.get(p - q, -1):
                length = _common(whole, p, item.text, q)
                reached[p - q] = q + length
                out.append((p, q, length))
            p = whole.find(seed, p + 1, end)
    return out


class Sought:
    """Items as they are searched: the stretches of all, each distinct one once."""

    def __init__(self, rows: list[tuple], share: float):
        self.items = [item for item in (Item.of(*r) for r in rows) if len(item.starts)]
        self.share = share
        of: dict[str, list[int]] = {}
        for i, item in enumerate(self.items):
            for q, n in item.stretches(share):
                mine = of.setdefault(item.text[q : q + n], [])
                if not mine or mine[-1] != i:
                    mine.append(i)
        self.patterns = [_codes(s) for s in of]
        self.owners = list(of.values())
        self.seeds = [item.seeds(share) for item in self.items]


class Shard:
    """Documents with the suffix array over their symbols."""

    def __init__(self, texts: list[str]):
        symbols, _, self.borders, self.hard, self.free = _streams(texts)
        self.array = SuffixArray(symbols, np.flatnonzero(symbols))
        self.whole = symbols.tobytes().decode("utf-32-le", "surrogatepass")

    def holding(self, sought: Sought) -> list[tuple[int, int]]:
        """(document, item) positions whose text holds enough of the item."""
        if not len(self.array.at):
            return []
        pairs: set[tuple[int, int]] = set()
        for k, (lo, hi) in enumerate(self.array.ranges(sought.patterns)):
            if lo < hi:
                docs = np.unique(np.searchsorted(self.borders, self.array.at[lo:hi], "right") - 1).tolist()
                pairs |= {(doc, i) for i in sought.owners[k] for doc in docs}
        return [(doc, i) for doc, i in sorted(pairs) if self._holds(doc, sought.items[i], sought.seeds[i], sought.share)]

    def _holds(self, doc: int, item: Item, seeds: list[tuple[int, int]], share: float) -> bool:
        begin, end = int(self.borders[doc]), int(self.borders[doc + 1]) - 1
        near = _matches(item, seeds, self.whole, begin, end)
        if not near:
            return False
        if item.chars:
            page = Page(self.whole, begin, end, [], [], True)
        else:
            # words longer than a gap reach farther than the match and its gaps: take the borders around them, too
            reach = len(item.text) + GAP * (len(item.starts) + 1)
            first, last = max(begin, min(m[0] for m in near) - reach), min(end, max(m[0] + m[2] for m in near) + reach)
            inside = self.hard[np.searchsorted(self.hard, first) : np.searchsorted(self.hard, last, "right")]
            page = Page(self.whole, first, last, inside.tolist(), (np.flatnonzero(self.free[first : last + 1]) + first).tolist(), False)
        return holds(item, page, near, share)


def leaked_items(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, lang: str, share: float = 0.45) -> DataFrame:
    """doc_id, item_id: documents that hold a run of at least a share of an item's words, at most one in ten changed.

    Null ids and texts, and items without letters or digits, give no rows. Repeated documents and items give one row for
    each pair of ids. Texts are searched whole, whatever their length.
    """
    ready = corpus.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    kept = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"), F.col(lang).alias("l"))
    kinds = dict(corpus.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc {kinds[0]}, item {kinds[1]}"
    ready = spread(ready, "d")
    blocks = max(1, -(-(kept.agg(F.sum(F.length("t"))).first()[0] or 0) // ITEM_BLOCK))
    sent = []
    for block in range(blocks):  # the driver holds one block at a time
        part = kept if blocks == 1 else kept.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        sent.append(corpus.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()]))
    return ready.mapInPandas(_searcher(sent, share), schema).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()


def _searcher(blocks: list, share: float):
    """blocks: broadcasts of rows (id, text, language)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = Sought(blocks[0].value, share) if len(blocks) == 1 else None
        for batch in batches:
            texts, ids = batch["t"].tolist(), batch["d"].tolist()
            first, size = 0, 0
            for last, text in enumerate(texts):
                size += len(text)
                if size >= SHARD or last == len(texts) - 1:
                    shard = Shard(texts[first : last + 1])
                    for block in blocks:
                        sought = only or Sought(block.value, share)
                        hits = shard.holding(sought)
                        if hits:
                            yield pd.DataFrame({"doc": [ids[first + d] for d, _ in hits], "item": [sought.items[i].item_id for _, i in hits]})
                    first, size = last + 1, 0

    return search
