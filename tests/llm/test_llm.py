import json
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.llm import groups, leaks, lookalikes, packing, pii, sentences, splitting, terms
from skein.llm.boosting import BoostedTrees, Calibration


# problem 4
def union(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(("shape", "cell"), [("random", 5), ("chain", 4), ("star", 6), ("random", 10_000)])
def test_groups_over_the_grid(spark, monkeypatch, shape, cell):
    monkeypatch.setattr(groups, "CELL_EDGES", cell)
    rng = random.Random(2)
    pairs = {"random": [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(36)], "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(24)], "star": [("n15", f"n{i:02}") for i in range(30)]}[shape]
    df = spark.createDataFrame([*pairs, *pairs[:5]], "u string, v string")
    got = {r.feature_key: r.group_key for r in groups.connected_groups(df).collect()}
    assert got == union([p for p in pairs if p[0] != p[1]])


def test_a_full_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(groups, "CELL_EDGES", 10)
    df = spark.createDataFrame([("hub", f"n{i:04}") for i in range(300)] + [(f"m{i}", f"m{i + 1}") for i in range(60)], "u string, v string")
    sizes = [r["count"] for r in groups._celled(df, df.count()).groupBy("row", "column", "part").count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == 360
    got = {r.feature_key: r.group_key for r in groups.connected_groups(df).collect()}
    assert got == union([tuple(r) for r in df.collect()])


def test_decisions_in_any_order_and_spelling(spark):
    from datetime import datetime

    t = lambda d: datetime(2024, 1, d)
    rows = [("a", "b", "SAME", t(1), 0), ("b", "a", "different", t(2), 0), ("c", "d", "DIFFERENT", t(1), 0), ("d", "c", " same ", t(2), 0), ("e", "e", "SAME", t(1), 0), ("f", None, "SAME", t(1), 0), ("g", "h", None, t(1), 0), ("i", "j", "UNCERTAIN", t(1), 0), ("k", "l", "SAME", t(3), 0), ("k", "l", "DIFFERENT", t(3), 0), ("m", "n", "SAME", None, 0)]
    df = spark.createDataFrame(rows, "feature_a string, feature_b string, decision string, decided_at timestamp_ntz, u int")
    assert {tuple(r) for r in groups.decided_matches(df).collect()} == {("c", "d"), ("k", "l"), ("m", "n")}
    assert groups.connected_groups(groups.decided_matches(df.limit(0))).count() == 0


# problem 6
def test_terms_equal_plain_counts(spark):
    rows = [(1, ["a", "b", "a"], 2), (2, ["a"], None), (3, [], 5), (4, None, 5), (5, ["é", None, "b"], -1)] + [(i, ["hot"] * 3, 1) for i in range(10, 200)]
    df = spark.createDataFrame(rows, "id int, term array<string>, weight int")
    got = {r.term: (r.occurrences, r.records, r.weight) for r in terms.term_counts(df, F.col("term"), F.col("weight")).collect()}
    assert got == {"a": (3, 2, 2), "b": (2, 2, 1), "é": (1, 1, -1), "hot": (570, 190, 190)}
    ids = [r.term_id for r in terms.term_counts(df, F.col("term")).collect()]
    assert len(set(ids)) == len(ids)
    assert terms.term_counts(df.limit(0), F.col("term")).count() == 0
    marks = {r.term: r.mark for r in terms.marked(terms.term_counts(df, F.col("term")), 200, "records").collect()}
    assert marks == {"a": "rare", "b": "rare", "é": "rare", "hot": "common"}
    w = spark.createDataFrame([("Foo-bar_2x Été3",)], "t string").select(terms.words_of(F.col("t"))).first()[0]
    assert w == ["foo", "bar", "2x", "été3"]


def test_blocks_and_ranges_of_any_size(spark, monkeypatch):
    rows = [(i, [f"t{(i * k) % 97}" for k in range(1, 9)], i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, term array<string>, weight int").repartition(3)
    monkeypatch.setattr(terms, "RANGE_ENTRIES", 20)
    want = {}
    for _, words, weight in rows:
        for w in words:
            want.setdefault(w, [0, 0, 0])[0] += 1
        for w in set(words):
            want[w][1] += 1
            want[w][2] += weight
    got = {r.term: [r.occurrences, r.records, r.weight] for r in terms.term_counts(df, F.col("term"), F.col("weight")).collect()}
    assert got == want
    frames = [pd.DataFrame({"terms": [r[1] for r in rows[i : i + 50]], "weight": [r[2] for r in rows[i : i + 50]]}) for i in range(0, 400, 50)]
    monkeypatch.setattr(terms, "BLOCK_TERMS", 150)
    blocks = list(terms._blocks(iter(frames)))
    assert len(blocks) > 1 and terms._added(blocks).set_index("term")["occurrences"].to_dict() == {w: n[0] for w, n in want.items()}


# problem 7
@pytest.mark.parametrize(("limit", "overlap"), [(40, 5), (30, 0), (1200, 100)])
def test_pieces_round_trip(spark, limit, overlap):
    rng = random.Random(limit)
    words = ["word ", "Ende. ", "x; ", "\n", "\n\n", "句子。", "😀", "supercalifragilistic" * 3]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 90 if limit < 100 else 900))) for _ in range(40)] + ["", "a" * limit, "a" * (limit + 1), "\n" * (3 * limit)]
    df = spark.createDataFrame([(f"k{i}", t, 9, 9) for i, t in enumerate(texts)] + [("k0", texts[0], 1, 1), (None, "x" * 99, 1, 1), ("n", None, 1, 1)], "k string, text string, piece int, cores int")
    rows = splitting.split_items(df, "k", "text", limit, overlap).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r.k == f"k{i}"), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and all(r.pieces == len(mine) and len(r.text) <= limit for r in mine)
        assert all(t[r.start : r.start + len(r.text)] == r.text for r in mine)
        assert mine[0].text + "".join(r.text[overlap:] for r in mine[1:]) == t
        assert (len(mine) == 1) == (len(t) <= limit)
    assert {r.k for r in rows} == {f"k{i}" for i in range(len(texts))}


def test_cuts_are_at_the_strongest_boundary(spark):
    text = "a " * 300 + "\n\n" + "b. " * 100 + "c " * 300
    rows = splitting.split_items(spark.createDataFrame([("k", text)], "k string, t string"), "k", "t").orderBy("piece").collect()
    assert rows[0].text.endswith("a \n\n") and rows[1].text[100:].startswith("b. ")


def test_boundaries_in_the_first_half_are_taken(spark):
    texts = {
        "a": ["a" * 430 + "\n\n", "G" * 1000],
        "b": ["b" * 599 + "\n", "c" * 49 + " ", "G" * 1090],
        "c": ["b" * 599 + ". ", "c" * 9 + " ", "G" * 1100, "G" * 300],
        "d": ["b" * 50 + " " + "G" * 1149, "G" * 200],  # too short for the overlap
    }
    df = spark.createDataFrame([(k, "".join(t)) for k, t in texts.items()], "k string, t string")
    rows = splitting.split_items(df, "k", "t").orderBy("k", "piece").collect()
    for k, cores in texts.items():
        mine, whole = [r for r in rows if r.k == k], "".join(cores)
        ends = [len("".join(cores[: i + 1])) for i in range(len(cores))]
        assert [(r.start, r.start + len(r.text)) for r in mine] == [(max(0, b - 100), e) for b, e in zip([0, *ends], ends)]
        assert all(whole[r.start : r.start + len(r.text)] == r.text for r in mine)


def test_the_first_piece_takes_the_whole_limit(spark):
    text = "a" * 1149 + ". " + "b" * 300
    rows = splitting.split_items(spark.createDataFrame([("k", text)], "k string, t string"), "k", "t").orderBy("piece").collect()
    assert [(r.start, len(r.text)) for r in rows] == [(0, 1151), (1051, 400)]


def test_very_long_texts_take_time_in_proportion(spark):
    import time

    took = []
    for n in (200_000, 3_200_000):
        df = spark.createDataFrame([("k", "word and " * (n // 9))], "k string, t string")
        began = time.perf_counter()
        assert splitting.split_items(df, "k", "t").agg(F.max(F.length("text"))).first()[0] <= 1200
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0] + 3


# problem 2
SENTENCES = [
    ["The U.S. filing lists 9 embodiments, of which No. 6 uses ZnO.", "Batch Xm-3 contained NiO, CuO, etc.", "pH values below 3.1 matter.", "4. n-Type GaN failed!", "Does it?"],
    ["It was kept at 395 K.", "The label reads \"Keep dry. Do not heat.\" and stays.", "They noted: “It cracked. It was replaced.”", "Next one."],
    ["Am 25. Oktober wurde sie ersetzt.", "Geeignete Oxide, z. B. V2O5 bzw. CuO, usw.", "Vgl. Abschn. 90.53 zur Drift.", "Auf dem Gehäuse steht „Nicht öffnen. Trocken halten.“ in roter Schrift."],
    ["В 2019 г. метод был запатентован.", "Такие добавки, т. е. ZnO и др.", "Эксперт указал: «Она треснула. Её заменили.»", "Плёнка 9,3 ч."],
    ["La couche fait env. 3,0 nm, cf. art. 79.", "Quel défaut !", "La notice indique « Ne pas chauffer. Garder au sec. » sur la pastille."],
]


@pytest.mark.parametrize("gap", [" ", "\n", "\n\n", "  ", " "])
def test_sentences_in_order(gap):
    for parts in SENTENCES:
        text = gap.join(parts)
        assert [text[a:b] for a, b in sentences.sentence_spans(text)] == parts


def test_scripts_without_blanks_and_edges():
    zh = ["外壳上写着“请勿加热。保持干燥。”的字样。", "第14次实验失败了！", "含WO3的薄膜是否稳定？", "加入6.5毫克并搅拌过夜．"]
    text = "".join(zh)
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == zh
    hi = ["डिब्बे पर “गरम न करें। सूखा रखें।” लिखा है।", "क्या यह स्थिर है?"]
    text = " ".join(hi)
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == hi
    assert sentences.sentence_spans("") == [] == sentences.sentence_spans(" \n　") and sentences.sentence_spans("Heading") == [(0, 7)]
    assert sentences.sentence_spans("😀 Go. 😀 Up.")[0] == (0, 5)
    glued = "It was used without purification.As shown in Fig. 16, it fell."
    assert len(sentences.sentence_spans(glued)) == 2


def test_sentence_table(spark):
    df = spark.createDataFrame([("a", "One. Two.", 1), ("a", "One. Two.", 2), ("b", None, 1), (None, "X.", 1), ("c", "x" * 200_000, 1), ("d", "One. Two.", 1), ("d", "One. Three.", 1)], "id string, text string, start_offset int")
    rows = sentences.sentence_units(df, "id", "text").collect()
    got = {tuple(r) for r in rows}
    assert len(rows) == len(got)
    assert got == {("a", 0, 4), ("a", 5, 9), ("c", 0, 200_000), ("d", 0, 4), ("d", 5, 9), ("d", 5, 11)}
    assert sentences.sentence_units(df.limit(0), "id", "text").count() == 0


def test_texts_of_one_key_are_in_several_tasks(spark):
    df = spark.createDataFrame([("hot", f"One {i}. Two {i}.") for i in range(200)] * 2, "id string, text string")
    units = sentences.sentence_units(df, "id", "text")
    assert {tuple(r) for r in units.collect()} == {s for i in range(200) for a in [len(f"One {i}.")] for s in [("hot", 0, a), ("hot", a + 1, 2 * a + 1)]}
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and re.search(r"hashpartitioning\(k#\d+, t#\d+", plan)


def test_spans_cover_the_text():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["Ab", " ", ". ", "“", "”", "?", "\n\n", "4.", "。", "e.g. ", "9", "(", ")"]) for _ in range(rng.randint(0, 40)))
        spans = sentences.sentence_spans(t)
        assert "".join("".join(t[a:b] for a, b in spans).split()) == "".join(t.split())
        assert all(t[a:b] == t[a:b].strip() and a < b for a, b in spans)


# problem 5
NAMES = ["γ-phase NO2 sensor", "flexible CO film", "efficient Pt hotplate", "пористый оксид СО ацетона", "pâte salé", "pate sale", "n-type film", "h-type film", "40 Å ZnO heater", "Öhm-Schicht", "Ohm-Schicht"]


def test_look_alikes(spark):
    same = ["ｆｌｅｘｉｂｌｅ CO　film", "еffісіеnt Рt hotplate", "eﬃcient Pt hot​plate", "γ‐phase NO2 sensor", "порисtый оксид CO ацетона".replace("t", "т"), unicodedata.normalize("NFD", "pâte salé"), "40 \u212b ZnO heater", "Оhm-Schicht", "flexible  CO film"]
    same += ["fⅼexible ᏟO film".replace("ⅼ", "l"), "efficieոt Pt հօtplate"]
    other = ["Flexible CO film", "flexible CO films", "pâte sale", "film CO flexible", "Γ-phase NO2 sensor", "", " ", "n-type film"]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate([*same, *other, None])], "id int, value string, concept_id string")
    names = spark.createDataFrame(list(enumerate(NAMES)), "name_id int, name string")
    got = {r.id: r.name_id for r in lookalikes.meant_names(df, "value", names, "name", "name_id").collect()}
    assert got == dict(enumerate([1, 2, 2, 0, 3, 4, 8, 10, 1, 1, 2]))
    assert lookalikes.meant_names(df, "value", names.limit(0), "name", "name_id").count() == 0
    assert lookalikes.meant_names(df.limit(0), "value", names, "name", "name_id").count() == 0


# problem 9
ITEM = "Because the tunnel store was flooded, 845 vials of acetone reached the night crew with grey caps, and each vial held 6.1 grams of Pd@ZnO below a cracked bellows near the harbour."
ZH = "丝线绑住黄色阀板达3.6小时，温室积水深9.2米，甲烷从69个针孔漏出，学徒在隧道挂起93片TiO2。"


def test_leaks_by_brute_force_cases(spark):
    words = ITEM.split()
    half, short = " ".join(words[:16]), " ".join(words[:12])
    changed = " ".join("zebra" if i in (4, 15) else w for i, w in enumerate(words))
    torn = " ".join("zebra" if i % 6 == 3 else w for i, w in enumerate(words))
    texts = {
        1: f"Before it. {ITEM} After it.", 2: ITEM.upper().replace(",", "").replace(" ", "\n "), 3: half, 4: short, 5: changed, 6: torn, 7: "nothing here", 8: re.sub(r"(\w{4})(\w{4})", r"\1-\n\2", ITEM),
        9: "".join(c for c in ITEM if c.isalnum() or c == " "), 10: "前文。" + ZH + "后文", 11: ZH[:12], 12: ZH.replace("黄", "红").replace("隧", "山"), 13: "", 14: ITEM + "\n" + ITEM,
    }
    docs = spark.createDataFrame([(k, t, k) for k, t in texts.items()] + [(15, None, 0), (None, ITEM, 0), (1, texts[1], 9)], "doc long, text string, item long")
    items = spark.createDataFrame([(100, ITEM, "en"), (200, ZH, "zh"), (300, None, "en"), (None, ITEM, "en"), (400, "…", None)], "item_id long, text string, lang string")
    got = {tuple(r) for r in leaks.leaked_items(docs, "doc", "text", items, "item_id", "text", "lang").collect()}
    assert got == {(k, 100) for k in (1, 2, 3, 5, 8, 9, 14)} | {(10, 200), (12, 200)}
    assert leaks.leaked_items(docs.limit(0), "doc", "text", items, "item_id", "text", "lang").count() == 0


class Sent:
    def __init__(self, value):
        self.value = value


def leaked(items, texts):
    frames = leaks._searcher([Sent(items)], 0.45)(iter([pd.DataFrame({"d": range(len(texts)), "t": texts})]))
    return {(int(d), int(i)) for f in frames for d, i in zip(f["doc"], f["item"])}


def test_short_items_are_found_whole():
    items = [(1, "Is it so?", "en"), (2, "Who is he?", "en"), (3, "a b c d e f g h i j", "en"), (4, "水的沸点", "zh"), (5, "I", "en")]
    texts = [f"He asked: {t} Then he left." for _, t, _ in items]
    assert {(k, k + 1) for k in range(5)} <= leaked(items, texts)
    assert not {(k, i) for k, i in leaked(items, texts) if i != k + 1 and i != 5}


def test_a_changed_word_of_any_length():
    words = ITEM.split()
    words[10] = "poly" * 20
    assert leaked([(1, ITEM, "en")], [" ".join(words[3:18]), " ".join([*words[3:10], "x" * 50, "y" * 50, *words[11:18]])]) == {(0, 1)}


def test_frequent_seeds_of_many_items_cost_no_alignment(monkeypatch):
    # all items and texts begin words with the same twelve symbols
    items = [(k, f"Considering that sample {k} " + " ".join(f"word{k}x{j}" for j in range(20)), "en") for k in range(300)]
    texts = [f"Considering that sample number is {d}, nothing happened in the long night. " * 3 for d in range(300)] + [items[7][1]]
    calls = []
    real = leaks.holds
    monkeypatch.setattr(leaks, "holds", lambda *a: calls.append(1) or real(*a))
    assert leaked(items, texts) == {(300, 7)} and len(calls) == 1


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 400)
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20)), "en") for k in range(12)], "item_id long, text string, lang string")
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(4, 20))) for k in range(0, 12, 2)], "doc long, text string")
    assert {tuple(r) for r in leaks.leaked_items(docs, "doc", "text", items, "item_id", "text", "lang").collect()} == {(k, k) for k in range(0, 12, 2)}


@pytest.mark.parametrize(("text", "lang"), [(ITEM, "en"), (ZH, "zh")])
def test_leaks_with_one_change_in_ten_anywhere(text, lang):
    rng = random.Random(9)
    item = leaks.Item.of(1, text, lang)
    units = list(item.text) if item.chars else text.split()
    glue, other = ("", "Ж") if item.chars else (" ", "zebra")
    search = leaks._searcher([Sent([(1, text, lang)])], 0.45)

    def found(parts):
        doc = glue.join(["前文" if item.chars else "Something else before", *parts, "后文" if item.chars else "nobody knows it"])
        return any(len(f) for f in search(iter([pd.DataFrame({"d": [1], "t": [doc]})])))

    least = -(-45 * len(units) // 100)
    for _ in range(60):
        n = rng.randint(least, len(units))
        a = rng.randrange(len(units) - n + 1)
        run = units[a : a + n]
        for k in rng.sample(range(1, n - 1), n // 10):
            run[k] = other
        assert found(run), run
        # a shorter quote, and one with a change too many in every long enough part of it
        assert not found(units[a : a + least - 1])
        assert not found([other if k % 6 == 3 else w for k, w in enumerate(units[a : a + n])])


def test_suffix_array_finds_every_prefix():
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(2000))
    text += text[:700] + "𐐷" + text[300:900]
    probes = []
    for n in (1, 5, 12, 13, 30, 100, 500):
        for _ in range(30):
            at = rng.randrange(len(text) - n)
            probes.append(text[at : at + n] if rng.random() < 0.8 else "".join(rng.choice("abc") for _ in range(n)))
    for at in (rng.sample(range(len(text)), len(text)), range(len(text))):
        array = leaks.SuffixArray(leaks._codes(text), np.array(at))
        for probe, (lo, hi) in zip(probes, array.ranges([leaks._codes(p) for p in probes])):
            assert sorted(array.at[lo:hi].tolist()) == [m.start() for m in re.finditer(f"(?={probe})", text)]
    assert leaks.SuffixArray(leaks._codes(""), np.arange(0)).ranges([leaks._codes("a")]) == [(0, 0)]


# problem 10
def test_redaction_and_edges(spark):
    text = "😀 Dr. Edwina Grimbrandt (edwina [at] lab [dot] example) lives at 382 Pinewater Ave., Westmere ZX0 3QQ. Call +1 (201) 555-0149 ext. 4. Grant 359-947-7507 stays."
    df = spark.createDataFrame([(1, text, "c"), (1, text, "c"), (2, "", "c"), (3, None, "c"), (None, text, "c"), (4, "word " * 30_000, "c")], "id long, text string, d string")
    rows = pii.personal_spans(df, "id", "text").collect()
    got = {(text[r.start_offset : r.end_offset], r.pii_type) for r in rows}
    assert got == {("Edwina Grimbrandt", "person"), ("edwina [at] lab [dot] example", "email"), ("382 Pinewater Ave., Westmere ZX0 3QQ", "address"), ("+1 (201) 555-0149 ext. 4", "phone")} and len(rows) == 4
    out = {r.id: (r.text, r.redactions) for r in pii.redacted(df.where("id is not null"), "id", "text").collect()}
    assert out[1][0] == "😀 Dr. [PERSON] ([EMAIL]) lives at [ADDRESS]. Call [PHONE]. Grant 359-947-7507 stays." and out[3] == (None, 0) and out[2] == ("", 0)
    assert pii.personal_spans(df.limit(0), "id", "text").count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = BoostedTrees(rounds=30, depth=3).fit(x[:1500], y[:1500])
    p = Calibration().fit(t.scores(x[1000:1500]), y[1000:1500])(t.scores(x[1500:]))
    assert ((p > 0.5) == y[1500:]).mean() > 0.95 and len(t.scores(np.zeros((0, 3)))) == 0


# problem 8
def test_packing_respects_all_limits(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 5, 40, 120, 900, 2048, 2049, 5000, None]), rng.randrange(60), 1) for i in range(600)] + [(1, 40, 3, 1), (None, 9, 9, 1)]
    df = spark.createDataFrame(rows, "id long, n int, loss int, container int")
    packed = packing.pack(df, "id", "n", "loss", 2048, 20).collect()
    by = {}
    for r in packed:
        by.setdefault(r.container, []).append(r)
    assert all(sum(r.tokens for r in b) <= 2048 and len(b) <= 20 and sum(r.loss_tokens for r in b) <= 2048 for b in by.values())
    assert sum(r.tokens for r in packed) == sum(r[1] or 0 for r in rows if r[0] is not None)
    parts = [r for r in packed if r.id == next(i for i, n, *_ in rows if n == 5000)]
    assert sorted((r.part, r.token_start, r.tokens) for r in parts) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    split = {r.id for r in packed if r.part > 0}
    assert split == {i for i, n, *_ in rows if i is not None and (n or 0) > 2048}
    report = packing.container_report(packing.pack(df, "id", "n", "loss", 2048, 64)).first()
    assert report.fill > 0.9
    assert packing.pack(df.limit(0), "id", "n", "loss").count() == 0


def test_a_loss_limit_below_the_capacity_binds(spark):
    rng = random.Random(6)
    rows = [(i, n, rng.randint(0, n)) for i, n in enumerate(rng.choices([0, 3, 40, 99, 100, 101, 200, 450], k=120))] + [(900, 100, 0), (901, 200, 200), (902, 250, 70), (903, 60, 60), (904, 300, 0)]
    df = spark.createDataFrame(rows, "id long, n int, loss int")
    by, parts = {}, {}
    for r in packing.pack(df, "id", "n", "loss", 100, 8, 30).collect():
        by.setdefault(r.container, []).append(r)
        parts.setdefault(r.id, []).append(r)
    assert all(sum(r.tokens for r in b) <= 100 and len(b) <= 8 and sum(r.loss_tokens for r in b) <= 30 for b in by.values())
    for i, n, loss in rows:
        mine = sorted(parts[i], key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(len(mine))) and sum(r.tokens for r in mine) == n and sum(r.loss_tokens for r in mine) == loss
        assert [r.token_start for r in mine] == [sum(x.tokens for x in mine[:k]) for k in range(len(mine))]
        assert (len(mine) > 1) == (n > 100 or loss > 30)
        # a part ends only where a limit is reached
        assert all(r.tokens == 100 or r.loss_tokens == 30 for r in mine[:-1])
    assert [(r.tokens, r.loss_tokens) for r in sorted(parts[902], key=lambda r: r.part)] == [(100, 0), (100, 20), (30, 30), (20, 20)]


def test_token_counts(spark):
    from skein.llm.plans import TOKEN_PATTERN, TOKENIZER

    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.tokens for r in packing.token_counts(df, "id", "t", packing.Tokenizer(TOKENIZER, TOKEN_PATTERN)).collect()}
    assert got == {1: 2, 2: 0}


def test_queries_have_sql_or_none():
    from skein.llm import plans

    assert set(plans.ORACLE) <= set(plans.QUERIES) and {f"p{n}_found" for n in (2, 4, 5, 6, 7, 9, 10)} <= set(plans.QUERIES)
    assert json.dumps(sorted(plans.QUERIES))


def test_the_program_equals_all_starts_for_all_ends():
    import math

    def whole(starts, ends, opening, closing, deep):
        best, back = [0.0], [0]
        for j in range(1, len(ends) + 1):
            value = lambda i: best[i] + opening[i] - 9.0 * (deep[i] != 0) + (-0.12 * abs(math.log((ends[j - 1] - starts[i]) / 80.0)) if ends[j - 1] - starts[i] >= 2 else -8.0)  # noqa: B023, E731
            back.append(max(range(j), key=value))
            best.append(value(back[-1]) + closing[j - 1] - 9.0 * (deep[j] != 0))
        return back

    def path(back):
        j, out = len(back) - 1, []
        while j:
            out.append(j)
            j = back[j]
        return out

    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(2, 60)
        cuts = sorted(rng.sample(range(1, rng.choice([150, 2000, 100_000])), 2 * n))
        ends, starts = cuts[1::2], [0, *[c + 1 for c in cuts[1::2]][:-1]]
        low = rng.choice([-9, -5, 0])
        args = (starts, ends, [0.0, *[rng.uniform(low, 2) for _ in range(n - 1)]], [*[rng.uniform(low, 3) for _ in range(n - 1)], 0.0], [0, *[rng.randint(0, 1) for _ in range(n - 1)], 0])
        assert path(sentences._program(*args)) == path(whole(*args))


def test_many_marks_take_time_in_proportion():
    import time

    took = []
    for n in (2_000, 32_000):
        began = time.perf_counter()
        sentences.sentence_spans("1. a, b. e.g. " * (n // 4))
        took.append(time.perf_counter() - began)
    assert took[1] < 64 * took[0] + 1


@pytest.mark.parametrize(
    "parts",
    [
        ["This is known from the prior art.", "The invention improves on it."], ["He said no.", "The test went on."], ["It was put in the tab.", "The cell failed."], ["Er ging über die Str.", "Danach kam er."],
        ["See Fig. 3 and Tab. 4.", "It is good."], ["Vgl. Art. 6 der Verordnung.", "Sie gilt."], ["As in No. 6 of the list.", "Ref. 7 says so."], ["As shown by Smith et al. in 1999, it held.", "Good."], ["Sie wohnt in der Lindenstr. 5 in Bonn.", "Er auch."],
        ["He came to Washington D.C. on Jan. 5 by train.", "The U.S. Government acted.", "He left the U.S. The end."[:16], "The end."], ["J.-P. Martin est venu.", "Il est parti."], ["Он живёт на ул. Ленина, д. 5.", "Там тихо."], ["U.S. Pat. No. 5,123,456 was cited.", "It expired."], ["It was Feb. 3, 1990.", "We met."], ["I. Introduction.", "II. Methods."],
        ["Dr. Miller came.", "Prof. Otto left."], ["We use max. 5 and min. 6 of them.", "The value is at its max.", "Then it falls."], ["It held for 5 min.", "Samples were dried."], ["On le voit à l'art. 79 de la loi.", "Il est clair."],
    ],
)
def test_abbreviations_by_language_and_what_follows(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == parts


def test_streams_of_many_texts_equal_each_alone():
    texts = ["Pd@ZnO, 2.8\tg", "", "丝线绑住Co3O4 硬壳。9", "ｆｕｌｌ ﬁne Straße ÉCOLE", "a\0b", "_-_", "मि.ग्रा. 5", "x" * 50]
    symbols, starts, borders = leaks.streams(texts)
    for i, t in enumerate(texts):
        one, begins = leaks.stream(t)
        part = symbols[borders[i] : borders[i + 1] - 1]
        assert "".join(map(chr, part)) == one
        assert [int(s) - borders[i] for s in starts if borders[i] <= s < borders[i + 1]] == begins


def test_items_that_never_fill_a_container_end(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    df = spark.createDataFrame([(i, 60, 1) for i in range(400)] + [(1000 + i, 1, 0) for i in range(3)], "id long, n int, loss int")
    packed = packing.pack(df, "id", "n", "loss", 100, 8).collect()
    assert sum(r.tokens for r in packed) == 400 * 60 + 3 and len({r.container for r in packed}) == 400
    # segments fill containers that tokens don't
    packed = packing.pack(spark.createDataFrame([(i, 1, 1) for i in range(800)], "id long, n int, loss int"), "id", "n", "loss", 100, 8).collect()
    assert len({r.container for r in packed}) <= 104


def test_two_lengths_of_one_row_are_counted(spark):
    from skein.llm.plans import TOKEN_PATTERN, TOKENIZER

    df = spark.createDataFrame([(1, "Hello world", "Hello"), (2, None, "x"), (3, "", "")], "id long, a string, b string")
    got = {tuple(r) for r in packing.token_counts(df, "id", ["a", "b"], packing.Tokenizer(TOKENIZER, TOKEN_PATTERN)).collect()}
    assert got == {(1, 2, 1), (3, 0, 0)}
