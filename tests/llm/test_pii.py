"""Names and numbers that stand in no list of the detector, in sentences that it wasn't fitted on."""

import pytest

from skein.llm import pii, pii_training

NAMES = {
    "en": "Peter Anderson|Olivia Bennett|Harriet Quigley|Zachary Osei|Priya Raman|Miguel Ortega|Fatima Haddad|Sean O'Connor|Jean-Luc Picot|Ada Lovett|Bruno Castellani|Ingrid Solberg|Kwame Mensah|Ljubica Kovač|William Henry|Mary Jones|T. S. Elwood|Zuvrak Pelmoor|Iskra Tumblewen|Oona van Haarst",
    "de": "Uwe Lindemann|Sabine Vogt|Günther Haas|Annegret Böhm|Lukas Pfeiffer",
    "fr": "Camille Rousseau|Étienne Lambert|Margaux Girard|Théo Blanchet|Odile Perrot",
    "ru": "Олег Захаров|Марина Белова|К. Н. Сидоров|Антон Гусев|Лидия Комарова",
    "zh": "张伟|李娜娜|王小明|赵丽华|欧阳修文|孙志刚|周杰|陈晓东|吴秀英|刘洋",
    "ja": "佐々木翔|中島 敦子|青木 恵|坂本龍一|西村 京太郎",
    "hi": "राहुल वर्मा|अनीता गुप्ता|संजय मेहता|प्रिया नायर",
}
FRAMES = {
    "en": "Dr. {} called.|The assistant, {}, left early.|Please contact {} for more details.|My neighbour {} owns a dog.|{} signed the contract on Tuesday.|We would like to thank {} for useful comments.|The device was tested by {} in June.|Inventor: {}|She asked {} whether it was safe.|Yesterday I spoke with {} about the plan.|Mr. {} was absent.|Emergency contact: {} (555) 201-3344|Prepared by {}|Minutes taken by {}, approved later.",
    "de": "Herr {} war krank.|Die Leitung hat {}.|Erfinder: {}|Ich sprach mit {} darüber.|Das Protokoll schrieb {}.",
    "fr": "Inventeur : {}|Madame {} est absente.|Nous remercions {} pour ses conseils.|Le test a été fait par {}.|J'ai parlé avec {}.",
    "ru": "Изобретатель: {}|Опыт провёл {}.|Директор {} согласен.|Вчера {} сделал доклад.|Письмо от {} пришло.",
    "zh": "发明人：{}。|我的同事{}说可以。|请与{}联系。|该实验由{}完成。",
    "ja": "発明者：{}|{}さんに聞いてください。|担当：{}、電話 03-1234-5678|{}氏が発表した。",
    "hi": "संपर्क: {}।|{} ने परीक्षण किया।|डॉ. {} से मिलें।|आविष्कारक: {}, दिल्ली।",
}


@pytest.mark.parametrize("lang", NAMES)
def test_names_of_no_list_are_found(lang):
    d, hit, n = pii.detector(), 0, 0
    for frame in FRAMES[lang].split("|"):
        for name in NAMES[lang].split("|"):
            text = frame.format(name)
            at, n = text.index(name), n + 1
            hit += (at, at + len(name), "person") in d.spans(text)
    assert hit >= 0.9 * n, (hit, n)


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        ("My SSN is 219-09-9999.", "219-09-9999", "id_number"), ("Her social security number, 219-09-9999, is known.", "219-09-9999", "id_number"), ("Passport number: 533380006A", "533380006A", "id_number"),
        ("NI number AB 12 34 56 C", "AB 12 34 56 C", "id_number"), ("call 415-555-2671 now", "415-555-2671", "phone"), ("Fax: +49 30 12345 678", "+49 30 12345 678", "phone"), ("ask j.doe@site.example.org today", "j.doe@site.example.org", "email"),
        ("ask JDOE (at) site.example.org today", "JDOE (at) site.example.org", "email"), ("He stays at 12 Elm Tree Road, Flat 3, Oakham, LE15 6QT until May.", "12 Elm Tree Road, Flat 3, Oakham, LE15 6QT", "address"), ("Brief an Ulmenallee 7, 50667 Köln senden.", "Ulmenallee 7, 50667 Köln", "address"),
    ],
)
def test_numbers_mails_and_addresses(text, value, kind):
    assert [(text[a:b], k) for a, b, k in pii.detector().spans(text)] == [(value, kind)]


@pytest.mark.parametrize("text", ["Lot 219-09-9999 failed.", "Grant 415-555-2671 paid.", "US 9,123,456 B2 and EP 1 234 567 B1", "The Langmuir isotherm and the Schottky barrier model", "Siemens Instruments Inc. sold it.", "Results And Discussion", "Die Messung der Probe. Der Sensor", "It read 300 K. The film held.", "doi:10.1234/abc.5678901", "高温下金属氧化物的电阻下降。"])
def test_what_only_looks_personal_stays(text):
    assert pii.detector().spans(text) == []


def test_composed_sentences_held_out():
    d = pii.detector()
    hit = wrong = missed = 0
    for text, truth in pii_training.labelled_sentences(300, seed=77):
        got = set(d.spans(text))
        hit, wrong, missed = hit + len(got & truth), wrong + len(got - truth), missed + len(truth - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_without_a_vocabulary_file():
    d = pii.Detector(600, 3, "/no/such/file")
    assert d.spans("Contact: Harriet Quigley, h.quigley@site.example") == [(9, 24, "person"), (26, 48, "email")]


def test_the_best_of_overlapping_picks_stay():
    import random

    rng = random.Random(5)
    for _ in range(200):
        picks = [(rng.random() > 0.5, rng.random(), a := rng.randrange(60), a + rng.randint(1, 9), rng.choice(pii.TYPES)) for _ in range(rng.randrange(25))]
        kept = []
        for *_, a, b, kind in sorted(picks, reverse=True):
            if all(b <= c or a >= d for c, d, _ in kept):
                kept.append((a, b, kind))
        assert pii._apart(picks) == sorted(kept)
