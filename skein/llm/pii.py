"""Personal information in free text: spans with types, and typed placeholders in their place.

Method. High-recall generators propose overlapping spans for each type: mail addresses in plain and spelled-out notation,
telephone and identity numbers by the number formats of several countries and by any other run of digits, postal addresses
in the order of several countries, every window of capitalized words and initials as a name, and runs of Han, Kanji and
Devanagari next to a border as names in those scripts. Boosted trees, one set for each type, score a proposal by features of
its format and its context; scores are calibrated to probabilities on held-out rows, and each type has the threshold that
does best there. Of overlapping proposals above their thresholds the most probable stays.

No list of given names or Latin surnames takes part. Names are told by letter case, position, the classes of the words
around them, other personal data near them, and how common their words are in the vocabulary of a public tokenizer. Chinese
names also by the surnames of the Hundred Family Surnames.

The trees are fitted on a bounded sample of labelled sentences that pii_training composes itself (TRAINING_SENTENCES, by a
fixed seed): labels come with the composition, no corpus text is used.
"""

from __future__ import annotations

import base64
import math
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import pii_training
from skein.llm.boosting import BoostedTrees, Calibration, best_threshold
from skein.session import spread

TYPES = ("person", "email", "phone", "id_number", "address")
#: Labelled sentences that the trees are fitted on.
TRAINING_SENTENCES = 10_000
#: A public tokenizer's rank file (base64 token and rank on each line), for the commonness of words; the environment may name another.
VOCABULARY = os.environ.get("SKEIN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Rank of a word that the vocabulary doesn't have.
UNKNOWN_RANK = 1 << 17

# ---- Word classes. Closed classes and common nouns of the languages concerned.
_CLASSES = {
    "title": "dr mr mrs ms miss prof professor doctor sir madam messrs herr herrn frau dipl ing dipl.-ing priv.-doz m mm mme mlle monsieur madame mademoiselle me pr "
    "г-н г-жа гр господин госпожа доктор профессор инж акад श्री श्रीमती सुश्री डॉ प्रो कुमारी",
    "role": "inventor inventors author authors contact contacts operator applicant applicants attorney assistant colleague engineer technician researcher supervisor owner witness chair "
    "chairman secretary manager director student examiner agent investigator coordinator analyst nurse patient consultant name attn attention signed undersigned recipient sender "
    "erfinder erfinderin autor autorin ansprechpartner ansprechpartnerin kontakt kontaktperson leiter leiterin mitarbeiter mitarbeiterin kollege kollegin anmelder techniker bearbeiter gezeichnet "
    "inventeur inventrice auteur auteure responsable titulaire chercheur technicien collègue directeur demandeur destinataire nom "
    "автор авторы изобретатель изобретатели контакт контакты сотрудник сотрудница инженер коллега заявитель оператор лаборант ответственный исполнитель руководитель подписал подписала "
    "संपर्क लेखक आविष्कारक शोधकर्ता इंजीनियर सहायक निदेशक अभियंता आवेदक नाम",
    "article": "the a an this that these those each every any our your my his her its their some such no all both which "
    "der die das den dem des ein eine einen einem einer eines dieser diese dieses jeder jede kein keine alle unser unsere ihre seine "
    "le la les l un une des du ce cet cette ces leur leurs son sa ses notre nos tout tous toute chaque эта этот эти это все каждый каждая данный данная такие такой такая",
    "conjunction": "and or und oder et ou и или & а y sowie nebst ainsi और तथा व एवं",
    "person_preposition": "by with to from for of thank thanks thanked thanking cc per via about as wie ask asked asking tell told met meet called call email telephone phone ring "
    "von mit bei durch an für an: dank par avec chez à pour de auprès от к у для с через कि",
    "place_preposition": "in at near into within across on under over after before during since between im am auf aus bei nach vor zum zur vom seit dans en sur sous vers depuis в на из при под после перед",
    "auxiliary": "is are was were be been has have had does do did can could may might must shall should will would if when where while once although because however thus here there then it he she we they "
    "not as than both neither once ist sind war waren wird werden wurde wurden hat haben kann können wenn auch nur es er sie wir ihr nicht "
    "est sont était étaient a ont peut si quand il elle nous ils elles on ne pas que qui как что если где когда он она мы они не для также",
    "person_verb": "said says wrote writes lives lived signed signs kept keeps works worked joined remarked noted called called thinks thought reported asked asks agreed explained resigned retired moved left found "
    "measured built ran repeated checked reviewed approved performed prepared sagte schrieb wohnt unterschrieb arbeitet prüfte maß leitete a habite vit écrit écrivit signa dit déclare travaille "
    "сказал сказала пишет написал написала живёт подписал подписала работает измерил измерила проверил проверила who whose whom",
    "company": "ltd limited inc incorporated gmbh corp corporation company co llc llp plc kg ag sa s.a sarl sas lab labs laboratory laboratories materials instruments sensorik systems technologies technology solutions "
    "industries group holding holdings institute university universität college school department faculty ministry agency office foundation society press journal hospital clinic bank hotel "
    "ооо оао зао ао нии институт университет завод кафедра institut université société école centre center committee council association museum library partners chemicals pharma electronics devices",
    "place": "street avenue road lane river lake valley bay mountain mountains island city town county bridge park square hill north south east west new saint port straße strasse stadt "
    "улица город область район республика rue place ville province state states kingdom union district station airport harbour ocean sea desert",
    "thing": "isotherm isotherms barrier barriers model models type stage effect equation equations method methods law constant plot diagram cell cells oven furnace test tests number numbers ratio theory theorem principle "
    "approximation process filter bridge coefficient transform distribution function analysis spectrum radiation scattering band gap phase alloy oxide film layer sensor sensors electrode catalyst reaction "
    "mechanism structure network criterion index scale curve junction diode contact resistance emission temperature pressure symmetry group algorithm prize award lecture memorial product series matrix",
    "month": "january february march april june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre "
    "novembre décembre января февраля марта апреля мая июня июля августа сентября октября ноября декабря monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag",
    "document_word": "figure fig table tab section abstract introduction background summary results discussion conclusion conclusions references claims claim description example examples appendix chapter volume page "
    "abbildung tabelle anspruch ansprüche beispiel zusammenfassung stand technik рисунок таблица раздел глава пример формула описание реферат revendication revendications exemple tableau sensor method device system"
    " nr no bzw usw etc ref eq abb kap ausgabe versuch probe run batch sample lot grant patent application register",
}
WORD_CLASS: dict[str, str] = {}
for _kind, _words in _CLASSES.items():
    for _word in _words.split():
        WORD_CLASS.setdefault(_word, _kind)
_FUNCTION = {"article", "conjunction", "person_preposition", "place_preposition", "auxiliary"}
_GERMAN_NOUN = re.compile(r"(?:ung|ungen|heit|keit|ität|schaft|tion|tionen|ment|tät|nis|anlage|gerät|stoff|fläche|schicht|messung|material|oxid|oxide|ismus)$")

#: What stands before a number: labels of telephones, of identity numbers and of other numbers. The nearest one counts.
CUE = re.compile(
    r"(?:(?P<phone>t[eé]l[eé]?(?:phone|fono?n)?\b|\b(?:tel|phone[ds]?|call(?:s|ed|ing)?|ring|dial(?:s|led)?|mobile?|mobil|cell|fax|handy|rufnummer|durchwahl|anrufen|appele[rz]|portable|reach(?:ed)?|extension|sms|text|whatsapp|hotline)\b"
    r"|тел(?:ефон\w*)?\b|моб\w*|звон\w+|факс|电话|電話|手机|致电|拨打|传真|携帯|連絡先|फ़ोन|फोन|मोबाइल|दूरभाष)"
    r"|(?P<id_number>\b(?:ssn|social security|passport|passeport|identity|national insurance|nino?|licen[cs]e|tax(?:payer)?|tin|staff|employee|personnel|insurance|badge|ssn|id|i\.d|nir|insee|sécurité sociale|carte d['’]identité"
    r"|ausweis\w*|personal\w*|steuer\w*|sozialversicherung\w*|reisepass\w*|führerschein\w*|pass)\b(?:[- ](?:id|nr))?|инн|снилс|паспорт\w*|удостоверени\w+|полис\w*|身份证号?码?|护照|证件|社保|個人番号|マイナンバー|パスポート|旅券|免許証?|पहचान|आधार|पासपोर्ट|पैन))(?:[- ]?(?:no|nr|num(?:ber|éro)?|id|card)\b\.?)?"
    r"|(?P<other>\b(?:grants?|lots?|cas|ep|us|wo|de|cn|jp|appl(?:ication|n)?s?|patents?|brevets?|patentschrift|anmeldung|doi|refs?|runs?|claims?|units?|batch|register(?:ed)?|registry|data ?sets?|dataset|isbn|issn|sec|fig|eq|tab"
    r"|order|invoice|serial|part|model|version|standard|iso|din|gost|contract|project|award|number of|accession|genbank|catalog(?:ue)?|stock|item|article|page|pp|vol|year|deposit|docket|charge|bestell\w*|auftrag\w*|seriennummer|aktenzeichen|az"
    r"|commande|contrat|facture|demande|série|no|nr|version|build|ticket|case|file)\b|патент\w*|заявк\w+|парти\w+|грант\w*|договор\w*|гост|№|专利|申请|批号|批次|编号|合同|序列|标准|特許|出願|ロット|型番|規格|पेटेंट|बैच|अनुदान)",
    re.I,
)

# ---- Generators: formats.
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)"
_SIGN = re.compile("[@＠]")
_SPELLED_AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s(?:at|AT)\s(?=[\w-]+\s?(?:[\[(]?dot|DOT))", re.I)
_USER = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:{_DOT}[A-Za-z0-9_%+-]+)*\Z", re.I)
_HOST = re.compile(rf"[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)*{_DOT}[A-Za-z]{{2,}}", re.I)
#: Characters that a user name takes at most.
_USER_LENGTH = 80

_EXT = r"(?:,?\s?(?:ext|extn|доб|x|poste|内線|转)\.?\s?\d{1,5})?"
#: Telephone formats by country. Fixed values.
PHONES = {
    "us": r"(?:\+1[ .-]?|1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}" + _EXT,
    "uk": r"(?:\+44 ?(?:\(0\) ?)?|0)\d{2,4} ?\d{3,4} ?\d{4}" + _EXT,
    "de": r"(?:(?:\+49|0049)[ /]?\(?\d{2,4}\)?[ /]?\d{3,8}(?:[ -]\d{1,4})?|\(0\d{2,4}\) ?\d{4,8}(?:-\d{1,4})?|0\d{2,4} ?/ ?\d{2,3}(?: ?\d{2,3}){1,3}(?:-\d{1,4})?|0\d{2,4}[-/]\d{5,9})" + _EXT,
    "fr": r"(?:(?:\+33|0033) ?(?:\(0\) ?)?|0)[1-9](?:[ .-]?\d{2}){4}",
    "ru": r"(?:\+7|8)[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}" + _EXT,
    "cn": r"(?:\+86[ -]?\d{2,3}[ -]?\d{4}[ -]?\d{4}|0\d{2,3}-\d{4}-?\d{4}|[（(]0\d{2,3}[)）] ?\d{4}-?\d{4}|(?:\+86[ -]?)?1\d{2}[ -]?\d{4}[ -]?\d{4})" + _EXT,
    "jp": r"(?:\+81[ -]?\d{1,3}[ -]?\d{3,4}[ -]?\d{4}|0\d{1,3}-\d{2,4}-\d{4})" + _EXT,
    "in": r"(?:\+91[ -]?|0)\d{5}[ -]?\d{5}|\+91[ -]?\d{2,4}[ -]?\d{3,4}[ -]?\d{4}",
}
PHONES = {k: re.compile(rf"(?<![0-9A-Za-z+.-]){p}(?![0-9A-Za-z]|[-.]\d)") for k, p in PHONES.items()}
#: Identity number formats. Fixed values.
IDS = {
    "3-2-4": r"\d{3}[- ]\d{2}[- ]\d{4}",
    "letters-pairs": r"[A-Z]{2}(?: ?\d{2}){3} ?[A-Z]",
    "letters-run": r"[A-Z]{1,3}\d{6,9}",
    "run-letter": r"\d{7,9}[A-Z]",
    "2-3-3-3": r"\d{2}(?: \d{3}){3}",
    "10-12": r"\d{10}(?:\d{2})?",
    "3-3-3-2": r"\d{3}-\d{3}-\d{3} ?-?\d{2}",
    "2-2-6": r"\d{2} ?\d{2} (?:№ ?)?\d{6}",
    "fr": r"\d(?: \d{2}){3}(?: ?\d{2}| \w{2})? \d{3} \d{3}(?: \d{2})?",
    "17+x": r"\d{17}[\dXx]",
    "4-4-4": r"\d{4}[- ]\d{4}[- ]\d{4}",
}
IDS = {k: re.compile(rf"(?<![0-9A-Za-z.+-])(?<!\d ){p}(?![0-9A-Za-z]|[-.]\d| \d)") if k not in ("17+x", "4-4-4") else re.compile(rf"(?<![0-9A-Za-z.+-]){p}(?![0-9A-Za-z]|[-.]\d)") for k, p in IDS.items()}
_RUN = re.compile(r"(?<![0-9A-Za-z.])\+?[(（]?\d[\d()（）]*(?:(?:[ .\-]|\s?/\s?)[(（]?\d[\d()）]*){0,8}" + _EXT + r"(?![0-9A-Za-z]|[.,]\d)")
#: Six digits near each other: no format can do with fewer.
_CLUSTER = re.compile(r"\d(?:[ ().\-/（）№]{0,3}\d){5,}")

_W = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ’']+"
_POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}|[A-Z]{2}\s\d{5}(?:-\d{4})?)"
_STREET = r"(?:Street|St\.|Lane|Ln\.?|Avenue|Ave\.?|Road|Rd\.?|Court|Ct\.?|Walk|Drive|Dr\.|Way|Place|Square|Close|Terrace|Boulevard|Blvd\.?|Row|Crescent|Hill|Gardens|Mews)"
_CITY = rf"(?:{_W}(?:[ -]{_W}){{0,3}})"
_DCITY = r"[A-ZÄÖÜ][a-zäöüß]+(?:[ -](?:am|an der|im|[A-ZÄÖÜ][a-zäöüß]+)){0,2}"
#: Postal addresses in the order of a country.
ADDRESSES = {
    "en": rf"\d{{1,5}}[A-Za-z]?,?\s(?:{_W}\s){{1,3}}{_STREET}(?:,?\s(?:Apt\.?|Suite|Flat|Unit|Floor|Room|#)\s?\w{{1,5}})?,?\s+{_CITY},?\s+{_POST}",
    "de": rf"(?:(?:Am|An der|Im|Auf der|Zum|Zur|In der)\s)?[A-ZÄÖÜ][a-zäöüß-]+(?:str\.)?\.?(?:\s[A-ZÄÖÜ][a-zäöüß-]+\.?){{0,2}}\s\d{{1,4}}\s?[a-z]?,\s+(?:D-)?\d{{5}}\s{_DCITY}",
    "fr": rf"\d{{1,4}}(?:\s?(?:bis|ter))?,?\s(?:rue|impasse|allée|avenue|place|chemin|boulevard|quai|cours|square|route|passage)\s[^,\n\d]{{2,50}},\s+(?:F-)?\d{{5}}\s[A-ZÀ-Ý][\wà-ÿ’'-]+(?:[ -][A-ZÀ-Ý][\wà-ÿ’'-]+){{0,3}}",
    "ru": r"(?:(?:\d{6},\s+)?г\.\s?[А-ЯЁ][\w-]+,\s+(?:ул|пр|пер|пл|наб|ш|бул|б-р)\.?\s?[А-ЯЁ][\w\s-]*?,\s+д\.\s?\d+\w?(?:,\s+(?:корп|стр)\.\s?\d+)?(?:,\s+(?:кв|оф)\.\s?\d+)?|\d{6},\s+(?:г\.\s?)?[А-ЯЁ][\w-]+,\s+(?:(?:ул|пр|пер|пл|наб)\.\s?)?[А-ЯЁ][\w-]+(?:\s(?:пр|ул|пер|пл|наб|ш|проспект|улица)\.?)?,\s+(?:д\.\s?)?\d+\w?(?:,\s+кв\.\s?\d+)?)",
    "zh": r"(?:[一-鿿]{2,4}省)?[一-鿿]{2,5}?[市县](?:[一-鿿]{1,4}区)?[一-鿿]{1,8}?(?:路|街|大道|巷|弄|道)\d+号(?:\d+[栋幢座])?(?:\d+单元)?(?:\d+[室号])?",
    "ja": r"(?:〒\s?\d{3}-\d{4}\s*[一-鿿々ヶぁ-んァ-ヴー]+?\d+(?:[-－丁目番地号\d])+|(?:[一-鿿]{2,3}[都道府県])?[一-鿿々ヶ]{1,4}[市区郡町村][一-鿿々ヶァ-ヴー]{1,8}?\d+(?:-\d+){1,3})",
    "hi": r"\d{1,4},\s[ऀ-ॿ]+(?:\s[ऀ-ॿ]+){0,2}\s(?:मार्ग|रोड|गली|सड़क|पथ),\s+[ऀ-ॿ]+(?:\s[ऀ-ॿ]+)?\s\d{6}",
}
ADDRESSES = {k: re.compile(p) for k, p in ADDRESSES.items()}
#: What an address can't do without.
_POSTAL = {
    "en": re.compile(_POST), "de": re.compile(r",\s+(?:D-)?\d{5}\s[A-ZÄÖÜ]"), "fr": re.compile(r",\s+(?:F-)?\d{5}\s[A-ZÀ-Ý]"), "ru": re.compile(r"\d{6},\s|г\.\s?[А-ЯЁ]"),
    "zh": re.compile(r"\d号"), "ja": re.compile(r"〒|[市区郡町村][一-鿿々ヶァ-ヴー]{1,8}\d"), "hi": re.compile(r"[ऀ-ॿ]\s\d{6}"),
}

# ---- Generators: names in scripts with letter case.
_CASED = [chr(c) for c in [*range(0x41, 0x250), *range(0x370, 0x530)] if chr(c).isalpha()]
_U, _L = "".join(c for c in _CASED if c.isupper()), "".join(c for c in _CASED if c.islower())
_INITIAL = rf"[{_U}]\.(?:-?[{_U}]\.)*"
_NAME_WORD = rf"(?:[{_U}]['’])?[{_U}](?:[{_L}]+(?:[{_U}][{_L}]+)?|[{_U}]+)(?:-[{_U}](?:[{_L}]+|[{_U}]+))*"
_PARTICLE = r"(?:van der|van den|van|von der|von|vom|zu|de la|del|della|de|da|dos|do|di|du|bin|ibn|al|el|ter|ten|af|av)"
_NAME_TOKEN = re.compile(rf"(?<![\w’'.-])(?:{_PARTICLE}\s)?(?:{_NAME_WORD}|{_INITIAL})(?![\w@]|['’](?!s\b)\w|-\w)|(?<=[{_U}]\.)(?:{_NAME_WORD})(?![\w@]|-\w)")
#: Where names may begin: two capitals with at most the rest of a word between them.
_TWO_CAPITALS = re.compile(rf"[{_U}](?:[\w’'-]*,?\s(?:{_PARTICLE}\s)?|\.\s?)[{_U}]")
#: Tokens of a name at most.
_LONGEST = 4

# ---- Generators: names in other scripts.
#: The compound surnames and the most frequent single ones of the Hundred Family Surnames. Fixed values.
COMPOUND_SURNAMES = "万俟 司马 上官 欧阳 夏侯 诸葛 闻人 东方 赫连 皇甫 尉迟 公羊 澹台 公冶 宗政 濮阳 淳于 单于 太叔 申屠 公孙 仲孙 轩辕 令狐 钟离 宇文 长孙 慕容 鲜于 闾丘 司徒 司空 亓官 司寇 子车 颛孙 端木 巫马 公西 漆雕 乐正 壤驷 公良 拓跋 夹谷 宰父 谷梁 段干 百里 东郭 南门 呼延 羊舌 微生 梁丘 左丘 东门 西门 南宫 第五".split()
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_HAN = r"[一-鿿]"
_ZH_ROLE = "发明人|联系人|联系|申请人|负责人|代理人|经办人|签字人|作者|笔者|操作员|测试员|研究员|工程师|技术员|实验员|教授|博士|医生|老师|主任|经理|学生|患者|姓名|同事|由|请|找|感谢|致谢|与|和|及|给|向|对|是|为|叫"
_ZH_AFTER = "联编审批核撰建收先女老教博同说在和与及的于是负完进签给等为将已也都从向来去测操提主写住参认指表"
HAN_NAME = re.compile(
    rf"(?:(?<!{_HAN})|(?<=[人者员师士长授系由请找谢与和及给向对是为叫任生名事]))(?:[{SURNAMES}]{_HAN}{{1,2}}?|(?:{'|'.join(COMPOUND_SURNAMES)}){_HAN}{{1,2}}?|(?<=[：:人者员师由]){_HAN}{{2,4}}?)(?={_HAN}?(?!{_HAN})|[{_ZH_AFTER}])"
    rf"|(?:{'|'.join(COMPOUND_SURNAMES)}){_HAN}{{1,2}}?(?=(?!{_HAN})|[{_ZH_AFTER}])"
)
HAN_LONGER = re.compile(rf"{_HAN}(?=(?!{_HAN})|[{_ZH_AFTER}])")
_JA_ROLE = re.compile(r"発明者|出願人|担当者|担当|連絡先|氏名|著者|作成者|測定者|責任者|代表者|代表|出席者|技師|研究員|助手|教授|博士|先生|社員|患者|署名者|操作者")
_JA_HONORIFIC = re.compile(r"(?:氏|様|先生|教授|博士|技師)$")
_KANJI_RUN = re.compile(r"[一-鿿々ヶ]+")
#: A given name behind a run of kanji, in kana or behind a blank.
_JA_GIVEN = re.compile(r"[ 　](?:[一-鿿々ヶ]{1,4}(?![一-鿿々ヶ])|[ぁ-ん]{2,4}(?![ぁ-ん])|[ァ-ヴー]{2,5})|[ぁ-ん]{2,3}(?=[、。（(]|さん)")
_JA_GIVEN_END = set("子美太郎一二三介人也夫雄男香奈恵理紗菜花吾平樹斗翔希真央代江枝彦司志明樹哉馬弥輔々乃音葉衣")
_JA_SURNAME_END = set("田中山川野村木本井上原沢崎島藤谷林森石松橋口部内岡塚瀬辺倉浦坂宮堀杉雪峰津城")
_DEV = r"[ऀ-ॣॱ-ॿ]"
HINDI_PAIR = re.compile(rf"(?<!{_DEV}){_DEV}{{2,}}(?:\s{_DEV}{{2,}}){{1,2}}?(?!{_DEV})")
_HINDI_FUNCTION = set("के का की को में से पर ने और है हैं था थे थी यह वह एक इस उस तथा या नहीं कि जो लिए द्वारा गया गई गए किया की करता करते होता होती होने हुआ हुई तक भी ही क्या इसके उसके इसमें जिसमें तो ये वे हो कर करने जाता जाती बाद साथ".split())

FORMATS = {"phone": [*PHONES, "run"], "id_number": [*IDS, "run"], "address": list(ADDRESSES)}

Span = tuple[int, int, str, str]


def _matches(pattern: re.Pattern, text: str, at: int, end: int) -> Iterator[re.Match]:
    """Matches from every place in a stretch at which one begins, overlapping ones too."""
    while m := pattern.search(text, at, end):
        yield m
        at = m.start() + 1


def _numbers(text: str) -> list[Span]:
    out, at = [], 0
    while c := _CLUSTER.search(text, at):
        first, last = max(at, c.start() - 5), min(len(text), c.end() + 14)  # letters, brackets and a sign may stand before
        known: set[tuple[int, int, str]] = set()
        for kind, table in (("phone", PHONES), ("id_number", IDS)):
            for name, pattern in table.items():
                for m in _matches(pattern, text, first, last):
                    out.append((m.start(), m.end(), kind, name))
                    known.add((m.start(), m.end(), kind))
        for m in _RUN.finditer(text, first, last):
            if 9 <= sum(d.isdigit() for d in m.group()) <= 18:
                out += [(m.start(), m.end(), kind, "run") for kind in ("phone", "id_number") if (m.start(), m.end(), kind) not in known]
        at = c.end()
    return out


def _cased_names(text: str) -> list[Span]:
    out: list[Span] = []
    done = 0
    while hit := _TWO_CAPITALS.search(text, done):
        begin = hit.start()
        # a particle or the rest of the word may stand before
        tokens: list[tuple[int, int, str]] = []
        at = begin
        while m := _NAME_TOKEN.match(text, at):
            s = m.group()
            tokens.append((at, m.end(), "i" if s[-1] == "." and len(s) <= 6 else "w"))
            at = m.end()
            if text.startswith(", ", at):
                at += 2
            elif text[at : at + 1].isspace():
                at += 1
            elif tokens[-1][2] != "i":
                break
            if (text[at : at + 1] > "ɏ") != (s[0] > "ɏ"):
                break  # no name mixes scripts
        done = max(at, begin + 1)
        for i in range(len(tokens)):
            commas = words = initials = 0
            for j in range(i, min(i + _LONGEST, len(tokens))):
                if j > i and text[tokens[j - 1][1]] == ",":
                    commas += 1
                if tokens[j][2] == "w":
                    words += 1
                else:
                    initials += 1
                if commas > 1:
                    break
                if j == i or not words or (commas and (tokens[i][2] == "i" or text[tokens[i][1]] != ",")):
                    continue
                out.append((tokens[i][0], tokens[j][1], "person", "comma" if commas else "cased"))
    return out


def _uncased_names(text: str) -> list[Span]:
    out: list[Span] = []
    kana = _KANA.search(text)
    if _HAN_ANY.search(text):
        if kana or _JA_ROLE.search(text):
            for m in _KANJI_RUN.finditer(text):
                a, b = m.span()
                starts = {a, *(a + r.end() for r in _JA_ROLE.finditer(m.group()))}
                ends = {b}
                if g := _JA_GIVEN.match(text, b):
                    ends.add(g.end())
                for e in list(ends):
                    if h := _JA_HONORIFIC.search(text[a:e]):
                        ends.add(a + h.start())
                out += [(i, e, "person", "kanji") for i in starts for e in ends if 2 <= e - i <= 8 and text[i] not in " 　"]
        if not kana:
            for m in _matches(HAN_NAME, text, 0, len(text)):
                a, b = m.span()
                out.append((a, b, "person", "han"))
                if b - a < 4 and HAN_LONGER.match(text, b):
                    out.append((a, b + 1, "person", "han"))
    if _DEV_ANY.search(text):
        for m in _matches(HINDI_PAIR, text, 0, len(text)):
            words = m.group().split()
            if not any(w in _HINDI_FUNCTION for w in words):
                out.append((*m.span(), "person", "hindi"))
    return out


_KANA, _HAN_ANY, _DEV_ANY = re.compile(r"[ぁ-んァ-ヴ]"), re.compile(_HAN), re.compile(_DEV)
_SCRIPT_OF = {"ru": re.compile("[а-яё]"), "zh": re.compile("号"), "ja": re.compile("〒|[市区郡町村]"), "hi": _DEV_ANY}


def proposals(text: str) -> list[Span]:
    """start, end, type, format: every span that may be personal information, with overlaps."""
    out: list[Span] = []
    signs = [*_SIGN.finditer(text)] if "@" in text or "＠" in text else []
    low = text.lower() if "at" in text or "AT" in text else ""
    if any(x in low for x in ("[at", "(at", "{at", "<at", "[ at", "( at", " dot ", "dot]")):
        signs += _SPELLED_AT.finditer(text)
    for m in signs:
        if (host := _HOST.match(text, m.end())) and (user := _USER.search(text, max(0, m.start() - _USER_LENGTH), m.start())):
            out.append((user.start(), host.end(), "email", "email"))
    out += _numbers(text)
    able = {"en", "de", "fr"} if text.isascii() else {"en", "de", "fr", *(k for k, p in _SCRIPT_OF.items() if p.search(text))}
    for name, pattern in ADDRESSES.items():
        if name in able and _POSTAL[name].search(text):
            found = _matches(pattern, text, 0, len(text)) if name == "zh" else pattern.finditer(text)
            out += [(m.start(), m.end(), "address", name) for m in found]
    out += _cased_names(text)
    if not text.isascii():
        out += _uncased_names(text)
    return out


@lru_cache(maxsize=4)
def word_ranks(path: str) -> dict[str, int]:
    """Rank of every word that is one token behind a blank; empty if there is no such file."""
    ranks: dict[str, int] = {}
    if os.path.exists(path):
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                token = base64.b64decode(token)
                if token[:1] == b" " and token[1:].isalpha():
                    ranks[token[1:].decode("ascii")] = int(rank)
    return ranks


class _Context:
    """Features of the proposals of one text."""

    def __init__(self, text: str, spans: list[Span], ranks: dict[str, int]):
        self.text, self.ranks = text, ranks
        other = sorted((a, b) for a, b, kind, _ in spans if kind != "person")
        self.starts, self.ends = [a for a, _ in other], sorted(b for _, b in other)

    def common(self, word: str) -> tuple[float, float]:
        """log rank of the word in lower case and as a capitalized word."""
        low = word.lower()
        return math.log2(2 + self.ranks.get(low, UNKNOWN_RANK)), math.log2(2 + self.ranks.get(low.capitalize(), UNKNOWN_RANK))

    def near(self, a: int, b: int) -> tuple[float, float]:
        """How near other proposals are behind and before a span, up to 40 characters."""
        i, j = bisect_left(self.starts, b), bisect_right(self.ends, a) - 1
        return float(min(40, self.starts[i] - b)) if i < len(self.starts) else 40.0, float(min(40, a - self.ends[j])) if j >= 0 else 40.0

    def before(self, a: int) -> tuple[str, str]:
        """(class, last word) of what stands before a place. A capital counts within the script of the place only, and not
        at the beginning of a sentence."""
        raw = self.text[max(0, a - 30) : a]
        left = raw.rstrip()
        if not left or "\n\n" in raw[len(left) :]:
            return "start", ""
        word = left.rsplit(None, 1)[-1]
        last = left[-1]
        low = word.strip("([{\"“„«'‘:：,;").rstrip(".").lower()
        if last in ":：":
            return ("role_label" if WORD_CLASS.get(low) == "role" else "label"), low
        known = WORD_CLASS.get(low)
        if known == "title" and len(raw) > len(left) and (last == "." or len(low) > 1):
            # a lone M. behind a capitalized word is an initial
            if len(low) == 1 and left[: -len(word)].split()[-1:] and left[: -len(word)].split()[-1][:1].isupper():
                return "capital", low
            return "title", low
        if last in ",、，":
            return "comma", low
        if last in ";/([{（|–—-•*":
            return "opening", low
        if last in "\"“„«‘'":
            return "quote", low
        if last in ".!?…。！？।”»":
            return "sentence", low
        if low[:1].isdigit():
            return "number", low
        if known:
            return known, low
        if word[:1].isupper():
            if (word[0] > "ɏ") != (self.text[a : a + 1] > "ɏ"):
                return "word", low
            head = left[: -len(word)].rstrip()
            first = len(word) > 2 and not word.isupper() and (not head and len(left) < 30 or head[-1:] in _STOPS or "\n" in left[len(head) : -len(word)])
            return ("first_word" if first else "capital"), low
        if last.isalpha():
            return "word", low
        return "sign", low

    def after(self, b: int) -> tuple[str, str]:
        """(class, first word) of what stands behind a place."""
        right = self.text[b : b + 26]
        if not right.strip():
            return "end", ""
        first = right[0]
        if right.startswith(("'s", "’s")):
            return "genitive", "s"
        if first in "-‐@#_":
            return "glued", ""
        if first in ",、，":
            return "comma", ""
        if first in ".!?…。！？।;；:：)）]”»\"":
            return "stop", ""
        gap = right.lstrip()
        if first == "\n":
            return "line", ""
        if gap[0] in "(（[/|<—–":
            return "opening", ""
        word = gap.split(None, 1)[0].strip(".,;:!?()[]\"“”„«»")
        low = word.lower()
        known = WORD_CLASS.get(low)
        if known:
            return known, low
        if word[:1].isupper():
            return "capital", low
        if word[:1].isdigit():
            return "number", low
        return "word", low


_STOPS = set(".!?。！？:;”»")
_BEFORE = "article capital number place_preposition auxiliary company thing place month document_word sign sentence quote start first_word word opening comma conjunction person_verb person_preposition label role title role_label".split()
_BEFORE_AT = {k: float(i) for i, k in enumerate(_BEFORE)}
_AFTER = "company place thing glued document_word number capital month auxiliary place_preposition word article title role genitive line end stop quote conjunction comma opening person_preposition person_verb".split()
_AFTER_AT = {k: float(i) for i, k in enumerate(_AFTER)}
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE_START = re.compile(r"[.!?:;]\s|\n")
_CAPITALS = re.compile(rf"(?<!\w)[{_U}]")


def _cased_features(c: _Context, span: Span) -> list[float]:
    a, b, _, name = span
    s = c.text[a:b]
    words = _LETTERS.findall(s)
    whole = [w for w in words if len(w) > 1] or words
    first, last = whole[0], whole[-1]
    kinds = [WORD_CLASS.get(w.lower()) for w in whole]
    f_low, f_cap = c.common(first)
    l_low, l_cap = c.common(last)
    lows = [c.common(w)[0] for w in whole]
    before, word = c.before(a)
    after, _ = c.after(b)
    behind, ahead = c.near(a, b)
    lead = c.text[max(0, a - 90) : a]
    cut = max((m.end() for m in _SENTENCE_START.finditer(lead)), default=0)
    lead_words = lead[cut:].split()
    capitals = sum(1 for w in lead_words if w[:1].isupper())
    colon = lead[max(0, cut - 2) : cut].strip()[-1:] == ":"
    upper = s.isupper()
    shouted = upper and any(len(w) > 1 and w.isupper() for w in (*c.text[max(0, a - 24) : a].split()[-2:], *c.text[b : b + 24].split()[:2]))
    return [
        _BEFORE_AT.get(before, 14.0), _AFTER_AT.get(after, 10.0),
        float(len(words)), float(len(whole)), float(len(words) - len(whole)) if len(whole) != len(words) or len(words[0]) > 1 else float(len(words)),
        float(name == "comma"), float(upper), float("-" in s), float("\n" in s), float(s[0] > "ɏ"), float(len(words[0]) == 1), float(s[-1] == "."),
        f_low, f_cap, l_low, l_cap, min(lows), max(lows), f_low - f_cap, l_low - l_cap,
        float(sum(k in _FUNCTION for k in kinds)), float(kinds[0] in _FUNCTION), float(sum(k is not None and k not in _FUNCTION and k not in ("title", "person_verb") for k in kinds)), float("month" in kinds), float("company" in kinds or "place" in kinds), float("title" in kinds or "role" in kinds),
        float(sum(1 for w in whole if _GERMAN_NOUN.search(w))), float(min(len(w) for w in whole)), float(len(s)),
        behind, ahead, float(before in ("title", "role", "role_label", "label")), float(before == "conjunction" or before == "comma"), float(before == "capital"), float(after == "capital"),
        float(len(lead_words)), float(capitals) / (len(lead_words) + 1), float(colon), float(len(words[0]) == 1 and before == "number"), float(word in _PARTICLES_BEFORE), c.common(word)[0] if word.isalpha() else 0.0, float(shouted), float(s.startswith("M. ") and word in _FRENCH),
    ]


_FRENCH = {"par", "de", "à", "avec", "chez", "que", "et", "pour", "selon", "à"}
_PARTICLES_BEFORE = {"van", "von", "de", "der", "den", "di", "da", "du", "al", "el", "bin"}
_ZH_ROLE_END = re.compile(rf"(?:{_ZH_ROLE})$")
_ZH_LABEL = re.compile(r"[：:]\s?$")
_JA_LABEL = re.compile(rf"(?:{_JA_ROLE.pattern})(?:の|は)?[ 　：:]{{0,2}}$|[：:][ 　]?$")


def _uncased_features(c: _Context, span: Span) -> list[float]:
    a, b, _, name = span
    s, before, after = c.text[a:b], c.text[max(0, a - 12) : a], c.text[b : b + 8]
    behind, ahead = c.near(a, b)
    prev, nxt = before[-1:], after[:1]
    if name == "han":
        bare = before.rstrip("：: ")
        left = 6 if bare != before and (r := _ZH_ROLE_END.search(bare)) and len(r.group()) > 1 else 5 if _ZH_ROLE_END.search(before) and len(_ZH_ROLE_END.search(before).group()) > 1 else 4 if _ZH_LABEL.search(before) else 3 if _ZH_ROLE_END.search(before) else 2 if prev in "，。；、（(" and prev else 1 if not prev or prev.isspace() else 0
        right = 5 if re.match(r"先生|女士|教授|博士|老师|同志|主任|经理|工程师", after) else 4 if nxt and nxt in "（(，、" else 3 if not nxt or nxt in "。；;,. \n" else 2 if nxt in "说签完负测进将于在和与及" else 1 if nxt in _ZH_AFTER else 0
        compound = s[:2] in _COMPOUND
        return [0.0, float(left), float(right), float(len(s)), float(2 if compound else s[0] in SURNAMES), float(len(s) - (2 if compound else 1)), float(sum(ch in _ZH_COMMON for ch in s)), behind, ahead, float(sum(ch in _ZH_COMMON for ch in s[-1:])), 0.0]
    if name == "kanji":
        left = 5 if _JA_LABEL.search(before) and not before[-1:] in "：:" else 4 if before.rstrip(" 　")[-1:] in ("：", ":") else 2 if prev and prev in "、。（( 　「" else 1 if not prev or prev == "\n" else 0
        right = 5 if re.match(r"氏|様|さん|先生|教授|博士|君", after) else 4 if nxt and nxt in "（(、" else 3 if not nxt or nxt in "。\n 　" else 2 if nxt in "がはと" else 1 if nxt in "のをにで" else 0
        parts = re.split(r"[ 　]", s)
        return [1.0, float(left), float(right), float(len(s)), float(len(parts) > 1), float(s[-1] in _JA_GIVEN_END), float(sum(ch in _JA_SURNAME_END for ch in s[:4])), behind, ahead, float(sum(ch in _JA_TECHNICAL for ch in s)), float(bool(_JA_ROLE.search(s)) or bool(_JA_HONORIFIC.search(s)))]
    before_class, word = c.before(a)
    nxt_word = after.strip().split(" ", 1)[0].rstrip("।,") if after[:1] == " " else ""
    left = 5 if before_class in ("title", "role_label", "role") else 4 if before_class == "label" else 2 if before_class in ("comma", "opening", "conjunction") else 1 if before_class in ("start", "sentence") else 0
    right = 5 if nxt_word in ("ने", "जी", "को") else 4 if nxt and nxt in ",(" or after[:2] == " (" else 3 if not nxt or nxt in "।\n;/" else 2 if nxt_word in ("से", "द्वारा", "और", "का", "की", "के") else 0
    words = s.split()
    return [2.0, float(left), float(right), float(len(s)), float(len(words)), float(min(map(len, words))), float(word in _HINDI_FUNCTION), behind, ahead, float(nxt_word in _HINDI_FUNCTION), float(words[0] in WORD_CLASS)]


_COMPOUND = set(COMPOUND_SURNAMES)
#: Characters that stand in function words and technical terms more than in given names.
_ZH_COMMON = set("的了在和是与及为有不于由对从到所其中这该此而也被将可能上下度量气体温电化学材料膜器性层表面结构制备方法传感测试样品实验分析结果数据时间使用进行得")
_JA_TECHNICAL = set("前記多孔質層電極薄膜検知素子感度温度湿度時間測定製造方法装置材料酸化金属基板表面構造請求項発明実施例図表特性変化反応試料条件加熱焼成分散安定導率選択性回数番号編体用化合物液気圧力量値比的")


def _number_features(c: _Context, span: Span) -> list[float]:
    a, b, kind, name = span
    s = c.text[a:b]
    lead = c.text[max(0, a - 42) : a]
    # labels in front of an earlier number don't count
    digit = max((i for i, d in enumerate(lead) if d.isdigit()), default=-1)
    lead = lead[digit + 1 :]
    cue, distance = "", 50
    for m in CUE.finditer(lead):
        cue, distance = m.lastgroup or "", len(lead) - m.end()
    prev, nxt = c.text[max(0, a - 1) : a], c.text[b : b + 2]
    digits = sum(d.isdigit() for d in s)
    return [
        float(FORMATS[kind].index(name)), float(kind == "phone"), float(digits), float(len(s)), float(s[0] == "+"), float(s[:2] == "00"), float(s[0] == "0"), float(s.count("-")), float(s.count(" ")), float(s.count(".")), float(s.count("(") + s.count("（")), float(sum(ch.isalpha() for ch in s)),
        float(cue == kind), float(cue == "other"), float(cue != "" and cue != kind and cue != "other"), float(distance), float(name == "run"),
        float(prev.isalpha() and prev.isascii()), float(prev != "" and prev in "-/.,:@#$€£"), float(nxt[:1] in ("-", "/", ":", "@", "%") or (nxt[:1] == " " and nxt[1:].isdigit())), float(bool(_DATE.match(s))), float(digit >= 0 and not lead.strip(" ")),
        float(prev in ("", " ", "\n", "/", "(", "：", ":", "（") or not prev.isascii()), c.near(a, b)[1], float(s.count("/")), float(sum(d.isdigit() for d in s.partition("/")[2])),
    ]


_DATE = re.compile(r"(?:19|20)\d\d-[01]\d-[0-3]\d|(?:19|20)\d\d[./-]\d{4,}")


def _email_features(c: _Context, span: Span) -> list[float]:
    a, b, *_ = span
    s = c.text[a:b]
    return [float("@" in s or "＠" in s), float(len(s)), float(s.count(".")), float(" " in s), float(bool(re.search(r"[\[({<]", s))), float(len(s) - max(s.rfind("."), s.rfind(" ")) - 1), float(s[-1].isalpha()), float(sum(d.isdigit() for d in s)), float(_BEFORE_AT.get(c.before(a)[0], 14.0))]


_ZH_TO = set("址于在到至往住寄送去：:，。、（( ")


def _address_features(c: _Context, span: Span) -> list[float]:
    a, b, _, name = span
    s = c.text[a:b]
    return [float(FORMATS["address"].index(name)), float(len(s)), float(sum(d.isdigit() for d in s)), float(s.count(",")), float(s.count("\n")), float(c.text[max(0, a - 1) : a].isalnum()), float(c.text[b : b + 1].isalnum()), float(c.before(a)[0] == "capital"), float(c.after(b)[0] == "capital"), float(c.text[max(0, a - 1) : a] in _ZH_TO)]


#: The sets of trees: by type, names by kind of script.
GROUPS = ("cased", "uncased", "email", "number", "address")
_FEATURES = {"cased": _cased_features, "uncased": _uncased_features, "email": _email_features, "number": _number_features, "address": _address_features}


def _group(span: Span) -> str:
    if span[2] == "person":
        return "cased" if span[3] in ("cased", "comma") else "uncased"
    return "number" if span[2] in ("phone", "id_number") else span[2]


def _apart(picked: list[tuple]) -> list[tuple[int, int, str]]:
    """The best of overlapping picks (rank..., start, end, type), in order of their places."""
    kept: list[tuple[int, int, str]] = []  # sorted, without overlaps
    for *_, a, b, kind in sorted(picked, reverse=True):
        at = bisect_left(kept, (a, b))
        if (at == len(kept) or kept[at][0] >= b) and (at == 0 or kept[at - 1][1] <= a):
            kept.insert(at, (a, b, kind))
    return kept


class Detector:
    """Trees, calibration and thresholds for each group of proposals."""

    def __init__(self, sentences: int = TRAINING_SENTENCES, seed: int = 20, vocabulary: str = VOCABULARY):
        self.vocabulary = vocabulary
        ranks = word_ranks(vocabulary)
        rows: dict[str, list] = {g: [] for g in GROUPS}
        labels: dict[str, list] = {g: [] for g in GROUPS}
        for i, (text, truth) in enumerate(pii_training.labelled_sentences(sentences, seed)):
            spans = proposals(text)
            context = _Context(text, spans, ranks)
            for span in spans:
                g = _group(span)
                rows[g].append(_FEATURES[g](context, span))
                labels[g].append((span[:3] in truth, i % 3 == 0))
        self.trees, self.calibration, self.threshold = {}, {}, {}
        for g in GROUPS:
            x, (y, held) = np.array(rows[g]), np.array(labels[g], dtype=bool).T
            self.trees[g] = BoostedTrees(rounds=80, depth=5 if g == "cased" else 4, rate=0.2).fit(x[~held], y[~held].astype(float))
            score = self.trees[g].scores(x[held])
            self.calibration[g] = Calibration().fit(score, y[held].astype(float))
            self.threshold[g] = best_threshold(self.calibration[g](score), y[held].astype(float), 0.3, 0.8)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Spans in order, without overlaps."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans of many texts; the proposals of all are scored at once. A text that comes again is scored once."""
        codes, words = pd.factorize(np.array(texts, dtype=object))
        ranks = word_ranks(self.vocabulary)
        rows: dict[str, list] = {g: [] for g in GROUPS}
        owners: dict[str, list] = {g: [] for g in GROUPS}
        for k, text in enumerate(words):
            spans = proposals(text)
            context = _Context(text, spans, ranks)
            for span in spans:
                g = _group(span)
                rows[g].append(_FEATURES[g](context, span))
                owners[g].append((k, span))
        picked: list[list[tuple]] = [[] for _ in words]
        for g in GROUPS:
            if not rows[g]:
                continue
            p = self.calibration[g](self.trees[g].scores(np.array(rows[g])))
            for i in np.flatnonzero(p >= self.threshold[g]):
                k, (a, b, kind, _) = owners[g][i]
                picked[k].append((p[i] >= 0.9, b - a, float(p[i]), a, b, kind))
        found = [_apart(mine) for mine in picked]
        return [found[c] for c in codes]


@lru_cache(maxsize=2)
def detector(sentences: int = TRAINING_SENTENCES, seed: int = 20, vocabulary: str = VOCABULARY) -> Detector:
    return Detector(sentences, seed, vocabulary)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder such as [EMAIL] for each span."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_FOUND = "start_offset int, end_offset int, pii_type string"


def personal_spans(documents: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start_offset, end_offset, pii_type: every occurrence, in code points of the whole text.

    Null ids, null texts and texts without personal information give no rows; repeated rows give one set. vocabulary is
    the rank file of a public tokenizer, which every task reads; without it all words count as rare.
    """
    model = detector(vocabulary=vocabulary)
    kind = dict(documents.dtypes)[doc_id]
    ready = spread(documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t")), "d")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *s) for d, spans in zip(batch["d"], model.spans_of(batch["t"].tolist())) for s in spans]
            yield pd.DataFrame(rows, columns=["d", "start_offset", "end_offset", "pii_type"])

    return ready.mapInPandas(find, f"d {kind}, {_FOUND}").distinct().withColumnRenamed("d", doc_id)


def redacted(documents: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, redactions: every document with placeholders in the place of personal information."""
    model = detector(vocabulary=vocabulary)
    kind = dict(documents.dtypes)[doc_id]
    ready = spread(documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), "d")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["t"].map(lambda t: isinstance(t, str)).to_numpy()
            spans = model.spans_of(batch["t"].where(known, "").tolist())
            texts = [redact(t, s) if k else None for t, s, k in zip(batch["t"], spans, known)]
            yield pd.DataFrame({"d": batch["d"], "text": pd.Series(texts, dtype=object), "redactions": [len(s) for s in spans]})

    return ready.mapInPandas(rewrite, f"d {kind}, text string, redactions int").withColumnRenamed("d", doc_id)
