"""Labelled sentences for the detector of personal information, composed at random.

Names, streets, places and numbers are made up from syllables and number forms; a share of the names has ordinary given
names and surnames, so that words known to a vocabulary are seen as names too. No sentence, name or place is taken from a
corpus. Labels come with the composition.
"""

from __future__ import annotations

import random
import re

# Ordinary names, a few for each language: the detector learns from them how common words look in a name, never the words.
_ORDINARY = {
    "en": ("james mary robert linda david susan richard karen thomas nancy brian helen kevin laura".split(), "smith johnson brown taylor wilson clark walker young king wright baker carter o'brien mcdonald".split()),
    "de": ("hans petra klaus monika jürgen ute stefan birgit wolfgang heike".split(), "müller schmidt schneider fischer wagner becker hoffmann koch richter krüger".split()),
    "fr": ("jean marie michel nathalie philippe isabelle jean-pierre françoise luc hélène".split(), "martin bernard dubois petit durand leroy moreau lefèvre garnier faure".split()),
    "ru": ("андрей наталья дмитрий татьяна алексей ирина павел светлана виктор юлия".split(), "иванов петров кузнецов попов волков соколов лебедев козлов новиков морозов".split()),
}
_SYLLABLES = {
    "en": "ba ke lo mi nu ra sel tor vin dal fen gor hal jes kor lan mar nel os per quin rod sta tul wen yor zan bri cla dro ash wick thorn bel cor dun el far".split(),
    "ru": "ба ве го ди же зо ли ма не ор пу ре со та фи кра мол све гор тра вел щу".split(),
    "hi": "का रा मी नु ते लो सा वि दे जो पा शि गो ना हे".split(),
}
_ENDS = {"en": "er on ton ley man son ell ard ick ow by ett ane ora ia is us o a".split(), "ru": "ов ев ин ский енко ук ая ова ина ель".split()}
_HAN_GIVEN = "建国志强丽娟晓雨文博思远佳怡子涵浩然梓萱雨桐俊杰静秀英伟明华红云飞宇轩欣悦嘉豪雪梅春兰永康德福世昌振东海燕立新玉珍小龙一帆天佑若曦诗涵"
_KANJI_FIRST = "佐藤 鈴木 高橋 田中 渡辺 伊藤 小林 加藤 吉田 山田 松本 井上 木村 清水 山崎 池田 橋本 石川 前田 藤田 長谷川 久保田 五十嵐".split()
_KANJI_MADE = "白 黒 青 赤 大 小 上 下 東 西 南 北 高 深 長 広 若 古 新 荒 岩 竹 梅 桜 霧 霜 星 風 波 泉".split()
_KANJI_TAIL = "田 川 山 野 村 沢 原 崎 島 谷 森 浜 坂 堂 沼 ヶ丘 木野 川原".split()
_KANJI_GIVEN = "健太 美咲 翔太 陽菜 大輔 由美子 直樹 恵子 誠 和也 真由美 拓海 結衣 さくら 浩二 千尋 悠斗 葵 奈緒 隆 亮介 里奈 修平 智子".split()

_WORDS = {
    "en": "sample film oxide surface layer reactor pump valve sensor heating coating mixture report drawing meeting spring winter result table filter sheet signal noise market river garden window".split(),
    "de": "Messung Schicht Probe Lösung Temperatur Anlage Prüfung Tabelle Membran Heizung Folie Spannung Leitung Kammer Oberfläche Dichte Versuch Ausgabe Verordnung Sitzung Pumpe Regelung".split(),
    "ru": "Плёнка Образец Измерение Таблица Датчик Температура Раствор Печь Мощность Подложка Установка Отчёт Заседание Анализ".split(),
    "fr": "Mesure Couche Membrane Température Réacteur Solution Capteur Tableau Rapport Réunion Pompe Filtre".split(),
}


class Maker:
    """Random names, numbers and places."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self, lang: str = "en", least: int = 2, most: int = 3) -> str:
        made = "".join(self.rng.choice(_SYLLABLES[lang]) for _ in range(self.rng.randint(least, most) - 1))
        return (made + self.rng.choice(_ENDS.get(lang, _SYLLABLES[lang]))).capitalize()

    def digits(self, form: str) -> str:
        return "".join(str(self.rng.randint(0, 9)) if c == "#" else self.rng.choice("ABCDEFGHKLMNPRSTXYZ") if c == "@" else c for c in form)

    def person(self, lang: str) -> str:
        r = self.rng
        if lang == "zh":
            from skein.llm.pii import COMPOUND_SURNAMES, SURNAMES

            surname = r.choice(COMPOUND_SURNAMES) if r.random() < 0.4 else r.choice(SURNAMES)
            return surname + "".join(r.choice(_HAN_GIVEN) for _ in range(r.choice([1, 1, 2, 2])))
        if lang == "ja":
            first = r.choice(_KANJI_FIRST) if r.random() < 0.4 else r.choice(_KANJI_MADE) + r.choice(["", "", r.choice(_KANJI_MADE)]) + r.choice(_KANJI_TAIL)
            given = r.choice(_KANJI_GIVEN) if r.random() < 0.5 else r.choice("健美翔陽大由直恵誠和真拓結浩千悠葵奈隆亮里修智澄冬遥凛") + r.choice("太子斗菜也樹美介奈香平人乃")
            return first + r.choice(["", " ", ""]) + given
        if lang == "hi":
            return " ".join("".join(r.choice(_SYLLABLES["hi"]) for _ in range(r.randint(2, 4))) for _ in range(2))
        script = "ru" if lang == "ru" else "en"
        ordinary = _ORDINARY.get(lang, _ORDINARY["en"])
        given, surname = (r.choice(ordinary[k]).title() if r.random() < 0.35 else self.word(script) for k in (0, 1))
        if r.random() < 0.12:
            surname += "-" + self.word(script)
        if script == "en" and r.random() < 0.06:
            surname = r.choice(["van ", "von ", "de ", "O'", "Mc", "di "]) + surname
        initial = r.choice("АБВГДЕИКЛМНПРСТ" if script == "ru" else "ABCDEFGHJKLMNPRSTVW") + "."
        second = r.choice("АВДИМНПС" if script == "ru" else "ABCDEHJLMPRS") + "."
        made = r.choice([f"{given} {surname}"] * 4 + [f"{given} {initial} {surname}", f"{initial} {surname}", f"{initial} {second} {surname}", f"{surname}, {given}", f"{surname}, {initial}", f"{surname} {given}" if lang == "ru" else f"{given} {surname}", f"{surname} {initial} {second}" if lang == "ru" else f"{given} {surname}"])
        return made.upper() if r.random() < 0.1 else made

    def email(self) -> str:
        r = self.rng
        user = r.choice([f"{self.word()}.{self.word()}", f"{self.word()}_{r.randint(1, 999)}", f"{self.word()}+{self.word()}", f"{self.word()}{r.randint(1, 99)}", f"{r.choice('abcdefg')}{self.word()}", self.word()])
        user = user if r.random() < 0.2 else user.lower()
        host = ".".join([*([r.choice(["mail", "post", "uni", "office", f"dept-{r.randint(1, 9)}"])] if r.random() < 0.4 else []), self.word().lower(), r.choice("com org net edu de fr ru cn jp in example test invalid co.uk".split())])
        style = r.random()
        if style < 0.12:
            return f"{user} (at) {host}"
        if style < 0.24:
            return f"{user} [at] {host.replace('.', ' [dot] ')}"
        if style < 0.27:
            return f"{user} at {host.replace('.', ' dot ')}"
        whole = f"{user}@{host}"
        return whole.upper() if style < 0.35 else whole

    def address(self, lang: str) -> str:
        r = self.rng
        n, place = r.randint(1, 990), self.word()
        if lang == "de":
            street = self.word() + r.choice(["weg", "straße", "gasse", "platz", "allee", "str.", "ring"])
            street = r.choice([street, street, f"Am {self.word()}", f"An der {self.word()}"])
            return f"{street} {n}{r.choice(['', 'a', ' b'])}, {self.digits('#####')} {place}{r.choice(['', 'heim', 'burg', ' am See'])}"
        if lang == "fr":
            return f"{n}{r.choice(['', ' bis'])}, {r.choice(['rue', 'avenue', 'place', 'impasse', 'chemin', 'boulevard'])} {r.choice(['de la', 'du', 'des', 'de'])} {self.word()}, {self.digits('#####')} {r.choice(['Saint-', ''])}{place}"
        if lang == "ru":
            town, street = self.word("ru") + r.choice(["ск", "град", ""]), self.word("ru")
            return r.choice([f"г. {town}, {r.choice(['ул', 'пер', 'пр'])}. {street}, д. {n}{r.choice(['', f', кв. {n % 90 + 1}'])}", f"{self.digits('######')}, {town}, {r.choice(['ул. ', ''])}{street}{r.choice([' пр.', ''])}, {n % 99 + 1}"])
        if lang == "zh":
            made = lambda k: "".join(r.choice("新平安和长江河东西南北湖光明山海林石金玉清泉") for _ in range(k))
            return made(2) + r.choice("市县") + r.choice(["", made(2) + "区"]) + made(2) + r.choice(["路", "街", "大道", "巷"]) + f"{n}号" + r.choice(["", f"{n % 9 + 1}栋", f"{n % 9 + 1}栋{self.digits('###')}室"])
        if lang == "ja":
            made = r.choice(_KANJI_MADE) + r.choice(_KANJI_TAIL) + r.choice("市町区") + r.choice(_KANJI_MADE) + r.choice(_KANJI_TAIL)
            return f"〒{self.digits('###-####')} {made}{n % 9 + 1}-{n % 30 + 1}-{n % 9 + 1}"
        if lang == "hi":
            return f"{n}, {''.join(r.choice(_SYLLABLES['hi']) for _ in range(3))} {r.choice(['मार्ग', 'रोड', 'गली'])}, {''.join(r.choice(_SYLLABLES['hi']) for _ in range(3))} {self.digits('######')}"
        street = f"{self.word()} {r.choice(['Street', 'Lane', 'Ave.', 'Avenue', 'Road', 'Court', 'Walk', 'Drive', 'Way', 'Close'])}"
        street = r.choice([street, street, f"{r.choice(['Old', 'North', 'Upper'])} {street}"])
        unit = r.choice(["", "", f", Apt. {r.randint(1, 40)}", f", Suite {r.randint(1, 9)}B", f", Flat {r.randint(1, 30)}"])
        town = r.choice(["", "", "", "New ", "Port ", "Lake "]) + place + r.choice(["", "", "", " Bay", " Falls"])
        return f"{n} {street}{unit}{r.choice([', ', chr(10)])}{town}{r.choice([' ', ', '])}{r.choice([self.digits('@@# #@@'), self.digits('@@ #####')])}"


_PHONES = {
    "en": ["(###) 555-####", "+1 ### 555 ####", "###.555.####", "1-###-555-####", "###-555-####", "+1 (###) 555-#### ext. #", "+44 20 7### ####", "020 7### ####", "01## ### ####"],
    "de": ["030 / ## ### ###", "(030) #####-###", "+49 30 ##### ###", "0049/30/########", "089/#######", "+49 1## #######"],
    "fr": ["+33 1 ## ## ## ##", "01.##.##.##.##", "01 ## ## ## ##", "06 ## ## ## ##"],
    "ru": ["8 9## ### ## ##", "+79#########", "+7 (9##) ###-##-##", "8 (4##) ###-##-##"],
    "zh": ["+86 10 #### ####", "010-####-####", "（010）########", "13#########", "1## #### ####"],
    "ja": ["03-####-####", "+81 3 #### ####", "090-####-####"],
    "hi": ["+91 ##### #####", "0##### #####"],
}
_IDS = {
    "en": [("SSN ", "###-##-####"), ("SSN: ", "### ## ####"), ("social security number ", "###-##-####"), ("staff ID ", "@@ ## ## ## @"), ("National Insurance no. ", "@@ ## ## ## @"), ("NI number: ", "@@######@"), ("passport no. ", "@@#######"), ("passport ", "@########"), ("driving licence ", "@@#######"), ("passport number: ", "########@"),  ("employee ID ", "@#######"), ("tax ID ", "###-##-####")],
    "de": [("Ausweis-Nr. ", "@########"), ("Personalausweis ", "@@#######"), ("Steuer-ID ", "## ### ### ###"), ("Steuer-ID: ", "## ### ### ###"), ("Reisepass ", "@########")],
    "fr": [("no de sécurité sociale ", "# ## ## ## ### ### ##"), ("numéro de sécurité sociale : ", "# ## ## ## ### ###"), ("passeport ", "@@#######")],
    "ru": [("ИНН ", "############"), ("ИНН: ", "##########"), ("СНИЛС ", "###-###-### ##"), ("паспорт ", "## ## ######"), ("паспорт ", "#### ######")],
    "zh": [("身份证号", "#################X"), ("身份证号：", "##################"), ("护照", "@########")],
    "ja": [("個人番号", "####-####-####"), ("マイナンバー：", "#### #### ####"), ("旅券", "@@#######")],
    "hi": [("पहचान संख्या ", "#### #### ####"), ("आधार ", "#### #### ####")],
}

_FRAMES = {
    "en": [
        "Author: {person}.", "Contact: {person}, {phone}", "Name: {person}; {id}", "Applicant {person} ({id}) paid the fee.", "Yesterday {person} called us.", "The sheet was signed by {person} and {person}.",
        "For details see {person}, room 12.", "I met {person} at the gate.", "My manager, {person}, agreed.", "{person} wrote the first draft.", "{person} lives in town.", "{person} paid the bill on Friday.", "{person} opened the door for us.", "{person} sent a letter to the board.", "{person} has resigned.", "{person} will come later.", "Professor {person} joined.", "Mr. {person} and Mrs. {person} were late.",
        "Please ask {person} about it.", "Attendees: {person}; {person}; {person}", "Participants were {person}, {person} and {person}.", "On shift: {person}, {person}", "According to {person}, it works.", "Ms. {person}, {address}, filed it.", "Ship to {person}, {address}.",
        "The house at {address} is empty.", "She stays at {address} and writes.", "Go to {address} for parts.", "We moved to {address}, then left.", "Send mail to {address}.", "My SSN is {rawid}.", "Her number is {phone}.", "Call me on {phone} or at {email}.", "Mail: {email}", "Write {email} for help.", "Reach {person} under {phone}.", "{email}", "{phone}", "Tel. {phone}",
        "{person} ({email}) reviewed it.", "Reviewed by {person} on Monday.", "We are grateful to {person} for advice.", "Witness {person} / {id} / {phone}", "From: {person} <{email}>", "Best regards,\n{person}", "Signed, {person}", "The clerk {person} said no.", "Our colleague {person} has moved to {address}, phone {phone}.",
        "Driver: {person} / {phone}", "{person} / {id} / {phone}", "{id} / {phone}", "As {person} put it, nothing helps.", "Just like {person}, he stayed.", "The prize went to {person} in May.", "It was {person} who found it.", "Work by {person} shows this.", "Engineer {person} checked it ({id}).", "Office {phone}; home {phone}.", "Reply to {person}, {address}, {email}.", "The will of {person} was read.", "Does {person} know?", "It is stored with our partner {person}, {address}.", "The tools of my cousin {person}, {phone}, are old.", "{person} and her team built it.", "Later {person}, an expert, left.",
        "{person}, {address}", "{person}'s notes are lost.", "{phone} is my direct line, not the lab's.", "A copy went to {person} as well.", "{person} and {person} shared the work.",
    ],
    "de": [
        "Autor: {person}.", "Kontakt: {person}, {phone}", "Herr {person} rief an.", "Frau {person} prüfte es ({email}).", "Das Blatt wurde von {person} unterschrieben.", "Ansprechpartner: {person}, {address}, Tel. {phone}.", "Bitte fragen Sie {person}.", "Teilnehmer: {person}, {person} und {person}.",
        "Dabei waren {person} und {person}.", "Eingeladen waren {person}, {person} und {person}.", "Geehrt wurden {person} und {person}.", "{person} wohnt in {address}.", "Die Bearbeiterin {person} sagte zu.", "Anmelder {person}, {id}.", "Mail: {email}", "Telefon {phone}", "Lieferung an {person}, {address}.", "Gezeichnet {person}", "Laut {person} geht es.", "Schreiben Sie an {email}.", "Die Geräte stehen bei {person}, {address}.", "{id}", "Der Brief ging an {person} in {address}.", "Die Leitung hatte Herr {person} ({email}).",
    ],
    "fr": [
        "Auteur : {person}.", "Responsable : {person}, {address}, tél. {phone}.", "M. {person} a signé.", "Mme {person} ({email}) a relu.", "Le rapport a été rédigé par {person}.", "Participants : {person}, {person} et {person}.", "Contact : {email}", "Écrire à {person}, {address}.", "Titulaire : {person}, {id}.", "Tél. {phone}", "Merci à {person} pour son aide.", "{person} habite {address}.", "Les mesures ont été refaites par M. {person} ({email}).", "Envoyer à {email}.", "Le chef est M. {person}.", "Remis à M. {person} ({email}).", "Avec M. {person}, tout va bien.", "Signé par M. {person}, {id}.", "M. {person} et Mme {person} sont là.", "Demandeur : {person}, {id}.",
    ],
    "ru": [
        "Автор: {person}.", "Контакт: {person}, {phone}", "Инженер {person} проверил прибор.", "Отчёт подписал {person}.", "Участвовали {person}, {person} и {person}.", "Ответственный: {person}, {address}, тел. {phone}.", "Письма направлять на {email}.", "{person} живёт по адресу {address}.", "Заявитель: {person}, {id}.", "Работу выполнил {person} ({email}).",
        "Телефон: {phone}", "Спросите у {person}.", "Склад находится: {address}.", "Благодарим {person} за помощь.", "{id}", "Получатель: {person}, {address}.", "На встрече были {person} и {person}.", "Почта: {email} или {phone}", "Выступили {person} и {person}.", "Подписали {person}, {person} и {person}.", "Лаборант {person} ({email}) провёл опыт.",
    ],
    "zh": [
        "作者：{person}，{id}。", "负责人：{person}，电话{phone}。", "{person}先生来电。", "由{person}签字。", "申请人{person}，住址：{address}。", "邮箱 {email} 。", "电话：{phone}", "本报告由{person}编写。", "感谢{person}的帮助。", "{person}和{person}参加了会议。", "我叫{person}。", "请联系{person}（{email}）。", "工程师{person}完成了实验。", "姓名：{person}，{id}，地址：{address}。", "{person}说没有问题。", "请与{person}讨论。", "{person}，男，四十岁。", "发言人：{person}。", "昨天，{person}去了北京。", "{person}教授、{person}老师", "联系{person}，{phone}", "实验由{person}负责。", "寄至{address}，{person}收。", "家庭住址：{address}。", "他住在{address}。", "{person}，{id}，地址：{address}。",
    ],
    "ja": [
        "著者：{person}", "氏名：{person}、{id}", "担当者 {person}（{email}）。", "{person}さんが来ました。", "{person}氏は欠席した。", "出願人 {person}、住所 {address}。", "電話 {phone}", "連絡先：{person}、{phone}。", "責任者は{person}です。", "作成者：{person}（{id}）", "メール {email} 。", "送付先：{address}、{person}様", "測定は{person}が行った。", "昨日、{person}が到着した。", "助手の{person}、電話 {phone}、{email}", "発明者{person}（{id}）、{address}。",
    ],
    "hi": [
        "लेखक: {person}।", "{person} ने लिखा।", "नाम: {person}, {id}।", "श्री {person} आए।", "संपर्क: {person}, {phone}।", "यह काम {person} ने पूरा किया।", "पता: {address}।", "फ़ोन {phone}।", "ईमेल {email}।", "कृपया {person} को लिखें ({email})।", "डॉ. {person} से पूछें।", "रिपोर्ट {person} ने जाँची ({email}), {id}।", "आवेदक: {person}, {address}, फ़ोन {phone}।", "{person} जी का धन्यवाद।", "परीक्षण {person} ने किया।",
    ],
}

#: Sentences without personal information that look like it. # a digit, {N} {C} made-up words (Latin, Cyrillic), {L} {K} in capitals, {w} {G} {R} {F} common words.
_DECOYS = [
    "The {N} isotherm fits the {w}.", "A {N}-{N} model and the {N} equation were used.", "{N} Instruments Inc. sold the {w}.", "The {w} came from {N} Labs Ltd. in 20##.", "{N} GmbH and {N} & Co. KG merged.", "{N} University lies near {N} Bay.", "It is made by {N} Systems Corp. today.", "It was bought from {N} S.A. and sold.", "{N} S.p.A. and {N} N.V. joined {N} A.G. in 20##.", "Parts by {N} S.A. fail.", "{N} B.V. answered.", "The {N} Institute of {N} opened.", "{N} Bridge and {N} Park are near {N} Street.", "I bought a {N} {w} from {N} Stores.", "Grant ###-###-#### paid for the {w}.", "See lot ###-##-#### and batch ##-####.", "Lot ###-##-####, Grant ###-###-####.",
    "Logged 20##-04-1# 09:4#:0# under lot ###-##-####.", "Patent EP # ### ### B1 and application 20##-###### are cited.", "US #,###,### B2; WO 20##/######.", "CAS ####-##-#, doi:10.####/abc.#####.", "Data set doi:10.#####/x.##### and register no. ### ### ###.", "Order ##########, invoice ####-####-####.", "Serial no. AB####### fails.", "The {w} read ## K. After that it fell.", "It gave # V. {N} oxide was worse.", "Kept at ### K. The {w} held.", "At # A. For the {w}, see below.", "Use ### mg. On {N} paper it dries.",
    "Results And Discussion", "Materials And Methods", "The Surface Area of the Film", "Claim ## covers a Sensor, Heater and Housing.", "Figure # and Table ## show the {w}.", "In New {N}, the {w} is cheap.", "The {N} River floods.", "On Monday, March ## it rained.", "The United Kingdom and the European Union agreed.", "The {N} effect is weak; the {N} {N} barrier is not.", "Vitamin C. Common salts help.", "Type B. Units differ.", "Model {L}-## beat model {L}-###.", "READ THE TEXT AND CHOOSE ONE.", "KEEP DRY. DO NOT HEAT.", "WHILE THE {L} {L} ROLLED THROUGH {L} {L}, THE {L} KEPT {L}.", "{L} {L}, ## {L} IN ALL, AND {L} {L} FELL BEFORE {L}.", "AFTER {L} IN {L} {L} THE {L} {L} STOPPED.", "AND HANG ### GRAMS OF {L} {L} FROM ITS {L}, {L} {L} TO {L}.", "{L} {L} FELL, YET {L} {L} WAS {L}.", "NACH ## {L} RUND #,# {L}, WÄHREND {L} {L} DURCH ## {L} FIEL.", "ЗА ## {K} #,# {K}, {K} {K} {K} ЧЕРЕЗ ## {K}, И {K} {K} В {K}.", "{K} {K} {K} ИЗ {K} {K}, А {K} {K} В {K} {K} ЧЕРЕЗ ## {K}.", "{K} В {K} {K}, И {K} {K} {K} СТОЯЛА НА {K}.", "IM {L} {L} STAND EINE {L} {L} UND DER {L} {L} ZUR {L} {L}.", "{L} {L} {L} OF THE {L} {L}.", "THE {L} OF {L} AND {L} WAS {L}.", "{L} {L} ## {L}, {L} {L} ###.", "HOW TO USE THE {w}",
    "Pd@ZnO and 10ppm@300 gave ####### counts.", "Samples Na-###, Vn-### and Lt-##.", "Grid ##.#### N, ##.#### E.", "If {N} is heated, the {w} is lost.", "When {N} and {N} met, the {w} grew.", "In {N}, {N} and {N} the {w} sells well.", "{N} filters and {N} valves are sold.", "Both {N} cells and {N} tests failed.", "For {N} oxide, the {w} is low. The {N} stage drifts.", "About #### units, Version #.##.####.",
    "Die {G} der {G} war gut.", "Die {G} wurde geprüft. Der {G} folgt.", "Geeignete {G} und {G}, z. B. {G}, sind bekannt.", "Bei der {G} Nr. ## fiel die {G} aus.", "Nach Anspruch ## ist die {G} dünn.", "Am ##. Oktober wurde die {G} ersetzt.", "{N} Messtechnik GmbH lieferte die {G}.", "Die {N}-Gleichung und das {N} Modell.", "Alle {G}, z. B. {G}, d. h. {G}, u. A. {G}.", "Vgl. Abb. ## und Tab. #.", "Versuch Nr. ##, {G} Xk-###.", "Das {G} {N}-### ist neu.", "Nach {G} {G} sank die {G}.", "Mit {G} {G} und {G} {G} ging es.", "Für ### Euro kaufte {G} {G} eine {G}.", "Von {N} S.A. kam die {G}.", "Q: Der {G} war neu.", "Man nahm ## {G} {G} und ### {G}.", "Es blieben nur ## von ### {G} {G} übrig, welche {G} zählt.", "Nach ## {G} {N} war Schluss.", "Rund # {G} {G}, während {G} fiel.", "A: Im {G} stand eine {G}. Die {G} fiel.", "Der {G} {G} und die {G}.",
    "La {F} de la {F} baisse.", "Les {F} p. ex. {N} sont connus. La {F} aussi.", "La société {N} S.A. a livré la {F}.", "Selon la revendication ##, la {F} est mince.", "Le modèle de {N} convient. Le {F} suit.", "La notice dit « Garder au sec. Ne pas ouvrir. »",
    "{R} из {C} на рис. ## растёт.", "{R} и {R} по п. ##.", "ООО {C} поставило прибор.", "Уравнение {C} и модель {C}. {R} мала.", "НА РИС. ## ПОКАЗАНА {K} {K}.", "{K} {K} ## ИЗ {K}.", "{R} {C} снизилась на ## %. Для {C} она выросла.", "По ГОСТ ####-## и патенту RU #######.", "Заявка 20########, договор ####-##.",
    "采用溶胶凝胶法制备的薄膜对氢气的灵敏度为#.#。", "经过##次循环后，稳定性明显提高，误差不超过#.#%。", "该方法包括加热步骤、冷却步骤和测量步骤。", "图#示出了电极的结构。", "第##次实验失败了！", "含WO3的衬底在潮湿空气中是否稳定？", "专利号：ZL##########.#，批号####-####。", "高温下，金属氧化物的电阻下降。", "加入##毫克并搅拌过夜。", "与其他材料相比，孔隙率保持不变。", "方法：将样品放入容器中。", "温度：##℃；时间：#小时", "万用表和石英管用于测量。", "金属、白金和黄铜", "方程、时间和温度",
    "前記多孔質層が金属酸化物からなる。", "図#に示すように、感度は低下した。", "請求項##に記載のセンサ。", "測定温度：##℃、湿度 ##%。", "本発明は検知素子に関する。", "加熱時間は##分である（番号Hb-###）。", "基板、電極、薄膜を備える。", "実施例#：酸化亜鉛、白金", "選択性は変化しなかった。安定性、再現性が向上した。", "特許第#######号、ロット####-####。",
    "चित्र ## में नमूने की संवेदनशीलता है।", "तापमान बढ़ने पर चालकता बढ़ती है।", "क्या यह झिल्ली स्थिर है?", "प्रयोग ## विफल रहा।", "दूसरा नमूना: पतली परत, मोटी परत।", "विधि में ताप चरण, शीतलन चरण शामिल हैं।", "इस सेंसर ने अच्छा परिणाम दिया।",
]


def labelled_sentences(n: int, seed: int) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """n texts of a few sentences with the true spans of their personal information."""
    rng = random.Random(seed)
    maker = Maker(rng)
    fill = {
        "N": lambda: maker.word(most=4), "L": lambda: rng.choice([maker.word(), rng.choice(_WORDS["en"])]).upper(), "C": lambda: maker.word("ru"), "K": lambda: rng.choice([maker.word("ru"), rng.choice(_WORDS["ru"])]).upper(),
        "w": lambda: rng.choice(_WORDS["en"]), "G": lambda: rng.choice(_WORDS["de"]), "R": lambda: rng.choice(_WORDS["ru"]), "F": lambda: rng.choice(_WORDS["fr"]).lower(),
    }
    out = []
    for _ in range(n):
        lang = rng.choices(list(_FRAMES), [7, 3, 3, 3, 3, 3, 2])[0]
        text, truth = "", set()
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.5:
                text += re.sub(r"\{([NLCKwGRF])\}", lambda m: fill[m.group(1)](), maker.digits(rng.choice(_DECOYS).replace("@", "\0"))).replace("\0", "@")
            else:
                for part in re.split(r"(\{\w+\})", rng.choice(_FRAMES[lang])):
                    kind = part.strip("{}") if part.startswith("{") else ""
                    if kind in ("id", "rawid"):
                        label, form = rng.choice(_IDS[lang])
                        text += label if kind == "id" else ""
                        kind, value = "id_number", maker.digits(form if kind == "id" else "###-##-####")
                    elif kind:
                        # a foreign name in a text is written in Latin letters
                        written = "en" if kind == "person" and lang in ("de", "fr", "ru") and rng.random() < 0.3 else lang
                        value = {"person": lambda: maker.person(written), "email": lambda: maker.email(), "phone": lambda: maker.digits(rng.choice(_PHONES[lang])), "address": lambda: maker.address(lang)}[kind]()
                    else:
                        value = part
                    if kind:
                        truth.add((len(text), len(text) + len(value), kind))
                    text += value
            text += rng.choice([" ", "\n", "  ", " "])
        out.append((text, truth))
    return out
