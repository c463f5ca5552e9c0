"""Labelled texts for training: invented persons, addresses and numbers in invented sentences of several languages.

Sentences are put together from what stands before an entity and what stands behind it; both are of our own writing, none is taken from
the tables (a test looks for them there), or they are nonsense words, so that shapes count for more than wording. Names, towns, streets and
titles are built from syllables and endings. Look-alikes are made by rule: digit groups behind words that
name no person's number, versions, times and codes, signs that are no address, capitalised titles of things.
Texts mention some entities again, as they stood or in another form, since the skip edges are learnt from that.
"""

from __future__ import annotations

import random
import re

Span = tuple[int, int, str]

_ON = ["b", "br", "c", "d", "f", "fr", "g", "gr", "h", "j", "k", "kr", "l", "m", "n", "p", "q", "r", "s", "st", "t", "tr", "v", "w", "y", "z"]
_VO = ["a", "e", "i", "o", "u", "ea", "ie", "ou"]
_CO = ["", "l", "n", "r", "s", "k", "m", "nd", "rk", "st"]
_FAMILY_END = ["sen", "berg", "mann", "ley", "ford", "ton", "ski", "ova", "ez", "eau", "lund", "dahl", "hurst", "ini", "ström", "wick", "by", "enko"]
_TOWN_END = ["ford", "burg", "ville", "stadt", "mouth", "bridge", "heim", "ona", "ira", "haven"]
_STREET_END = ["Street", "Road", "Avenue", "Lane", "Court", "Close", "Terrace", "Drive", "Square", "Way", "Ave", "St.", "Rd"]
_HANGUL_A = "강달별솔윤한해온빛늘"
_HANGUL_B = [a + b for a in "가나다라마" for b in "람온솔빈율"]
#: Common nouns and adjectives that titles of things are made of.
_TITLE_A = "annual basic blue central civic common early eastern final global golden grand green inner joint large late local lower main modern monthly narrow new northern old open outer plain public quiet rapid red regional second shared short silent simple small solid southern spring steady summer swift upper urban weekly western white wide winter yearly young friday monday autumn".split()
_TITLE_B = "agenda archive bakery balance board bridge bulletin calendar canal catalogue chapter circle clinic council course digest engine festival forecast forum gallery garage guide handbook harbour index journal kitchen league library market meeting method museum notebook office orchard outline panel parade platform portal program project quarter question radio railway record report review room school season sheet signal station storage studio summit survey system table theatre track union update valley village warehouse window workshop".split()
_PLAIN = "about above after again all always and another any around as back before behind below best both bring but by came can change clear close come could day did done down during each early either end enough even every far few find first for from full gave get give go good had half has have held here high how if in into it just keep kept kind last late least left less let like list little long look made make many may mean might more most much must near need never next no not now of off often on once one only open or other our out over own part past place plain plan put quite rather read ready rest right run said same saw see seem seen send set several shall she should show side since small so some soon still such take tell than that the their them then there these they thing this those through time to today together too took toward turn two under until up upon us use used very was way we week well went were what when where which while who why will with work would yet you".split()
_OTHER = {
    "de": "aber alle auch auf aus bei bis das dem den der die doch ein eine er es für gegen haben hat heute hier ihm ihr ist jetzt kann kein mehr mit morgen nach nicht noch nur oder ohne schon sehr sich sie sind über und von vor war was wenn wer wie wieder wird wo zu zum zur".split(),
    "fr": "alors aussi avec avant bien car ce cela cette chez comme dans demain depuis des donc elle en encore entre est et être fait hier il jamais je leur lui mais même moins nous on ou où par pas peu plus pour quand que qui sans ses son sont sous sur très trop un une vers vous".split(),
    "es": "ahora al algo antes aquí así ayer cada como con cuando de desde después donde él ella en entre era es esta este fue ha hasta hay hoy la las lo los más me mi muy no nos o otra otro para pero poco por porque que se ser si sin sobre su también tiene todo un una y ya".split(),
    "pt": "agora ainda ali antes ao aqui assim até cada com como da das de depois do dos e ela ele em entre era essa este eu foi há hoje isso já mais mas me muito na não nas no nós o onde os ou para pela pelo por pouco quando que quem se sem ser seu sob também tem um uma".split(),
    "ko": "그리고 그래서 그런데 오늘 내일 어제 지금 다시 먼저 모두 많이 조금 아주 매우 새로 함께 이미 아직 혹시 바로 여기 거기 이번 다음 지난 회의 문서 일정 자료 결과 확인이 필요합니다 했습니다 됩니다 있습니다 없습니다 부탁드립니다 바랍니다 하세요 이며 에서 으로 까지 부터".split(),
}

#: What may stand before and behind an entity of each kind, by language: pairs of lists.
_FRAMES: dict[str, list[tuple[list[str], list[str]]]] = {
    "name": [
        (
            ["spoke with ", "as agreed with ", "thanks to ", "minutes taken by ", "the contact person is ", "the new lead is ", "assigned to ", "on behalf of ", "Hello ", "Hi ", "Regards, ", "author: ", "assignee ", "forward it to ", "Dr ", "Ms ", "Mr ", "Mrs. ", "Prof. ", "met ", "interview of ", "by ", "with ", "for ", "to ", "from ", "and ", "this is ", "name: ", "attention ", "approved by ", "on duty: ", "reviewer=", "- ", "* ", "(", "\"", "please ask ", "I talked to ", "talk to ", "a letter for ", "our colleague ", "yesterday ", "Yours, "],
            [" joined the call", " will be away until the weekend", " gave the go-ahead", ", head of sales,", " wrote down the rest", ":", "'s laptop was replaced", " has the keys", " left early", " knows more", " and the others", ", please advise", ")", "\"", " again", " called twice", " thinks so too", " prefers the second option", ".", "!", "?", "", " (away)", " is responsible", " wants a copy", " did not answer", " confirmed", "; nobody else", " - thanks", " lives nearby", " turned it down", " explained the rest", " was not there"],
        ),
        (["Herr ", "Frau ", "im Auftrag von ", "zuständig ist ", "Gruß, ", "laut ", "für ", "von ", "an ", "Ansprechpartnerin: ", "mit "], [" kommt später", " hat zugestimmt", " fragt nach", ".", ",", "", " ist im Urlaub"]),
        (["Monsieur ", "Madame ", "M. ", "Mme ", "de la part de ", "avec ", "pour ", "selon ", "responsable : "], [" arrive demain", " a refusé", ".", ",", "", " est absente"]),
        (["el señor ", "la señora ", "Sra. ", "Sr. ", "de parte de ", "con ", "para ", "según ", "responsable: "], [" llega tarde", " lo aprobó", ".", ",", "", " no contesta"]),
        (["o senhor ", "a senhora ", "Sr. ", "da parte de ", "com ", "para ", "segundo ", "responsável: "], [" chega amanhã", " aprovou tudo", ".", ",", "", " não respondeu"]),
        (["작성자: ", "발표는 ", "참석자 ", "", "어제 "], [" 씨가 왔다", " 참석", ""]),
    ],
    "korean": [(["", "작성자 ", "발표자는 ", "담당자 ", "오늘 ", "그리고 ", "결재: ", "문의는 "], [" 님", " 님께", " 님이 참석했습니다", " 씨", " 씨가 발표합니다", " 님의 의견", " 님 부재중", " 님에게 문의", "님께 전달", "님 확인 부탁"])],
    "email": [
        (
            ["e-mail ", "mail to ", "mail: ", "address <", "<", "(", "user=", "to: ", "cc ", "reply to ", "write ", "or ", "and ", "mailed from ", "login ", "account ", "", "at ", "the inbox ", "contact "],
            ["", ".", ",", ">", ")", " bounced twice", " for details", " or by phone", "; thanks", " is the new one", " please", " - urgent", "|", " was blocked", " und ", " et "],
        ),
        (["E-Mail an ", "schreiben Sie an ", "Mail: ", "per Mail: "], [" bitte", ".", ""]),
        (["courriel : ", "écrire à ", "envoyer à "], [" merci", ".", ""]),
        (["correo: ", "enviar a ", "para "], [" gracias", ".", ""]),
        (["e-mail: ", "enviar para "], [" obrigado", ".", ""]),
        (["메일 ", "메일 주소는 ", "이메일: ", ""], [" 으로 보내세요", " 입니다", " 로 회신", ""]),
    ],
    "phone": [
        (
            ["phone ", "phone: ", "tel ", "tel. ", "Tel: ", "mobile ", "cell: ", "ring ", "ring me on ", "reach us on ", "call ", "call back: ", "dial ", "fax ", "fax: ", "text ", "hotline ", "number ", "at ", "on ", "or ", "and ", "", "(", "new number: ", "office ", "home: ", "voicemail "],
            ["", ".", ",", ")", " in the evening", " before noon", " ext 5", " or mail", "; ask twice", " works best", " is engaged", " (private)", " please", "|", " does not exist any more", " today"],
        ),
        (["Telefon ", "Tel. ", "Rückruf unter ", "mobil: ", "unter "], [" anrufen", ".", ""]),
        (["téléphone ", "tél. ", "joindre au ", "portable : "], [" le soir", ".", ""]),
        (["teléfono ", "móvil: ", "tel. ", "al "], [" por la tarde", ".", ""]),
        (["telefone ", "celular: ", "ligar para "], [" à noite", ".", ""]),
        (["전화 ", "전화번호: ", "연락처 ", "휴대폰 ", "팩스 "], [" 으로 연락", " 입니다", " 로 전화", ""]),
    ],
    "idnum": [
        (
            ["soc. sec. no. ", "SSN ", "SSN: ", "passport ", "passport number ", "passport: ", "tax number ", "tax ID ", "TIN ", "national id ", "national ID: ", "identity card ", "id card no. ", "insurance number ", "NI number ", "her ID ", "his ID: ", "holder of ID ", "personal number "],
            ["", ".", ",", ")", " on file", " expired", " was checked", " must be removed", " is a guest's", "; delete it", " (copy)", " again", " please shred"],
        ),
        (["Steuernummer ", "Ausweis ", "Ausweisnummer: ", "Reisepass ", "Personalausweis ", "IdNr. "], [" löschen", ".", ""]),
        (["passeport ", "numéro fiscal ", "carte d'identité ", "sécurité sociale "], [" à effacer", ".", ""]),
        (["DNI ", "pasaporte ", "NIE: ", "número fiscal "], [" borrar", ".", ""]),
        (["passaporte ", "CPF ", "NIF: ", "identidade "], [" apagar", ".", ""]),
        (["주민등록번호 ", "주민번호: ", "여권번호 ", "여권 ", "신분증 번호 "], [" 삭제", " 는 지워 주세요", ""]),
    ],
    "address": [
        (
            ["address: ", "address ", "deliver to ", "lives at ", "living at ", "moved to ", "resident at ", "the flat at ", "letters go to ", "billing: ", "home: ", "visit ", "at ", "near ", "in front of ", "", "(", "\"", "from ", "pick up at "],
            ["", ".", ",", ")", "\"", " by courier", " since last year", " (second floor)", "; ring twice", " until further notice", " is closed", " please", " today"],
        ),
        (["Anschrift: ", "wohnt in der ", "Lieferung an ", "in der ", "wohnt "], [" abgeben", ".", ""]),
        (["adresse : ", "habite au ", "livrer au "], [" s'il vous plaît", ".", ""]),
        (["dirección: ", "vive en la ", "entregar en "], [" por favor", ".", ""]),
        (["endereço: ", "mora na ", "entregar na "], [" por favor", ".", ""]),
        (["주소는 ", "주소: ", "배송지 ", ""], [" 입니다", " 로 배송", ""]),
    ],
}
#: Words before digit groups that are no person's number.
_COUNTED = "order invoice ticket parcel serial isbn part lot batch case article build epoch offset checksum row port seq job range run item receipt voucher tracking chapter page line lines score size total sum count id# ref sku version release sprint shard bucket key step node block frame bytes tokens bestellung rechnung commande facture pedido factura 주문 주문번호 송장 번호표 페이지 버전".split()
_UNITS = "ms s kb MB GB % rows files days hours km kg EUR USD items points tests 원 개 분 초 시간".split()
_SENTENCE = ["{w} {w} {T} {w}.", "the {T} {w} {w}", "{T}: {w} {w}", "{W} {w} {w} {T}", "see {T}", "{w} ({T})", "{T}, {T} {w}", "{w} {w}. {W} {w}", "{w} {w}. {W} {W2} {w}", "{W} {w} {w} {w}", "{pw} {w} {pw}", "{Pw} {w} {w}", "{pw}, {ref} {w} {ref}", "{ref}; {pw}", "{w} {T} {n} {w}", "{T} {n}", "{U} {w}", "{U} {U2} {w}", "{w} {Pw} {W}", "{Pw}'s {w} {w}", "at {n}:{n2} {w}"]
_KO_SENTENCE = ["{k} {k} {k}", "{k} {pw} {k}", "고객님 {k}", "여러분께 {k}", "회원님 {k} {k}", "선생님이 {k}", "팀장님 {k}", "담당자에게 {k}", "담당자 {k}", "{role} 님 {k}", "{role} 님께 {k}", "{role} 님이 {k}", "{role}님 {k}", "{k} {role} 님 {k}", "담당자 {role} {k}", "{k} 씨앗 {k}"]
#: Whom a form of address follows without being a name.
KO_ROLES = "고객 회원 사용자 이용자 선생 팀장 부장 과장 차장 대리 사장 회장 대표 원장 교수 박사 기사 관리자 담당자 작성자 독자 시청자 구독자 참석자 신청자 보호자 학부모 의원 위원 이사 감독 작가".split()


class Maker:
    """Makes texts; known_given, known_family and known_korean are the lists that stand for a directory of known persons."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given = [self._syllables(2).capitalize() for _ in range(150)]
        self.stems = [self._syllables(1).capitalize() for _ in range(24)]
        self.family = [s + e for s in self.stems for e in _FAMILY_END]
        self.korean = [a + b for a in _HANGUL_A for b in _HANGUL_B]
        self.known_given, self.known_family = set(self.given[:135]), set(self.r.sample(self.family, len(self.family) * 6 // 10))
        self.known_korean = {x for x in self.r.sample(self.korean, len(self.korean) * 6 // 10) if x[1:] not in _HANGUL_B[:3]}
        self.met: list[tuple[str, str]] = []

    def _syllables(self, n: int) -> str:
        return "".join(self.r.choice(_ON) + self.r.choice(_VO) + self.r.choice(_CO) for _ in range(n))

    def _digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def _hex(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))

    def _upper(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHKMPQRSTXYZ") for _ in range(n))

    def word(self) -> str:
        w = self._syllables(self.r.randint(2, 4))
        return w if self.r.random() < 0.8 else w + self.r.choice(["_" + self._syllables(1), "." + self.r.choice(["py", "md", "json", "rs", "toml"]), "_x.rs", self._digits(1), "-" + self._syllables(1)])

    def title(self) -> str:
        a, b = self.r.choice(_TITLE_A).capitalize(), self.r.choice(_TITLE_B).capitalize()
        x = self.r.random()
        if x < 0.5:
            return f"{a} {b}"
        if x < 0.7:
            return f"{b} {self.r.choice(_TITLE_B).capitalize()}"
        return f"{a} {b} {self.r.choice(_TITLE_B).capitalize()}" if x < 0.85 else f"{self.word().capitalize()} {b}" if x < 0.93 else f"{a} {self._syllables(2).capitalize()}"

    # entities

    def name(self) -> str:
        r = self.r
        given, family = r.choice(self.given), r.choice(self.family)
        if r.random() < 0.12:
            family += "-" + r.choice(self.family)
        if r.random() < 0.14:
            family = r.choice(["de ", "van ", "von ", "el-", "al-", "da ", "di ", "van der ", "de la "]) + family
        return self._ordered(given, family)

    def _ordered(self, given: str, family: str) -> str:
        x = self.r.random()
        out = f"{given} {family}" if x < 0.66 else f"{family}, {given}" if x < 0.82 else f"{given[0]}. {family}"
        return out.upper() if self.r.random() < 0.06 else out

    def email(self) -> str:
        r = self.r
        g, f = r.choice(self.given).lower(), re.sub("[^a-z]", "o", r.choice(self.family).lower())
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{f}{r.randint(2, 99)}", f"{g}+{self._syllables(2)}", g, f"{g}.{f}+{r.randint(2, 99)}", self._syllables(2)])
        host = ".".join([*([r.choice(["mail", "post", "inbox", "team", "web"])] if r.random() < 0.5 else []), self._syllables(2), *([self._syllables(1)] if r.random() < 0.2 else []), r.choice(["example", "example.org", "example.net", "com", "org", "net", "test", "invalid", "co.kr", "de", "fr"])])
        at, dot = r.choice([("@", ".")] * 6 + [(" @ ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), ("＠", "."), (" at ", " dot "), (" AT ", " DOT ")])
        out = local + at + host.replace(".", dot)
        return out.upper() if r.random() < 0.1 else out

    def phone(self) -> str:
        d, r = self._digits, self.r
        return r.choice([
            f"+1 {d(3)}-{d(3)}-{d(4)}", f"+1{d(10)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(2)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}",
            f"010-{d(4)}-{d(4)}", f"010 {d(4)} {d(4)}", f"010{d(8)}", f"02-{d(3)}-{d(4)}", f"+82 10 {d(4)} {d(4)}", f"+82-10-{d(4)}-{d(4)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(6)}", f"+49 (0){d(2)} {d(7)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(2)} / {d(7)}", f"0{d(3)} {d(6)}", f"0{d(3)}-{d(6)}",
            f"01{d(3)} {d(3)} {d(3)}", f"0{d(4)} {d(6)}", f"+44 {d(4)} {d(6)}", f"+44 {d(2)} {d(4)} {d(4)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33{d(9)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+34 {d(3)} {d(2)} {d(2)} {d(2)}", f"+55 {d(2)} {d(5)}-{d(4)}", f"({d(2)}) {d(5)}-{d(4)}", f"+351 {d(3)} {d(3)} {d(3)}",
        ])

    def idnum(self) -> str:
        d, r, up = self._digits, self.r, self._upper
        return r.choice([
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(6)}-{d(7)}", f"{up(2)}{d(6)}{up(1)}", f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", f"{up(2)}{d(7)}", f"{up(1)}{d(8)}", f"{up(1)}{d(2)}{up(1)}{d(4)}{up(1)}", f"{d(2)} {d(3)} {d(3)} {d(3)}",
            f"{d(11)}", f"{d(9)}", f"{d(8)}{up(1)}", f"{d(8)}-{up(1)}", f"{up(1)}-{d(7)}-{up(1)}", f"{up(1)}{d(7)}{up(1)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}",
        ])

    def address(self) -> str:
        r = self.r
        made = lambda ends: (self._syllables(r.randint(1, 2)).capitalize() if r.random() < 0.6 else r.choice(_TITLE_B).capitalize()) + r.choice(ends)
        street, n, zip_ = made([""]), r.randint(1, 199), self._digits(5)
        town = made(_TOWN_END) if r.random() < 0.8 else r.choice(["Sankt ", "Port ", "New ", "Bad "]) + made([""]) if r.random() < 0.5 else r.choice(["Port-", "Saint-", "Sankt-"]) + made([""])
        end, german = r.choice(_STREET_END), r.choice(["weg", "straße", "gasse", "platz", "allee", "strasse"])
        hangul = "".join(r.choice("가나다라마바사솔달별한빛온누리들") for _ in range(2))
        return r.choice([
            f"{n} {street} {end}, {town}", f"{n} {street} {end}".rstrip("."), f"{n}{r.choice('abCD')} {street} {end}".rstrip("."), f"{n} {street} {end}, {town} {zip_}", f"Flat {r.randint(1, 9)}, {n} {street} {end}, {town}", f"Apt {r.randint(1, 9)}, {n} {street} {end}",
            f"{street}{german} {n}", f"{street}{german} {n}, {zip_} {town}", f"{street}{german} {n}{r.choice('abc')}, {zip_} {town}", f"Calle {street} {n}, {zip_} {town}", f"Calle de {street} {n}", f"Avenida {street} {n}, {town}", f"{n} bis, rue {street}, {zip_} {town}", f"{n}, rue {street}, {zip_} {town}", f"{n} rue de {street}, {zip_} {town}", f"rue {street} {n}",
            f"{hangul}시 {hangul[::-1]}로{r.randint(1, 40)}길 {n}", f"{hangul}구 {hangul[::-1]}로 {n}", f"{hangul}시 {hangul}구 {hangul[::-1]}길 {n}", f"Rua {street} {n}, {zip_} {town}", f"Rua de {street} {n}", f"Via {street} {n}, {zip_} {town}",
        ])

    # other text

    def ref(self) -> str:
        d, r = self._digits, self.r
        return r.choice([f"{self._syllables(1)}-{d(5)}", f"#{d(r.randint(3, 6))}", f"{self._upper(3)}-{d(r.randint(2, 5))}", f"{self._upper(1)}{d(5)}", self._hex(7), self._hex(12), d(7), f"{d(1)}.{d(1)}.{d(2)}", f"v{d(1)}.{d(2)}", f"{self._syllables(2)}@{d(1)}.{d(1)}.{d(1)}", f"{self._syllables(2)}/{self._syllables(1)}@{d(2)}"])

    def _number(self) -> str:
        """Digit groups, times, versions and amounts."""
        d, r = self._digits, self.r
        groups = lambda s: s.join(d(r.randint(2, 5)) for _ in range(r.randint(2, 4)))
        return r.choice([
            groups("-"), groups("-"), groups(" "), groups("."), groups("/"), f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", d(8), d(9), d(10), d(11), d(13), f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}T1{d(1)}:{r.randint(10, 59)}:{r.randint(10, 59)}Z", f"1{d(1)}:{r.randint(10, 59)}",
            f"{d(1)}.{d(2)}.{d(1)}", f"10.{d(2)}.{d(2)}.{d(1)}", f"{d(1)},{d(3)},{d(3)}", f"{d(3)}.{d(2)}", f"97{r.choice('89')}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{self._hex(8)}-{self._hex(4)}-{self._hex(4)}", f"{d(4)}-{d(4)}", f"{d(4)} to {d(4)}", f"{d(2)}/{d(2)}/20{d(2)}",
        ])

    def _decoy(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.45:
            sep = r.choice([" ", ": ", " no. ", " #", "=", " nr. ", " number ", " "])
            return f"{self._some(r.randint(0, 2))}{r.choice(_COUNTED)}{sep}{self._number()} {self._some(r.randint(0, 3))}".strip()
        if x < 0.55:
            return f"{self._some(2)}{self._number()} {r.choice(_UNITS)} {self._some(2)}".strip()
        if x < 0.68:
            return r.choice(["@" + self.word(), f"ping @{self.word()} {self._some(2)}", f"{self.word()}@{self._digits(1)}.{self._digits(1)}.{self._digits(2)}", f"{self.word()}@{self._digits(2)} {self._some(2)}", f"look at the dot {self._some(1)}", f"meet at noon {self._some(2)}", f"{self._some(2)}at {self.word()} {self._some(2)}", f"@ {self.word()} {self._some(1)}", f"{self.word()} @ {r.randint(1, 99)}"]).strip()
        if x < 0.8:
            return r.choice([f"{r.randint(1, 99)} {r.choice(_TITLE_A)} {r.choice(_TITLE_B)}", f"{r.choice(_STREET_END[:6])} {r.randint(1, 99)} {self._some(2)}", f"{r.randint(2, 99)}, {self.title()}", f"{r.choice([*_STREET_END[:5], *_TITLE_B]).capitalize()} {r.randint(1, 99)}, {self.title()} {self._some(1)}", f"{self.title()} {r.choice(_STREET_END[:5])} {self._some(1)}", f"{r.choice([*_STREET_END[:5], *_TITLE_B]).capitalize()} {r.randint(1, 99)}, {r.choice(_TITLE_B).capitalize()} {r.choice(_STREET_END[:5])} {self._some(2)}",  # a street without a house number
             f"{r.randint(1, 99)} {self.title()}", f"{r.choice(['Plan', 'Section', 'Part', 'Option', 'Team'])} {self._upper(1)}. {r.choice(_TITLE_B).capitalize()} {self._some(2)}", f"{r.choice(_TITLE_B)} {self._upper(1)}. {self.title()}", f"{r.choice(_TITLE_B).capitalize()}, {r.choice(_TITLE_B).capitalize()} and {r.choice(_TITLE_B)}"])
        return self._fill(r.choice(_KO_SENTENCE if r.random() < 0.3 else _SENTENCE))

    def _fill(self, template: str) -> str:
        r = self.r
        made = {
            "w": lambda: r.choice(_PLAIN), "W": lambda: r.choice(_PLAIN).capitalize(), "W2": lambda: r.choice(_TITLE_B).capitalize(), "T": self.title, "pw": self.word, "Pw": lambda: self.word().capitalize(), "ref": self.ref, "n": lambda: str(r.randint(1, 23)), "n2": lambda: str(r.randint(10, 59)),
            "U": lambda: r.choice(_TITLE_B).upper(), "U2": lambda: r.choice(_PLAIN).upper(), "k": lambda: r.choice(_OTHER["ko"]), "role": lambda: r.choice(KO_ROLES),
        }
        return re.sub(r"\{(\w+)\}", lambda m: made[m[1]](), template)

    def _some(self, n: int, lang: str = "en") -> str:
        """n words with a space behind each: of a language, nonsense, or a reference."""
        r = self.r
        stock = _PLAIN if lang == "en" else _OTHER[lang]
        return "".join((r.choice(stock) if (x := r.random()) < 0.6 else self.word() if x < 0.85 else r.choice(_TITLE_B) if x < 0.95 else self.ref()) + " " for _ in range(n))

    def _entity(self, kind: str) -> str:
        """A new entity, or one that was met before, sometimes in another form."""
        r = self.r
        old = [v for k, v in self.met if k == kind]
        if old and r.random() < 0.35:
            v = r.choice(old)
            if kind == "name" and r.random() < 0.5 and (m := re.fullmatch(r"([A-Z]\w+) ((?:[a-z]\S* )*\S+)", v)):
                return self._ordered(m[1], m[2])
            return v
        v = {"name": self.name, "korean": lambda: r.choice(self.korean), "email": self.email, "phone": self.phone, "idnum": self.idnum, "address": self.address}[kind]()
        self.met.append((kind, v))
        return v

    def _framed(self) -> tuple[str, list[Span]]:
        """One or two entities with what stands before and behind them."""
        r = self.r
        out, spans = "", []
        lang = r.choice(["en", "en", "en", "en", "de", "fr", "es", "pt", "ko"])
        for k in range(1 if r.random() < 0.75 else 2):
            kind = r.choice(["name", "name", "name", "korean", "korean", "email", "email", "phone", "phone", "idnum", "idnum", "address", "address"])
            frames = _FRAMES[kind]
            before, behind = frames[0] if len(frames) == 1 else frames[["en", "de", "fr", "es", "pt", "ko"].index(lang)]
            made = self._entity(kind)
            x = r.random() * (0.6 if kind == "idnum" and not re.search("[A-Z]", made) else 1)  # digits alone are told by what stands before
            lead = r.choice(before) if x < 0.6 else self._some(r.randint(1, 3), lang) if x < 0.85 else "" if k == 0 else " "
            if kind == "korean" and not lead.strip():
                lead = ""
            if kind == "korean" and r.random() < 0.5:
                lead = ""
            if k:
                out += r.choice([" ", ", ", "; ", " / ", " - ", " | ", "\n", ". "])
            elif lead and r.random() < 0.3:
                out += self._some(r.randint(1, 3), lang)
            if r.random() < 0.1:
                lead = lead.capitalize()
            out += lead
            spans.append((len(out), len(out) + len(made), "name" if kind == "korean" else kind))
            out += made
            x = r.random()
            if kind != "korean" and r.random() < 0.08:  # a sentence that begins without a stop before it
                out += " " + r.choice(_PLAIN).capitalize() + " " + r.choice(_PLAIN)
                continue
            out += r.choice(behind) if x < 0.6 or kind == "korean" else " " + self._some(r.randint(1, 3), lang).strip() if x < 0.85 else ""
        return out, spans

    def sentence(self, most: int = 3) -> tuple[str, list[Span]]:
        """A text of one to most sentences with the spans (start, end, kind) of what is personal."""
        self.met = []
        out, spans = "", []
        for k in range(self.r.randint(1, most)):
            x = self.r.random()
            text, some = self._framed() if x < 0.6 else (self._decoy(), []) if x < 0.88 else (self._some(self.r.randint(2, 8)).strip(), [])
            if k:
                out += self.r.choice([" ", " ", "\n", ". ", ". ", ", ", "; "])
            spans += [(a + len(out), b + len(out), c) for a, b, c in some]
            out += text
        return out, spans


def stock() -> list[str]:
    """All written pieces of sentences, for the test that none of them stands in the tables."""
    pieces = [p for frames in _FRAMES.values() for pair in frames for side in pair for p in side]
    return [*pieces, *(x for t in (*_SENTENCE, *_KO_SENTENCE) for x in re.split(r"\{\w+\}", t))]
