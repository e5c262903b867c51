"""Personal data replaced by surrogates that look alike.

Detected are e-mail addresses, telephone, card, social security and account (IBAN) numbers, IP addresses, secrets after
their keyword, and names of persons: after a title, by a given name of the list (a parameter) before a capitalized word, in capitals
too, and before or after a form of address in Chinese, Japanese, Korean, Arabic and Hindi. A name that a text holds in full
is also found where it stands alone in that text. Every mention has a kind and a canonical form (the digits of a telephone number,
an address in lower case), and its surrogate depends on these and a secret key alone: mentions of one entity stay
alike in all texts, however they are written (coreference). Surrogates keep the kind's form: lengths, separators,
letter case, alphabets, digits' scripts, country codes, check digits where the original had valid ones, and for names the gender and
the script; given names and surnames are replaced on their own.

Different entities must keep different surrogates, and no surrogate may be an entity of the corpus. The distinct
entities of all texts are checked in Spark: of equal surrogates the smallest entity keeps its own, the others and those
that meet an entity try again until none is left. Only entities that had to try again are remembered. They are handed
to the tasks if there are at most ``REMEMBERED``, else joined to the rows that mention them; both give the same texts.

Detection covers whole texts. NULL text stays NULL. Repeated rows get equal texts. An empty table gives no rows. All
columns of the table are kept as they are, but for the text.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm import common

#: Entities that had to try again and may be handed to every task: about 100 bytes each.
REMEMBERED = 20_000
#: After so many attempts a surrogate gets one digit or letter more, an IP address any numbers.
WIDEN = 8

UP, LOW = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ", "a-zß-öø-ÿа-яёα-ωάέήίόύώϊϋΐΰ"
NAME = rf"[{UP}][{LOW}]+(?:-[{UP}][{LOW}]+)*"

EMAIL = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
SECRET = re.compile(
    r"""\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token|private[_-]?key)["']?\s*(?:=>|[:=])\s*["']?([^\s"'<>,;]{8,})""",
    re.IGNORECASE,
)
ISSUED = re.compile(r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![\w-])|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])")
# What texts with a mention of these kinds hold, found faster than the mention.
KEYWORDS = ("token", "secret", "passw", "pwd", "key")
ISSUERS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
DIGITS = re.compile(r"\d[\d .()+-]{3,}\d")
COUNTRY = re.compile(r"[A-Z]{2}\d\d")
CAPITALIZED = re.compile(rf"[{UP}]\w*")

# Titles by the gender they tell.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur M Señor Sr Don Signor Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Señorita Doña Signora Госпожа Κυρία".split(),
    "x": "Dr Prof Professor Доктор".split(),
}
TITLE = {t: g for g, ts in TITLES.items() for t in ts}
# Common given names, to find names and to replace them.
GIVEN = {
    ("latin", "m"): (
        "James John Robert Michael William David Thomas Daniel Peter Paul Richard Joseph Charles Christopher Matthew Anthony Mark Steven "
        "Andrew Kenneth George Kevin Brian Edward Ronald Jason Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Scott Brandon Benjamin "
        "Samuel Gregory Frank Patrick Alexander Jack Dennis Hans Klaus Jürgen Wolfgang Stefan Uwe Pierre Jean Jacques François Luc Carlos "
        "José Juan Miguel Luis Pedro Diego Giovanni Marco Luca Lars Sven Omar Ahmed Mohammed Ali Hassan Raj Arjun Wei Hiroshi"
    ).split(),
    ("latin", "f"): (
        "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Emily Emma Anna Barbara Jessica Karen Lisa Nancy Betty Sandra Margaret Ashley "
        "Kimberly Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Julia Olivia "
        "Sophia Isabella Charlotte Ursula Monika Sabine Claudia Petra Marie Sophie Camille Chloé María Carmen Lucía Isabel Ana Elena Giulia "
        "Francesca Ingrid Astrid Fatima Aisha Layla Priya Ananya Mei Yuki"
    ).split(),
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Николай Михаил Алексей Владимир Павел".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Юлия".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
}
Given = Mapping[tuple[str, str], Sequence[str]]
# Forms of address by the gender they tell, after the name and before it.
AFTER = {
    "先生": "m", "女士": "f", "小姐": "f", "太太": "f", "教授": "x", "博士": "x", "さん": "x", "様": "x", "ちゃん": "x", "くん": "m", "씨": "x",
    "님": "x", "선생님": "x",
}
BEFORE = {"السيد": "m", "السيدة": "f", "الدكتور": "x", "श्री": "m", "श्रीमती": "f", "डॉ": "x"}
# Frequent Chinese family names.
FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛段雷黎史龙陶贺顾毛郝龚邵万钱严武戴莫孔向汤"
#: Parts of names in these scripts.
PARTS = {
    "han": ("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红建文"),
    "kana": ("アイウエオカキクケコサシスセソタチツテト", "ナニヌネノハヒフヘホマミムメモヤユヨラリルレロ"),
    "hangul": ("김이박최정강조윤장임한오서신권황안송류홍", "민서준지현우진영수경하은도윤재성호연미나"),
    "arabic": ("محمد أحمد علي حسن حسين خالد يوسف عمر سعيد ناصر كريم طارق ماجد فهد سامي رامي بلال زياد وليد هاني".split(), "العلي الحسن الخطيب النجار الحداد المصري الشامي الكردي البغدادي التونسي الصالح الأمين القاضي الراشد الفارس".split()),
    "devanagari": ("राम श्याम मोहन सोहन विजय अजय संजय अमित रोहित सुनील अनिल राहुल दीपक विकास मनोज राजेश सुरेश महेश गणेश हरीश".split(), "कुमार शर्मा वर्मा गुप्ता सिंह यादव पटेल जोशी मिश्रा तिवारी चौहान नायर मेहता देसाई".split()),
}
#: Surnames are made of these.
ROOTS = {
    "latin": "Ash Bren Cald Dun Els Fair Gran Hart Kings Lang Mor Nor Oak Pem Rad Stan Thorn Wal West Wood".split(),
    "cyrillic": "Берез Волк Глеб Дуб Зим Калин Лес Мороз Озер Перв Ряб Сокол Тих Холм Ясен".split(),
    "greek": "Αλεξ Βασιλ Γεωργ Δημητρ Ζαχαρ Καλογ Λαμπρ Μαρκ Νικολ Παπαδ Σταυρ Φωτ".split(),
}
ENDS = {
    "latin": "berg bridge brook by dale den feld ford ham hurst ley man mont more ridge rick son ton well worth".split(),
    "cyrillic": "ин ов ский енко анов".split(),
    "greek": "όπουλος ίδης άκης ίου ιάδης".split(),
}
LETTERS = {"arabic": "\u0621-\u064a", "devanagari": "\u0900-\u0963"}
ADDRESSED = re.compile(
    rf"([{FAMILY}][\u4e00-\u9fff]{{1,2}})(?=({'|'.join(k for k in AFTER if k < '一' or '一' <= k < '가')}))"
    rf"|(?<![\u4e00-\u9fff\u30a0-\u30ff])([\u4e00-\u9fff]{{2,4}}|[\u30a1-\u30faー]{{2,8}})(?=(さん|様|ちゃん|くん))"
    rf"|(?<![가-힣])([가-힣]{{2,4}}) ?(?=(선생님|씨))"
    rf"|(?<!\w)(السيدة|السيد|الدكتور) ([{LETTERS['arabic']}]{{2,}})(?: ([{LETTERS['arabic']}]{{2,}}))?"
    rf"|(?<!\w)(श्रीमती|श्री|डॉ)\.? ([{LETTERS['devanagari']}]{{2,}})(?: ([{LETTERS['devanagari']}]{{2,}}))?"
)
CAPITALS = rf"[{UP}]{{2,}}(?:-[{UP}]{{2,}})*"
ALONE = re.compile(rf"(?<!\w)(?:{NAME}|{CAPITALS})(?!\w)")
_TITLES = "|".join(sorted(TITLE, key=len, reverse=True))
PERSON = re.compile(
    rf"(?<!\w)(?:((?:(?:{_TITLES})\.? )+)(?:({NAME}) )?({NAME})|({NAME}) ({NAME})|({CAPITALS}) ({CAPITALS}))(?!\w)"
)


class Known:
    """A list of given names, ready to be looked up."""

    def __init__(self, given: Given):
        self.given = given
        self.gender = {n: g for (_, g), names in given.items() for n in names}
        self.words = frozenset(TITLE) | frozenset(self.gender) | frozenset(n.upper() for n in self.gender)


    def gender_of(self, name: str) -> str | None:
        """The gender of a given name of the list, or of the first part of a double one."""
        return self.gender.get(name) or self.gender.get(name.split("-")[0])


@lru_cache(maxsize=8)
def _known(items: tuple) -> Known:
    return Known(dict(items))


DEFAULT = Known(GIVEN)


def known(given: Given) -> Known:
    return DEFAULT if given is GIVEN else _known(tuple((k, tuple(v)) for k, v in given.items()))


def canonical(name: str) -> str:
    """A name in capitals as it is written otherwise."""
    return "-".join(p.capitalize() for p in name.split("-")) if name.isupper() and len(name) > 1 else name


Mention = tuple[int, int, str, str]


def script(name: str) -> str:
    first = name[:1]
    for kind, low, high in (
        ("han", "\u4e00", "\u9fff"), ("kana", "\u3040", "\u30ff"), ("hangul", "가", "힣"), ("arabic", "\u0600", "\u06ff"), ("devanagari", "\u0900", "\u097f"),
    ):
        if low <= first <= high:
            return kind
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _digits(text: str) -> str:
    return "".join(str(int(c)) for c in text if c.isdecimal())


def _plain(text: str) -> str:
    """Digits of any script as ASCII ones."""
    return text if text.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in text)


def _like(digit: str, value: str) -> str:
    """A digit in the script of another one; what is no digit stays."""
    return chr(ord(digit) - int(digit) + int(value)) if digit.isdecimal() and value.isdecimal() else value


def _numbers(text: str) -> Iterator[Mention]:
    for m in IPV6.finditer(text) if "::" in text or text.count(":") >= 7 else ():
        try:
            address = ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        # neither :: nor ::1 tells of anyone, and a::b may be a name in a program
        if int(address) > 1 and (m[0].count(":") > 2 or re.search(r"[0-9A-Fa-f]{3}", m[0])):
            yield m.start(), m.end(), "ipv6", address.compressed
    if not DIGITS.search(text):
        return
    for m in IBAN.finditer(text) if COUNTRY.search(text) else ():
        compact = _plain(m[0].replace(" ", ""))
        if iban_rest(compact) == 1:
            yield m.start(), m.end(), "iban", compact
    for m in IP.finditer(text):
        if all(int(n) <= 255 for n in m[0].split(".")):
            yield m.start(), m.end(), "ip", _plain(m[0])
    for m in SSN.finditer(text):
        yield m.start(), m.end(), "ssn", _digits(m[0])
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if len(digits) == 16 and re.fullmatch(r"\d{16}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}", m[0]) or luhn(digits):
            yield m.start(), m.end(), "card", digits
    for m in PHONE.finditer(text):
        yield m.start(), m.end(), "phone", _digits(m[0])


def _persons(text: str, names: Known) -> Iterator[Mention]:
    at = 0
    while m := PERSON.search(text, at):
        title, given, surname = m[1], m[2] or m[4] or m[6], m[3] or m[5] or m[7]
        if title is None and names.gender_of(canonical(given)) is None:
            # what follows may be the given name of the next pair
            at = m.start(5) if m[5] else m.start(7)
            continue
        at = m.end()
        if given:
            start = next(m.start(k) for k in (2, 4, 6) if m[k])
            yield start, start + len(given), f"given-{names.gender_of(canonical(given)) or TITLE[title.split()[0].rstrip('.')]}", canonical(given)
        start = next(m.start(k) for k in (3, 5, 7) if m[k])
        yield start, start + len(surname), "surname", canonical(surname)


def _addressed(text: str) -> Iterator[Mention]:
    """Names beside a form of address, in scripts without capitals."""
    for m in ADDRESSED.finditer(text):
        if m[1] or m[3] or m[5]:
            group = 1 if m[1] else 3 if m[3] else 5
            yield m.start(group), m.end(group), f"name-{AFTER[m[group + 1]]}", m[group]
        else:
            first = 8 if m[7] else 11
            for group in (first, first + 1):
                if m[group]:
                    kind = f"name-{BEFORE[m[first - 1]]}" if group == first else "surname"
                    yield m.start(group), m.end(group), kind, m[group]


def _alone(text: str, found: list[Mention]) -> Iterator[Mention]:
    """Further places of the names that were found in full."""
    kinds: dict[str, str] = {}
    for _, _, kind, entity in found:
        kinds.setdefault(entity, kind)
    for m in ALONE.finditer(text):
        name = canonical(m[0])
        if name in kinds:
            yield m.start(), m.end(), kinds[name], name


def detect(text: str, given: Given = GIVEN) -> list[Mention]:
    """Mentions ``(start, end, kind, canonical form)`` in order, none in another; earlier kinds go first."""
    found: list[Mention] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        small = text.lower()
        if any(k in small for k in KEYWORDS):
            found += [(m.start(1), m.end(1), "secret", m[1]) for m in SECRET.finditer(text)]
    if any(k in text for k in ISSUERS):
        found += [(m.start(), m.end(), "secret", m[0]) for m in ISSUED.finditer(text)]
    found += _numbers(text)
    names = known(given)
    if not names.words.isdisjoint(CAPITALIZED.findall(text)):
        persons = [*_persons(text, names)]
        found += persons
        found += _alone(text, persons) if persons else ()
    if not text.isascii() and any(word in text for word in (*AFTER, *BEFORE)):
        found += _addressed(text)
    # of mentions that overlap the one found first stays; ends of those that stay, in order
    starts: list[int] = []
    ends: list[int] = []
    kept: list[Mention] = []
    for mention in found:
        at = bisect_left(starts, mention[0])
        free = (at == 0 or ends[at - 1] <= mention[0]) and (at == len(starts) or mention[1] <= starts[at])
        if free:
            starts.insert(at, mention[0])
            ends.insert(at, mention[1])
            kept.append(mention)
    return sorted(kept)


class Stream:
    """Numbers that depend on the key, the kind, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.block, self.left = key, f"{kind}\0{entity}\0{attempt}\0", 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, f"{self.seed}{self.block}".encode(), hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def of(self, items):
        return items[self.below(len(items))]

    def alike(self, text: str, hexadecimal: bool = False) -> str:
        """Digits for digits, letters for letters of the same alphabet and case."""
        out = []
        for c in text:
            if c.isdecimal():
                out.append(_like(c, self.of("0123456789")))
            elif not c.isalpha():
                out.append(c)
            elif hexadecimal:
                out.append(self.of("abcdef" if c.islower() else "ABCDEF"))
            else:
                letters = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}.get(
                    script(c), "abcdefghijklmnopqrstuvwxyz"
                )
                letter = self.of(letters)
                out.append(letter.upper() if c.isupper() else letter)
        return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int, given: Given = GIVEN) -> str:
    """The canonical form of an entity's surrogate."""
    s = Stream(key, kind, entity, attempt)
    more = attempt // WIDEN  # digits or letters more, where the form's own space is crowded
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{s.alike(local)}{s.alike('x' * more)}@{s.alike(name)}.{top}"
    if kind == "ip":
        ranges = {1: (0, 10), 2: (10, 100), 3: (100, 256)}
        parts = [ranges[len(n)] if not more else (0, 256) for n in entity.split(".")]
        return ".".join(str(low + s.below(high - low)) for low, high in parts)
    if kind == "phone":
        country = max(0, len(entity) - 10)
        return entity[:country] + s.alike(entity[country:] + "0" * more)
    if kind == "card":
        body = entity[0] + s.alike(entity[1:-1] + "0" * more)
        if luhn(entity):
            return next(body + d for d in "0123456789" if luhn(body + d))
        return body + s.of([d for d in "0123456789" if not luhn(body + d)])
    if kind == "iban":
        body = s.alike(entity[4:] + "0" * more)
        return f"{entity[:2]}{98 - iban_rest(entity[:2] + '00' + body):02d}{body}"
    if kind == "secret":
        return s.alike(entity + "0" * more, hexadecimal=re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity) is not None)
    if kind == "ipv6":
        groups = ipaddress.IPv6Address(entity).exploded.split(":")
        # groups of zeros stay; others keep their length, or get any once the space is crowded
        made = [g if g == "0000" else f"{1 + s.below(min(16 ** (len(g.lstrip('0')) + more), 65_536) - 1):x}" for g in groups]
        return ipaddress.IPv6Address(":".join(made)).compressed
    if kind.startswith("name") or script(entity) in PARTS:
        first, rest = PARTS[script(entity)]
        if script(entity) in LETTERS:  # scripts of whole words
            return " ".join(s.of(rest if kind == "surname" else first) for _ in range(1 + attempt // 2))
        return s.of(first) + "".join(s.of(rest) for _ in range(max(1, len(entity) - 1) + attempt // 2))
    if kind.startswith("given"):
        gender = kind[-1] if kind[-1] in "mf" else s.of("mf")
        names = given.get((script(entity), gender)) or given.get((script(entity), "mf"[gender == "m"])) or [entity]
        return "-".join(s.of(names) for _ in range(1 + attempt // 2 + entity.count("-")))
    if kind == "surname":
        kinds = script(entity)
        parts = [s.of(ROOTS[kinds]) + s.of(ENDS[kinds]) for _ in range(1 + attempt // 3 + entity.count("-"))]
        return "-".join(parts)
    return s.alike(entity + "0" * more)


def written(mention: str, kind: str, value: str) -> str:
    """A surrogate in the way the mention is written."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(value)
        same = "".join(_like(c, next(left)) if c.isalnum() else c for c in mention)
        return same + "".join(left)
    if kind == "ip" and not mention.isascii():
        digit = next(c for c in mention if c.isdecimal() and not c.isascii())
        return "".join(_like(digit, v) for v in value)
    if kind == "ipv6" and mention != mention.lower():
        return value.upper()
    if kind == "surname" or kind.startswith("given"):
        return value.upper() if mention.isupper() and len(mention) > 1 else value
    if kind == "email" and mention != mention.lower():
        return "".join(v.upper() if m.isupper() else v for m, v in zip(mention, value, strict=False)) if len(mention) == len(value) else value
    return value


def replace(text: str, key: bytes, again: dict[tuple[str, str], int], given: Given = GIVEN) -> tuple[str, int]:
    """The text with surrogates, and the number of mentions. ``again``: attempts of entities that had to try again."""
    out, at = [], 0
    mentions = detect(text, given)
    for start, end, kind, entity in mentions:
        value = surrogate(key, kind, entity, again.get((kind, entity), 0), given)
        out += [text[at:start], written(text[start:end], kind, value)]
        at = end
    return "".join([*out, text[at:]]), len(mentions)


MENTIONS = "array<struct<kind:string,entity:string>>"
PAIRS = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string())]))


def _mentioned(text, given: Given):
    """The distinct entities of a text column."""

    def run(batches):
        for batch in batches:
            rows = [sorted({m[2:] for m in detect(t or "", given)}) for t in batch.to_pylist()]
            yield pa.array([[{"kind": k, "entity": e} for k, e in row] for row in rows], PAIRS)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, MENTIONS)(text)


def _surrogates(key: bytes, kind, entity, attempt, given: Given):
    def run(batches):
        for columns in batches:
            rows = zip(*(c.to_pylist() for c in columns), strict=True)
            yield pa.array([surrogate(key, *row, given) for row in rows], pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(kind, entity, attempt)


def entities(docs: DataFrame, text_col: str = "text", given: Given = GIVEN) -> DataFrame:
    """``kind, entity``: the distinct entities of all texts, staged."""
    found = docs.select(F.explode(_mentioned(F.col(f"`{text_col}`").cast("string"), given)).alias("m")).select("m.kind", "m.entity")
    return common.stage(found.distinct(), "entities")


def tried_again(found: DataFrame, key: bytes, given: Given = GIVEN) -> DataFrame:
    """``kind, entity, attempt`` of the entities whose first surrogate met an entity or another surrogate, staged.

    Given names of one script share one space of surrogates and entities, whatever gender they tell. The first surrogates
    of all entities are written once; after that only those of the entities that try again move.
    """
    space = F.when(F.col("kind").rlike("^(given|name)"), F.split("kind", "-")[0]).otherwise(F.col("kind")).alias("space")
    place = ["space", "value"]

    def tries(of: DataFrame, attempt: int) -> DataFrame:
        value = F.lower(_surrogates(key, F.col("kind"), F.col("entity"), F.lit(attempt), given)).alias("value")
        made = of.select("kind", "entity", space, value)
        first = Window.partitionBy(*place).orderBy("entity", "kind")
        return made.withColumn("first", F.row_number().over(first) == 1)

    own = found.select(space, F.lower("entity").alias("value")).distinct()
    judged = tries(found, 0).join(own.withColumn("met", F.lit(True)), place, "left")
    judged = common.stage(judged.withColumn("won", F.col("met").isNull() & F.col("first")), "surrogates")
    # values that are taken: entities, and surrogates that stay
    taken = [own, judged.where("won").select(*place)]
    open_, attempt, settled = judged.where("NOT won").select("kind", "entity"), 0, []
    while not open_.isEmpty():
        attempt += 1
        mine = common.stage(tries(open_, attempt), "tries")
        wanted = mine.select(*place).distinct()
        hits = [t.join(wanted, place, "left_semi") for t in taken]
        met = reduce(DataFrame.unionByName, hits).distinct().withColumn("met", F.lit(True))
        judged = mine.join(met, place, "left").withColumn("won", F.col("met").isNull() & F.col("first"))
        judged = common.stage(judged, "tried")
        taken.append(judged.where("won").select(*place))
        settled.append(judged.where("won").select("kind", "entity", F.lit(attempt).alias("attempt")))
        open_ = judged.where("NOT won").select("kind", "entity")
    if not settled:
        return common.stage(found.limit(0).select("kind", "entity", F.lit(0).alias("attempt")), "tried-again")
    return common.stage(reduce(DataFrame.unionByName, settled), "tried-again")


RESULT = "struct<text:string,n:bigint>"
RESULTS = pa.struct([("text", pa.string()), ("n", pa.int64())])


def _replaced(key: bytes, text, again, shared, given: Given):
    """``again``: a column of the row's own entities that had to try again; ``shared``: a broadcast of all, or none."""

    def run(batches):
        everyone = shared.value if shared is not None else {}
        for texts, own in batches:
            out = []
            for t, some in zip(texts.to_pylist(), own.to_pylist(), strict=True):
                attempts = everyone if not some else {(x["kind"], x["entity"]): x["attempt"] for x in some}
                out.append((None, 0) if t is None else replace(t, key, attempts, given))
            yield pa.array([{"text": t, "n": n} for t, n in out], RESULTS)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT)(text, again)


ATTEMPTS = "array<struct<kind:string,entity:string,attempt:int>>"


def pseudonymized(
    docs: DataFrame, key: bytes, text_col: str = "text", remembered: int = REMEMBERED, given: Given = GIVEN
) -> DataFrame:
    """``whole`` (the row as a struct), ``text`` with surrogates and ``n`` mentions.

    ``given`` are the given names by script and gender, as many as one likes; with more names their surrogates vary more.
    """
    again = tried_again(entities(docs, text_col, given), key, given)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    text = F.col("whole").getField(text_col).cast("string")
    if again.count() <= remembered:
        attempts = {(r["kind"], r["entity"]): r["attempt"] for r in again.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(attempts) if attempts else None
        result = rows.withColumn("r", _replaced(key, text, F.expr(f"CAST(array() AS {ATTEMPTS})"), shared, given))
    else:
        rows = common.stage(rows.withColumn("row", common.row_key()), "rows")
        mentioned = rows.select("row", F.explode(_mentioned(text, given)).alias("m")).select("row", "m.kind", "m.entity")
        own = mentioned.join(again, ["kind", "entity"]).groupBy("row")
        own = own.agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("own"))
        joined = rows.join(own, "row", "left").withColumn("own", F.coalesce("own", F.expr(f"CAST(array() AS {ATTEMPTS})")))
        result = joined.withColumn("r", _replaced(key, text, F.col("own"), None, given))
    return result.select("whole", F.col("r.text").alias("text"), F.col("r.n").alias("n"))


def pseudonymize(
    docs: DataFrame, key: bytes, text_col: str = "text", remembered: int = REMEMBERED, given: Given = GIVEN
) -> DataFrame:
    """``docs`` with surrogates in its text column."""
    rows = pseudonymized(docs, key, text_col, remembered, given)
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns])
