"""Find personal information in free text and replace it.

Every detected entity is replaced by a placeholder of its type, or by a surrogate: a keyed replacement of the
same type, format and script. All surrogates are keyed permutations, so distinct entities stay distinct, the same
entity has one surrogate everywhere, in whatever order and number texts come, and nothing but the key is shared
between tasks. Names become pronounceable words of the same script, of the gender that their ending tells and of
bounded length; a surrogate that is itself a name in the corpus is drawn again.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.session import cut

TYPES = ["email", "phone", "id_number", "address", "name"]

_AT = r"\s*(?:@|＠|\(at\)|\[at\]|\{at\}|<at>)\s*"
_DOT = r"(?:\.|\s*(?:\(dot\)|\[dot\]|\{dot\})\s*)"
#: The part before the sign has at most 64 characters and begins at a boundary, so long runs cost nothing.
_USER = r"(?<![\w.%+\-])[\w.%+\-]{1,64}"
EMAIL = re.compile(rf"{_USER}(?:{_AT})\w[\w\-]{{0,62}}(?:{_DOT}\w[\w\-]{{0,62}}){{0,8}}{_DOT}[A-Za-z]{{2,24}}|{_USER}\s+at\s+\w[\w\-]{{0,62}}(?:\s+dot\s+\w[\w\-]{{0,62}}){{1,8}}", re.I)

# What announces a number of identity, the nouns of kinship, titles, and kinds of street.
_ID_WORDS = (
    r"ssn|social[ -]security(?: (?:number|no|nr|card))?|passport(?: (?:number|no|nr))?|(?:national|citizen) id(?:entity)?(?: (?:number|card|no))?|identity (?:card|number)(?: (?:number|no))?|id card(?: (?:number|no))?|"
    r"driver(?:['’]?s)? licen[cs]e(?: (?:number|no))?|driving licen[cs]e(?: (?:number|no))?|licen[cs]e (?:number|no)|insurance (?:number|no|id|policy)(?: (?:number|no))?|(?:health )?insurance card|policy (?:number|no)|"
    r"member(?:ship)? (?:id|number|no)|medical record(?: (?:number|no))?|mrn|nhs(?: (?:number|no))?|health card(?: (?:number|no))?|patient (?:id|number|no)|id (?:number|no)|nino|tax (?:id|number)|nie|dni|ausweisnummer|"
    r"sozialversicherungsnummer|versicherungsnummer|numéro de sécurité sociale|número de la seguridad social|pasaporte|passeport|reisepass"
)
ID_NUMBER = re.compile(rf"\b(?:{_ID_WORDS})\b\.?\s*(?:is|was|:|#|=|nr\.?|no\.?|number)?[\s:#=]*((?=[A-Z0-9\- ./]*\d)[A-Z]{{0,5}}[\-. ]?\d(?:[A-Z0-9]|[\-. /](?=[A-Z0-9]*\d)){{2,24}})", re.I)
BARE_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")

PHONE = re.compile(
    r"(?<![\w/.\-])(?:\+\s?\d{1,3}[\s().\-]*(?:\(?\d{1,4}\)?[\s.\-]*){1,5}\d{2,}|00\d{1,3}(?:[\s.\-]?\d{2,4}){2,5}|\(\d{2,5}\)\s?\d{3,4}[\s.\-]?\d{3,5}|0\d{2,4}[\s.\-/]\d{3,4}[\s.\-]?\d{3,4}|0\d{9,10}|\d{3}[\-. ]\d{3}[\-. ]\d{4}|[2-9]\d{9})(?![\w\-]|[./]\d)"
)
CALLED = re.compile(r"\b(?:tel|phone|telephone|mobile|cell|fax|call|ring|text|whatsapp|reach me on|reach me at|number is|tél|teléfono|telefon|handy)\b\.?:?\s*((?:\+|\()?\d[\d\s().\-]{5,18}\d)(?![\w\-])", re.I)

_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][\w’']*(?:[\-‑][A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][\w’']*)*"
_STREET = r"Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Terrace|Ter|Way|Close|Court|Ct|Drive|Dr|Place|Pl|Square|Sq|Boulevard|Blvd|Crescent|Cres|Gardens|Gdns|Hill|Row|Walk|Mews|Grove|Parkway|Pkwy|Highway|Hwy|Quay|Alley"
_TOWN = rf"(?:,?\s+(?:in\s+)?(?:\d{{4,6}}\s+)?{_CAP}(?:\s+{_CAP})?(?:,?\s+\d{{4,6}}\b|,?\s+[A-Z]{{1,2}}\d[\dA-Z]?\s?\d[A-Z]{{2}}\b)?)?"
_FLAT = r"(?:(?:flat|apt\.?|apartment|unit|suite|room|no\.?)\s*#?\d+\w?,?\s+)?"
_FLAT_AFTER = r"(?:,?\s+(?:flat|apt\.?|apartment|unit|suite)\s*#?\d+\w?)?"
ADDRESS = re.compile(
    "|".join(
        [
            rf"\b(?i:p\.?\s?o\.?\s?box|post(?:al)?\s?(?:office\s)?box|postfach|apartado(?: de correos)?|boîte postale)\s*#?\d+{_TOWN}",
            rf"\b(?i:{_FLAT})\b\d{{1,5}}[A-Za-z]?,?\s+(?:{_CAP}\s+){{1,3}}(?:{_STREET})\b\.?(?i:{_FLAT_AFTER}){_TOWN}",
            rf"\b\d{{1,5}}(?:\s?(?:bis|ter))?,?\s+(?i:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|calle|avenida|plaza|paseo|camino|via|viale|piazza)\s+(?:(?:de|du|des|la|le|les|del|los|las|di|della)\s+|l['’]|d['’])*{_CAP}(?:\s+{_CAP})?{_TOWN}",
            rf"\b(?i:calle|avenida|avda\.|plaza|paseo|via|viale|piazza)\s+(?:(?:de|del|la|los|las|di)\s+)*{_CAP}(?:\s+{_CAP})?,?\s+(?:n\.?º?\s*)?\d{{1,4}}{_TOWN}",
            rf"\b[A-ZÄÖÜ][\wäöüß\-]*(?:weg|straße|strasse|str\.|gasse|allee|platz|ring|damm|ufer|chaussee)\s+\d{{1,4}}\s?[a-z]?\b{_TOWN}",
        ]
    )
)
ADDRESS_LOWER = re.compile(rf"\b\d{{1,5}}\s+(?:[a-z]+\s+){{1,2}}(?:street|road|lane|avenue|terrace|drive|close|crescent|boulevard)\b,?(?:\s+[a-z]+\s+\d{{4,6}})?|\b[A-Z]+(?:WEG|STRASSE|GASSE|ALLEE|PLATZ)\s+\d{{1,4}}\b", re.ASCII)

_NO_NAMES = (
    "doctor dr doc nurse team all sir madam everyone everybody friend friends colleague colleagues support staff clinic patient patients pharmacist there you your here please help thank thanks again hello hi dear regards "
    "what is does do can could how i my the this that a an if since since it in on at for with after before no yes not now emergency please reading ticket was were are we"
).split()
_NOT_NAME = r"(?!(?i:" + "|".join(sorted(set(_NO_NAMES), key=len, reverse=True)) + r")\b)"
_NAME_PART = rf"{_NOT_NAME}{_CAP}"
_NAME = rf"{_NAME_PART}(?:(?:\s+[A-Z]\.)*(?:\s+(?:de|del|van|von|der|den|da|dos|la|el|bin|al|ben|ter|di))*\s+{_NAME_PART}){{0,3}}"
_FULL = rf"{_NAME_PART}(?:(?:\s+[A-Z]\.)*(?:\s+(?:de|del|van|von|der|den|da|dos|la|el|bin|al|ben|ter|di))*\s+{_NAME_PART}){{1,3}}"
_KIN = r"son|daughter|wife|husband|mother|father|mum|mom|dad|brother|sister|partner|friend|neighbou?r|aunt|uncle|cousin|grandmother|grandfather|grandson|granddaughter|niece|nephew|child|boy|girl|carer|boss|colleague|flatmate|fianc[eé]e?"
_NOT_AFTER = r"(?!['’]s\s+(?:disease|syndrome|palsy|lymphoma|sign|test|thyroiditis|contracture))"
NAMES = [
    re.compile(rf"\b(?i:my (?:full )?name is|name is|name['’]?s|i am called|call me|named|name:|patient:|patient name:|contact:|client:|mein name ist|ich hei(?:ß|ss)e|me llamo|mi nombre es|je m['’]appelle|mon nom est)\s+({_NAME}){_NOT_AFTER}"),
    re.compile(rf"\b(?i:mr|mrs|ms|miss|mx|herr|frau|señora?|sra?|mme|monsieur|madame)\.?\s+({_NAME}){_NOT_AFTER}"),
    re.compile(rf"(?:\b|^)(?i:regards|signed|sincerely|yours|yours truly|best|best wishes|cheers|thank you|thanks|many thanks|dear|hello|hi|hey|greetings|from|cc|attn)(?:\s*[,:\-–—]\s*|\s+)(?i:(?:mr|mrs|ms|dr)\.?\s+)?({_FULL}){_NOT_AFTER}"),
    re.compile(rf"(?:\b|^)(?i:regards|signed|sincerely|yours|best wishes|dear|hello|hi|thank you),?\s+({_NAME_PART})(?=\s*[,.!;\n]|$){_NOT_AFTER}"),
    re.compile(rf"\b(?i:(?:my|our|his|her|their) (?:{_KIN})),?\s+({_NAME}){_NOT_AFTER}"),
    re.compile(rf"\b(?i:this is|i am|i['’]m|it is|speaking is|belongs to|on behalf of|ask for|care of)\s+({_FULL}){_NOT_AFTER}(?=\s*[,.;!?\n:]|\s+(?:and|here|from|speaking|with|who)\b|$)"),
    re.compile(rf"(?<!\w)({_FULL}){_NOT_AFTER}(?=\s+(?:here again|here\b|speaking\b|writing\b|calling\b))"),
]
_PERSON_VALUE = re.compile(rf"^\s*({_FULL})\s*$")
#: Under a name even a value in small letters is a name, unless it says that there is none.
_NO_PERSON = r"(?:not|no|none|given|prefers?|to|say|anonymous|unknown|withheld|declined|undisclosed|private|n|na|null|patient|user|guest|test|yes|same|as|above|unnamed|refused|rather)"
_LOWER_VALUE = re.compile(rf"^\s*((?!{_NO_PERSON}\b)[^\W\d_]{{2,}}(?:\s+[^\W\d_]\.)?(?:\s+(?!{_NO_PERSON}\b)[^\W\d_]{{2,}}(?:-[^\W\d_]+)*){{1,2}})\s*$", re.I)
_NUMBER_VALUE = re.compile(r"^\s*(\+?[\d(][\d\s().\-]{5,20}\d)\s*$")


#: Strings of which a text in small letters, with single blanks, also at both ends, holds one if the pattern can match.
_CUES = {
    ID_NUMBER: ("ssn", "social", "passp", "pasap", "reisep", "id", "licen", "insur", "polic", "member", "record", "mrn", "nhs", "health", "patient", "nino", "tax", "nie", "dni", "nummer", "num"),
    ADDRESS: ("box", "postfach", "apartado", "boîte", *(f" {x.lower()}" for x in _STREET.split("|")), "rue ", " av", " bd ", "chemin", "allée", "impasse", "quai ", "route ", "place ", "calle ", "avda.", "plaza ", "paseo ", "camino ", "via ", "viale ", "piazza ", "weg ", "straße ", "strasse ", "str. ", "gasse ", "allee ", "platz ", "ring ", "damm ", "ufer ", "chaussee "),
    ADDRESS_LOWER: ("street", "road", "lane", "avenue", "terrace", "drive", "close", "crescent", "boulevard", "weg", "strasse", "gasse", "allee", "platz"),
    CALLED: ("tel", "phone", "mobile", "cell", "fax", "call", "ring", "text", "whatsapp", "reach", "number is", "tél", "handy"),
    NAMES[0]: ("name", "called", "call me", "patient:", "contact:", "client:", "ich hei", "llamo", "nombre", "appelle", "nom est"),
    NAMES[1]: ("mr", "ms ", "ms.", "miss", "mx", "herr", "frau", "señor", "sra", "sr", "mme", "monsieur", "madame"),
    NAMES[2]: ("regards", "signed", "sincerely", "yours", "best", "cheers", "thank", "dear", "hello", "hi", "hey", "greetings", "from", "cc", "attn"),
    NAMES[3]: ("regards", "signed", "sincerely", "yours", "best wishes", "dear", "hello", "hi", "thank you"),
    NAMES[4]: ("my ", "our ", "his ", "her ", "their "),
    NAMES[5]: ("this is", "i am", "i'm", "i’m", "it is", "speaking is", "belongs to", "on behalf of", "ask for", "care of"),
    NAMES[6]: ("here", "speaking", "writing", "calling"),
}


@lru_cache(maxsize=1)
def _cue_finder():
    """What tells the patterns whose cues a text holds: their bits, in the order of _CUES."""
    bits: dict[str, int] = {}
    for n, cues in enumerate(_CUES.values()):
        for c in cues:
            bits[c] = bits.get(c, 0) | 1 << n
    try:
        import ahocorasick
    except ImportError:
        return lambda low: sum(1 << n for n, cues in enumerate(_CUES.values()) if any(c in low for c in cues))
    machine = ahocorasick.Automaton()
    for c, b in bits.items():
        machine.add_word(c, b)
    machine.make_automaton()

    def found(low: str) -> int:
        mask = 0
        for _, b in machine.iter(low):
            mask |= b
        return mask

    return found


_BIT = {rx: 1 << n for n, rx in enumerate(_CUES)}
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d.*\d.*\d", re.S)
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]")
_SPOKEN_AT = re.compile(r"(?i)[(\[{<]at[)\]}>]| dot ")


def find_entities(text: str | None, key: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order, without overlap.

    ``key`` is what a fact is filed under; under ``name`` a value that is just a name needs no context.
    """
    if not text:
        return []
    digit, capital = _DIGIT.search(text) is not None, _CAPITAL.search(text) is not None
    if not (key or digit or capital or "@" in text or "＠" in text or " at " in text or " dot " in text):
        return []
    cues, found = _cue_finder()(f" {' '.join(text.lower().split())} "), []

    def add(start: int, end: int, kind: str) -> None:
        while end > start and text[end - 1] in " \t\n.,;:":
            end -= 1
        if end > start and not any(s < end and start < e for s, e, _ in found):
            found.append((start, end, kind))

    def matches(rx: re.Pattern):
        return rx.finditer(text) if cues & _BIT[rx] else ()

    def long(number: str, least: int) -> bool:
        return least <= sum(c.isdigit() for c in number) <= 15

    if "@" in text or "＠" in text or _SPOKEN_AT.search(text):
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if digit:
        many = _DIGITS.search(text) is not None
        if many:
            for m in matches(ID_NUMBER):
                if sum(c.isdigit() for c in m[1]) >= 4:
                    add(m.start(1), m.end(1), "id_number")
            if "-" in text:
                for m in BARE_SSN.finditer(text):
                    add(m.start(), m.end(), "id_number")
        for rx in (ADDRESS, ADDRESS_LOWER):
            for m in matches(rx):
                add(m.start(), m.end(), "address")
        if many:
            for m in PHONE.finditer(text):
                if long(m[0], 7):
                    add(m.start(), m.end(), "phone")
            for m in matches(CALLED):
                if long(m[1], 7):
                    add(m.start(1), m.end(1), "phone")
    if capital:
        for rx in NAMES:
            for m in matches(rx):
                add(m.start(1), m.end(1), "name")
    filed = (key or "").strip().lower()
    if filed in ("name", "full_name", "full name", "patient_name") and (m := _PERSON_VALUE.match(text) or _LOWER_VALUE.match(text)):
        add(m.start(1), m.end(1), "name")
    if filed in ("contact", "phone", "mobile", "telephone", "tel") and (m := _NUMBER_VALUE.match(text)) and long(m[1], 7):
        add(m.start(1), m.end(1), "phone")
    return sorted(found)


# Consonants, vowels, the vowels that mark a word with accents, and the endings of women's and other names.
SOUNDS = {
    "latin": ("bdfgklmnprstvz", "aeiou", "áéíóú", ("a", "ia", "ea", "ua"), ("n", "r", "s", "l")),
    "greek": ("βδφγκλμνπρστζξ", "αειου", "άέίόύ", ("α", "ια", "εα", "υα"), ("ν", "ρ", "ς", "λ")),
    "cyrillic": ("бдфгклмнпрствз", "аеиоу", "яёїюэ", ("а", "иа", "еа", "уа"), ("н", "р", "с", "л")),
}
PARTICLES = frozenset("de del des du la le les el los las di della da dos van von der den bin al ben ter y und".split())
_FEMALE_END = re.compile(r"[aáàеаяηα]$", re.I)
DRAWS = 4


def _keyed(key: bytes, bits: int, *parts: str) -> int:
    """``bits`` pseudorandom bits of the parts under a key."""
    h = hashlib.shake_256(len(key).to_bytes(4, "big") + key + "\x1f".join(parts).encode("utf-8", "surrogatepass"))
    return int.from_bytes(h.digest((bits + 7) // 8), "big") & ((1 << bits) - 1)


def _feistel(n: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of 0 .. size - 1 (a balanced network with cycle walking)."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = n >> half, n & mask
        for r in range(6):
            left, right = right, left ^ _keyed(key, half, label, str(r), str(right))
        n = (left << half) | right
        if n < size:
            return n


@lru_cache(maxsize=1024)
def _small_letters(block: int) -> str:
    """The small letters among 256 code points, those without case included."""
    return "".join(c for c in map(chr, range(block << 8, (block + 1) << 8)) if c.isalpha() and c.lower() == c and len(c.upper()) == 1)


@lru_cache(maxsize=65536)
def _kind(c: str) -> tuple[str, str] | None:
    """(name, alphabet) of what may stand for a character; None if it stays."""
    if c.isascii():
        return ("9", "0123456789") if c.isdigit() else ("a", "abcdefghijklmnopqrstuvwxyz") if c.isalpha() else None
    if c.isdigit() and len(c) == 1 and unicodedata.category(c) == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return f"9{zero:x}", "".join(map(chr, range(zero, zero + 10)))
    low = c.lower()
    if len(low) == 1 and low in (letters := _small_letters(ord(low) >> 8)):
        return f"a{ord(low) >> 8:x}", letters
    return ("ss", "ßŉǰΐΰ") if c in "ßŉǰΐΰ" else None


def scrambled(text: str, key: bytes, kind: str, keep: int = 0) -> str:
    """The characters of a number or a word permuted within their alphabets, but for the first ``keep`` of them.

    Format and case are kept, and distinct inputs stay distinct. Marks between the characters don't count, so one
    number written in two ways has one surrogate in those two ways.
    """
    places = [(i, k) for i, k in enumerate(map(_kind, text)) if k][keep:]
    n, size = 0, 1
    for i, (_, letters) in places:
        n, size = n * len(letters) + letters.index(text[i].lower() if text[i].lower() in letters else text[i]), size * len(letters)
    if not places:
        return text
    n = _feistel(n, size, key, "\x1f".join([kind, *(name for _, (name, _) in places)]))
    out = list(text)
    for i, (_, letters) in reversed(places):
        n, x = divmod(n, len(letters))
        out[i] = letters[x].upper() if text[i].isupper() else letters[x]
    return "".join(out)


@lru_cache(maxsize=8)
def _alphabets(script: str) -> list[str]:
    """Alphabets of a script, each holding the one before."""
    if script == "latin":
        ascii_ = "abcdefghijklmnopqrstuvwxyz"
        western = ascii_ + _small_letters(0).replace(ascii_, "") + "ß"
        return [ascii_, western, western + _small_letters(1) + _small_letters(2) + "ŉǰ"]
    return [_small_letters(3) + "ΐΰ"] if script == "greek" else ["абвгдежзийклмнопрстуфхцчшщъыьэюяё", _small_letters(4)]


def _script(word: str) -> str | None:
    blocks = {ord(c) >> 8 for c in word}
    return "latin" if blocks <= {0, 1, 2} else "greek" if blocks <= {3} else "cyrillic" if blocks <= {4} else None


@lru_cache(maxsize=200_000)
def name_word(word: str, key: bytes, draw: int = 0) -> str:
    """The surrogate, in small letters, of one word of a name: pronounceable, of its script and gender.

    The word is numbered among all strings of its length, the number permuted by the key and spelled in syllables, so
    two words never share a surrogate and its length is bounded by that of the word. ``draw`` chooses another one.
    """
    low = unicodedata.normalize("NFC", word.lower())
    script = _script(low)
    level = next((i for i, letters in enumerate(_alphabets(script)) if all(c in letters for c in low)), None) if script and len(low) > 1 else None
    if level is None:
        return scrambled(low, key, f"word{draw}")
    consonants, vowels, marked, female, other = SOUNDS[script]
    alphabet = _alphabets(script)[level]
    base, n = len(alphabet), 0
    for c in low:
        n = n * base + alphabet.index(c)
    n = _feistel(n, base ** len(low), key, f"name\x1f{script}\x1f{level}\x1f{len(low)}\x1f{draw}") + sum(base**k for k in range(1, len(low))) + 1
    syllables = []
    while n > 0:
        n, x = divmod(n - 1, len(consonants) * len(vowels))
        syllables.append(consonants[x // len(vowels)] + vowels[x % len(vowels)])
    if level > len(syllables):
        return scrambled(low, key, f"word{draw}")
    accented = [x[0] + marked[vowels.index(x[1])] for x in syllables[:level]]  # so words of different alphabets stay apart
    return "".join([*accented, *syllables[level:], (female if _FEMALE_END.search(low) else other)[draw % DRAWS]])


def _cased(new: str, like: str) -> str:
    return new.upper() if len(like) > 1 and like.isupper() else new.capitalize() if like[:1].isupper() else new


_NAME_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[^\W\d_]+|\d+")
_STREET_WORD = re.compile(rf"(?:{_STREET}|P\.?O|Box|Post(?:al|fach)?|Office|Flat|Apt|Apartment|Unit|Suite|Room|No|Rue|Av|Bd|Chemin|Allée|Impasse|Route|Calle|Avenida|Avda|Plaza|Paseo|Camino|Via|Viale|Piazza|Apartado|Correos|Boîte|Postale|Bis|In)", re.I)
_STREET_END = re.compile(r"(.+?)(weg|straße|strasse|str|gasse|allee|platz|ring|damm|ufer|chaussee)", re.I)


def surrogate(text: str, kind: str, key: bytes, draws: dict[str, int] | None = None) -> str:
    """The surrogate of one entity; ``draws`` has the words whose first surrogate is a name of the corpus.

    Letters and digits change within their script, marks stay. Names and the letters of e-mail addresses go through the
    same words, so a person's address still resembles the name. E-mail domains stay apart and end in a reserved one.
    Streets keep their kind, phone numbers their first digit.
    """
    draws = draws or {}

    def word(w: str) -> str:
        low = w.lower()
        return w if low in PARTICLES else _cased(name_word(low, key, draws.get(low, 0)), w)

    def run(w: str) -> str:
        return scrambled(w, key, kind) if w[0].isdigit() else word(w)

    if kind == "name":
        return _NAME_WORD.sub(lambda m: word(m[0]), text)
    if kind == "email":
        parts = re.split(rf"({_AT}|\s+at\s+)", text, maxsplit=1, flags=re.I)
        user, sep, domain = parts if len(parts) == 3 else (text, "@", "")
        labels = re.split(rf"({_DOT}|\s+dot\s+)", domain, flags=re.I)
        spelled = "".join(x if i % 2 or i == len(labels) - 1 else _RUN.sub(lambda m: run(m[0]), x) for i, x in enumerate(labels))
        return _RUN.sub(lambda m: run(m[0]), user) + sep + spelled + (labels[-2] if len(labels) > 1 else ".") + "example"
    if kind == "address":

        def part(m: re.Match) -> str:
            w = m[0]
            if w in ("P", "O", "p", "o") or _STREET_WORD.fullmatch(w):
                return w
            if w[0].isdigit() or len(w) == 1:
                return scrambled(w, key, kind)
            end = _STREET_END.fullmatch(w)
            return word(end[1]) + end[2] if end else word(w)

        return _RUN.sub(part, text)
    return scrambled(text, key, kind, keep=1 if kind == "phone" else 0)


ENTITIES = "array<struct<start:int,end:int,type:string,text:string,surrogate:string>>"


def with_entities(texts: DataFrame, key: str | None = None) -> DataFrame:
    """src, rec_id, text, entities of each row of ``texts(src, rec_id, fact_key, text)``. Null texts have none.

    With a ``key`` every entity has its surrogate. Equal texts of a batch are read once.
    """
    secret = None if key is None else key.encode()

    def of(text: str, filed: str | None) -> list[tuple]:
        return [(s, e, k, text[s:e], None if secret is None else surrogate(text[s:e], k, secret)) for s, e, k in find_entities(text, filed)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict = {}
            found = []
            for t, f in zip(pdf["text"], pdf["fact_key"], strict=True):
                if not isinstance(t, str):
                    found.append([])
                    continue
                if (t, f) not in known:
                    known[t, f] = of(t, f if isinstance(f, str) else None)
                found.append(known[t, f])
            yield pdf[["src", "rec_id", "text"]].assign(entities=found)

    return texts.select("src", "rec_id", "fact_key", "text").mapInPandas(run, f"src string, rec_id long, text string, entities {ENTITIES}")


def texts_of(messages: DataFrame, facts: DataFrame) -> DataFrame:
    """src, rec_id, fact_key, text of both tables; rows without an id are left out."""
    a = messages.select(F.lit("messages").alias("src"), F.col("id").alias("rec_id"), F.lit(None).cast("string").alias("fact_key"), F.col("content").alias("text"))
    b = facts.select(F.lit("user_facts").alias("src"), F.col("id").alias("rec_id"), "fact_key", F.col("fact_value").alias("text"))
    return a.unionByName(b).where("rec_id is not null")


def pii_found(texts: DataFrame, key: str | None = None) -> DataFrame:
    """src, rec_id, pii_type: one row for each record and type of which something in it is replaced by a surrogate.

    Without a ``key`` a new one is drawn; which rows come out doesn't depend on it.
    """
    replaced = F.filter("entities", lambda e: e["surrogate"].isNotNull())
    return with_entities(texts.where("text is not null"), key or secrets.token_hex(16)).select("src", "rec_id", F.explode(F.array_distinct(F.transform(replaced, lambda e: e["type"]))).alias("pii_type"))


def redacted(texts: DataFrame) -> DataFrame:
    """src, rec_id, text with each entity replaced by its type in brackets; all else, nulls included, unchanged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["src", "rec_id"]].assign(text=[_replaced(t, [(s, e, f"[{k.upper()}]") for s, e, k in find_entities(t, f if isinstance(f, str) else None)]) if isinstance(t, str) else None for t, f in zip(pdf["text"], pdf["fact_key"], strict=True)])

    return texts.select("src", "rec_id", "fact_key", "text").mapInPandas(run, "src string, rec_id long, text string")


def _replaced(text: str, parts: list[tuple[int, int, str]]) -> str:
    for start, end, new in sorted(parts, reverse=True):
        text = text[:start] + new + text[end:]
    return text


def _words(entities: DataFrame) -> DataFrame:
    """src, rec_id, word of the words that name surrogates are made of."""
    worded = F.filter("entities", lambda e: e["type"].isin("name", "email", "address"))
    return entities.select("src", "rec_id", F.explode(worded).alias("e")).select("src", "rec_id", F.explode(F.regexp_extract_all(F.lower("e.text"), F.lit(r"(\p{L}{2,})"), 1)).alias("word"))


def redraws(entities: DataFrame, key: str) -> DataFrame:
    """word, draw of the words whose first surrogate is itself such a word of the corpus: their first draw that isn't."""
    secret = key.encode()
    real = _words(entities).select("word").distinct()

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, d, name_word(w, secret, d)) for w, first in zip(pdf["word"], pdf["first"], strict=True) for d in range(first, DRAWS if first else 1)]
            yield pd.DataFrame(rows, columns=["word", "draw", "drawn"])

    draw = lambda words, first: words.withColumn("first", F.lit(first)).mapInPandas(drawn, "word string, draw int, drawn string")
    clash = draw(real, 0).join(real.withColumnRenamed("word", "drawn"), "drawn", "left_semi").select("word")
    free = draw(clash, 1).join(real.withColumnRenamed("word", "drawn"), "drawn", "left_anti")
    return free.groupBy("word").agg(F.min("draw").alias("draw"))


def with_surrogates(texts: DataFrame, key: str) -> DataFrame:
    """src, rec_id, text with each entity replaced by its surrogate under ``key``; the same entity keeps one surrogate.

    Only words whose surrogate is a word of a name in the corpus need another one, so few records are joined with draws.
    Records with a null text are left out.
    """
    secret = key.encode()
    found = cut(with_entities(texts.where("text is not null"), key))
    again = _words(found).distinct().join(redraws(found, key), "word").groupBy("src", "rec_id").agg(F.collect_list(F.struct("word", "draw")).alias("draws"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, entities, draws in zip(pdf["text"], pdf["entities"], pdf["draws"], strict=True):
                other = {} if draws is None else {d["word"]: d["draw"] for d in draws}
                out.append(_replaced(text, [(e["start"], e["end"], surrogate(e["text"], e["type"], secret, other) if other else e["surrogate"]) for e in entities]))
            yield pdf[["src", "rec_id"]].assign(text=out)

    return found.join(again, ["src", "rec_id"], "left").mapInPandas(run, "src string, rec_id long, text string")
