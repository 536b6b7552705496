"""Keyed surrogates for personal data that keep type, format, script and gender.

Detected entities are replaced within their own format's domain: digits stay digits, letters stay
letters of their alphabet and case, card numbers keep their issuer digit and check rule and IBANs
theirs, addresses stay in their private block or public, given names move within the list of their
gender and script, and a known surname within its list; other names keep their length, script and
last letter. In each domain a keyed permutation puts all values on one cycle, and each is replaced
by the next: no two share a surrogate and none keeps its own, and the same entity has the same one
in every document, so mentions stay coreferent. A person is found by a known given name before a
capitalised word, a known surname after one, a title or a cue, or an e-mail address of the same
words; then each mention of the name's words in the document is replaced.

A corpus-wide check then looks for surrogates that are entities of the corpus themselves. Those are
drawn again under other keys, TWEAKS times, and take a draw that nobody has; in a domain so full that
no draw is free they keep their first, which is nobody else's either. These exceptions are a table;
the rewriting pass gets them by broadcast where they are counted to be few, else by a join.
"""

from __future__ import annotations

import hmac
import math
import re
import secrets
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, fresh, slices, stash

#: Where the query finds its key, as text; without one it draws a key for this call.
KEY_SETTING = "spark.chronoloom.surrogate.key"
TWEAKS = 8
#: Exceptions up to which they are broadcast.
EXCEPTIONS = 100_000

#: Given names by script and gender, surnames by script and form.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Camille Carmen Charlotte Clara Elena Emma Eva Greta Hannah Ines Julia Laura Linda Lucia Maria Marie Mary Nina Olivia Paula Rosa Sarah Sofia Susan Teresa Ursula Vera".split(),
    ("latin", "m"): "Adam Albert Andreas Antonio Carlos Charles Daniel David Diego Felix Frank George Hans Henri Hugo Jack James John Jorge Karl Louis Lucas Marco Martin Michael Oscar Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    ("greek", "f"): "Αθηνά Άννα Ειρήνη Ελένη Ζωή Θάλεια Κατερίνα Μαρία Σοφία Χλόη".split(),
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Σταύρος Χρήστος".split(),
}
SURNAMES = {
    ("latin", ""): "Adler Baker Becker Bernard Carter Castillo Dubois Fischer Garcia Hoffmann Jackson Keller Lambert Lopez Martinez Meyer Moreau Morgan Parker Petit Richter Robinson Romero Schmidt Smith Thompson Turner Vidal Wagner Weber".split(),
    ("cyrillic", "f"): "Белова Волкова Иванова Козлова Кузнецова Новикова Орлова Петрова Смирнова Соколова".split(),
    ("cyrillic", "m"): "Белов Волков Иванов Козлов Кузнецов Новиков Орлов Петров Смирнов Соколов".split(),
    ("greek", ""): "Αγγέλου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Νικολάου Οικονόμου Παπαδάκης Παππάς Χατζής".split(),
}
_GIVEN = {n: k for k, names in GIVEN.items() for n in names}
_SURNAME = {n: k for k, names in SURNAMES.items() for n in names}

#: Alternatives in order of precedence; each group's name is the entity's type.
PATTERN = re.compile(
    r"(?P<email>\b[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b)"
    r"|(?P<password>(?<=password=)[^\s,;]+|(?<=passwd=)[^\s,;]+)"
    r"|(?P<access_key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?P<token>\b(?:ghp_|gho_|sk-|xoxb-)[A-Za-z0-9-]{10,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))"
    r"|(?P<phone>(?<![\w])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
)
#: The end of a name that says secret, looked for only where a text holds one of _SAYS; and what is assigned to it, quoted or not.
_SAYS = ("token", "secret", "passw", "pwd", "key", "credential", "bearer")
_SECRET_NAME = re.compile(r"(?i)token|secret|passwo?r?d|pwd|(?:api|access|private|auth)[_-]?key|credentials?|bearer")
_ASSIGNED = re.compile(r"[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}(?P<quote>[\"'])?(?P<value>(?(quote)[^\s\"']+|[^\s\"',;<>(){}]+))")
_CREDENTIAL = re.compile(r"\s{1,3}(?P<value>[^\s\"',;<>(){}]+)")
#: An assigned value that is no word: its length, and either a password's context or bits of entropy a character.
_SECRET_LENGTH, _SECRET_BITS = 8, 2.5
_HINT = re.compile(r"[@+]|\d[ .-]?\d[ .-]?\d|password=|passwd=|A[KS]IA|ghp_|gho_|sk-|xoxb-|\d{1,3}\.\d{1,3}\.")
_CAPITAL = "[A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ]"
#: Two capitalised words in a row; the first is then looked up among the given names.
_NAMES = re.compile(rf"\b({_CAPITAL}\w+)(?= ({_CAPITAL}\w*(?:-\w+)?)\b)")
_COUPLES = re.compile(rf"\b(?=({_CAPITAL}\w+ {_CAPITAL}\w+)\b)")
#: What stands before a word inside a sentence.
_INSIDE = re.compile(r"[\w,;)] $")
#: A word of a name; its first letter's case is looked at afterwards.
_NAME = r"[^\W\d_]\w*(?:-\w+|['’](?=[^\W\d_]{2})\w+)*"
_WORD, _PART = re.compile(_NAME), re.compile(r"\w+")
_TITLES = {
    "m": "Mr Sir Herr Herrn Monsieur Señor Signor Don г-н Г-н господин Господин κύριος Κύριος κύριο".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Signora Doña г-жа Г-жа госпожа Госпожа κα κυρία Κυρία".split(),
    "": "Dr Prof Professor Doctor доктор Доктор профессор Профессор δρ Δρ".split(),
}
_CUES = "[Mm]y name is|[Nn]amed|[Nn]ame:|[Dd]ear|[Pp]atient|[Ss]igned(?: by|,)|[Cc]ontact:|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i chiamo|[Мм]еня зовут|[Μμ]ε λένε"
#: A title or a cue, and up to three words with initials between them, of any spelling.
_CALLED = re.compile(rf"(?<!\w)(?:(?P<title>(?:(?:{'|'.join(t for k in _TITLES.values() for t in k)})\.? )+)|(?:{_CUES}) )(?=(?P<words>{_NAME}\.?(?: {_NAME}\.?){{0,2}}))")
_EVERY_TITLE = {t for k in _TITLES.values() for t in k}
#: Capitalised words that begin sentences or follow a cue without being names.
_NOT_NAMES = set("A About After All Also An And Any Are As At Be Because Before But By Can Colleague Colleagues Customer Did Do Does Editor For Friend Friends From Had Has Have He Her Here His How I If In Is It Its Madam May My No Not Now Of On Or Our Please Reader Readers She Sir So Some Team That The Their Then There These They This Those To Under Was We Were What When Where Which Who Why Will With You Your Der Die Das Ein Eine Und El La Los Las Le Les Un Une И В На Он Она Это Και Ο Η Το".split()) | _EVERY_TITLE
_ALPHABETS = ["àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "άέήίόύώ", "ΆΈΉΊΌΎΏ", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_SIGNS = "!#$%&()*+-./:<=>?@[]^_{|}~"
_ALPHABET = {c: a for a in _ALPHABETS for c in a}


def _mixed_up(n: int, x: int, key: bytes, label: str, back: bool) -> int:
    """A keyed permutation of 0 to n - 1 at x or its inverse: an unbalanced Feistel network, walked until it stays inside."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, a)
        for r in reversed(range(8)) if back else range(8):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * _prf(key, label, r, n, left)) % a
            else:
                left = (left + sign * _prf(key, label, r, n, right)) % b
        x = left * a + right
        if x < n:
            return x


def permute(n: int, x: int, key: bytes, label: str) -> int:
    """The next of x on a keyed cycle through all of 0 to n - 1: x itself only where there is no other."""
    if n <= 1:
        return x
    return _mixed_up(n, (_mixed_up(n, x, key, label, False) + 1) % n, key, label, True)


def _prf(key: bytes, label: str, *parts: int) -> int:
    return int.from_bytes(hmac.digest(key, "/".join([label, *map(str, parts)]).encode(), "sha256")[:16], "big")


def _alphabet(c: str) -> str | None:
    """The letters that c may become: a listed alphabet, or the letters of its case in its block of 64 code points."""
    if c in _ALPHABET or not c.isalpha():
        return _ALPHABET.get(c)
    block = ord(c) & ~63
    got = "".join(d for d in map(chr, range(block, block + 64)) if d.isalpha() and d not in _ALPHABET and (d.isupper(), d.islower()) == (c.isupper(), c.islower()))
    return _ALPHABET.setdefault(c, got)


def _cipher(text: str, key: bytes, label: str, sets: list[str | None] | None = None) -> str:
    """The next text of the same pattern; characters without an alphabet stay. sets: each place's alphabet."""
    sets = sets if sets is not None else [_alphabet(c) for c in text]
    if len([s for s in sets if s]) > 24:  # long texts in halves that depend on each other
        cut = len(text) // 2
        head = _cipher(text[:cut], key, label, sets[:cut])
        return head + _cipher(text[cut:], key, f"{label}|{head}", sets[cut:])
    x, size = 0, 1
    for c, s in zip(text, sets):
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    n = permute(size, x, key, f"{label}:{len(text)}:{''.join(s[0] + str(len(s)) + ',' if s else c for c, s in zip(text, sets))}")
    out = []
    for c, s in zip(reversed(text), reversed(sets)):
        if s:
            n, k = divmod(n, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def _walk(text: str, step, good) -> str:
    while True:
        text = step(text)
        if good(text):
            return text


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits))) % 10


def _fill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


#: First address and size of each block that is not public, fixed by the address registries.
_BLOCKS = [(0, 1 << 24), (10 << 24, 1 << 24), (127 << 24, 1 << 24), (169 << 24 | 254 << 16, 1 << 16), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16), (224 << 24, 1 << 29)]


def _address(x: int, key: bytes, label: str) -> int:
    """Another address of the same block, or another public one."""
    below = 0
    for first, size in _BLOCKS:
        if first <= x < first + size:
            return first + permute(size, x - first, key, f"{label}/{first}")
        below += size if first < x else 0
    x = permute((1 << 32) - sum(size for _, size in _BLOCKS), x - below, key, label)
    for first, size in _BLOCKS:
        x += size if x >= first else 0
    return x


def _check_digits(country: str, rest: str) -> int:
    """The two check digits of an IBAN as a number."""
    return 98 - int("".join(str(int(c, 36)) for c in rest + country) + "00") % 97


def norm(kind: str, text: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "phone", "ssn"):
        digits = "".join(c for c in text if c.isdigit())
        # a number of the North American plan is the same with its country code and without
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return text.replace(" ", "")
    return text


def surrogate(kind: str, name: str, key: bytes, tweak: int = 0) -> str:
    """The normal form's image; name is a normal form."""
    label = f"{kind}#{tweak}"
    if kind == "email":
        local, _, domain = name.partition("@")
        host, _, top = domain.rpartition(".")
        sub = host.removesuffix("example")
        if sub == host:
            domain = _walk(host, lambda t: _cipher(t, key, label + "d"), lambda t: not t.endswith("example")) + f".{top}"
        else:
            domain = f"{_cipher(sub, key, label + 'd')}example.{top}"
        return f"{_cipher(local, key, label)}@{domain}"
    if kind == "card":
        delta = (int(name[-1]) + _luhn(name[:-1])) % 10
        body = name[0] + _cipher(name[1:-1], key, label + name[0])
        return body + str((delta - _luhn(body)) % 10)
    if kind == "phone":
        keep = max(1, len(name) - 10) if len(name) > 10 else 0
        head, rest = name[:keep], name[keep:]
        sets = ["23456789" if rest[0] in "23456789" else "01", *["0123456789"] * (len(rest) - 1)]
        return head + _cipher(rest, key, label + head, sets)
    if kind == "ip":
        x = int.from_bytes(bytes(int(o) for o in name.split(".")), "big")
        return ".".join(map(str, _address(x, key, label).to_bytes(4, "big")))
    if kind == "iban":
        country, off, rest = name[:2], int(name[2:4]) - _check_digits(name[:2], name[4:]), name[4:]
        rest = _cipher(rest, key, label + country)
        return f"{country}{(_check_digits(country, rest) + off) % 100:02}{rest}"
    if kind == "access_key":
        return name[:4] + _mixed(name[4:], key, label + name[:4])
    if kind == "token":
        cut = name.index("_") + 1 if "_" in name[:4] else name.index("-") + 1
        return name[:cut] + _cipher(name[cut:], key, label)
    if kind == "given" and name in _GIVEN:
        names = GIVEN[_GIVEN[name]]
        return names[permute(len(names), names.index(name), key, f"{label}{_GIVEN[name]}")]
    if kind == "surname":
        if name in _SURNAME:
            names = SURNAMES[_SURNAME[name]]
            return names[permute(len(names), names.index(name), key, f"{label}{_SURNAME[name]}")]
    if kind in ("given", "surname"):
        # the last letter stays in longer names: it often tells the gender
        known, end = (_GIVEN, _SURNAME)[kind == "surname"], name[-1] if len(name) > 3 else ""
        return _walk(name, lambda t: _cipher(t[: len(t) - len(end)], key, label + end) + end, lambda t: t not in known)
    if kind == "password" and re.fullmatch(r"[0-9a-f]{4,64}", name) and not name.isdigit():
        return _walk(name, lambda t: _mixed(t, key, label, "0123456789abcdef"), lambda t: not t.isdigit())
    if kind == "password":
        return _cipher(name, key, label, [_SIGNS if c in _SIGNS else _alphabet(c) for c in name])
    return _cipher(name, key, label)


def _mixed(text: str, key: bytes, label: str, abc: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") -> str:
    """All places of text over one alphabet."""
    x = 0
    for c in text:
        x = x * len(abc) + abc.index(c)
    x = permute(len(abc) ** len(text), x, key, f"{label}:{len(abc)}^{len(text)}")
    out = []
    for _ in text:
        x, k = divmod(x, len(abc))
        out.append(abc[k])
    return "".join(reversed(out))


def restore(kind: str, text: str, image: str) -> str:
    """image in the format of the mention text."""
    if kind in ("card", "phone", "ssn"):
        digits = "".join(c for c in text if c.isdigit())
        return _fill(text, digits[: len(digits) - len(image)] + image)
    if kind == "iban":
        it = iter(image)
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "email":
        if text.isupper():
            return image.upper()
        head = "".join(b.upper() if a.isupper() else b for a, b in zip(text, image))
        return head + image[len(head) :]
    return image


def mentions(text: str, given: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of each entity, in order, not overlapping. given: further given names."""
    out, names_out = [], []
    if _HINT.search(text):
        for m in PATTERN.finditer(text):
            kind = m.lastgroup
            digits = norm(kind, m.group())
            if kind == "card" and (digits[0] not in "3456" or _luhn_odd(digits)):
                continue
            if kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind, digits))
    out = _with_secrets(text, out)
    names = _names(text, given, [n for *_, k, n in out if k == "email"])
    if names:
        starts = [a for a, *_ in out]
        for m in _WORD.finditer(text):
            # a part of a compound counts where the whole is no name
            for a, b in [m.span()] if m.group() in names else [w.span() for w in _PART.finditer(text, *m.span())]:
                k = bisect_left(starts, b)
                if text[a:b] in names and not (k and out[k - 1][1] > a):
                    names_out.append((a, b, names[text[a:b]], text[a:b]))
    return sorted(out + names_out)


def _is_secret(value: str) -> bool:
    """Whether an assigned value looks drawn rather than written: long enough, of mixed kinds or hexadecimal, and its characters spread out."""
    if len(value) < _SECRET_LENGTH or value.isalpha() and (value.islower() or value.istitle()):
        return False
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in (value.count(c) for c in set(value)))
    return bits >= _SECRET_BITS and (any(c.isdigit() for c in value) or any(c.isupper() for c in value) and any(c.islower() for c in value))


def _with_secrets(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found and the values assigned to names of secrets, where no other entity lies."""
    lower = text.lower()
    if not any(word in lower for word in _SAYS):
        return found
    more, k = [], 0
    for name in _SECRET_NAME.finditer(text):
        m = (_CREDENTIAL if name.group().lower() == "bearer" else _ASSIGNED).match(text, name.end())
        if not m:
            continue
        a, b = m.span("value")
        while b > a and text[b - 1] in ".,;:!?":
            b -= 1
        while k < len(found) and found[k][1] <= a:
            k += 1
        if _is_secret(text[a:b]) and not (k < len(found) and found[k][0] < b):
            more.append((a, b, "password", text[a:b]))
    return sorted(found + more) if more else found


def _names(text: str, known: frozenset[str], emails: list[str]) -> dict[str, str]:
    """The words of persons' names in text, each given or surname; every mention of them counts, also a single one."""
    names = {}
    lower, couples = None, None  # the text's words, its pairs of capitalised words: collected once, and only if asked for
    for m in _NAMES.finditer(text):
        given, last = m.groups()
        if last in _NOT_NAMES or len(last) < 2 or last.isupper():
            continue
        if given in _GIVEN or given in known:
            names.setdefault(given, "given")
            names.setdefault(last, "given" if last in _GIVEN or last in known else "surname")
        # a known surname: the word before it is a name too, unless it begins a sentence or the text has it in lower case
        elif last in _SURNAME and given not in _NOT_NAMES and not given.isupper() and _INSIDE.search(text, max(0, m.start() - 3), m.start()):
            lower = set(_PART.findall(text)) if lower is None else lower
            if given.lower() not in lower:
                names.setdefault(given, "given")
                names.setdefault(last, "surname")
    for m in _CALLED.finditer(text):
        words = []
        for w in m["words"].split(" "):
            if not w[0].isupper() or w.rstrip(".") in _NOT_NAMES:
                break
            words.append(w.rstrip("."))
            if w[-1] == "." and len(w) > 2:
                break
        for k, w in enumerate(words):
            alone = "surname" if m["title"] and w not in _GIVEN and w not in known else "given"
            if len(w) > 1:
                names.setdefault(w, alone if len(words) == 1 else "surname" if k == len(words) - 1 else "given")
    for mail in emails:  # john.doe@... names John Doe where the text has these words together
        parts = [p.capitalize() for p in re.split(r"[^a-z]+", mail.partition("@")[0]) if len(p) > 2]
        if len(parts) != 2:
            continue
        couples = set(_COUPLES.findall(text)) if couples is None else couples
        if " ".join(parts) in couples:
            names.setdefault(parts[0], "given")
            names.setdefault(parts[1], "surname")
    return names


def _luhn_odd(digits: str) -> bool:
    """Whether a number fails the card check rule."""
    return (int(digits[-1]) + _luhn(digits[:-1])) % 10 != 0


class Rewriter:
    def __init__(self, key: bytes, given: frozenset[str]):
        self.key, self.given = key, given
        self.known: dict[tuple[str, str, int], str] = {}

    def image(self, kind: str, name: str, tweak: int) -> str:
        got = self.known.get((kind, name, tweak))
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[kind, name, tweak] = surrogate(kind, name, self.key, tweak)
        return got

    def rewrite(self, text: str, exceptions: dict[tuple[str, str], int]) -> tuple[str, int]:
        found = mentions(text, self.given)
        if not found:
            return text, 0
        parts, at = [], 0
        for a, b, kind, name in found:
            parts += [text[at:a], restore(kind, text[a:b], self.image(kind, name, exceptions.get((kind, name), 0)))]
            at = b
        return "".join([*parts, text[at:]]), len(found)


def _strings(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(len(names))], names)


def _extract(key: bytes, given: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(k, n) for part in slices([batch]) for t in part.column("text").to_pylist() if t for _, _, k, n in mentions(t, given)}
            yield _strings([(k, n, surrogate(k, n, key)) for k, n in sorted(seen)], ["kind", "name", "image"])

    return run


def _mentioned(given: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = sorted({(h, k, n) for h, t in zip(batch.column("th").to_pylist(), batch.column("text").to_pylist()) if t for _, _, k, n in mentions(t, given)})
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *_strings([r[1:] for r in rows], ["kind", "name"]).columns], ["th", "kind", "name"])

    return run


def _again(key: bytes, tweak: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("kind").to_pylist(), batch.column("name").to_pylist()))
            yield _strings([(k, n, surrogate(k, n, key, tweak)) for k, n in rows], ["kind", "name", "image"])

    return run


def assign(docs: DataFrame, key: bytes, given: frozenset[str] = frozenset()) -> DataFrame:
    """(kind, name, tweak, image) of each distinct entity of docs (text): images differ from each
    other and from their names, and from all names as far as the domains have room; persons' names
    come from lists, so there another person's name is no collision."""
    table = docs.select("text").mapInArrow(_extract(key, given), "kind string, name string, image string").distinct()
    table = stash(table, "entities")
    names = table.select("kind", F.col("name").alias("image"))
    held = table.select("kind", "image").unionByName(names)
    left = table.where(~F.col("kind").isin("given", "surname")).join(names, ["kind", "image"], "left_semi").select("kind", "name")
    left = stash(left, "collisions")
    found = []
    for tweak in range(1, TWEAKS + 1):
        if not left.limit(1).count():
            break
        drawn = left.mapInArrow(_again(key, tweak), "kind string, name string, image string")
        free = drawn.join(held, ["kind", "image"], "left_anti").groupBy("kind", "image").agg(F.min("name").alias("name"))
        free = stash(free.select("kind", "name", F.lit(tweak).alias("tweak"), F.col("image").alias("drawn")), "drawn")
        found.append(free)
        held = held.unionByName(free.select("kind", F.col("drawn").alias("image")))
        left = stash(left.join(free, ["kind", "name"], "left_anti"), "collisions")
    if not found:
        return table.select("kind", "name", F.lit(0).alias("tweak"), "image")
    moved = found[0]
    for more in found[1:]:
        moved = moved.unionByName(more)
    return table.join(moved, ["kind", "name"], "left").select("kind", "name", F.coalesce("tweak", F.lit(0)).alias("tweak"), F.coalesce("drawn", "image").alias("image"))


def _rewrite(rewriter: Rewriter, schema: list[str], where: int, shared, own: str):
    """shared: the exceptions of all texts; without them each row brings its own in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(where).to_pylist()
            if shared is not None:
                mine = [shared.value] * len(texts)
            else:
                mine = [{(x["kind"], x["name"]): x["tweak"] for x in row or ()} for row in batch.column(own).to_pylist()]
            done = [(None, 0) if t is None else rewriter.rewrite(t, x) for t, x in zip(texts, mine)]
            cols = batch.columns[: len(schema) - 1]
            cols[where] = pa.array([d[0] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([d[1] for d in done], pa.int32())], schema)

    return run


def pseudonymise(docs: DataFrame, key: bytes, count: str = "n_replaced", given: frozenset[str] = frozenset()) -> DataFrame:
    """docs with every detected entity in text replaced, and the number of replacements.

    key: whoever has it can undo the surrogates. given: given names to know besides the lists, of any
    script. Null texts stay null with a count of 0; empty texts and texts without an entity come back
    as they were; texts are read whole, however long. Equal texts get equal surrogates, and rows that
    repeat are each rewritten. Other columns stay, a column named like count is replaced. An empty
    table stays empty.
    """
    docs = docs.drop(count)
    odd = stash(assign(docs, key, given).where("tweak > 0").select("kind", "name", "tweak"), "exceptions")
    spark, names = docs.sparkSession, [*docs.columns, count]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{count}` int"
    rewriter, where, own = Rewriter(key, given), docs.columns.index("text"), fresh(docs, "su_own")
    if odd.limit(EXCEPTIONS + 1).count() <= EXCEPTIONS:
        shared = spark.sparkContext.broadcast({(r.kind, r.name): r.tweak for r in odd.collect()})
        return docs.mapInArrow(_rewrite(rewriter, names, where, shared, own), schema)
    th = fresh(docs, "su_text")
    found = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("th"), "text").mapInArrow(_mentioned(given), "th long, kind string, name string").distinct()
    lists = found.join(odd, ["kind", "name"]).groupBy("th").agg(F.collect_list(F.struct("kind", "name", "tweak")).alias(own)).withColumnRenamed("th", th)
    met = docs.withColumn(th, F.xxhash64("text")).join(lists, th, "left").select(*docs.columns, own)
    return met.mapInArrow(_rewrite(rewriter, names, where, None, own), schema)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_replaced) of each document. The key is the session's KEY_SETTING; where that is
    unset, one is drawn for this call, and another call gives other surrogates."""
    key = spark.conf.get(KEY_SETTING, None)
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key.encode() if key else secrets.token_bytes(32))
