"""Operator 2: keyed surrogates for personal data and secrets, of the same kind, gender, script and format."""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, free_name, map_arrow, materialize, replace_columns, table

#: Salts of entities that moved are sent to executors up to so many; beyond it they are joined by shuffle.
EXCEPTIONS = 200_000
#: Turns of the permutation, and turns of salting within an entity's format; salts in a turn: so many for each entity at
#: least, CANDIDATES in all where few entities are left, SALTS at most.
ROUNDS, TRIES, LEAST_SALTS, SALTS, CANDIDATES = 8, 20, 4, 4096, 200_000
#: Salts from here on write a wider format: names and emails get more letters, other kinds have letters for digits.
WIDE = 1 << 30

_GAP = r"[\s.\-!#$%&*|]{0,4}"
# Titles that tell a person, by the gender that they tell.
FEMALE = "Mrs Ms Miss Lady Frau Señora Señorita Sra Madame Mademoiselle Mme Mlle".split()
MALE = "Mr Mister Sir Herr Señor Sr Monsieur".split()
TITLES = [*FEMALE, *MALE, "Dr", "Prof"]
# Country calling codes of one and of two digits; all others have three.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Address blocks that aren't public; an address stays in its block, or public.
BLOCKS = [ipaddress.ip_network(x) for x in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 240.0.0.0/4 fe80::/10 fc00::/7 ff00::/8 2001:db8::/32 ::/8 2000::/3".split()]
#: Last letters of given names that read as female and as male, by script.
ENDS = {"f": ("aei", "ая", "αη"), "m": ("nrsdlkot", "нрсдлктмй", "ςν")}

ENTITY = regex.compile(
    r"(?P<email>(?<![\w.+-])[\w%+-]+(?:\.[\w%+-]+)*@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<secret>(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)gh[opsur]_[A-Za-z0-9]{36}(?!\w)|(?<![\w/+])(?=[0-9a-f]*\d)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\w/+]))"
    r"|(?i:\b(?:token|secret|password|passwd|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)(?P<keyed>(?=[\w+/-]*\d)[\w+/-]{12,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){3,7}(?:\ ?[A-Z0-9]{1,3})?(?!\w))"
    rf"|(?P<phone>(?<![\w+])\+\d{{1,3}}{_GAP}\(?\d{{2,4}}\)?(?:{_GAP}\d{{2,4}}){{2,4}}(?!\d)|(?<!\w)\(\d{{3}}\){_GAP}\d{{3}}-\d{{4}}(?!\d)|(?<![\d-])\d{{3}}-\d{{3}}-\d{{4}}(?![\d-]))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})(?=[A-Fa-f:]*\d)[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.,-])\d(?:[\ -]?\d){12,18}(?![\d-]))"
    rf"|\b(?P<title>{'|'.join(TITLES)})\.?\ (?P<person>\p{{Lu}}[\p{{L}}'-]+(?:\ \p{{Lu}}[\p{{L}}'-]+){{0,2}})",
)

#: Every entity holds one of these; around them, and MARGIN further to the next blank, the texts are looked at closely.
ANCHOR = re.compile(rf"[0-9@]|(?:{'|'.join(TITLES)})\.?\ ")
MARGIN = 128

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Alphabets of other scripts and kinds; a letter is replaced within its own. Letters of none of them go by code range.
_ALPHABETS = ("аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "ъь", "αειουωη", "άέίόύώή", "βγδζθκλμνξπρστφχψ")
_OWN = {c: a for x in _ALPHABETS for a in (x, x.upper()) for c in a}
_LATIN = range(0xC0, 0x180)


def _class(c: str) -> tuple:
    """What letters of one alphabet have in common: kind and case, script, whether case can be undone, vowel or not."""
    flip = c.swapcase()
    undone = len(flip) == 1 and flip.swapcase() == c and unicodedata.normalize("NFC", c) == c
    vowel = unicodedata.normalize("NFD", c)[0].lower() in "aeiouyæøœıаеиоуыэюяіαειουωη"
    return unicodedata.category(c), unicodedata.name(c, "").split(" ")[0], undone, vowel


@functools.lru_cache(1 << 16)
def _other_letter(c: str) -> str:
    """The alphabet of a letter or digit that isn't ASCII: its digits, its script's letters, or those of its code range."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if c in _OWN:
        return _OWN[c]
    if not c.isalpha():
        return ""
    start = ord(c) & ~0xFF
    near = _LATIN if ord(c) in _LATIN else range(max(start, 0x80), start + 256)
    own = _class(c)
    return "".join(x for x in map(chr, near) if x not in _OWN and (ord(x) in _LATIN) == (ord(c) in _LATIN) and _class(x) == own)


def _lower(text: str) -> str:
    """text in lower case, but for letters that would become several."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _upper(text: str) -> str:
    return "".join(x if len(x := c.upper()) == 1 else c for c in text)


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(t - 9 * (t > 9) for t in twice)) % 10 == 0


class Surrogates:
    """A keyed permutation of all entities of one kind and format: different ones stay different, equal ones equal."""

    def __init__(self, key: bytes):
        self.key, self.memory = key, {}

    def _shuffle(self, tweak: str, value: int, size: int, good=None) -> int:
        """A permutation of 0..size-1 (of its members that are good): a Feistel network on as many bits, walked back into range."""
        if size < 2:
            return value
        half = max(1, (size.bit_length() + 1) // 2)
        mask = (1 << half) - 1
        start = value
        while True:
            left, right = value >> half, value & mask
            for turn in range(ROUNDS):
                message = f"{tweak}\0{size}\0{turn}\0{right:x}".encode()
                left, right = right, left ^ (int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest()) & mask)
            value = left << half | right
            if value < size and (good is None or value == start or good(value)):
                return value

    def _spell(self, tweak: str, text: str, alphabet_of, good=None) -> str:
        """text with each character that has an alphabet replaced from it, as one mixed-radix number."""
        sets = [alphabet_of(c) for c in text]
        plan = "".join("." if not a else a[0] for a in sets)
        value, size = 0, 1
        for c, a in zip(text, sets):
            if a:
                value, size = value * len(a) + a.index(c), size * len(a)

        def write(v: int) -> str:
            out = []
            for c, a in zip(reversed(text), reversed(sets)):
                if a:
                    v, i = divmod(v, len(a))
                    c = a[i]
                out.append(c)
            return "".join(reversed(out))

        fixed = "".join(c for c, a in zip(text, sets) if not a)
        return write(self._shuffle(f"{tweak}\0{plan}\0{fixed}", value, size, good and (lambda v: good(write(v)))))

    @staticmethod
    def _letter(c: str) -> str:
        if c.isascii():
            return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else ""
        return _other_letter(c)

    @staticmethod
    def _name_letter(c: str) -> str:
        for a in (_VOWELS, _CONSONANTS):
            if c in a:
                return a
        return "" if c.isascii() else _other_letter(c)

    def _wide(self, kind: str, normal: str, salt: int) -> str:
        """A surrogate outside the entity's format, where that has no place left; more letters the longer none is found."""
        tweak = f"{kind}{salt}"
        person = kind.startswith("person")
        if kind == "email" or person:
            text, at, rest = normal.rpartition("@") if kind == "email" else (normal[:-1], "", normal[-1:])
            text, rest = (text, rest) if at or person else (normal, "")
            alphabet_of = self._letter if kind == "email" else self._name_letter
            sets = [a for c in text if len(a := alphabet_of(c)) > 1 and not a[0].isdecimal()]
            more = (sets[-1][0] + sets[0][-1] if sets else "ba") * (1 + (salt - WIDE) // 64)
            if person:
                return self._spell(tweak, text + more, alphabet_of) + self._ending(kind, rest, tweak)
            host, _, top = rest.rpartition(".")
            return f"{self._spell(tweak, text + more, alphabet_of)}@{self._spell('domain', host, self._letter)}.{top}"
        if kind == "ipv6":  # a block that isn't in use, so that nothing can be met twice
            return self._address(tweak, normal)
        keep = len(normal) - len(normal.rpartition(" ")[2]) if kind == "phone" else 2 if kind == "iban" else 0
        letters = "".join("abcdefghij"[unicodedata.decimal(c)] if c.isdecimal() else c for c in normal[keep:])
        return normal[:keep] + self._spell(tweak, letters, self._letter)

    def of(self, kind: str, normal: str, salt: int = 0) -> str:
        """The surrogate of an entity's normal form."""
        if salt >= WIDE:
            return self._wide(kind, normal, salt)
        tweak = f"{kind}{salt or ''}"
        if kind == "email":
            local, domain = normal.rsplit("@", 1)
            host, top = domain.rsplit(".", 1)
            return f"{self._spell(tweak, local, self._letter)}@{self._spell('domain', host, self._letter)}.{top}"
        if kind in ("ip", "ipv6"):
            return self._address(tweak, normal)
        if kind == "card":
            valid = _luhn(normal)
            if not valid:
                return self._spell(tweak, normal, self._letter, lambda s: not _luhn(s))
            head = self._spell(f"{tweak}+", normal[:-1], self._letter)
            return next(head + d for d in "0123456789" if _luhn(head + d))
        if kind == "secret":
            if set(normal) <= set("0123456789abcdef"):
                return self._spell(tweak, normal, lambda c: "0123456789abcdef")
            if set(normal) <= set("0123456789ABCDEF"):
                return self._spell(tweak, normal, lambda c: "0123456789ABCDEF")
            keep = 4 if normal[:4] in ("AKIA", "ASIA", *(f"gh{c}_" for c in "opsur")) else 0
            return normal[:keep] + self._spell(tweak, normal[keep:], self._letter)
        if kind == "iban":
            return normal[:2] + self._spell(tweak, normal[2:], self._letter)
        if kind == "phone":
            code, _, rest = normal.rpartition(" ")
            return f"{code} {self._spell(tweak, rest, self._letter)}" if code else self._spell(tweak, rest, self._letter)
        if kind.startswith("person"):
            if all(len(self._name_letter(c)) < 2 for c in normal[:-1]):
                return self._spell(tweak, normal, self._name_letter)
            return self._spell(tweak, normal[:-1], self._name_letter) + self._ending(kind, normal[-1:], tweak + normal[:-1])
        return self._spell(tweak, normal, self._letter)

    def _address(self, tweak: str, normal: str) -> str:
        """An address of the same block, or a public one for a public one."""
        own = ipaddress.ip_address(normal)
        block = next((b for b in BLOCKS if b.version == own.version and own in b), None)
        start, size = (int(block.network_address), block.num_addresses) if block else (0, 1 << own.max_prefixlen)
        public = lambda v: not any(b.version == own.version and ipaddress.ip_address(v.to_bytes(own.max_prefixlen // 8)) in b for b in BLOCKS)
        value = start + self._shuffle(f"{tweak}\0{start}", int(own) - start, size, None if block else public)
        return str(ipaddress.ip_address(value.to_bytes(own.max_prefixlen // 8)))

    def _ending(self, kind: str, last: str, tweak: str) -> str:
        """The last letter of a name: a surname's stays, as it carries the gender in many languages; a given name gets one of its gender."""
        ends = next((e for e in ENDS.get(kind[7:], ()) if unicodedata.name(e[0]).split(" ")[0] == unicodedata.name(last, " ").split(" ")[0]), None)
        if not ends or last in ends:
            return self._spell(f"{tweak}\0end", last, lambda c: ends) if ends else last
        return ends[int.from_bytes(hashlib.blake2b(f"{tweak}\0{last}".encode(), key=self.key, digest_size=8).digest()) % len(ends)]

    def cached(self, kind: str, normal: str, salt: int) -> str:
        k = (kind, normal, salt)
        if k not in self.memory:
            if len(self.memory) > 100_000:
                self.memory.clear()
            self.memory[k] = self.of(kind, normal, salt)
        return self.memory[k]


def _code(digits: str) -> int:
    """Digits of the country code that an international number starts with."""
    return next((n for n in (1, 2) if digits[:n] in CODES), 3)


def _normal(kind: str, text: str) -> list[tuple[str, str]]:
    """(kind, normal form) of an entity other than a name: what is written differently but means the same has one form."""
    if kind == "email":
        return [(kind, text.lower())]
    if kind in ("card", "ssn", "iban"):
        return [(kind, "".join(c for c in text if c.isalnum()))]
    if kind == "phone":
        digits = "".join(c for c in text if c.isdigit())
        n = _code(digits) if text.startswith("+") else 0
        return [(kind, f"+{digits[:n]} {digits[n:]}" if n else digits)]
    if kind == "ip":
        return [(kind, ".".join(str(int(x)) for x in text.split(".")))]
    if kind == "ipv6":
        return [(kind, str(ipaddress.ip_address(text)))]
    return [(kind, text)]


def _name(word: str) -> str:
    return _lower(unicodedata.normalize("NFC", word))


def _write(kind: str, text: str, new: list[str]) -> str:
    """The surrogate in the format of what it replaces: separators, case and leading zeros."""
    if kind == "email":
        return new[0].upper() if text.isupper() else new[0]
    if kind in ("card", "ssn", "iban", "phone"):
        code, _, rest = new[0].rpartition(" ") if kind == "phone" else ("", "", new[0])
        chars, keep, out = iter(rest), max(len(code) - 1, 0), []
        for c in text:
            if c.isalnum() and keep:
                keep -= 1
            elif c.isalnum():
                c = next(chars)
            out.append(c)
        return "".join(out)
    if kind == "ipv6":
        own = ipaddress.ip_address(new[0])
        made = str(own) if "::" in text else ":".join(x.lstrip("0") or "0" for x in own.exploded.split(":")) if any(len(x) < 4 for x in text.split(":")) else own.exploded
        return made.upper() if text.isupper() else made
    if kind == "person":
        words = []
        for w, n in zip(text.split(" "), new):
            words.append(_upper(n) if w.isupper() and len(w) > 1 else "".join(_upper(b) if a.isupper() else b for a, b in zip(w, n)) + n[len(w) :])
        return " ".join(words)
    return new[0]


def _windows(text: str) -> list[tuple[int, int]]:
    """Parts of a text in which entities can lie, from blank to blank."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := ANCHOR.search(text, at):
        a = text.rfind(" ", 0, max(0, m.start() - MARGIN)) + 1
        end = m.end()
        while (n := ANCHOR.search(text, end, end + MARGIN)) is not None:
            end = n.end()
        b = text.find(" ", end + MARGIN)
        b = len(text) if b < 0 else b
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
        at = b
    return out


def entities(text: str | None) -> list[tuple[int, int, str, list[tuple[str, str]]]]:
    """(start, end, kind, parts) of the entities of a whole text; parts are (kind, normal form) of each word of a name.

    A name is found by its title, and then every mention of its words in the text. The first words of a name are given
    names, of the gender of a title that any mention in the text has with them, or else of their last letter.
    """
    out, names, gender = [], [], {}
    for a, b in _windows(text or ""):
        for m in ENTITY.finditer(text, a, b):
            kind = m.lastgroup
            start, end = m.span(kind)
            digits = "".join(c for c in m[0] if c.isdigit()) if kind in ("card", "phone") else ""
            if kind == "card" and not (_luhn(digits) or len(digits) == 16):
                continue
            if kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            if kind == "ipv6":
                try:
                    ipaddress.IPv6Address(m[kind])
                except ValueError:
                    continue
            if kind == "person":
                names.append((start, end))
                words = [_name(w) for w in m[kind].split(" ")]
                told = "f" if m["title"] in FEMALE else "m" if m["title"] in MALE else ""
                for w in words[:-1]:
                    gender[w] = gender.get(w) or told
                gender |= {words[-1]: gender.get(words[-1])}
            else:
                out.append((start, end, kind, _normal("secret" if kind == "keyed" else kind, m[kind])))
    if not names:
        return [(a, b, "secret" if k == "keyed" else k, p) for a, b, k, p in out]

    def part(word: str) -> tuple[str, str]:
        w = _name(word)
        if gender.get(w) is None:
            return "person", w
        ends = ENDS["f"]
        return f"person-{gender[w] or ('f' if any(w[-1:] in e for e in ends) else 'm')}", w

    known = {w for a, b in names for w in text[a:b].split(" ") if len(w) > 1}
    mention = "|".join(sorted(map(regex.escape, known | {_upper(w) for w in known}), key=len, reverse=True))
    taken = sorted([(a, b) for a, b, _, _ in out] + names)
    starts = [a for a, _ in taken]
    for m in regex.finditer(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])(?:{mention})(?![\p{{L}}\p{{M}}\p{{N}}_])", text) if known else ():
        i = bisect.bisect_right(starts, m.start()) - 1
        if (i < 0 or taken[i][1] <= m.start()) and (i + 1 == len(taken) or taken[i + 1][0] >= m.end()):
            names.append(m.span())
    out += [(a, b, "person", [part(w) for w in text[a:b].split(" ")]) for a, b in names]
    return [(a, b, "secret" if k == "keyed" else k, p) for a, b, k, p in sorted(out, key=lambda x: x[0])]


SALTED = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "normal")] + [T.StructField("salt", T.IntegerType()), T.StructField("new", T.StringType())])


def _moved(known: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, normal, salt, new) of the entities that need a salt, or None: none of them has an original or another's surrogate.

    Of several with one surrogate the first by hash keeps it. Kinds of names share their words, so they are compared
    as one (`what`). Each turn every entity that is left tries some salts, more the fewer are left. Values that nobody
    has go to the entity that has them by the least salt, and entities take the first that they got, so the result
    depends on the entities alone. Where TRIES turns, or two of SALTS salts an entity, found no place, the formats that
    are left are full: their salts write a wider format from there on, which grows until there is a place.
    """
    what = F.split("kind", "-")[0].alias("what")
    originals = materialize(known.select(what, F.col("normal").alias("new")).distinct(), "pii-originals")
    first = known.groupBy(what, "new").agg(F.count("*").alias("many"), F.min(F.struct(F.xxhash64("normal").alias("h"), "normal", "kind")).alias("x")).where("many > 1")
    later = known.withColumn("what", what).join(first, ["what", "new"]).where("x.normal <> normal or x.kind <> kind").select("kind", "normal")
    left = materialize(known.withColumn("what", what).join(originals, ["what", "new"], "left_semi").select("kind", "normal").union(later).distinct(), "pii-met")
    n = left.count()
    if not n:
        return None
    taken = known.join(left, ["kind", "normal"], "left_anti").select(what, "new")
    moved, salt, turn, vain = None, 1, 0, 0
    while n:
        if salt < WIDE and (turn == TRIES or vain == 2):
            salt = WIDE
        many = max(LEAST_SALTS, min(SALTS, CANDIDATES // n))

        def salted(batch: pa.RecordBatch, salt=salt, many=many) -> dict:
            s, out = Surrogates(key), []
            for k, n in zip(*(batch.column(i).to_pylist() for i in range(2))):
                seen = {n}
                for x in range(salt, salt + many):
                    if (new := s.of(k, n, x)) not in seen:
                        seen.add(new)
                        out.append((k, n, x, new))
            return {f: [r[i] for r in out] for i, f in enumerate(SALTED.names)}

        tried = map_arrow(left, salted, SALTED).withColumn("what", what).join(originals.union(taken), ["what", "new"], "left_anti")
        own = tried.groupBy("what", "new").agg(F.min(F.struct("salt", F.xxhash64("normal").alias("h"), "normal", "kind")).alias("x")).select("x.kind", "x.normal", "x.salt", "new")
        got = materialize(own.groupBy("kind", "normal").agg(F.min(F.struct("salt", "new")).alias("x")).select("kind", "normal", "x.salt", "x.new"), "pii-moved")
        moved = got if moved is None else moved.unionByName(got)
        taken = taken.union(got.select(what, "new"))
        left = materialize(left.join(got, ["kind", "normal"], "left_anti"), "pii-met")
        before, n = n, left.count()
        salt, turn, vain = salt + many, turn + 1, vain + 1 if n == before and many == SALTS else 0
    return moved


def _with_salts(docs: DataFrame, moved: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with the salts of the moved entities of each text, by the text's hash; a list of two texts serves both."""

    def listed(batch: pa.RecordBatch) -> dict:
        found = sorted({(h, *x) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, _, _, parts in entities(t) for x in parts})
        return {f: [r[i] for r in found] for i, f in enumerate(("h", "kind", "normal"))}

    h = free_name(docs, f"{name}_of")
    hashed = docs.withColumn(h, F.xxhash64(F.col(f"`{text_col}`")))
    held = map_arrow(hashed.select(h, F.col(f"`{text_col}`")), listed, T.StructType.fromDDL("h long, kind string, normal string")).distinct()
    lists = held.join(moved.select("kind", "normal", "salt").hint("shuffle_merge"), ["kind", "normal"]).groupBy(F.col("h").alias(h)).agg(F.collect_list(F.struct("kind", "normal", "salt")).alias(name))
    return hashed.join(materialize(lists, "pii-salts"), h, "left").drop(h)


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with surrogate_text and n_entities: emails, addresses, numbers, secrets and titled names replaced everywhere alike.

    A surrogate is a keyed mapping within the entity's kind and format: Luhn-valid numbers stay valid and others
    invalid, numbers keep their country code, private addresses their block, names their script and case. A given name
    ends as names of its gender do, which its title tells, or else its own ending. All words of a titled name are
    replaced wherever the text has them, so mentions without the title go with it; one word has one surrogate in all
    documents, but for given names whose title speaks against their ending. All distinct entities are then checked: one
    whose surrogate is an original or another's surrogate moves on by salts until it meets none, and into a wider format
    only where its own has no place left. The salts of those that moved are broadcast, or joined by shuffle where there
    are more than EXCEPTIONS; both give equal results.

    Cases: null stays null with no entities; empty and long texts, null ids and repeated rows need nothing special; an
    empty table gives an empty result; input columns named like the added ones are replaced.
    """
    docs = replace_columns(docs, ["surrogate_text", "n_entities"])
    spark = docs.sparkSession

    def listed(batch: pa.RecordBatch) -> dict | None:
        found = set()
        for t in batch.column(0):
            t = t.as_py()
            for _, _, _, parts in entities(t):
                found |= set(parts)
        if not found:
            return None
        s = Surrogates(key)
        rows = sorted(found)
        return {"kind": [k for k, _ in rows], "normal": [n for _, n in rows], "salt": [0] * len(rows), "new": [s.of(k, n) for k, n in rows]}

    known = materialize(map_arrow(docs.select(F.col(f"`{text_col}`").alias("t")), listed, SALTED).groupBy("kind", "normal").agg(F.first("salt").alias("salt"), F.first("new").alias("new")), "pii-entities")
    moved = _moved(known, key)
    large = moved is not None and moved.count() > EXCEPTIONS
    exceptions = {} if moved is None or large else {(r.kind, r.normal): r.salt for r in moved.toLocalIterator()}
    held = free_name(docs, "pii_salts")
    if large:
        docs = _with_salts(docs, moved, text_col, held)
    sent = spark.sparkContext.broadcast(exceptions)
    own: list[Surrogates] = []

    def write(batch: pa.RecordBatch) -> dict:
        if not own:
            own.append(Surrogates(key))
        texts, counts = [], []
        lists = batch.column(batch.schema.get_field_index(held)) if large else None
        for i, t in enumerate(batch.column(batch.schema.get_field_index(text_col))):
            t = t.as_py()
            found, at, out = entities(t), 0, []
            salts = {(x["kind"], x["normal"]): x["salt"] for x in lists[i].as_py() or ()} if large else sent.value
            for a, b, kind, parts in found:
                new = [own[0].cached(k, n, salts.get((k, n), 0)) for k, n in parts]
                out += [t[at:a], _write(kind, t[a:b], new)]
                at = b
            texts.append(None if t is None else "".join([*out, t[at:]]))
            counts.append(len(found))
        return {"surrogate_text": pa.array(texts, pa.string()), "n_entities": counts}

    return add_columns(docs, write, [T.StructField("surrogate_text", T.StringType()), T.StructField("n_entities", T.LongType())], drop=(held,) if large else ())


def op2_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """The key is a fixed one here, so that runs can be compared; production passes its own secret."""
    out = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), b"a key for comparable runs")
    return out.select("doc_id", F.col("surrogate_text").alias("text"), "n_entities")
