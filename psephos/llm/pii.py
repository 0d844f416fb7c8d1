"""PII surrogates: detected entities are replaced by keyed, type-consistent ones.

An entity has one part or several: an e-mail address its local part and its host, a name its given
names, initials and surname.  Surrogates belong to parts, so equal parts get equal surrogates
everywhere (coreference: addresses of one host keep one host, "Smith" follows "John Smith"), different
ones different ones (distinctness).  Most are keyed permutations of a part's free characters (a Feistel
network over their alphabets, walked until the result is of the same type), so format, script, case
and length stay.  By kind:

* email: the last label stays.  Case doesn't count for identity and is put back.
* phone: the country code and the signs stay.
* ip: private, loopback and link-local ranges stay in their range; public ones stay public.
* card: the first digit stays; a number that passes the Luhn check still does, another doesn't.
* iban: the country stays and the check digits hold.  ssn, key (AKIA...), secret (token=..., password: ...).
* name: what follows a title, and listed given names that a capitalised word follows.  Gender comes from
  the title, else from the list.  Listed given names are permuted among those of the same gender and
  script; others, and surnames, become made-up names of their script with an ending of the gender.
  Initials become other initials.  Later and earlier mentions of the surname or the given name alone
  in the same text follow.  A single letter after a title is no name.

The collision check compares all surrogates of the corpus with each other and with all parts of the
corpus; one that meets another, or a real one, gets the next round of its own part (given names may be
real ones, but never their own).  Where the domain is too full (short parts, secrets and numbers, private
ip ranges), rounds after NARROW_ROUNDS widen it: each makes the surrogate a character longer, or takes an
ip to 10.0.0.0/8; made-up names grow a syllable every third round.  What has no free characters
("password: ____________") is no secret.

Null texts stay null and empty ones empty; very long ones are read whole.  Repeated rows and ties are
treated alike, rows without doc_id like others.  Extra columns stay as they are, whatever their names, but
for n_entities and entity_kinds, which the result defines anew.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import discard, slices, stored

#: Up to so many entities that need a later round are sent to every task; beyond, they are joined.
MOST_OVERRIDES = 50_000
#: So many rounds stay in an entity's own domain; after MOST_ROUNDS the run fails.
NARROW_ROUNDS, MOST_ROUNDS = 6, 60

# Titles and given names by gender, script by script; parts of made-up names.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f"}
GIVEN = {
    "m": ("James John Robert Michael David William Richard Thomas Charles Daniel Paul Mark George Peter Bob Steven Kevin Brian Hans Klaus Jürgen Wolfgang Pierre Jean Michel Louis Carlos José Juan Luis Miguel Antonio", "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил"),
    "f": ("Mary Patricia Linda Barbara Elizabeth Jennifer Maria Susan Margaret Lisa Nancy Karen Alice Emma Emily Sarah Anna Helga Ursula Monika Marie Jeanne Sophie Claire Carmen Lucía Isabel Elena Laura Ana", "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана"),
}
SYLLABLES = {
    "latin": ("b d f g h j k l m n p r s t v z br dr gr kr st tr".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х бр др гр ст".split(), "а е и о у".split()),
}
ENDINGS = {
    "latin": {"m": "n r s l rt".split(), "f": "la na ra lia sa".split(), "": "n la s ra l".split(), "surname": "ner sen ler mann ck rt ns ld".split()},
    "cyrillic": {"m": "н р с л м".split(), "f": "ла на ра лия са".split(), "": "н ла с ра л".split(), "surname": "нко вич рук нин лев ров".split()},
}
_POOLS = {(gender, word.lower()): pool.lower().split() for gender, pools in GIVEN.items() for pool in pools for word in pool.split()}
_GENDER = {word: gender for gender, pools in GIVEN.items() for pool in pools for word in pool.split()}

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
PATTERNS = {
    "email": re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    "secret": re.compile(r"(?i)(?<![^\W_])(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<value>[\w/+.~-]{7,}[\w/+=])"),
    "key": re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])"),
}
_INITIAL, _NAME = r"[^\W\d_a-z]\.", r"[^\W\d_a-z](?:['’](?=[^\W\d_]))?[^\W\d_]+"
_FULL = rf"(?:{_INITIAL} ?)*{_NAME}(?:-{_NAME})?(?: (?:{_INITIAL} ?)*{_NAME}(?:-{_NAME})?)?"
_TITLED = re.compile(rf"(?<!\w)(?P<title>{_TITLE})\.? +(?P<value>{_FULL})(?!\w)")
_UNTITLED = re.compile(rf"(?<!\w)(?P<value>(?:{'|'.join(sorted(_GENDER, key=lambda w: (-len(w), w)))}) (?:{_INITIAL} ?)*{_NAME}(?:-{_NAME})?)(?!\w)")
_TOKEN = re.compile(rf"{_INITIAL}|{_NAME}")
_ANY_SIGN = re.compile(r"[\d@]")
_ANY_KEYWORD = re.compile(rf"(?i:passw|passphrase|pwd|token|secret|key)|(?<!\w)(?:{_TITLE})\.? ")
_QUOTES = str.maketrans(dict.fromkeys("\"'(“„«[", " "))
_VOWELS = "aeiou"


class Part(NamedTuple):
    start: int
    end: int
    kind: str
    value: str


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    value: str
    parts: tuple[Part, ...]


def _name_parts(start: int, value: str, title: str) -> tuple[Part, ...]:
    """Initials, given names (with their gender) and surname of a name that begins at ``start``."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(value)]
    # what the last blank precedes is the surname, all of it where a hyphen is in it; a lone listed name is a given one
    at = value.rfind(" ") + 1
    lone = all(t.endswith(".") for a, _, t in tokens if a < at)
    gender = TITLES.get(title, "")
    parts = []
    for a, b, token in tokens:
        if token.endswith("."):
            parts.append(Part(start + a, start + b - 1, "initial", token[:-1]))
        elif a < at or lone and token in _GENDER and "." not in value:
            parts.append(Part(start + a, start + b, f"given.{gender or _GENDER.get(token, '')}", token))
        else:
            parts.append(Part(start + a, start + b, "surname", token))
    return tuple(parts)


def _entity(start: int, end: int, kind: str, value: str, title: str = "") -> Entity:
    if kind == "email":
        at, last = value.rindex("@"), value.rindex(".")
        parts = (Part(start, start + at, "email.local", value[:at]), Part(start + at + 1, start + last, "email.host", value[at + 1 : last]))
    else:
        parts = _name_parts(start, value, title) if kind == "name" else (Part(start, end, kind, value),)
    return Entity(start, end, kind, value, parts)


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def _iban_rest(text: str) -> int:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def detect(text: str | None) -> list[Entity]:
    """Entities in order, none over another; kinds listed first win."""
    if not text:
        return []
    signs, words = _ANY_SIGN.search(text), _ANY_KEYWORD.search(text)
    given = not _GENDER.keys().isdisjoint(text.translate(_QUOTES).split())
    if not signs and not words and not given:
        return []
    found: list[Entity] = []

    def free(start: int, end: int) -> bool:
        return all(end <= e.start or start >= e.end for e in found)

    for kind, pattern in PATTERNS.items():
        if kind == "email" and "@" not in text or kind == "secret" and not words or kind != "secret" and not signs:
            continue
        for m in pattern.finditer(text):
            start, end = m.span("value") if "value" in pattern.groupindex else m.span()
            value = text[start:end]
            if kind == "iban" and _iban_rest(value) != 1 or kind == "secret" and (not re.search(r"\d", value) and len(value) < 12 or all(len(alphabet(c)) == 1 for c in value)):
                continue
            if free(start, end):
                found.append(_entity(start, end, kind, value))
    names = []
    for pattern, wanted in ((_TITLED, words), (_UNTITLED, given)):
        for m in pattern.finditer(text) if wanted else ():
            e = _entity(*m.span("value"), "name", m["value"], m.groupdict().get("title", ""))
            if free(e.start, e.end) and all(not p.value[0].islower() for p in e.parts):
                found.append(e)
                names.append(e)
    # other mentions of a part follow the first name that has it
    parts: dict[str, str] = {}
    for e in sorted(names):
        for part in e.parts:
            if part.kind != "initial":
                parts.setdefault(part.value, part.kind)
                parts.setdefault(part.value.upper(), part.kind)
    if parts:
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts, key=lambda w: (-len(w), w))))})(?!\w)", text):
            if free(*m.span()):
                found.append(Entity(*m.span(), "name", m[0], (Part(*m.span(), parts[m[0]], m[0]),)))
    return sorted(found)


@lru_cache(4096)
def alphabet(c: str) -> str:
    """Characters that may stand for c: ASCII vowels, consonants and digits each; else those of the same
    general category in the same run of 128 code points."""
    if "0" <= c <= "9":
        return "0123456789"
    if c.isascii():
        if not c.isalpha():
            return c
        own = [x for x in "abcdefghijklmnopqrstuvwxyz" if (x in _VOWELS) == (c.lower() in _VOWELS)]
        return "".join(own) if c.islower() else "".join(own).upper()
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return c
    base = ord(c) & ~127
    own = "".join(chr(x) for x in range(base, base + 128) if unicodedata.category(chr(x)) == kind and (len(chr(x).lower()) == 1 == len(chr(x).upper())))
    return own if c in own else c


class Surrogates:
    """Surrogates under one key; ``rounds`` of an entity moves on to other ones."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _draw(self, tweak: str, value: int, most: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}/{value}".encode(), key=self.key, digest_size=48).digest(), "little") % most

    def permute(self, symbols: list[int], radices: list[int], tweak: str) -> list[int]:
        """A keyed bijection of mixed-radix numbers."""
        half = len(symbols) // 2
        sides, sizes = [0, 0], [1, 1]
        for i, (s, r) in enumerate(zip(symbols, radices, strict=True)):
            sides[i >= half] = sides[i >= half] * r + s
            sizes[i >= half] *= r
        tweak += "/" + ",".join(map(str, radices))
        for turn in range(8):
            a, b = turn % 2, 1 - turn % 2
            sides[b] = (sides[b] + self._draw(f"{tweak}/{turn}", sides[a], sizes[b])) % sizes[b]
        out = []
        for i in range(len(symbols) - 1, -1, -1):
            sides[i >= half], s = divmod(sides[i >= half], radices[i])
            out.append(s)
        return out[::-1]

    def _chars(self, text: str, tweak: str, hexadecimal: bool = False) -> str:
        pools = ["0123456789abcdef" if hexadecimal else alphabet(c) for c in text]
        # the signature of pools is part of the tweak: texts of other forms are other domains
        moved = self.permute([p.index(c) for p, c in zip(pools, text, strict=True)], [len(p) for p in pools], f"{tweak}/{len(text)}")
        return "".join(p[i] for p, i in zip(pools, moved, strict=True))

    def _digits(self, digits: list[int], tweak: str) -> list[int]:
        return self.permute(digits, [10] * len(digits), tweak)

    def of(self, kind: str, value: str, rounds: int = 0) -> str:
        """The surrogate of a part, in the case of this form of it."""
        plain = canonical(kind, value)
        out = self.plain(kind, plain, rounds)
        if kind.startswith("email."):
            return "".join(p.upper() if v != v.lower() and len(p.upper()) == 1 else p for p, v in zip(out, value, strict=True)) if len(out) == len(value) else out
        if plain == value:
            return out
        return out.upper() if value.isupper() and (len(value) > 1 or len(out) == 1) else out[:1].upper() + out[1:]

    def plain(self, kind: str, value: str, rounds: int) -> str:
        """The surrogate of a part in canonical form."""
        if kind == "initial":
            pool = "abcdefghijklmnopqrstuvwxyz" if value.isascii() else alphabet(value)
            if value not in pool or len(pool) < 2:
                return value
            return pool[(pool.index(value) + 1 + self._draw("initial", 0, len(pool) - 1)) % len(pool)]
        script = _script(value) if _is_name(kind) else ""
        if script:
            pool = _POOLS.get((kind[6:], value)) if not rounds else None
            return pool[self.permute([pool.index(value)], [len(pool)], f"{kind}/{pool[0]}")[0]] if pool else self._made(kind, value, rounds, script)
        more = rounds - NARROW_ROUNDS if self._narrow(kind, value) else 0
        original = value
        method = self._chars if _is_name(kind) or kind.startswith("email.") else getattr(self, f"_{kind}")
        for turn in range(rounds + 1 - max(0, more)):
            value = method(value, kind if not turn else f"{kind}/{turn}")
        return self._wider(kind, value, original, more) if more > 0 else value

    def _made(self, kind: str, value: str, rounds: int, script: str) -> str:
        """A made-up name: keyed syllables and an ending of its gender."""
        onsets, vowels = SYLLABLES[script]
        tweak = f"{kind}/made/{rounds}/{value}"
        count = (3 if kind == "surname" else 2) + rounds // 3
        out = "".join(onsets[self._draw(tweak, 2 * i, len(onsets))] + vowels[self._draw(tweak, 2 * i + 1, len(vowels))] for i in range(count))
        endings = ENDINGS[script]["surname" if kind == "surname" else kind[6:]]
        return out + endings[self._draw(tweak, 2 * count, len(endings))]

    def _narrow(self, kind: str, value: str) -> bool:
        """Whether later rounds widen the domain; others have 10 million values and more."""
        if kind == "ip":
            return _fixed_octets([int(p) for p in value.split(".")]) == 2
        return kind == "secret" or kind.startswith("email.") or _is_name(kind) or kind == "phone" and sum(c.isdecimal() for c in value) < 10

    def _wider(self, kind: str, value: str, original: str, more: int) -> str:
        """The surrogate ``value`` with ``more`` keyed characters."""
        tweak = f"{kind}/wider/{more}/{original}"
        if kind == "ip":
            return "10." + ".".join(str(self._draw(f"{tweak}/{i}", 0, 256)) for i in range(3))
        if kind in ("secret", "phone"):
            pool = "0123456789"
        else:
            pool = alphabet(value[-1]) if _is_name(kind) and len(alphabet(value[-1])) > 1 else "abcdefghijklmnopqrstuvwxyz"
        added = "".join(pool[self._draw(tweak, i, len(pool))] for i in range(more))
        return added + value if kind == "secret" else value + added

    def _secret(self, value: str, tweak: str) -> str:
        return self._chars(value, tweak, hexadecimal=bool(re.fullmatch("[0-9a-f]+", value)))

    def _key(self, value: str, tweak: str) -> str:
        pool = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return value[:4] + "".join(pool[i] for i in self.permute([pool.index(c) for c in value[4:]], [36] * 16, tweak))

    def _replace_digits(self, value: str, digits: list[int], skip: int = 0) -> str:
        it, seen, out = iter(digits), 0, []
        for c in value:
            if c.isdecimal():
                seen += 1
                out.append(alphabet(c)[next(it)] if seen > skip else c)
            else:
                out.append(c)
        return "".join(out)

    def _card(self, value: str, tweak: str) -> str:
        digits = [int(c) for c in value if c.isdecimal()]
        if _luhn(digits) == 0:
            middle = self._digits(digits[1:-1], tweak + f"/valid{digits[0]}")
            last = next(d for d in range(10) if _luhn([digits[0], *middle, d]) == 0)
            return self._replace_digits(value, [*middle, last], 1)
        rest = self._digits(digits[1:], tweak + f"/other{digits[0]}")
        while _luhn([digits[0], *rest]) == 0:
            rest = self._digits(rest, tweak + f"/other{digits[0]}")
        return self._replace_digits(value, rest, 1)

    def _ssn(self, value: str, tweak: str) -> str:
        return self._replace_digits(value, self._digits([int(c) for c in value if c.isdecimal()], tweak))

    def _phone(self, value: str, tweak: str) -> str:
        code = len(re.match(r"\+?(\d{1,3})(?=[ .(-])|", value).group(1) or "") if value.startswith("+") else 0
        digits = [int(c) for c in value if c.isdecimal()]
        return self._replace_digits(value, self._digits(digits[code:], tweak), code)

    def _ip(self, value: str, tweak: str) -> str:
        parts = [int(p) for p in value.split(".")]
        fixed = _fixed_octets(parts)
        rest = self.permute(parts[fixed:], [256] * (4 - fixed), f"{tweak}/{parts[:fixed]}")
        while _fixed_octets([*parts[:fixed], *rest]) != fixed:
            rest = self.permute(rest, [256] * (4 - fixed), f"{tweak}/{parts[:fixed]}")
        return ".".join(map(str, [*parts[:fixed], *rest]))

    def _iban(self, value: str, tweak: str) -> str:
        plain = value.replace(" ", "")
        pools = ["0123456789" if c.isdecimal() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in plain[4:]]
        moved = self.permute([p.index(c) for p, c in zip(pools, plain[4:], strict=True)], [len(p) for p in pools], f"{tweak}/{plain[:2]}")
        body = "".join(p[i] for p, i in zip(pools, moved, strict=True))
        it = iter(f"{plain[:2]}{98 - _iban_rest(plain[:2] + '00' + body):02d}{body}")
        return "".join(c if c == " " else next(it) for c in value)


def _fixed_octets(parts: list[int]) -> int:
    """Octets that a range outside the public ones keeps."""
    a, b = parts[:2]
    if a in (10, 127, 0):
        return 1
    if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32:
        return 2
    return 0


def _is_name(kind: str) -> bool:
    return kind == "surname" or kind.startswith("given.")


def _script(value: str) -> str:
    """The script that made-up names can take; none for others."""
    scripts = {"latin" if c < "\u0250" else "cyrillic" if "\u0400" <= c < "\u0530" else "" for c in value if c.isalpha()}
    return scripts.pop() if len(scripts) == 1 else ""


def canonical(kind: str, value: str) -> str:
    """The form in which parts are compared: case doesn't count in addresses and names."""
    return value.lower() if kind == "initial" or kind.startswith("email.") or _is_name(kind) else value


def replace(text: str | None, surrogates: Surrogates, rounds: dict[tuple[str, str], int]) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds of its entities."""
    out, at, kinds = [], 0, []
    for e in detect(text):
        for p in e.parts:
            out += [text[at : p.start], surrogates.of(p.kind, p.value, rounds.get((p.kind, canonical(p.kind, p.value)), 0))]
            at = p.end
        kinds.append(e.kind)
    return ("".join(out) + text[at:] if kinds else text), kinds


_ENTITY = pa.schema([("text_key", pa.int64()), ("kind", pa.string()), ("value", pa.string())])


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = sorted({(key, p.kind, canonical(p.kind, p.value)) for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for e in detect(text) for p in e.parts if p.kind != "initial"})
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ENTITY)], schema=_ENTITY)


def find_entities(docs: DataFrame) -> DataFrame:
    """(text_key, kind, value): parts of the entities of each text, in canonical form; the key is the text's hash."""
    return docs.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(_entities, "text_key long, kind string, value string")


def _surrogate_column(key: bytes):
    @F.pandas_udf("string")
    def column(kind, value, rounds):
        import pandas as pd

        s = Surrogates(key)
        return pd.Series([s.plain(k, v, int(r)) for k, v, r in zip(kind, value, rounds, strict=True)], dtype=object)

    return column


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, rounds) of the distinct parts whose surrogate had to move on.

    A surrogate that another part has too (all but the least value move), or that is itself a part of
    the corpus, moves one round; then all are compared again, until none meet.  Given names of all
    genders are compared with each other.
    """
    every = stored(entities.select("kind", "value").distinct(), "entities")
    surrogate = _surrogate_column(key)
    family = F.when(F.col("kind").startswith("given."), F.lit("given")).otherwise(F.col("kind"))
    rounds = every.select("kind", "value", F.lit(0).alias("rounds"))
    last = moving = None
    for _ in range(MOST_ROUNDS):
        now = stored(rounds.withColumn("surrogate", surrogate("kind", "value", "rounds")).withColumn("family", family), "surrogates")
        discard(last, moving)
        last = now
        twins = now.groupBy("family", "surrogate").agg(F.min(F.struct("value", "kind")).alias("least"), F.count("*").alias("n")).filter("n > 1")
        own = now.filter("surrogate = value").select("kind", "value")
        real = now.filter("family <> 'given'").join(every.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "value").unionByName(own)
        clash = now.join(twins, ["family", "surrogate"]).filter("struct(value, kind) <> least").select("kind", "value")
        moving = stored(real.unionByName(clash).distinct(), "moving")
        if not moving.limit(1).count():
            return now.filter("rounds > 0").select("kind", "value", "rounds")
        rounds = now.join(moving.withColumn("move", F.lit(1)), ["kind", "value"], "left").select("kind", "value", (F.col("rounds") + F.coalesce("move", F.lit(0))).alias("rounds"))
    raise RuntimeError(f"{moving.count()} surrogates still meet others after {MOST_ROUNDS} rounds")


def _apply(key: bytes, schema: pa.Schema, rounds):
    """Replace in every row; ``rounds`` is a mapping for all rows, or None: then each row brings its own."""
    text = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for part in slices(batches):
            n = len(schema) - 2
            own = part.column(n).to_pylist() if rounds is None else [None] * part.num_rows
            done = [replace(t, surrogates, rounds if rounds is not None else {(o["kind"], o["value"]): o["rounds"] for o in mine or ()}) for t, mine in zip(part.column(text).to_pylist(), own, strict=True)]
            columns = list(part.columns)[:n]
            columns[text] = pa.array([d[0] for d in done], schema.field(text).type)
            columns += [pa.array([len(d[1]) for d in done], pa.int64()), pa.array([",".join(sorted(set(d[1]))) for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with replaced texts, all columns kept, and n_entities and entity_kinds."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    if not key:
        raise ValueError("surrogates need a key")
    found = find_entities(docs)
    moved = stored(settle(found, key), "moved")
    names = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("entity_kinds", T.StringType())])
    count = moved.count()
    if count <= MOST_OVERRIDES:
        rounds = {(r.kind, r.value): r.rounds for r in moved.collect()} if count else {}
        return docs.mapInArrow(_apply(key, to_arrow_schema(schema), rounds), schema)
    # Beyond, each text brings its own: texts of one hash share what any of them needs.
    per_text = found.join(moved, ["kind", "value"]).groupBy("text_key").agg(F.collect_set(F.struct("kind", "value", "rounds")).alias("own"))
    mine, keyed = (next(f"_{w}{i}" for i in range(len(names) + 1) if f"_{w}{i}" not in names) for w in ("rounds", "key"))
    per_text = per_text.select(F.col("text_key").alias(keyed), F.col("own").alias(mine))
    joined = docs.join(per_text, F.xxhash64("text") == F.col(keyed), "left").select(*[F.col(f"`{c}`") for c in [*names, mine]])
    return joined.mapInArrow(_apply(key, to_arrow_schema(schema), None), schema)
