"""PII surrogates (operator 5).

Detected entities are e-mail addresses, phone numbers, card numbers, IPv4 addresses, IBANs, social-security numbers and
names: up to three capitalised words after a form of address, and wherever a word of such a name stands in the same text
again. Each is replaced by a keyed permutation of the strings of its own pattern: a digit stays a digit, a vowel a vowel
of its script and case, a consonant a consonant, any other letter one of its own block and kind; what is no letter or
digit stays. What the pattern must keep is kept: a phone's country code, an IPv4 address's range of octets, the checksum
of a card or an IBAN if it held (and none where it did not), an IBAN's country. E-mail domains move under ``.example``,
which no one can own.

Names go word by word, so a family name alone and after a given name has one surrogate. A word of a list of common names
becomes another of the same list (given names by gender and script, family names by script); any other word keeps its
shape, and ends in a letter of feminine names just if it did, and never becomes a listed name.

A permutation gives distinct entities distinct surrogates, and the same entity, however it is spaced or cased, the same
one, in every document and on every executor, with no table of entities. It is x -> E'(E(x) + 1) for a keyed permutation
E with inverse E', so no entity is its own surrogate. Long strings go in blocks: the first is permuted under a tweak
made of all others, each other one under a tweak made of the new first, which is a permutation again and takes time in
proportion to the length. ``Watch`` checks both ways while texts are replaced; ``collisions`` checks a whole result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For tests and the registered query; a real run passes its own secret.
PUBLIC_TEST_KEY = b"not a secret"
ROUNDS = 6

#: Characters of an entity that are permuted at once.
BLOCK = 32

_VOWELS = ("aeiouy", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "аеёиоуыэюя", "αεηιουω")
_CONSONANTS = ("bcdfghjklmnpqrstvwxz", "çðñþ", "бвгджзйклмнпрстфхцчшщ", "βγδζθκλμνξπρστφχψ")
_CLASSES = {c: s for s in (*_VOWELS, *_CONSONANTS, "0123456789") for c in s}
#: last letters that mark feminine names
_FEMININE = frozenset("aeаяαη")

#: Common names: given ones by gender, then family names; a row for each script.
NAMES = tuple(
    tuple(x.split())
    for x in (
        "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven peter hans juan pedro jean pierre luis carlos",
        "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy anna maria emma laura julia carmen sophie marie claire ingrid petra ursula",
        "smith johnson brown jones garcia miller davis wilson anderson taylor moore jackson martin white müller schmidt schneider fischer weber meyer dubois bernard lopez gonzalez",
        "александр сергей иван дмитрий андрей алексей михаил николай владимир павел",
        "мария анна елена ольга наталья татьяна ирина светлана екатерина юлия",
        "иванов смирнов кузнецов попов васильев петров соколов волков зайцев морозов",
        "иванова смирнова кузнецова попова васильева петрова соколова волкова зайцева морозова",
        "γιώργος δημήτρης κώστας γιάννης νίκος παναγιώτης",
        "ελένη κατερίνα βασιλική σοφία άννα δήμητρα",
    )
)
_LISTED = {n: (k, i) for k, names in enumerate(NAMES) for i, n in enumerate(names)}

#: Calling codes of one and of two digits; every other code has three. Fixed values of the numbering plan.
_CODES_1 = frozenset("17")
_CODES_2 = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|господин|госпожа|κύριος|κυρία"
#: signs that belong to the letter before them
_MARKS = "".join(chr(k) for k in range(0x300, 0x1000) if unicodedata.category(chr(k))[0] == "M")
_NAME = rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}]|['’-](?=[^\W\d_]))*"


@lru_cache(maxsize=1 << 16)
def class_of(c: str) -> str:
    """The characters that may stand for a lower-case letter or digit: its table, else the letters of its kind in its block of
    256 code points; none for what is neither letter nor digit."""
    if c in _CLASSES:
        return _CLASSES[c]
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lu", "Lt", "Lo", "Lm", "Nd"):
        return ""
    start = ord(c) & ~0xFF
    every = (chr(k) for k in range(start, start + 256))
    return "".join(x for x in every if unicodedata.category(x) == kind and x not in _CLASSES and len(x.lower()) == 1 and (kind != "Ll" or len(x.upper()) == 1))


PATTERNS: dict[str, str] = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z]|[-.][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "person": rf"(?<!\w)(?:{_TITLES})\.?[ ](?=({_NAME}(?: {_NAME}){{0,2}}))",
}
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


class Cipher:
    """Keyed permutations without fixed points of range(n), for any n of 2 or more."""

    def __init__(self, key: bytes):
        self.key = key

    @lru_cache(maxsize=1 << 14)  # noqa: B019  one object for each task
    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        data = b"%d:%d:%s:" % (i, bits, tweak) + half.to_bytes(bits // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key[:64], digest_size=bits // 8 + 1).digest(), "big") & ((1 << bits) - 1)

    def digest(self, data: str) -> bytes:
        return hashlib.blake2b(data.encode("utf-8", "surrogatepass"), key=self.key[:64], digest_size=16).digest()

    def _walk(self, x: int, n: int, tweak: bytes, rounds: list[int]) -> int:
        bits = max(1, -(-(n - 1).bit_length() // 2))
        mask = (1 << bits) - 1
        while True:  # from outside the range on, until it is entered
            a, b = x >> bits, x & mask
            if rounds[0] < rounds[-1]:
                for i in rounds:
                    a, b = b, a ^ self._round(tweak, i, b, bits)
            else:
                for i in rounds:
                    a, b = b ^ self._round(tweak, i, a, bits), a
            x = a << bits | b
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: bytes) -> int:
        if n < 2:
            return x
        there = self._walk(x, n, tweak, list(range(ROUNDS)))
        return self._walk((there + 1) % n, n, tweak, list(range(ROUNDS))[::-1])

    def letters(self, text: str, sets: list[str], tweak: bytes) -> str:
        """``text``, each character of which is in its set, moved among the strings of these sets."""
        n, x = 1, 0
        for c, s in zip(text, sets, strict=True):
            n, x = n * len(s), x * len(s) + s.index(c)
        x, out = self.permute(x, n, tweak), []
        for s in reversed(sets):
            x, k = divmod(x, len(s))
            out.append(s[k])
        return "".join(reversed(out))


def _permuted(text: str, kind: str, cipher: Cipher, fixed: set[int] = frozenset(), ending: bool = False) -> str:
    """``text`` with the letters and digits, but those at ``fixed``, moved within the strings of its pattern. ``ending``: the
    last letter stays one of feminine names, or none of them."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    sets = ["" if i in fixed else class_of(c) for i, c in enumerate(low)]
    if ending:
        last = max((i for i, s in enumerate(sets) if s), default=0)
        sets[last] = "" if low[last] in _FEMININE else "".join(x for x in sets[last] if x not in _FEMININE)
    at = [i for i, s in enumerate(sets) if s]
    if not at:
        return text
    # spacing and punctuation do not count, so that an entity in another format meets the same permutation
    shape = cipher.digest(",".join(str(len(sets[i])) + sets[i][0] for i in at))
    own = "".join(low[i] for i in at)
    blocks = [(own[k : k + BLOCK], [sets[i] for i in at[k : k + BLOCK]]) for k in range(0, len(at), BLOCK)]
    tweak = kind.encode() + shape
    head = cipher.letters(*blocks[0], tweak + (cipher.digest(own[BLOCK:]) if len(blocks) > 1 else b""))
    rest = [cipher.letters(t, s, tweak + b"%d" % k + cipher.digest(head)) for k, (t, s) in enumerate(blocks[1:], 1)]
    out = list(text)
    for i, new in zip(at, "".join([head, *rest]), strict=True):
        up = new.upper()
        out[i] = up if text[i] != low[i] and len(up) == 1 else new
    return "".join(out)


def _luhn(digits: str) -> int:
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _cased(new: str, like: str) -> str:
    return new.upper() if len(like) > 1 and like.isupper() else new[0].upper() + new[1:] if like[0].isupper() else new


def name(word: str, cipher: Cipher) -> str:
    """One word of a name, whatever its place in the name."""
    low = word.lower()
    if low in _LISTED:
        k, i = _LISTED[low]
        return _cased(NAMES[k][cipher.permute(i, len(NAMES[k]), b"list%d" % k)], word)
    while True:  # among the words that are not listed
        word = _permuted(word, "name", cipher, ending=True)
        if word.lower() not in _LISTED:
            return word


def calling_code(digits: str) -> str:
    """The country's part of an international number."""
    return digits[:1] if digits[:1] in _CODES_1 else digits[:2] if digits[:2] in _CODES_2 else digits[:3]


def surrogate(kind: str, text: str, cipher: Cipher) -> str:
    """Of one entity. International and ten-digit numbers of the plan of code 1 are one entity in either form."""
    if kind == "email":
        return _permuted(text, kind, cipher) + ".example"
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, text.split("."))), "big")
        return ".".join(map(str, cipher.permute(n, 1 << 32, b"ip").to_bytes(4, "big")))
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        if _luhn(digits[:-1]) == int(digits[-1]):
            at = max(i for i, c in enumerate(text) if c.isdigit())
            new = _permuted(text, "card+", cipher, {at})
            return new[:at] + str(_luhn(re.sub(r"\D", "", new[:at]))) + new[at + 1 :]
        while True:  # without a valid checksum before, without one after
            text = _permuted(text, kind, cipher)
            digits = re.sub(r"\D", "", text)
            if _luhn(digits[:-1]) != int(digits[-1]):
                return text
    if kind == "phone":
        at = [i for i, c in enumerate(text) if c.isdigit()]
        code = calling_code("".join(text[i] for i in at)) if text[0] == "+" else ""
        return _permuted(text, "phone" + (code or "1"), cipher, set(at[: len(code)]))
    if kind == "iban":
        bare = text.replace(" ", "")
        if _mod97(bare) != 1:
            while True:
                text = _permuted(text, kind, cipher, {0, 1})
                if _mod97(text.replace(" ", "")) != 1:
                    return text
        new = _permuted(text, "iban+", cipher, {0, 1, 2, 3})
        check = 98 - _mod97(new[:2] + "00" + new[4:].replace(" ", ""))
        return f"{new[:2]}{check:02d}{new[4:]}"
    if kind == "person":
        return re.sub(_NAME, lambda m: name(m[0], cipher), text)
    return _permuted(text, kind, cipher)


def _named(found: str) -> str:
    """The words of what follows a form of address that are a name: they begin with a capital, or the script has none and they
    are one. A form of address behind another is no name."""
    words = found.split(" ")
    if words[0][0].islower() or re.fullmatch(_TITLES, words[0]):
        return ""
    if not words[0][0].isupper():
        return words[0]
    kept = next((k for k, w in enumerate(words) if not w[0].isupper() or re.fullmatch(_TITLES, w)), len(words))
    return " ".join(words[:kept])


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, without overlap: earlier start first, then the order of ``PATTERNS``."""
    found, names = [], set()
    for rank, (kind, pattern) in enumerate(_COMPILED.items()):
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if kind != "person":
                found.append((m.start(), rank, m.end(), kind))
            elif own := _named(m[1]):
                found.append((m.start(1), rank, m.start(1) + len(own), kind))
                names.update(w for w in re.findall(_NAME, own) if len(w) > 1)
    if names:  # the same words elsewhere in the text; neighbours are one mention
        words = sorted({x for w in names for x in (w, w.upper())}, key=lambda w: (-len(w), w))
        one = "|".join(re.escape(w) if not w[0].isupper() else rf"(?<!\w){re.escape(w)}(?!\w)" for w in words)
        found += [(m.start(), len(_COMPILED), m.end(), "person") for m in re.finditer(rf"(?:{one})(?: (?:{one})){{0,2}}", text)]
    out, at = [], 0
    for start, _, end, kind in sorted(found):
        if start >= at:
            out.append((start, end, kind))
            at = end
    return out


def bare(kind: str, text: str) -> str:
    """An entity or surrogate without what its format may change."""
    low = text.lower()
    return low if kind in ("ip", "email", "person") else re.sub(r"[\s().-]", "", low)


class Watch:
    """Raises where two entities get one surrogate, or one entity two, or one itself, among the last ``held`` entities or so of a task."""

    def __init__(self, held: int = 1 << 16):
        self.held, self.there, self.back = held, {}, {}

    def see(self, kind: str, entity: str, new: str) -> None:
        a, b = (kind, bare(kind, entity)), (kind, bare(kind, new))
        if a == b or self.there.setdefault(a, b) != b or self.back.setdefault(b, a) != a:
            raise ValueError(f"surrogates of {kind} are not one to one")
        if len(self.there) > self.held:
            self.there, self.back = {}, {}


def replaced(text: str, cipher: Cipher, watch: Watch | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """(new text, [(kind, entity, surrogate)])."""
    parts, made, at = [], [], 0
    for start, end, kind in entities(text):
        new = surrogate(kind, text[start:end], cipher)
        if watch:
            watch.see(kind, text[start:end], new)
        parts += [text[at:start], new]
        made.append((kind, text[start:end], new))
        at = end
    return "".join([*parts, text[at:]]), made


def replace(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id", with_entities: bool = False) -> DataFrame:
    """(doc_id, n_entities, kinds, text; with ``with_entities`` also entities array<struct<kind,entity,surrogate>>) for every row.

    kinds: "email:2,phone:1", in order of name. Null texts stay null with no entities, empty ones empty; very long texts and
    entities are read whole, in time near proportional to their length; repeated rows and ids stay; an empty table gives no
    rows; further columns are not read. Raises if surrogates meet (``Watch``).
    """
    some = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher, watch = Cipher(key), Watch()
        for b in batches:
            new, n, kinds, listed = [], [], [], []
            for x in b.column(1):
                got, made = (None, []) if not x.is_valid else replaced(x.as_py(), cipher, watch)
                count: dict[str, int] = {}
                for k, _, _ in made:
                    count[k] = count.get(k, 0) + 1
                new.append(got)
                n.append(len(made))
                kinds.append(",".join(f"{k}:{c}" for k, c in sorted(count.items())))
                listed.append([dict(zip(("kind", "entity", "surrogate"), m, strict=True)) for m in made])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(kinds, pa.string()), pa.array(new, pa.string())]
            if with_entities:
                cols.append(pa.array(listed, pa.list_(pa.struct([(k, pa.string()) for k in ("kind", "entity", "surrogate")]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_entities", "kinds", "text"] + ["entities"] * with_entities)

    return some.mapInArrow(run, "doc_id long, n_entities long, kinds string, text string" + (", entities array<struct<kind:string,entity:string,surrogate:string>>" if with_entities else ""))


def collisions(replaced_rows: DataFrame) -> DataFrame:
    """Of a result with entities: surrogates that two entities share, entities with two surrogates, and entities that stayed."""
    one = replaced_rows.select(F.explode("entities").alias("e")).select("e.*")
    bare = F.lower(F.regexp_replace("entity", r"[\s().-]", "")).alias("entity")
    new = F.lower(F.regexp_replace("surrogate", r"[\s().-]", "")).alias("surrogate")
    pairs = one.select("kind", F.when(F.col("kind").isin("ip", "email", "person"), F.lower("entity")).otherwise(bare).alias("entity"), F.when(F.col("kind").isin("ip", "email", "person"), F.lower("surrogate")).otherwise(new).alias("surrogate")).distinct()
    shared = pairs.groupBy("kind", F.col("surrogate").alias("value")).count().where("count > 1").select("kind", "value", F.lit("shared").alias("fault"))
    split = pairs.groupBy("kind", F.col("entity").alias("value")).count().where("count > 1").select("kind", "value", F.lit("split").alias("fault"))
    same = pairs.where("entity = surrogate").select("kind", F.col("entity").alias("value"), F.lit("unchanged").alias("fault"))
    return shared.union(split).union(same)
