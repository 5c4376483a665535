"""PII surrogates: detected entities get keyed replacements of their own type, gender, script and format.

Emails, phone numbers, payment cards, IP addresses, IBANs, social security numbers, secrets and titled personal names are
found in whole texts. The parts of a titled name are then found in the rest of its text too, where they stand without a
title and begin with a capital letter. A surrogate is a function of a secret key, the type, the entity in normal form and an attempt number,
so one entity has one surrogate in every document and every spelling, and parts that return (a mail domain, a surname)
return as the same surrogate part. A replacement keeps separators, letter case, country codes, check digits and script.

Distinctness is checked over the whole corpus: a surrogate that equals a real entity of its type, or another entity's
surrogate, is drawn again with the next attempt number (the smallest entity keeps it), until none does. Only entities with a
later attempt are joined back to documents; all others follow from the key alone.

Defined results: null text stays null with no entities; overlapping finds go to the one that starts first, then the longer;
repeated rows are replaced alike. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from gaugeline.llm.common import Scratch

KEY = b"set a secret key of your own"
ATTEMPTS = 64
#: titles by gender (fixed values)
TITLES = {"f": "Mrs Ms Miss Mme Madame Frau Señora Sra Doña Signora г-жа госпожа", "m": "Mr Monsieur Herr Señor Signore г-н господин", "n": "Dr Prof Professor"}
GENDER = {t.casefold(): g for g, names in TITLES.items() for t in names.split()}
_TITLE = "|".join(sorted((regex.escape(t) for names in TITLES.values() for t in names.split()), key=len, reverse=True))
#: a capitalised part of a name, perhaps behind initials
_PART = r"(?:\p{Lu}\.[ \t]*)*\p{Lu}[\p{L}'’-]+"
#: what is replaced of a name; initials stay
_WORD = regex.compile(r"[\p{L}'’-]{2,}")
_OWN = regex.compile(r"['’]s(?![\p{L}'’-])|['’-]+$")
_TRUNK = regex.compile(r"^\+\d{1,3}[ .-]|\D")
PATTERNS = {
    "EMAIL": regex.compile(r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}"),
    "IBAN": regex.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "IP": regex.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    "SSN": regex.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "CARD": regex.compile(r"(?<![\p{L}\d-])\d(?:[ -]?\d){12,18}(?![\p{L}\d])"),
    "PHONE": regex.compile(r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\p{L}\d])|(?<![\p{L}\d])\+\d{8,14}(?!\d)"),
    # groups of two digits, as in 06 12 34 56 78, +33 6 12 34 56 78, 91 234 56 78 and 612 34 56 78
    "PHONE2": regex.compile(r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,4}\)?(?:[ .-]\d{3})?(?:[ .-]\d{2}){2,5}|\(?0\d{1,3}\)?(?:[ .-]\d{2}){3,5}|\(?\d{2,3}\)?[ .-]\d{3}(?:[ .-]\d{2}){2}|[6-9]\d{2}(?:[ .-]\d{2}){3})(?![\p{L}\d])"),
    "SECRET": regex.compile(r"\b[0-9a-fA-F]{32,}\b|(?<=\b(?:token|secret|password|passwd|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"']{8,}", regex.I),
    "NAME": regex.compile(rf"\b(?P<title>{_TITLE})\.?[ \t]+(?P<names>{_PART}(?:[ \t]+{_PART})*)"),
}
#: a text without any of these holds nothing to find
_HINT = regex.compile(rf"[@\d]|\b(?:{_TITLE})\b|token|secret|passw|api_?key", regex.I)
Find = tuple[int, int, str, str]


def luhn(digits: str) -> int:
    """The digit that makes ``digits`` plus it valid."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def _only(text: str, test: Callable[[str], bool]) -> str:
    return "".join(c for c in text if test(c))


def finds(text: str) -> list[Find]:
    """(start, end, type, normal form) of all entities, by start, none overlapping."""
    if not _HINT.search(text):
        return []
    out: list[Find] = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            s, e = m.span()
            found = m.group()
            digits = _only(found, str.isdigit)
            if kind == "NAME":
                gender = GENDER[m["title"].casefold()]
                names, s = m["names"], m.start("names")
                if own := _OWN.search(names):  # the name ends before a possessive
                    names = names[: own.start()]
                if _WORD.search(names):
                    out.append((s, s + len(names), f"NAME_{gender}", " ".join(names.casefold().split())))
                continue
            if kind == "CARD" and not (len(digits) == 16 or luhn(digits[:-1]) == int(digits[-1])):
                continue
            if kind in ("PHONE", "PHONE2") and not 7 <= len(digits) <= 15:
                continue
            if kind == "PHONE2":
                # without country code and the zero that stands for it
                out.append((s, e, "PHONE", _TRUNK.sub("", found).lstrip("0") or digits))
                continue
            normal = {"EMAIL": found.lower(), "IBAN": found.replace(" ", ""), "IP": found, "SECRET": found}.get(kind, digits[-10:] if kind == "PHONE" else digits)
            out.append((s, e, kind, normal))
    order = {k: i for i, k in enumerate(PATTERNS)}
    out.sort(key=lambda f: (f[0], -f[1], order.get(f[2], 9)))
    kept, at = [], 0
    for f in out:
        if f[0] >= at:
            kept.append(f)
            at = f[1]
    return sorted(kept + mentions(text, kept))


def mentions(text: str, found: list[Find]) -> list[Find]:
    """Where parts of the names in ``found`` stand in the rest of the text; given names and a surname in a row are one find."""
    known: dict[str, str] = {}
    for f in found:
        if f[2].startswith("NAME"):
            for kind, part in entities(f):
                known.setdefault(part, kind)
    if not known:
        return []
    any_part = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(regex.escape(p) for p in sorted(known, key=len, reverse=True)) + r")(?![\p{L}\p{N}])", regex.I | regex.F)
    starts, single = [f[0] for f in found], []
    for m in any_part.finditer(text):
        s, e = m.span()
        i, part = bisect_right(starts, s), m[0].casefold()
        if m[0][0].isupper() and part in known and not (i and found[i - 1][1] > s) and not (i < len(found) and starts[i] < e):
            single.append((s, e, known[part], part))
    out, given = [], []
    for f in single:
        if given and (f[2] not in ("SURNAME", given[-1][2]) or text[given[-1][1]: f[0]].strip(" \t") or f[0] == given[-1][1]):
            out, given = out + given, []
        if f[2] != "SURNAME":
            given.append(f)
        elif given:
            out.append((given[0][0], f[1], f"NAME_{given[0][2][-1]}", " ".join(g[3] for g in (*given, f))))
            given = []
        else:
            out.append(f)
    return out + given


def entities(find: Find) -> list[tuple[str, str]]:
    """What a find stands for: names are made of parts, each an entity of its own."""
    kind, normal = find[2], find[3]
    if kind.startswith("NAME"):
        *given, surname = _WORD.findall(normal)
        return [(f"GIVEN_{kind[-1]}", g) for g in given] + [("SURNAME", surname)]
    if kind == "EMAIL":
        local, domain = normal.rsplit("@", 1)
        return [("EMAIL", normal), ("DOMAIN", domain)]
    return [(kind, normal)]


class Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.key, self.message, self.block, self.pool = key, f"{kind}\0{normal}\0{attempt}".encode("utf-8", "surrogatepass"), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 32:
            self.pool = int.from_bytes(hmac.digest(self.key, self.message + self.block.to_bytes(4, "big"), hashlib.sha256), "big")
            self.block, self.left = self.block + 1, 256
        v = self.pool & 0xFFFFFFFF
        self.pool, self.left = self.pool >> 32, self.left - 32
        return v * n >> 32


#: letters by script, consonants and vowels (fixed values)
SCRIPTS = {"latin": ("bcdfghjklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζθκλμνπρστ", "αειου")}
ENDINGS = {"latin": {"f": "a", "m": "o", "n": "e"}, "cyrillic": {"f": "а", "m": "й", "n": "е"}, "greek": {"f": "α", "m": "ς", "n": "ι"}}


def script_of(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def word(stream: Stream, length: int, script: str, ending: str = "") -> str:
    """A pronounceable lower-case word."""
    consonants, vowels = SCRIPTS[script]
    n = max(3, length) - len(ending)
    return "".join((consonants if k % 2 == 0 else vowels)[stream.below(len((consonants, vowels)[k % 2]))] for k in range(n)) + ending


def same_kind(stream: Stream, text: str) -> str:
    """Digits for digits, hexadecimal letters for such, else letters of the same script; all other characters stay."""
    hexadecimal = bool(regex.fullmatch(r"[0-9a-fA-F]+", text))
    out = []
    for c in text:
        if c.isdigit():
            out.append("0123456789"[stream.below(10)])
        elif c.isalpha():
            letters = "abcdef" if hexadecimal else "".join(SCRIPTS[script_of(c)])
            n = letters[stream.below(len(letters))]
            out.append(n.upper() if c.isupper() else n)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, normal: str, attempt: int) -> str:
    """The replacement in normal form."""
    s = Stream(key, kind, normal, attempt)
    if kind.startswith("GIVEN"):
        script = script_of(normal)
        return word(s, min(12, max(4, len(normal))), script, ENDINGS[script][kind[-1]])
    if kind == "SURNAME":
        return word(s, min(14, max(5, len(normal))), script_of(normal))
    if kind == "DOMAIN":
        *labels, top = normal.split(".")
        return ".".join([*(word(s, max(5, len(x)), "latin") for x in labels), top])
    if kind == "EMAIL":
        return same_kind(s, normal.rsplit("@", 1)[0])
    if kind == "IP":
        return ".".join(str(v) for v in (11 + s.below(80), s.below(256), s.below(256), 1 + s.below(254)))
    if kind == "CARD":
        body = normal[0] + "".join(str(s.below(10)) for _ in normal[1:-1])
        last = luhn(body)
        return body + str(last if luhn(normal[:-1]) == int(normal[-1]) else (last + 1 + s.below(9)) % 10)
    if kind == "IBAN":
        body = same_kind(s, normal[4:])
        number = int("".join(str(int(c, 36)) for c in body + normal[:2] + "00"))
        return f"{normal[:2]}{98 - number % 97:02d}{body}"
    return same_kind(s, normal)


def laid_out(find: Find, text: str, new: dict[tuple[str, str], str]) -> str:
    """The replacement in the format of the text it replaces."""
    start, end, kind, normal = find
    old = text[start:end]
    if kind.startswith(("NAME", "GIVEN", "SURNAME")):
        parts = [new[e] for e in entities(find)]
        out = iter(parts)
        return _WORD.sub(lambda m: (lambda w: w.upper() if m[0].isupper() and len(m[0]) > 1 else w.capitalize())(next(out)), old)
    if kind == "EMAIL":
        return new["EMAIL", normal] + "@" + new["DOMAIN", normal.rsplit("@", 1)[1]]
    fresh = new[kind, normal]
    if kind in ("CARD", "PHONE", "SSN", "IBAN"):
        # a country code in front of a phone number stays
        chars = [c for c in old if c.isalnum()]
        fresh = "".join(chars[: len(chars) - len(fresh)]) + fresh
        out = iter(fresh)
        return "".join(next(out) if c.isalnum() else c for c in old)
    return fresh


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int, int]:
    """(new text, number of finds, number of different entities)."""
    found = finds(text)
    new = {e: surrogate(key, *e, attempts.get(e, 0)) for f in found for e in entities(f)}
    out, at = [], 0
    for f in found:
        out += [text[at: f[0]], laid_out(f, text, new)]
        at = f[1]
    return "".join([*out, text[at:]]), len(found), len({f[2:] for f in found})


def settled(found: DataFrame, key: bytes) -> DataFrame:
    """kind, normal, attempt of the distinct entities: no surrogate equals another or a real entity of its type."""
    scratch = Scratch(found.sparkSession)

    @F.pandas_udf(T.StringType())
    def draw(kind: pd.Series, normal: pd.Series, attempt: pd.Series) -> pd.Series:
        # a mail's surrogate is its local part; its domain's surrogate is made from the first draw, so mails of one domain differ in the local part
        return pd.Series([surrogate(key, k, n, int(a)) + ("@" + n.rsplit("@", 1)[1] if k == "EMAIL" else "") for k, n, a in zip(kind, normal, attempt)])

    table = scratch.keep(found.select("kind", "normal", F.lit(0).alias("attempt")))
    real = table.select("kind", F.col("normal").alias("new")).withColumn("real", F.lit(True))
    for _ in range(ATTEMPTS):
        drawn = scratch.keep(table.withColumn("new", draw("kind", "normal", "attempt")))
        owner = drawn.groupBy("kind", "new").agg(F.min("normal").alias("owner"))
        judged = drawn.join(owner, ["kind", "new"]).join(real, ["kind", "new"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | (F.col("owner") != F.col("normal"))
        after = scratch.keep(judged.select("kind", "normal", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")))
        open_ = after.filter("again").limit(1).count()
        scratch.release(drawn)
        table = after.drop("again")
        if not open_:
            return table
    raise RuntimeError("surrogates still collide; the formats leave too few of them")


def with_surrogates(documents: DataFrame, key: bytes = KEY) -> DataFrame:
    """All columns of ``documents`` as struct ``row``, with text, n_entities and n_distinct."""
    rows = documents.select(F.struct("*").alias("row"), F.col("text"), F.xxhash64("text").alias("h"))

    def look(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(h, *e) for h, t in zip(frame["h"], frame["text"]) if t for e in {e for f in finds(t) for e in entities(f)}], columns=["h", "kind", "normal"])

    seen = Scratch(documents.sparkSession).keep(rows.select("h", "text").mapInPandas(look, "h long, kind string, normal string"))
    later = settled(seen.select("kind", "normal").distinct(), key).filter("attempt > 0")
    by_text = seen.distinct().join(later, ["kind", "normal"]).groupBy("h").agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias("later"))

    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType()), T.StructField("n_distinct", T.LongType())])

    @F.pandas_udf(result)
    def replace(text: pd.Series, later: pd.Series) -> pd.DataFrame:
        out = [(None, 0, 0) if t is None else replaced(t, key, {(x["kind"], x["normal"]): x["attempt"] for x in (more if more is not None else ())}) for t, more in zip(text, later)]
        return pd.DataFrame(out, columns=["text", "n_entities", "n_distinct"])

    return rows.join(by_text, "h", "left").select("row", replace("text", "later").alias("new")).select("row", "new.text", "new.n_entities", "new.n_distinct")
