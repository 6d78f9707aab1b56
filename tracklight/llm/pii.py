"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

A surrogate is a keyed permutation of the entity within its format: the digits, the letters of each
case and script, the bytes of an address or the places in a list of names are the digits of a mixed
number, and a Feistel network over its two halves maps each number to another one. So equal entities
have equal surrogates in all documents, and different ones different surrogates, without a table of
entities. `collisions` checks this over all entities of a corpus.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import map_texts, unused
from tracklight.session import shared_dir

KEY = b"surrogates"
ROUNDS = 8

# How entities look. Where two start at one place, the first kind counts, but for
# e-mail addresses, which come before all and are sought from their @ outwards.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Herr|Frau|Señora|Señor|Monsieur|Madame|Mme)"
KINDS = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
    "ip6": rf"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{{2,39}}(?:(?<=:){_OCTET}(?:\.{_OCTET}){{3}})?(?![\w:]|\.[0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ -]?)?\([0-9]{3}\)[ -]?[0-9]{3}[ -][0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ -][0-9]{2,4}){2,4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": rf"\b{_TITLE}\.? +[^\W\d_]\w+(?: [^\W\d_a-z]\w+)?",
}
#: What every entity of a kind has. Most texts have few of these, and need no search for the others.
_SIGNS = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}"),
    "ip6": re.compile(r":[0-9A-Fa-f]{0,4}:"),
    "ip": re.compile(r"[0-9]\.[0-9]{1,3}\.[0-9]"),
    "phone": re.compile(r"\([0-9]{3}\)|\+[0-9]{1,3}[ -][0-9]|[0-9]{3}-[0-9]{3}-"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){12}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-"),
    "person": re.compile(rf"{_TITLE}[. ]"),
}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_UNCHECKED = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items() if k not in ("iban", "ip6")))
_TITLES = re.compile(rf"{_TITLE}\.? +")

# Given names by gender. A name in a list is replaced by one of the same list.
FEMALE = (
    "Anna Emma Maria Sofia Laura Julia Clara Elena Alice Lucia Marta Nora Paula Rosa Sarah Eva "
    "Carmen Ines Louise Marie Camille Chloe Greta Heidi Ingrid Johanna Katrin Mary Linda Susan"
).split()
MALE = (
    "Peter Paul John James Robert Michael David Thomas Daniel Martin Hans Karl Otto Fritz Jonas "
    "Pablo Carlos Diego Javier Luis Pierre Jean Louis Henri Jacques Antoine Hugo Oscar Felix Max"
).split()
_LISTED = {n: names for names in (tuple(FEMALE), tuple(MALE)) for n in names}

# Ranges of letters, by script and case.
_ALPHABETS = [
    (start, end)
    for start, end in (
        ("0", "9"), ("a", "z"), ("A", "Z"), ("à", "ö"), ("ø", "ÿ"), ("À", "Ö"), ("Ø", "Þ"), ("α", "ρ"),
        ("σ", "ω"), ("Α", "Ρ"), ("Σ", "Ω"), ("а", "я"), ("А", "Я"), ("א", "ת"), ("ء", "غ"), ("अ", "ह"),
        ("ぁ", "ん"), ("ァ", "ン"), ("一", "鿿"), ("가", "힣"),
    )
]


def _permuted(values: list[int], radices: list[int], label: str, key: bytes) -> list[int]:
    """A keyed permutation of the numbers with these digits; `label` names the format."""
    half = len(values) // 2
    sizes = [_product(radices[:half]), _product(radices[half:])]
    parts = [_number(values[:half], radices[:half]), _number(values[half:], radices[half:])]
    for r in range(ROUNDS):
        here, other = r % 2, 1 - r % 2
        told = f"{label}|{radices}|{r}|{parts[other]}".encode()
        step = int.from_bytes(hashlib.blake2b(told, key=key[:64], digest_size=32).digest(), "big")
        parts[here] = (parts[here] + step) % sizes[here]
    return _digits(parts[0], radices[:half]) + _digits(parts[1], radices[half:])


def _product(radices: list[int]) -> int:
    out = 1
    for r in radices:
        out *= r
    return out


def _number(values: list[int], radices: list[int]) -> int:
    out = 0
    for v, r in zip(values, radices):
        out = out * r + v
    return out


def _digits(number: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        number, v = divmod(number, r)
        out.append(v)
    return out[::-1]


def _alphabet(c: str) -> tuple[str, str] | None:
    return next(((a, b) for a, b in _ALPHABETS if a <= c <= b), None)


def _reformed(text: str, label: str, key: bytes, keep: frozenset[int] = frozenset()) -> str:
    """Permute letters and digits within their alphabets; all else and the places in `keep` stay.

    What stays is a part of the format, so texts that differ there are permuted apart.
    """
    spots = [(i, a) for i, c in enumerate(text) if i not in keep and (a := _alphabet(c))]
    if not spots:
        return text
    out = list(text)
    for i, (a, _) in spots:
        out[i] = a
    values = [ord(text[i]) - ord(a) for i, (a, _) in spots]
    radices = [ord(b) - ord(a) + 1 for _, (a, b) in spots]
    for (i, (a, _)), v in zip(spots, _permuted(values, radices, f"{label}|{''.join(out)}", key)):
        out[i] = chr(ord(a) + v)
    return "".join(out)


def _name(name: str, key: bytes) -> str:
    names = _LISTED.get(name)
    if names:
        return names[_permuted([names.index(name)], [len(names)], "|".join(names), key)[0]]
    out = _reformed(name, "name", key)
    while out in _LISTED:  # walk on until outside the lists, which keeps it a permutation
        out = _reformed(out, "name", key)
    return out


def _luhn(digits: list[int]) -> int:
    """The check digit that makes the digits valid."""
    doubled = [d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
    return -sum(doubled) % 10


def _card(text: str, key: bytes) -> str:
    """The first digit stays, and the last is as right or wrong as it was."""
    at = [i for i, c in enumerate(text) if c.isdigit()]
    digits = [int(text[i]) for i in at]
    off = (digits[-1] - _luhn(digits[:-1])) % 10
    # The last digit follows from the others and `off`; it must not be a part of the format.
    marked = text[: at[-1]] + "#" + text[at[-1] + 1 :]
    out = list(_reformed(marked, f"card|{off}", key, frozenset({at[0]})))
    out[at[-1]] = str((_luhn([int(out[i]) for i in at[:-1]]) + off) % 10)
    return "".join(out)


def _iban_check(country: str, account: str) -> int:
    rearranged = account + country + "00"
    return 98 - int("".join(str(int(c, 36)) for c in rearranged)) % 97


def _is_iban(text: str) -> bool:
    return int(text[2:4]) == _iban_check(text[:2], text[4:])


def _iban_end(text: str) -> int | None:
    """Where an IBAN ends that starts the text: the longest in groups of four, else in any groups."""
    ends = [i for i in range(len(text), 14, -1) if i == len(text) or text[i] == " "]
    fours = [e for e in ends if all(len(g) == 4 for g in text[:e].split(" ")[:-1]) and len(text[:e].split(" ")[-1]) <= 4]
    for e in fours + ends:
        whole = text[:e].replace(" ", "")
        if len(whole) >= 15 and _is_iban(whole):
            return e
    return None


def _is_ip6(text: str) -> bool:
    """Valid, and no mere pair of words such as a::b."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any(c.isdigit() for c in text) or len([g for g in text.split(":") if g]) > 2


def _ip6(text: str, key: bytes) -> str:
    """Digits and letters a-f of each case are permuted; colons stay, and an IPv4 tail goes by itself."""
    head, tail = text, ""
    if "." in text:
        head, tail = text[: text.rindex(":") + 1], surrogate("ip", text[text.rindex(":") + 1 :], key)
    first = ["0" if c.isdigit() else "a" if c.islower() else "A" for c in head if c != ":"]
    values = [ord(c) - ord(a) for c, a in zip(head.replace(":", ""), first)]
    shape, of = "".join(first), iter(first)
    shape = "".join(c if c == ":" else next(of) for c in head)
    if values:
        values = _permuted(values, [10 if a == "0" else 6 for a in first], f"ip6|{shape}", key)
    new = iter(chr(ord(a) + v) for a, v in zip(first, values))
    return "".join(c if c == ":" else next(new) for c in head) + tail


def surrogate(kind: str, text: str, key: bytes = KEY) -> str:
    """The replacement of an entity: the same for equal entities, another for any other one."""
    if kind == "email":
        last = text.rindex(".")
        return _reformed(text, kind, key, frozenset(range(last, len(text))))
    if kind == "ip" and ":" in text:
        return _ip6(text, key)
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        return ".".join(map(str, _permuted(octets, [256] * 4, kind, key)))
    if kind == "iban":
        whole = text.replace(" ", "")
        account = _reformed(whole[4:], f"iban|{whole[:2]}", key)
        new = iter(f"{whole[:2]}{_iban_check(whole[:2], account):02d}{account}")
        return "".join(c if c == " " else next(new) for c in text)
    if kind == "card":
        return _card(text, key)
    if kind == "person":
        titled = _TITLES.match(text)
        title = titled.end() if titled else 0
        return text[:title] + " ".join(_name(n, key) for n in text[title:].split(" "))
    kept = 0
    if kind == "phone" and text[0] == "+":
        kept = re.match(r"\+[0-9]+", text).end()
    return _reformed(text, kind, key, frozenset(range(kept)))


@functools.cache
def _pattern(kinds: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{KINDS[k]})" for k in kinds))


def _emails(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the @, end) of the addresses; each character is looked at once."""
    found, least, at = [], 0, text.find("@")
    while at >= 0:
        start, domain = at, _DOMAIN.match(text, at + 1)
        if domain:
            while start > least and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                found.append((start, at, domain.end()))
        least = at + 1
        at = text.find("@", least)
    return found


def _next(pattern: re.Pattern | None, text: str, at: int, emails: list[tuple[int, int, int]]):
    """(start, end, kind, text) of the first entity from `at` on."""
    while emails and emails[0][1] <= at:
        emails.pop(0)
    m = pattern.search(text, at) if pattern else None
    if emails:
        start, end = max(emails[0][0], at), emails[0][2]
        if m is None or start <= m.start():
            return start, end, "email"
    return (m.start(), m.end(), m.lastgroup) if m else None


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, from left to right, without overlaps.

    Names behind a title, and their capitalised words, are found in the whole text, titled or not.
    """
    found, at = [], 0
    kinds = tuple(k for k, sign in _SIGNS.items() if sign.search(text))
    pattern, emails = _pattern(kinds) if kinds else None, _emails(text)
    while m := _next(pattern, text, at, emails):
        start, end, kind = m
        at = end
        if kind == "iban":
            size = _iban_end(text[start:end])
            if size is None:  # a block is passed over as a whole; spaced groups may be something else
                first = text[start:end].split(" ")[0]
                at = start + (len(first) if len(first) >= 15 else 1)
                m = _UNCHECKED.match(text, start) if at == start + 1 else None
                if m is None:
                    continue
                end, kind = m.end(), m.lastgroup
            else:
                end = start + size
            at = end
        if kind == "ip6":
            if not _is_ip6(text[start:end]):
                m = _UNCHECKED.match(text, start)
                if m is None:
                    at = start + 1
                    continue
                end, kind = m.end(), m.lastgroup
                at = end
            else:
                kind = "ip"
        found.append((start, end, kind))
    names = {text[s:e][_TITLES.match(text[s:e]).end() :] for s, e, kind in found if kind == "person"}
    names |= {w for n in names for w in n.split(" ") if not w[0].islower()}
    if not names:
        return found
    mentions = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)")
    out, at = [], 0
    for start, end, kind in [*found, (len(text), len(text), "")]:
        out += [(m.start(), m.end(), "person") for m in mentions.finditer(text, at, start)]
        out.append((start, end, kind))
        at = end
    return out[:-1]


def replaced(text: str, key: bytes = KEY) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, kind, entity, surrogate) of each."""
    out, at, found = [], 0, []
    for start, end, kind in entities(text):
        new = surrogate(kind, text[start:end], key)
        out += [text[at:start], new]
        found.append((start, end, kind, text[start:end], new))
        at = end
    return "".join(out) + text[at:], found


_FOUND = "array<struct<start: int, end: int, kind: string, entity: string, surrogate: string>>"


def detected(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """`docs` with `found`, the entities of each whole text with their surrogates, and the new text.

    NULL has no entities and stays NULL. A column of `docs` named found gives way.
    """
    new_text = unused("new_text", docs)

    def run(texts: list[bytes | None]) -> dict[str, list]:
        names = ("start", "end", "kind", "entity", "surrogate")
        made = [replaced((t or b"").decode(), key) for t in texts]
        return {
            "found": [[dict(zip(names, f)) for f in found] for _, found in made],
            new_text: [None if t is None else new for t, (new, _) in zip(texts, made)],
        }

    return map_texts(docs, run, f"found {_FOUND}, {new_text} string").withColumnRenamed(new_text, "text")


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate, entities): surrogates that stand for more than one entity. None should.

    Entities are made distinct before the shuffle, so a frequent one weighs no more than others.
    """
    pairs = found.select(F.inline("found")).select("kind", "entity", "surrogate").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("entities")).where("entities > 1")


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Replace the entities of each whole text: `docs` with new texts, n_entities (long) and spans.

    `spans` lists kind:start:end of the entities in code points of the old text, joined by commas.
    Texts are searched once: what was found is written to the shared folder, checked for collisions
    over all documents, and read back; if there are any, ValueError is raised. NULL stays NULL and
    has no entities; rows are treated one by one, so repeated rows get equal results. A column of
    `docs` named found, n_entities or spans gives way. No rows give no rows.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "surrogates")
    detected(docs, key).write.parquet(folder)
    made = spark.read.parquet(folder)
    clash = collisions(made).limit(3).collect()
    if clash:
        raise ValueError(f"surrogates of several entities: {clash}")
    span = F.transform("found", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    kept = [c for c in made.columns if c.lower() not in ("found", "n_entities", "spans")]
    return made.select(
        *[F.col(f"`{c}`") for c in kept], F.size("found").cast("long").alias("n_entities"), F.array_join(span, ",").alias("spans")
    )
