"""Secret scans: rules for known forms, and windows of high entropy in candidate strings."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame

from tracklight.llm.common import map_texts, unused

# The base rules, in the order of their kinds, with the shortest length that counts.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
KINDS = ("assign", "access", "hex", "entropy")

#: Strings that may hold a secret, and the window that slides over them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Least bits per character of a window, by the class of its characters.
HEX_BITS, BASE36_BITS, BASE64_BITS = 3.0, 3.4, 3.7
#: Candidates that only look random: UUIDs, and digests by name in hex or in base64 of their length.
ALLOWED = re.compile(
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    r"|(?:sha(?:1|256|384|512)|md5)[-_=][0-9a-f]{8,128}"
    r"|md5[-_=][a-z0-9+/_-]{22}(?:==)?|sha1[-_=][a-z0-9+/_-]{27}=?|sha256[-_=][a-z0-9+/_-]{43}=?"
    r"|sha384[-_=][a-z0-9+/_-]{64}|sha512[-_=][a-z0-9+/_-]{86}(?:==)?",
    re.IGNORECASE | re.ASCII,
)
#: Windows that overlap one of these do not count; the rest of their candidate does.
ALLOWED_WORDS = re.compile(
    r"example|sample|placeholder|abcdefgh|01234567|x{6,}", re.IGNORECASE | re.ASCII
)
_HEX_LOWER, _HEX_UPPER = frozenset("abcdef"), frozenset("ABCDEF")
_ENTROPY_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the base rules find, by start, then kind as listed."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Unions of windows whose entropy reaches the least bits of their character class."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        string = m.group()
        if ALLOWED.fullmatch(string) or not any("0" <= c <= "9" for c in string):
            continue  # every class asks for a digit
        words = [w.span() for w in ALLOWED_WORDS.finditer(string)]
        near = 0
        for at in _random_windows(string):
            while near < len(words) and words[near][1] <= at:
                near += 1
            if near < len(words) and words[near][0] < at + WINDOW:
                continue
            start = m.start() + at
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], start + WINDOW)
            else:
                found.append((start, start + WINDOW))
    return found


def _random_windows(string: str):
    """Starts of the windows that count. One step takes a character in and one out of the counts."""
    counts: dict[str, int] = {}
    classes = [0] * 6  # digits, a-f, g-z, A-F, G-Z, others
    terms = 0.0
    for i, c in enumerate(string):
        if i >= WINDOW:
            old = string[i - WINDOW]
            n = counts[old]
            terms += _ENTROPY_TERM[n - 1] - _ENTROPY_TERM[n]
            counts[old] = n - 1
            classes[_class(old)] -= 1
        n = counts.get(c, 0)
        terms += _ENTROPY_TERM[n + 1] - _ENTROPY_TERM[n]
        counts[c] = n + 1
        classes[_class(c)] += 1
        if i >= WINDOW - 1:
            least = _least_bits(classes)
            if least is not None and math.log2(WINDOW) - terms / WINDOW >= least:
                yield i - WINDOW + 1


def _class(c: str) -> int:
    if "0" <= c <= "9":
        return 0
    if "a" <= c <= "z":
        return 1 if c in _HEX_LOWER else 2
    if "A" <= c <= "Z":
        return 3 if c in _HEX_UPPER else 4
    return 5


def _least_bits(classes: list[int]) -> float | None:
    """The threshold of a window's class; None for words and numbers, which no class takes in."""
    digits, lower, upper = classes[0], classes[1] + classes[2], classes[3] + classes[4]
    if digits < 2 or lower + upper < 2:
        return None
    if lower and upper:
        return BASE64_BITS
    if classes[5]:
        return None
    return BASE36_BITS if classes[2] + classes[4] else HEX_BITS


def scan(text: str) -> dict:
    """All that is found in one text; positions are code points, ends are exclusive."""
    base = base_spans(text)
    more = [(start, end, "entropy") for start, end in entropy_spans(text)]
    spans = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    counts = {f"n_{k}": sum(s[2] == k for s in spans) for k in KINDS}
    return counts | {"base": _joined(base), "spans": _joined(spans)}


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Add what `scan` finds in each whole text to the other columns of `docs`.

    New columns: n_assign, n_access, n_hex, n_entropy (long), base_sha256, spans (string). NULL is
    an empty text: it has no spans. Rows are judged one by one, so repeated rows get equal results.
    A column of `docs` with one of the new names gives way. No rows give no rows.
    """

    def run(texts: list[bytes | None]) -> dict[str, list]:
        found = [scan((t or b"").decode()) for t in texts]
        out = {f"n_{k}": [f[f"n_{k}"] for f in found] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(f["base"].encode()).hexdigest() for f in found]
        out["spans"] = [f["spans"] for f in found]
        return out

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_texts(docs, run, f"{counts}, base_sha256 string, spans string")


def without_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; texts without spans stay as they are.

    NULL stays NULL. Spans that touch or overlap become one, named after the first.
    """

    def run(texts: list[bytes | None]) -> dict[str, list]:
        return {clean: [None if t is None else masked(t.decode()) for t in texts]}

    clean = unused("clean", docs)
    masked_texts = map_texts(docs, run, f"{clean} string")
    return masked_texts.withColumnRenamed(clean, "text").select(*[f"`{c}`" for c in docs.columns])


def masked(text: str) -> str:
    merged: list[list] = []
    for start, end, kind in sorted(
        base_spans(text) + [(s, e, "entropy") for s, e in entropy_spans(text)],
        key=lambda s: (s[0], KINDS.index(s[2])),
    ):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, at = [], 0
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]
