"""Texts through public tokenizers, a word at a time.

Byte-level BPE cuts a text before each space that stands between two characters that are not white
space, and sentence pieces never reach over such a space. So a text is the sum of its words, and
each distinct word of a task is encoded once. Words whose edges touch other white space stay
together. Where a tokenizer cuts in another way, whole texts are encoded.
"""

from __future__ import annotations

import json
import re


#: White space that can stand beside a space without being one.
SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace() and i != 0x20]
ASCII_SPACES = [c for c in SPACES if c.isascii()]
#: How byte-level BPE cuts plain words, which are ASCII without apostrophes and runs of white space.
_PARTS = re.compile(r" ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9\s]+|\s")
_PLAIN = re.compile(r"[!-&(-~]+(?:\s[!-&(-~]+)*", re.ASCII)
#: How it cuts whole texts of ASCII and the letters of Latin-1, apostrophes and white space included.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_LATIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_LATIN_PARTS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r 0-9{_LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def words(text: str) -> list[str]:
    """The text cut at single spaces; every word but the first had a space before it.

    A word starts or ends with white space, or is empty, only where the text does.
    """
    cut = text.split(" ")
    spaces = ASCII_SPACES if text.isascii() else SPACES
    if not ("  " in text or not cut[0] or not cut[-1] or any(c in text and _beside(text, c) for c in spaces)):
        return cut
    joined = cut[:1]
    for word in cut[1:]:
        if not word or not joined[-1] or word[0].isspace() or joined[-1][-1].isspace():
            joined[-1] += " " + word
        else:
            joined.append(word)
    return joined


def _beside(text: str, c: str) -> bool:
    return c + " " in text or " " + c in text


class Encoder:
    """Ids of whole texts by a tokenizer file of the `tokenizers` library, as little-endian bytes.

    Strings of special tokens in a text become these tokens, as the library has it by default, or
    are ordinary text with `plain_specials`.
    """

    #: Long words seldom come again; only short ones are kept, and no more of them than this.
    MOST_KNOWN = 600_000
    KEPT = 10
    #: Parts of texts, which come again more often, are kept up to this length, and given up
    #: when they were not met while so many others were.
    KEPT_PARTS = 14
    MOST_PARTS = 400_000

    def __init__(self, path: str, dtype: str = "<u4", plain_specials: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.dtype = dtype
        with open(path, encoding="utf-8") as file:
            self.cuttable = cuts_at_spaces(json.load(file))
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [] if plain_specials else [t.content for t in added]
        self.first, self.later, self.parts = {}, {}, {}
        self.known, self.older = {}, {}
        if self.cuttable:
            import numpy as np

            tokens = byte_level_tokens(self.tokenizer.get_vocab())
            self.spaced = np.array([t[:1] == b" " for t in tokens])

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [not self.cuttable or any(s in t for s in self.special) for t in texts]
        latin = [not w and _LATIN_TEXT.fullmatch(t) is not None for t, w in zip(texts, whole)]
        by_parts = iter(self._by_parts([t for t, is_latin in zip(texts, latin) if is_latin]))
        others = [(t, w) for t, w, is_latin in zip(texts, whole, latin) if not is_latin]
        by_words = iter(self._by_words([t for t, _ in others], [w for _, w in others]))
        return [next(by_parts if is_latin else by_words) for is_latin in latin]

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        """The ids of Latin texts, each distinct part encoded once."""
        if len(self.known) > self.MOST_PARTS:
            self.known, self.older = {}, self.known
        cut = [_LATIN_PARTS.findall(t) for t in texts]
        missing = set().union(*cut).difference(self.known)
        self.known.update((p, self.older[p]) for p in missing if p in self.older)
        new = list(missing.difference(self.older))
        self.known.update(zip(new, self._ids(new)))
        made = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > self.KEPT_PARTS:
                del self.known[p]
        return made

    def _by_words(self, texts: list[str], whole: list[bool]) -> list[bytes]:
        """The ids of texts by their words, or of the whole text."""
        cut = [None if w else words(t) for t, w in zip(texts, whole)]
        for known in (self.first, self.later, self.parts):
            if len(known) > self.MOST_KNOWN:
                known.clear()
        first, later = {c[0] for c in cut if c}, set().union(*(c[1:] for c in cut if c))
        first = [w for w in first if w not in self.first]
        self.first.update(zip(first, self._ids(first)))
        later = [w for w in later if w not in self.later]
        self._learn(later)
        encoded = iter(self._ids([t for t, w in zip(texts, whole) if w]))
        made = [
            next(encoded) if c is None else self.first[c[0]] + b"".join(map(self.later.__getitem__, c[1:]))
            for c in cut
        ]
        for known, new in ((self.first, first), (self.later, later)):
            for w in new:
                if len(w) > self.KEPT:
                    del known[w]
        return made

    def behind_spaces(self, new: list[str]) -> list[bytes]:
        """The ids of each of some distinct words with a space before it; only their parts are kept."""
        if len(self.parts) > self.MOST_KNOWN:
            self.parts.clear()
        if not self.cuttable:
            return self._ids([" " + w for w in new])
        self._learn(new)
        made = list(map(self.later.__getitem__, new))
        self.later.clear()
        return made

    def _learn(self, new: list[str]) -> None:
        """Learn new words that have a space before them; plain ones by their parts."""
        plain = [w for w in new if len(w) < 100 and _PLAIN.fullmatch(w)]
        parts = _PARTS.findall("".join([" " + w for w in plain]))
        unknown = [p for p in set(parts) if p not in self.parts]
        self.parts.update(zip(unknown, self._ids(unknown)))
        raw = list(map(self.parts.__getitem__, parts))
        starts = [i for i, p in enumerate(parts) if p[0] == " "]
        for w, i, j in zip(plain, starts, [*starts[1:], len(parts)]):
            self.later[w] = raw[i] if j - i == 1 else b"".join(raw[i:j])
        for p in unknown:
            if len(p) > self.KEPT + 1:
                del self.parts[p]
        if len(plain) < len(new):
            others = [w for w in new if w not in self.later]
            self.later.update(zip(others, self._ids([" " + w for w in others])))

    def _ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Plain words behind a space go in many at a time and are cut apart again."""
        import numpy as np

        joined = [t for t in texts if t[:1] == " " and t[1:].isalnum() and t.isascii()] if self.cuttable else []
        found = {}
        for i in range(0, len(joined), 1000):
            group = joined[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(group):
                raw, at = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
                found.update(zip(group, [raw[x:y] for x, y in zip(at, at[1:])]))
        rest = [t for t in texts if t not in found]
        made = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []
        found.update(zip(rest, [np.array(e.ids, self.dtype).tobytes() for e in made]))
        return [found[t] for t in texts]


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file describes byte-level BPE that cuts before spaces and keeps texts as they are."""
    before = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
    )


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Such vocabularies write printable bytes of Latin-1 as themselves and the others, in rising
    order, as the characters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    made = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        made[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return made


def sentence_piece_tokens(pieces: list[str]) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> one byte."""
    return [
        bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()
        for p in pieces
    ]
