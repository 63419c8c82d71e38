"""Cutting texts where the pre-tokenizer cannot match across, and caches of what it makes of the pieces."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space that no word takes: white space or the end of the text follows.
_LOOSE = re.compile(r" (?:\s|$)")


def text_chunks(text: str) -> list[str]:
    """Pieces that join to the text and that a byte-level pre-tokenizer never matches across.

    A word takes at most the one space before it, so there is always a boundary
    before a space that a non-space follows. Pieces are cut there only.
    """
    raw = text.split(" ")
    if not _LOOSE.search(text):
        return ([raw[0]] if raw[0] else []) + [" " + p for p in raw[1:]]
    out = [raw[0]] if raw[0] else []
    for p in raw[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        elif out:
            out[-1] += " " + p
        else:
            out.append(" " + p)
    return out


class Remembered(dict):
    """What ``make`` gives for a string or bytes, kept for the last ``entries`` short ones or fewer."""

    def __init__(self, make: Callable[[str | bytes], object], entries: int, longest: int = 64) -> None:
        self.make, self.entries, self.longest = make, entries, longest

    def __missing__(self, key: str | bytes) -> object:
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class WordCache:
    """Ids of a text, as little-endian 32-bit numbers, from the ids of its chunks and their words.

    ``encode_word`` gives the ids of one match of ``pattern``; both caches are bounded.
    """

    def __init__(self, encode_word: Callable[[str], bytes], pattern: str, entries: int = 600_000) -> None:
        import regex

        find = regex.compile(pattern).findall
        words = Remembered(encode_word, entries // 2)

        def chunk(text: str) -> bytes:
            core = text.rstrip(".,;:!?")
            if core[1:].isalpha() and core[0] == " ":  # letters, then a run of marks: what the pattern would match
                return words[core] + words[text[len(core) :]] if len(core) < len(text) else words[core]
            return b"".join([words[w] for w in find(text)])

        self.chunks = Remembered(chunk, entries)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text_chunks(text)))
