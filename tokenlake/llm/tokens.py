"""Exact, cached encoding with the tokenizers library.

Almost all words of a corpus recur, so the byte-pair merges of a piece of text between white spaces are looked up
in a bounded cache; only new pieces reach the model. A text with characters outside a safe range (where
normalisation or Unicode tables could matter), or with an added token such as `<|endoftext|>` in it, is encoded whole by
the library as delivered, so ids are the library's own always.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

#: Safe: ASCII but control characters, Latin-1 and Latin Extended without the dotted capital I: here NFC changes
#: nothing, lower case is one code point to one, and all Unicode versions agree on letters and digits. The letters that
#: stand for a space and a line's end in byte-level vocabularies (U+0120, U+010A) are marks here, so they are not safe.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u0109\u010b-\u011f\u0121-\u012f\u0131-\u024f]")
#: The pre-tokenizer patterns of the two public vocabularies, over the safe range.
LETTER, DIGIT = r"[^\W\d_]", r"[0-9²³¹¼½¾]"
WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?![²³¹¼½¾]){LETTER})+|{DIGIT}|(?:(?!{LETTER}|{DIGIT})\S|[²³¹¼½¾])+?(?=\s|{LETTER}|{DIGIT}|$)")
BYTE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?(?:(?![²³¹¼½¾]){LETTER})+| ?{DIGIT}+| ?(?:(?!{LETTER}|{DIGIT})\S)+|\s+")
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Entries in either of the two generations of a worker's cache.
CACHE = 350_000
#: White space whose runs a byte-level vocabulary does not cut one by one.
RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")


def byte_letters() -> dict[int, str]:
    """Byte to printable character, as in byte-level vocabularies: printable Latin-1 stays, others follow U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """encode(text) gives the ids as little-endian bytes of `width` bytes each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        added = spec.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        names = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.lower = names == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence"
        self.fast = spec["model"]["type"] == "BPE" and (self.lower or spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space"))
        self.folded = [t["content"].lower() for t in added if t.get("normalized") and self.lower]
        self.letters = byte_letters()
        self.latin = {b: c for b, c in self.letters.items() if chr(b) != c}
        self.ends = {c: self.piece(c) for c in ".,"}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pack(self, ids) -> bytes:
        out = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token."""
        if not (text.isascii() and text.isalnum()):
            text = text.encode().decode("latin-1").translate(self.latin)
        return self.pack([t.id for t in self.model.tokenize(text)])

    def word(self, text: str) -> bytes:
        """The ids of letters, with or without the mark of a space before them: one pre-token that is in no cache."""
        if text.isascii() or text[0] == "Ġ" and text[1:].isascii():
            return self.pack([t.id for t in self.model.tokenize(text)])
        head, body = ("Ġ", text[1:]) if text[0] == "Ġ" and not self.lower else ("", text)
        return self.pack([t.id for t in self.model.tokenize(head + body.encode().decode("latin-1").translate(self.latin))])

    def cached(self, text: str) -> bytes:
        """The ids of one pre-token (a space before it, or a line's end, as its mark), which is a chunk of its own as well."""
        got = self.new.get(text) or self.old.get(text)
        if got is None:
            got = self.piece(text if self.lower else text.replace("Ġ", " ").replace("Ċ", "\n"))
            if len(text) <= 64:
                self.new[text] = got
        return got

    def chunk(self, text: str) -> bytes:
        """The ids of what stands between white spaces; most often a word, or one with a full stop or comma."""
        got = self.old.get(text)
        if got is None:
            last = text[-1]
            core = text[:-1] if last in self.ends else text
            letters = core[1:] if not self.lower and core[:1] == "Ġ" else core
            if letters.isalpha() and text != "Ċ":
                if core is text:
                    got = self.word(text)
                else:
                    head = self.new.get(core) or self.old.get(core)
                    if head is None:
                        head = self.word(core)
                        if len(core) <= 64:
                            self.new[core] = head
                    got = head + self.ends[last]
            elif self.lower:
                got = b"".join(map(self.cached, WORD_SPLIT.findall(text)))
            else:
                pieces = BYTE_SPLIT.findall(text.replace("Ġ", " ").replace("Ċ", "\n"))
                got = b"".join([self.cached(p.replace(" ", "Ġ").replace("\n", "Ċ")) for p in pieces])
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}
        if len(text) <= 64:
            self.new[text] = got
        return got

    def special(self, text: str) -> bool:
        """Whether the text may hold an added token, which the library finds before anything else."""
        return any(map(text.__contains__, self.added)) or any(t in text.lower() for t in self.folded)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.fast or UNSAFE.search(text) or self.special(text):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        if self.lower:
            chunks = text.lower().split()
        elif any(map(text.__contains__, RUNS)):
            chunks = CHUNK.findall(text)
        else:
            chunks = text.replace(" ", " Ġ").replace("\n", " Ċ ").split()
        parts, at = list(map(self.new.get, chunks)), -1
        try:
            while True:
                at = parts.index(None, at + 1)
                parts[at] = self.chunk(chunks[at])
        except ValueError:  # no further one
            return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file; its cache lasts as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
