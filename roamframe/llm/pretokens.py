"""Split texts into the pre-tokens of a public BPE tokenizer, fast where that is exact.

A text whose characters all lie in ranges on which Python's character classes equal the library's is
split with one compiled pattern; any other text goes through the library's own normalizer and
pre-tokenizer. Both give the same pieces; tests compare them.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

from tokenizers import Tokenizer

#: Characters on which the fast patterns and the library agree: control characters that both take for
#: neither space nor word, ASCII, Latin without superscript digits and fractions, Greek, Cyrillic, dashes, quotes,
#: currency, kana, unified ideographs, Hangul syllables.
_SAFE = (
    r"\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ȶΑ-ΡΣ-ώЀ-ҁҊ-ӿ"
    r"‐-‧‰-⁞€、-〃ぁ-ゔァ-ヺ一-龥가-힣！-／"
)
_UNSAFE = re.compile(f"[^{_SAFE}]")

#: The split patterns of the two tokenizers, in Python's character classes.
FAST = {
    "bytes": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    "words": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"),
}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
LETTER_BYTES = {ord(c): b for b, c in BYTE_LETTERS.items()}


def letters(piece: str) -> str:
    """A piece as byte-level vocabularies spell it."""
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_LETTERS)


class Splitter:
    """The pre-tokens, model and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: The model alone: a string goes to the merges as it is.
        self.model = Tokenizer(self.library.model)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        self.special = added
        by_length = sorted(added, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if added else None
        pre = spec["pre_tokenizer"]
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None:
            self.kind = "bytes"
        elif pre["type"] == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
            self.kind = "words"
        else:
            raise ValueError("this kind of pre-tokenizer is not supported")
        self._fast = FAST[self.kind].findall
        self.fold = self.kind == "words"

    def segments(self, text: str) -> list[str]:
        """The text between special strings and, at odd places, the special strings."""
        return self._special.split(text) if self._special else [text]

    def pieces(self, segment: str) -> list[str]:
        """The pre-tokens of a text without special strings, normalised."""
        if _UNSAFE.search(segment) is None:
            if self.fold:
                if not unicodedata.is_normalized("NFC", segment):
                    segment = unicodedata.normalize("NFC", segment)
                # Letter by letter, as the library does: no final form of sigma.
                segment = segment.replace("Σ", "σ").lower()
            return self._fast(segment)
        return self.library_pieces(segment)

    def library_pieces(self, segment: str) -> list[str]:
        if self.library.normalizer is not None:
            segment = self.library.normalizer.normalize_str(segment)
        return [segment[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(segment)]


@functools.lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    """One per process and file; the path must be readable where this runs."""
    return Splitter(path)
