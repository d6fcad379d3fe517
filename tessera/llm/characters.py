"""Where the Unicode tables of this Python differ from those of the tokenizer libraries, found by asking the libraries.

Each library brings the tables of some Unicode version. Letters, numbers, white space and normal forms that a faster path
takes from Python are compared here, once in the driver, with what the library itself says about every code point.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata

CLASSES = ("\\p{L}", "\\p{N}", "\\s")
# A character of each class, and of none, that no rule of a pattern names.
STAND_INS = ("ä", "٠", " ", "§")


def code_points() -> str:
    """Every character but surrogates."""
    return "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))


def tiktoken_class(pattern: str) -> set[str]:
    """The characters that tiktoken's pattern engine matches."""
    import tiktoken

    single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(bytes(single.encode_ordinary(code_points())).decode())


@functools.cache
def stand_ins() -> dict[int, str]:
    """For characters whose class differs between `regex` and tiktoken: a character that both put into tiktoken's class."""
    import regex

    every, out = code_points(), {}
    theirs = [tiktoken_class(p) for p in CLASSES]
    for odd in set().union(*(set(regex.findall(p, every)) ^ t for p, t in zip(CLASSES, theirs, strict=True))):
        out[ord(odd)] = next((s for s, t in zip(STAND_INS, theirs, strict=False) if odd in t), STAND_INS[-1])
    return out


def _normal_forms(chars: str, normalise) -> list[list[str]]:
    """Each character alone, between marks of the lowest and the highest class, and after a letter."""
    text = normalise("\n".join(f"{c} a{c}̴ aͅ{c} e{c}" for c in chars))
    return [text.split()[k::4] for k in range(4)]


@functools.cache
def odd_characters(path: str) -> frozenset[str]:
    """Characters that the tokenizer at `path` may classify or normalise otherwise than Python does.

    Planes that hold no character or private ones only are left out: every version agrees on them.
    """
    import regex
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    chars = "".join(c for c in code_points() if (ord(c) < 0x40000 or 0xE0000 <= ord(c) < 0xE1000) and not 0xE000 <= ord(c) < 0xF900)
    odd: set[str] = set()
    theirs = []
    for p in CLASSES:
        split = pre_tokenizers.Split(Regex(f"[^{p}]+"), "removed")
        theirs.append(set("".join(x for x, _ in split.pre_tokenize_str(chars))))
        odd |= theirs[-1] ^ set(regex.findall(p, chars))
    odd |= theirs[0] ^ {c for c in chars if c.isalpha()}
    odd |= theirs[2] ^ {c for c in chars if c.isspace() and c not in "\x1c\x1d\x1e\x1f"}
    solid = "".join(c for c in chars if c not in theirs[2] and not c.isspace())
    mine = _normal_forms(solid, lambda s: unicodedata.normalize("NFC", s).replace("Σ", "σ").lower())
    for a, b in zip(mine, _normal_forms(solid, Tokenizer.from_file(path).normalizer.normalize_str), strict=True):
        odd |= {c for c, x, y in zip(solid, a, b, strict=True) if x != y}
    return frozenset(odd)
