"""Regex dialect used by the rule tables.

Rules are written once in a neutral notation (``\\b \\w \\s \\d``, Unicode aware). ``java_regex`` rewrites
those four escapes for Spark's Java engine, whose own versions are ASCII-only or vary between releases.
"""

from __future__ import annotations

import re
import string

# Character-class bodies. Single characters in a class of their own are answered from Java's Latin-1 bit table, and
# categories are only asked of what is not ASCII; ranges or categories first would each be a test of every character.
_ASCII_WORD = string.ascii_letters + string.digits + "_"
WORD = rf"[{_ASCII_WORD}][[^\x00-\x7f]&&[\p{{L}}\p{{N}}]]"
SPACE = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f][[^\x00-\x7f]&&[\x85\p{Z}]]"

# Every character removed by a Unicode-aware strip.
_WHITESPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE_CHARS = "".join(map(chr, _WHITESPACE_CODES))

_ESCAPE = re.compile(r"(\[?)\\([bwsd])(?=(.?))", re.DOTALL)
#: What follows an opening ``\\b``: one ASCII letter, or alternatives without groups that each begin with one; neither optional.
_LETTER = r"[A-Za-z](?![?*{])"
_OPENING = re.compile(rf"(?:{_LETTER}|\(\?:{_LETTER}[^()\[\]|]*(?:\|{_LETTER}[^()\[\]|]*)*\)(?![?*{{]))")


def first_letters(pattern: str) -> str:
    """The letters with which every match of ``pattern`` must begin, or none where they are not plain to see."""
    opening = _OPENING.match(pattern)
    return "".join(sorted(set(re.findall(r"(?:^|\(\?:|\|)([A-Za-z])", opening[0])))) if opening else ""


def java_regex(pattern: str, flags: str = "") -> str:
    """Rewrite a rule pattern for Java. ``flags`` may hold ``i`` (case), ``m`` (lines), ``s`` (dot matches LF).

    ``\\b`` becomes a look-behind when a word follows it and a look-ahead otherwise; the rule tables only use it
    next to a word character, where this is the same test. Before a look-behind the next letter is tested where it is
    known, which decides most places.
    """

    def rewrite(match: re.Match) -> str:
        bracket, kind, following = match.groups()
        if kind == "b":
            opens_word = following and (following.isalpha() or following in "([")
            if not opens_word:
                return bracket + f"(?![{WORD}])"
            letters = first_letters(pattern[match.end():])
            return bracket + (f"(?=[{letters}])" if letters else "") + f"(?<![{WORD}])"
        body = {"w": WORD, "s": SPACE, "d": r"\p{Nd}"}[kind]
        return "[" + body if bracket else f"[{body}]"

    inline = "d" + flags.replace("i", "iu")
    return f"(?{inline})" + _ESCAPE.sub(rewrite, pattern)
