"""Personal data that patterns find: e-mail and IP addresses, card and phone numbers; and what a tagger's finds must be."""

from __future__ import annotations

import re
import unicodedata

# fixed values: kinds in the order of results, and the patterns of each
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# the same matches in linear time: a failed run of digits is not tried again from its middle
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(PHONE)
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((0, start, free))
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and not overlapping within a kind, sorted by kind and start."""
    found = _emails(text)
    if not _DIGIT.search(text):
        return found
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_part, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = _only_digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return found


# ways to write signs out, with or without brackets around
_AT = re.compile(r"\s*[(\[{<]\s*(?:at|@)\s*[)\]}>]\s*|\s+at\s+|\s*@\s*", re.I)
_DOT = re.compile(r"\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*|\s+dot\s+|\s*\.\s*", re.I)
_BETWEEN = re.compile(r"[^0-9]+")
_NUMBER = re.compile(r"[0-9 ()./_+\-‐-―− ]+")
_WHOLE_EMAIL = re.compile(EMAIL)


def plausible(kind: int, surface: str) -> bool:
    """Whether a tagged piece of text is of its kind once signs that are written out are put back."""
    plain = unicodedata.normalize("NFKC", surface)
    if kind == 0:
        plain = _DOT.sub(".", _AT.sub("@", plain))
        return len(plain) <= 254 and _WHOLE_EMAIL.fullmatch(plain) is not None
    digits = _only_digits(plain)
    if kind == 1:
        plain = _DOT.sub(".", plain)
        parts = plain.split(".")
        return len(parts) == 4 and all(p and not _BETWEEN.search(p) and _part(p) for p in parts)
    if not _NUMBER.fullmatch(plain):
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(plain) > len(digits)


def text_of(spans: list[Span]) -> str:
    """kind:start:end of each, by kind and start, joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans))
