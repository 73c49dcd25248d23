"""Personal data by pattern: e-mail and IP addresses, card and phone numbers.  Every scan is linear in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    """Code points ``start`` to ``end`` (exclusive)."""

    kind: str
    start: int
    end: int


_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match takes all digits of its last part, so the next one starts where digits start
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
MAX_PART = 255


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts double."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    for host in _HOST.finditer(text):
        start = host.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < host.start():
            yield Span("email", start, host.end())
            done = host.end()


def is_ip(parts: tuple[str, ...]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= MAX_PART for p in parts)


def base_spans(text: str) -> list[Span]:
    """All spans by kind, then start."""
    found = list(_emails(text)) if "@" in text else []
    found += [Span("ip", *m.span()) for m in _IP.finditer(text) if is_ip(m.groups())]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    if "+" in text:
        found += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return found
