"""Detectors as plain functions: text -> [(start, end), ...] in code points, in order of discovery.

They run inside one Arrow function (operators/detectors.py). Each takes all candidates of a pattern from left to
right; a candidate that is rejected has used up its characters all the same.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import ipaddress
import itertools
import json
import re
from datetime import date
from functools import lru_cache

Span = tuple[int, int]

WHITE = "\t\n\v\f\r \x85\xa0                　"


def wordy(c: str) -> bool:
    """A letter or a decimal digit of any script; false for no character."""
    return c.isalpha() or c.isdecimal()


def sides(text: str, start: int, end: int) -> tuple[str, str]:
    """Up to two characters before and after a span."""
    return text[max(0, start - 2) : start], text[end : end + 2]


def stands_alone(text: str, start: int, end: int) -> bool:
    before, after = sides(text, start, end)
    return not (wordy(before[-1:]) or wordy(after[:1]))


_GLUED = re.compile(r"[0-9][-._]$"), re.compile(r"^[-._][0-9]")


def number_alone(text: str, start: int, end: int) -> bool:
    """Stands alone and isn't a part of a longer number with - . or _ in it."""
    before, after = sides(text, start, end)
    return stands_alone(text, start, end) and not (_GLUED[0].search(before) or _GLUED[1].search(after))


def one_digit(digits: str) -> bool:
    return len(set(digits)) == 1


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


# e-mail -------------------------------------------------------------------------------------------------------------

_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
_DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})+")
_LOCAL = re.compile(r"[a-zA-Z0-9._+-]+\Z")


def email(text: str) -> list[Span]:
    """Anchored on @, so that long runs of mailbox characters cost no more than their length."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._+-"):
            start -= 1
        local = text[start:at].lstrip("._+-")
        domain = _DOMAIN.match(text, at + 1) if local and local[-1].isalnum() else None
        if domain:
            start, end = at - len(local), domain.end()
            before, after = sides(text, start, end)
            if ".." not in local and not any(wordy(c) or c in tuple(".+-_@") for c in (before[-1:], after[:1])):
                out.append((start, end))
            floor = end
        at = text.find("@", max(at + 1, floor))
    return out


# telephone ----------------------------------------------------------------------------------------------------------

_PHONE = re.compile(r"\+[0-9][0-9\t\n\f\r \-().]{5,22}[0-9]|(?:\+7|8)[0-9\t\n\f\r \-().]{8,22}[0-9]")
_ONE_GROUP = re.compile(r"[^()]*\(([0-9]+)\)[^()]*")


def phone_ok(segment: str) -> bool:
    digits = only_digits(segment)
    if "." in segment or not 8 <= len(digits) <= 15:
        return False
    group = None
    if "(" in segment or ")" in segment:
        found = _ONE_GROUP.fullmatch(segment)
        if not found:
            return False
        group = found[1]
    if segment[0] == "8" or digits[0] == "7":
        return len(digits) == 11 and (group is None or len(group) == 3 and digits[1:4] == group)
    return segment[0] == "+"


def phone(text: str) -> list[Span]:
    out = []
    for m in _PHONE.finditer(text):
        before, after = sides(text, *m.span())
        if not any(c and (wordy(c) or c in "+()-") for c in (before[-1:], after[:1])) and phone_ok(m[0]):
            out.append(m.span())
    return out


# addresses of the web -----------------------------------------------------------------------------------------------

_RUN = r"(?:[^\t\n\f\r <>\"{}|\\^`\[\]]|\[[^\]]*\])+"
_URL = re.compile(r"https?://" + _RUN)
_PAIRS = {")": "(", "]": "[", "}": "{", ">": "<"}
_BAD_ESCAPE = re.compile(r"%(?![0-9a-fA-F]{2})")
_USER = re.compile(r"[A-Za-z0-9\-._:~!$&'()*+,;=%@]*")
_DNS = re.compile(rf"{_LABEL}(?:\.{_LABEL})+")


def trimmed(text: str, start: int, end: int) -> int:
    """Without punctuation at the end; a bracket goes only if the text so far closes more of its kind than it opens."""
    while end > start:
        c = text[end - 1]
        if c in _PAIRS:
            if text.count(c, start, end) <= text.count(_PAIRS[c], start, end):
                break
        elif c not in ".,;:!?":
            break
        end -= 1
    return end


def ip4_ok(text: str) -> bool:
    return bool(re.fullmatch(r"(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})", text, re.ASCII)) and all(int(x) < 256 for x in text.split("."))


def ip6_ok(text: str) -> bool:
    if ":" not in text or "%" in text:
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def split_authority(url: str) -> tuple[str, str, str] | None:
    """(userinfo, host, rest after the authority), or None where a strict parser fails."""
    if re.search(r"[\x00-\x1f\x7f]", url):
        return None
    body = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", body)
    authority, rest = (body[: cut.start()], body[cut.start() :]) if cut else (body, "")
    path, _, fragment = rest.partition("#")
    if _BAD_ESCAPE.search(path.partition("?")[0]) or _BAD_ESCAPE.search(fragment):
        return None
    user, _, host = authority.rpartition("@")
    if not _USER.fullmatch(user) or _BAD_ESCAPE.search(user):
        return None
    if host.startswith("["):
        name, closed, port = host[1:].partition("]")
        if not closed:
            return None
    else:
        name, colon, port = host.rpartition(":")
        name, port = (name, colon + port) if colon else (port, "")
        if ":" in name or "[" in host or "]" in host:
            return None
    if not re.fullmatch(r"(?::[0-9]*)?", port):
        return None
    return user, name, rest


def url(text: str) -> list[Span]:
    out = []
    for m in _URL.finditer(text) if "://" in text else ():
        start, end = m.start(), trimmed(text, *m.span())
        if end <= start + 7 or not stands_alone(text, start, end):
            continue
        parts = split_authority(text[start:end])
        if parts and (ip4_ok(parts[1]) or ip6_ok(parts[1]) or _DNS.fullmatch(parts[1])):
            out.append((start, end))
    return out


_IP4 = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")
_IP6 = re.compile(r"(?:[0-9a-fA-F]{0,4}:){1,6}(?:[0-9a-fA-F]{0,4}|(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}))")
#: Characters of the longest IPv6 address, whose last part is an IPv4 one.
LONGEST_IP6 = 45
_TAIL6 = re.compile(r"[:.][0-9a-fA-F:.]*")


def ip_alone(text: str, start: int, end: int) -> bool:
    after = text[end : end + 2]
    return stands_alone(text, start, end) and not (after[:1] == ":" or re.match(r"\.[0-9]", after))


class Cover:
    """Spans that are asked whether one of them holds another."""

    def __init__(self, spans: list[Span]):
        lined = sorted(spans)
        self.starts = [a for a, _ in lined]
        self.reach = list(itertools.accumulate((b for _, b in lined), max))

    def holds(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.starts, start)
        return k > 0 and self.reach[k - 1] >= end


def apart(spans: list[Span]) -> list[Span]:
    """In order; of overlapping ones the longest, then the first."""
    out: list[Span] = []
    for a, b in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        i = bisect.bisect(out, (a, b))
        if all(b <= c or d <= a for c, d in out[max(0, i - 1) : i + 1]):
            out.insert(i, (a, b))
    return out


def ip(text: str) -> list[Span]:
    """Bracketed IPv6 first, then other IPv6 outside all brackets, then IPv4; of overlapping ones the longest, then the first."""
    found: list[Span] = []
    if ":" in text:
        shuts = [m.start() for m in re.finditer(r"\]", text)]
        brackets = [(m.end(), shuts[k]) for m in re.finditer(r"\[", text) if (k := bisect.bisect_left(shuts, m.end())) < len(shuts)]
        found += [(a, b) for a, b in brackets if b - a <= LONGEST_IP6 and ip6_ok(text[a:b]) and stands_alone(text, a, b)]
        bracketed = Cover(brackets)
        for m in _IP6.finditer(text):
            start, end = m.span()
            if text[end : end + 1] == "%" or bracketed.holds(start, end):
                continue
            while ip6_ok(text[start:end]) and (more := _TAIL6.match(text, end)) and ip6_ok(text[start : more.end()]):
                end = more.end()
            if ip_alone(text, start, end) and ip6_ok(text[start:end]):
                found.append((start, end))
    wide = Cover(found)
    for m in _IP4.finditer(text):
        start, end = m.span()
        if not wide.holds(start, end) and ip_alone(text, start, end) and ip4_ok(m[0]):
            found.append((start, end))
    return apart(found)


# numbers with checks ------------------------------------------------------------------------------------------------

def weighted(digits: str, weights) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights, strict=False))


#: Weights of the tax number's check digits.
INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def inn_ok(d: str) -> bool:
    if one_digit(d):
        return False
    if len(d) == 10:
        return weighted(d, INN_10) % 11 % 10 == int(d[9])
    return len(d) == 12 and weighted(d, INN_11) % 11 % 10 == int(d[10]) and weighted(d, INN_12) % 11 % 10 == int(d[11])


def inn(text: str) -> list[Span]:
    return [m.span() for m in re.finditer(r"[0-9]{12}|[0-9]{10}", text) if number_alone(text, *m.span()) and inn_ok(m[0])]


def in_turn(text: str, patterns, ok) -> list[Span]:
    """Matches of each pattern that are ok and don't overlap one accepted before."""
    out: list[Span] = []
    for p in patterns:
        before = sorted(out)  # apart from each other, so only the neighbours of a place can reach it
        for m in p.finditer(text):
            a, b = m.span()
            i = bisect.bisect(before, (a, b))
            if all(b <= c or d <= a for c, d in before[max(0, i - 1) : i + 1]) and ok(text, a, b):
                out.append((a, b))
    return out


_SNILS = re.compile(r"[0-9]{3}-[0-9]{3}-[0-9]{3} [0-9]{2}"), re.compile(r"[0-9]{11}")


def snils_ok(d: str) -> bool:
    return int(d[:9]) >= 1001998 and weighted(d, range(9, 0, -1)) % 101 % 100 == int(d[9:])


def snils(text: str) -> list[Span]:
    return in_turn(text, _SNILS, lambda t, a, b: number_alone(t, a, b) and snils_ok(only_digits(t[a:b])))


_CARD = re.compile(r"(?:[0-9][ -]?){12,18}[0-9]")


def luhn(d: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
    return (sum(map(int, d[-1::-2])) + sum(doubled)) % 10 == 0


def bank_card(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        d = only_digits(m[0])
        if number_alone(text, *m.span()) and not (" " in m[0] and "-" in m[0]) and not one_digit(d) and luhn(d):
            out.append(m.span())
    return out


# numbers that need a word before them -------------------------------------------------------------------------------

#: The markers, in the order in which they are tried.
PASSPORT_MARKERS = ("паспортные данные", "паспорт рф", "паспорт", "серия")
ACCOUNT_MARKERS = ("банковский счёт", "банковский счет", "расчётный счёт", "расчетный счет", "р/с")
BIRTH_MARKERS = ("дата рождения", "д.р.", "родился", "родилась")
GAP_WORDS = ("рф", "серия", "номер")
GAP_BYTES, CODE_GAP_BYTES = 48, 8
#: The longest marker, the widest gap, and a character before.
MARKED_CHARS = max(map(len, (*PASSPORT_MARKERS, *ACCOUNT_MARKERS, *BIRTH_MARKERS))) + GAP_BYTES + 2
_GAP = re.compile(rf"(?:[{WHITE}:№#,-]|(?:{'|'.join(GAP_WORDS)})(?![^\W\d_]))*", re.IGNORECASE)
_CODE = re.compile(rf"([{WHITE}:№#,-]*)([0-9]{{9}})")


def marked(text: str, start: int, markers) -> bool:
    """A marker stands before `start` on the same line, as its last of that kind, with nothing but filler between."""
    line = text[max(0, start - MARKED_CHARS) : start]  # a marker that begins earlier is too far away
    line = line[line.rfind("\n") + 1 :]
    low = line.lower()
    if len(low) != len(line):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in line)
    for marker in markers:
        at = low.rfind(marker)
        if at < 0 or wordy(line[at - 1 : at] if at else ""):
            continue
        gap = line[at + len(marker) :]
        if not gap[:1].isalpha() and len(gap.encode()) <= GAP_BYTES and _GAP.fullmatch(gap):
            return True
    return False


_PASSPORT = re.compile(r"[0-9]{4} [0-9]{6}"), re.compile(r"[0-9]{2} [0-9]{2} [0-9]{6}")


def passport(text: str) -> list[Span]:
    return in_turn(text, _PASSPORT, lambda t, a, b: number_alone(t, a, b) and marked(t, a, PASSPORT_MARKERS))


_ACCOUNT = re.compile(r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}"), re.compile(r"[0-9]{20}")
_BANK = re.compile("бик", re.IGNORECASE)


@lru_cache(1)  # accounts of a line ask one after another
def bank_codes(text: str, begin: int, stop: int) -> list[tuple[int, int, str]]:
    """The labelled bank codes of a line, in order."""
    out = []
    for m in _BANK.finditer(text, begin, stop):
        if wordy(text[m.start() - 1 : m.start()] if m.start() > begin else "") or text[m.end() : m.end() + 1].isalpha():
            continue
        code = _CODE.match(text, m.end(), stop)
        if code and len(code[1].encode()) <= CODE_GAP_BYTES and number_alone(text, *code.span(2)):
            out.append((*code.span(2), code[2]))
    return out


def bank_code(text: str, start: int, end: int) -> str | None:
    """The first labelled bank code on the account's line, apart from the account."""
    begin = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    return next((code for a, b, code in bank_codes(text, begin, len(text) if stop < 0 else stop) if b <= start or end <= a), None)


def account_ok(text: str, start: int, end: int) -> bool:
    d = only_digits(text[start:end])
    if not number_alone(text, start, end) or one_digit(d) or not marked(text, start, ACCOUNT_MARKERS):
        return False
    code = bank_code(text, start, end)
    return code is None or weighted(code[6:] + d, (7, 1, 3) * 8) % 10 == 0


def bank_account(text: str) -> list[Span]:
    return in_turn(text, _ACCOUNT, account_ok)


#: Months, as they stand in dates.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
_DATE = re.compile(r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}"), re.compile(rf"[0-9]{{1,2}}[\t\n\f\r ]+(?:{'|'.join(MONTHS)})[\t\n\f\r ]+[0-9]{{4}}", re.IGNORECASE)


def birth_ok(text: str, start: int, end: int) -> bool:
    before, after = sides(text, start, end)
    if not stands_alone(text, start, end) or before[-1:] in tuple("./") and before[:1].isdecimal() and len(before) == 2 or after[:1] in tuple("./") and after[1:].isdecimal():
        return False
    segment = text[start:end]
    if segment[2] in "./" and segment[2] == segment[5:6]:
        day, month, year = re.split(r"[./]", segment)
    elif segment[2] in "./" or "\n" in segment or "\r" in segment:
        return False
    else:
        day, name, year = segment.lower().split()
        month = MONTHS.index(name) + 1
    try:
        date(int(year), int(month), int(day))
    except ValueError:
        return False
    return marked(text, start, BIRTH_MARKERS)


def date_of_birth(text: str) -> list[Span]:
    return in_turn(text, _DATE, birth_ok)


# secrets ------------------------------------------------------------------------------------------------------------

_JWT_RUN = re.compile(r"[A-Za-z0-9_.\-]+")


def b64url(text: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)) if len(text) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def jwt(text: str) -> list[Span]:
    out = []
    for m in _JWT_RUN.finditer(text) if text.count(".") > 1 else ():
        body = m[0].rstrip(".") if text[m.end() - 1] == "." and m[0].count(".") > 2 else m[0]
        parts = body.split(".")
        start, end = m.start(), m.start() + len(body)
        if len(parts) != 3 or not all(parts) or not stands_alone(text, start, end) or any(len(p) % 4 == 1 for p in parts):
            continue
        try:
            head = json.loads(b64url(parts[0]) or b"")
        except ValueError:
            continue
        alg = head.get("alg") if isinstance(head, dict) else None
        if isinstance(alg, str) and alg and alg.lower() != "none":
            out.append((start, end))
    return out


#: Labels of private keys.
KEY_LABELS = ("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK")
_PEM = re.compile(rf"^-----BEGIN ({'|'.join(KEY_LABELS)})-----\r?\n([A-Za-z0-9+/=\r\n]+)\r?\n-----END \1-----(?=\r?$)", re.MULTILINE)


def private_key(text: str) -> list[Span]:
    out = []
    for m in _PEM.finditer(text) if "-----BEGIN " in text else ():
        try:
            body = base64.b64decode(re.sub(r"[\r\n]", "", m[2]), validate=True)
        except (binascii.Error, ValueError):
            continue
        if body:
            out.append(m.span())
    return out


#: Shapes of provider keys.
KEY_SHAPES = (
    r"ghp_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"sk-proj-[A-Za-z0-9_-]{20,}",
    r"sk-[A-Za-z0-9]{20,}",
)
_KEY = re.compile(rf"(?<![A-Za-z0-9_-])(?:{'|'.join(KEY_SHAPES)})(?![A-Za-z0-9_-])")


def api_key(text: str) -> list[Span]:
    return [m.span() for m in _KEY.finditer(text) if stands_alone(text, *m.span())]


#: Schemes of connection strings.
DSN_SCHEMES = ("postgresql", "postgres", "mysql", "mongodb+srv", "mongodb", "rediss", "redis", "amqps", "amqp")
_DSN = re.compile(rf"(?<![A-Za-z0-9+.\-_])(?:{'|'.join(map(re.escape, DSN_SCHEMES))})://" + _RUN)


def dsn(text: str) -> list[Span]:
    out = []
    for m in _DSN.finditer(text) if "://" in text else ():
        start, end = m.start(), trimmed(text, *m.span())
        parts = split_authority(text[start:end]) if stands_alone(text, start, end) else None
        if parts and parts[1]:
            name, _, word = parts[0].partition(":")
            if name and word:
                out.append((start, end))
    return out
