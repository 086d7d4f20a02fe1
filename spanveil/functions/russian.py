"""Person names and postal addresses in Russian text, by rules over tokens."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from .scanners import Span, wordy

_UNIT = r"(?:[а-яА-ЯёЁ]+|[a-zA-Z]+|[0-9]+(?:[.,/][0-9]+)*)"
_TOKEN = re.compile(rf"{_UNIT}(?:[-‑–—−_]{_UNIT})*|[.!?…]+|--+|\*\*|\S")
_CYRILLIC_WORD = re.compile(r"[А-ЯЁ][а-яё]*(?:-[А-ЯЁ][а-яё]*)*")

NOM_M, DAT_M, INS_M, NOM_F, DAT_F, INS_F = (1 << i for i in range(6))

#: Name forms with their role (F first, P patronymic, S surname) and grammatical forms.
NAME_FORMS = {
    "иван": ("F", NOM_M),
    "ивану": ("F", DAT_M),
    "иваном": ("F", INS_M),
    "мария": ("F", NOM_F),
    "марии": ("F", DAT_F | NOM_F),
    "марией": ("F", INS_F),
    "анна": ("F", NOM_F),
    "анне": ("F", DAT_F),
    "анной": ("F", INS_F),
    "сергей": ("F", NOM_M),
    "сергею": ("F", DAT_M),
    "сергеем": ("F", INS_M),
    "сергеевич": ("P", NOM_M),
    "сергеевичу": ("P", DAT_M),
    "сергеевичем": ("P", INS_M),
    "сергеевна": ("P", NOM_F),
    "сергеевне": ("P", DAT_F),
    "сергеевной": ("P", INS_F),
    "петров": ("S", NOM_M),
    "петрову": ("S", DAT_M),
    "петровым": ("S", INS_M),
    "петрова": ("S", NOM_F),
    "петровой": ("S", INS_F),
    "иванова": ("S", NOM_F),
    "иванову": ("S", DAT_F),
    "ивановой": ("S", INS_F),
    "сидоров": ("S", NOM_M),
    "сидорову": ("S", DAT_M),
    "сидоровым": ("S", INS_M),
    "смирнов": ("S", NOM_M),
    "смирнову": ("S", DAT_M),
    "смирновым": ("S", INS_M),
    "смирнова": ("S", NOM_F),
}
#: Endings of patronymics and of surnames.
PATRONYMIC_ENDINGS = (
    (("ович", "евич", "ич"), NOM_M),
    (("овичу", "евичу", "ичу"), DAT_M),
    (("овичем", "евичем", "ичем"), INS_M),
    (("овна", "евна", "ична"), NOM_F),
    (("овне", "евне", "ичне"), DAT_F),
    (("овной", "евной", "ичной"), INS_F),
)
SURNAME_ENDINGS = (
    (("ов", "ев", "ин", "ын"), NOM_M),
    (("ова", "ева", "ина", "ына"), NOM_F),
    (("ову", "еву", "ину", "ыну"), DAT_M),
    (("овой", "евой", "иной", "ыной"), DAT_F | INS_F),
    (("овым", "евым", "иным"), INS_M),
)
#: Words that make what follows a street.
STREET_WORDS = {"улица", "ул", "проспект", "пр-т", "просп", "переулок", "пер", "бульвар", "б-р", "шоссе", "площадь", "пл"}
#: Parts of an address with their short and full labels.
LABELS = {
    "street": {"short": ("ул", "пр-т", "просп", "пер"), "full": ("улица", "проспект", "переулок", "шоссе")},
    "settlement": {"short": ("г",), "full": ("город",)},
    "house": {"short": ("д",), "full": ("дом",)},
    "corpus": {"short": ("корп",), "full": ("корпус",)},
    "building": {"short": ("стр",), "full": ("строение",)},
    "flat": {"short": ("кв",), "full": ("квартира",)},
}
LABEL_WORDS = {w for kinds in LABELS.values() for words in kinds.values() for w in words}


@lru_cache(65536)
def name_role(folded: str) -> tuple[str, int]:
    if folded in NAME_FORMS:
        return NAME_FORMS[folded]
    for role, endings in (("P", PATRONYMIC_ENDINGS), ("S", SURNAME_ENDINGS)):
        for ends, forms in endings:
            if (role == "P" or len(folded) > 3) and any(folded.endswith(e) and len(folded) > len(e) for e in ends):
                return role, forms
    return "", 0


@dataclass(slots=True)
class Token:
    text: str
    start: int
    end: int
    kind: str  # word, number, point, other, initial
    folded: str = ""
    capital: bool = False
    role: str = ""
    forms: int = 0


def kind_of(text: str) -> str:
    if text.isdecimal():
        return "number"
    if all(unicodedata.category(c)[0] == "P" for c in text):
        return "point"
    return "word" if all(c.isalpha() or c in "-'" for c in text) else "other"


@lru_cache(1)  # names and addresses ask for the same text one after the other
def tokens(text: str) -> list[Token]:
    """Runs of one script or of digits, joined over dashes; numbers keep their points; a lone capital and the point after it are one initial."""
    out: list[Token] = []
    for m in _TOKEN.finditer(text):
        word = m[0]
        if word == "." and out and out[-1].end == m.start() and out[-1].kind == "word" and re.fullmatch("[А-ЯЁ]", out[-1].text):
            out[-1] = Token(out[-1].text + ".", out[-1].start, m.end(), "initial", out[-1].folded, True, "I")
            continue
        t = Token(word, m.start(), m.end(), kind_of(word), word.lower())
        if t.kind == "word" and _CYRILLIC_WORD.fullmatch(word):
            t.capital = True
            t.role, t.forms = name_role(t.folded)
        out.append(t)
    return out


def alone(text: str, start: int, end: int) -> bool:
    return not (wordy(text[start - 1 : start] if start else "") or wordy(text[end : end + 1]))


# persons ------------------------------------------------------------------------------------------------------------

#: Orders of name parts, longest first: F first name, P patronymic, S surname, I initial.
PERSON_SHAPES = ("FPS", "SFP", "SII", "IIS", "FS", "SF")


def after_street_word(row: list[Token], i: int) -> bool:
    before = row[i - 1] if i else None
    if before is None or before.kind not in ("word", "point", "initial"):
        return False
    return before.text.lower() in STREET_WORDS or before.text == "." and i > 1 and row[i - 2].text.lower() == "ул"


_CAPITAL = re.compile("[А-ЯЁ]")


def person(text: str) -> list[Span]:
    if not _CAPITAL.search(text):
        return []
    row = tokens(text)
    roles = "".join(t.role or "-" for t in row)
    joined = [not text[a.end : b.start].strip(" \t") for a, b in zip(row, row[1:], strict=False)]
    out, i = [], 0
    while i < len(row):
        for shape in PERSON_SHAPES:
            n = len(shape)
            if not roles.startswith(shape, i) or not all(joined[i : i + n - 1]):
                continue
            agreed = -1
            for t in row[i : i + n]:
                agreed &= t.forms if t.forms else -1
            start, end = row[i].start, row[i + n - 1].end
            if agreed and not after_street_word(row, i) and alone(text, start, end):
                out.append((start, end))
                i += n
                break
        else:
            i += 1
    return out


# addresses ----------------------------------------------------------------------------------------------------------

STREET_TOKENS, SETTLEMENT_TOKENS = 4, 2
_HOUSE_PART = r"(?:\d+[a-zA-Zа-яА-ЯёЁ]?\d*|[a-zA-Zа-яА-ЯёЁ]\d+)"
_HOUSE = re.compile(rf"{_HOUSE_PART}(?:[/-]{_HOUSE_PART})?")


class Row:
    """Tokens with the questions that the address grammar asks; answers are the index after what matched, or -1."""

    def __init__(self, text: str):
        self.text, self.row = text, tokens(text)

    def is_(self, i: int, what: str) -> bool:
        return 0 <= i < len(self.row) and self.row[i].text == what

    def label(self, i: int, part: str) -> int:
        if not 0 <= i < len(self.row):
            return -1
        t = self.row[i]
        if t.kind not in ("word", "other", "initial"):
            return -1
        if t.folded in LABELS[part]["full"]:
            return i + 1
        if t.folded in LABELS[part]["short"]:
            return i + 1 + self.is_(i + 1, ".")
        return -1

    def comma(self, i: int) -> int:
        """Past an optional comma; two in a row are malformed."""
        if not self.is_(i, ","):
            return i
        return -1 if self.is_(i + 1, ",") else i + 1

    def named(self, i: int) -> bool:
        t = self.row[i]
        return t.kind in ("word", "initial") and t.capital and t.folded not in LABEL_WORDS

    def settled(self, i: int) -> bool:
        t = self.row[i]
        return t.kind in ("word", "initial") and (t.capital or "-" in t.text)

    def names(self, i: int, ok, most: int) -> int:
        end = i
        while 0 <= end < len(self.row) and end - i < most and ok(end):
            end += 1
        return end if end > i else -1

    def street(self, i: int) -> int:
        after = self.label(i, "street")
        if after >= 0 and (end := self.names(after, self.named, STREET_TOKENS)) >= 0:
            return end
        end = self.names(i, self.named, STREET_TOKENS)
        return self.label(end, "street") if end >= 0 else -1

    def number(self, i: int) -> int:
        if not 0 <= i < len(self.row):
            return -1
        t, after = self.row[i], self.row[i + 1] if i + 1 < len(self.row) else None
        if t.kind == "number" and after and after.start == t.end and after.kind == "word" and re.fullmatch("[a-zA-Zа-яА-ЯёЁ]", after.text):
            return i + 2
        return i + 1 if t.kind in ("number", "word", "other") and _HOUSE.fullmatch(t.text) else -1

    def house(self, i: int) -> int:
        after = self.label(i, "house")
        return self.number(after if after >= 0 else i)

    def further(self, i: int) -> int:
        """Past corpus, building and flat, each optional, in this order; i if there are none, -1 if what follows is malformed."""
        end, at = i, self.comma(i)
        for part in ("corpus", "building", "flat"):
            if at < 0:
                return -1
            label = self.label(at, part)
            done = self.number(label) if label >= 0 else -1
            if done >= 0:
                end, at = done, self.comma(done) if part != "flat" else done
        if at < 0:
            return -1
        if end == i and any(self.label(at, part) >= 0 for part in ("corpus", "building", "flat")):
            return -1
        return end

    def settlement_before(self, street: int) -> int:
        """Where the settlement before a street begins; the street itself if there is none."""
        last = street - 2
        if not self.is_(street - 1, ",") or last < 0 or not self.settled(last):
            return street
        first = last - 1 if last and self.settled(last - 1) else last
        if self.is_(first - 1, "."):
            return first - 2 if first > 1 and self.row[first - 2].folded == "г" else first
        return first - 1 if first and self.label(first - 1, "settlement") == first else first

    def settlement_after(self, i: int) -> int:
        """Past a settlement and its comma, or -1."""
        label = self.label(i, "settlement")
        end = self.names(label if label >= 0 else i, self.settled, SETTLEMENT_TOKENS)
        return end + 1 if end >= 0 and self.is_(end, ",") else -1

    def at(self, i: int) -> tuple[int, int, int] | None:
        """(start, end, next token) of the address that scanning finds at token i: of two readings that which ends later, then that which starts first."""
        found = []
        for street in dict.fromkeys((i, self.settlement_after(i))):
            if street < 0 or (first := self.settlement_before(street)) > i:
                continue
            end = self.street(street)
            end = self.comma(end) if end >= 0 else -1
            end = self.house(end) if end >= 0 else -1
            end = self.further(end) if end >= 0 else -1
            if end < 0:
                continue
            start, stop = self.row[first].start, self.row[end - 1].end
            if "\n" not in self.text[start:stop] and alone(self.text, start, stop):
                found.append((-stop, start, end))
        if not found:
            return None
        stop, start, end = min(found)
        return start, -stop, end


_STREET = re.compile("|".join(w for kind in LABELS["street"].values() for w in kind), re.IGNORECASE)


def address(text: str) -> list[Span]:
    if not _CAPITAL.search(text) or not _STREET.search(text):
        return []
    row, out, i = Row(text), [], 0
    while i < len(row.row):
        found = row.at(i)
        if found:
            out.append(found[:2])
            i = max(found[2], i + 1)
        else:
            i += 1
    return out
