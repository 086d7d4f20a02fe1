"""Detectors: the sixteen built-in ones, patterns of the caller's, and functions of the caller's.

The built-in families share one Arrow function. A row goes to Python once, with a bit for each family whose cheap test,
made by Java, says that the row may hold something; most rows have none and don't go. (As Catalyst expressions, the
number families took eight times as long: higher-order functions are interpreted.) Patterns of the caller's are Catalyst
expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import russian, scanners
from ..functions import spans as sp
from .errors import ConfigError

FINDING = "struct<entity:string,start:int,end:int,confidence:double,detector:string>"
RAW = "array<struct<reg:int,local:int,start:int,end:int>>"

#: The entities, in report order, and their rank where spans overlap.
PRIORITY = {
    "PERSON": 50,
    "ADDRESS": 80,
    "EMAIL": 100,
    "PHONE": 40,
    "IP_ADDRESS": 30,
    "URL": 110,
    "INN": 60,
    "SNILS": 60,
    "PASSPORT": 60,
    "BANK_CARD": 70,
    "BANK_ACCOUNT": 20,
    "DATE_OF_BIRTH": 20,
    "SECRET_JWT": 140,
    "SECRET_PRIVATE_KEY": 140,
    "SECRET_API_KEY": 140,
    "CONNECTION_STRING": 150,
}
ENTITIES = tuple(PRIORITY)
SECRETS = ("SECRET_JWT", "SECRET_PRIVATE_KEY", "SECRET_API_KEY", "CONNECTION_STRING")


@dataclass(frozen=True)
class Detector:
    """name, entity and confidence of its findings, and one of: `spans`, text column -> array of spans; `scan`, text -> code-point spans.

    `hint` is a Java pattern that a text with a finding surely matches, or None. `sure` spans, as those of patterns,
    lie within the text and cut no character; others are looked at.
    """

    name: str
    entity: str
    confidence: float
    spans: Callable[[Column], Column] | None = None
    scan: Callable[[str], list[tuple[int, int]]] | None = None
    hint: str | None = None
    sure: bool = False

    def __post_init__(self):
        if not self.name.strip() or any(ord(c) < 32 or ord(c) == 127 for c in self.name):
            raise ConfigError("detector name")
        if not self.entity.strip():
            raise ConfigError("detector entity")
        if not 0 <= self.confidence <= 1:
            raise ConfigError("detector confidence")
        if (self.spans is None) == (self.scan is None):
            raise ConfigError("detector needs spans or scan")


#: What every marker word has that has to stand before a number.
CYRILLIC = "[А-Яа-яЁё]"


def person() -> Detector:
    return Detector("person", "PERSON", 0.82, scan=russian.person, hint="[А-ЯЁ]")


def address() -> Detector:
    return Detector("address", "ADDRESS", 0.84, scan=russian.address, hint="[А-ЯЁ]")  # the scan looks for street words itself


def email() -> Detector:
    return Detector("email", "EMAIL", 0.90, scan=scanners.email, hint="@")


def phone() -> Detector:
    return Detector("phone", "PHONE", 0.85, scan=scanners.phone, hint=r"\+[0-9][0-9\t\n\f\r \-().]{5}|(?:\+7|8)[0-9\t\n\f\r \-().]{8}")


def ip() -> Detector:
    return Detector("ip", "IP_ADDRESS", 0.90, scan=scanners.ip, hint=r"[0-9]\.[0-9]{1,3}\.[0-9]|:[0-9a-fA-F:]")


def url() -> Detector:
    return Detector("url", "URL", 0.88, scan=scanners.url, hint="://")


def inn() -> Detector:
    return Detector("inn", "INN", 0.92, scan=scanners.inn, hint="[0-9]{10}")


def snils() -> Detector:
    return Detector("snils", "SNILS", 0.91, scan=scanners.snils, hint="[0-9]{3}-[0-9]{3}-[0-9]{3} |[0-9]{11}")


def passport() -> Detector:
    return Detector("passport", "PASSPORT", 0.86, scan=scanners.passport, hint=CYRILLIC)


def bank_card() -> Detector:
    return Detector("bank_card", "BANK_CARD", 0.87, scan=scanners.bank_card, hint="(?:[0-9][ -]?){12}[0-9]")


def bank_account() -> Detector:
    return Detector("bank_account", "BANK_ACCOUNT", 0.85, scan=scanners.bank_account, hint=CYRILLIC)


def date_of_birth() -> Detector:
    return Detector("date_of_birth", "DATE_OF_BIRTH", 0.84, scan=scanners.date_of_birth, hint=CYRILLIC)


def jwt() -> Detector:
    return Detector("secret_jwt", "SECRET_JWT", 0.92, scan=scanners.jwt, hint=r"[A-Za-z0-9_-]\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]")


def private_key() -> Detector:
    return Detector("secret_private_key", "SECRET_PRIVATE_KEY", 0.95, scan=scanners.private_key, hint="-----BEGIN ")


def api_key() -> Detector:
    return Detector("secret_api_key", "SECRET_API_KEY", 0.90, scan=scanners.api_key, hint="ghp_|github_pat_|glpat-|AKIA|ASIA|sk-")


def dsn() -> Detector:
    return Detector("secret_dsn", "CONNECTION_STRING", 0.93, scan=scanners.dsn, hint="://")


def builtin() -> list[Detector]:
    """All sixteen, in the order of registration."""
    return [person(), address(), email(), phone(), ip(), url(), inn(), snils(), passport(), bank_card(), bank_account(), date_of_birth(), jwt(), private_key(), api_key(), dsn()]


def regexp(name: str, entity: str, pattern: str, confidence: float = 0.5) -> Detector:
    """A pattern of the caller's, in Java syntax; matches of nothing are dropped."""
    if not pattern:
        raise ConfigError("pattern")
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ConfigError("a pattern needs a running session, whose Java reads it")
    try:
        empty = spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").matches()
    except (Py4JJavaError, PySparkException) as e:
        raise ConfigError("pattern") from e
    if empty:
        raise ConfigError("pattern matches the empty text")
    return Detector(name, entity, confidence, spans=lambda text: sp.find_spans(text, pattern), hint=pattern, sure=True)


def function(name: str, entity: str, scan: Callable[[str], list[tuple[int, int]]], confidence: float = 0.5) -> Detector:
    """A function of the caller's: text -> (start, end) code-point pairs. A bad pair or an exception shows in the row's status."""
    return Detector(name, entity, confidence, scan=scan)


def byte_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if text.isascii():
        return spans
    return [(a0 := len(text[:a].encode()), a0 + len(text[a:b].encode())) for a, b in spans]


def scanning(detectors: list[tuple[int, Detector]]) -> Callable:
    """One Arrow function for all scanning detectors: struct of raw findings, and the first failing detector's number and field.

    `asked` has a bit for each of the detectors, in order; those that a row's hints rule out don't run on it. All or
    nothing: a row with a failure has no findings.
    """
    kind = f"struct<found:{RAW},failed:int,field:string>"

    @F.pandas_udf(kind)
    def scan_all(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, asked in batches:
            found, failed, field = [], [], []
            for text, bits in zip(texts, asked.tolist(), strict=True):
                row, bad, what = [], None, None
                for k, (reg, d) in enumerate(detectors if text is not None and bits else ()):
                    if not bits >> k & 1:
                        continue
                    try:
                        spans = list(d.scan(text))
                        if any(not (isinstance(a, int) and isinstance(b, int) and 0 <= a < b <= len(text)) for a, b in spans):
                            bad, what = reg, "span"
                            break
                    except Exception:  # a caller's function may fail in any way; the row says which, never with what text
                        bad, what = reg, "detector"
                        break
                    row += [{"reg": reg, "local": i, "start": a, "end": b} for i, (a, b) in enumerate(byte_offsets(text, spans))]
                found.append([] if bad is not None else row)
                failed.append(bad)
                field.append(what)
            yield pd.DataFrame({"found": found, "failed": pd.array(failed, "Int32"), "field": pd.Series(field, dtype=object)})

    return scan_all
