"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from functools import partial
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.arrow import bounded_batches, row_udf
from shelf.llm.spans import code_points

# The contract's patterns, written so that no text makes them retry a run from its middle.
BASE_KINDS = ("email", "ip", "card", "phone")
MAILBOX = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: What follows country and check digits, by its number of letters and digits.
IBAN_REST = {n: re.compile(rb"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % n) for n in range(11, 31)}
# The length of an IBAN that ISO 13616 fixes for each country.
IBAN_LENGTHS = {
    b"AD": 24, b"AE": 23, b"AL": 28, b"AT": 20, b"AZ": 28, b"BA": 20, b"BE": 16, b"BG": 22, b"BH": 22, b"BI": 27, b"BR": 29, b"BY": 28, b"CH": 21,
    b"CR": 22, b"CY": 28, b"CZ": 24, b"DE": 22, b"DJ": 27, b"DK": 18, b"DO": 28, b"EE": 20, b"EG": 29, b"ES": 24, b"FI": 18, b"FK": 18, b"FO": 18,
    b"FR": 27, b"GB": 22, b"GE": 22, b"GI": 23, b"GL": 18, b"GR": 27, b"GT": 28, b"HN": 28, b"HR": 21, b"HU": 28, b"IE": 22, b"IL": 23, b"IQ": 23,
    b"IS": 26, b"IT": 27, b"JO": 30, b"KW": 30, b"KZ": 20, b"LB": 28, b"LC": 32, b"LI": 21, b"LT": 20, b"LU": 20, b"LV": 21, b"LY": 25, b"MC": 27,
    b"MD": 24, b"ME": 22, b"MK": 19, b"MR": 27, b"MT": 31, b"MU": 30, b"NI": 28, b"NL": 18, b"NO": 15, b"OM": 23, b"PK": 24, b"PL": 28, b"PS": 29,
    b"PT": 25, b"QA": 29, b"RO": 24, b"RS": 22, b"RU": 33, b"SA": 24, b"SC": 31, b"SD": 18, b"SE": 24, b"SI": 19, b"SK": 24, b"SM": 27, b"SO": 23,
    b"ST": 25, b"SV": 28, b"TL": 23, b"TN": 24, b"TR": 26, b"UA": 29, b"VA": 22, b"VG": 24, b"XK": 20, b"YE": 30,
}


def _words(text: str) -> frozenset[bytes]:
    return frozenset(w.encode() for w in text.split())


#: Whole words near a span that speak for its kind, in English, German, French and Spanish, and those that speak against it.
CONTEXT = {
    "email": _words("email mail e-mail contact write mailto kontakt schreiben adresse courriel écrire contacter correo escribir contacto"),
    "ip": _words("ip ipv4 host server address client login rechner adresse serveur hôte servidor dirección anfitrión"),
    "card": _words("card visa mastercard credit debit payment karte kreditkarte zahlung carte crédit paiement tarjeta crédito pago"),
    "phone": _words("phone tel telephone call mobile cell fax telefon anrufen handy mobil téléphone appeler portable teléfono llamar móvil"),
    "iban": _words("iban account bank transfer konto überweisung compte virement banque cuenta transferencia banco"),
}
AGAINST = {
    "email": _words("example beispiel exemple ejemplo"),
    "ip": _words("version release build section chapter firmware ausgabe abschnitt kapitel révision chapitre versión capítulo sección"),
    "phone": _words("order invoice isbn part serial bestellung rechnung seriennummer commande facture série pedido factura serie"),
    "card": _words("serial isbn order tracking seriennummer bestellung sendung série commande suivi serie pedido seguimiento"),
}
#: The score before any word is seen, what words for and against it change, and the least score that is masked. A card
#: and an IBAN have passed their checks, so a word against a card alone does not free it; words on both sides leave a score as it was.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
RAISE, LOWERED, AROUND, LEAST = 0.2, 0.3, 40, 0.4

WORD = re.compile(r"[^\W\d_][\w-]*")
NO_LETTER = re.compile(r"\W")
NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
SCHEMA = "spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
MASK_SCHEMA = "masked string, n_masked bigint"


def luhn(digits: bytes) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        d -= 48
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: bytes) -> bool:
    """The check of ISO 13616: country and check digits to the end, letters as numbers, remainder 1."""
    code = iban.replace(b" ", b"")
    return int("".join(str(int(chr(c), 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: bytes) -> list[tuple[int, int]]:
    """A match takes the whole run of mailbox characters before its @, so each @ is looked at once."""
    found, after, at = [], 0, text.find(b"@")
    before = -1
    while at >= 0:
        if at >= after:
            run = text[max(after, before + 1):at]
            start = at - (len(run) - len(run.rstrip(MAILBOX)))
            if start < at and (domain := DOMAIN.match(text, at)):
                found.append((start, domain.end()))
                after = domain.end()
        before, at = at, text.find(b"@", at + 1)
    return found


def _ibans(text: bytes) -> list[tuple[int, int]]:
    """A country's IBAN ends at its length, whatever follows. What no country's IBAN takes is searched for those of
    countries without a length: they end at the last end of a word that the check allows."""
    fixed, after = [], 0
    for m in IBAN.finditer(text):
        if m.start() >= after and (n := IBAN_LENGTHS.get(m[0][:2])) and (rest := IBAN_REST[n - 4].match(text, m.end())) and mod97(m[0] + rest[0]):
            fixed.append((m.start(), after := rest.end()))
    found = list(fixed)
    for (_, low), (high, _) in pairwise([(0, 0), *fixed, (len(text), len(text))]):
        after = low
        for m in IBAN.finditer(text, low, high):
            if m.start() >= after and m[0][:2] not in IBAN_LENGTHS:
                for n in range(30, 10, -1):
                    if (rest := IBAN_REST[n].match(text, m.end(), high)) and mod97(m[0] + rest[0]):
                        found.append((m.start(), after := rest.end()))
                        break
    return sorted(found)


def _digits(span: bytes) -> bytes:
    return span.translate(None, NOT_DIGITS)


def find_pii(text: bytes | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in bytes, by kind, then start."""
    if not text:
        return []
    found = [("email", *s) for s in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text)
              if all(len(p := part.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for part in m[0].split(b"."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if b"+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    found += [("iban", *s) for s in _ibans(text)]
    return [(kind, start, end, _score(text, kind, start, end)) for kind, start, end in found]


def _near(text: bytes, start: int, end: int) -> set[bytes]:
    """The whole words within ``AROUND`` bytes of a span, lower-cased; a word that the bound cuts is left out."""
    before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
    words = WORD.findall(before.decode("utf-8", "ignore").lower())
    if words and start > AROUND and not NO_LETTER.match(before.decode("utf-8", "ignore")):
        words = words[1:]
    following = after.decode("utf-8", "ignore").lower()
    more = WORD.findall(following)
    if more and end + AROUND < len(text) and following[-1:].isalnum():
        more = more[:-1]
    return {w.encode() for w in words + more}


def _score(text: bytes, kind: str, start: int, end: int) -> float:
    near, score = _near(text, start, end), SCORE[kind]
    if near & CONTEXT[kind]:
        score += RAISE
    if near & AGAINST.get(kind, frozenset()):
        score -= LOWERED
    return round(min(1.0, score), 2)


def _scan(text: bytes | None) -> tuple[list]:
    spans = find_pii(text)
    if not spans:
        return ([],)
    at = code_points(text, [p for s in spans for p in s[1:3]])
    return ([(kind, at[start], at[end], score) for kind, start, end, score in spans],)


def masked(text: bytes | None, least: float) -> tuple[bytes | None, int]:
    """The text with every span of a sufficient score replaced by its kind; overlapping spans become one."""
    spans = sorted((start, end, kind) for kind, start, end, score in find_pii(text) if score >= least)
    if not spans:
        return text, 0
    merged: list[list] = []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, after = [], 0
    for start, end, kind in merged:
        out += [text[after:start], b"[" + kind.upper().encode() + b"]"]
        after = end
    return b"".join([*out, text[after:]]), len(spans)


def _make_scan():
    return _scan


def _make_mask(least: float):
    def apply(text: bytes | None) -> tuple[str | None, int]:
        value, n = masked(text, least)
        return (None if value is None else value.decode("utf-8", "replace")), n

    return apply


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a column ``out``: the personal data of every whole text, by kind, then start.

    Spans count code points, the end exclusive. Checksums decide (card by Luhn, iban by mod 97);
    whole words within 40 bytes raise or lower the score but drop nothing here. A null or empty text has no
    spans. A column named ``out`` is replaced; all rows and all other columns stay.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, row_udf(_make_scan, SCHEMA, binary=True)(F.col(text))["spans"])


def mask(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with the spans of a score of ``least`` or more replaced by [EMAIL], [IP] and so on.

    With the default an address or number of a doubtful kind (ip, phone) stays where words nearby speak
    against it and none for it: "release version 1.2.3.4" is no address. A null text stays null; texts without personal data stay as they are.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text, row_udf(partial(_make_mask, least), MASK_SCHEMA, binary=True)(F.col(text))["masked"])
