"""Normalisation of record attributes as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ATTRIBUTES, ID, SOURCE

# Street-type abbreviations and legal forms as French postal and company registers use them.
STREET = {
    "av": "avenue", "ave": "avenue", "aven": "avenue", "bd": "boulevard", "bld": "boulevard", "boul": "boulevard", "blvd": "boulevard",
    "r": "rue", "pl": "place", "imp": "impasse", "all": "allee", "ch": "chemin", "che": "chemin", "rte": "route", "sq": "square",
    "fg": "faubourg", "fbg": "faubourg", "res": "residence", "bat": "batiment", "appt": "appartement", "apt": "appartement",
    "st": "saint", "ste": "sainte", "sts": "saints", "quai": "quai",
}
LEGAL_FORMS = ("sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "scop", "scs", "sca", "gie", "asso", "association", "ei", "eirl", "sel", "selarl")


def _folding() -> tuple[str, str]:
    """Latin letters that canonical decomposition turns into one base character and marks, with their bases."""
    marked, base = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        kept = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
        if len(kept) == 1 and kept[0] != c:
            marked.append(c)
            base.append(kept[0])
    return "".join(marked), "".join(base)


_MARKED, _BASE = _folding()
_MARKS = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))


def without_accents(x: Column) -> Column:
    """Drops combining marks and replaces accented Latin letters by their base; ASCII values skip both."""
    folded = F.translate(x, _MARKED + _MARKS, _BASE)
    return F.when(x.rlike("^[\\x00-\\x7F]*$"), x).otherwise(folded)


def plain(x: Column) -> Column:
    """Lower case without accents; runs of anything but digits and a-z become one space; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(without_accents(x)), "[^0-9a-z]+", " ")), F.lit(""))


def joined_initials(x: Column) -> Column:
    """Joins runs of two or more single letters."""
    return F.regexp_replace(x, "(?<=\\b[a-z]) (?=[a-z]\\b)", "")


def last_name(x: Column) -> Column:
    """Plain, initials joined, legal forms left out unless nothing else is there."""
    words = F.split(joined_initials(plain(x)), " ")
    kept = F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS))
    return F.array_join(F.when(F.size(kept) == 0, words).otherwise(kept), " ")


def _expanded(x: Column, table: dict[str, str]) -> Column:
    words = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.array_join(F.transform(F.split(plain(x), " "), lambda w: F.coalesce(F.element_at(words, w), w)), " ")


def city(x: Column) -> Column:
    return _expanded(x, {k: v for k, v in STREET.items() if k in ("st", "ste")})


def address(x: Column) -> Column:
    return _expanded(x, STREET)


def email(x: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(x, "(?U)\\s+", "")), F.lit(""))


def digits(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x, "[^0-9]", ""), F.lit(""))


def phone(x: Column) -> Column:
    d = digits(x)
    n = F.length(d)
    return F.when(d.startswith("0033") & (n == 13), F.concat(F.lit("0"), F.substring(d, 5, 9))).when(d.startswith("33") & (n == 11), F.concat(F.lit("0"), F.substring(d, 3, 9))).otherwise(d)


def birth_date(x: Column) -> Column:
    """Year-first, eight digits, or day-first, to zero-padded ISO; anything else as plain text. No calendar check."""
    t = F.trim(x)
    two = lambda c: F.lpad(c, 2, "0")
    shapes = [("^(\\d{4})[^0-9](\\d{1,2})[^0-9](\\d{1,2})$", (1, 2, 3)), ("^(\\d{4})(\\d{2})(\\d{2})$", (1, 2, 3)), ("^(\\d{1,2})[^0-9](\\d{1,2})[^0-9](\\d{4})$", (3, 2, 1))]
    out = None
    for pattern, (y, m, d) in shapes:
        g = lambda k, p=pattern: F.regexp_extract(t, p, k)
        value = F.concat_ws("-", g(y), two(g(m)), two(g(d)))
        out = F.when(t.rlike(pattern), value) if out is None else out.when(t.rlike(pattern), value)
    return out.otherwise(plain(x))


NORMALISERS = {"last_name": last_name, "first_name": plain, "birth_date": birth_date, "address": address, "postal_code": digits, "city": city, "email": email, "phone": phone}


def normalize(records: DataFrame) -> DataFrame:
    """The ten known columns, attributes normalised; null, empty and empty after normalisation are one state."""
    return records.select(ID, SOURCE, *(NORMALISERS[a](F.col(a).cast("string")).alias(a) for a in ATTRIBUTES))
