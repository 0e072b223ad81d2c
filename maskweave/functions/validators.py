"""Checksum validators and word tests as column functions; null in, null or false out."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.functions.dialect import SPACE, TRIM

_MARKED = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1)
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, TRIM, "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks; combining marks are dropped."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{Mn}", "")


def valid_nir(text: Column) -> Column:
    d = without_space(text)
    key = 97 - F.substr(d, F.lit(1), F.lit(13)).try_cast("bigint") % 97
    return F.coalesce((F.length(d) == 15) & (key == F.substr(d, F.lit(14), F.lit(2)).try_cast("int")), F.lit(False))


def valid_iban(text: Column) -> Column:
    clean = F.upper(without_space(text))
    turned = F.concat(F.substr(clean, F.lit(5)), F.substr(clean, F.lit(1), F.lit(4)))
    digit = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.try_cast("int"))
    step = lambda a, c: (a * F.when(c.between("A", "Z"), 100).otherwise(10) + digit(c)) % 97
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.coalesce(F.length(clean).between(15, 34) & (rest == 1), F.lit(False))


def valid_siren(text: Column) -> Column:
    d = without_space(text)
    return F.coalesce(F.length(d).isin(9, 14) & d.rlike(r"^[1-9][0-9]+\z") & ~d.rlike(r"^([0-9])\1+\z") & F.call_function("luhn_check", d), F.lit(False))


def one_of(text: Column, words: tuple[str, ...]) -> Column:
    """Membership in a fixed list, built as one expression: a column per word is slow to build."""
    quoted = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return F.array_contains(F.expr(f"array({quoted})"), text)


def is_stopword(text: Column, words: tuple[str, ...]) -> Column:
    """Every word of the text is in the list (which has single words only)."""
    upper = trim(F.upper(text))
    return F.forall(F.split(upper, f"[{SPACE}]+"), lambda w: one_of(w, words))
