"""Transliteration to ASCII by the names and decompositions that Unicode gives its characters."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters by the names that Unicode gives them, and signs.
GREEK = dict(
    zip(
        "ALPHA BETA GAMMA DELTA EPSILON ZETA ETA THETA IOTA KAPPA LAMDA MU NU XI OMICRON PI RHO SIGMA TAU UPSILON PHI CHI PSI OMEGA".split(),
        "a b g d e z e th i k l m n x o p r s t u ph kh ps o".split(),
        strict=True,
    )
) | {"FINAL SIGMA": "s"}
CYRILLIC = dict(
    zip(
        "A BE VE GHE DE IE IO ZHE ZE I KA EL EM EN O PE ER ES TE U EF HA TSE CHE SHA SHCHA YERU E YU YA YI JE LJE NJE DZHE".split(),
        "a b v g d e io zh z i k l m n o p r s t u f kh ts ch sh shch y e iu ia yi j lj nj dzh".split(),
        strict=True,
    )
) | {"SHORT I": "i", "HARD SIGN": "'", "SOFT SIGN": "'", "BYELORUSSIAN-UKRAINIAN I": "i", "UKRAINIAN IE": "ie"}
LATIN = {"AE": "ae", "OE": "oe", "ETH": "d", "THORN": "th", "SHARP S": "ss", "ENG": "ng", "DOTLESS I": "i"}
SIGNS = dict(
    zip(
        "‐ ‑ ‒ – — ― ‘ ’ ‚ “ ” „ ‹ › « » … • · ′ ″ ⁄ − × ÷ ± ≤ ≥ ≈ ∞ € £ © ® ° ¡ ¿ § ¶".split(),
        "- - - - -- -- ' ' , \" \" ,, < > << >> ... * * ' '' / - x / +- <= >= ~ inf EUR PS (c) (r) deg ! ? SS P".split(),
        strict=True,
    )
)


def _letter(ch: str) -> str | None:
    """A letter by its name; a mark that it is 'WITH' doesn't count."""
    words = unicodedata.name(ch, "").split(" WITH ")[0].split(" ")
    kind = next((k for k in ("LETTER", "LIGATURE") if k in words), None)
    if kind is None or words[0] not in ("GREEK", "CYRILLIC", "LATIN"):
        return None
    name = " ".join(words[words.index(kind) + 1 :])
    table = {"GREEK": GREEK, "CYRILLIC": CYRILLIC, "LATIN": LATIN}[words[0]]
    out = table.get(name) or (name.lower() if words[0] == "LATIN" and len(name) == 1 else None)
    return out.capitalize() if out and "CAPITAL" in words else out


@cache
def ascii_of(ch: str) -> str:
    """A character in ASCII; nothing for one that has no such form here."""
    if ch.isascii():
        return ch
    found = SIGNS.get(ch)
    if found is None:
        found = _letter(ch)
    if found is not None:
        return found
    parts = [x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)]
    return "".join(ascii_of(x) for x in parts) if parts != [ch] else ""


@F.pandas_udf(StringType())
def _transliterated(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else "".join(map(ascii_of, unicodedata.normalize("NFC", t))))


def transliterated(c: Column) -> Column:
    """The text in ASCII: letters of Latin, Greek and Cyrillic script, ligatures, forms and common signs by what they stand for; other characters go. Null stays null."""
    return _transliterated(c)
