"""Text normalisation, exactly in Python and as JVM columns.

The order is fixed: Unicode form, strip, case folding, punctuation to spaces,
white space. A column judges each row: a text of plain code points only is
in every step as the JVM has it, and never leaves it; any other text runs through
the Python form as an Arrow function. Plain are the code points that the form
leaves alone, that no neighbour can change, that fold to one letter (or are the
German sharp s), and that were letters, digits or signs in Unicode 3.2 already.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split sees it.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same as a pattern that is quick in the JVM.
_WHITE = r"(?U)[\s\x1c-\x1f]"
WHITES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_FORMS = ("NFC", "NFD", "NFKC", "NFKD")
_RUN = re.compile(r"\s+")
_SIGN = re.compile(r"[^\w\s]")


#: Blocks whose plain code points are judged in the JVM: Latin, Greek, Cyrillic, punctuation, currency, kana, Han, Hangul.
_BLOCKS = ((0x0, 0x24F), (0x370, 0x52F), (0x2010, 0x205E), (0x20A0, 0x20BF), (0x3001, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: Shorter runs of plain code points stay out, so that the class of a row stays short.
_RUN_FROM = 5


@functools.cache
def _followers() -> frozenset[int]:
    """Code points that a composing form may join to the one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset({int(p[1], 16) for p in pairs if len(p) == 2 and p[0][0] != "<"} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)})


@functools.cache
def plain_runs(form: str) -> tuple[tuple[int, int], ...]:
    """First and last code points of the runs of plain ones."""

    def plain(c: int) -> bool:
        x = chr(c)
        kinds = unicodedata.category(x), unicodedata.ucd_3_2_0.category(x)
        word = kinds[0][0] in "LN"
        return (
            "Cn" not in kinds and word == (kinds[1][0] in "LN") and bool(re.match(r"\w", x)) == (word or x == "_")
            and unicodedata.normalize(form, x) == x and not unicodedata.combining(x) and c not in _followers() and (len(x.casefold()) == 1 or x == "ß")
        )

    runs: list[list[int]] = []
    for c in (c for a, b in _BLOCKS for c in range(a, b + 1) if plain(c)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return tuple((a, b) for a, b in runs if b - a + 1 >= _RUN_FROM)


@functools.cache
def _refolded(form: str) -> tuple[str, str]:
    """Plain letters that fold to another letter than their lower case, and what they fold to. The capital sigma's lower case depends on its place."""
    letters = [x for a, b in plain_runs(form) for x in map(chr, range(a, b + 1)) if x != "ß" and (x.lower() != x.casefold() or x == "Σ")]
    return "".join(letters), "".join(x.casefold() for x in letters)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class TextNormalizer:
    """An explicit policy for comparing texts."""

    unicode_form: str = "NFC"
    lowercase: bool = False
    collapse_whitespace: bool = True
    strip_punctuation: bool = False

    def __post_init__(self) -> None:
        if self.unicode_form not in _FORMS:
            raise ValueError(f"unicode_form must be one of {', '.join(_FORMS)}")
        for k in ("lowercase", "collapse_whitespace", "strip_punctuation"):
            if not isinstance(getattr(self, k), bool):
                raise TypeError(f"{k} must be a boolean")

    def __call__(self, value: Any) -> str:
        if not isinstance(value, str):
            raise TypeError(f"text metrics need strings, not {type(value).__name__}")
        text = unicodedata.normalize(self.unicode_form, value).strip()
        text = text.casefold() if self.lowercase else text
        text = _SIGN.sub(" ", text) if self.strip_punctuation else text
        return _RUN.sub(" ", text).strip() if self.collapse_whitespace else text

    def tokenize(self, value: Any) -> list[str]:
        return self(value).split()

    def plain(self, text: Column) -> Column:
        """Whether a text has plain code points only; ASCII is known by its length."""
        runs = plain_runs(self.unicode_form)
        beyond = lambda own: text.rlike("[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in own) + "]")
        return (F.length(text) == F.octet_length(text)) | ~beyond([r for r in runs if r[1] < 0x250]) | ~beyond(runs)

    def exact(self, text: Column) -> Column:
        """The Python form as an Arrow function; null for null."""

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(self, na_action="ignore")

        return run(text)

    def _plain_column(self, text: Column) -> Column:
        out = F.btrim(text, F.lit(WHITES))
        if self.lowercase:
            letters, folded = _refolded(self.unicode_form)
            full = F.replace(F.lower(F.translate(out, letters, folded)), F.lit("ß"), F.lit("ss"))
            out = F.when(F.length(out) == F.octet_length(out), F.lower(out)).otherwise(full)
        if self.strip_punctuation:
            out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_{SPACES}]", " ")
        if self.collapse_whitespace:
            out = F.trim(F.regexp_replace(out, f"{_WHITE}+", " "))
        return out

    def column(self, text: Column) -> Column:
        """The normalised text; equal to the Python form for all input."""
        return F.coalesce(self.exact(F.when(~self.plain(text), text)), self._plain_column(text))

    def tokens(self, text: Column) -> Column:
        """The JVM form of ``tokenize``."""
        return F.filter(F.split(self.column(text), f"{_WHITE}+"), lambda t: t != "")

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)
