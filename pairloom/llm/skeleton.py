"""Text that looks the same made equal: the confusables skeleton.

A text is decomposed, every character is replaced by its prototype and the result is decomposed again. Originals with
one skeleton look alike. Width, composition, invisible characters, the kind of space or hyphen, ligatures and
look-alike letters of other scripts vanish; case, accents, voicing marks, punctuation and wording stay.

Defined results: NULL has no skeleton; empty text and text of invisible characters alone have the empty skeleton.
Text of printable ASCII is its own skeleton and never leaves the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pairloom.functions.jsonx import as_object

#: Letters of other scripts and the Latin letters they look like, in the order of their scripts.
LOOK_ALIKES = (
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("αγινορυϲϳ", "ayivopucj"),
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮҺӀ", "ABESIJKMHOPCTYXGQWYhl"), ("аеорсухѕіјһԁԛԝүӏ", "aeopcyxsijhdqwyl"),
    # Armenian
    ("ՍՏՕԼ", "USOL"), ("օսոհցքյզ", "ounhgfjq"),
    # Cherokee and Lisu
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZbRWVSLCPKB"), ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    # Roman numerals and letter-like forms that keep no compatibility mapping
    ("ıȷɑɡ", "ijag"),
)

#: Hyphens of other code points.
HYPHENS = "\u2010\u2011\u2012\u2013\u2212\u02d7\u2043\ufe63\uff0d"

#: Characters without a glyph that are no format characters by category.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u3164\uffa0"

#: Compatibility forms that differ in width, spacing or joining only.
_FORMS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>")


def prototype(char: str) -> str:
    """The prototype of one decomposed character."""
    return _TABLE.get(ord(char), char)


class _Prototypes(dict):
    """Prototypes by code point, worked out on first use from the character's own properties and the look-alikes."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        category = unicodedata.category(char)
        form = unicodedata.decomposition(char)
        if category == "Cf" or char in UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            found = ""
        elif category == "Zs" or char in "\t\n\r\x0b\x0c\x85\u2028\u2029":
            found = " "
        elif form.startswith(_FORMS) or (form.startswith("<compat>") and category in ("Ll", "Lu", "Lt", "Lo")):
            found = "".join(self[ord(c)] for c in unicodedata.normalize("NFKD", char))
        else:
            found = char
        self[code] = found
        return found


_TABLE = _Prototypes({ord(a): b for alike, latin in LOOK_ALIKES for a, b in zip(alike, latin, strict=True)} | {ord(h): "-" for h in HYPHENS})


def skeleton_of(text: str) -> str:
    """The skeleton of one text."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE))


def _skeletons(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda text: None if text is None else skeleton_of(text))


def skeleton(c: Column) -> Column:
    """The skeleton of a string column; only text outside printable ASCII goes to Python."""
    odd = F.regexp_like(c, F.lit(r"[^\x20-\x7e]"))
    return F.coalesce(F.pandas_udf(_skeletons, StringType())(F.when(odd, c)), c)


def _folds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda text: None if text is None else fold_words(text))


class _Folds(dict):
    """What each character folds to, worked out on first use."""

    def __missing__(self, code: int) -> str:
        text = unicodedata.normalize("NFKD", skeleton_of(chr(code)).replace("º", "o").replace("ª", "a")).casefold()
        self[code] = found = "".join(c for c in text if not unicodedata.combining(c))
        return found


_FOLDS = _Folds()


def fold(text: str) -> str:
    """Look-alikes, case, accents and spacing taken away."""
    return " ".join((text.lower() if text.isascii() else text.translate(_FOLDS)).split())


def fold_words(text: str) -> str:
    """``fold``, but words of other scripts come out the same in small letters and in capitals.

    Look-alikes differ by case (В has one, в none), so these words are folded as capitals: those with a letter that
    looks like no Latin one and, beside such a word, those without any Latin letter.
    """
    whole = fold(text)
    if whole.isascii():
        return whole
    out = []
    for word in text.split():
        plain = fold(word)
        latin = plain.isascii() and any("a" <= c <= "z" for c in word.lower())
        out.append(plain if latin else fold(word.upper()))
    return " ".join(out)


def folded_words(c: Column) -> Column:
    """The words of a text without look-alikes, case, accents and punctuation, one space between them."""
    odd = F.regexp_like(c, F.lit(r"[^\x20-\x7e]"))
    plain = F.coalesce(F.pandas_udf(_folds, StringType())(F.when(odd, c)), F.lower(c))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def main_name(c: Column) -> Column:
    """``primary``, else ``raw``, of a names column; unreadable JSON has none."""
    names = as_object(c, "primary:string,raw:string")
    return F.coalesce(F.when(F.trim(names["primary"]) != "", names["primary"]), names["raw"])


def alike_pairs(df: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """Rows of which ``left`` and ``right`` differ in characters but have one skeleton: (key, left, right, skeleton).

    Rows with a NULL side or equal sides are no such pairs; repeated rows count once.
    """
    rows = df.select(F.col(key), left.alias("left_text"), right.alias("right_text")).filter(F.col("left_text") != F.col("right_text"))
    rows = rows.filter(F.regexp_like(F.concat("left_text", "right_text"), F.lit(r"[^\x20-\x7e]")))
    both = rows.select("*", skeleton(F.col("left_text")).alias("skeleton"), skeleton(F.col("right_text")).alias("other"))
    return both.filter(F.col("skeleton") == F.col("other")).drop("other").distinct()


def look_alike_groups(texts: DataFrame, column: str) -> DataFrame:
    """(skeleton, n_forms, n_rows) of every skeleton written in more than one way.

    Rows are counted by spelling first, so a text that fills a third of the table is one row when groups are formed.
    """
    forms = texts.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    forms = forms.select(skeleton(F.col("form")).alias("skeleton"), "n")
    groups = forms.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_rows"))
    return groups.filter(F.col("n_forms") > 1)
