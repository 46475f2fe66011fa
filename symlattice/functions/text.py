"""Scalar text functions as columns, all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The low bytes of FNV-1a's 64-bit offset basis and prime.
FNV_START, FNV_FACTOR = 37, 179
DIM = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def tokens(doc: Column) -> Column:
    """Lower-cased alphanumeric runs, cut before an upper-case letter that follows a lower-case one or a digit."""
    split = F.regexp_replace(doc, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")
    return F.filter(F.split(ascii_lower(split), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def trigrams(name: Column) -> Column:
    """Three-character windows over the letters and digits of the first space-separated word."""
    word = ascii_lower(F.regexp_replace(F.split(name, " ")[0], r"[^\p{IsAlphabetic}\p{N}]", ""))
    n = F.length(word)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def document(name: Column, qualified_name: Column, signature: Column, file_path: Column) -> Column:
    return F.concat_ws(" ", name, qualified_name, signature, file_path)


def bag(doc: Column) -> Column:
    """All tokens of a document, repeats included, and the trigrams of its first word."""
    return F.concat(tokens(doc), trigrams(doc))


def fnv_bucket(token: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, modulo 256. Its low byte depends on low bytes alone, so 8-bit arithmetic will do."""
    digits = F.hex(F.encode(token, "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2))
    of_bytes = F.filter(F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int")), lambda b: b.isNotNull())
    return F.aggregate(of_bytes, F.lit(FNV_START), lambda h, b: h.bitwiseXOR(b) * FNV_FACTOR % DIM)


def sign(bucket: Column) -> Column:
    """The hash's sign: +1 for even buckets, -1 for odd ones."""
    return F.when(bucket % 2 == 0, 1).otherwise(-1)


def word_pattern(word: str) -> str:
    """A regular expression for ``word`` without an identifier character on either side."""
    import re

    return r"(?<![\p{IsAlphabetic}\p{N}_$])" + re.escape(word) + r"(?![\p{IsAlphabetic}\p{N}_$])"


def has_word(line: Column, word: str) -> Column:
    return line.rlike(word_pattern(word)) if word else F.lit(False)


def lines_of(text: Column) -> Column:
    """Lines as an editor counts them: a final newline opens no line, and a carriage return before one is dropped."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def clip(text: Column, most: int = 120) -> Column:
    return F.substring(F.trim(F.translate(text, "\t\r", "  ")), 1, most)


def line_list(numbers: Column, most: int = 6) -> Column:
    """``3,5,9`` with an ellipsis after ``most`` numbers."""
    shown = F.array_join(F.transform(F.slice(numbers, 1, most), lambda n: n.cast("string")), ",")
    return F.when(F.size(numbers) > most, F.concat(shown, F.lit(",…"))).otherwise(shown)
