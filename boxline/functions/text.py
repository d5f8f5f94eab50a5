"""Recognised text: cleaning, splitting of combined results, distances, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxline.functions.binding import bind

# Full-width characters and CJK punctuation with their replacements.
WIDE_CHARS = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪａｂｃｄｅ，。？！：；"
NARROW_CHARS = "0123456789ABCDEFGHIJabcde,.?!:;"
# Separators tried for one combined text, in this order.
BATCH_SEPARATORS = ["|", "｜", "I", "l", "1"]
LINE_SEPARATORS = ["|", "｜", "l", "丨", " | "]

# Python strips these as white space; the Java class needs (?U) and lacks U+001C to U+001F there.
_SPACE = "[\\s\\x{1c}-\\x{1f}]"


def strip(text: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def normalise(text: Column, extended: bool = False) -> Column:
    """Strips, narrows full-width characters and collapses white space.

    ``extended`` narrows every full-width letter and straightens curly quotes as well.
    """
    wide, narrow = WIDE_CHARS, NARROW_CHARS
    if extended:
        for start, stop in (("A", "Z"), ("a", "z")):
            for code in range(ord(start), ord(stop) + 1):
                full = chr(code + 0xFEE0)
                if full not in wide:
                    wide, narrow = wide + full, narrow + chr(code)
        wide, narrow = wide + "“”‘’", narrow + "\"\"''"
    return F.regexp_replace(F.translate(strip(text), wide, narrow), f"(?U){_SPACE}+", " ")


def _quoted(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def _padded(parts: Column, n: Column) -> Column:
    missing = F.array_repeat(F.lit(""), F.greatest(n - F.size(parts), F.lit(0)))
    return F.concat(parts, missing)


def _equal_cut(text: Column, n: Column) -> Column:
    size = F.length(text)
    return bind(F.struct(size.alias("all"), F.floor(size / n).cast("int").alias("step")), lambda s:
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.substring(
                text, i * s["step"] + 1, F.when(i < n - 1, s["step"]).otherwise(s["all"])
            ),
        ))


def _stripped(parts: Column) -> Column:
    return F.transform(parts, strip)


def split_batch(text: Column, n: Column, use_separator: bool = True) -> Column:
    """The texts of ``n`` regions recognised in one call.

    The first separator present whose part count is within one of ``n`` decides; then runs of
    two or more spaces; then a cut into equal lengths.
    """
    chosen = F.when(F.coalesce(text, F.lit("")) == "", F.array_repeat(F.lit(""), n))
    chosen = chosen.when(n == 1, F.array(text))
    for separator in BATCH_SEPARATORS if use_separator else []:
        parts = F.split(text, _quoted(separator), -1)
        merged = F.concat(
            F.slice(parts, 1, n - 1),
            F.array(F.array_join(F.slice(parts, n, F.size(parts)), separator)),
        )
        fitted = F.when(F.size(parts) > n, merged).otherwise(_padded(parts, n))
        close = F.contains(text, F.lit(separator)) & (F.abs(F.size(parts) - n) <= 1)
        chosen = chosen.when(close, _stripped(fitted))
    spaced = F.split(text, "(?U)" + _SPACE + "{2,}", -1)
    fitted = F.when(F.size(spaced) > n, F.slice(spaced, 1, n)).otherwise(_padded(spaced, n))
    chosen = chosen.when(F.abs(F.size(spaced) - n) <= 1, _stripped(fitted))
    return chosen.otherwise(_stripped(_equal_cut(text, n)))


def split_lines(text: Column, n: Column) -> Column:
    """The texts of ``n`` packed lines: a separator with the exact count, else equal lengths
    for texts longer than ``2 n``, else everything in the first line."""
    chosen = F.when(F.coalesce(text, F.lit("")) == "", F.array_repeat(F.lit(""), n))
    for separator in LINE_SEPARATORS:
        parts = F.split(text, _quoted(separator), -1)
        exact = F.contains(text, F.lit(separator)) & (F.size(parts) == n)
        chosen = chosen.when(exact, _stripped(parts))
    chosen = chosen.when(F.length(text) > n * 2, _stripped(_equal_cut(text, n)))
    return chosen.otherwise(_padded(F.array(text), n))


def stem(path: Column) -> Column:
    """File name without folder and last ending."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def ending(path: Column) -> Column:
    """Lower-case file ending with its dot."""
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))


def preview(text: Column, size: int = 30) -> Column:
    return F.substring(text, 1, size)


def percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value * 100)


def rounded(value: Column, digits: int = 3) -> Column:
    """Half-even rounding, as Python rounds."""
    return F.bround(value, digits)

