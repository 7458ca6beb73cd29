"""Text clean-up and extraction as Column -> Column functions.

Whitespace is Unicode whitespace plus the four ASCII separators, which is what
Python's `str.strip` and `str.split` remove. It is spelled out, because Java's
`\\s` is ASCII only and its Unicode mode is slow.
"""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The escape sequences, fences and prompts the extraction rules are defined by.
ESCAPE_SEQUENCE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
COLOR_PAIR = r"\x1b\[\d+;\d+m"
COLOR = r"\x1b\[\d+m"
FENCED_CODE = r"(?s)```(python)?\n*(.*?)\n*```"
WHOLE_TEXT_CODE = r"(?sd)^(```(python)?)?\n?(.*?)\n?(```)?$"
FENCE = "```"
ANY_FENCED = r"```[\s\S]*?```"
ELLIPSIS = "..."
OUTPUT_SEPARATOR = "\n---\n"
BLOCK_SEPARATOR = "\n\n"

SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PROMPT = rf"(?md)^>>>{SPACE}?"


def strip(text: Column) -> Column:
    """Trim all whitespace, not only blanks."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def squeeze(text: Column) -> Column:
    """Trim, and turn every whitespace run into one blank."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def clean_console(text: Column) -> Column:
    """Console output without escape sequences, on one line.

    Removing a sequence can bring the parts of another together, hence the two
    color passes; they only run on texts that still hold an escape character.
    """
    once = F.regexp_replace(text, ESCAPE_SEQUENCE, "")
    again = F.regexp_replace(F.regexp_replace(once, COLOR_PAIR, ""), COLOR, "")
    return squeeze(F.when(F.instr(once, "\x1b") > 0, again).otherwise(once))


def unescape_newlines(text: Column) -> Column:
    """A literal backslash-n becomes a line feed."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def clean_cell(code: Column) -> Column:
    return unescape_newlines(strip(code))


def join_outputs(outputs: Column) -> Column:
    """Several outputs as one text; escaped line feeds are restored after joining."""
    return unescape_newlines(F.array_join(outputs, OUTPUT_SEPARATOR))


def join_blocks(blocks: Column) -> Column:
    return F.array_join(blocks, BLOCK_SEPARATOR)


def truncate(text: Column, length: int = 300) -> Column:
    """At most `length` characters, marked with an ellipsis when cut."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit(ELLIPSIS))).otherwise(text)


def prefix(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))


def _compiles(code: str | None) -> bool:
    """Whether the text is a Python module. It is never run."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(code or "", "<text>", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def compiles_as_python(source: pd.Series) -> pd.Series:
    return source.map(_compiles, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compiling(candidates: pd.Series) -> pd.Series:
    return candidates.map(lambda codes: [c for c in codes if _compiles(c)], na_action="ignore")


def code_candidates(text: Column) -> Column:
    """Fenced blocks, or the whole text when there is no complete fence."""
    fenced = F.regexp_extract_all(text, F.lit(FENCED_CODE), F.lit(2))
    whole = F.array(F.regexp_extract(text, WHOLE_TEXT_CODE, 3))
    return F.when(F.size(fenced) > 0, fenced).otherwise(whole)


def extract_code(df: DataFrame, text: str, alias: str) -> DataFrame:
    """Adds the candidates that compile as Python, joined with a blank line.

    The compile check is one Arrow-batched call per row's array, so no array is
    exploded and regrouped.
    """
    candidates = code_candidates(F.col(text))
    return df.withColumn(alias, join_blocks(_compiling(candidates)))


def text_before_code(text: Column) -> Column:
    found = F.instr(text, FENCE) > 0
    return F.when(found, strip(F.substring_index(text, FENCE, 1))).otherwise(F.when(text.isNotNull(), F.lit("")))


def text_outside_code(text: Column) -> Column:
    """Prose around fenced blocks, without stray backticks and interpreter prompts."""
    pieces = F.split(text, ANY_FENCED, -1)

    def tidy(piece: Column) -> Column:
        return strip(F.regexp_replace(F.replace(piece, F.lit("`"), F.lit("")), PROMPT, ""))

    return join_blocks(F.filter(F.transform(pieces, tidy), lambda piece: piece != ""))


def error_digest(name: Column, message: Column) -> Column:
    """Error name with the first and last three lines of the message."""
    lines = F.split(message, "\n", -1)
    first = F.slice(lines, 1, 3)
    last = F.slice(lines, -F.least(F.lit(3), F.size(lines)), F.lit(3))
    return F.concat(
        F.lit("error name:"), name, F.lit("---\n"), F.array_join(first, "\n"), F.lit("...\n"), F.array_join(last, "\n")
    )


def python_float(text: Column) -> Column:
    """Number in the text as Python's `float` reads it, null where it would refuse; NaN counts as no number."""
    bare = strip(text)
    digits = r"\d+(?:_\d+)*"
    number = rf"(?i)\A[+-]?(?:(?:{digits}\.?(?:{digits})?|\.{digits})(?:e[+-]?{digits})?|inf|infinity)\z"
    return F.when(bare.rlike(number), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def stamp(when: Column) -> Column:
    return F.date_format(when, "yyyyMMddHHmmss")


def epoch_id(when: Column) -> Column:
    return F.unix_seconds(when.cast("timestamp"))


def markdown_row(*cells: Column) -> Column:
    """One line of a Markdown table; missing cells read nan."""
    shown = [F.coalesce(c.cast("string"), F.lit("nan")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def quoted_list(lines: Column) -> Column:
    """The lines of a text, each in backticks, as one comma-separated list in their own order."""
    quoted = F.transform(F.split(lines, "\n", -1), lambda x: F.concat(F.lit("`"), x, F.lit("`")))
    return F.array_join(quoted, ", ")


def parse_answer(text: Column, schema: str) -> Column:
    """A model's JSON answer as a typed record, null when it cannot be read as one."""
    found = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(text).isNotNull(), found)


def override(defaults: Column, values: Column) -> Column:
    """Union of two maps; entries of the second win."""
    kept = F.map_filter(defaults, lambda key, _: ~F.map_contains_key(values, key))
    return F.map_concat(kept, values)
