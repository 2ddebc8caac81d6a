"""Text clean-up and list extraction as Column functions.

Everything runs as built-in expressions except Unicode decomposition, for which Spark
has no function; that one step is an Arrow UDF over pyarrow's own kernel, and rows that
are pure ASCII are sent to it as nulls.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.schema import ABBREVIATIONS

# What str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

TAG = r"<[^>]+>"
# White space and all characters that are not kept.
GAP = r"[^\p{L}\p{N}_.,\-()/:]+"
CLAIM_NUMBER = r"\s*\p{Nd}+\.\s*"
REFERENCE_MARK = r"\[\p{Nd}+\]|\(\p{Nd}+\)"
PERSON_TITLE = r"(?U)\b(Dr\.|Prof\.|Mr\.|Ms\.|Mrs\.|Jr\.|Sr\.|PhD|MD)\b"
IPC_SHAPE = r"^[A-H]\p{Nd}{2}[A-Z]\p{Nd}+/\p{Nd}+"

MIN_EXTRACTED_CLAIM = 20
MIN_CODE = 3


def _decompose(values: pa.Array) -> pa.Array:
    return pc.utf8_normalize(values, form="NFKD")


def _decompose_lists(values: pa.Array) -> pa.Array:
    flat = pc.utf8_normalize(values.flatten(), form="NFKD")
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, flat, mask=pc.is_null(values))


# Declared non-deterministic only to keep Spark from copying a cleaned text, with all
# its expressions, into each later use of the column.
_decompose_udf = F.arrow_udf(_decompose, T.StringType()).asNondeterministic()
_decompose_lists_udf = F.arrow_udf(_decompose_lists, T.ArrayType(T.StringType())).asNondeterministic()


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_tags(c: Column) -> Column:
    # Most texts have no tag, and looking for one character is cheap.
    return F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, TAG, "")).otherwise(c)


def expand_abbreviations(c: Column) -> Column:
    for short, full in ABBREVIATIONS.items():
        c = F.replace(c, F.lit(short), F.lit(full))
    return c


def normalize_whitespace(c: Column) -> Column:
    """Drop special characters, keep one blank between words."""
    return F.trim(F.regexp_replace(c, GAP, " "))


def _has_foreign(c: Column) -> Column:
    """True where a text has characters beyond ASCII: they take more than one byte."""
    return F.octet_length(c) != F.length(c)


def decompose(c: Column) -> Column:
    """Unicode NFKD."""
    return F.coalesce(_decompose_udf(F.when(_has_foreign(c), c)), c)


def _decompose_each(c: Column) -> Column:
    foreign = F.exists(c, _has_foreign)
    return F.coalesce(_decompose_lists_udf(F.when(foreign, c)), c)


def _tidy(c: Column) -> Column:
    return normalize_whitespace(expand_abbreviations(c))


def clean_text(c: Column) -> Column:
    return _tidy(decompose(strip_tags(F.coalesce(c, F.lit("")))))


def clean_each(c: Column) -> Column:
    """clean_text over every element of an array of strings."""
    return F.transform(
        _decompose_each(F.transform(c, lambda x: strip_tags(F.coalesce(x, F.lit(""))))), _tidy
    )


def extract_claims(c: Column) -> Column:
    """Cut a numbered claims section into its claims."""
    # The first part is what stands before the first number.
    parts = F.filter(F.split(clean_text(c), CLAIM_NUMBER), lambda x, i: i > 0)
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > MIN_EXTRACTED_CLAIM)
    # Already decomposed and without tags, so only the later steps can still change it.
    cleaned = F.transform(kept, lambda x: _tidy(F.regexp_replace(x, REFERENCE_MARK, "")))
    return F.filter(cleaned, lambda x: x != "")


def _split_names(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,|]"), strip)
    return F.filter(parts, lambda x: x != "")


def split_list(c: Column) -> Column:
    """The list form of a `|`-separated cell."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda x: x != "")


def _first_key(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[
        F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys
    ])


def _shape(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, ... of a variant, without the element types."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _names_of_variant(v: Column, list_keys: tuple[str, ...], object_keys: tuple[str, ...]) -> Column:
    def of_element(x: Column) -> Column:
        return F.when(_shape(x) == "STRING", F.try_variant_get(x, "$", "string")).when(
            _shape(x) == "OBJECT", _first_key(x, list_keys)
        )

    elements = F.try_variant_get(v, "$", "array<variant>")
    names = (
        F.when(_shape(v) == "STRING", _split_names(F.try_variant_get(v, "$", "string")))
        .when(_shape(v) == "ARRAY", F.transform(elements, of_element))
        .when(_shape(v) == "OBJECT", F.array(_first_key(v, object_keys)))
        .otherwise(F.array().cast("array<string>"))
    )
    names = F.coalesce(names, F.array().cast("array<string>"))
    return F.transform(F.filter(names, lambda x: x.isNotNull()), strip)


def _clean_names(names: Column) -> Column:
    return F.filter(clean_each(names), lambda x: x != "")


def _without_titles(names: Column) -> Column:
    return F.transform(names, lambda x: F.regexp_replace(x, PERSON_TITLE, ""))


def _valid_codes(codes: Column) -> Column:
    upper = F.transform(codes, lambda x: F.upper(strip(x)))
    return F.filter(upper, lambda x: x.rlike(IPC_SHAPE) | (F.length(x) >= MIN_CODE))


def extract_inventors(c: Column) -> Column:
    """Names out of one delimited string."""
    return _clean_names(_without_titles(_split_names(c)))


def extract_assignees(c: Column) -> Column:
    return _clean_names(_split_names(c))


def extract_classification_codes(c: Column) -> Column:
    return _valid_codes(_split_names(c))


def extract_inventors_variant(v: Column) -> Column:
    """Names out of a JSON value: text, a list of texts or objects, or one object."""
    keys = ("name", "full_name")
    return _clean_names(_without_titles(_names_of_variant(v, (*keys, "inventor_name"), keys)))


def extract_assignees_variant(v: Column) -> Column:
    keys = ("name", "assignee_name", "organization")
    return _clean_names(_names_of_variant(v, (*keys, "company"), keys))


def extract_classification_codes_variant(v: Column) -> Column:
    keys = ("code", "classification_code", "ipc_code")
    return _valid_codes(_names_of_variant(v, (*keys, "class"), keys))


def format_date(c: Column) -> Column:
    """YYYYMMDD and YYMMDD to YYYY-MM-DD; any other shape keeps its digits and hyphens."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{Nd}\-]", "")
    century = F.when(F.substring(digits, 1, 2) < "50", "20").otherwise("19")
    return (
        F.when(
            digits.rlike(r"^[0-9]{8}$"),
            F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)),
        )
        .when(
            digits.rlike(r"^[0-9]{6}$"),
            F.concat_ws(
                "-",
                F.concat(century, F.substring(digits, 1, 2)),
                F.substring(digits, 3, 2),
                F.substring(digits, 5, 2),
            ),
        )
        .otherwise(digits)
    )
