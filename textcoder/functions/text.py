"""Column expressions for text: cleaning, stripping, document text, ids.

All are built-in Spark expressions (codegen, no Python in the row path).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/str.strip() whitespace = Unicode White_Space plus the
# four separators U+001C..U+001F; Java's (?U)\s covers the former.
_WS = r"[\s\x{1c}-\x{1f}]"
_WS_RUN = r"(?U)" + _WS + "+"
_EDGES = r"(?U)^" + _WS + "+|" + _WS + "+$"

# Document text headers and the id namespace name.
CODE_HEADER = "# Code: "
TITLE_HEADER = "# Title: "
INCLUDES_HEADER = "## Includes:"
INCLUDES_ALSO_HEADER = "## Also includes:"
EXCLUDES_HEADER = "## Excludes:"
ID_NAMESPACE_NAME = "nace-rev2"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Null stays null; whitespace runs become one blank; strip; empty -> null."""
    return F.nullif(F.trim(F.regexp_replace(_c(col), _WS_RUN, " ")), F.lit(""))


def strip(col) -> Column:
    """Remove leading and trailing whitespace only (as ``str.strip``)."""
    return F.regexp_replace(_c(col), _EDGES, "")


def assemble_text(code, heading, includes, includes_also, excludes, *,
                  with_includes_also: bool = True, with_excludes: bool = True) -> Column:
    """``# Code``/``# Title`` lines, then one block per present optional field.

    Fields are expected cleaned (null when empty). Each block is a blank line,
    its header and its content; lines are joined by newlines, two-character
    ``\\n`` sequences become real newlines and the result is stripped.
    """
    def block(header: str, value) -> Column:
        v = _c(value)
        return F.when(v.isNotNull(), F.concat(F.lit("\n" + header + "\n"), strip(v)))

    parts = [F.concat(F.lit(CODE_HEADER), _c(code)), F.concat(F.lit(TITLE_HEADER), _c(heading)),
             block(INCLUDES_HEADER, includes)]
    if with_includes_also:
        parts.append(block(INCLUDES_ALSO_HEADER, includes_also))
    if with_excludes:
        parts.append(block(EXCLUDES_HEADER, excludes))
    joined = F.concat_ws("\n", *parts)
    return strip(F.replace(joined, F.lit("\\n"), F.lit("\n")))


def namespace_hex(name: str = ID_NAMESPACE_NAME) -> str:
    """Hex of ``uuid5(NAMESPACE_DNS, name)``: the namespace of point ids."""
    return uuid.uuid5(uuid.NAMESPACE_DNS, name).hex


def uuid5(col, namespace: str | None = None) -> Column:
    """RFC 4122 name-based (SHA-1) UUID of a string column, canonical 36-char text.

    ``sha1(namespace bytes || UTF-8 name)``, first 16 bytes, version nibble 5,
    variant bits 10xx. Equal to Python's ``uuid.uuid5`` for any Unicode name.
    """
    ns = namespace or namespace_hex()
    h = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(_c(col), "UTF-8")))
    variant = F.lower(F.hex(F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4))
                            + F.lit(8)))
    return F.when(_c(col).isNotNull(), F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def char_count(col, char: str) -> Column:
    """occurrences of one character."""
    return F.length(_c(col)) - F.length(F.replace(_c(col), F.lit(char), F.lit("")))


def basename_stem(col) -> Column:
    """F8: file name without directories and without its last extension."""
    base = F.regexp_extract(_c(col), r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def tokens(col) -> Column:
    """Lower-cased word tokens: maximal runs of Unicode letters and digits."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(r"[\p{L}\p{N}]+"), 0)
