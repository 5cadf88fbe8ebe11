"""Scalar text functions over columns.

All are plain Spark SQL expressions so they stay inside whole-stage codegen
(regexp, md5, substring, concat) and push through projections untouched.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import config

ColumnOrName = Column | str

# Suffix of the last path component, as a POSIX path suffix: "a.tar.gz" ->
# ".gz", ".bashrc" -> "", "foo." -> "".  Works on a whole path because
# neither group can cross a "/".
SUFFIX_REGEX = r"(?s)^(?:.*/)?[^/]+(\.[^./]+)$"

# Characters Python's str.strip() removes (str.isspace), spelled so both
# Java regex and RE2 read them the same way.
PY_WHITESPACE = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Word tokens for hashed term vectors: letters, digits and underscore.
TOKEN_REGEX = r"[\p{L}\p{N}_]+"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_extension(path: ColumnOrName) -> Column:
    """File extension of a path, with the leading dot; "" when none."""
    return F.regexp_extract(_c(path), SUFFIX_REGEX, 1)


def path_has_ignored_dir(path: ColumnOrName, ignore: Iterable[str] = config.IGNORE_DIRS,
                         root: ColumnOrName | None = None) -> Column:
    """True when any "/"-separated component of ``path`` is in ``ignore``.

    Every component counts, the file name too, as in a test over
    ``Path.parts``.  Pass the path relative to the scanned root so a root
    that itself sits below e.g. ``build/`` still yields files; give ``root``
    to test the root's own components as well.
    """
    parts = F.split(_c(path), "/")
    if root is not None:
        parts = F.concat(F.split(_c(root), "/"), parts)
    return F.coalesce(
        F.arrays_overlap(parts, F.array(*[F.lit(d) for d in sorted(ignore)])),
        F.lit(False),
    )


def normalize_newlines(text: ColumnOrName) -> Column:
    """Universal-newline reading: CRLF and lone CR become LF."""
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def decode_text(raw: ColumnOrName) -> Column:
    """Bytes to text: UTF-8 when valid, else ISO-8859-1 (which never fails,
    so no third fallback is reachable)."""
    as_utf8 = _c(raw).cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(_c(raw), "ISO-8859-1"))


def content_hash(text: ColumnOrName) -> Column:
    """md5 hex digest of the UTF-8 encoding of the text."""
    return F.md5(_c(text).cast("binary"))


def embedding_text(path: ColumnOrName, content: ColumnOrName) -> Column:
    """Text handed to the embedder for a document (queries go in bare)."""
    return F.concat(F.lit("File: "), _c(path), F.lit("\n\nContent:\n"), _c(content))


def preview(content: ColumnOrName, n: int = config.PREVIEW_CHARS) -> Column:
    """Strip, newlines to spaces, first ``n`` characters, then "..."."""
    stripped = F.regexp_replace(_c(content), f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$", "")
    flat = F.replace(stripped, F.lit("\n"), F.lit(" "))
    return F.concat(F.substring(flat, 1, n), F.lit("..."))


def repo_name_from_url(url: ColumnOrName, strict_compat: bool = False) -> Column:
    """Repository name from a clone URL or path: the last "/" segment with
    ".git" removed.  ``strict_compat`` removes every ".git" occurrence
    (so "my.github.io" -> "myhub.io") as the original tool did; otherwise
    only a trailing ".git" is stripped and a trailing "/" is ignored."""
    if strict_compat:
        return F.replace(F.element_at(F.split(_c(url), "/"), -1), F.lit(".git"), F.lit(""))
    trimmed = F.regexp_replace(_c(url), "/+$", "")
    return F.regexp_replace(F.element_at(F.split(trimmed, "/"), -1), r"\.git$", "")


def tokens(text: ColumnOrName) -> Column:
    """Lower-cased word tokens, in order, as ARRAY<STRING>."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_REGEX), 0)


def term_bucket(token: ColumnOrName, num_buckets: int = config.DEFAULT_NUM_BUCKETS) -> Column:
    """Hash a token into [0, num_buckets): first 32 bits of its md5 as an
    unsigned integer, modulo the width.  md5 is used (not xxhash64) so any
    SQL engine can reproduce the exact bucket."""
    hi32 = F.conv(F.substring(F.md5(_c(token).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(hi32, F.lit(num_buckets)).cast("int")
