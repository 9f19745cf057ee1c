"""Text expressions: titles, names, transcript numbers and line breaks.

All of them are Column to Column and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a title may not carry into a file name.
SLUG_DROP = r'[<>:"/\\|?*\[\]]'
SAFE_TITLE_FROM = '|:/\\?*<>"'
SAFE_TITLE_TO = "----"
SLUG_LENGTH = 80
NAME_SUFFIX = "_short.mp4"
NAME_FALLBACK = "output"


def strip(col: Column | str) -> Column:
    """Remove Unicode whitespace on both sides (``trim`` only knows the space)."""
    return F.regexp_replace(_col(col), r"(?U)^\s+|\s+$", "")


def slug(col: Column | str) -> Column:
    """File-name form of a title.  The cut to 80 characters comes last on purpose."""
    dropped = F.regexp_replace(F.lower(_col(col)), SLUG_DROP, "")
    dashed = F.regexp_replace(dropped, r"(?U)[\s_]+", "-")
    single = F.regexp_replace(dashed, "-+", "-")
    return F.substring(F.regexp_replace(single, "^-|-$", ""), 1, SLUG_LENGTH)


def safe_title(col: Column | str) -> Column:
    """Title with separators turned to ``-`` and other unsafe characters removed."""
    return F.translate(_col(col), SAFE_TITLE_FROM, SAFE_TITLE_TO)


def title_from_path(path: Column | str, downloaded: Column | bool = False) -> Column:
    """Base name without its last extension; a leading-dot name keeps its dot."""
    path = _col(path)
    flag = downloaded if isinstance(downloaded, Column) else F.lit(downloaded)
    path = F.when(flag, F.replace(path, F.lit(".webm"), F.lit(".mp4"))).otherwise(path)
    base = F.regexp_replace(path, r"(?s)^.*/", "")
    return F.regexp_replace(base, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def session_key(*cols: Column | str) -> Column:
    """Eight characters that identify a run; derived from data, so retries agree."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8)


def output_name(title: Column | str, session: Column | str) -> Column:
    """``{slug}_{session}_short.mp4``; a null or empty title becomes ``output``."""
    title = _col(title)
    stem = F.when(title.isNull() | (title == ""), F.lit(NAME_FALLBACK)).otherwise(slug(title))
    return F.concat(stem, F.lit("_"), _col(session), F.lit(NAME_SUFFIX))


def seconds_text(col: Column | str) -> Column:
    """A time as plain decimal digits with at least one decimal (``12.0``, ``0.5``).

    Casting a double switches to exponents from 1E7 up and below 1E-3; those
    values pass through an exact decimal instead.
    """
    col = _col(col)
    plain = col.cast("string")
    exact = F.regexp_replace(plain.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(plain.contains("E"), exact).otherwise(plain)


def wrap_text(col: Column | str, max_chars: int = 35) -> Column:
    """Greedy line breaks by words, lines joined with a newline.

    Text that fits is returned untouched.  Longer text is split on whitespace; a
    word longer than a line stays whole on a line of its own.  One regex pass over
    the text, so the cost is linear and no array is built per row.
    """
    col = _col(col)
    words = F.regexp_replace(strip(col), r"(?U)\s+", " ")
    broken = F.regexp_replace(words, rf"(.{{1,{max_chars}}}|[^ ]+)(?: |$)", "$1\n")
    lines = F.regexp_replace(broken, r"\n$", "")
    return F.when(F.length(col) <= max_chars, col).otherwise(lines)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
