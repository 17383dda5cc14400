"""String helpers with the source system's (JavaScript) semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters JavaScript's String.prototype.trim removes
# (WhiteSpace and LineTerminator of ECMA-262), as a regex class that both
# Java regex and RE2 accept.
JS_SPACE = (r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")
JS_TRIM_RE = "^" + JS_SPACE + "+|" + JS_SPACE + "+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(s) -> Column:
    return F.regexp_replace(_c(s), JS_TRIM_RE, "")


def blank_to_null(s) -> Column:
    """``nullif(x, '')``."""
    s = _c(s)
    return F.when(s != "", s)


def is_blank(s) -> Column:
    """JavaScript ``!x || !String(x).trim()``."""
    s = _c(s)
    return s.isNull() | (js_trim(s) == "")


def label(s) -> Column:
    """Display label: underscores to spaces (``in_progress`` -> ``in progress``)."""
    return F.replace(_c(s), F.lit("_"), F.lit(" "))


def name_with_subteam(name, subteam) -> Column:
    """``name (subteam)``, or the bare name when the subteam is empty."""
    name, subteam = _c(name), _c(subteam)
    return F.when(F.coalesce(subteam, F.lit("")) == "", name).otherwise(
        F.concat(name, F.lit(" ("), subteam, F.lit(")")))


def task_label(subteam, title, status) -> Column:
    """``[subteam] title (status label)``."""
    return F.concat(F.lit("["), _c(subteam), F.lit("] "), _c(title),
                    F.lit(" ("), label(status), F.lit(")"))
