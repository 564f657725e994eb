"""English words in the manner of Moses, with escaping, as one chain of replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"\p{L}\p{N}_"
_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
#: Stands for each dot of a run of dots until the end, so that no rule for single dots fits it.
_DOT = "\ue000"
#: A split apostrophe is preceded by a backslash: the results to match hold it.
_APOSTROPHE = r"\\'"

# The rules and their order, which make the result.
_STEPS = [
    (_SPACE, " "), (r"[\x00-\x1f]", ""), (" +", " "), ("^ | $", ""),
    (rf"([^\s.'`,\-{_W}]|[_\p{{No}}])", " $1 "),
    (rf"([{_W}])-(?=[{_W}])", "$1 @-@ "),
    (r"\.(?=\.)|(?<=\.)\.", _DOT), (f"({_DOT}+)", " $1 "),
    (r"(\P{Nd}),", "$1 , "), (r",(\P{Nd})", " , $1"), (r"(\p{Nd}),$", "$1 ,"),
    (r"([^\p{L}\p{Nl}\p{No}_])'([^\p{L}\p{Nl}\p{No}_])", f"$1 {_APOSTROPHE} $2"),
    (rf"([^{_W}])'(.)", f"$1 {_APOSTROPHE} $2"),
    (r"(.)'([^\p{L}\p{Nl}\p{No}_])", f"$1 {_APOSTROPHE} $2"),
    ("(.)'(.)", f"$1 {_APOSTROPHE}$2"),
    (r"([^\p{L}\p{Nl}\p{No}_])'(s)", f"$1 {_APOSTROPHE}$2"),
    (" +", " "), ("^ | $", ""),
    (r"(\S)\.(?= |$)", "$1 ."),
    (r"\.' ?$", f" . {_APOSTROPHE} "),
    (_DOT, "."),
]

# Characters and their escapes, `&` first.
_ESCAPES = [
    ("&", "&amp;"), ("|", "&#124;"), ("<", "&lt;"), (">", "&gt;"),
    ("'", "&apos;"), ('"', "&quot;"), ("[", "&#91;"), ("]", "&#93;"),
]


def tokenise_moses(text: Column) -> Column:
    """Marks apart from words, runs of dots together, commas kept inside numbers, hyphens
    inside words as @-@, contractions split on the right, special characters escaped.
    Null stays null."""
    for pattern, to in _STEPS:
        text = F.regexp_replace(text, pattern, to)
    for mark, to in _ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(to))
    return text
