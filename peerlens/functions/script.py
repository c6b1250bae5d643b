"""Name keys across scripts: accents, full-width forms, Cyrillic and Greek folded to plain Latin letters.

All in the JVM: one `translate` for letters that become one letter, a few replacements for those that become several.  The
table for Latin letters follows from Unicode's decompositions; Cyrillic and Greek follow common passport spellings.  Letters of
other scripts (Chinese, Japanese, Korean and more) stay as they are, and compare by themselves.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that become several, lower case.
SEVERAL = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya",
    "є": "ye", "ї": "yi", "θ": "th", "χ": "ch", "ψ": "ps", "ё": "yo", "ъ": "", "ь": "",
}
#: Letters that become one, lower case, in pairs of a letter and its reading.
ONE = {
    **dict(zip("абвгдезийклмнопрстуфыэіґў", "abvgdeziiklmnoprstufyeigu")), **dict(zip("αβγδεζηικλμνξοπρσςτυφω", "avgdeziiklmnxoprsstyfo")),
    **dict(zip("øłđðħıŋ", "olddhin")),
}


@functools.lru_cache(maxsize=1)
def _letters() -> tuple[str, str, str]:
    """(letters, their readings, marks that go): Latin and Greek letters with marks, and full-width ASCII."""
    found: dict[str, str] = {**ONE, "\u3000": " "}
    for at in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        c = chr(at)
        plain = unicodedata.normalize("NFKD", c)
        base = "".join(x for x in plain if not unicodedata.combining(x)).lower()
        base = ONE.get(base, base)
        if c not in SEVERAL and len(base) == 1 and base != c and ord(base) < 128:
            found[c] = base
    marks = "".join(chr(x) for x in range(0x300, 0x370) if unicodedata.combining(chr(x)))
    return "".join(found), "".join(found.values()), marks


def folded(name: Column) -> Column:
    """A normalised name (lower case) in plain Latin letters as far as its script has them, words parted by one space."""
    letters, readings, marks = _letters()
    out = F.lower(name)
    # written with marks of their own, these two would lose them
    out = F.replace(F.replace(out, F.lit("й"), F.lit("й")), F.lit("ё"), F.lit("ё"))
    for c, to in SEVERAL.items():
        out = F.replace(out, F.lit(c), F.lit(to))
    # `translate` drops the letters that have no counterpart at the end
    return F.btrim(F.regexp_replace(F.translate(out, letters + marks, readings), r"\s+", " "))


def has_other_script(name: Column) -> Column:
    """Whether a name has letters beyond ASCII, so that its folded form can differ."""
    return F.coalesce(name.rlike(r"[^\x00-\x7F]"), F.lit(False))
