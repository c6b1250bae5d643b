r"""Line-first cleaning: every line is judged, failing lines are removed, and a document that loses too much text is rejected.

Rules of a line (its words are the runs of `[^\x20\x09-\x0D]`), as shares that go for any language (`Rules`):

* punctuation: `marks_percent` of its words or more end in two or more of `!?`; or `symbol_percent` of its word characters or
  more, and `symbols` at least, are symbols that prose hardly has (``#$%&*+/<=>@\^_`{|}~»·•``); or it has `long_line` words or
  more and not one of `.!?;:…` (or their full-width forms) anywhere
* navigation: `separator_percent` of its words or more are bare separators (`| > < » · / •`); or it is one of `menu_lines` lines
  or more in a row (blank ones aside) of `menu_words` words at most without such a mark
* repetition: `repeat_percent` of the steps from a word to the next or more repeat the same word (8 words at least)
* boilerplate: a short line with a phrase of licences, cookie notices or site furniture (`_BOILERPLATE`; these are English)

The shares were chosen on half of the labelled documents (by crc32 of the id) and measured on the other half (see the README).

A document is rejected if it fails the base measures (under 50 words, or more than half of its words inside 3-word runs
that it repeats) or if its removed lines hold more than `most_lost` of its word characters.

Null, empty and white-space-only texts have no words and fail the base measures; their cleaned text is empty.  Repeated
rows are judged alike, an empty table gives an empty table, and other columns are not looked at.  Lines are whole, however
long.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rules:
    marks_percent: int = 50
    symbol_percent: int = 8
    symbols: int = 4
    long_line: int = 60
    separator_percent: int = 30
    menu_words: int = 3
    menu_lines: int = 3
    repeat_percent: int = 50
    most_lost: float = 0.3


_ASCII_SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~"
_OTHER_SYMBOLS = ("»".encode(), "·".encode(), "•".encode())
_SEPARATORS = {b"|", b">", b"/", b"<", *_OTHER_SYMBOLS}
_MARKS = re.compile(rb"[!?]{2}[.]?$")
_STOPS = re.compile(r"[.!?;:…。！？]".encode())
_BOILERPLATE = re.compile(
    rb"all rights reserved|released under the|licensed under the|terms of (?:use|service)|privacy policy"
    rb"|cookie policy|uses? cookies|enable javascript|sign up for our|subscribe to our|click here|lorem ipsum"
)
_SHORT_BOILERPLATE = 30

OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_bad_lines long, lost_chars long, cleaned string"
)


def n_symbols_of(line: bytes) -> int:
    return len(line) - len(line.translate(None, _ASCII_SYMBOLS)) + (0 if line.isascii() else sum(map(line.count, _OTHER_SYMBOLS)))


def bad_line(line: bytes, words: list[bytes], chars: int, rules: Rules = Rules()) -> bool:
    """Whether a line of one word at least, of so many code points in words, fails a rule by itself."""
    n = len(words)
    if (b"!" in line or b"?" in line) and 100 * sum(_MARKS.search(w) is not None for w in words) >= rules.marks_percent * n:
        return True
    symbols = n_symbols_of(line)
    if symbols >= rules.symbols and 100 * symbols >= rules.symbol_percent * chars:
        return True
    if symbols and 100 * sum(w in _SEPARATORS for w in words) >= rules.separator_percent * n:
        return True
    if n >= rules.long_line and not _STOPS.search(line):
        return True
    if n >= 8 and 100 * sum(a == b for a, b in zip(words, words[1:])) >= rules.repeat_percent * (n - 1):
        return True
    return n <= _SHORT_BOILERPLATE and _BOILERPLATE.search(line.lower()) is not None


def menus(short: list[bool], rules: Rules = Rules()) -> list[bool]:
    """Which of a text's lines with words lie in a row of `menu_lines` short ones or more."""
    out, begin = [False] * len(short), 0
    for i in range(len(short) + 1):
        if i == len(short) or not short[i]:
            if i - begin >= rules.menu_lines:
                out[begin:i] = [True] * (i - begin)
            begin = i + 1
    return out


def code_points(line: bytes) -> int:
    """Code points of UTF-8 text: bytes that don't continue one."""
    return len(line.decode("utf-8", "replace")) if not line.isascii() else len(line)


def repeated_words(texts: list[bytes | None]) -> np.ndarray:
    """For each text, its words inside 3-word windows that the text has twice or more."""
    words = common.Words(texts)
    out = np.zeros(len(texts), np.int64)
    h, at = words.windows(words.hashes(), 3)
    if not len(h):
        return out
    doc = words.doc[at]
    key = common.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[n[inverse] > 1]
    hit = np.zeros(len(words.start), bool)
    for i in range(3):
        hit[twice + i] = True
    return np.bincount(words.doc[hit], minlength=len(texts)).astype(np.int64)


def judge(texts: list[bytes | None], rules: Rules = Rules()) -> list:
    """The columns of OUT for a slice of texts."""
    cols: list[list] = [[] for _ in range(10)]
    for text, again in zip(texts, repeated_words(texts)):
        lines = (text or b"").split(b"\n")
        seen: set[bytes] = set()
        found: list[tuple[int, int, bool]] = []  # of the lines with words: number, code points, whether it fails by itself
        short: list[bool] = []
        n_words = n_dup = 0
        for i, line in enumerate(lines):
            words = line.split()
            if not words:
                continue
            own = sum(map(len, words)) if line.isascii() else sum(map(code_points, words))
            n_words += len(words)
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
            found.append((i, own, bad_line(line, words, own, rules)))
            short.append(len(words) <= rules.menu_words and not _STOPS.search(line))
        gone = {i: own for (i, own, bad), menu in zip(found, menus(short, rules) if any(short) else short) if bad or menu}
        chars, lost = sum(own for _, own, _ in found), sum(gone.values())
        symbols = sum(text.count(s) for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) if text else 0
        again = int(again)
        failed = n_words < MIN_WORDS or 100 * again > MOST_REPEATED_PERCENT * n_words
        kept = not failed and lost <= rules.most_lost * chars
        cleaned = b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else (text or b"")
        for c, v in zip(cols, (n_words, chars, symbols, n_dup, again, failed, kept, len(gone), lost, cleaned.decode("utf-8", "replace"))):
            c.append(v)
    return cols


def clean(df: DataFrame, keep: dict[str, Column], text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """`keep` and the columns of OUT; `cleaned` is the text without its failing lines, whether or not it is kept."""
    return common.map_texts(df, keep, text, lambda column: judge(common.to_bytes(column), rules), OUT)


def verdicts(documents: DataFrame) -> DataFrame:
    return clean(documents, {"doc_id": F.col("doc_id")}).drop("cleaned", "n_bad_lines", "lost_chars")


#: The base measures and the line rules as DuckDB SQL over `documents`.
VERDICTS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))
),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM win WHERE n > 1) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY doc_id, l ORDER BY j) AS nth, l, lw, len(lw) AS n, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    length(regexp_replace(l, '[^#$%&*+/<=>@\\^_`{|}~»·•]', '', 'g')) AS symbols, len(lw) <= 3 AND NOT regexp_matches(l, '[.!?;:…。！？]') AS short
  FROM (SELECT doc_id, j, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw
        FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS j, unnest(ls) AS l
              FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d)))
  WHERE len(lw) > 0
),
rows_of AS (SELECT *, count(*) FILTER (WHERE NOT short) OVER (PARTITION BY doc_id ORDER BY j) AS r FROM lines),
judged AS (
  SELECT doc_id, nth, chars,
    100 * len(list_filter(lw, lambda x: regexp_matches(x, '[!?]{2}[.]?$'))) >= 50 * n
      OR (symbols >= 4 AND 100 * symbols >= 8 * chars)
      OR 100 * len(list_filter(lw, lambda x: x IN ('|', '>', '<', '/', '»', '·', '•'))) >= 30 * n
      OR (n >= 60 AND NOT regexp_matches(l, '[.!?;:…。！？]'))
      OR (short AND count(*) FILTER (WHERE short) OVER (PARTITION BY doc_id, r) >= 3)
      OR (n >= 8 AND 100 * len(list_filter(range(1, n), lambda i: lw[i] = lw[i + 1])) >= 50 * (n - 1))
      OR (n <= 30 AND regexp_matches(lower(l), 'all rights reserved|released under the|licensed under the|terms of (use|service)|privacy policy|cookie policy|uses? cookies|enable javascript|sign up for our|subscribe to our|click here|lorem ipsum'))
      AS bad
  FROM rows_of
),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE nth > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost
  FROM judged GROUP BY doc_id
),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.3 * word_chars AS kept
FROM base
"""
