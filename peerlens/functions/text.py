"""String, URL and hash functions as Column expressions.

Patterns use Unicode classes (`(?U)`), as Java's plain `\\w` and `\\s` are ASCII; `strip` removes all white space, not only
spaces as `trim` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corporate suffixes in the order in which they are tried; the first that matches is stripped, once.
SUFFIXES = (
    ", inc.", ", inc", " inc.", " inc",
    ", llc.", ", llc", " llc.", " llc",
    ", ltd.", ", ltd", " ltd.", " ltd",
    " co.", " co", " corp.", " corp", " corporation",
    " s.p.a.", " spa", " s.r.l.", " srl",
    " gmbh", " ag", " ab", " bv", " sa", " sas",
    " pte. ltd.", " pte ltd",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean(c: Column | str) -> Column:
    """Stripped text; null for blank text and the literal text "nan"."""
    s = strip(c)
    return F.when(~F.lower(s).isin("", "nan"), s)


def missing_if_empty(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def normalize_name(c: Column | str) -> Column:
    """Lower-cased name without its corporate suffix and punctuation; "" for a missing one."""
    # a lambda names the cleaned text, so that the suffix tests don't each carry the expression that makes it
    return F.get(F.transform(F.array(F.lower(clean(c))), _bare_name), F.lit(0))


def _bare_name(s: Column) -> Column:
    cut = F.lit(0)
    for suffix in reversed(SUFFIXES):
        cut = F.when(F.endswith(s, F.lit(suffix)), len(suffix)).otherwise(cut)
    bare = strip(F.substring(s, F.lit(1), F.length(s) - cut))
    bare = F.regexp_replace(bare, r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.coalesce(strip(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit(""))


def extract_domain(c: Column | str) -> Column:
    """Host of a URL (port and user kept), or a bare host with its path; null if it looks like neither."""
    s = clean(c)
    host = F.regexp_extract(s, r"(?i)https?://(?:www\.)?([^/?#]+)", 1)
    bare = F.regexp_replace(F.btrim(F.lower(s), F.lit("/")), r"^www\.", "")
    return F.when(host != "", strip(F.lower(host))).when(F.contains(s, F.lit(".")) & ~F.contains(s, F.lit(" ")), bare)


def strict_domain(c: Column | str) -> Column:
    """Host of a lower-case-scheme URL up to the first slash; null without a scheme (the candidate analysis's variant)."""
    return missing_if_empty(F.lower(F.regexp_extract(col(c), r"https?://(?:www\.)?([^/]+)", 1)))


def enrichment_domain(c: Column | str) -> Column:
    """Lower-cased host for enrichment keys: one leading `www.` and trailing slashes go."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"^www\.", ""), r"/+$", "")


def domain_root(c: Column | str) -> Column:
    """The label before the last dot's suffix."""
    parts = F.split(col(c), r"\.")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(col(c))


def split_list(c: Column | str) -> Column:
    """Comma-separated values, stripped, without empty ones; [] for null."""
    parts = F.filter(F.transform(F.split(col(c), ","), strip), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def as_list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def slugify(c: Column | str) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(missing_if_empty(s), F.lit("seed"))


def file_slug(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^a-zA-Z0-9_.-]+", "_")


def cache_key(record_id: Column | str, query: Column | str) -> Column:
    """File-safe record id and the first 8 hex digits of the query's sha256."""
    safe = F.translate(col(record_id), ":/", "__")
    return F.concat(safe, F.lit("__"), F.substring(F.sha2(F.coalesce(col(query), F.lit("")), 256), 1, 8))


def fingerprint(*parts: Column) -> Column:
    """The first 16 hex digits of the sha256 of the parts joined by line feeds."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def embedding_text(long_description: Column, one_liner: Column, name: Column, industries: Column) -> Column:
    """What a record is embedded by: its descriptions, else its name and first four tags; 6000 characters at most."""
    described = missing_if_empty(F.concat_ws("\n", missing_if_empty(long_description), missing_if_empty(one_liner)))
    fallback = F.concat(F.coalesce(name, F.lit("")), F.lit(" — "), F.array_join(F.slice(as_list(industries), 1, 4), ", "))
    return F.substring(F.coalesce(described, F.btrim(fallback, F.lit(" —"))), 1, 6000)


def short_description(one_liner: Column, long_description: Column, name: Column, most: int = 600) -> Column:
    first = F.coalesce(missing_if_empty(one_liner), missing_if_empty(long_description), name, F.lit(""))
    return F.substring(first, 1, most)


def combined_description(dir_long: Column, dir_one: Column, reg_one: Column) -> Column:
    """Directory texts, then the registry's one-liner unless it repeats one of them."""
    a, b, c = (missing_if_empty(x) for x in (dir_long, dir_one, reg_one))
    fresh = F.when(~F.coalesce(c == a, F.lit(False)) & ~F.coalesce(c == b, F.lit(False)), c)
    return F.concat_ws("\n", a, b, fresh)


def tier(c: Column | str) -> Column:
    """tier_1..tier_4: as given, else by the first digit 1-4, else tier_4."""
    s = F.lower(strip(c))
    digit = missing_if_empty(F.regexp_extract(s, "[1-4]", 0))
    named = F.when(s.isin("tier_1", "tier_2", "tier_3", "tier_4"), s)
    return F.coalesce(named, F.concat(F.lit("tier_"), digit), F.lit("tier_4"))


def truthy(c: Column | str) -> Column:
    """A verdict as boolean: false for null and the texts false, no, 0 and empty."""
    return F.coalesce(~F.lower(strip(col(c).cast("string"))).isin("false", "no", "0", "", "null"), F.lit(False))


def name_from_domain(c: Column | str) -> Column:
    return F.initcap(F.translate(F.split_part(col(c), F.lit("."), F.lit(1)), "-", " "))


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def summary(names: Column, most: int, sep: str = ", ") -> Column:
    """The first `most` items, joined."""
    return F.array_join(F.slice(names, 1, most), sep)


def taxonomy_summary(taxonomy: Column, most: int = 6) -> Column:
    """`key: a, b` of each entry of a map of lists, joined by ` | `."""
    entry = lambda e: F.concat(e["key"], F.lit(": "), summary(e["value"], most))
    return F.array_join(F.transform(F.array_sort(F.map_entries(taxonomy)), entry), " | ")
