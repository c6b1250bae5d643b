r"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans stand on their own: `assign` (a keyword, a separator and a value of 6 characters or more), `access`
(`AKIA...`, 20 characters or more) and `hex` (24 or more of `[0-9a-f]`).  Weak candidates mean little alone: a mixed token
(`token`: 20 characters or more with a digit, an upper- and a lower-case letter, outside every base span), an account
name (`account`) and an address (`endpoint`).  Each span is a part of a credential: identifiers (access, account), secrets
(assign, hex, token) and endpoints.  An interval join over (document, stretch of text) finds for each weak candidate the
parts within `SCOPE` code points of it; it is reported only if a complementary part is there:

* a token needs an identifier or an endpoint,
* an account needs a secret,
* an endpoint needs a secret or an access identifier.

Positions are code points, end exclusive.  They come from splitting the text by the pattern: pieces and matches alternate,
so running lengths give every start.  Matches of one kind are leftmost and don't overlap; matches that fail a length rule
still use up their text.  Running lengths are kept over chunks of `CHUNK` matches and within each chunk, so a text with very
many matches costs no square of their number.  Tokens are tested for overlap by chunks too, against the base spans near a chunk.

Null and empty texts have no spans.  Rows that agree on id and text are judged alike and each keeps its row; a null id is
a document like any other.  An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCOPE = 200
#: Fixed patterns of the base spans.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ACCOUNT = r"""(client_?id|account_?id|user_?name|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
ENDPOINT = r"""(https?|ftp|s3|postgres|postgresql|mysql|redis|mongodb|amqp)://([^\x20\x09-\x0D"'<>]+)"""

KINDS = ("assign", "access", "hex", "token", "account", "endpoint")
SPAN = "struct<start:int,kind:int,end:int>"
CHUNK = 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _over_chunks(items: Column, measure: Callable, combine: Callable, inner: Callable[[Column, Column, Column], Column]) -> Column:
    """The arrays inner(chunk, value before, value after) of the chunks of a non-empty array, joined; the value is 0, combined
    with the measure of one item after the other."""

    def over(parts: Column) -> Column:
        steps = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: combine(acc, measure(x))))
        edges = F.aggregate(steps, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(combine(F.element_at(acc, -1), t))))
        return _let(edges, lambda e: F.flatten(F.transform(parts, lambda p, i: inner(p, F.get(e, i), F.get(e, i + 1)))))

    return _let(items, lambda z: _let(_cut(z), over))


def _cut(items: Column) -> Column:
    """A non-empty array in chunks of CHUNK items."""
    last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))


def _apart(weak: Column, base: Column) -> Column:
    """The weak candidates but for tokens that overlap a base span.

    A chunk of candidates is compared with the base spans that reach into its part of the text only."""

    def within(chunk: Column) -> Column:
        first, end = F.array_min(F.transform(chunk, lambda w: w["start"])), F.array_max(F.transform(chunk, lambda w: w["end"]))
        near = _let(F.struct(first.alias("a"), end.alias("b")), lambda r: F.filter(base, lambda b: (b["start"] < r["b"]) & (b["end"] > r["a"])))
        meets = lambda n, w: F.exists(n, lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"]))
        return _let(near, lambda n: F.filter(chunk, lambda w: (w["kind"] != 3) | ~meets(n, w)))

    parts = _let(weak, lambda z: F.flatten(F.transform(_cut(z), within)))
    return F.when((F.size(weak) > 0) & (F.size(base) > 0), parts).otherwise(weak)


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, maybe: Column | None = None, also=None) -> Column:
    """array<SPAN> of the matches of `pattern` whose `group` has `least` characters or more and meets `also`."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = _let(found, lambda m: F.arrays_zip(F.slice(pieces, F.lit(1), F.size(m)).alias("p"), m.alias("m"), (m if group == 0 else inner).alias("g")))
    empty = F.array().cast(f"array<{SPAN}>")

    def spans(chunk: Column, begin: Column, _end: Column) -> Column:
        def step(acc, x):
            start = acc["at"] + F.length(x["p"])
            end = start + F.length(x["m"])
            ok = F.length(x["g"]) >= least
            ok = ok & also(x["g"]) if also is not None else ok
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    made = _over_chunks(zipped, lambda x: F.length(x["p"]) + F.length(x["m"]), lambda a, b: a + b, spans)
    test = text.rlike(pattern) if maybe is None else maybe & text.rlike(pattern)
    return F.when(test, made).otherwise(empty)


def scan(df: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """`keep`, `base` and `weak`: the base spans, and the weak candidates outside of them, of each whole text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digit = t.rlike("[0-9]")
    mixed = lambda g: g.rlike("[0-9]") & g.rlike("[A-Z]") & g.rlike("[a-z]")
    found = df.select(
        *[c.alias(k) for k, c in keep.items()],
        F.concat(
            _matches(t, ASSIGN, 0, group=2, least=6, maybe=t.rlike("[:=]")),
            _matches(t, ACCESS, 1, maybe=F.contains(t, F.lit("AKIA"))),
            _matches(t, HEX, 2, maybe=digit | t.rlike("[a-f]{24}")),
        ).alias("base"),
        F.concat(
            _matches(t, TOKEN, 3, maybe=digit, also=mixed),
            _matches(t, ACCOUNT, 4, maybe=t.rlike("[:=]")),
            _matches(t, ENDPOINT, 5, maybe=F.contains(t, F.lit("://"))),
        ).alias("weak"),
    )
    return found.withColumn("weak", _apart(F.col("weak"), F.col("base")))


def _kind_in(kind: Column, *names: str) -> Column:
    return kind.isin(*[KINDS.index(n) for n in names])


def link(scanned: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """For each key with reported weak candidates, `linked`: these candidates.  The join's keys are (key, stretch), so a
    group holds the spans of one stretch of one text, however many texts or spans there are."""
    rows = scanned.where(F.size("weak") > 0)
    stretch = lambda at: F.floor(at / F.lit(2 * scope)).cast("int")
    weak = rows.select(*key, F.explode("weak").alias("w")).distinct()
    weak = weak.withColumn("at", F.explode(F.sequence(stretch(F.greatest(F.col("w.start") - scope, F.lit(0))), stretch(F.col("w.end") + scope))))
    reach = F.sequence(stretch(F.col("p.start")), stretch(F.col("p.end")))
    parts = rows.select(*[F.col(k).alias(f"_{k}") for k in key], F.explode(F.concat("base", "weak")).alias("p")).distinct()
    parts = parts.withColumn("_at", F.explode(reach))
    w, p = F.col("w.kind"), F.col("p.kind")
    complement = (
        (_kind_in(w, "token") & _kind_in(p, "access", "account", "endpoint"))
        | (_kind_in(w, "account") & _kind_in(p, "assign", "hex", "token"))
        | (_kind_in(w, "endpoint") & _kind_in(p, "assign", "hex", "token", "access"))
    )
    near = (F.col("p.start") < F.col("w.end") + scope) & (F.col("p.end") > F.col("w.start") - scope)
    same = F.col("at") == F.col("_at")
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    reported = weak.join(parts, same & complement & near, "left_semi")
    return reported.groupBy(*key).agg(F.collect_set("w").alias("linked"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _keyed(documents: DataFrame, text: str = "text") -> dict[str, Column]:
    return {"_id": common.long_id("doc_id"), "_hash": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))}


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and all spans of every document."""
    key = _keyed(documents)
    scanned = common.materialize(scan(documents, {"doc_id": F.col("doc_id"), **key}), "secrets")
    linked = link(scanned, list(key))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    made = scanned.join(linked, list(key), "left").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(_every()).alias("spans"),
    )
    return common.finish(made, "spans", scanned)


def _every() -> Column:
    return F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", "linked"))


def redact(documents: DataFrame, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """`documents` with every span of its texts replaced; texts without spans, and all other columns, stay as they are.

    The texts are scanned once; the spans, of the texts that have any, meet them again by a sort-merge join."""
    cols = documents.columns
    key = _keyed(documents, text)
    scanned = common.materialize(scan(documents, key, text).where((F.size("base") > 0) | (F.size("weak") > 0)).dropDuplicates(list(key)), "secrets")
    found = scanned.join(link(scanned, list(key)), list(key), "left")
    found = common.finish(found.select(*key, F.array_sort(_every()).alias("_spans")).where(F.size("_spans") > 0), "found", scanned)
    rows = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], *[c.alias(k) for k, c in key.items()])
    rows = rows.join(found.hint("merge"), list(key), "left")
    t = F.col(f"c{cols.index(text)}")

    def pieces(chunk: Column, begin: Column, end: Column) -> Column:
        """The kept stretches of the text before each span of the chunk that starts after the earlier ones, and marks."""

        def within(part: Column) -> Column:
            def step(acc, s):
                kept = F.array(F.substring(part, acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit(by))
                out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], kept)).otherwise(acc["out"])
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

            zero = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(chunk, zero, step, lambda acc: acc["out"])

        return _let(F.substring(t, begin + 1, end - begin), within)

    made = F.array_join(_over_chunks(F.col("_spans"), lambda s: s["end"], F.greatest, pieces), "")
    last = F.array_max(F.transform("_spans", lambda s: s["end"]))
    new = F.concat(made, F.substring(t, last + 1, F.length(t)))
    rows = rows.withColumn("_new", F.when(F.col("_spans").isNotNull(), new).otherwise(t))
    return rows.select(*[F.col("_new" if c == text else f"c{i}").alias(c) for i, c in enumerate(cols)])


def _sql_spans(kind: int, pattern: str, where: str, group: int = 0, gate: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, i, g[i] AS g,
    CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
    length(ms[i]) AS n
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS ps
    FROM d WHERE {gate}))
  WHERE {where}"""


SPANS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
every AS ({" UNION ALL ".join([
    _sql_spans(0, ASSIGN, "length(g[i]) >= 6", 2), _sql_spans(1, ACCESS, "true"), _sql_spans(2, HEX, "true"),
    _sql_spans(3, TOKEN, "regexp_matches(g[i], '[0-9]') AND regexp_matches(g[i], '[A-Z]') AND regexp_matches(g[i], '[a-z]')"),
    _sql_spans(4, ACCOUNT, "true"), _sql_spans(5, ENDPOINT, "true")])}),
span AS (SELECT doc_id, kind, s, s + n AS e FROM every),
part AS (
  SELECT * FROM span w WHERE kind <> 3
    OR NOT EXISTS (SELECT 1 FROM span b WHERE b.doc_id = w.doc_id AND b.kind < 3 AND b.s < w.e AND b.e > w.s)
),
chosen AS (
  SELECT * FROM part w WHERE kind < 3 OR EXISTS (
    SELECT 1 FROM part p WHERE p.doc_id = w.doc_id AND p.s < w.e + {SCOPE} AND p.e > w.s - {SCOPE}
      AND ((w.kind = 3 AND p.kind IN (1, 4, 5)) OR (w.kind = 4 AND p.kind IN (0, 2, 3)) OR (w.kind = 5 AND p.kind IN (0, 1, 2, 3))))
),
named AS (SELECT *, (['assign', 'access', 'hex', 'token', 'account', 'endpoint'])[kind + 1] || ':' || s || ':' || e AS label FROM chosen),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS h,
    string_agg(label, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(label, ',' ORDER BY s, kind) AS spans
  FROM named GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access,
  CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""
