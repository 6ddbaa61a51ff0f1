r"""Secret scans by multipart credential linking, in DataFrame functions alone.

Base spans are found by pattern: assignments, access identifiers and hex runs. Weak candidates, each harmless alone, are an
account name, a mixed token of 20 characters or more, and an endpoint; a weak one is reported only when its complements
occur within scope (at most 240 code points between the end of the one and the start of the other) in the same text:
    token      with an access identifier or account name
    account    with an assignment, hex run or token
    endpoint   with an identifier of either kind and a secret of any kind
Parts meet in an interval join: a part lies in all buckets of one scope that it covers, its complement also in the two beside
these, and a left semi join on text and bucket with the distance as condition finds co-occurrence without making pairs. Only
parts move in shuffles, never texts; a text of any length gives rows by bucket, in proportion to its length.

Positions come from splitting a text by the pattern: lengths of pieces and matches in turn add up to starts and ends in
code points. These sums are made by doubling, so that a text with n matches costs n log n. Texts without the marks that a
pattern needs (AKIA, ://) skip its search.

Defined cases: a null text is an empty one; rows of one doc_id and text are each returned, with equal spans; a null doc_id
is kept; spans of several kinds may overlap and then are near each other; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a maximal run, so under 18 characters none of its parts can match either
HEX = r"[0-9a-f]{16,}"
ACCOUNT = r"""(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+"""
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "account", "token", "endpoint")
SCOPE = 240
SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, pattern: str, keep=None) -> Column:
    """Starts and ends (code points, end exclusive) of all matches; keep: a condition on the matched string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    kept = (lambda m: F.lit(True)) if keep is None else keep
    steps = F.zip_with(before, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), kept(m).alias("kept")))
    ends = running(F.transform(steps, lambda z: z["gap"] + z["len"]))
    placed = F.zip_with(steps, ends, lambda z, e: F.struct((e - z["len"]).alias("start"), e.alias("end"), z["kept"].alias("kept")))
    made = F.transform(F.filter(placed, lambda z: z["kept"]), lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end")))
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast(SPANS))


def running(xs: Column) -> Column:
    """Running sums of an array of ints that is not empty: each round adds to an entry the one 1, 2, 4, ... places before."""
    n = F.size(xs)
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int"))

    def step(s: Column, k: Column) -> Column:
        back = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(s))
        shifted = F.concat(F.array_repeat(F.lit(0), back), F.slice(s, F.lit(1), F.size(s) - back))
        return F.zip_with(s, shifted, lambda x, y: x + y)

    return F.aggregate(rounds, xs, step)


def _mixed(m: Column) -> Column:
    return F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Z]")) & F.rlike(m, F.lit("[a-z]"))


def _where(has: Column, found: Column) -> Column:
    return F.when(has, found).otherwise(F.array().cast(SPANS))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, two keys of the text, and an array of spans for each kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select("doc_id", text.alias("text"))
    t = F.col("text")
    long_value = lambda m: F.length(F.regexp_extract(m, f"^(?:{ASSIGN})$", 2)) >= 12
    marks = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    return plain.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("key"),
        F.hash("text", "doc_id").alias("key2"),
        _where(marks, spans(t, ASSIGN, long_value)).alias("assign"),
        _where(F.contains(t, F.lit("AKIA")), spans(t, ACCESS)).alias("access"),
        spans(t, HEX).alias("hex"),
        _where(marks, spans(t, ACCOUNT)).alias("account"),
        spans(t, TOKEN, _mixed).alias("token"),
        _where(F.contains(t, F.lit("://")), spans(t, ENDPOINT)).alias("endpoint"),
    )


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left with a row of right of the same text within scope."""
    low, high = F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE)
    rows = left.withColumn("bucket", F.explode(F.sequence(low, high)))
    r = right.select("key", "key2", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(low - 1, high + 1)).alias("bucket"))
    near = (r["s"] - rows["end"] <= SCOPE) & (rows["start"] - r["e"] <= SCOPE)
    met = rows.join(r, (rows["key"] == r["key"]) & (rows["key2"] == r["key2"]) & (rows["bucket"] == r["bucket"]) & near, "left_semi")
    return met.drop("bucket").distinct()


def linked(found: DataFrame) -> DataFrame:
    """key, key2 and spans (start, kind, end) of weak parts with their complements in scope, for parts as found."""
    weak = found.where((F.size("account") + F.size("token") + F.size("endpoint") > 0) & (F.size("account") + F.size("token") + F.size("assign") + F.size("access") + F.size("hex") > 0))
    rows = cut(weak.select("key", "key2", F.explode(F.concat(*map(_with_kind, KINDS))).alias("s")).select("key", "key2", "s.kind", "s.start", "s.end").distinct())
    of = lambda *kinds: rows.where(F.col("kind").isin(*(KINDS.index(k) for k in kinds)))
    token = _near(of("token"), of("access", "account"))
    account = _near(of("account"), of("assign", "hex", "token"))
    endpoint = _near(_near(of("endpoint"), of("access", "account")), of("assign", "hex", "token"))
    all_ = reduce(DataFrame.unionByName, (token, account, endpoint))
    return all_.groupBy("key", "key2").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def _with_kind(name: str) -> Column:
    """The spans of a kind as (start, kind, end), which sort as they are listed."""
    kind = F.lit(KINDS.index(name))
    return F.transform(name, lambda s: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end")))


def _listed(all_: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(all_), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of each row of docs."""
    found = cut(parts(docs))
    out = found.select("doc_id", "key", "key2", "assign", "access", "hex").join(linked(found), ["key", "key2"], "left")
    base = F.concat(*map(_with_kind, KINDS[:3]))
    more = F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.encode(_listed(base), "UTF-8"), 256).alias("base_sha256"),
        _listed(F.concat(base, more)).alias("spans"),
        F.size(more).cast("long").alias("n_linked"),
    )


def _sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = (ASSIGN, ACCESS, HEX, ACCOUNT, TOKEN, ENDPOINT)
    found = " UNION ALL ".join(f"SELECT r, {k} AS kind, string_split_regex(t, {q(p)}) AS gaps, regexp_extract_all(t, {q(p)}) AS hits FROM d" for k, p in enumerate(patterns))
    near = lambda *kinds: f"EXISTS (SELECT 1 FROM f g WHERE g.r = f.r AND g.kind IN ({', '.join(map(str, kinds))}) AND g.s - f.e <= {SCOPE} AND f.s - g.e <= {SCOPE})"
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END || ':' || s || ':' || e"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
    m AS ({found}),
    x AS (SELECT r, kind, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
    y AS (SELECT r, kind, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda v: length(v))) + CASE WHEN i > 1 THEN list_sum(list_transform(hits[1:i - 1], lambda v: length(v))) ELSE 0 END AS BIGINT) AS s FROM x),
    f AS (SELECT r, kind, s, s + length(hit) AS e FROM y WHERE (kind <> 0 OR length(regexp_extract(hit, {q(ASSIGN)}, 2)) >= 12)
          AND (kind <> 4 OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')))),
    k AS (SELECT * FROM f WHERE kind < 3 OR (kind = 4 AND {near(1, 3)}) OR (kind = 3 AND {near(0, 2, 4)}) OR (kind = 5 AND {near(1, 3)} AND {near(0, 2, 4)})),
    g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
            string_agg({name}, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg({name}, ',' ORDER BY s, kind) AS spans FROM k GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON d.r = g.r
    """


SQL = _sql()
