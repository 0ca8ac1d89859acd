"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong kinds (assign, access, hex) are found by pattern alone. Weak candidates - account identifiers, random-looking
values and endpoints - mean little by themselves: they are reported only when complementary parts start within
``SCOPE`` code points of them in the same text. An identifier needs a secret, a secret needs an identifier, an endpoint
needs both. The parts are linked by an interval join over (text, stretch of ``SCOPE`` code points).

Defined results: a null text is an empty one and has no spans; an empty table gives an empty result. Rows with equal id and
text get equal results, each row its own; null ids are allowed; other columns of the input don't enter. Positions count code
points, ends are exclusive. A long text is scanned whole; starts are summed run by run and masked texts are put
together from pieces, so the work hardly grows faster than the text and its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, read_table

SCOPE = 400
#: Kinds in the order in which spans with the same start are listed: (kind, role, pattern, group with the value, its least length).
STRONG = [
    ("assign", "secret", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "id", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", r"[0-9a-f]{24,}", 0, 24),
]
WEAK = [
    ("weak_id", "id", r"""\b([cC]lient|[uU]ser|[aA]ccount|[aA]ccess|[tT]enant)[_-]?([iI][dD]|[nN]ame|[kK]ey)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""", 0, 4),
    ("weak_secret", "secret", r"\b[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    ("endpoint", "endpoint", r"https?://[A-Za-z0-9.-]+(:[0-9]+)?", 0, 8),
]
KINDS = [k for k, *_ in STRONG + WEAK]


#: Entries that a running sum or maximum takes at a time.
RUN = 512
#: Characters of a text in each of the pieces that masking cuts it into.
PIECE = 4096


def running(values: Column, combine) -> Column:
    """What ``combine`` (of two numbers, with 0 neutral) makes of all entries of an array up to each of them.

    Runs of ``RUN`` entries are accumulated one by one, then the runs; so n entries cost about n x ``RUN`` / 2 + (n / ``RUN``)**2 / 2 steps.
    """
    none = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("all"))

    def accumulated(entries: Column) -> Column:
        def more(done: Column, x: Column) -> Column:
            return F.struct(combine(done["last"], x).alias("last"), F.concat(done["all"], F.array(combine(done["last"], x))).alias("all"))

        return F.aggregate(entries, none, more, lambda done: done["all"])

    def joined(runs: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), accumulated(F.transform(runs, lambda r: F.element_at(r, -1))))
        moved = F.zip_with(runs, before, lambda r, b: F.transform(r, lambda x: combine(b, x)))
        return F.flatten(F.slice(moved, 1, F.size(runs)))

    def cut(v: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(RUN))
        return F.when(F.size(v) <= RUN, accumulated(v)).otherwise(let(F.transform(firsts, lambda k: accumulated(F.slice(v, k + 1, RUN))), joined))

    return let(values, cut)


def _starts(gaps: Column, found: Column) -> Column:
    """Start of each match, from the lengths of the gaps before them and of the matches."""
    ends = running(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
    return F.zip_with(ends, found, lambda e, m: e - F.length(m))


def find_spans(text: Column, kind: str, role: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of a pattern whose value is long enough, as structs (start, rank, end, kind, role)."""
    rank = KINDS.index(kind)

    def of(found: Column) -> Column:
        values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        rows = F.zip_with(F.arrays_zip(found.alias("m"), values.alias("v")), _starts(F.split(text, pattern), found), lambda x, s: F.struct(s.alias("start"), (s + F.length(x["m"])).alias("end"), F.length(x["v"]).alias("n")))
        return F.transform(F.filter(rows, lambda x: x["n"] >= least), lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], F.lit(kind).alias("kind"), F.lit(role).alias("role")))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,role:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(none)


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Rows of ``left`` with some row of ``right`` in the same text that starts within ``scope`` of theirs: an interval join by stretches."""
    stretch = F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(F.col("start") / scope) + d))
    a = left.withColumn("stretch", stretch).alias("a")
    b = right.select("key", "start", F.floor(F.col("start") / scope).alias("stretch")).alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.stretch") == F.col("b.stretch")) & (F.abs(F.col("a.start") - F.col("b.start")) <= scope)
    return a.join(b, same, "left_semi").drop("stretch").distinct()


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts (key, start, rank, end, kind, role) whose complementary parts co-occur in scope."""
    ids, secrets = parts.where("role = 'id'"), parts.where("role = 'secret'")
    weak = parts.where(F.col("kind").isin([k for k, *_ in WEAK]))
    return (
        _near(weak.where("role = 'id'"), secrets, scope)
        .unionByName(_near(weak.where("role = 'secret'"), ids, scope))
        .unionByName(_near(_near(weak.where("role = 'endpoint'"), ids, scope), secrets, scope))
    )


def text_digest(doc_id: Column, text: Column) -> Column:
    """The key of (id, text) that ``scan_secrets`` returns; a null text counts as an empty one."""
    return F.sha2(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))), 256)


def scan_secrets(docs: DataFrame, scope: int = SCOPE, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document row: doc_id, key of id and text, the strong spans and all spans (strong and linked), sorted."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        "doc_id",
        text_digest(F.col("doc_id"), F.col(text)).alias("key"),
        F.sort_array(F.concat(*[find_spans(body, *k) for k in STRONG])).alias("strong"),
        F.concat(*[find_spans(body, *k) for k in WEAK]).alias("weak"),
    )
    with Scratch(docs.sparkSession, scratch) as own:
        found = own.keep(found, "secret-spans")  # small: no texts, read twice below
    parts = found.where(F.size("weak") > 0).select("key", F.explode(F.concat("strong", "weak")).alias("p")).select("key", "p.*").distinct()
    added = linked_parts(parts, scope).groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end", "kind", "role")).alias("added"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,role:string>>")
    return found.join(added, "key", "left").select("doc_id", "key", "strong", F.sort_array(F.concat("strong", F.coalesce("added", none))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def mask_secrets(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start) replaced by a mask; overlapping spans become one."""
    body = F.coalesce(text, F.lit(""))

    def masked(pieces: Column, reach: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            near = F.array_join(F.slice(pieces, first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
            return F.substring(near, a - first * PIECE + 1, b - a)

        # a span that begins where all before it have ended begins a new mask
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        gaps = F.filter(F.transform(spans, lambda x, i: F.struct(before(i).alias("a"), x["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        kept = F.transform(gaps, lambda g: between(g["a"], g["b"]))
        return F.array_join(F.concat(kept, F.array(between(F.element_at(reach, -1), F.length(body)))), mask)

    cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) == 0, text).otherwise(let(cut, lambda p: let(ends, lambda r: masked(p, r))))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, strong ones as counts and digest and all of them as text."""
    rows = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("strong", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k, *_ in STRONG], F.sha2(_listed(F.col("strong")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql_spans(kind: str, role: str, pattern: str, group: int, least: int) -> str:
    """Matches of one kind: positions from the lengths of the pieces between and of the matches."""
    p, r = pattern.replace("'", "''"), KINDS.index(kind)
    return f"""
      select rid, {r} as rank, '{kind}' as kind, '{role}' as role, v, (sum(length(g)) over w + sum(length(m)) over w - length(m))::int as start, (sum(length(g)) over w + sum(length(m)) over w)::int as "end"
      from (select rid, unnest(ms) as m, unnest(vs) as v, unnest(gs[:len(ms)]) as g, generate_subscripts(ms, 1) as i from (
        select rid, regexp_extract_all(body, '{p}') as ms, regexp_extract_all(body, '{p}', {group}) as vs, string_split_regex(body, '{p}') as gs
        from d where regexp_matches(body, '{p}')))
      window w as (partition by rid order by i)
      qualify length(v) >= {least}"""


SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as body from documents),
parts as ({' union all '.join(_sql_spans(*k) for k in STRONG + WEAK)}),
pairs as (select a.rid, a.rank, a.kind, a.role, a.start, a."end", bool_or(b.role = 'id') as has_id, bool_or(b.role = 'secret') as has_secret
  from parts a join parts b on a.rid = b.rid and abs(a.start - b.start) <= {SCOPE} where a.kind in ('weak_id', 'weak_secret', 'endpoint') group by all),
added as (select * from pairs where (role = 'id' and has_secret) or (role = 'secret' and has_id) or (role = 'endpoint' and has_id and has_secret)),
spans as (select rid, rank, kind, start, "end", true as strong from parts where kind in ('assign', 'access', 'hex')
  union all select rid, rank, kind, start, "end", false from added),
agg as (select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) filter (where strong) as base, string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank, "end") as spans
  from spans group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join agg using (rid)
"""
