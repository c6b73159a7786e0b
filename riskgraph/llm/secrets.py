"""Operator 3: secret scans over an incremental blob ledger, with DataFrame functions only.

Every historical version of a path is addressed by the SHA-256 of its text. The ledger has a row for each pair of
blob and rule version that was ever scanned, with the spans found. A scan takes the pairs the ledger lacks, reads
each such blob once, appends their rows, and joins the spans of all blobs back to all their paths. A rule that gets
a new version is scanned again everywhere, alone; text seen before is not scanned at all.

Spans are code points, end exclusive. Spark gives the matches of a pattern and the pieces between them; the sum of
the lengths of what lies before a match is its start. A window over the matches of a blob forms those sums, so a
text with very many matches costs n log n.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.io import cut
from .base import table


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and not overlapping; they count when group ``group`` (0: the match) has
    ``least`` characters or more. A change of any field needs a new ``version``."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool = True


RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, base=False),
)
SPANS = "array<struct<start:long,end:long>>"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """Rows (blob, rule, version, spans) of all finished scans; None when there was none. A pair that two scans
    both wrote counts once."""
    try:
        rows = spark.read.schema(f"blob string, rule string, version int, spans {SPANS}").parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.dropDuplicates(["blob", "rule", "version"])


def _hits(text: Column, rule: Rule, wanted: Column) -> Column:
    """Lengths of the candidates of a rule, of the pieces before them, and of the group that counts."""
    p = F.lit(rule.pattern)
    # a cheaper pattern that every counting match of `hex` contains; the others fail at the first character
    first = r"[0-9a-f]{16}" if rule.kind == "hex" else rule.pattern
    found = wanted & text.rlike(first)
    size = lambda a: F.transform(a, lambda x: F.length(x))
    none = F.array().cast("array<int>")
    return F.struct(
        F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"),
        F.when(found, size(F.regexp_extract_all(text, p, F.lit(0)))).otherwise(none).alias("match"),
        F.when(found, size(F.split(text, rule.pattern, -1))).otherwise(none).alias("piece"),
        F.when(found, size(F.regexp_extract_all(text, p, F.lit(rule.group)))).otherwise(none).alias("value"))


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan ``versions`` (blob, text) for the pairs that the ledger at ``ledger`` lacks and append them to it;
    returns the whole ledger. Equal blobs are one: partial aggregates keep one text per blob and task, so a blob
    that a third of the versions share is not gathered in one place. The append is one Parquet commit: a scan that
    is lost midway leaves nothing, and the next one does its work."""
    spark = versions.sparkSession
    done = read_ledger(spark, ledger)
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    key = lambda r: f"{r.kind}@{r.version}"
    if done is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = done.groupBy("blob").agg(F.collect_set(F.concat("rule", F.lit("@"), "version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    blobs = blobs.where(~F.forall(F.array(*[F.lit(key(r)) for r in rules]), lambda k: F.array_contains(F.col("seen"), k)))
    scanned = cut(blobs.select("blob", "seen", F.array(*[
        _hits(F.col("text"), r, ~F.array_contains("seen", key(r))) for r in rules]).alias("hits")), "secret-hits")
    hits = scanned.select("blob", F.explode("hits").alias("h")).where(F.size("h.match") > 0)
    one = hits.select("blob", "h.rule", "h.version", "h.least", F.posexplode(F.arrays_zip("h.piece", "h.match", "h.value")).alias("at", "x"))
    upto = Window.partitionBy("blob", "rule", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # the piece after the last match has no match beside it
    spans = (one.where(F.col("x.match").isNotNull())
             .withColumn("end", F.sum(F.col("x.piece") + F.col("x.match")).over(upto).cast("long"))
             .where(F.col("x.value") >= F.col("least"))
             .groupBy("blob", "rule", "version")
             .agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("x.match")).alias("start"), "end"))).alias("spans")))
    pairs = (scanned.select("blob", "seen", F.explode("hits").alias("h")).select("blob", "seen", "h.rule", "h.version")
             .where(~F.array_contains("seen", F.concat("rule", F.lit("@"), "version"))).drop("seen"))
    (pairs.join(spans, ["blob", "rule", "version"], "left")
     .select("blob", "rule", F.col("version").cast("int").alias("version"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
     .write.mode("append").parquet(ledger))
    return read_ledger(spark, ledger)


def secrets(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with the spans that ``rules`` find in their text: doc_id, blob, findings (array of kind,
    start, end by start, then by the place of the kind in ``rules``).

    Null text counts as empty. Repeated rows are versions of their own with the same blob. Texts are scanned whole.
    An empty table leaves the ledger empty and gives an empty result; other columns are not read."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    versions = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.sha2(body, 256).alias("blob"), body.alias("text"))
    rows = scan(versions.select("blob", "text"), ledger, rules)
    now = [(F.col("rule") == r.kind) & (F.col("version") == r.version) for r in rules]
    place = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(now)])
    found = (rows.withColumn("place", place).where("place is not null and size(spans) > 0")
             .select("blob", "place", F.col("rule").alias("kind"), F.explode("spans").alias("s"))
             .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("s.start", "place", "kind", "s.end"))).alias("f")))
    # written, so that Spark can split a blob of very many paths in the join
    found = cut(found.select("blob", F.transform("f", lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings")), "secret-found")
    return (versions.select("doc_id", "blob").join(found, "blob", "left")
            .withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<kind:string,start:long,end:long>>"))))


def digest(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts, digest and list of the spans of each row of :func:`secrets`."""
    base = [r.kind for r in rules if r.base]
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base],
                        F.sha2(text(F.filter("findings", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
                        text(F.col("findings")).alias("spans"), "blob")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secrets(table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger")))


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"select doc_id, {i} as place, '{r.kind}' as kind, {str(r.base).lower()} as base, {r.least} as least, "
                     f"regexp_extract_all(t, '{p}') as a, regexp_split_to_array(t, '{p}') as p, regexp_extract_all(t, '{p}', {r.group}) as g from d")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({' union all '.join(parts)}),
i as (select doc_id, place, kind, base, least, a, p, g, unnest(range(1, len(a) + 1)) as nth from m where len(a) > 0),
l as (select doc_id, place, kind, base, least, nth, length(p[nth]) as lp, length(a[nth]) as la, length(g[nth]) as lg from i),
e as (select *, sum(lp + la) over (partition by doc_id, place order by nth) as stop from l),
s as (select doc_id, place, kind, base, (stop - la)::bigint as start, stop::bigint as stop from e where lg >= least),
j as (select doc_id,
        count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
        count(*) filter (where kind = 'hex') as n_hex,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) filter (where base), '') as base_spans,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) as spans
      from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans,
  sha256(t) as blob
from d left join j on d.doc_id = j.doc_id
"""


ORACLE_SECRETS = _oracle()
