"""Secrets by patterns, and credentials of several parts by interval joins, with DataFrame functions only.

Strong findings stand alone: ``assign`` (a named secret with a value), ``access`` (an access key id) and ``hex`` (a long hexadecimal
run). Weak candidates are ``ident`` (a named user or client), ``key`` (a bare 40-character token of mixed case with digits) and
``endpoint`` (a service address). They are reported only next to what completes them: within the same scope, the text between two
blank lines, an ident needs a secret (assign, hex or key), a key needs an identifier (access or ident) or an endpoint, and an
endpoint needs a secret, at any distance. Scopes are the intervals between breaks; which parts a scope holds is one row for each
scope, to which its parts are joined, so no pairs are made.

Offsets are code points, end exclusive. Matches of a kind are leftmost and do not overlap; those that are too short are dropped
after matching. Kinds may overlap each other.

Null and empty texts have no findings. Repeated texts have the same. Input columns with the names of results are replaced;
one named _key is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.llm.batches import without
from duelbook.session import cut

VALUE = "[A-Za-z0-9+/_.=-]+"
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
STRONG = KINDS[:3]
BREAK = "break"
#: A kind's pattern and the group whose length counts. A run that is too short holds no longer one, so its length can be in the pattern.
PATTERNS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?(" + VALUE + ")", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "ident": (r"(?<![A-Za-z0-9])((?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.+-]+)", 2, 3),
    "key": (r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "endpoint": (r"(?<![A-Za-z0-9])(?:https?|wss?|s?ftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>]+", 0, 8),
    BREAK: (r"\n[\x20\t\r]*\n\s*", 0, 1),
}
ANY = "|".join(f"(?:{PATTERNS[k][0]})" for k in KINDS)


def _matches(text: Column, kind: str) -> Column:
    """For each match: the code points between the match before and it, its own, and whether it is long enough."""
    pattern, group, least = PATTERNS[kind]
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), counted.alias("counted")), lambda m: F.struct(
        F.length(m["gap"]).cast("long").alias("gap"), F.length(m["whole"]).cast("long").alias("size"), (F.length(m["counted"]) >= least).alias("fits")))


def parts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(_key, kind, start, end) of all strong and weak parts and scope breaks of the distinct texts with any part."""
    hit = documents.where(F.regexp_like(F.col(text), F.lit(ANY))).select(F.sha2(text, 256).alias("_key"), F.col(text).alias("x"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _matches(F.col("x"), k).alias("found")) for k in PATTERNS])).alias("k")
    rows = hit.select("_key", kinds).select("_key", "k.kind", F.posexplode("k.found").alias("place", "m"))
    once = rows.groupBy("_key", "kind", "place").agg(F.first("m").alias("m"))
    order = Window.partitionBy("_key", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(order)
    return once.withColumn("end", end).where("m.fits").select("_key", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end")


def findings(found: DataFrame) -> DataFrame:
    """(_key, kind, start, end): strong parts, and weak ones with what completes them in their scope."""
    upto = Window.partitionBy("_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scoped = found.withColumn("scope", F.sum(F.when(F.col("kind") == BREAK, 1).otherwise(0)).over(upto)).where(F.col("kind") != BREAK)

    def holds(*kinds):
        return F.max(F.col("kind").isin(*kinds))

    scopes = scoped.groupBy("_key", "scope").agg(holds("assign", "hex", "key").alias("secret"), holds("access", "ident", "endpoint").alias("other"))
    completed = F.col("kind").isin(*STRONG) | (F.col("kind").isin("ident", "endpoint") & F.col("secret")) | ((F.col("kind") == "key") & F.col("other"))
    return scoped.join(scopes, ["_key", "scope"]).where(completed).select("_key", "kind", "start", "end")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


RESULTS = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_spans and spans (``kind:start:end`` by start, then kind, joined by commas)."""
    source = without(documents, [*RESULTS, "_key"])
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    rows = findings(cut(parts(source, text))).withColumn("rank", rank)
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in STRONG]
    each = rows.groupBy("_key").agg(*counts, F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("all"))
    told = each.select("_key", *[f"n_{k}" for k in STRONG], _joined(F.filter("all", lambda s: s["rank"] <= len(STRONG))).alias("base_spans"), _joined(F.col("all")).alias("spans"))
    has = F.coalesce(F.regexp_like(F.col(text), F.lit(ANY)), F.lit(False))
    hit = source.where(has).withColumn("_key", F.sha2(text, 256)).join(told, "_key", "left")
    values = [F.coalesce(F.col(c), F.lit("") if c.endswith("spans") else F.lit(0).cast("long")).alias(c) for c in RESULTS]
    columns = [F.col(f"`{c}`") for c in source.columns]
    none = [(F.lit("") if c.endswith("spans") else F.lit(0).cast("long")).alias(c) for c in RESULTS]
    return source.where(~has).select(*columns, *none).unionByName(hit.select(*columns, *values))
