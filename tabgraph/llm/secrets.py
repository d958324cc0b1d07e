"""Secret scan over a content-addressed blob ledger, in DataFrame functions only.

Every version of a text is a blob named by the SHA-256 of its bytes. A ledger holds, for each
(blob, rule, rule version) pair that was scanned, the findings. A run scans only pairs the
ledger lacks, each blob once however many paths carry it, and joins findings back to all paths.

Rules report the leftmost non-overlapping matches of their pattern; a match that fails the
rule's length test is dropped and not retried. Starts and ends are code points, end exclusive.

Defined cases: null text counts as the empty blob; repeated rows are paths of their own; an
empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import materialize
from tabgraph.functions.numbers import bound


@dataclass(frozen=True)
class Rule:
    """``hint`` is a cheap pattern that every match of ``pattern`` satisfies; ``least`` is the
    smallest length of group ``group``; ``rank`` orders kinds at one start."""

    kind: str
    rank: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The word list and formats of the base kinds are fixed values; the last two kinds are added spans.
RULES = (
    Rule("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"(?i:passw|secret|token|api_?key)", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "AKIA", 0, 20),
    Rule("hex", 2, r"[0-9a-f]{24,}", r"[0-9a-f]{24}", 0, 24),
    Rule("jwt", 3, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    Rule("pem", 4, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
)
BASE = ("assign", "access", "hex")
FINDINGS = "array<struct<start:int,end:int>>"


def running(values: Column, block: int = 64) -> Column:
    """Inclusive running sums of an array, by blocks: appending to an array copies it, so only short ones grow."""
    def grown(part: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(part, empty, lambda acc, x: F.struct(
            (acc["at"] + x).alias("at"), F.array_append(acc["sums"], acc["at"] + x).alias("sums")), lambda acc: acc["sums"])

    def of(v: Column) -> Column:
        begins = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(block))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(begins, lambda at: F.slice(v, at, F.lit(block)))
        return bound(parts, lambda p: F.flatten(F.zip_with(p, F.concat(F.array(F.lit(0)), grown(F.transform(
            p, lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + y)), F.lit(0))), lambda x, start: F.when(
                x.isNotNull(), grown(x, start)).otherwise(F.array().cast("array<int>")))))

    return bound(values, of)


def find(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches that pass its length test.

    The pieces between matches and the matches themselves alternate, so running lengths give
    each match its place.
    """
    matches = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    inner = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1))
    pieces = F.split(text, rule.pattern, -1)
    sizes = F.transform(F.arrays_zip(matches.alias("m"), inner.alias("g"), F.slice(pieces, 1, F.size(matches)).alias("p")), lambda x: F.struct(
        F.length(x["m"]).alias("m"), (F.length(x["g"]) >= rule.least).alias("kept"), (F.length(x["p"]) + F.length(x["m"])).alias("step")))
    placed = bound(sizes, lambda z: F.zip_with(z, running(F.transform(z, lambda x: x["step"])), lambda x, end: F.struct(
        (end - x["m"]).alias("start"), end.alias("end"), x["kept"].alias("kept"))))
    spans = F.transform(F.filter(placed, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast(FINDINGS)
    return F.when(text.rlike(rule.hint), spans).otherwise(none)


def blobs(paths: DataFrame, path: str, text: str, *more: str) -> DataFrame:
    """(path, blob): the content address of every path's text."""
    return paths.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"), *more)


def scan(paths: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None,
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger entries (blob, kind, version, found) for the unseen pairs of blob and rule.

    ``path`` may repeat or be null. Pairs without findings are entries too, with an empty
    ``found``: they need no second scan. One path per blob is picked from the addresses alone,
    so only the texts of unseen blobs meet the patterns.
    """
    addressed = materialize(blobs(paths, path, text))
    known = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    new = addressed.groupBy("blob").agg(F.min("path").alias("_one"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("_seen"))
        new = new.join(seen, "blob", "left").withColumn(
            "_due", F.array_except(known, F.coalesce("_seen", F.array().cast("array<struct<kind:string,version:int>>")))
        ).filter(F.size("_due") > 0)
    else:
        new = new.withColumn("_due", known)
    texts = blobs(paths.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), path, text, "_text")
    due = lambda r: F.array_contains("_due", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
    # The blob says which text is meant where a path repeats; null paths meet too.
    met = texts.alias("t").join(new.alias("n"), (F.col("t.blob") == F.col("n.blob")) & F.col("t.path").eqNullSafe(F.col("n._one")))
    once = met.select("t.blob", "_text", "_due").dropDuplicates(["blob"])
    scanned = once.select(
        "blob", *[F.when(due(r), find(F.col("_text"), r)).alias(r.kind) for r in rules])
    entries = F.array(*[F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("found")) for r in rules])
    return scanned.select("blob", F.explode(entries).alias("_e")).select("blob", "_e.*").filter("found is not null")


def findings_of_paths(paths: DataFrame, entries: DataFrame, path: str = "doc_id", text: str = "text",
                      rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, spans): every path with the findings of its blob under the versions of ``rules``,
    an array of (start, rank, kind, end)."""
    current = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]
    rank = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.rank))])
    valid = entries.filter((F.size("found") > 0) & F.struct("kind", "version").isin(*current))
    spans = valid.select("blob", "kind", F.explode("found").alias("_f")).groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("_f.start").alias("start"), rank[F.col("kind")].alias("rank"), "kind", F.col("_f.end").alias("end")))).alias("spans"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return blobs(paths, path, text).join(spans, "blob", "left").select(
        "path", F.coalesce("spans", none).alias("spans"))


def ledger_after(entries: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """The ledger with a run's entries added, cut from its lineage."""
    return materialize(entries if ledger is None else ledger.unionByName(entries))


def updated(paths: DataFrame, ledger: DataFrame | None, path: str = "doc_id", text: str = "text",
            rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after a run over ``paths``, which scans only what the ledger lacks."""
    return ledger_after(scan(paths, path, text, ledger, rules), ledger)


def digest(found: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """One row per path: counts of the base kinds, their digest, and all spans."""
    joined = lambda spans: F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"), *[count(k) for k in base],
        F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
