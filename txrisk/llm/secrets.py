"""Secret scans over an incremental ledger of blobs (DataFrame functions only).

A version of a text is a blob, named by its SHA-256. The ledger says which blobs were scanned with which version of
which rule. A scan names all versions, takes the pairs of blob and rule version that the ledger has not seen, reads
one copy of each such blob, and joins the findings, old and new, back to every path that has the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import let, prefix, whole
from txrisk.session import reliable


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # shorter ones are no finding, but their text is used up
    version: int = 1


#: The base rules, in order of rank; the patterns mean the same to Java and RE2.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Tokens that carry their issuer's mark.
MARKED = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("userinfo", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D:/@]{1,64}:[^\x20\x09-\x0D:/@]{1,64}@"),
]
RULES = BASE + MARKED


def blob_name(text: str | Column) -> Column:
    return F.unhex(F.sha2(whole(text), 256))


def matches(text: Column, rule: Rule) -> Column:
    """Every match of the rule in order: rule, place, the length of the text before it since the last match, its
    own length, and the length that has to reach ``rule.least``."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("own"), counted.alias("value"))
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(rule.kind).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["own"]).alias("own"),
        F.length(x["value"]).alias("value")))
    return F.when(text.rlike(rule.pattern), F.filter(rows, lambda r: r["own"].isNotNull()))


def scan(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, text, todo) -> (blob, kind, begin, end) of the kinds in ``todo``, in code points, end exclusive."""
    lacking = F.col("todo")
    nothing = F.array().cast("array<struct<kind:string,place:int,gap:int,own:int,value:int>>")
    rows = F.concat(*[F.coalesce(F.when(F.array_contains(lacking, rule.kind), matches(F.col("text"), rule)), nothing) for rule in rules])
    found = texts.select("blob", F.explode(rows).alias("m")).select("blob", "m.*").distinct()
    up_to = Window.partitionBy("blob", "kind").orderBy("place")
    least = F.create_map(*[F.lit(v) for rule in rules for v in (rule.kind, rule.least)])
    return (found.withColumn("end", F.sum(F.col("gap") + F.col("own")).over(up_to)).filter(F.col("value") >= least[F.col("kind")])
            .select("blob", "kind", (F.col("end") - F.col("own")).cast("long").alias("begin"), F.col("end").cast("long").alias("end")))


def empty_ledger(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A ledger that has seen nothing: (blob, kind, version) and (blob, kind, version, begin, end)."""
    spark = docs.sparkSession
    return (spark.createDataFrame([], "blob binary, kind string, version int"),
            spark.createDataFrame([], "blob binary, kind string, version int, begin bigint, end bigint"))


def ledger_scan(versions: DataFrame, rules: list[Rule], ledger: tuple[DataFrame, DataFrame] | None = None,
                key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, seen, findings): the blob of every row, and the ledger with this scan added.

    ``versions`` has a row for every historical version of every path. Only blobs that lack a rule at its version are
    read, one copy of each; a blob that lacks one rule only is scanned for that rule only.
    """
    named = versions.select(F.col(key).alias("key"), whole(text).alias("text"))
    paths = reliable(named.select("key", blob_name("text").alias("blob")))
    seen, findings = ledger or empty_ledger(versions)
    kinds = versions.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    done = seen.join(F.broadcast(kinds), ["kind", "version"]).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    blobs = paths.groupBy("blob").agg(F.min("key").alias("path"))
    todo = F.array_sort(F.array_except(F.array(*[F.lit(r.kind) for r in rules]), F.coalesce("done", F.array().cast("array<string>"))))
    todo = reliable(blobs.join(done, "blob", "left").select("blob", "path", todo.alias("todo")).filter(F.size("todo") > 0))
    # Path and blob deal the texts out, so that the copies of one blob don't meet; all but one copy go no further.
    texts = named.withColumn("blob", blob_name("text")).join(
        todo.hint("shuffle_hash").withColumnRenamed("blob", "_blob"),
        (F.col("blob") == F.col("_blob")) & F.col("key").eqNullSafe(F.col("path"))).select("blob", "text", "todo")
    version = F.create_map(*[F.lit(v) for r in rules for v in (r.kind, r.version)])
    wanted = reliable(scan(texts, rules).select("blob", "kind", version[F.col("kind")].alias("version"), "begin", "end"))
    added = todo.select("blob", F.explode("todo").alias("kind")).select("blob", "kind", version[F.col("kind")].alias("version"))
    return paths, seen.unionByName(added), findings.unionByName(wanted)


def per_path(paths: DataFrame, findings: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """key, blob and ``spans``: the findings of every path as an array of (begin, rank, kind, end), in order of start,
    then rank of the rule. Findings of older versions of a rule are left out."""
    rank = findings.sparkSession.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version int, rank int")
    by_blob = findings.join(F.broadcast(rank), ["kind", "version"]).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("begin", "rank", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<begin:bigint,rank:int,kind:string,end:bigint>>")
    return paths.join(by_blob, "blob", "left").select(F.col("key").alias(key), "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame, rules: list[Rule] | None = None, ledger=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, blob, spans.

    Missing texts are empty and hold nothing. Rows that repeat each other are one blob, scanned once, and each gets
    the findings. No rows give no rows. Other columns may have any name.
    """
    rules = rules or RULES
    paths, _, findings = ledger_scan(docs, rules, ledger, key, text)
    return per_path(paths, findings, rules, key)


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_<base kind>, base_sha256, spans: counts and positions in words."""
    base = [r.kind for r in BASE]
    own = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(key, *map(count, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, mark: str = "[secret]", **settings) -> DataFrame:
    """The documents with every finding replaced by ``mark``, overlapping ones by one; clean ones are untouched.
    n_chars, where there is one, is the new length."""
    p = prefix(docs)
    spans, new = F.col(f"{p}spans"), f"{p}new"
    hits = found(docs.select("doc_id", "text"), **settings).filter(F.size("spans") > 0).select(
        F.col("doc_id").alias(f"{p}id"), F.col("blob").alias(f"{p}blob"), F.col("spans").alias(f"{p}spans")).distinct()
    rows = docs.withColumn(f"{p}name", blob_name("text")).join(
        hits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}name") == F.col(f"{p}blob")), "left")
    # Walk the spans by start; a span that begins before the last end prolongs the gap.
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("upto"))
    walked = F.aggregate(spans, state, lambda a, s: F.struct(
        F.when(s["begin"] < a["upto"], a["out"]).otherwise(F.concat(
            a["out"], F.substring(F.col("text"), (a["upto"] + 1).cast("int"), (s["begin"] - a["upto"]).cast("int")), F.lit(mark))).alias("out"),
        F.greatest(a["upto"], s["end"]).alias("upto")))
    tail = let(walked, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["upto"] + 1).cast("int"), F.lit(2147483647))))
    rows = rows.withColumn(new, F.when(spans.isNull(), F.col("text")).otherwise(tail))
    fresh = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(spans.isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long"))
    return rows.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns])
