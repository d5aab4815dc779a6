"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

1. Sources get targets: shares of the budget by weight, none above ``most`` times the source's own size; what a
   source can't take is shared again by weight. That is water filling: with the sources in order of size per
   weight, the level is the largest that any of them sees when all before it are full.
2. The documents of a source are dealt to shards by a seeded hash. The words of a shard, its documents laid end to
   end in seeded order, are cut into blocks of equal length.
3. Blocks are allocated to sources by the highest quotients wanted / (2 k + 1), then each source's blocks to its
   shards in the same way: integer quotas per shard.
4. A shard whose quota is q of n blocks takes every block q div n times and q mod n more blocks by seeded rank.

A document's share is the words of it that lie in taken blocks, repeats counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import WORD, prefix, whole
from txrisk.operators.scans import HEAVY_ROWS, KeyedRows, Running
from txrisk.session import reliable

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
SEED = "mix-1"


def words(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def seeded(seed: str, *parts) -> Column:
    """A hash of the parts as 32 hex digits; the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(p).cast("string"), F.lit("?")) for p in parts]))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, sid (place by code point, missing last, from 1), source_size, weight, target.

    Weights belong to named sources, so a mix has as many rows here as somebody has weighed; they are put in order
    in one task.
    """
    listed = F.array(*[F.lit(w) for w in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(listed, ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(
        Window.unboundedPreceding, -1)
    room = (F.lit(share) * F.sum("source_size").over(everything)
            - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", F.max(room / left).over(everything))
    return per.withColumn("target", F.least(F.col("level") * F.col("weight"),
                                            (most * F.col("source_size")).cast("double"))).drop("level")


def sainte_lague(parties: DataFrame, group: list[str], order: str, wanted: str, most: str, seats: str,
                 heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Adds the integer column ``seats``: the sum of ``wanted`` over the group, rounded, dealt out by the highest
    quotients wanted / (2 k + 1), none above the column ``most``; ties go to the smaller ``order``, which is unique in a group.

    Only quotients near the end are compared. With n parties the seats at the divisor one and the final seats differ
    by at most 1.5 n times the party's share of the votes, plus one; quotients before that all win, those after it
    all lose. So about 8 n rows are ranked, however many seats there are. Groups with more than ``heavy_rows`` of them are
    ranked in chunks, each by a task of its own.
    """
    by = group or ["_all"]
    known = parties if group else parties.withColumn("_all", F.lit(0))
    sums = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(wanted).alias("_votes"))
    near = F.ceil(1.5 * F.col("_n") * F.when(F.col("_votes") > 0, F.col(wanted) / F.col("_votes")).otherwise(0.0)) + 2
    rows = (known.join(sums, by).withColumn("_near", near.cast("long"))
            .withColumn("_sure", F.greatest(F.lit(0), F.least(F.col(most), F.round(wanted).cast("long")) - F.col("_near"))))
    rows = reliable(rows)  # a row per party; what is sure must be the same wherever it is read
    left = rows.groupBy(*by).agg((F.round(F.first("_votes")).cast("long") - F.sum("_sure")).alias("_open"))
    last = F.least(F.col(most) - 1, F.col("_sure") + 2 * F.col("_near"))
    steps = F.when(last >= F.col("_sure"), F.sequence("_sure", last)).otherwise(F.array().cast("array<bigint>"))
    tried = rows.select(*by, *[c for c in (order, wanted) if c not in by], F.explode(steps).alias("_k"))
    tried = tried.withColumn("_behind", -F.col(wanted) / (2 * F.col("_k") + 1))
    ranked = KeyedRows.of(tried, by, ["_behind", order, "_k"], heavy_rows).running(Running("_place", "count")).rows()
    won = ranked.join(left, by).filter("_place <= _open").groupBy(*by, order).agg(F.count(F.lit(1)).alias("_won"))
    return rows.join(won, [*by, order], "left").select(
        *parties.columns, (F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).alias(seats))


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
           share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
           seed: str = SEED) -> DataFrame:
    """What the mix takes of every document.

    One row per row of ``docs``: key, text_hash, source, size, source_size, target, taken and ``runs``, the taken
    word ranges as an array of (first, end, times). Missing texts have size 0 and take nothing; a missing source is
    a source of its own, the last; rows that repeat each other are documents of their own. No rows give no rows.
    Other columns of ``docs`` may have any name.
    """
    sized = reliable(docs.select(F.col(key).alias("key"), F.xxhash64(whole(text)).alias("text_hash"),
                                 F.col(source).alias("source"), words(text).alias("size")))
    plan = targets(sized, weights, share, most).withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    plan = reliable(plan)  # a row per source
    near = plan.withColumnRenamed("source", "_source")
    order = seeded(seed, "key")
    dealt = (sized.join(near, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
             .withColumn("order", order)
             .withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("shards")))
    lots = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("lot"), F.first("target").alias("target"),
                                              F.first("source_size").alias("source_size"))
    lots = lots.withColumn("blocks", F.when(F.col("lot") > 0, F.greatest(
        F.lit(1), F.round(F.col("lot") / block_words).cast("long"))).otherwise(0))
    lots = reliable(lots)  # a row per shard
    per = (lots.groupBy("sid").agg(F.sum("blocks").alias("n"), F.first("target").alias("target"),
                                   F.first("source_size").alias("source_size"))
           .withColumn("wanted", F.when(F.col("source_size") > 0, F.col("target") * F.col("n") / F.col("source_size")).otherwise(0.0))
           .withColumn("top", most * F.col("n")))
    per = sainte_lague(per, [], "sid", "wanted", "top", "quota").select("sid", "n", "quota")
    lots = (lots.join(per, "sid").withColumn("wanted", F.when(F.col("n") > 0, F.col("quota") * F.col("blocks") / F.col("n")).otherwise(0.0))
            .withColumn("top", most * F.col("blocks")).select("sid", "shard", "lot", "blocks", "wanted", "top"))
    lots = reliable(sainte_lague(lots, ["sid"], "shard", "wanted", "top", "quota"))  # a row per shard
    laid = Window.partitionBy("sid", "shard").orderBy("order", "key", "text_hash", "size")
    rows = (dealt.join(lots.select("sid", "shard", "lot", "blocks", "quota"), ["sid", "shard"])
            .withColumn("rn", F.row_number().over(laid))
            .withColumn("end", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("begin", F.col("end") - F.col("size")))
    first = F.expr("begin * blocks div lot")
    last = F.expr("(end - 1) * blocks div lot")
    touched = F.when(F.col("size") > 0, F.sequence(first, last))
    cut = rows.select("*", F.explode_outer(touched).alias("block"))
    begins = F.expr("(block * lot + blocks - 1) div blocks")
    ends = F.expr("((block + 1) * lot + blocks - 1) div blocks")
    ranked = F.dense_rank().over(Window.partitionBy("sid", "shard").orderBy(
        F.col("block").isNull(), seeded(seed, "sid", "shard", "block"), "block"))
    cut = (cut.withColumn("times", F.expr("quota div blocks") + (ranked <= F.expr("quota % blocks")).cast("long"))
           .withColumn("from", F.greatest("begin", begins) - F.col("begin"))
           .withColumn("to", F.least("end", ends) - F.col("begin")))
    took = F.coalesce(F.col("times"), F.lit(0)) > 0
    runs = F.array_sort(F.collect_list(F.when(took, F.struct(
        F.col("from").alias("first"), F.col("to").alias("end"), F.col("times")))))
    return cut.groupBy("sid", "shard", "rn").agg(
        *[F.first(c).alias(c) for c in ("key", "text_hash", "source", "size", "source_size", "target")],
        F.coalesce(F.sum(F.when(took, (F.col("to") - F.col("from")) * F.col("times"))), F.lit(0)).alias("taken"),
        runs.alias("runs"),
    ).drop("sid", "shard", "rn").withColumnRenamed("key", key)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for every time that a document is taken, holding the
    words taken that time (white space between them as it was, ranges that do not touch parted by a line break);
    n_chars, where there is one, is the new length. A document taken whole keeps its text untouched. Rows equal in id and
    text share their ranges in any order. No rows give no rows.
    """
    p = prefix(docs)
    c = {n: f"{p}{n}" for n in ("id", "hash", "size", "runs", "turn", "copies", "own", "time", "now", "tokens", "new")}
    alike = Window.partitionBy("doc_id", "text_hash")
    took = reliable(
        shares(docs.select("doc_id", "text", "source"), **settings)
        .withColumn("turn", F.row_number().over(alike.orderBy(F.desc("taken"), "runs")))
        .withColumn("copies", F.count(F.lit(1)).over(alike)).filter("taken > 0")
        .select(F.col("doc_id").alias(c["id"]), F.col("text_hash").alias(c["hash"]), F.col("size").alias(c["size"]),
                F.col("turn").alias(c["turn"]), F.col("copies").alias(c["copies"]), F.col("runs").alias(c["runs"])))
    same = F.col("doc_id").eqNullSafe(F.col(c["id"])) & (F.col(c["own"]) == F.col(c["hash"]))
    first = docs.withColumn(c["own"], F.xxhash64(whole("text"))).join(took.filter(F.col(c["turn"]) == 1), same)
    # Rows that repeat each other are numbered on both sides, so that each meets one set of ranges and not all.
    number = F.row_number().over(Window.partitionBy("doc_id", c["own"]).orderBy(c["own"]))
    repeated = (first.filter(F.col(c["copies"]) > 1).select(*docs.columns, c["own"]).withColumn(f"{p}number", number)
                .join(took.filter(F.col(c["copies"]) > 1), same & (F.col(f"{p}number") == F.col(c["turn"]))).drop(f"{p}number"))
    rows = first.filter(F.col(c["copies"]) == 1).unionByName(repeated)
    top = F.array_max(F.transform(c["runs"], lambda r: r["times"]))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), top)).alias(c["time"]))
    rows = rows.withColumn(c["now"], F.filter(c["runs"], lambda r: r["times"] >= F.col(c["time"])))
    all_words = F.aggregate(c["now"], F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["first"]) == F.col(c["size"])
    tokens = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))

    def part(r: Column, i: Column) -> Column:
        """Touching ranges stay together; a gap becomes a line break."""
        said = F.array_join(F.slice(c["tokens"], (r["first"] + 1).cast("int"), (r["end"] - r["first"]).cast("int")), "")
        opens = (i == 0) | (F.get(c["now"], i - 1)["end"] != r["first"])
        return F.when(opens, F.concat(F.when(i > 0, F.lit("\n")).otherwise(F.lit("")), F.ltrim(said, F.lit(" \t\n\x0b\x0c\r")))).otherwise(said)

    joined = F.array_join(F.transform(c["now"], part), "")
    rows = rows.withColumn(c["tokens"], F.when(~all_words, tokens))
    rows = rows.withColumn(c["new"], F.when(F.col(c["tokens"]).isNull(), F.col("text")).otherwise(joined))
    fresh = {"text": F.col(c["new"]), "n_chars": F.length(c["new"]).cast("long")}
    return rows.select(*[fresh[n].alias(n) if n in fresh else F.col(n) for n in docs.columns])
