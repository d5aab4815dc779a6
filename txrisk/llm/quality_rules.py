"""Quality rules whose cutoffs come from the data (DataFrame functions only).

Each document is measured; each measure is put in a bucket that keeps three significant digits. The bucket counts of
a language and source are a quantile sketch with a relative error below one percent: counts of parts add up, so
sketches merge in any order, combine before the shuffle, and are the same in every run. A measure is an outlier if it
lies beyond the quartile by more than ``reach`` times the quartile's distance from the median, or ``margin`` where
that is wider. Groups with under ``least`` measured documents use the merged sketch of their language, languages with
under ``least`` that of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import WORD, let, prefix, whole
from txrisk.session import reliable

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
REACH = 8
LEAST = 200
#: Measure -> (smallest width of the fence below, above); None: no fence on that side. Word length in hundredths,
#: the rest in thousandths.
MARGINS = {"word_length": (200, 400), "symbols": (None, 60), "repeated": (None, 200), "repeated_lines": (None, 400),
           "capitals": (None, 300)}
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that occur twice or more.

    Hashes of the windows tell the texts without a repeat, most of them; the others compare the windows themselves.
    """
    size = F.size(words)
    starts = F.sequence(F.lit(0), size - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    sorted_windows = F.array_sort(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i"))))

    def covered(s: Column) -> Column:
        at = F.transform(s, lambda x, j: F.when(
            (x["w"] == F.get(s, j + 1)["w"]) | (x["w"] == F.get(s, j - 1)["w"]), x["i"]))
        return let(F.array_sort(F.filter(at, lambda i: i.isNotNull())), lambda p: F.aggregate(
            F.transform(p, lambda i, j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - i), F.lit(WINDOW))),
            F.lit(0), lambda a, b: a + b))

    exact = F.when(some, let(sorted_windows, covered)).otherwise(0)
    return F.when(size >= WINDOW, exact).otherwise(0)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             source: str = "source") -> DataFrame:
    """key, text_hash, lang, source and the counts of each text; a missing text has none of anything."""
    body = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source), F.lit("")).alias("source"), whole(text).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    counts = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    length = F.length("text")
    plain = F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))
    return body.select(
        "key", F.xxhash64("text").alias("text_hash"), "lang", "source", plain.cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (length - F.length(F.translate("text", CAPITALS, ""))).cast("long").alias("n_capitals"),
        line_counts.alias("_l"), counts.alias("_w"),
    ).select("*", "_l.*", "_w.*").drop("_l", "_w")


def rates() -> dict[str, Column]:
    """The measures of a document with words, as whole numbers."""
    return {
        "word_length": F.expr("100 * word_chars div n_words"),
        "symbols": F.expr("1000 * n_symbols div word_chars"),
        "repeated": F.expr("1000 * n_repeat_words div n_words"),
        "repeated_lines": F.expr("1000 * n_dup_lines div n_lines"),
        "capitals": F.expr("1000 * n_capitals div word_chars"),
    }


def bucket(value: Column) -> Column:
    """The value cut to three significant digits."""
    digits = F.greatest(F.lit(0), F.length(value.cast("string")) - 3)
    unit = F.pow(F.lit(10.0), digits).cast("long")
    return value - value % unit


def sketches(measures: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n): the mergeable sketch of every group, language and of all rows.

    Documents that fail the base rules are not part of it: fences follow what is worth keeping.
    """
    named = F.array(*[F.struct(F.lit(name).alias("measure"), bucket(value).alias("bucket"))
                      for name, value in rates().items()])
    fine = (measures.filter("NOT base_failed").select("lang", "source", F.explode(named).alias("m"))
            .groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n")))
    levels = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), a.alias("lang"), b.alias("source")) for level, a, b in (
        (0, F.col("lang"), F.col("source")), (1, F.col("lang"), F.lit("")), (2, F.lit(""), F.lit("")))]))
    return (fine.select(levels.alias("g"), "measure", "bucket", "n").groupBy("g.level", "g.lang", "g.source", "measure", "bucket")
            .agg(F.sum("n").alias("n")))


def fences(sketch: DataFrame, reach: int = REACH, margins: dict | None = None) -> DataFrame:
    """(level, lang, source, n, low_<measure>, high_<measure>): one row per group of a sketch."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    seen = F.sum("n").over(group.orderBy("bucket"))
    total = F.sum("n").over(group)
    ranked = sketch.select("*", seen.alias("seen"), total.alias("total"))
    at = {q: F.min(F.when(F.col("seen") * 100 >= F.col("total") * q, F.col("bucket"))) for q in (25, 50, 75)}
    quartiles = ranked.groupBy("level", "lang", "source", "measure").agg(
        F.first("total").alias("n"), *[value.alias(f"q{q}") for q, value in at.items()])
    columns = []
    for name, (below, above) in (margins or MARGINS).items():
        mine = F.col("measure") == name
        if below is not None:
            low = F.col("q25") - F.greatest(F.lit(below), reach * (F.col("q50") - F.col("q25")))
            columns.append(F.max(F.when(mine, low)).alias(f"low_{name}"))
        if above is not None:
            high = F.col("q75") + F.greatest(F.lit(above), reach * (F.col("q75") - F.col("q50")))
            columns.append(F.max(F.when(mine, high)).alias(f"high_{name}"))
    return quartiles.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *columns)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
           least: int = LEAST, reach: int = REACH, margins: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: key, text_hash, the counts, base_failed, kept.

    Missing or empty texts have no words and fail the base rules; a missing language or source counts as ''. Rows
    that repeat each other are judged alike. No rows give no rows. Other columns may have any name.
    """
    margins = margins or MARGINS
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = reliable(measured(docs, key, text, lang, source).withColumn("base_failed", failed))
    limits = reliable(fences(sketches(rows), reach, margins))  # a row per group
    bounds = [c for c in limits.columns if c[:4] in ("low_", "high")]
    packed = limits.select("level", "lang", "source", "n", F.struct(*bounds).alias("fence"))
    out = rows
    for level, on in ((0, ["lang", "source"]), (1, ["lang"]), (2, [])):
        side = packed.filter((F.col("level") == level) & (F.col("n") >= (least if on else 0)))
        side = side.select(*on, F.col("fence").alias(f"fence{level}"))
        # The last side is the one row of the whole table.
        out = out.join(side, on, "left") if on else out.join(F.broadcast(side), F.lit(True), "left")
    out = out.withColumn("fence", F.coalesce("fence0", "fence1", "fence2"))
    good = F.lit(True)
    for name, value in rates().items():
        below, above = margins[name]
        if below is not None:
            good = good & (value >= F.col(f"fence.low_{name}"))
        if above is not None:
            good = good & (value <= F.col(f"fence.high_{name}"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(good, F.lit(True)))
    return out.select(F.col("key").alias(key), "text_hash", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "n_capitals", "n_lines", "base_failed", kept.alias("kept"))


def kept_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that pass, all columns as they were."""
    p = prefix(docs)
    good = (judged(docs, **settings).filter("kept").select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}hash"))
            .distinct())
    on = F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(whole("text")) == F.col(f"{p}hash"))
    return docs.join(good.hint("shuffle_hash"), on, "left_semi")
