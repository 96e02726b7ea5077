"""How good retrieval, extraction and the graph are, against gold rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import search


def ranked_files(hits: DataFrame) -> DataFrame:
    """item_id, files: distinct file names of each question's hits (item_id, rank, file_name), in order."""
    return hits.groupBy("item_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_name"))), lambda x: x["file_name"])).alias("files"))


def outcomes(expected: DataFrame, hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """item_id, top1, top3, category of each question of expected (item_id, file_name); corpus: file_name."""
    there = corpus.select("file_name").distinct().withColumn("in_corpus", F.lit(True))
    e = expected.join(there, "file_name", "left").join(ranked_files(hits), "item_id", "left")
    files = F.coalesce("files", F.array().cast("array<string>"))
    e = e.withColumn("at", F.array_position(files, F.col("file_name")))
    category = F.when(F.col("at").between(1, 3), "pass").when(F.col("in_corpus").isNull(), "expected_source_absent_from_corpus").when(F.col("at") > 3, "correct_document_outside_top3").otherwise("correct_document_not_retrieved")
    return e.select("item_id", (F.col("at") == 1).alias("top1"), F.col("at").between(1, 3).alias("top3"), F.coalesce("in_corpus", F.lit(False)).alias("answerable"), category.alias("category"))


def rates(outcomes_: DataFrame) -> DataFrame:
    """questions, top1_rate, top3_rate, and the same of answerable questions."""
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 4)
    of = lambda c: F.when(F.col("answerable"), F.col(c))
    return outcomes_.agg(F.count("*").alias("questions"), share(F.col("top1")).alias("top1_rate"), share(F.col("top3")).alias("top3_rate"), share(of("top1")).alias("answerable_top1"), share(of("top3")).alias("answerable_top3"))


def categories(outcomes_: DataFrame) -> DataFrame:
    return outcomes_.groupBy("category").agg(F.count("*").alias("questions"))


def answer_outcomes(questions: DataFrame, answers: DataFrame, corpus: DataFrame, evidence: DataFrame) -> DataFrame:
    """item_id, expected, place (of the expected file among the cited ones, 0 if it isn't), answerable, has_asset,
    asset_hit, source_hit, cited, confidence, category of each question.

    questions: item_id, file_name (expected), asset; answers: item_id, citations (distinct files, in order), confidence;
    corpus: file_name; evidence: item_id, tags, text of the chunks behind the answers. An asset is hit if one of them is
    tagged with it or names it as a whole word, in any case. A question without an answer counts as one that found
    nothing. A source hit takes file names in any case; a null or blank asset is none.
    """
    there = corpus.select("file_name").distinct().withColumn("answerable", F.lit(True))
    asset = F.nullif(F.upper(F.trim("asset")), F.lit(""))
    q = questions.select("item_id", F.col("file_name"), asset.alias("asset")).join(there, "file_name", "left").join(answers.select("item_id", "citations", "confidence"), "item_id", "left")
    named = search.names(F.coalesce("text", F.lit("")), F.col("asset")) | F.coalesce(F.exists("tags", lambda t: F.upper(F.trim(t)) == F.col("asset")), F.lit(False))
    hit = evidence.join(q.select("item_id", "asset").where("asset is not null"), "item_id").groupBy("item_id").agg(F.max(named).alias("asset_hit"))
    files = F.coalesce("citations", F.array().cast("array<string>"))
    at = F.coalesce(F.array_position(files, F.col("file_name")), F.lit(0)).cast("int")
    source = F.coalesce(F.array_contains(F.transform(files, F.lower), F.lower("file_name")), F.lit(False))
    answerable = F.coalesce("answerable", F.lit(False))
    category = F.when(at.between(1, 3), "pass").when(~answerable, "expected_source_absent_from_corpus").when(at > 3, "correct_document_outside_top3").otherwise("correct_document_not_retrieved")
    return q.join(hit, "item_id", "left").select(
        "item_id", F.col("file_name").alias("expected"), at.alias("place"), answerable.alias("answerable"), F.col("asset").isNotNull().alias("has_asset"), F.coalesce("asset_hit", F.lit(False)).alias("asset_hit"), source.alias("source_hit"),
        (F.size(files) > 0).alias("cited"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), category.alias("category"),
    )


def answer_rates(outcomes_: DataFrame) -> DataFrame:
    """One row: questions, answerable, top1_rate, top3_rate, asset_hit_rate (of questions with an asset), asset_questions,
    answerable_top1, answerable_top3, answerable_asset_hit_rate, answerable_asset_questions, failed, source_hit_rate,
    citation_rate, mean_confidence. Rates of nothing are 0."""
    top1, top3, ok = F.col("place") == 1, F.col("place").between(1, 3), F.col("answerable")
    share = lambda hit, of=F.lit(True): F.round(F.coalesce(F.avg(F.when(of, hit.cast("double"))), F.lit(0.0)), 4)
    asset = F.col("has_asset")
    return outcomes_.agg(
        F.count("*").alias("questions"), F.count_if(ok).alias("answerable"), share(top1).alias("top1_rate"), share(top3).alias("top3_rate"), share(F.col("asset_hit"), asset).alias("asset_hit_rate"), F.count_if(asset).alias("asset_questions"),
        share(top1, ok).alias("answerable_top1"), share(top3, ok).alias("answerable_top3"), share(F.col("asset_hit"), asset & ok).alias("answerable_asset_hit_rate"), F.count_if(asset & ok).alias("answerable_asset_questions"),
        F.count_if(~top3).alias("failed"), share(F.col("source_hit")).alias("source_hit_rate"), share(F.col("cited")).alias("citation_rate"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("mean_confidence"),
    )


#: Ranges that a group's values are counted in, and rows of a range that may be ranked at once.
RANGES, MOST_RANKED = 1024, 10_000


def nearest_rank(rows: DataFrame, by: str, value: str, share: float = 0.95, most_ranked: int = MOST_RANKED) -> DataFrame:
    """by, n, mean, percentile: of each group's values in order that of number share * (n - 1), rounded to even.

    A group's values are counted by range, which each task sums before it sends them; only the range that holds the rank
    is looked into again, until it has few different values or one. So no task gets a whole group. Values are finite
    numbers; null ones don't count. A null group is a group. An empty table gives an empty one.
    """
    given = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    stats = given.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = stats.withColumn("rank", F.bround(share * (F.col("n") - 1), 0).cast("long") + 1).withColumn("held", F.col("n"))
    while (wanted.agg(F.max(F.when(F.col("low") < F.col("high"), F.col("held")))).first()[0] or 0) > most_ranked:
        width = F.when(F.col("low") < F.col("high"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES)).otherwise(0)
        counted = _within(given, wanted).withColumn("at", width).groupBy("g", "at").agg(F.count("*").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy("g").orderBy("at")  # RANGES rows a group
        until = counted.withColumn("until", F.sum("held").over(w)).join(wanted.select(F.col("g").alias("_g"), "n", "mean", "rank"), F.col("g").eqNullSafe(F.col("_g")))
        chosen = until.where("rank <= until and rank > until - held").withColumn("rank", F.col("rank") - F.col("until") + F.col("held"))
        wanted = chosen.select("g", "n", "mean", "low", "high", "rank", "held")
    values = _within(given, wanted).groupBy("g", "v").agg(F.count("*").alias("held"), F.first("rank").alias("rank"), F.first("n").alias("n"), F.first("mean").alias("mean"))
    until = F.sum("held").over(Window.partitionBy("g").orderBy("v"))  # a range of few values
    found = values.withColumn("until", until).where("rank <= until and rank > until - held")
    return found.select(F.col("g").alias(by), "n", F.round("mean", 4).alias("mean"), F.round("v", 4).alias("percentile"))


def _within(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values between low and high of their group, with what is wanted there."""
    w = wanted.select(F.col("g").alias("_g"), "n", "mean", "low", "high", "rank")
    return given.join(w, F.col("g").eqNullSafe(F.col("_g"))).where("v between low and high").drop("_g")


def precision_recall(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over distinct rows."""
    f, g = found.select(*keys).distinct().withColumn("_f", F.lit(1)), gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = f.join(g, keys, "full_outer")
    c = both.agg(F.count_if(F.expr("_f = 1 and _g = 1")).alias("tp"), F.count_if(F.expr("_f = 1 and _g is null")).alias("fp"), F.count_if(F.expr("_f is null and _g = 1")).alias("fn"))
    return scored(c)


def scored(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall, f1; 0 where undefined."""
    p, r = F.expr("coalesce(try_divide(tp, tp + fp), 0D)"), F.expr("coalesce(try_divide(tp, tp + fn), 0D)")
    f1 = F.expr("coalesce(try_divide(2D * tp, 2D * tp + fp + fn), 0D)")
    return counts.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def completeness(edges: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """gold, found, completeness: how much of the distinct gold rows the edges have."""
    g = gold.select(*keys).distinct()
    n, hit = g.agg(F.count("*").alias("gold")), g.join(edges.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("found"))
    return n.join(hit, F.lit(True)).select("gold", "found", F.round(F.expr("coalesce(try_divide(found, gold), 0D)"), 4).alias("completeness"))  # one row each
