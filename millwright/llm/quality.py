"""Quality rules, with DataFrame functions only: counts of a text's words, marks and repetitions, and how far its
character classes and common words stand from those of its language.

A document's two histograms (classes of its characters; its language's common words, and all others) are compared with
those of all documents of its lang by Jensen-Shannon distance (the root of the divergence to base 2, 0 to 1). Short
documents have rough histograms: one of fewer than min_chars characters or min_words words passes that comparison, and
the limits allow for the noise of a sample: limit + noise / sqrt(size). The limit of the common words is besides a share
of the distance that a text without any common word has (none_distance), by the language's own common words; its noise
goes with how many of them such a text should have. Where it should have 12 or more, one without any is beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hidden, stored, table

CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[\\x20\\x09-\\x0D]", r"[.,;:!?]", r"[!-/:-@\\[-`{-~&&[^.,;:!?]]", r"[^\\x00-\\x7F]")
COMMON_WORDS = 24
#: With more languages than these, their references aren't broadcast.
MANY_LANGUAGES = 1000
CHAR_LIMIT, WORD_LIMIT, CHAR_NOISE, WORD_NOISE, MIN_CHARS, MIN_WORDS = 0.25, 0.42, 1.5, 1.0, 200, 50
#: Of none_distance; at sf0.01 19 of 20 documents of their language stay below 0.86 of it (50 words) to 0.32 (1,000).
NONE_SHARE, NONE_NOISE = 0.45, 1.88
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and words (array)."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    out = docs.withColumn("trimmed", trimmed).withColumn("words", F.expr(r"if(trimmed = '', cast(array() as array<string>), split(trimmed, '[\\x20\\x09-\\x0D]+'))")).drop("trimmed")
    out = out.withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
    lines = F.expr(r"filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    out = out.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    hashes = "transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"
    out = out.withColumn("hashes", F.expr(f"if(size(words) >= 3, {hashes}, array())"))
    # equal windows have equal hashes: the windows of a hash that another place has, by 33 bits of it, are compared as text.
    # Hash and place in one number sort as primitives; sorted, equal hashes are neighbours.
    out = out.withColumn("places", F.expr("if(size(array_distinct(hashes)) < size(hashes), sort_array(transform(hashes, (h, i) -> shiftleft(h, 31) | bigint(i))), array())")).withColumn("end", F.size("places") - 1)
    alike = "filter(places, (x, k) -> (k > 0 and shiftright(places[greatest(k - 1, 0)], 31) = shiftright(x, 31)) or (k < end and shiftright(places[least(k + 1, end)], 31) = shiftright(x, 31)))"
    out = out.withColumn("likely", F.expr(f"transform({alike}, x -> int(x & 2147483647L))"))
    out = out.withColumn("windows", F.expr("sort_array(transform(likely, i -> struct(concat(words[i], ' ', words[i + 1], ' ', words[i + 2]) as w, i as i)))"))
    out = out.withColumn("last", F.size("windows") - 1)
    again = "filter(windows, (x, k) -> (k > 0 and windows[greatest(k - 1, 0)].w = x.w) or (k < last and windows[least(k + 1, last)].w = x.w))"
    out = out.withColumn("starts", F.expr(f"sort_array(transform({again}, x -> x.i))")).drop("hashes", "places", "end", "likely", "windows", "last")
    covered = "aggregate(starts, struct(0L as n, 0 as upto), (a, i) -> struct(a.n + i + 3 - greatest(i, a.upto) as n, i + 3 as upto), a -> a.n)"
    return out.withColumn("n_repeat_words", F.expr(covered)).drop("starts")


def _with_classes(docs: DataFrame) -> DataFrame:
    """docs with classes: the number of characters of each class. One class after another is taken out of the text."""
    out, rest = docs, "coalesce(text, '')"
    for k, c in enumerate(CLASSES):
        out = out.withColumn(f"rest_{k}", F.expr(f"regexp_replace({rest}, '{c}+', '')"))
        out = out.withColumn(f"n_{k}", F.expr(f"double(length({rest}) - length(rest_{k}))"))
        rest = f"rest_{k}"
    out = out.withColumn("classes", F.array(*(f"n_{k}" for k in range(len(CLASSES)))))
    return out.drop(*(f"{x}_{k}" for x in ("rest", "n") for k in range(len(CLASSES))))


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two columns of counts; 0 if either has none."""
    zipped = f"zip_with({p}, {q}, (a, b) -> struct(a / aggregate({p}, 0D, (s, x) -> s + x) as a, b / aggregate({q}, 0D, (s, x) -> s + x) as b))"
    term = "if(z.{0} > 0, z.{0} * log2(2 * z.{0} / (z.a + z.b)), 0D)"
    whole = f"aggregate({zipped}, 0D, (s, z) -> s + ({term.format('a')} + {term.format('b')}) / 2)"
    return F.expr(f"if(aggregate({p}, 0D, (s, x) -> s + x) > 0 and aggregate({q}, 0D, (s, x) -> s + x) > 0, sqrt(greatest({whole}, 0D)), 0D)")


def references(docs: DataFrame) -> DataFrame:
    """lang, ref_classes, common (array of the language's most frequent words, lower-cased, ties by word), ref_words
    (their counts, then that of all other words), common_share (of all words), none_distance (of a text without common
    words from ref_words): over all documents."""
    chars = _with_classes(docs.select("lang", "text")).select("lang", F.col("classes").alias("c")).groupBy("lang").agg(F.array(*(F.sum(F.col("c")[i]) for i in range(len(CLASSES)))).alias("ref_classes"))
    words = docs.select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    counts = stored(counts, "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON_WORDS)
    common = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "w", "n"))).alias("t"))
    others = "total - aggregate(t.n, 0L, (s, x) -> s + x)"
    both = common.alias("a").join(totals.alias("b"), F.expr("a.lang <=> b.lang")).select("a.lang", F.col("t.w").alias("common"), F.expr(f"concat(transform(t.n, x -> double(x)), array(double({others})))").alias("ref_words"))
    both = both.withColumn("none", F.expr("transform(ref_words, (x, i) -> if(i = size(ref_words) - 1, 1D, 0D))")).withColumn("none_distance", _distance("none", "ref_words"))
    both = both.withColumn("common_share", F.expr("1 - element_at(ref_words, -1) / aggregate(ref_words, 0D, (s, x) -> s + x)"))
    return chars.alias("c").join(both.alias("d"), F.expr("c.lang <=> d.lang"), "left").select("c.lang", "ref_classes", "common", "ref_words", "common_share", "none_distance")


def assessed(docs: DataFrame) -> DataFrame:
    """docs with the counts of counted(), base_failed, char_distance, word_distance and kept.

    Nulls: a null text has no words and fails the base rules; documents with a null lang are a language of their own.
    Empty tables give empty ones; repeated rows are assessed each. Other columns come back unchanged, but for those that
    have a name given here, which are replaced.
    """
    given, columns = hidden(docs.drop(*RESULTS), "text", "lang")
    out = counted(given)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    ref = stored(references(given), "references").withColumnRenamed("lang", "ref_lang")
    few = len(ref.select("ref_lang").take(MANY_LANGUAGES + 1)) <= MANY_LANGUAGES  # rows of some forty values
    out = out.join(F.broadcast(ref) if few else ref, F.expr("lang <=> ref_lang"), "left")
    out = _with_classes(out)
    out = out.withColumn("spaced", F.expr("concat(' ', lower(array_join(words, '  ')), ' ')"))  # two spaces between words: no match takes another's
    hits = "transform(common, w -> double(octet_length(spaced) - octet_length(replace(spaced, concat(' ', w, ' '), ''))) / (octet_length(w) + 2))"
    out = out.withColumn("hits", F.expr(hits)).withColumn("hits", F.expr("concat(hits, array(size(words) - aggregate(hits, 0D, (s, x) -> s + x)))"))
    out = out.withColumn("char_distance", F.coalesce(_distance("classes", "ref_classes"), F.lit(0.0)))
    out = out.withColumn("word_distance", F.coalesce(_distance("hits", "ref_words"), F.lit(0.0)))
    n_chars = F.expr("aggregate(classes, 0D, (s, x) -> s + x)")
    guarded = (n_chars < MIN_CHARS) | (F.col("n_words") < MIN_WORDS)
    word_limit = F.least(WORD_LIMIT + WORD_NOISE / F.sqrt(F.col("n_words")), F.col("none_distance") * (NONE_SHARE + NONE_NOISE / F.sqrt(F.col("common_share") * F.col("n_words"))))
    far = (F.col("char_distance") > CHAR_LIMIT + CHAR_NOISE / F.sqrt(n_chars)) | (F.col("word_distance") > word_limit)
    out = out.withColumn("kept", ~F.col("base_failed") & (guarded | ~far))
    return out.select(*columns, *RESULTS)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
    return assessed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(*columns)
