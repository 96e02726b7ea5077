"""Language of pages by Bayesian fusion of four kinds of evidence.

    text       naive Bayes over hashed byte triples, fitted on a bounded sample of labelled documents; its logarithms are
               scaled as if a page had 200 triples at most, since triples of one page aren't independent
    declared   P(lang attribute | language)
    suffix     P(last label of the host | language)
    host       prior of the host, smoothed towards its domain's, which is smoothed towards that of all pages

The last three come from grouped sums of the text's posteriors over all pages; a page's own share is taken off first.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

BUCKETS, EVIDENCE = 1 << 15, 200.0
#: Different labelled texts a language that the text model is fitted on, whole.
SAMPLE, MOST_SENT = 1500, 300_000
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
#: A key of more than one in so many rows is common: its row is sent, not shuffled.
COMMON = 256
#: Elements whose text isn't the page's.
HIDDEN = (b"script", b"style", b"noscript", b"nav")
NAME = re.compile(rb"/?([a-z][a-z0-9]*)")
DECLARED = re.compile(rb"\slang\s*=\s*[\"']?([a-z]{2,3})")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
# Second labels below a country's under which names are given out.
SHARED = {"ac", "co", "com", "edu", "gov", "net", "org"}


def visible(page: str) -> tuple[str, str | None]:
    """The text of a page outside tags, comments and hidden elements, and the language that its html tag declares. Each
    kind of end is looked for once when there is none left, so that time goes with the page's length."""
    raw = page.encode("utf-8", "surrogatepass")
    low, pieces, at, declared = raw.lower(), [], 0, None
    none_after: set[bytes] = set()

    def find(what: bytes, start: int) -> int:
        if what in none_after:
            return -1
        found = low.find(what, start)
        if found < 0:
            none_after.add(what)
        return found

    while (start := find(b"<", at)) >= 0:
        pieces.append(raw[at:start])
        at = -1
        if low.startswith(b"<!--", start) and (end := find(b"-->", start + 4)) >= 0:
            at = end + 3
        elif (end := find(b">", start)) >= 0:
            name = m[1] if (m := NAME.match(low, start + 1)) else b""
            if name == b"html" and declared is None and (m := DECLARED.search(low, start, end)):
                declared = m[1].decode()
            at = end + 1
            if name in HIDDEN and low[start + 1] != 0x2F and (close := find(b"</" + name, at)) >= 0 and (end := find(b">", close)) >= 0:
                at = end + 1
        if at < 0:
            pieces.append(raw[start:])
            at = len(raw)
    pieces.append(raw[at:])
    return b" ".join(pieces).decode("utf-8", "surrogatepass"), declared


def domain_of(host: str) -> str:
    labels = host.split(".")
    return ".".join(labels[-3:] if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SHARED else labels[-2:])


def triples(text: str) -> np.ndarray:
    b = np.frombuffer(re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)


def fitted(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the logarithm of each triple's probability in each. docs: lang, text."""
    named = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # half of the sample by each parity of the hash: Spark limits groups of up to 1,000 before it shuffles
    order = Window.partitionBy("lang", F.col("h").bitwiseAND(1)).orderBy("h")
    chosen = named.select("lang", "h").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE // 2).drop("r")
    chosen = stored(chosen, "language-sample")  # SAMPLE rows a language at most
    sample = named.join(F.broadcast(chosen) if len(chosen.take(MOST_SENT + 1)) <= MOST_SENT else chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, g in b.groupby("lang"):
                n = np.bincount(np.concatenate([triples(x) for x in g["text"]]), minlength=BUCKETS)
                used = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": used, "n": n[used]})

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        n = np.full(BUCKETS, 0.5)
        n[g["bucket"]] += g["n"]
        return pd.DataFrame({"lang": g["lang"].iloc[:1], "model": [np.log(n / n.sum()).astype("<f4").tobytes()]})

    rows = counts.groupBy("lang").applyInPandas(packed, "lang string, model binary").orderBy("lang").collect()  # BUCKETS counts a group; 128 KB a language
    return [r.lang for r in rows], np.stack([np.frombuffer(r.model, "<f4") for r in rows]) if rows else np.zeros((0, BUCKETS), np.float32)


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, ll (the text's evidence by language), p (its posterior)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    sent = pages.sparkSession.sparkContext.broadcast(model)  # 128 KB a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url, page in zip(b["url"], b["html"], strict=True):
                said, declared = visible(page or "")
                t = triples(entities.unescape(said))
                ll = sent.value[:, t].sum(axis=1, dtype=np.float64) * min(1.0, EVIDENCE / max(1, len(t)))
                ll -= ll.max(initial=-np.inf) if len(ll) else 0
                p = np.exp(ll) / np.exp(ll).sum()
                host = (m[1].lower().rstrip(".") if (m := HOST.match(url or "")) else "")
                out.append((host, domain_of(host), host.rsplit(".", 1)[-1], declared, ll, p))
            frame = pd.DataFrame(out, columns=["host", "domain", "suffix", "declared", "ll", "p"])
            frame.insert(0, "page_id", b["page_id"].to_numpy())
            yield frame

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, host string, domain string, suffix string, declared string, ll array<double>, p array<double>")


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host of each page.

    Nulls: a page without html has no text evidence, one without url the host '', one without a lang attribute no
    declared evidence. Ties go to the first language by name. Pages that share a page_id keep a row each. Other columns
    aren't read. Without labelled documents lang and probability are null; an empty table gives an empty one.
    """
    langs, model = fitted(docs)
    k = len(langs)
    if not k:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    seen = stored(evidence(pages, langs, model), "evidence")

    n_pages = seen.count()

    def with_sums(out: DataFrame, by: str) -> DataFrame:
        """out with of_<by>: the sums of its key. Common keys, COMMON at most, are sent; in the join of all others a row of
        a common key has a key of its own, so that none of them goes to one task."""
        sums = stored(seen.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("key")).agg(F.array(*(F.sum(F.col("p")[i]) for i in range(k))).alias("sums"), F.count("*").alias("n")), "sums")
        often = F.col("n") > n_pages / COMMON
        common = sums.where(often).select("key", F.col("sums").alias("common"))
        rare = sums.where(~often).select(F.col("key").alias("rare_key"), F.col("sums").alias("rare"))
        out = out.join(F.broadcast(common), F.col(by) == F.col("key"), "left").drop("key")
        own = F.when(F.col("common").isNull() & F.col(by).isNotNull(), F.col(by)).otherwise(F.concat(F.lit("\x00"), F.monotonically_increasing_id()))
        out = out.withColumn("own", own).join(rare, F.col("own") == F.col("rare_key"), "left")
        return out.withColumn(f"of_{by}", F.coalesce("common", "rare")).drop("common", "rare", "rare_key", "own")

    whole = seen.agg(*(F.sum(F.col("p")[i]) for i in range(k))).first()
    whole = [x or 0.0 for x in whole]
    everywhere = F.array(*(F.lit(float(x)) for x in whole))
    # one vote a host's page in each table: what a page itself added goes again
    out = seen
    for by in ("host", "domain", "suffix", "declared"):
        out = with_sums(out, by)

    def less(x: str) -> str:
        return f"transform({x}, (v, i) -> greatest(v - p[i], 0D))"

    def share(x: str) -> str:
        return f"transform({x}, v -> v / aggregate({x}, 0D, (s, y) -> s + y))"

    def step(out: DataFrame, name: str, expression: str | Column) -> DataFrame:
        return out.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)

    out = step(out, "whole", everywhere)
    out = step(out, "whole", f"transform({less('whole')}, v -> v + 1)")
    out = step(out, "prior", share("whole"))
    for by, weight in (("domain", DOMAIN_WEIGHT), ("host", HOST_WEIGHT)):
        out = step(out, "mixed", f"zip_with({less(f'of_{by}')}, prior, (n, q) -> n + {weight}D * q)")
        out = step(out, "prior", share("mixed"))
    n_suffix, n_declared = (max(1, seen.select(c).distinct().count()) for c in ("suffix", "declared"))
    out = step(out, "by_suffix", f"zip_with({less('of_suffix')}, whole, (n, w) -> (n + 1) / (w + {n_suffix}))")
    out = step(out, "by_declared", f"if(declared is null, transform(whole, w -> 1D), zip_with({less('of_declared')}, whole, (n, w) -> (n + 0.5) / (w + {n_declared} * 0.5)))")
    out = step(out, "log", "transform(ll, (x, i) -> x + log(prior[i]) + log(by_suffix[i]) + log(by_declared[i]))")
    out = step(out, "weight", "transform(log, x -> exp(x - array_max(log)))")
    out = step(out, "posterior", share("weight"))
    names = F.array(*map(F.lit, langs))
    best = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    text_best = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))
    return out.select("page_id", best.alias("lang"), F.round(F.array_max("posterior"), 6).alias("probability"), text_best.alias("text_lang"), "declared", "host")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
