"""Exact top-k of queries against all rows, as products of matrix blocks: no row for each pair is ever made.

A block of queries is sent to every task. A task multiplies it with slices of its rows and keeps the best k of each query,
so it hands on at most k rows a query; those of all tasks are merged by query. Work is linear in pairs, memory is that
of one block, one slice and the product of both.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes and number of queries in a block, and bytes of a slice's product with it.
QUERY_BYTES, MOST_QUERIES, PRODUCT_BYTES = 32 << 20, 10_000, 16 << 20
#: Rows in a slice that is prepared, so that what is made of it stays small beside the batch that it is from.
PREPARED_ROWS = 2000


@dataclass(frozen=True)
class Rules:
    """What else decides about a pair. digits: scores are rounded to. cap: rows of one label among a query's k.
    boost: added (up to 1) where a row's text has the query's tag as a whole word. only: pairs without it are none.
    same_model: pairs of different models are none. skip_same: a row isn't met by the query of its own id."""

    digits: int = 4
    cap: int | None = None
    boost: float = 0.0
    only: bool = False
    same_model: bool = False
    skip_same: bool = False


def _dense(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of list<number>, or of struct<at: list<int>, value: list<number>> (the places that aren't 0), all valid."""
    if pa.types.is_struct(column.type):
        at, value = column.field("at"), column.field("value")
        out = np.zeros((len(column), dimension))
        out[pc.list_parent_indices(at).to_numpy(), pc.list_flatten(at).to_numpy()] = pc.list_flatten(value).to_numpy()
        return out
    return pc.fill_null(pc.list_flatten(column), 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def _dimensions(column: pa.Array, sparse: int | None) -> np.ndarray:
    """Of each vector; -1 of a null one."""
    if pa.types.is_struct(column.type):
        return np.where(column.is_valid().to_numpy(zero_copy_only=False), sparse, -1)
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the squares of their lengths."""
    return m, np.einsum("ij,ij->i", m, m)


def whole_words(texts: list[str | None], tags: list[str]) -> np.ndarray:
    """texts x tags: whether a text has the tag, in any case, with no letter, digit or _ beside its ends."""
    import ahocorasick

    out, words = np.zeros((len(texts), len(tags)), bool), ahocorasick.Automaton()
    for i, t in enumerate(tags):
        words.add_word(t.lower(), (i, len(t.lower())))
    if not tags:
        return out
    words.make_automaton()
    inner = lambda text, i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    for row, text in enumerate(texts):
        low = (text or "").lower()
        for end, (tag, n) in words.iter(low):
            if not out[row, tag]:
                start = end - n + 1
                out[row, tag] = inner(low, start - 1) != inner(low, start) and inner(low, end) != inner(low, end + 1)
    return out


@dataclass
class Block:
    """Queries of one block, as tasks get them."""

    ids: pa.Array
    vectors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by dimension: which, rows, squares
    tags: list[str] = field(default_factory=list)
    tag_of: np.ndarray | None = None
    models: pa.Array | None = None

    @classmethod
    def of(cls, t: pa.Table, sparse: int | None) -> Block:
        column = t.column("query").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        sizes, out = _dimensions(column, sparse), cls(t.column("query_id").combine_chunks())
        for d in np.unique(sizes[sizes > 0]):
            which = np.flatnonzero(sizes == d)
            out.vectors[int(d)] = (which, *_unit(_dense(column.take(pa.array(which)), int(d))))
        if "tag" in t.column_names:
            tags = [x.lower() if x else None for x in t.column("tag").to_pylist()]
            out.tags = sorted({x for x in tags if x})
            number = {x: i for i, x in enumerate(out.tags)}
            out.tag_of = np.array([number.get(x, len(out.tags)) for x in tags])
        if "model" in t.column_names:
            out.models = t.column("model").combine_chunks()
        return out


def _scores(part: pa.RecordBatch, q: Block, rules: Rules, sparse: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of rows x queries in units of the last digit, and whether the pair is one."""
    n, m, unit = part.num_rows, len(q.ids), 10**rules.digits
    out, there = np.zeros((n, m), np.int64), np.ones((n, m), bool)
    column = part.column("vector")
    sizes = _dimensions(column, sparse)
    for d, (which, vectors, squares) in q.vectors.items():
        rows = np.flatnonzero(sizes == d)
        if len(rows):
            c, own = _unit(_dense(column.take(pa.array(rows)), d))
            length = np.sqrt(own[:, None] * squares[None, :])
            score = np.divide(c @ vectors.T, length, out=np.zeros_like(length), where=length > 0)
            out[np.ix_(rows, which)] = np.sign(score) * np.floor(np.abs(score) * unit + 0.5)
    if q.tag_of is not None and (rules.boost or rules.only):
        named = whole_words(part.column("text").to_pylist(), q.tags)
        named = np.concatenate([named, np.full((n, 1), bool(rules.only))], axis=1)[:, q.tag_of]  # a query without a tag meets all
        out = np.where(named & (q.tag_of < len(q.tags)), np.minimum(unit, out + round(rules.boost * unit)), out)
        if rules.only:
            there &= named
    if rules.same_model and q.models is not None:
        both = pc.dictionary_encode(pa.chunked_array([part.column("model"), q.models]).combine_chunks(), null_encoding="encode")
        codes = (both.chunk(0) if isinstance(both, pa.ChunkedArray) else both).indices.to_numpy()
        there &= codes[:n, None] == codes[None, n:]
    if rules.skip_same:
        own = pc.index_in(part.column("id"), value_set=q.ids)
        at = own.is_valid().to_numpy(zero_copy_only=False)
        there[np.flatnonzero(at), pc.drop_null(own).to_numpy()] = False
    return out, there


def _rank_within(*keys: np.ndarray) -> np.ndarray:
    """The place (from 0) of each row among those that share all keys but the last, by the last."""
    order = np.lexsort(keys[::-1])
    changed = np.zeros(len(order), bool)
    for k in keys[:-1]:
        changed[1:] |= k[order[1:]] != k[order[:-1]]
    first = np.maximum.accumulate(np.where(changed, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - first
    return out


def _capped(query: np.ndarray, place: np.ndarray, label: np.ndarray, k: int, cap: int | None) -> np.ndarray:
    """Rows of the first k of each query by place, at most cap of a label."""
    kept = np.arange(len(query))
    if cap is not None:
        kept = kept[_rank_within(query, label, place) < cap]
    return kept[_rank_within(query[kept], place[kept]) < k]


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    coded = pc.dictionary_encode(column, null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy()


class Best:
    """The best k rows of each query so far."""

    def __init__(self, n_queries: int, k: int, cap: int | None, ties: list[tuple[str, str]]) -> None:
        self.n, self.k, self.cap, self.ties = n_queries, k, cap, ties
        self.query, self.score, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def add(self, rows: pa.Table, score: np.ndarray, there: np.ndarray) -> None:
        """rows: in the order of ties; score, there: rows x queries."""
        n, m = score.shape
        key = np.where(there, score * n + (n - 1 - np.arange(n))[:, None], np.iinfo(np.int64).min)
        label = _codes(rows.column("label")) if self.cap is not None else np.zeros(n, np.int64)
        open_q, taken = np.arange(m), []
        deep = min(n, self.k if self.cap is None else 4 * self.k)
        while len(open_q):  # deeper for queries whose rows of few labels leave places free
            part = key[:, open_q]
            top = np.argpartition(part, n - deep, axis=0)[n - deep :] if deep < n else np.tile(np.arange(n)[:, None], (1, len(open_q)))
            query, row = np.repeat(np.arange(len(open_q)), deep), top.T.ravel()
            valid = there[row, open_q[query]]
            query, row = query[valid], row[valid]
            kept = _capped(query, -key[row, open_q[query]], label[row], self.k, self.cap)
            query, row = query[kept], row[kept]
            full = np.bincount(query, minlength=len(open_q)) >= self.k
            if deep == n or self.cap is None:
                full[:] = True
            ready = full[query]
            taken.append((open_q[query[ready]], row[ready]))
            open_q, deep = open_q[~full], min(n, 4 * deep)
        query, row = (np.concatenate(x) for x in zip(*taken, strict=True)) if taken else (np.zeros(0, np.int64),) * 2
        self._merge(query, score[row, query], rows.take(pa.array(row)))

    def _merge(self, query: np.ndarray, score: np.ndarray, rows: pa.Table) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        rows = pa.concat_tables([self.rows, rows]).combine_chunks() if self.rows is not None else rows
        if not len(query):
            return
        tie = np.empty(len(query), np.int64)
        tie[pc.sort_indices(rows, sort_keys=self.ties).to_numpy()] = np.arange(len(query))
        order = np.lexsort((tie, -score))
        place = np.empty(len(query), np.int64)
        place[order] = np.arange(len(query))
        label = _codes(rows.column("label")) if self.cap is not None else place
        kept = _capped(query, place, label, self.k, self.cap)
        self.query, self.score, self.rows = query[kept], score[kept], rows.take(pa.array(kept))


def best(
    rows: DataFrame, names: list[str], queries: DataFrame, n_bytes: Column, block_of: Callable[[pa.Table], Any], scores: Callable[[pa.RecordBatch, Any], tuple[np.ndarray, np.ndarray]],
    k: int, ties: list[tuple[str, str]], digits: int = 0, cap: int | None = None, most_queries: int = MOST_QUERIES, prepare: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]] | None = None,
) -> DataFrame:
    """query_id, place (from 1), score, and the named columns of rows: the k best rows of each of queries (query_id and
    others, n_bytes each when sent).

    block_of makes of a block of queries what tasks get, with ids; scores gives of a slice of rows, in the order of ties,
    and such a block the units of the last digit and whether the pair is one, rows x queries. ties: column and
    'ascending' or 'descending', nulls last. prepare makes, in each task, what turns a slice of rows into one for scores.
    """
    spark = rows.sparkSession
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    n, sent_bytes = queries.agg(F.count("*"), F.coalesce(F.sum(n_bytes + 100), F.lit(0))).first()
    # twice as many blocks as would do on average, since the hash deals unevenly
    blocks = 1 if n <= most_queries and sent_bytes <= QUERY_BYTES else max(-(-2 * n // most_queries), -(-2 * sent_bytes // QUERY_BYTES))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, units long, " + ", ".join(f"{c} {types[c]}" for c in names)

    def found(block: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(block_of(block.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ready = sent.value, prepare() if prepare else None
            best_ = Best(len(q.ids), k, cap, ties)
            step = max(k, min(PRODUCT_BYTES // (8 * max(1, len(q.ids))), PREPARED_ROWS if ready else sys.maxsize))
            for b in batches:
                for start in range(0, b.num_rows if len(q.ids) else 0, step):
                    part = ready(b.slice(start, step)) if ready else b.slice(start, step)
                    if not part.num_rows:
                        continue
                    part = part.take(pc.sort_indices(pa.table({c: part.column(c) for c, _ in ties}), sort_keys=ties))
                    best_.add(pa.table({c: part.column(c) for c in names}), *scores(part, q))
            if best_.rows is not None and len(best_.query):
                out = [q.ids.take(pa.array(best_.query)), pa.array(best_.score), *(best_.rows.column(c) for c in names)]
                yield from pa.table(dict(zip(["query_id", "units", *names], out, strict=True))).to_batches(max_chunksize=10_000)

        return rows.mapInArrow(run, schema)

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    each = reduce(DataFrame.union, [found(queries.where(block == i) if blocks > 1 else queries) for i in range(blocks)])
    order = [F.desc("units"), *(F.asc_nulls_last(c) if way == "ascending" else F.desc_nulls_last(c) for c, way in ties)]
    if cap is not None:
        each = each.withColumn("of_label", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(*order))).where(F.col("of_label") <= cap)
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k)
    return placed.select("query_id", "place", (F.col("units") / 10**digits).alias("score"), *names)


def nearest(rows: DataFrame, queries: DataFrame, k: int, ties: list[str], rules: Rules = Rules(), dimension: int | None = None, most_queries: int = MOST_QUERIES, prepare: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]] | None = None) -> DataFrame:
    """query_id, place (from 1), score, and rows' columns but vector, text and model: the k rows of the largest cosine.

    rows: id, vector, the columns of ties (which decide between equal scores, ascending, nulls last) and, as the rules
    need them, label, text, model. queries: query_id, query, and tag, model. A vector is an array of numbers, or a struct
    of the places (at) and values that aren't 0 in `dimension` places. The score is 0 where a vector is null or has no
    length, or the two differ in dimension. Equal rows keep a place each. No rows or no queries: an empty table. prepare: as
    in best; it may make vectors of the column words.
    """
    names = [*dict.fromkeys(["id", *ties, *(["label"] if "label" in rows.columns else [])])]
    used = [*names, "vector", *(c for c in ("text", "model", "words") if c in rows.columns)]
    asked = queries.select("query_id", "query", *(c for c in ("tag", "model") if c in queries.columns))
    sizes = F.coalesce(F.lit(dimension) if dimension else F.size("query"), F.lit(0))
    return best(
        rows.select(used), names, asked, 8 * F.greatest(sizes, F.lit(1)), lambda t: Block.of(t, dimension), lambda part, q: _scores(part, q, rules, dimension),
        k, [(c, "ascending") for c in ties], rules.digits, rules.cap, most_queries, prepare,
    )
