"""Audit of how sources of a language differ in their words, by products of one-hot level matrices.

What a term adds to the divergence of two sources hangs on its two counts alone. So each term is a row of indicators, one
column for every (source, count level) pair that occurs, and the product of this matrix with its transpose holds, for
every two sources at once, the joint table of their levels: how many terms have level a here and level b there. Terms
are dealt over tasks and sorted by their total, so that blocks of rows share few columns; blocks are cut by rows until
the columns are bounded, by columns beyond that, and their products are exact. Tables are priced block by block and summed.

A level of zero has no column: the tables are priced as if every term were at zero in both sources, plus what one level
changes (a sum over the levels of a source), plus what both change together (the joint tables).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged

SCALE = 1_000_000_000
TERM = re.compile(rb"[a-z\x80-\xff]+")  # bytes of lower-cased text: a letter a-z or a byte of a code point beyond ASCII
FLUSH_TERMS = 400_000  # distinct terms that a task counts before it hands them on
COLUMNS = 512  # columns of one product
ROWS = 4096  # terms of one product


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows so far, again and again."""
    total, docs = defaultdict(Counter), defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        keys = [(k, t, n) for k, counts in total.items() for t, n in counts.items()]
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _, _ in keys], pa.string()), pa.array([k[1] for k, _, _ in keys], pa.string()),
             pa.array([t for _, t, _ in keys], pa.binary()), pa.array([n for _, _, n in keys], pa.int64()),
             pa.array([docs[k][t] for k, t, _ in keys], pa.int64())], ["lang", "source", "term", "n", "docs"])
        total.clear()
        docs.clear()
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                found = TERM.findall(text.lower())  # of bytes: only A-Z change
                total[lang, source].update(found)
                docs[lang, source].update(set(found))
            if sum(map(len, total.values())) > FLUSH_TERMS:
                yield flush()
    yield flush()


def kept_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, lang_n) of terms in at least `least_docs` documents of the language; n is above zero."""
    rows = docs.select(_text("lang").alias("lang"), _text("source").alias("source"), _text("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(_term_counts, "lang string, source string, term binary, n long, docs long")
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return (cells.withColumns({"lang_n": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term)})
            .filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in whole numbers of any length."""
    wide = "decimal(38,0)"
    top = (count.cast(wide) + 1).cast("decimal(26,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", top, (total + terms).cast(wide)) + 1)


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def one_hot_product(term: np.ndarray, column: np.ndarray, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, terms) with i < j for all columns that terms have in common: the transpose of the one-hot matrix with itself,
    a block of columns against another at a time. `term` numbers the rows from 0."""
    rows = int(term.max()) + 1

    def block(a: int) -> np.ndarray:
        matrix = np.zeros((rows, min(COLUMNS, columns - a)), np.float32)  # sums of at most ROWS ones are exact
        inside = (column >= a) & (column < a + COLUMNS)
        matrix[term[inside], column[inside] - a] = 1
        return matrix

    for a in range(0, columns, COLUMNS):
        left = block(a)
        for b in range(a, columns, COLUMNS):
            product = left.T @ (left if a == b else block(b))
            i, j = np.nonzero(np.triu(product, 1) if a == b else product)
            yield i + a, j + b, product[i, j].astype(np.int64)


def _priced_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): what both levels of two sources change together, summed over the block's terms.

    Rows come in order of language and term; a term's rows are never parted.
    """
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, now]) if rest is not None else now
        cut = _last_term(rest)
        if cut:
            yield from _blocks(rest.slice(0, cut))
            rest = rest.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield from _blocks(rest)


def _new(values: pa.ChunkedArray) -> np.ndarray:
    codes = values.combine_chunks().dictionary_encode().indices.to_numpy()
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _last_term(rows: pa.Table) -> int:
    starts = np.flatnonzero(_new(rows.column("lang")) | _new(rows.column("term"))) if rows.num_rows else np.zeros(1, int)
    return int(starts[-1])


def _blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    langs = np.flatnonzero(np.append(_new(rows.column("lang")), True))
    for a, b in zip(langs, langs[1:]):
        of = rows.slice(a, b - a)
        names = of.column("source").combine_chunks().dictionary_encode()
        source, level = names.indices.to_numpy(), of.column("n").to_numpy()
        p, p0 = of.column("p").to_numpy(), of.column("p0").to_numpy()
        starts = np.flatnonzero(_new(of.column("term")))
        order = np.lexsort((level, source))
        step = np.concatenate([[True], (source[order][1:] != source[order][:-1]) | (level[order][1:] != level[order][:-1])])
        column = np.empty(len(source), np.int64)
        column[order] = np.cumsum(step) - 1  # the (source, level) pair of each row
        edges = np.append(starts, len(source))
        low = 0
        sums: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
        while low < len(starts):
            high = low + _fitting(column, edges, low)
            x, y = edges[low], edges[high]
            used, first, local = np.unique(column[x:y], return_index=True, return_inverse=True)
            first = first + x
            term = np.repeat(np.arange(high - low), np.diff(edges[low:high + 1]))
            for i, j, terms in one_hot_product(term, local, len(used)):
                i, j = first[i], first[j]
                for s, t in ((i, j), (j, i)):
                    _add(sums, source[s], source[t], terms, _price(p[s], p[t]) - _price(p[s], p0[t]) - _price(p0[s], p[t]) + _price(p0[s], p0[t]))
            low = high
        if sums:
            lang = of.column("lang")[0].as_py()
            values = [Decimal((hi << 32) + lo) for hi, lo in sums.values()]
            label = names.dictionary.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(sums), pa.string()), pa.array([label[s] for s, _ in sums], pa.string()),
                 pa.array([label[t] for _, t in sums], pa.string()), pa.array(values, pa.decimal128(38, 0))], ["lang", "source", "item", "value"])


def _fitting(column: np.ndarray, edges: np.ndarray, low: int) -> int:
    """How many terms from `low` on have COLUMNS columns together at most, one at least."""
    high = min(low + ROWS, len(edges) - 1)
    part = column[edges[low]:edges[high]]
    _, first = np.unique(part, return_index=True)
    if len(first) <= COLUMNS:
        return high - low
    limit = edges[low] + np.sort(first)[COLUMNS]  # the row that brings one column too many
    return max(int(np.searchsorted(edges, limit, side="right")) - 1 - low, 1)


def _add(sums: dict, s: np.ndarray, t: np.ndarray, terms: np.ndarray, gain: np.ndarray) -> None:
    """Add terms * gain to the sums of (s, t), in two halves so that nothing overflows."""
    if not len(s):
        return
    key = s.astype(np.int64) << 32 | t
    keys, at = np.unique(key, return_inverse=True)
    for half, part in enumerate((gain >> 32, gain & 0xFFFFFFFF)):
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, part * terms)
        for k, value in zip(keys.tolist(), total.tolist()):
            sums[k >> 32, k & 0xFFFFFFFF][half] += value


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of the rows.

    Part `pair`: the group against each other source of its language, summed over all kept terms. Part `term`: the `top`
    terms that the group has more often than its language. Nulls are '', rows count each, languages without a kept term
    have value 0 for their pairs and no terms. An empty table gives no rows. Other columns are not read.
    """
    cells = staged(kept_terms(docs, least_docs), "term-counts")
    langs = cells.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = (docs.select(_text("lang").alias("lang"), _text("source").alias("source")).distinct()
              .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
              .withColumn("p0", probability(zero, F.col("total"), F.col("terms"))))
    groups = staged(groups, "groups")
    priced = (cells.join(groups, ["lang", "source"])
              .withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms"))))
    blocks = (priced.select("lang", "term", "source", "n", "lang_n", "p", "p0").repartition("lang", "term")
              .sortWithinPartitions("lang", "lang_n", "term").drop("lang_n"))
    wide = "decimal(38,0)"
    together = blocks.mapInArrow(_priced_blocks, f"lang string, source string, item string, value {wide}")
    # One level apart from zero, on either side.
    levels = priced.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("many"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = levels.join(other, "lang").filter("source <> item").withColumn("base", price(F.col("p0"), F.col("q0")))
    back = price(F.col("q0"), F.col("p0"))
    alone = met.select("lang", F.explode(F.array(
        F.struct("source", "item", ((price(F.col("p"), F.col("q0")) - F.col("base")).cast("decimal(19,0)") * F.col("many")).cast(wide).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"),
                 ((price(F.col("q0"), F.col("p")) - back).cast("decimal(19,0)") * F.col("many")).cast(wide).alias("value")))).alias("r")).select("lang", "r.*")
    none = (groups.join(other, "lang").filter("source <> item")
            .select("lang", "source", "item", F.coalesce(price(F.col("p0"), F.col("q0")).cast("decimal(19,0)") * F.col("terms"), F.lit(0)).cast(wide).alias("value")))
    pairs = (none.unionByName(alone).unionByName(together).groupBy("lang", "source", "item")
             .agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair")))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = (priced.withColumn("q", q).filter("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), price(F.col("p"), F.col("q")).alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    ranked = pairs.withColumn("rank", F.row_number().over(order)).select(*out)
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(*out)
    return ranked.unionByName(best)
