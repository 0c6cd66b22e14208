"""Spelling variants grouped by squared distances of letter counts from blocked Gram matrices.

One inserted or deleted letter changes the vector of letter counts by a squared distance of 1, a replaced one by 2. Words
lie in blocks, and in a block the words of a length meet those of the same and of the next length in one matrix
product, |a|^2 + |b|^2 - 2 ab; pairs at 1 (next length) or 2 (same length) are verified letter by letter.

Blocks need not hold all words of a length: letters are dealt to bands, and one edit changes the counts of two bands at
most. So a block is named by two bands left out and the exact counts of all letters in the others, every word stands
in one block for each choice of two bands, and near words share one. A pair is taken only in the first choice that holds
the bands in which it differs, so once. A block of more than `block_words` words is cut into parts that meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = 26 + 64  # a-z and U+00C0-U+00FF
SHORTEST, NOISE = 7, 31  # least code points of a word; one run in so many loses a code point
FLUSH_LETTERS = 1 << 20  # letters of the blocks that are worked on together
CELLS = 1 << 22  # cells of one matrix product or comparison
POOL = 512  # words of small blocks that share a product


def corrupted_words(docs: DataFrame, at_least: int = 2) -> DataFrame:
    """(word, n): runs of letters of all texts, lower-cased in A-Z, one code point deleted where the checksum says so.

    The checksum takes a null doc_id as empty. Shorter runs can't become words, so only long ones are found.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    low = low.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    gap = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), gap), F.substring("run", gap + 2, F.char_length("run")))
    words = low.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= at_least))


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words after one another, as numbers 0..LETTERS-1, and where each word begins (one more at the end)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.where(codes < 0x80, codes - ord("a"), codes - 0xC0 + 26), np.concatenate([[0], ends]).astype(np.int64)


def letter_counts(letters: np.ndarray, begins: np.ndarray) -> np.ndarray:
    rows = len(begins) - 1
    owner = np.repeat(np.arange(rows), np.diff(begins))
    return np.bincount(owner * LETTERS + letters, minlength=rows * LETTERS).reshape(rows, LETTERS)


def deal_bands(totals: np.ndarray, bands: int) -> np.ndarray:
    """The band of each letter: frequent letters first, each to the band with the fewest occurrences so far."""
    load, band = np.zeros(bands), np.zeros(len(totals), np.int64)
    for letter in np.argsort(-totals, kind="stable"):
        band[letter] = load.argmin()
        load[band[letter]] += totals[letter] + 1e-9
    return band


class Bands:
    """The choices of two bands to leave out, their block names, and the first choice for each set of differing bands."""

    def __init__(self, band: np.ndarray, bands: int):
        self.choices = list(combinations(range(bands), 2))
        self.bits = (1 << band).astype(np.int64)
        factors = np.random.default_rng(5).integers(1, 1 << 62, LETTERS, dtype=np.int64) * 2 + 1
        self.factors = np.stack([np.where((band == x) | (band == y), 0, factors) for x, y in self.choices], axis=1)
        self.first = np.full(1 << bands, -1)
        for at, (x, y) in reversed(list(enumerate(self.choices))):
            self.first[[1 << x, 1 << y, 1 << x | 1 << y]] = at

    def names(self, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.int64) @ self.factors  # wraps around, as a hash

    def first_choice(self, difference: np.ndarray) -> np.ndarray:
        return self.first[np.bitwise_or.reduce(np.where(difference != 0, self.bits, 0), axis=1)]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows in which the long word is the short one with one letter more."""
    width = short.shape[1]
    ahead, behind = short == long[:, :-1], short == long[:, 1:]
    equal_from_left = np.where(ahead.all(axis=1), width, ahead.argmin(axis=1))
    last_unequal = np.where(behind.all(axis=1), -1, width - 1 - behind[:, ::-1].argmin(axis=1))
    return last_unequal < equal_from_left


def near_in_block(letters: np.ndarray, begins: np.ndarray, sizes: np.ndarray, counts: np.ndarray, side: np.ndarray,
                  across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart, the shorter word first. Rows are in order of size; with `across` only pairs of unequal side.

    Row blocks of one length are multiplied with the columns of that and the next length.
    """
    squares = (counts * counts).sum(axis=1)
    lengths, starts = np.unique(sizes, return_index=True)
    starts = np.append(starts, len(sizes))
    exact = np.float32 if sizes.max() < 2048 else np.float64  # all sums stay whole numbers
    varying = counts[:, (counts != counts[0]).any(axis=0)].astype(exact)  # equal columns cancel out
    fixed = squares - (varying.astype(np.float64) ** 2).sum(axis=1).astype(squares.dtype)
    squares = (squares - fixed).astype(exact)
    for at, length in enumerate(lengths):
        low, high = starts[at], starts[at + 1]
        longer = at + 1 < len(lengths) and lengths[at + 1] == length + 1
        stop = starts[at + 2] if longer else high
        step = max(1, CELLS // int(stop - low))
        for a in range(low, high, step):
            b = min(a + step, high)
            distance = squares[a:b, None] + squares[None, a:stop] - 2 * (varying[a:b] @ varying[a:stop].T)
            column = np.arange(a, stop)
            wanted = np.where(column < high, 2, 1).astype(exact)
            i, j = np.nonzero((distance == wanted) & (column[None, :] > np.arange(a, b)[:, None]))
            i, j = i + a, j + a
            if across:
                other = side[i] != side[j]
                i, j = i[other], j[other]
            for same in (True, False):
                of = (j < high) == same
                x, y = i[of], j[of]
                width = max(1, CELLS // int(length + 1))
                for k in range(0, len(x), width):
                    u, v = x[k:k + width], y[k:k + width]
                    p = letters[begins[u][:, None] + np.arange(length)]
                    q = letters[begins[v][:, None] + np.arange(length + (0 if same else 1))]
                    good = one_replaced(p, q) if same else one_inserted(p, q)
                    yield u[good], v[good]


def pools(edges: np.ndarray, choice: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks, small whole ones of one choice taken together: near words of two of them differ in a band that the choice keeps,
    so they are not taken here."""
    begin = None
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if begin is not None and (b - begin > POOL or high[a] or high[begin] or choice[a] != choice[begin]):
            yield begin, a
            begin = None
        begin = a if begin is None else begin
    if begin is not None:
        yield begin, int(edges[-1])


def _near_rows(words: list[str], n: np.ndarray, choice: np.ndarray, edges: np.ndarray, chunk: np.ndarray, low: np.ndarray,
               high: np.ndarray, bands: Bands) -> pa.RecordBatch:
    """For each row with near words in its block: how many, and the best of them."""
    letters, begins = letters_of(words)
    counts = letter_counts(letters, begins)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes = np.diff(begins)
    for a, b in pools(edges, choice, high):
        if b - a < 2:
            continue
        rows = a + np.argsort(sizes[a:b], kind="stable")
        for u, v in near_in_block(letters, begins[rows], sizes[rows], counts[rows], chunk[rows] == low[a], low[a] != high[a]):
            u, v = rows[u], rows[v]
            first = bands.first_choice(counts[u] - counts[v]) == choice[a]
            us.append(u[first])
            vs.append(v[first])
    u, v = np.concatenate([*us, *vs]), np.concatenate([*vs, *us])
    if len(v):
        seen = np.unique(v)
        place = np.zeros(len(words), np.int64)
        place[sorted(seen.tolist(), key=words.__getitem__)] = np.arange(len(seen))
        order = np.lexsort((place[v], -n[v], u))
        u, v = u[order], v[order]
    rows, at, many = np.unique(u, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in rows], pa.string()), pa.array(many, pa.int64()),
         pa.array([words[k] for k in v[at]], pa.string()), pa.array(n[v[at]], pa.int64())],
        ["word", "n_near", "best", "best_n"])


def _search(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their block; whole blocks are worked on, some letters at a time."""
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, now]) if rest is not None else now
            if rest.num_rows < 2 or rest.column("len").to_numpy().sum() < FLUSH_LETTERS:
                continue
            starts = _block_starts(rest)
            if len(starts) > 1:  # the last block may go on in the next batch
                yield work(rest.slice(0, starts[-1]), starts)
                rest = rest.slice(starts[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield work(rest, np.append(_block_starts(rest), rest.num_rows))

    def work(rows: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        def col(name: str) -> np.ndarray:
            return rows.column(name).to_numpy()
        return _near_rows(rows.column("word").to_pylist(), col("n"), col("choice"), edges, col("chunk"), col("low"), col("high"), bands)

    return run


def _block_starts(rows: pa.Table) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for name in ("choice", "name", "low", "high"):
        values = rows.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def near_words(words: DataFrame, bands: int | None = None, block_words: int = 4096) -> DataFrame:
    """(word, n_near, best, best_n) of words that others are one edit away from; best has the largest n, then the smallest word.

    `words` is (word, n) without repeats, of letters a-z and U+00C0-U+00FF. More bands make smaller blocks and more of
    them: by default one for each digit of the number of words but two, from 3 to 12; every number gives equal rows.
    """
    if bands is None:
        bands = min(max(len(str(words.count())) - 2, 3), 12)
    totals = np.zeros(LETTERS, np.int64)
    for row in words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect():  # a row per letter
        if row["c"]:
            totals[letters_of([row["c"]])[0][0]] += row["count"]
    dealt = Bands(deal_bands(totals, bands), bands)

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("word").to_pylist()
        letters, begins = letters_of(words)
        names = dealt.names(letter_counts(letters, begins))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * len(dealt.choices), pa.int32()), pa.array(names.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(np.diff(begins)), lists], ["word", "n", "len", "names"])

    keyed = staged(map_slices(words, "word", named, "word string, n long, len long, names array<long>"), "word-blocks")
    spread = F.posexplode("names").alias("choice", "name")
    many = staged(keyed.select(spread).groupBy("choice", "name").count().filter(F.col("count") > block_words)
                  .select("choice", "name", F.ceil(F.col("count") / block_words).cast("int").alias("chunks")), "large-blocks")
    chunks = F.coalesce("chunks", F.lit(1))
    members = (keyed.select("word", "n", "len", spread).join(many, ["choice", "name"], "left")
               .withColumn("chunk", F.pmod(F.xxhash64("word"), chunks).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
               .select("word", "n", "len", "choice", "name", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")))
    block = ["choice", "name", "low", "high"]
    found = (members.repartition(*block).sortWithinPartitions(*block)
             .mapInArrow(_search(dealt), "word string, n_near long, best string, best_n long"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top")).select(
        "word", "n_near", F.col("top.best").alias("best"), (-F.col("top.m")).alias("best_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last. Every round doubles the steps; n grows along a
    path, so there are no circles, and few rounds."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = staged(now, "word-roots")
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, at_least: int = 2, factor: int = 10, bands: int | None = None, block_words: int = 4096) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    A word's form is its near word of the largest n if that is `factor` times its own or more, else null; root is the
    last of the forms, the word itself if it has none. Null and empty texts have no words, repeated rows count each,
    an empty table gives no rows, other columns are not read.
    """
    words = staged(corrupted_words(docs, at_least), "words")
    joined = words.join(near_words(words, bands, block_words), "word", "left")
    far = F.col("best_n") >= factor * F.col("n")
    rows = staged(joined.select("word", F.when(far, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(far, F.col("best_n")).alias("form_n")), "word-forms")
    roots = with_roots(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
