"""Toxicity by noisy-channel deobfuscation.

A character 4-gram model is counted over all documents. Words that may be disguised (leet characters
among letters, doubled letters, single letters or leet characters set apart) become character lattices: a leet
character may stand for a letter or for nothing, a repeated letter may be a stutter, a separator may be
padding or the end of a word. Viterbi takes the likeliest letters under the model. A word without any of these has
one path only, itself. Restored and plain words meet a lexicon of log odds learned from labelled documents, and a
logistic curve over the evidence gives the score.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, is_fold, map_slices, slices, staged

SYMBOLS = 28  # 0 boundary, 1-26 letters without accents, 27 any other letter
GRAMS = SYMBOLS ** 4
# Letters that leet characters may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SUBSTITUTE, NOISE, STUTTER, PADDING = 1.0, 4.0, 2.0, 0.5  # costs in nats
GAP = 4  # bytes from one single character of a spaced run to the next, at most
CACHE_BYTES = 32 << 20  # of spans and the words behind them that one task remembers
PIECE, OVERLAP = 2048, 64  # bytes: longer spans are decoded in pieces, each beginning with the end of the one before


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane; code points above count as boundaries."""
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        letter = chr(code)
        if letter.isalpha():
            base = unicodedata.normalize("NFD", letter.lower())[0]
            table[code] = ord(base) - 96 if "a" <= base <= "z" else 27
    return table


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return symbol_table()[np.where(codes < 1 << 16, codes, 0)]


def gram_counts(symbols: np.ndarray) -> np.ndarray:
    """Counts of symbol 4-grams; what stands before a boundary is forgotten."""
    s = np.concatenate([np.zeros(3, np.uint8), symbols, np.zeros(1, np.uint8)])
    c, d = s[2:-1], s[3:]
    b = np.where(c == 0, 0, s[1:-2])
    a = np.where(b == 0, 0, s[:-3])
    seen = (c != 0) | (d != 0)
    index = ((a.astype(np.int32) * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d
    return np.bincount(index[seen], minlength=GRAMS)


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(d | a b c) over all texts, interpolated with shorter contexts. At most 28^4 counts reach the driver."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(GRAMS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = [t for t in part.column("text").to_pylist() if t]
                if texts:
                    counts += gram_counts(symbols_of("\n".join(texts)))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], ["gram", "n"])

    found = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "gram int, n long")
             .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros(GRAMS)
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    counts = counts.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        part = counts.sum(axis=axes) if axes else counts
        p = (part + 5.0 * p) / (part.sum(axis=-1, keepdims=True) + 5.0)
    return np.log(p).astype(np.float32)


def restore(span: str, logp: np.ndarray, split: bool = False) -> str:
    """The likeliest letters behind a disguised span: Viterbi over its lattice, states are the last three symbols.

    With `split` it may be several words, with blanks between: a separator may end a word, separators outside of words
    cost nothing, and equal letters set apart may be a stutter.
    """
    table = symbol_table()
    paths = {(0, 0, 0): (0.0, None)}  # state -> (score, (letter, rest of the path))
    previous = ""
    for char in span:
        own = int(table[ord(char)]) if ord(char) < 1 << 16 else 0
        moves: list[tuple[str, int, float]] = []
        drop = None
        if own:
            moves.append((char, own, 0.0))
            drop = STUTTER if char == previous else None
        elif char in LEET:
            moves += [(letter, ord(letter) - 96, SUBSTITUTE) for letter in LEET[char]]
            drop = NOISE if char != previous else STUTTER
        else:
            drop = PADDING
            moves += [(" ", 0, 0.0)] if split else []
        after: dict[tuple, tuple] = {}
        for (a, b, c), (score, path) in paths.items():
            cost = 0.0 if split and not (c or own or char in LEET) else drop
            if cost is not None and score - cost > after.get((a, b, c), (-1e300,))[0]:
                after[a, b, c] = (score - cost, path)
            for letter, symbol, cost in moves:
                if not symbol and not c:
                    continue
                reached = score - cost + float(logp[a, b, c, symbol])
                state = (b, c, symbol) if symbol else (0, 0, 0)
                if reached > after.get(state, (-1e300,))[0]:
                    after[state] = (reached, (letter, path))
        paths = after
        if not split or own or char in LEET:
            previous = char
    _, path = max(((score + (float(logp[a, b, c, 0]) if c or not split else 0.0), path) for (a, b, c), (score, path) in paths.items()),
                  key=lambda x: x[0])
    letters = []
    while path:
        letter, path = path
        letters.append(letter)
    return "".join(reversed(letters))


# Classes of bytes of lower-cased UTF-8: letters (bytes from 0x80 on belong to some), leet characters, blanks.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_PLAIN = bytes(c if _LETTER[c] else 32 for c in range(256))


def disguised_spans(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of lower-cased text that may hide a word."""
    if len(data) < 2:
        return []
    raw = np.frombuffer(data, np.uint8)
    padded = np.concatenate([[32] * 4, raw, [32] * 4]).astype(np.uint8)
    letter, leet, blank = _LETTER[padded], _LEET[padded], _BLANK[padded]
    n = len(raw)
    at = lambda x, k: x[4 + k:4 + k + n]
    # A leet character between word start or letter on the left and a letter on the right; a doubled one;
    # or one or two at the end of a word; or a doubled letter.
    before = at(letter, -1) | at(blank, -1) | (at(leet, -1) & (at(letter, -2) | at(blank, -2)))
    inner = at(leet, 0) & before & (at(letter, 1) | (at(leet, 1) & at(letter, 2)))
    soft = (at(padded, 0) != ord("!")) & (at(padded, 0) != ord("|")) & (at(padded, 0) != ord("+"))
    ends = at(blank, 1) | (at(leet, 1) & at(blank, 2))
    last = at(leet, 0) & soft & at(letter, -1) & ends
    ascii_ = at(padded, 0) < 128
    twice = at(letter, 0) & ascii_ & (at(padded, 0) == at(padded, 1))
    word = letter | ((padded >= 48) & (padded <= 57))
    single = (letter | leet) & ~np.concatenate([[False], word[:-1]]) & ~np.concatenate([word[1:], [False]])
    starts = np.flatnonzero(inner | last | twice)
    spans, end = [], 0
    if len(starts):
        edges = np.flatnonzero(at(blank, 0))
        left = np.concatenate([[-1], edges])[np.searchsorted(edges, starts)]
        right = np.concatenate([edges, [n]])[np.searchsorted(edges, starts)]
        for a, b in zip((left + 1).tolist(), right.tolist()):
            if a >= end:
                spans.append((a, b))
                end = b
    # Runs of three or more single characters, a letter among them. What stands between is neither letter nor digit.
    apart = np.flatnonzero(at(single, 0))
    if len(apart) > 2:
        edges = np.flatnonzero(np.diff(apart) > GAP) + 1
        first, last_one = np.append(0, edges), np.append(edges, len(apart)) - 1
        letters = np.append(0, np.cumsum(at(letter, 0)[apart]))
        run = (last_one - first > 1) & (letters[last_one + 1] > letters[first])
        spans += zip(apart[first[run]].tolist(), (apart[last_one[run]] + 1).tolist())
    return spans


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A range whole, or cut into overlapping ones of `PIECE`, so that what is no longer than the overlap lies whole in one."""
    if end - start <= PIECE:
        return [(start, end)]
    return [(at, min(at + PIECE, end)) for at in range(start, end - OVERLAP, PIECE - OVERLAP)]


class SpanCache(dict):
    """Words behind the spans met so far; emptied before they would take more than `limit` bytes."""

    def __init__(self, limit: int = CACHE_BYTES):
        super().__init__()
        self.limit, self.size = limit, 0

    def __setitem__(self, span: bytes, words: list[bytes]) -> None:
        taken = 256 + len(span) + sum(64 + len(word) for word in words)
        if self.size + taken > self.limit:
            self.clear()
            self.size = 0
        if taken <= self.limit:
            super().__setitem__(span, words)
            self.size += taken


def traits(word: bytes) -> set[bytes]:
    """What the lexicon may know a word by: its beginnings of 4 to 6 bytes, and itself with a blank behind it."""
    return {word + b" "} | {word[:n] for n in (4, 5, 6) if len(word) >= n}


@dataclass
class ToxicityModel:
    logp: np.ndarray
    lexicon: dict[bytes, float] = field(default_factory=dict)
    curve: tuple[float, ...] = ()
    heads: set[bytes] = field(default_factory=set)

    def learn(self, lexicon: dict[bytes, float]) -> None:
        self.lexicon, self.heads = lexicon, {trait.rstrip(b" ")[:4] for trait in lexicon}

    def words(self, text: str | None, cache: dict[bytes, list[bytes]]) -> list[bytes]:
        """Plain words, and the restored ones of disguised spans where these differ.

        A span without blanks may be as long as the text; beyond `PIECE` bytes it is decoded in pieces, and a word
        that lies in the overlap of two counts in both.
        """
        data = (text or "").lower().encode("utf-8", "replace")
        found = data.translate(_PLAIN).split()
        for a, b in (piece for span in disguised_spans(data) for piece in pieces(*span)):
            span = data[a:b]
            if (behind := cache.get(span)) is None:
                behind, plain = restore(span.decode("utf-8", "replace"), self.logp, split=True).encode().split(), span.translate(_PLAIN).split()
                cache[span] = behind = [] if behind == plain else behind
            found += behind
        return found

    def evidence(self, words: list[bytes]) -> tuple[float, float, float]:
        """Summed log odds of the lexicon's words met, their number, and their share of the words."""
        odds = []
        for word in words:
            if word[:4] in self.heads:
                best = max((self.lexicon[t] for t in traits(word) if t in self.lexicon), default=0.0)
                if best:
                    odds.append(best)
        if not odds:
            return 0.0, 0.0, 0.0
        return np.log1p(sum(odds)), np.log1p(len(odds)), np.log1p(1000 * len(odds) / len(words))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if not self.curve:
            return np.zeros(len(evidence))
        z = np.clip(evidence @ np.array(self.curve[1:]) + self.curve[0], -30, 30)
        return 1 / (1 + np.exp(-z))

    def scores(self, texts: list[str | None], cache: dict[bytes, list[bytes]]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.probability(np.array([self.evidence(self.words(t, cache)) for t in texts]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, ...]:
    """Newton steps for a small logistic regression with intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, lexicon_words: int = 5_000) -> ToxicityModel:
    """Count the character model over all documents, then learn lexicon and curve from labelled ones.

    Learns from rows whose crc32(doc_id) mod 4 is not 2, about `train_rows` of them at most, chosen by a hash
    of the id. `lexicon_words` bounds the candidate traits, by significance. Without labels of both kinds every score is 0.
    """
    model = ToxicityModel(character_model(docs))
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
              .filter("doc_id is not null and label in (0, 1)").filter(~is_fold("doc_id", 4, 2)))
    chosen = bounded_share(marked.count(), train_rows, F.col("doc_id"))
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                  .filter(chosen).join(marked.filter(chosen), "doc_id").select("text", "label").dropDuplicates(), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SpanCache()
        for batch in batches:
            for part in slices(batch, "text"):
                seen = (Counter(), Counter())
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                    seen[label].update({b"", *(t for w in set(model.words(text, cache)) for t in traits(w))})  # the empty one counts documents
                words = [*seen[0].keys() | seen[1].keys()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.binary()), *(pa.array([s[w] for w in words], pa.int64()) for s in seen)],
                    ["word", "clean", "toxic"])

    counted = (rows.mapInArrow(count, "word binary, clean long, toxic long").groupBy("word")
               .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("toxic >= 3 or length(word) = 0"))
    all_ = F.broadcast(counted.filter("length(word) = 0").select(F.col("clean").alias("all_clean"), F.col("toxic").alias("all_toxic")))
    # 2 * (observed * log ratio) of the toxic cells: how far the word stands out among toxic documents.
    odds = F.log((F.col("toxic") + 0.5) / (F.col("all_toxic") + 1)) - F.log((F.col("clean") + 0.5) / (F.col("all_clean") + 1))
    listed = (counted.filter("length(word) > 0").join(all_).withColumn("odds", odds)
              .filter(F.col("odds") > 1.5).withColumn("weight", F.col("odds") * F.col("toxic"))
              .filter(F.col("weight") > 12).orderBy(F.desc("weight"), "word").limit(lexicon_words).collect())
    candidates = {bytes(r["word"]): r["odds"] for r in listed}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SpanCache()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [sorted({t for w in set(model.words(text, cache)) for t in traits(w) if t in candidates})
                         for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], ["traits"])

    toxic = rows.filter("label = 1").select("text").mapInArrow(look_up, "traits array<binary>").toPandas()["traits"]
    model.learn(explaining(candidates, [{bytes(t) for t in found} for found in toxic]))
    if not model.lexicon:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SpanCache()
        for batch in batches:
            for part in slices(batch, "text"):
                values = [model.evidence(model.words(t, cache)) for t in part.column("text").to_pylist()]
                columns = [pa.array([float(v[k]) for v in values], pa.float64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, part.column("label")], ["a", "b", "c", "label"])

    found = rows.mapInArrow(measure, "a double, b double, c double, label int").toPandas()
    model.curve = logistic(found[["a", "b", "c"]].to_numpy(), found["label"].to_numpy(np.float64))
    return model


def explaining(candidates: dict[bytes, float], toxic: list[set[bytes]], least_share: float = 0.005) -> dict[bytes, float]:
    """The traits that explain toxic documents, strongest first, with their odds.

    A document counts 1 / (1 + k) once k traits explain it: copies of a toxic document share harmless words
    too, and these explain little that is left. A trait that begins with a chosen one adds nothing.
    """
    where: dict[bytes, list[int]] = {}
    for at, found in enumerate(toxic):
        for trait in found:
            where.setdefault(trait, []).append(at)
    share, known, chosen = np.ones(len(toxic)), np.zeros(len(toxic)), {}
    while where:
        best = max(where, key=lambda t: (share[where[t]].sum() * candidates[t], t))
        rows = where.pop(best)
        if share[rows].sum() < max(3, least_share * len(toxic)):
            break
        chosen[best] = candidates[best]
        known[rows] += 1
        share = 1 / (1 + known)
        where = {t: r for t, r in where.items() if not t.startswith(best)}
    return chosen


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row, from its whole text alone; null and empty texts have the score of no evidence."""
    cache = SpanCache()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = model.scores(batch.column("text").to_pylist(), cache)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(narrow, "text", work, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The documents scoring below the threshold, every column unchanged. Rows with null ids or texts are judged like others."""
    cache = SpanCache()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = model.scores(batch.column("text").to_pylist(), cache) < threshold
        return batch.filter(pa.array(kept))

    return map_slices(docs, "text", work, docs.schema)
