"""Removal of repeated strings by prefix-free parsing.

A string of `length` bytes is removed where it also starts in a document with a smaller id.

Triggers: the rolling hash of every WIDTH-byte window is taken; in each string of `length` bytes the smallest
one (the leftmost on a tie) is its trigger. The trigger depends on the string alone, so equal strings have
equal triggers. Neighbouring strings with one trigger form a phrase, the text from the first one's start to the last one's
end. Phrases overlap so far that every string lies in exactly one phrase with its trigger.

Dictionary: phrases meet by the hash of their trigger, as packed blocks. Equal phrases are one entry; all but
the ones in the smallest document repeat it wholly. They are equal by 64 bits of the phrase's hash within one trigger:
N different phrases of a trigger expect N^2 / 2^65 false matches, 2.4e-7 at three million. Where one trigger has
several phrases, the texts of those entries are fetched, and the suffixes at which strings start are put in order
(a suffix array of the dictionary, to the depth of the string). Equal neighbours are the same string, and the smallest document keeps it. The suffixes
of one trigger are spread by a hash of the string, so a common trigger is no single group.

Phrases carry the text that follows them, so the order of the parse is not needed to compare `length` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

WIDTH = 24
CHUNK = 1 << 19
PIECE = 4 << 20  # longer texts are parsed in pieces, and so many bytes are joined at most
PLACE_BITS = 24  # places in the bytes joined must fit
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
FIELDS = (("h", np.uint64), ("p", np.uint64), ("doc", np.int64), ("twin", np.int64), ("start", np.uint32), ("span", np.uint8))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Hashes:
    """Hash of any substring of some bytes, in constant time each."""

    _up = _powers(BASE, 1 << 16)
    _down = _powers(_INVERSE, 1 << 16)

    def __init__(self, raw: np.ndarray):
        if len(raw) + 1 > len(Hashes._up):
            size = 1 << (len(raw) + 1).bit_length()
            Hashes._up, Hashes._down = _powers(BASE, size), _powers(_INVERSE, size)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._up[:len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self._down[start])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self._down[:n])


def sliding_argmin(values: np.ndarray, width: int, place_bits: int = PLACE_BITS) -> np.ndarray:
    """Place of the smallest of each run of `width` values, the leftmost on a tie of the bits above the place."""
    if len(values) > 1 << place_bits:
        raise ValueError(f"{len(values)} places do not fit {place_bits} bits")
    low = np.uint64((1 << place_bits) - 1)
    key = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        shift = width - size
        key = np.minimum(key[:-shift], key[shift:])
    return (key & low).astype(np.int64)


def phrases(texts: list[bytes], length: int, place_bits: int = PLACE_BITS) -> tuple[np.ndarray, ...]:
    """(h, p, which text, start in it, strings - 1) of every phrase of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    strings = np.maximum(sizes - length + 1, 0)
    total = int(strings.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashes = Hashes(np.frombuffer(b"".join(texts), np.uint8))
    trigger = hashes.windows(WIDTH)
    anchor = sliding_argmin(trigger, length - WIDTH + 1, place_bits)
    which = np.repeat(np.arange(len(texts)), strings)
    at = np.arange(total) + np.repeat(offset[:-1] - (np.cumsum(strings) - strings), strings)
    anchor = anchor[at]
    begins = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])]))
    span = np.diff(np.append(begins, total)) - 1
    first, anchor, which = at[begins], anchor[begins], which[begins]
    p = mixed(hashes.of(first, first + span + length) + (anchor - first).astype(np.uint64) * np.uint64(BASE) + span.astype(np.uint64))
    return trigger[anchor], p, which, first - offset[which], span


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns byte plane by byte plane, compressed: what is regular in them takes little room."""
    planes = [np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T.tobytes()
              for c, (_, t) in zip(columns, FIELDS)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for _, kind in FIELDS:
        size = np.dtype(kind).itemsize
        plane = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).ravel())
        at += n * size
    return out


def pieces_of(texts: list[bytes], length: int, piece: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(which text, place in it, bytes) of the pieces of some texts, in groups of about `piece` bytes.

    Every string of `length` bytes starts in one piece; a piece carries the bytes that its last strings need.
    """
    row, base, data, held = [], [], [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(len(text) - length + 1, 0), piece):
            part = text[a:a + piece + length - 1]
            if held and held + len(part) > piece + length - 1:
                yield row, base, data
                row, base, data, held = [], [], [], 0
            row.append(k)
            base.append(a)
            data.append(part)
            held += len(part)
    if held:
        yield row, base, data


def parse(docs: DataFrame, length: int, buckets: int, piece: int = PIECE, place_bits: int = PLACE_BITS) -> DataFrame:
    """(bucket, n, blob): packed phrases of all texts, dealt by their trigger's hash."""
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush():
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            # Triggers are smallest hashes, so their own upper bits are mostly zero.
            bucket = (mixed(columns[0] + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(columns[0]), np.int64)
            order = np.argsort(bucket, kind="stable")
            found, begins = np.unique(bucket[order], return_index=True)
            columns = [c[order] for c in columns]
            ends = np.append(begins[1:], len(order))
            blobs = [pack([c[a:b] for c in columns]) for a, b in zip(begins, ends)]
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(ends - begins, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "n", "blob"])

        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                ids, twins = part.column("doc_id").to_numpy(), part.column("twin").to_numpy()
                texts = [text.encode() for text in part.column("text").to_pylist()]
                for row, base, pieces in pieces_of(texts, length, piece):
                    h, p, which, start, span = phrases(pieces, length, place_bits)
                    at = np.array(row)[which]
                    held.append([h, p, ids[at], twins[at], start + np.array(base)[which], span])
                    if sum(len(c[0]) for c in held) > 500_000:
                        yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "twin", "text").mapInArrow(run, "bucket long, n long, blob binary")


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The unpacked columns of one bucket after another; rows come sorted by bucket."""
    held, now = [], None
    for batch in batches:
        for bucket, n, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if bucket != now and held:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            now = bucket
            held.append(unpack(blob, n))
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _begins(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a run of equal rows begins."""
    first = np.ones(len(sorted_columns[0]), bool)
    first[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return first


def match_phrases(parsed: DataFrame, hot_entries: int) -> DataFrame:
    """(doc_id, twin, start, span, h, hot): phrases that a smaller document has too, with h null, go whole.

    With the hash of their trigger come entries that differ but share it: in each, the smallest document's
    places. hot marks triggers with more than `hot_entries` of these.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, p, doc, twin, start, span in _collected(batches):
            order = np.lexsort((doc, p, h))
            h, p, doc, twin, start, span = (c[order] for c in (h, p, doc, twin, start, span))
            group, entry = _begins(h), _begins(h, p)
            number, which = np.cumsum(group) - 1, np.cumsum(entry) - 1
            begin = np.flatnonzero(group)
            low, high = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
            again = doc > doc[np.flatnonzero(entry)][which]
            asked = ~again & ((np.add.reduceat(entry.astype(np.int64), begin) > 1) & (low != high))[number]
            hot = (np.add.reduceat(asked.astype(np.int64), begin) > hot_entries)[number]
            for a in range(0, len(h), 500_000):
                keep = np.flatnonzero((again | asked)[a:a + 500_000]) + a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[keep]), pa.array(twin[keep]), pa.array(start[keep].astype(np.int32)), pa.array(span[keep].astype(np.int32)),
                     pa.array(h[keep].view(np.int64), mask=again[keep]), pa.array(hot[keep])],
                    ["doc_id", "twin", "start", "span", "h", "hot"])

    dealt = parsed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc_id long, twin long, start int, span int, h long, hot boolean")


def entry_texts(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, twin, start, bytes): the text of the entries to compare, keyed by trigger.

    Entries of a hot trigger come as single strings, keyed by trigger and string, so that they spread.
    """
    lists = asked.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("h", "start", "span", "hot")).alias("asked"))
    names = ["key", "doc_id", "twin", "start", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                out: list[list] = [[], [], [], [], []]

                def batch_of(out=out):
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

                for doc, twin, text, entries in zip(*(part.column(c).to_pylist() for c in ("doc_id", "twin", "text", "asked"))):
                    data = text.encode()
                    for entry in entries:
                        first, last = entry["start"], entry["start"] + entry["span"]
                        if entry["hot"]:
                            for at in range(first, last + 1):
                                string = data[at:at + length]
                                row = (entry["h"] ^ int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True), doc, twin, at, string)
                                for column, value in zip(out, row):
                                    column.append(value)
                        else:
                            for column, value in zip(out, (entry["h"], doc, twin, first, data[first:last + length])):
                                column.append(value)
                    if len(out[0]) > 200_000:
                        yield batch_of()
                        for column in out:
                            column.clear()
                yield batch_of()

    return (docs.select("doc_id", "twin", "text").join(lists, ["doc_id", "twin"])
            .mapInArrow(cut, "key long, doc_id long, twin long, start int, bytes binary"))


def suffix_ranges(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of removed bytes: suffixes of all entries are sorted behind their key, to `length`
    bytes; of equal ones the smallest document keeps its own."""
    sizes = np.array([len(t) for t in texts]) - length + 1
    raw = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin = np.concatenate([[0], np.cumsum(sizes + length - 1)])[:-1]
    by_doc = np.argsort(docs[row], kind="stable")
    row, inside = row[by_doc], inside[by_doc]
    suffix = np.empty((len(row), 8 + length), np.uint8)
    suffix[:, :8] = keys[row].astype(">i8").view(np.uint8).reshape(-1, 8)
    suffix[:, 8:] = np.lib.stride_tricks.sliding_window_view(raw, length)[begin[row] + inside]
    flat = suffix.view(f"S{8 + length}").ravel()
    order = np.argsort(flat, kind="stable")
    flat, row, inside = flat[order], row[order], inside[order]
    first = _begins(flat)
    least = docs[row][np.flatnonzero(first)][np.cumsum(first) - 1]
    gone = docs[row] > least
    row, inside = row[gone], inside[gone]
    order = np.lexsort((inside, row))
    row, inside = row[order], inside[order]
    if not len(row):
        return row, row, row
    edge = np.ones(len(row), bool)
    edge[1:] = (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1)
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(row)) - 1
    return row[a], starts[row[a]] + inside[a], starts[row[a]] + inside[b] + length


def resolve(entries: DataFrame, length: int) -> DataFrame:
    """(doc_id, twin, a, b): byte ranges of the entries that a smaller document has too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(last: bool):
            rows = pa.Table.from_batches(held)
            keys = rows.column("key").to_numpy()
            cut = len(keys)
            if not last:
                change = np.flatnonzero(keys[1:] != keys[:-1])
                cut = int(change[-1]) + 1 if len(change) else 0
            held[:] = rows.slice(cut).combine_chunks().to_batches() if cut < len(keys) else []
            if not cut:
                return None
            rows = rows.slice(0, cut)
            ids = rows.column("doc_id").to_numpy()
            row, a, b = suffix_ranges(keys[:cut], ids, rows.column("start").to_numpy().astype(np.int64), rows.column("bytes").to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(rows.column("twin").to_numpy()[row]), pa.array(a.astype(np.int32)),
                                               pa.array(b.astype(np.int32))], ["doc_id", "twin", "a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= 20_000 and (out := ready(False)) is not None:
                    yield out
        if held and (out := ready(True)) is not None:
            yield out

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, twin long, a int, b int")


def cut_out(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the ranges, and the number of maximal runs inside them."""
    kept, end, runs = [], 0, 0
    for a, b in sorted(ranges):
        if a > end or not runs:
            kept.append(data[end:a])
            runs += 1
        end = max(end, b)
    return b"".join([*kept, data[end:]]), runs


def repeated_ranges(docs: DataFrame, length: int, bucket_bytes: int, hot_entries: int, piece: int = PIECE, place_bits: int = PLACE_BITS) -> DataFrame:
    """(doc_id, twin, ranges) of documents with repeated strings."""
    total, = docs.agg(F.sum(F.octet_length("text"))).first()
    buckets = 1 << max(0, (-(-(total or 0) // bucket_bytes) - 1).bit_length())
    found = staged(match_phrases(parse(docs, length, buckets, piece, place_bits), hot_entries), "phrase-matches")
    whole = found.filter("h is null").select("doc_id", "twin", F.col("start").alias("a"), (F.col("start") + F.col("span") + length).alias("b"))
    part = resolve(entry_texts(docs, found.filter("h is not null"), length), length)
    return (whole.unionByName(part).groupBy("doc_id", "twin")
            .agg(F.collect_list(F.struct("a", "b")).alias("ranges")))


def remove_repeats(docs: DataFrame, length: int = 50, bucket_bytes: int = 8 << 20, hot_entries: int = 10_000,
                   piece: int = PIECE, place_bits: int = PLACE_BITS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept are the remaining bytes of its whole text.

    Null texts are empty. Rows of one doc_id never remove from each other. Rows with a null doc_id keep their text and
    take part in no match. Texts shorter than `length` bytes stay whole. An empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Ids that several rows share need the text to tell their rows apart; there are few of them or none.
    shared = staged(narrow.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("shared")), "shared-ids")
    rows = (narrow.join(shared, "doc_id", "left")
            .select("doc_id", "text", F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("twin")))
    known = rows.filter("doc_id is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                data = [t.encode() for t in part.column("text").to_pylist()]
                done = [cut_out(d, [(r["a"], r["b"]) for r in ranges or ()]) for d, ranges in zip(data, part.column("ranges").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array([len(d) - len(k) for d, (k, _) in zip(data, done)], pa.int64()),
                     pa.array([n for _, n in done], pa.int64()), pa.array([k for k, _ in done], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    whole = known.join(repeated_ranges(known, length, bucket_bytes, hot_entries, piece, place_bits), ["doc_id", "twin"], "left").mapInArrow(cut, schema)
    none = rows.filter("doc_id is null").withColumn("ranges", F.lit(None).cast("array<struct<a:int,b:int>>")).mapInArrow(cut, schema)
    return whole.unionByName(none)
