"""Spelling variants, streaming deduplication and source divergence against plain re-computations."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import divergence, spelling, stream_dedup

UPPER_TO_LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER_TO_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(rows):
    words, out = plain_words(rows), {}
    for word, n in words.items():
        near = [w for w in words if one_edit(w, word)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[word] = (form, n, len(near), words[form] if form else None)
    result = set()
    for word, (form, n, many, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        result.add((word, form, root, n, many, form_n))
    return result


def variants(frame, rows, **settings):
    found = spelling.spelling_variants(frame(rows), **settings).collect()
    assert len(found) == len({r["word"] for r in found})
    return {tuple(r) for r in found}


def spelled_rows(seed):
    """Texts of few letters, so that words are close: edits, anagrams, accents, and words of very different frequency."""
    draw = random.Random(seed)
    bases = ["".join(draw.choice("abcäÄß") for _ in range(draw.randint(7, 10))) for _ in range(12)]
    rows = []
    for doc_id in range(60):
        words = []
        for _ in range(40):
            word = draw.choice(bases[:3]) if draw.random() < 0.6 else draw.choice(bases)
            if draw.random() < 0.15:
                at = draw.randrange(len(word))
                word = word[:at] + draw.choice(["", "a", "b", "ab", "é"]) + word[at + 1:]
            words.append(word.replace("a", "A") if draw.random() < 0.1 else word)
        rows.append((doc_id, draw.choice([" ", "-", "_", ". 9"]).join(words)))
    return rows


@pytest.mark.parametrize("seed, settings", [
    (1, {}), (2, {"bands": 4}), (3, {"bands": 6, "block_words": 7}), (4, {"bands": 3, "block_words": 1})])
def test_variants_equal_plain_search(frame, seed, settings):
    rows = spelled_rows(seed)
    expected = plain_variants(rows)
    assert sum(r[1] is not None for r in expected) > 5
    assert variants(frame, rows, **settings) == expected


def test_variants_follow_forms_to_the_last(frame):
    """near of near: 1000 aaaaaaaa, 20 aaaaaaab, 2 aaaaaabb; only neighbours ten times as frequent count."""
    rows = [(None, " ".join(["oooooooo"] * 600 + ["ooooooob"] * 40 + ["oooooobb"] * 3))]
    expected = plain_variants(rows)
    assert {(w, root) for w, _, root, *_ in expected} >= {("oooooobb", "oooooooo"), ("ooooooob", "oooooooo")}
    assert variants(frame, rows) == expected


def test_variants_of_odd_rows(frame):
    """Null and empty texts, null ids, repeated rows, a run of 30,000 letters, extra columns, an empty table."""
    long = "ab" * 15_000
    rows = [(1, None), (2, ""), (None, "Wörtlich wörtlich WÖRTLICH"), (3, "lengthen lengthen"), (3, "lengthen lengthen"), (4, f"{long} {long} {long[1:]} {long[1:]}")]
    assert variants(frame, rows) == plain_variants(rows)
    assert variants(frame, []) == set()
    clash = frame(rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS run", "4 AS h", "5 AS id", "6 AS root", "7 AS names")
    assert {tuple(r) for r in spelling.spelling_variants(clash).collect()} == plain_variants(rows)


def test_edit_checks():
    a, b = np.array([[1, 2, 3], [1, 2, 3], [1, 1, 1]]), np.array([[1, 9, 3], [3, 2, 1], [1, 1, 1]])
    assert spelling.one_replaced(a, b).tolist() == [True, False, False]
    longer = np.array([[1, 2, 2, 3], [9, 1, 2, 3], [1, 1, 1, 1]])
    assert spelling.one_inserted(a, longer).tolist() == [True, True, True]
    assert spelling.one_inserted(a, np.array([[3, 1, 2, 4], [1, 3, 2, 3], [1, 1, 2, 2]])).tolist() == [False, True, False]


# Streaming deduplication

def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for doc_id, text in rows:
        ids = groups[text or ""]
        out[doc_id, max((i for i in ids if i is not None), default=None), len(ids)] += 1
    return out


def written(frame, folder, rows, files=3):
    path = str(folder / "documents.parquet")
    frame(rows).repartition(files).write.mode("append").parquet(path)
    return path


def groups_of(found):
    rows = found.collect()
    per = Counter((r["digest"], r["keep_id"]) for r in rows if r["kept"])
    assert all(n == 1 for n in per.values())
    return Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows), sum(r["kept"] for r in rows)


ODD = [(1, "same"), (2, "same"), (3, "Same"), (4, None), (5, ""), (6, " "), (None, "same"), (None, "alone"), (None, "alone"),
       (7, "x" * 300_000), (8, "x" * 300_000), (9, "x" * 299_999), (10, "twice"), (10, "twice")]


def one_byte(text):
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))


@pytest.mark.parametrize("digest", [stream_dedup.sha256, one_byte, lambda text: F.lit(b"0")])
def test_stream_groups_equal_plain_groups(spark, frame, tmp_path, digest):
    """Also with digests that unequal texts share: their bytes are compared."""
    rows = ODD + [(100 + i, f"text {i % 40}") for i in range(90)]
    path = written(frame, tmp_path, rows)
    found, kept = groups_of(stream_dedup.exact_duplicates(spark, path, digest=digest))
    assert found == plain_groups(rows)
    assert kept == len({t or "" for _, t in rows})


def test_stream_goes_on_from_its_state(spark, frame, tmp_path):
    """Later files meet the digests of earlier calls; a batch is a file here, and no row is counted twice."""
    state = str(tmp_path / "state")
    path = written(frame, tmp_path, ODD)
    stream_dedup.exact_duplicates(spark, path, folder=state, batch_bytes=1).count()
    more = [(50, "same"), (51, "new"), (0, "twice"), (52, "alone")]
    written(frame, tmp_path, more, files=2)
    found, _ = groups_of(stream_dedup.exact_duplicates(spark, path, folder=state, batch_bytes=1))
    assert found == plain_groups(ODD + more)
    again, _ = groups_of(stream_dedup.exact_duplicates(spark, path, folder=state))
    assert again == found


def test_stream_of_clashing_columns_and_empty_table(spark, frame, tmp_path):
    clash = frame(ODD).selectExpr("*", "1 AS digest", "2 AS file", "3 AS n", "4 AS keep", "5 AS at", "6 AS row", "7 AS least")
    path = str(tmp_path / "clash.parquet")
    clash.write.parquet(path)
    assert groups_of(stream_dedup.exact_duplicates(spark, path))[0] == plain_groups(ODD)
    empty = str(tmp_path / "empty.parquet")
    frame([]).write.parquet(empty)
    assert stream_dedup.exact_duplicates(spark, empty).collect() == []


# Source divergence

def plain_divergence(rows, least_docs=3, top=200):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER_TO_LOWER))
        counts[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = set()
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        groups = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}

        def p(count, group):
            return 1 + 1_000_000_000 * (count + 1) // (sum(group.values()) + len(kept))

        def f(a, b):
            return (a - b) * (a - b) // b

        for s, group in groups.items():
            pairs = [(o, sum(f(p(group[t], group), p(g[t], g)) for t in kept)) for o, g in groups.items() if o != s]
            terms = [(t, f(p(group[t], group), p(whole[t], whole))) for t in kept if group[t] and p(group[t], group) > p(whole[t], whole)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


def divergence_rows(seed):
    draw = random.Random(seed)
    words = [w + e for w in "der die das und ist ein Haus été naïve Straße 漢字 ЖУК a b".split() for e in ("", "en", "X")]
    rows = [(k, draw.choice([" ", ", ", "9"]).join(draw.choice(words[:draw.randint(1, len(words))]) for _ in range(draw.randint(0, 60))),
             draw.choice(["de", "fr", None]), draw.choice(["a", "b", "c", "d", None, "é"])) for k in range(150)]
    return rows + [(200, "seldom", "xx", "a"), (201, None, "xx", "b"), (202, "", "yy", None), (None, "der der", "de", "big"), (203, "word " * 40_000, "de", "big")]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_equals_plain_sums(frame, seed):
    rows = divergence_rows(seed)
    found = divergence.divergence(frame(rows)).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == plain_divergence(rows)


def test_divergence_top_ties_and_repeats(frame):
    rows = [(1, "one two three four", "de", "a")] * 3 + [(2, "four five", "de", "b")] * 4
    found = divergence.divergence(frame(rows), top=2)
    assert {tuple(r) for r in found.collect()} == plain_divergence(rows, top=2)


def test_divergence_of_clashing_columns_and_empty_table(frame):
    rows = divergence_rows(5)
    clash = frame(rows).selectExpr("*", "1 AS term", "2 AS n", "3 AS p0", "4 AS total", "5 AS part", "6 AS item", "7 AS docs")
    assert {tuple(r) for r in divergence.divergence(clash).collect()} == plain_divergence(rows)
    assert divergence.divergence(frame([])).collect() == []


@pytest.mark.parametrize("columns, rows_at_once", [(512, 4096), (3, 2), (1, 1000), (7, 5)])
def test_blocks_of_any_size_price_alike(monkeypatch, columns, rows_at_once):
    draw = random.Random(7)
    cells = [("de" if t < 50 else "fr", str(t).encode(), s, n, 10 * n + 7, 7 + s_at) for t in range(70)
             for s_at, s in enumerate("abcde") for n in [draw.randint(0, 4)] if n]
    plain = Counter()
    for x in cells:
        for y in cells:
            if x[:2] == y[:2] and x[2] != y[2]:
                (p, p0), (q, q0) = x[4:], y[4:]
                plain[x[0], x[2], y[2]] += sum(sign * ((a - b) ** 2 // b) for sign, a, b in ((1, p, q), (-1, p, q0), (-1, p0, q), (1, p0, q0)))
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    monkeypatch.setattr(divergence, "ROWS", rows_at_once)
    names = ["lang", "term", "source", "n", "p", "p0"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, c)) for c in cells[k:k + 9]]) for k in range(0, len(cells), 9)]
    found = Counter()
    for batch in divergence._priced_blocks(iter(batches)):
        for row in batch.to_pylist():
            found[row["lang"], row["source"], row["item"]] += int(row["value"])
    assert found == plain


@pytest.mark.parametrize("columns", [512, 7, 1])
def test_one_hot_product_counts_terms(monkeypatch, columns):
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    draw = np.random.default_rng(3)
    cells = sorted({(int(t), int(c)) for t, c in draw.integers(0, 40, (300, 2))})
    term, column = (np.array(x) for x in zip(*cells))
    term = np.unique(term, return_inverse=True)[1]
    plain = Counter((a, b) for t in range(term.max() + 1) for a in column[term == t] for b in column[term == t] if a < b)
    found = {(int(i), int(j)): int(n) for x in divergence.one_hot_product(term, column, 40) for i, j, n in zip(*x)}
    assert found == plain
