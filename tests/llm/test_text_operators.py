"""Toxicity, personal data, quality and language on small fixtures and against brute force."""

import random
import re

import numpy as np
import pytest
from shelfspark.llm import langid, pii, quality_bt, toxicity
from shelfspark.llm.common import slices

CLEAN = "the river runs along the quiet hills and under the old bridge of stone".split()


def _labelled(frame, spark, n=160):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(CLEAN) for _ in range(40)]
        if k % 4 == 0:
            for bad in ("wretch", "fiend", "wretched"):
                words[rng.randrange(40)] = bad
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, 1, int(k % 4 == 0)))
    return frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_restores_and_separates(spark, frame):
    docs, labels = _labelled(frame, spark)
    model = toxicity.fit(docs, labels)
    assert any(t.startswith(b"wretc") or t.startswith(b"wret") for t in model.lexicon)
    hard = frame([(1000, "the quiet wr3tch and the f1end of stone"), (1001, "the quiet w r e t c h under the fieeeend bridge"),
                  (1002, "the river runs quiet"), (1003, None), (1004, ""), (1002, "the river runs quiet"), (None, "the old fiend wretch"),
                  (1005, "x" * 200_000), (1006, "1" * 100_000)])
    scores = [(r["doc_id"], r["score"]) for r in toxicity.score(hard, model).collect()]
    by = dict(scores)
    assert by[1000] >= 0.3 and by[1001] >= 0.3 and by[None] >= 0.3
    assert all(by[k] < 0.3 for k in (1002, 1003, 1004, 1005, 1006)) and len(scores) == 9
    kept = toxicity.drop_toxic(hard, model)
    assert kept.columns == hard.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1002, 1002, 1003, 1004, 1005, 1006]


def test_toxicity_of_spaced_and_doubled_words(spark, frame):
    """Runs beside single letters of other words, with leet characters or wide separators, and doubled letters."""
    docs, labels = _labelled(frame, spark)
    model = toxicity.fit(docs, labels)
    hidden = ["o l d w r e t c h", "w r e t c h t h e", "t h e f i e n d o f", "w r 3 t c h", "f 1 e n d", "f 1 3 n d", "w  r  e  t  c  h",
              "w. r. e. t. c. h.", "f - i - e - n - d", "o l d   f 1 e n d", "wwrreettcchh", "ffiieenndd", "wrettch", "f i i e e n d"]
    missed = [h for h in hidden if not {b"wretch", b"fiend"} & set(model.words(f"runs along {h} under quiet hills", {}))]
    assert not missed
    rows = [(k, f"the river runs along {h} under {h} quiet hills") for k, h in enumerate(hidden)]
    rows += [(100, "t h e r i v e r r u n s"), (101, "1 2 3 4 5 6 7 8 9 0"), (102, "the hills, a b c d e f g"), (103, "o l d b r i d g e o f s t o n e"), (104, "q 1 " * 20_000)]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(frame(rows), model).collect()}
    assert [k for k, v in sorted(scores.items()) if v >= 0.3] == list(range(len(hidden)))


def test_toxicity_without_labels_or_rows(spark, frame):
    docs, labels = _labelled(frame, spark, 8)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("score > 0").count() == 0
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_span_cache_is_bounded_by_bytes():
    cache, rng = toxicity.SpanCache(10_000), random.Random(2)
    for k in range(3000):
        cache[b"%d" % k * rng.randrange(1, 200)] = [b"word"] * rng.randrange(5)
        held = sum(256 + len(span) + sum(64 + len(word) for word in words) for span, words in cache.items())
        assert held == cache.size <= 10_000
    cache[b"x" * 20_000] = []  # larger than the bound alone: not kept
    assert b"x" * 20_000 not in cache


def test_pieces_cover_a_span_and_hold_short_words_whole():
    for n in (0, 1, toxicity.PIECE, toxicity.PIECE + 1, 3 * toxicity.PIECE - 2 * toxicity.OVERLAP, 100_003):
        cut = toxicity.pieces(7, 7 + n)
        assert cut[0][0] == 7 and cut[-1][1] == 7 + n and all(0 <= b - a <= toxicity.PIECE for a, b in cut)
        assert all(0 < a - c <= toxicity.PIECE - toxicity.OVERLAP and d - a >= toxicity.OVERLAP for (c, d), (a, _) in zip(cut, cut[1:]))
    model = toxicity.ToxicityModel(np.zeros((toxicity.SYMBOLS,) * 4, np.float32))
    plain = model.words("stone-" * 1500, {})
    for at in range(toxicity.PIECE - 70, toxicity.PIECE + 10, 3):  # a disguised word in a text without blanks, at and around a cut
        text = ("stone-" * 1500)[:at] + "-wr3tch-" + ("stone-" * 1500)[at:]
        assert any(b"tch" in word for word in model.words(text, {}) if word not in plain), at


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    logp = np.log(rng.dirichlet(np.ones(28), (28, 28, 28))).astype(np.float32)

    def brute(span):
        best = (-1e300, "")

        def walk(at, state, score, word, previous):
            nonlocal best
            if at == len(span):
                best = max(best, (score + float(logp[(*state, 0)]), word))
                return
            char = span[at]
            own = ord(char) - 96 if char.isalpha() else 0
            moves = [(char, own, 0.0)] if own else [(x, ord(x) - 96, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(char, "")]
            drop = (toxicity.STUTTER if char == previous else None) if own else (
                (toxicity.NOISE if char != previous else toxicity.STUTTER) if char in toxicity.LEET else toxicity.PADDING)
            if drop is not None:
                walk(at + 1, state, score - drop, word, char)
            for letter, symbol, cost in moves:
                walk(at + 1, (state[1], state[2], symbol), score - cost + float(logp[(*state, symbol)]), word + letter, char)

        walk(0, (0, 0, 0), 0.0, "", "")
        return best[1]

    for span in ("1d10t", "a$$", "l0000l", "s.c.u.m", "b@@d1", "|||x"):
        assert toxicity.restore(span, logp) == brute(span)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                  "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_patterns_equal_plain_regexes():
    rng = random.Random(3)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111-1111 1111", "4111111111111111", "+1 (212) 555-0199", "+", " ", "é", "\n", "..", "-", "99", "0001.2.3.004"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == _plain(text), text


def test_crf_decodes_the_best_path_and_redacts(spark, frame):
    crf = pii.train()
    text = "mail a.b@c.example.com, call +1 (212) 555-0199 or pay 1234567812345678 in 2019"
    ids = pii.shape_ids(pii.shape_parts(pii._codes(text))[2])
    n = len(ids)
    first, last = np.eye(n, dtype=bool)[0], np.eye(n, dtype=bool)[-1]
    e = crf.emissions(ids, first, last)
    best = e[0].copy()
    back = []
    for t in range(1, n):
        step = best[:, None] + crf.pairs
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + e[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert crf.decode(ids, np.zeros(n, int)).tolist() == path[::-1]
    docs = frame([(1, text), (2, None), (3, ""), (4, "no data here, 12 of 45"), (4, "no data here, 12 of 45"), (None, "x " * 50_000 + "a@b.cd")])
    rows = {r["doc_id"]: r["text"] for r in pii.redact(docs, crf).collect()}
    assert rows[1] == "mail [EMAIL], call [PHONE] or pay [CARD] in 2019"
    assert rows[2] is None and rows[3] == "" and rows[4] == "no data here, 12 of 45" and rows[None].endswith("x [EMAIL]")
    assert pii.redact(docs.limit(0), crf).count() == 0


def test_quality_ranks_and_handles_edges(spark, frame):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(200):
        words = [rng.choice(CLEAN) for _ in range(60)]
        if k % 3 == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words] if k % 2 else [words[0]] * 60
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 != 0), 0))
    docs = frame(rows)
    model = quality_bt.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r["score"] for r in quality_bt.score(docs, model).collect()}
    assert np.mean([(found[k] >= 0.5) == (k % 3 != 0) for k in range(200)]) > 0.97
    edge = frame([(1, None), (2, ""), (3, " \n\t"), (None, "a"), (5, "word " * 100_000), (5, "word " * 100_000)])
    scores = quality_bt.score(edge, model).collect()
    assert len(scores) == 6 and all(0 <= r["score"] <= 1 for r in scores)
    nothing = quality_bt.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality_bt.score(docs, nothing).filter("score <> 0.5").count() == 0


def test_language_by_centroids(spark, frame):
    rng = random.Random(5)
    tongues = {"xx": "kalo mira tesu nova reko".split(), "yy": "schwung pfad krach zwist drang".split()}
    rows = [(k, " ".join(rng.choice(tongues[lang]) for _ in range(30)), lang) for k in range(120) for lang in [("xx", "yy")[k % 2]]]
    docs = frame(rows + [(500, None, "xx"), (501, "123 ... !", "yy"), (502, "", None), (None, "kalo mira", None)])
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs, per_language=20)).collect()}
    assert all(found[k]["lang_pred"] == ("xx", "yy")[k % 2] for k in range(120))
    assert [found[k]["lang_pred"] for k in (500, 501, 502)] == ["und"] * 3 and found[None]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[501]["rejected"]
    empty = docs.limit(0)
    assert langid.identify(docs, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("limit,rows", [(1, 100), (50, 2), (10_000, 65_536)])
def test_slices_cover_all_rows(limit, rows):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": ["a" * k if k % 7 else None for k in range(40)], "k": list(range(40))})
    parts = list(slices(batch, "text", limit, rows))
    assert [x for p in parts for x in p.column("k").to_pylist()] == list(range(40)) and all(p.num_rows for p in parts)


def test_personal_data_takes_bounded_slices():
    """A full slice of text is searched in a few times its size of memory, far below what 8 MB of text at once took."""
    import tracemalloc
    crf = pii.train()
    text = "write to a.b@c.example or call +49 30 555 0134, room 12 of 45 " * 16
    texts = [text] * (pii.SLICE_BYTES // len(text))
    tracemalloc.start()
    pii.all_spans(texts, crf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
