"""Mixing, deduplication, extraction, decontamination and search against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from shelfspark.llm import ann_scan, decontaminate, html_extract, mixing, near_copies, pfp_dedup, simhash_dedup
from shelfspark.llm.common import staged
from shelfspark.llm.components import _large_star, components
from shelfspark.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1080)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for a, b in edges for x in (a, b) if root(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_of_a_hub_are_split(spark):
    """Adaptive execution finds plain shuffles under the join of a large star, so one hub is no single task."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {key: spark.conf.get(key, None) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        hub = spark.range(1, 200_001, numPartitions=8).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
        star = _large_star(staged(hub, "hub"))
        rows = star.toPandas()
        plan = star._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert len(rows) == 200_000 and (rows["v"] == 0).all()
    assert "skew" in plan.lower()


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("group_rows", [4096, 8])
def test_simhash_components(frame, group_rows):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        rows.append((k, " ".join(text)))
        for j in range(k % 4):
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 + 10 * k + j, " ".join(text)))
    rows += [(5000, None), (5001, ""), (5002, "  "), (None, "w1 w2"), (7, "w1 W2"), (7, "w1 w2"), (5003, "Z " * 30_000)]
    prints = [(d, _fingerprint(t)) for d, t in rows]
    named = [(d, f) for d, f in prints if d is not None]
    label = {f: min(d for d, g in named if g == f) for _, f in named}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    found = simhash_dedup.near_duplicates(frame(rows), group_rows=group_rows).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == Counter(
        (d, f, label[f] if d is not None else None) for d, f in prints)
    kept = simhash_dedup.keep_one(frame(rows)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([None, *set(label.values())])
    assert simhash_dedup.near_duplicates(frame([])).count() == 0


def _near_copies_by_brute_force(rows):
    """Ids kept of (doc_id, text): the smallest of each group linked by a 5-word Jaccard similarity of 0.8 or more."""
    def grams(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = sorted({(d, grams(t)) for d, t in rows if d is not None}, key=lambda x: (x[0], len(x[1])))
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return Counter([d for d, _ in rows if d is None] + [min(sets[k][0] for k in range(len(sets)) if group[k] == g) for g in set(group)])


@pytest.mark.parametrize("sample, rounds", [(4000, 4), (5, 0)])
def test_near_copies_equal_brute_force(monkeypatch, frame, sample, rounds):
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", sample)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    line = rng.choices(words, k=30)
    rows, hub = [], rng.choices(words, k=200)
    for k in range(60):
        text = rng.choices(words, k=rng.randrange(1, 150)) + (line if k % 3 == 0 else [])
        rows.append((k, " ".join(text)))
        for j in range(k % 4):  # copies of copies, from barely changed to below 0.8
            text = list(text)
            for _ in range(rng.randrange(1, 2 + len(text) // 40)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 + 10 * k + j, " ".join(text)))
    for k in range(60):  # a large group around one text
        text = list(hub)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(200)] = rng.choice(words)
        rows.append((3000 + k, " ".join(text)))
    rows += [(5000, None), (5001, ""), (5002, "  "), (None, "w1 w2"), (None, rows[0][1]), (7, "w1 W2"), (7, "other words that it has only once"), (5003, "w1\nw2"),
             (5004, "Z " * 30_000), (5005, "z z z z z"), (6000, "a b c d e f g h"), (6001, "a b c d e f g h i"), (6002, "a b c d e f g h i j k")]
    kept = near_copies.keep_one(frame(rows)).collect()
    expected = _near_copies_by_brute_force(rows)
    assert Counter(r["doc_id"] for r in kept) == expected and len(expected) < 150
    assert {(r["doc_id"], r["text"]) for r in kept} <= set(rows)
    assert near_copies.keep_one(frame([])).count() == 0


@pytest.mark.parametrize("rounds", [1])
def test_near_copies_in_chunks_equal_brute_force(monkeypatch, frame, rounds):
    """Groups dealt in chunks, near the similarity, so that links fail and are searched again."""
    monkeypatch.setattr(near_copies, "GROUP_ROWS", 5)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(2000)]
    rows = []
    for k in range(4):
        hub = rng.choices(words, k=120)
        for j in range(25):
            text = list(hub)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(120)] = rng.choice(words)
            rows.append((100 * k + j, " ".join(text)))
    kept = near_copies.keep_one(frame(rows)).collect()
    assert Counter(r["doc_id"] for r in kept) == _near_copies_by_brute_force(rows)


def test_near_copies_verify_a_forest_not_all_pairs(monkeypatch, frame):
    rng, seen = random.Random(9), []
    words, rows, size = [f"w{k}" for k in range(5000)], [], 7
    for k in range(20):
        hub = rng.choices(words, k=300)
        for j in range(size):
            text = list(hub)
            text[rng.randrange(300)] = "changed"
            rows.append((10 * k + j, " ".join(text)))
    verified = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: (seen.append(pairs.count()), verified(pairs, *a))[1])
    kept = near_copies.keep_one(frame(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [10 * k for k in range(20)]
    assert sum(seen) < 2 * len(rows)  # all pairs: 420


def test_near_copies_begin_with_the_fingerprints_of_the_tries(monkeypatch, frame):
    """Without the exact search, what the tries link and the texts confirm is still dropped, and nothing else."""
    monkeypatch.setattr(near_copies, "linked_rounds", lambda *_: (None, True))
    rng = random.Random(5)
    long = rng.choices([f"w{k}" for k in range(500)], k=2000)
    near = [*long[:1999], "changed"]
    bits = [near_copies.simhash(near_copies.shingle_hashes(" ".join(t), 5)) for t in (long, near)]
    assert (bits[0] ^ bits[1]).bit_count() <= near_copies.BUDGET
    rows = [(2, " ".join(long)), (1, " ".join(near)), (3, " ".join(long[::-1])), (4, "z z z z z z"), (5, "z z z z z")]
    assert sorted(r["doc_id"] for r in near_copies.keep_one(frame(rows)).collect()) == [1, 3, 4]


def test_fingerprint_pairs_link_what_is_near(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(63) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(62), k % 7)) for k, p in enumerate(prints)]
    pairs = near_copies.fingerprint_pairs(spark.createDataFrame(list(enumerate(prints)), "class long, fp long")).collect()
    group = list(range(len(prints)))
    for a, b in pairs:
        group = [group[a] if g == group[b] else g for g in group]
    expected = list(range(len(prints)))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                expected = [expected[j] if g == expected[i] else g for g in expected]
    assert {(group[i] == group[j]) == (expected[i] == expected[j]) for i in range(80) for j in range(80)} == {True}



def test_mix_reaches_targets(frame):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(50), None, rng.choice(["a", "b", "c", "d", None])) for k in range(300)]
    rows += [(5, None, None, "e"), (None, "a b c", None, "a"), (7, "a b", None, "b"), (7, "a b", None, "b"), (9, "x " * 40_000, None, "d")]
    found = mixing.curriculum_mix(frame(rows)).toPandas()
    total = found["size"].sum()
    assert len(found) == len(rows) and (found["taken"] <= 2 * found["size"]).all() and (found["taken"] >= 0).all()
    by = defaultdict(lambda: [0, 0.0])
    for target, size, taken in zip(found["target"], found["source_size"], found["taken"]):
        by[target, size][0] += taken
    assert abs(sum(t for (t, _) in by) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken - int(target)) < 1 and target <= 2 * size + 1e-9 for (target, size), (taken, _) in by.items())
    spots = found.apply(lambda r: all(0 <= p <= 1 for p in r["positions"]), axis=1)
    assert spots.all() and (found[found["taken"] > 0]["positions"].map(len) > 0).all()
    assert mixing.curriculum_mix(frame([])).count() == 0
    assert mixing.curriculum_mix(frame([(1, None, None, "a"), (2, "", None, None)])).filter("taken > 0 or target > 0").count() == 0


def test_inverse_demand_inverts_the_integral(spark):
    from pyspark.sql import functions as F
    for knots in mixing.SCHEDULES:
        shares = np.linspace(0, 1, 21)
        got = spark.createDataFrame([(float(s),) for s in shares], "s double").select(mixing.inverse_demand(knots, F.col("s")).alias("t")).toPandas()["t"]
        grid = np.linspace(0, 1, 200_001)
        weight = np.interp(grid, *zip(*knots))
        area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        assert np.abs(np.interp(got, grid, area / area[-1]) - shares).max() < 1e-4


def test_mix_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    sql = con.sql(ORACLE_SQL["op2_mix_curriculum"]).df().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES["op2_mix_curriculum"](spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[sql.columns] == sql).all().all()


def _without_repeats(rows):
    """What remove_repeats() should return, by brute force."""
    data = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        if d is not None:
            for k in range(len(b) - 49):
                first[b[k:k + 50]] = min(d, first.get(b[k:k + 50], d))
    expected = Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if d is not None else 0):
            if first[b[k:k + 50]] < d:
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        expected[d, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return expected


def _found(kept):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in kept.collect())


def test_repeats_of_texts_longer_than_the_places(frame):
    """4,000 and 9,000 bytes with pieces of 200 and places of 10 bits: a text's places exceed what the bits hold."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = [say(rng.randrange(50, 400)) for _ in range(8)]
    rows = [(1, say(4000)), (2, say(3000) + "".join(shared) + say(4000)), (3, say(700) + shared[7] + say(30) + shared[0]), (4, shared[3]), (5, say(2500) + shared[5])]
    assert _found(pfp_dedup.remove_repeats(frame(rows), piece=200, place_bits=10)) == _without_repeats(rows)
    with pytest.raises(ValueError):
        pfp_dedup.phrases([b"x" * 2000], 50, place_bits=10)


def test_phrases_that_agree_in_32_bits_are_apart(frame):
    """Two texts with one trigger, no common string of 50 bytes, and hashes with equal upper 32 bits."""
    def text(seed):
        rng = random.Random(seed)
        side = lambda: "".join(rng.choice("abcdefgh") for _ in range(26))
        return side() + "oeykaqcfdowzpvsxlgrbaqck" + side()

    for pair in ((162569, 190356), (125684, 195149), (18553, 282816)):
        rows = list(enumerate(map(text, pair)))
        h, p, *_ = pfp_dedup.phrases([t.encode() for _, t in rows], 50)
        assert h[0] == h[1] and p[0] != p[1] and p[0] >> np.uint64(32) == p[1] >> np.uint64(32)
        assert [h.dtype, p.dtype] == [x for _, x in pfp_dedup.FIELDS[:2]]
        assert _found(pfp_dedup.remove_repeats(frame(rows))) == _without_repeats(rows)


@pytest.mark.parametrize("hot", [10_000, 0])
def test_repeats_removed_like_brute_force(frame, hot):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(30)) for _ in range(6))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "short"), (None, pool[0] * 3), (3, rows[5][1]), (3, rows[5][1]), (200, "Te " * 20_000), (201, "Te " * 500)]
    data = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        if d is not None:
            for k in range(len(b) - 49):
                first[b[k:k + 50]] = min(d, first.get(b[k:k + 50], d))
    expected = Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if d is not None else 0):
            if first[b[k:k + 50]] < d:
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        expected[d, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()] += 1
    found = pfp_dedup.remove_repeats(frame(rows), bucket_bytes=4096, hot_entries=hot).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found) == expected
    assert pfp_dedup.remove_repeats(frame([])).count() == 0


def test_long_text_in_pieces(monkeypatch, frame):
    monkeypatch.setattr(pfp_dedup, "PIECE", 64)
    text = "".join(random.Random(6).choice("abcdefgh") for _ in range(500))
    whole = [pfp_dedup.phrases([text.encode()], 50)]
    strings = sum(int(x[4].sum()) + len(x[4]) for x in whole)
    assert strings == 451


FURNITURE_CASES = [
    ("<p>Alpha <span class='ad'>BUY <span>NOW</span> x</span> delta words.</p>", "Alpha delta words."),
    ("<p>a <a class='share' href=x>Share</a> b<p>c <i class=social>unclosed<p>d words", "a b\nc\nd words"),
    ("<p>a <img class='ad' src=x> b</p>", "a b"),
    ("<body><div class='container has-sidebar'><article><p>Real text.</p></article><div class=sidebar>links</div></div>", "Real text."),
    ("<div class='widget'><main><p>Text of main.</p></main><div class='ad-box'>buy</div></div>", "Text of main."),
    ("<div class='layout-sidebar-left'><p>Text in a wrapper.</p></div>", "Text in a wrapper."),
    ("<div class='post with-comments'><p>Some text here, long enough.</p><div class=comments><article class=comment>"
     "a long and nice comment, longer than the text itself</article></div></div>", "Some text here, long enough."),
    ("<div class='cookie-notice'><p>We use cookies on all of our pages.</p></div>", ""),
    ("<p>Text of the page.</p><div class='main-menu'><a href=1>One of many links</a> <a href=2>Two of many links</a></div>", "Text of the page."),
]


@pytest.mark.parametrize("source, text", FURNITURE_CASES)
def test_furniture_by_name(source, text):
    assert html_extract.main_text(source) == text


def test_deep_pages_stay_linear():
    assert html_extract.main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=x>Home</a> <a href=y>More</a></nav>
<!-- <p>old</p> --><div class="ad">Buy now</div><article><h1>A &amp; B</h1><p><b>First   one<br><p>Second &eacute; <a href=z>link</a> here.</p>
<ul><li>One<li>Two</ul></article><aside>Side text that is long enough to be seen by all</aside><div id="comments"><p>I like it a lot, thanks!</p></div><footer>&copy; x</footer>"""


def test_main_text_of_pages(spark):
    assert html_extract.main_text(PAGE) == "A & B\nFirst one\nSecond é link here.\nOne\nTwo"
    odd = ["", None, "plain text only", "<p>a<p>b", "<div><div><div>" * 3000 + "deep", "<!-- open", "<script>x", "a < b and <b>c</b>", "<p class='x>q</p>", "</p></div>x"]
    texts = [html_extract.main_text(h) for h in odd]
    assert texts[:4] == ["", "", "plain text only", "a\nb"] and texts[4] == "deep" and texts[5:7] == ["", ""] and texts[7] == "a < b and c"
    rows = [(k, "u", h) for k, h in enumerate(odd)] + [(None, None, PAGE), (1, "u", PAGE), (1, "u", PAGE)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _windows_by_brute_force(docs, items):
    grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    out = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            want = (item or "").lower().split()
            if not want or not words or (len(want) < 5 and len(words) < len(want)):
                continue
            n = len(want)
            for s in range(max(1, len(words) - n + 1)):
                a, b = grams(words[s:s + n]), grams(want)
                similarity = sum((a & b).values()) / sum((a | b).values())
                if similarity >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), similarity)
    return out


def test_decontamination_equals_brute_force(spark, frame):
    rng = random.Random(7)
    words = [f"v{k}" for k in range(300)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(say(rng.randrange(14, 50)))) for k in range(20)] + [(50, "only three words"), (51, None), (52, ""), (3, "v1 v1 v1 v1 v1 v1 v1 v1")]
    docs = []
    for k in range(80):
        body = say(rng.randrange(200))
        if k % 2:
            leak = items[rng.randrange(20)][1].split()
            if k % 4 == 1:
                leak = leak[2:] if k % 8 == 1 else [*leak[:-1], "other"]
            at = rng.randrange(len(body) + 1)
            body[at:at] = leak * (1 + k % 3)
        docs.append((k, " ".join(body)))
    docs += [(200, None), (201, ""), (202, " ".join(items[0][1].split()[:-1])), (203, "x only THREE words y"), (204, "v1 " * 2000), (None, items[1][1]), (300, "again"), (300, "again")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(frame(docs), bench).collect()
    expected = _windows_by_brute_force(docs, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found} == {k: round(v, 9) for k, v in expected.items()}
    parts = decontaminate.contaminated(frame(docs), bench, item_shingles_at_once=100).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in parts} == set(expected)
    kept = decontaminate.drop_contaminated(frame(docs), bench)
    bad = {d for d, _ in expected}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in docs if d not in bad)
    assert decontaminate.contaminated(frame([]), bench).count() == 0
    assert decontaminate.contaminated(frame(docs), bench.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 32))
    x[::3] = x[0] + 0.05 * rng.normal(size=(500, 32))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0, None] * 16), (5004, [1.0]), (None, rows[0][1]), (6000, rows[100][1]), (6000, rows[100][1])]
    data = ann_scan.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert data.count() == 1502
    x = np.concatenate([x.astype(np.float32).astype(np.float64), x[[100, 100]].astype(np.float32).astype(np.float64)])
    ids = np.array([*range(1500), 6000, 6000])
    found = ann_scan.nearest(data, data.filter("vec_id % 100 = 0"), part_rows=200).toPandas()
    hits = total = 0
    for q in range(0, 1500, 100):
        gap = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((ids, gap)) if ids[j] != q][:10]
        mine = found[found.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine["score"].is_monotonic_increasing
        assert all(abs(s - gap[ids == v][0]) < 1e-12 for s, v in zip(mine["score"], mine["vec_id"]))
        hits += len(set(ids[best]) & set(mine["vec_id"]))
        total += len(set(ids[best]))
    assert hits / total >= 0.9
    blocks = ann_scan.nearest(data, data.filter("vec_id % 100 = 0"), part_rows=200, block_rows=3).toPandas()
    of = [sorted(zip(f["query_id"], f["rank"], f["vec_id"], f["score"].round(9))) for f in (found, blocks)]
    assert [x for x in of[0] if x not in set(of[1])] == [x for x in of[1] if x not in set(of[0])] == []
    few = data.filter("vec_id < 4")
    assert ann_scan.nearest(few, few.filter("vec_id = 0")).count() == 3
    assert ann_scan.nearest(data.limit(0), data).count() == 0


def test_neighbours_of_repeated_query_rows(spark):
    """Equal query rows are one query; rows of one id with other vectors have ranks of their own. All lists are probed here."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.integers(0, 3, 20)]) for k in range(1, 100)]
    rows += [(100, rows[5][1])] * 2 + [(200, rows[7][1]), (200, rows[9][1])] + [(300 + k, rows[5][1]) for k in range(15)]
    data = ann_scan.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = ann_scan.nearest(data, data.filter("vec_id % 100 = 0"), probe_share=1.0, lists=5, epsilon=50.0).collect()
    expected = []
    for own, vector in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(vector)) ** 2).sum())), i) for i, v in rows if i != own)[:10]
        expected += [(own, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert 0 < len(rows) <= before
        docs, before = spark.createDataFrame(rows, docs.schema), len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == before


def test_stages_with_clashing_columns(spark, frame):
    """Columns named like those the operators make for themselves come through unchanged."""
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (3, "quite another text"), (4, "the test item of seven words stands here"), (None, None)]
    extra = ["row_key", "kept_key", "found_key", "class", "sketch", "text_key", "label", "n", "item_id", "start", "root", "prefix"]
    docs = frame(rows).selectExpr("*", *[f"'{name}' AS {name}" for name in extra])
    items = spark.createDataFrame([(9, "test item of seven words stands here", 5)], "item_id long, text string, found_key int")
    for stage, left in ((lambda d: near_copies.keep_one(d), {1, 3, 4, None}), (lambda d: decontaminate.drop_contaminated(d, items), {1, 2, 3, None})):
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert {r["doc_id"] for r in got} == left and len(got) == len(left)
        assert all(r[name] == name for r in got for name in extra)


def test_parity_sketches_never_exceed_the_difference():
    """Also between sketches of unequal length, folded: differing bits are at most the shingles in one set alone."""
    rng = np.random.default_rng(6)
    for n in (1, 5, 31, 32, 33, 200, 1000):
        a = np.unique(rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * 0.85))], rng.integers(-2**63, 2**63 - 1, n // 5, dtype=np.int64)]))
        x, y = (near_copies.parity_sketch(s) for s in (a, b))
        while len(x) != len(y):
            long, short = (x, y) if len(x) > len(y) else (y, x)
            x, y = long[: len(long) // 2] ^ long[len(long) // 2:], short
        bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and bits % 2 == len(np.setxor1d(a, b)) % 2
