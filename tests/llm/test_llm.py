"""Operators for training text against brute force, round trips and held-out passages, and on awkward tables."""

import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from armarium.llm import grouping, leaks, levels, mixing, overlap, scans, spans, subjects, tokens
from armarium.llm.queries import ORACLE, QUERIES
from armarium.llm.texts import folded_words, is_latin, lcs, words

SF = Path("/root/testdata/sf0.001")
LONG = "verbum " * 30_000


def vocabulary(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("bcdlmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(n)]


def text_of(rnd, v, n):
    return " ".join(rnd.choice(v) for _ in range(n))


PIECES = [(0, "<eos>"), (1, "<unk>"), (2, "▁"), (3, "a"), (4, "b"), (5, "ab"), (6, "▁ab"), (7, "abba"), (8, "c")]


def pieces(spark):
    return spark.createDataFrame(PIECES, "token_id int, piece string")


def test_tokens_are_the_longest_pieces(spark):
    cut = tokens.PieceTokenizer({p: i for i, p in PIECES})
    assert cut.encode("abba c") == [6, 4, 3, 2, 8, 0] and cut.encode("") == [0] and cut.encode("x<eos>")[0] == 2
    d = spark.createDataFrame([(1, "abba c", 9), (2, "", 9), (3, None, 9), (None, "a", 9), (1, "abba c", 9), (5, LONG, 9), (6, "a\tb c\n", 9)], "doc_id long, text string, n_tokens int")
    got = {r.key: r.n_tokens for r in tokens.token_counts(d, pieces(spark)).collect()}
    assert got == {1: 6, 2: 1, 5: len(cut.encode(LONG)), 6: len(cut.encode("a\tb c\n"))}
    budget = tokens.token_budget(tokens.token_counts(d, pieces(spark)), d.select(F.col("doc_id").alias("key"), F.lit("s").alias("source")), ["source", "language"])
    assert budget.where("source is null and language is null").first().docs == 4


def test_modern_languages():
    assert is_latin(words("et in terra pax hominibus bonae voluntatis")) and not is_latin(words("et in terra pax de la"))
    assert not is_latin(words("the page of the manuscript was written by a second hand")) and is_latin(words("arma virumque cano troiae qui primus"))
    assert not is_latin([])


def span_truth(rows):
    windows = {}
    for k, t in rows:
        w = (t or "").split()
        for i in range(len(w) - spans.SPAN + 1):
            windows.setdefault(tuple(w[i : i + spans.SPAN]), set()).add(k)
    return {p for ks in windows.values() for p in combinations(sorted(ks), 2)}


def test_shared_spans_equal_brute_force(spark, monkeypatch):
    rnd, v = random.Random(5), vocabulary(60)
    base = [text_of(rnd, v, rnd.randrange(0, 120)) for _ in range(60)]
    for _ in range(50):
        a, b, n = rnd.randrange(60), rnd.randrange(60), rnd.randrange(25, 45)
        w = base[a].split()
        at = rnd.randrange(max(1, len(w) - n + 1))
        base[b] = base[b] + "\n " + "\t".join(w[at : at + n]) + " " + text_of(rnd, v, 3)
    rows = list(enumerate(base)) + [(60, base[7]), (61, base[7]), (62, None), (63, ""), (7, base[7])]
    d = spark.createDataFrame(rows, "key long, text string")
    for hot in (2_000, 2):
        monkeypatch.setattr(spans, "HOT", hot)
        got = {(r.key_a, r.key_b) for r in spans.span_pairs(d).collect()}
        assert got == span_truth(rows) and got
    assert {(r.sample, r.longest) for r in spans.sample_statistics(d, d, "key", "text", "key", "text", block_words=200).collect()} == {(k, len(t.split())) for k, t in rows if t and t.split()}
    shared = {r.key: r.shared for r in spans.shared_words(d).collect()}
    windows = {}
    for k, t in rows:
        w = (t or "").split()
        for i in range(len(w) - spans.SPAN + 1):
            windows.setdefault(tuple(w[i : i + spans.SPAN]), set()).add(k)
    want = {}
    for k, t in dict(rows).items():
        w, marked = (t or "").split(), set()
        for i in range(len(w) - spans.SPAN + 1):
            if len(windows[tuple(w[i : i + spans.SPAN])]) > 1:
                marked |= set(range(i, i + spans.SPAN))
        if marked:
            want[k] = len(marked)
    assert shared == want


def test_a_third_of_all_records_alike(spark, monkeypatch):
    from armarium import runtime

    monkeypatch.setattr(spans.salted_join, "__defaults__", (7,))
    rnd, v = random.Random(25), vocabulary(200)
    same = text_of(rnd, v, 40)
    rows = [(i, same if i % 3 == 0 else text_of(rnd, v, 50)) for i in range(90)]
    d = spark.createDataFrame(rows, "key long, text string")
    assert runtime.salted_join.__defaults__ == (7,)
    assert {(r.key_a, r.key_b) for r in spans.span_pairs(d).collect()} == set(combinations(range(0, 90, 3), 2))


def test_longest_match_of_samples(spark):
    rnd, v = random.Random(6), vocabulary(20)
    docs = [(i, text_of(rnd, v, 80)) for i in range(20)] + [(90, None), (91, "")]
    samples = [(100 + i, text_of(rnd, v, 30)) for i in range(8)] + [(200, " ".join(docs[3][1].split()[10:60])), (201, "zzz qqq"), (202, None)]
    got = {r.sample: r.longest for r in spans.sample_statistics(spark.createDataFrame(docs, "doc_id long, _text string"), spark.createDataFrame(samples, "sample_id long, text string")).collect()}
    for k, t in samples:
        w = (t or "").split()
        best = max((n for n in range(1, len(w) + 1) for i in range(len(w) - n + 1) if any(f" {' '.join(w[i:i+n])} " in f" {x} " for _, x in docs if x)), default=0)
        assert got.get(k, 0) == best


def test_longest_match_of_nested_samples(spark):
    rnd = random.Random(16)
    word = lambda: rnd.choice("abcdefgh")
    docs = [(7, "a b c d e"), (3, "q b c d r"), (5, "s t")] + [(10 + i, " ".join(word() for _ in range(15))) for i in range(6)]
    samples = [(100, "a b c d e"), (101, "b c d x"), (102, "s t"), (103, "t u")] + [(110 + i, " ".join(word() for _ in range(10))) for i in range(8)]
    d, s = spark.createDataFrame(docs, "doc_id long, _text string"), spark.createDataFrame(samples, "sample_id long, text string")
    got = {r.sample: (r.longest, r.doc) for r in spans.sample_statistics(d, s).collect()}
    for k, t in samples:
        w = t.split()
        holds = [(n, -doc) for n in range(1, len(w) + 1) for i in range(len(w) - n + 1) for doc, x in docs if f" {' '.join(w[i:i+n])} " in f" {x} "]
        n, doc = max(holds)
        assert got[k] == (n, -doc)


def test_shared_words_of_texts_in_lines(spark):
    span = [f"w{i}" for i in range(30)]
    rows = [(1, "\n".join(span[:20]) + "\t" + "  ".join(span[20:]) + "\n\nfinis hic\u00a0est\x1cnunc "), (2, " ".join(span)), (3, "unum\nduo")]
    got = {r.key: (r.words, r.shared, round(r.share, 6)) for r in spans.shared_words(spark.createDataFrame(rows, "key long, text string")).collect()}
    assert got == {1: (34, 30, round(30 / 34, 6)), 2: (30, 30, 1.0)}


def altered(rnd, v, text, share):
    w = text.split()
    for i in rnd.sample(range(len(w)), int(len(w) * share)):
        w[i] = rnd.choice(v)
    return " ".join(w)


def test_overlaps_equal_brute_force(spark, monkeypatch):
    rnd, v = random.Random(7), vocabulary(800)
    left = [(i, text_of(rnd, v, rnd.randrange(1, 90))) for i in range(40)] + [(40, None), (41, ""), (42, "unum")]
    right = [(100 + i, text_of(rnd, v, rnd.randrange(20, 90))) for i in range(80)] + [(300, "UNUM."), (301, None)]
    for i in range(30):
        right.append((400 + i, altered(rnd, v, left[i][1], rnd.choice((0, 0.1, 0.2, 0.25, 0.6))).upper().replace("U", "V").replace(" ", rnd.choice((" ", "\n")))))
    right.append(right[-1])
    # texts of few very common words, and one of them extended
    left += [(43, "et in"), (44, " ".join(v[:5]))]
    right += [(700, "ET IN"), (701, " ".join(v[:6])), (702, "in et " + v[0])]
    d = [spark.createDataFrame([(k, t, "Pagina_X.djvu_1.txt") for k, t in rows], "key long, text string, name string") for rows in (left, right)]
    got = {(r.key_l, r.key_r) for r in overlap.overlaps(*d).collect()}
    f = lambda t: folded_words(t or "")
    want = {(a, b) for a, x in left for b, y in right if f(x) and f(y) and lcs(f(x), f(y)) >= overlap.AGREE * max(len(f(x)), len(f(y)))}
    assert got == want and len(want) > 15
    monkeypatch.setattr(overlap.salted_join, "__defaults__", (2,))
    monkeypatch.setattr(overlap, "MOST_BITS", 1 << 6)
    monkeypatch.setattr(overlap, "LEAST_BITS", 1 << 6)
    assert {(r.key_l, r.key_r) for r in overlap.overlaps(*d).collect()} == want
    assert overlap.overlaps(d[0].limit(0), d[1].limit(0)).count() == 0


def test_leaks(spark, monkeypatch):
    rnd, v = random.Random(8), vocabulary(400)
    items = [(i, text_of(rnd, v, n)) for i, n in enumerate((60, 45, 15, 80, 30))] + [(90, None), (91, " .,! ")]
    w = [t.split() for _, t in items[:5]]
    broken = " ".join(w[0][10:20]) + " " + w[0][20][:2] + "-\n" + w[0][20][2:] + " [12] " + " ".join(w[0][21:32])
    docs = [
        (1, text_of(rnd, v, 30) + " " + broken.upper() + " " + text_of(rnd, v, 30)), (2, " ".join(w[1][:10])), (3, "<i>" + " ".join(w[2]).replace("u", "v") + "</i>"),
        (4, altered(rnd, v, " ".join(w[3]), 0.08)), (5, None), (6, ""), (7, text_of(rnd, v, 300)), (3, "<i>" + " ".join(w[2]).replace("u", "v") + "</i>"), (8, LONG), (9, " ".join(w[4][3:22])),
    ]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.key, r.item) for r in leaks.leaks(d, i).collect()} == {(1, 0), (3, 2), (4, 3)}
    monkeypatch.setattr(leaks, "ITEMS", 2)
    assert {(r.key, r.item) for r in leaks.leaks(d, i).collect()} == {(1, 0), (3, 2), (4, 3)}
    assert leaks.leaks(d, i.limit(0)).count() == 0 and leaks.leaks(d.limit(0), i).count() == 0


def test_leaks_whatever_words_are_replaced(spark):
    rnd, v = random.Random(28), vocabulary(300)
    items = [(i, text_of(rnd, v, n)) for i, n in enumerate((12, 19, 20, 33, 45, 60))]
    docs, want = [], set()
    for i, t in items:
        w = t.split()
        # the rarest places in turn: every tenth word, and the first tenth of the words
        for kind in range(12):
            x, r = w[:], int(len(w) * leaks.REPLACED)
            for p in range(kind, len(x), 10) if kind < 10 else range(r):
                if r:
                    x[p], r = f"qq{p}", r - 1
            docs.append((100 * i + kind, text_of(rnd, v, 9) + " " + " ".join(x) + " " + text_of(rnd, v, 9)))
            want.add((100 * i + kind, i))
    # a word of the item cut in two, the second half unknown
    cut = items[0][1].split()
    docs.append((999, " ".join(x[:3] + " " + x[3:] if len(x) > 4 else x for x in cut)))
    want.add((999, 0))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.key, r.item) for r in leaks.leaks(d, i).collect()} == want


def test_components_and_pairs(spark):
    rnd = random.Random(9)
    rows = [tuple(rnd.choice((f" W{rnd.randrange(40)}", None, "unknown", "")) if c == 0 else rnd.choice((f"x{rnd.randrange(60)}", None, "")) for c in range(3)) for _ in range(70)]
    rows += [("w1", "chain0", None)] + [(None, f"chain{i}", f"c{i}") for i in range(9)] + [(None, f"chain{i + 1}", f"c{i}") for i in range(9)] + [("w2", "chain9", None)]
    d = spark.createDataFrame(rows, "work_id string, work_group string, content_sha1 string")
    nodes, near = set(), {}
    for r in rows:
        own = [f"{i}:{x.strip().lower()}" for i, x in enumerate(r) if x and x.strip().lower() not in ("", "unknown")]
        nodes |= set(own)
        for x in own:
            near.setdefault(x, set()).update(own)
    root = {}
    for n in sorted(nodes):
        if n not in root:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in root:
                    root[x] = n
                    stack += near[x]
    edges = grouping.links(d, "work_id", "work_group", "content_sha1")
    for bound in (10**6, 1):
        assert {r.node: r.root for r in grouping.components(edges.repartition(5), merge_links=bound).collect()} == root
    works = sorted(n for n in nodes if n[0] == "0")
    got = {(r.a, r.b) for r in grouping.linked_pairs(d, ("work_id", "work_group", "content_sha1")).collect()}
    assert got == {(a[2:], b[2:]) for a, b in combinations(works, 2) if root[a] == root[b]}
    assert grouping.linked_pairs(d.limit(0), ("work_id", "work_group", "content_sha1")).count() == 0


def test_groups_fill_splits(spark):
    rnd = random.Random(10)
    sizes = spark.createDataFrame([(f"g{i}", rnd.randrange(1, 100)) for i in range(3000)] + [("huge", 20_000), ("none", None)], "root string, size long")
    total = sizes.agg(F.sum("size")).first()[0]
    sums = []
    for largest in (50_000, 100):
        got = grouping.split_groups(sizes, {"train": 0.85, "val": 0.1, "test": 0.05}, largest)
        assert got.count() == 3002 and got.select("root").distinct().count() == 3002
        held = {r.split: r.s for r in got.join(sizes, "root").groupBy("split").agg(F.sum("size").alias("s")).collect()}
        assert all(abs(held[s] / total - share) < 0.001 for s, share in (("train", 0.85), ("val", 0.1), ("test", 0.05)))
        sums.append(held)
    assert sums[0] == sums[1]


def test_raking_meets_marginals_and_caps(spark):
    mass = np.array([10.0, 20, 30, 40])
    cells = np.array([[0, 0, 1, 1], [0, 1, 0, 1], [0, 0, 0, 0]])
    f = mixing.rake(mass, cells, [np.array([60.0, 40]), np.array([45.0, 55]), np.array([100.0])], np.full(4, 9.0))
    assert np.allclose(np.bincount(cells[0], mass * f), [60, 40], atol=0.1) and np.allclose(np.bincount(cells[1], mass * f), [45, 55], atol=0.5)
    docs = [(i, s, "la", "t", 10) for i, s in enumerate(["A b"] * 20 + ["a-B", "a_b "] * 10 + ["c"] * 160 + [None, "", "zz"])]
    d = spark.createDataFrame(docs, "key long, source string, lang string, topic string, n_tokens long")
    t = spark.createDataFrame([("a_b", 0.5, 2), ("c", 0.4, 3), ("gone", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    cap = {r.source: r for r in mixing.capacities(d.select("source", "n_tokens"), t).collect()}
    assert cap["a_b"].own_tokens == 400 and cap["a_b"].all_tokens == 2000 and not cap["a_b"].reachable and cap["c"].reachable and not cap["gone"].reachable
    report = {r.source: r for r in mixing.mixture_report(d, t).collect()}
    assert report["a_b"].most_repeats == 2 and report["a_b"].used_tokens == 800 and report["gone"].used_tokens == 0 and report["c"].used_tokens == 800
    assert {r.source for r in mixing.unreachable(d, t).collect()} == {"a_b", "gone"}
    assert mixing.mixture_report(d.limit(0), t).count() == 3


def test_draws_keep_totals(spark, monkeypatch):
    rnd = random.Random(18)
    docs = [(i, rnd.choice("AB"), rnd.choice(("la", None)), rnd.choice("xyz"), rnd.randrange(1, 40)) for i in range(600)]
    d = spark.createDataFrame(docs, "key long, source string, lang string, topic string, n_tokens long")
    t = spark.createDataFrame([("a", 0.37, 3), ("b", 0.63, 2)], "source string, target_share double, max_repeats int")
    first = {r.source: r for r in mixing.mixture_report(d, t).collect()}
    assert all(abs(r.reached - 1) < 0.005 and r.most_repeats <= r.max_repeats for r in first.values())
    used = {r.key: r.repeats for r in mixing.mixture(d, t).collect()}
    assert len(used) == 600
    monkeypatch.setattr(mixing, "MOST_CELLS", 1)
    assert {r.key: r.repeats for r in mixing.mixture(d, t).collect()} == used


def page(rnd, v, n):
    return [text_of(rnd, v, 7) for _ in range(n)]


def test_pages_are_read(spark):
    rnd, v = random.Random(11), [w for w in vocabulary(300) if len(w) > 5]
    clean = [(i, f"a/Opus_{i}.txt", " ".join(page(rnd, v, 40))) for i in range(30)]
    a, b = v[0], v[1].replace("e", "a") if "e" not in v[1] else v[1]
    odd = next(w for w in v if "e" in w)
    lines = ["4   OPUS MIRUM", *page(rnd, v, 2), f"{text_of(rnd, v, 4)} {a[:3]}-", f"{a[3:]} {text_of(rnd, v, 4)}", f"{text_of(rnd, v, 4)} {v[2][:4]}", "LIB. I. CAP. IV.", f"{v[2][4:]} {text_of(rnd, v, 3)}", f"{odd.replace('e', 'c', 1)} {text_of(rnd, v, 4)} anno 944", "C iij", "[5]"]
    rows = clean + [(100, "a/Pagina_Opus Mirum.djvu_3.txt", "\n".join(lines)), (101, "a/Pagina_X.djvu_1.txt", ""), (102, "a/Pagina_X.djvu_2.txt", None), (103, None, "x"), (104, "Pagina_Y.djvu_1.txt", LONG)]
    d = spark.createDataFrame(rows, "doc_id long, path string, _text string").withColumn("line", F.lit(1))
    got = {(r.key, r.line, r.kind) for r in scans.scan_noise(d).collect()}
    want = {(100, 1, "furniture"), (100, 4, "broken_word"), (100, 6, "broken_word"), (100, 7, "furniture"), (100, 9, "misread"), (100, 10, "furniture"), (100, 11, "furniture")}
    assert {x for x in got if x[0] == 100} == want and not {x for x in got if x[0] in (101, 102, 103, 104)}
    whole = {r.key: r.text for r in scans.scan_noise(d, repaired=True).collect()}
    assert "OPUS" not in whole[100] and a in whole[100] and v[2] in whole[100] and odd in whole[100] and "\n" not in whole[100]
    assert scans.scan_noise(d.limit(0)).count() == 0


def test_misread_words_seen_twice_where_all_are_pages(spark):
    rnd, v = random.Random(15), [w for w in vocabulary(300, 31) if len(w) > 4]
    right, wrong = "fenestram", "fcnestram"
    assert wrong in scans.replaced(right, {"e": [("c", -1.0)]}, 1)
    rows = [(i, "Pagina_Opus.djvu_%d.txt" % i, text_of(rnd, v, 40) + f" {right} " + text_of(rnd, v, 10)) for i in range(40)]
    rows += [(100 + i, "Pagina_Opus.djvu_%d.txt" % i, f"{v[i]} {wrong} {v[i + 2]}") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, path string, _text string")
    got = {(r.key, r.printed, r.repaired) for r in scans.scan_noise(d).where("kind = 'misread'").collect()}
    assert got >= {(100 + i, wrong, right) for i in range(3)} and not [x for x in got if x[1] == right]


def test_glyphs_are_learned_from_all_words(spark):
    rnd = random.Random(41)
    word = lambda n: "".join(rnd.choice("abdeghklmoprstuy") for _ in range(n))
    common, rare = sorted({word(10) for _ in range(20_500)}), sorted({word(4) + "q" + word(4) for _ in range(300)})
    rows = [(i, f"a/Opus_{i}.txt", " ".join(common[i % 40 :: 40] * 3)) for i in range(40)] + [(100, "a/Opus_100.txt", " ".join(rare * 2)), (101, "a/Opus_101.txt", (LONG.replace(" ", "") + " ") * 2)]
    rows += [(1000 + i, f"a/Pagina_Opus.djvu_{i}.txt", f"{common[i]} {w.replace('q', 'x')} {common[i + 1]}") for i, w in enumerate(rare)]
    got = scans.scan_noise(spark.createDataFrame(rows, "doc_id long, path string, _text string")).where("kind = 'misread'").collect()
    assert {(r.key, r.printed, r.repaired) for r in got} == {(1000 + i, w.replace("q", "x"), w) for i, w in enumerate(rare)}


def test_the_lexicon_is_whole_at_any_size(spark, monkeypatch):
    rnd, v = random.Random(42), vocabulary(400, 43)
    parts = [*v, *(w[:3] for w in v), *(w[3:] for w in v if len(w) > 3)]
    spoilt = lambda w: w.replace(*rnd.choice([("e", "c"), ("n", "u"), ("o", "0"), ("i", "1"), ("s", "f"), ("a", "'a")]), 1) + rnd.choice(["", "", "", "-", "."])
    lines = lambda: "\n".join(" ".join(spoilt(rnd.choice(parts)) for _ in range(rnd.choice((0, 1, 1, 1, 4)))) for _ in range(25))
    rows = [(i, f"a/Opus_{i}.txt", text_of(rnd, v, 60)) for i in range(40)] + [(100 + i // 2, "a/Pagina_Opus.djvu_1.txt", lines()) for i in range(60)]
    rows += [rows[-1], (200, "a/Pagina_X.djvu_1.txt", ""), (201, "a/Pagina_X.djvu_2.txt", None), (None, "a/Pagina_X.djvu_3.txt", "x"), (202, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, path string, _text string")
    read = lambda repaired: sorted(map(tuple, scans.scan_noise(d, repaired=repaired).collect()))
    places, texts = read(False), read(True)
    assert {p[2] for p in places} >= {"misread", "broken_word"} and len(texts) == 62
    monkeypatch.setattr(scans, "LEXICON", 100)
    monkeypatch.setattr(scans, "BLOCK", 2_000, raising=False)
    assert read(False) == places and read(True) == texts
    empty = d.where("path is null")
    monkeypatch.setattr(scans, "LEXICON", -1)
    assert scans.scan_noise(empty).count() == 0


def test_subjects(spark):
    rnd = random.Random(12)
    topics = {s: vocabulary(30, seed) for s, seed in (("law", 21), ("medicine", 22), ("war", 23))}
    common = vocabulary(300, 24)
    own = lambda s, n, k: " ".join(rnd.sample([rnd.choice(topics[s]) for _ in range(k)] + [rnd.choice(common) for _ in range(n - k)], n))
    examples = spark.createDataFrame([(i, s, own(s, 100, 35)) for i, s in enumerate([*topics] * 20)] + [(99, None, "x"), (98, "law", None)], "example_id long, subject string, text string")
    terms = spark.createDataFrame([(s, w) for s in topics for w in topics[s][:10]] + [("law", None), (None, "x")], "subject string, term string")
    docs, want = [], set()
    for i in range(400):
        kind = i % 4
        if kind == 3:
            docs.append((i, text_of(rnd, common, 80)))
        else:
            s = [*topics][kind]
            docs.append((i, own(s, 80, 20)))
            want.add((i, s))
    docs += [(1000, own("law", 50, 12) + " " + own("war", 50, 12)), (1001, own("law", 30, 20)), (1002, None), (1003, ""), (0, docs[0][1])]
    want |= {(1000, "law"), (1000, "war")}
    d = spark.createDataFrame(docs, "doc_id long, _text string").withColumn("subject", F.lit("?"))
    got = {(r.key, r.subject) for r in subjects.subjects_of(d, terms, examples).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert subjects.subjects_of(d, terms.limit(0), examples.limit(0)).count() == 0 and subjects.subjects_of(d.limit(0), terms, examples).count() == 0


def test_isotonic_and_awkward_levels(spark):
    steps = levels.isotonic([(0.1, 1), (0.2, 1), (0.9, 2), (0.8, 3), (1.5, 3), (1.6, 3)])
    assert list(steps) == sorted(steps) and 0.2 < steps[0] <= steps[1] < 1.5
    d = spark.createDataFrame([(1, None), (2, ""), (3, "pauca verba"), (4, LONG), (None, LONG)], "doc_id long, text string").withColumn("level", F.lit(9))
    p = spark.createDataFrame([(i, 1 + i % 2, "verbum et res. " * 9 if i % 2 else "quamvis obscurissima interpretatio, " * 9) for i in range(20)] + [(50, None, "x"), (51, 1, None)], "passage_id long, reading_level int, text string")
    assert {r.key for r in levels.reading_levels(d, p).collect()} == {4}
    assert levels.reading_levels(d, p.limit(0)).count() == 0 and levels.reading_levels(d.limit(0), p).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_levels_of_held_out_passages():
    import duckdb

    passages = duckdb.sql(f"select reading_level, text from '{SF}/graded_passages.parquet' where text is not null").df().values.tolist()
    docs = duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").df()["text"]
    n = np.zeros(levels.COUNTERS, np.int64)
    for t in docs:
        for w in folded_words(t):
            n[levels.hash64(w) & (levels.COUNTERS - 1)] += 1
    passages.sort(key=lambda x: levels.hash64(x[1]))
    d = levels.Difficulty(n, passages)
    right = [d.levels[int(np.searchsorted(d.steps[0], x, side="right"))] == g for x, g in d.held[0]]
    assert np.mean(right) > 0.8


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    got = QUERIES[name](spark, str(SF))
    assert len(set(got.columns)) == len(got.columns) and got.count() >= 0
    if name.endswith("_found"):
        assert got.count() == got.distinct().count()


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = QUERIES[name](spark, str(SF)).toPandas(), c.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(tuple(str(v) for v in r) for r in f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
