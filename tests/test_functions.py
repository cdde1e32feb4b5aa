"""The reference's own assertions on names, texts, weights and schedules, on inline rows."""

import pytest
from pyspark.sql import functions as F

from armarium.functions import text as T
from armarium.functions.weights import parse_pairs, resolve_profile, weight
from armarium.operators import build, corpus, sampling


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())).select(col).first()[0]


def wid(spark, name):
    return one(spark, T.work_id(F.col("n")), n=name)


def test_pages_parts_volumes_and_authors_share_a_work(spark):
    same = [
        ("Pagina_Opus X.djvu_1.txt", "Pagina_Opus X.djvu_22.txt"), ("Summa Theologiae_Quaestio 1.txt", "Summa Theologiae_Quaestio 2.txt"),
        ("Pagina_Patrologia Latina 3.djvu_1.txt", "Pagina_Patrologia Latina 77.djvu_1.txt"), ("Aeneis (Vergilius)_1.txt", "Aeneis_2.txt"),
    ]
    for a, b in same:
        assert wid(spark, a) == wid(spark, b)
    assert wid(spark, "(x).txt") == "(x)"


def test_author_counts_only_where_several_share_a_title(spark):
    rows = [(1, "carmina", "horatius"), (2, "carmina", "venantius"), (3, "aeneis", "vergilius"), (4, "aeneis", None)]
    got = {r.doc_id: r.work_group for r in corpus.work_groups(spark.createDataFrame(rows, "doc_id int, work_id string, author_hint string")).collect()}
    assert got == {1: "carmina (horatius)", 2: "carmina (venantius)", 3: "aeneis", 4: "aeneis"}


def test_editors_are_no_authors(spark):
    for title in ("De civitate Dei (ed. Migne)", "X (PL 32)", "X (1599)", "X (XIV)"):
        assert one(spark, T.author_from_title(F.col("t")), t=title) is None
    assert one(spark, T.author_from_title(F.col("t")), t="Carmina (Horatius)_2") == "horatius"


def test_era_by_author_then_title_then_volume(spark):
    era = lambda a, t: spark.range(1).select(T.era(F.lit(a), F.lit(t))).first()[0]
    assert era("augustinus", "Ab urbe condita") == "late_antique"
    assert era(None, "Opera Rabanus Maurus") == "early_medieval"
    assert era(None, "Summa Theologiae_1") == "high_medieval"
    assert era(None, "Patrologia Latina 3") == "compilation"
    assert era(None, "PL 190") == "early_medieval" and era(None, "PL 217") == "high_medieval" and era(None, "PL 218") == "unknown"
    assert era(None, "Nugae") == "unknown"


def test_cleaner_keeps_spelling(spark):
    got = one(spark, T.clean_text(F.col("t")), t="  vēni ​uidi .b et a.u.c.� x____y [[z\n-----\n\n\n\n\nfinis ")
    assert got == "vēni uidi  et a.u.c. xy z\n\nfinis"
    assert one(spark, T.clean_text(F.col("t")), t="") == ""


def test_verse_and_abstention(spark):
    verse = "\n".join(["arma virumque cano troiae qui primus ab oris"] * 20)
    prose = "\n".join(["x" * 200, "y" * 10, "z" * 150] * 10)
    sig = lambda t, s: spark.range(1).select(T.verse_signal(F.lit(t), F.lit(s))).first()[0]
    assert (sig(verse, False), sig(prose, False), sig(verse, True), sig("una linea", False)) == ("verse", "prose", "unknown", "unknown")


def test_language_and_scan_signals(spark):
    assert one(spark, T.non_latin_per_1k(F.col("t")), t="gallia est omnis divisa") == 0.0
    assert one(spark, T.non_latin_per_1k(F.col("t")), t="the law and the prophets") == 600.0
    clean, dirty = (one(spark, T.ocr_quality(F.col("t")), t=t) for t in ("gallia est omnis", "ga11ia ¤st #mnis"))
    assert clean == 1.0 > dirty and one(spark, T.ocr_quality(F.col("t")), t="") == 0.0


def test_fragments(spark):
    score = lambda t: one(spark, T.fragment_score(F.col("t")), t=t)
    whole = "verbum latinum est hic. " * 60
    assert score(whole) == 0.0 and score("pauca verba") == 1.0 and score("") == 1.0 and 0 < score("verbum " * 130) < 1


def test_orthography(spark):
    o = lambda level: one(spark, T.orthography(F.col("t"), level), t="Vēni uia jam iam Uenit")
    assert o("none") == "Vēni uia jam iam Uenit" and o("conservative") == "Veni uia jam iam Uenit"
    assert o("classical") == "Ueni uia iam iam Uenit" and o("modern") == "Veni via jam jam Venit"
    with pytest.raises(ValueError):
        T.orthography(F.col("t"), "baroque")


def test_trim(spark):
    trim = lambda t: one(spark, T.trim_to_whitespace(F.col("t")), t=t)
    assert trim("a" * 10 + "\n\nb") == "a" * 10 + "\n\n" and trim("una sententia longa est. et") == "una sententia longa est."
    assert trim("sine") == "sine" and trim("") == "" and trim("ab cdefghijklmnop") == "ab "


def weigh(spark, profile, **v):
    d = {"tier": 1, "era": "unknown", "genre": "unknown", "w": "x", "q": 1.0, "nl": 0.0} | v
    return spark.range(1).select(weight(profile, *[F.lit(d[k]) for k in ("tier", "era", "genre", "w", "q", "nl")])).first()[0]


def test_profiles_caps_and_exclusion(spark):
    canon, rest = {"era": "classical", "genre": "poetry", "w": "aeneis"}, {"era": "early_medieval", "genre": "exegesis", "w": "y"}
    assert weigh(spark, resolve_profile("uniform"), **canon) == weigh(spark, resolve_profile("uniform"), **rest) == 1.0
    free = resolve_profile("canonical", max_weight=1e9)
    assert weigh(spark, free, **canon) / weigh(spark, free, **rest) > 20
    assert weigh(spark, resolve_profile("canonical"), **canon) == 10.0
    assert weigh(spark, resolve_profile("uniform"), nl=41.0) == 0.0 and weigh(spark, resolve_profile("manifest"), tier=15) == 15.0
    assert parse_pairs(["a=2", " b = 3"]) == {"a": 2.0, "b": 3.0}
    for bad in (lambda: parse_pairs(["a"]), lambda: resolve_profile("none")):
        with pytest.raises(ValueError):
            bad()


def test_repetition_is_flagged(spark):
    d = spark.createDataFrame([("classical", "poetry", 10.0, 1000), ("unknown", "unknown", 1.0, 100_000)], "era string, genre string, weight double, tokens long")
    assert corpus.mixture_report(d, 1e8).where("high").count() > 0 and corpus.mixture_report(d, 1e5).where("high").count() == 0


def test_sampling_cdf(spark):
    d = spark.createDataFrame([(0, 1.0, 100), (1, 9.0, 100)], "doc_id int, weight double, tokens long")
    assert abs(sampling.sampling_cdf(d, "doc_id").where("doc_id = 0").first().cdf - 0.1) < 1e-9


def test_longest_match_is_exact(spark):
    import random

    rnd = random.Random(4)
    docs = [(i, [rnd.choice("abc") for _ in range(rnd.randrange(0, 60))]) for i in range(12)]
    probes = [(i, [rnd.choice("abc") for _ in range(rnd.randrange(0, 40))]) for i in range(6)]
    probes[0] = (0, docs[3][1][2:30])
    got = {r.probe: r.words for r in sampling.longest_matches(spark.createDataFrame(probes, "probe int, words array<string>"), spark.createDataFrame(docs, "doc int, words array<string>"), 5).collect()}
    for i, p in probes:
        best = max((n for n in range(5, len(p) + 1) for a in range(len(p) - n + 1) for _, d in docs for b in range(len(d) - n + 1) if p[a : a + n] == d[b : b + n]), default=0)
        assert got[i] == best


def test_longest_run_has_no_floor(spark):
    import random

    rnd = random.Random(14)
    docs = [(i, [rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(0, 40))]) for i in range(8)] + [(90, None)]
    probes = [(i, [rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(1, 30))]) for i in range(8)] + [(20, ["z", "a", "z"]), (21, ["z"]), (22, []), (23, docs[1][1][:20])]
    got = {r.probe: r.words for r in sampling.longest_runs(spark.createDataFrame(probes, "probe int, words array<string>"), spark.createDataFrame(docs, "doc int, words array<string>"), 5).collect()}
    want = {i: max((n for n in range(1, len(p) + 1) for a in range(len(p) - n + 1) for _, d in docs if d for b in range(len(d) - n + 1) if p[a : a + n] == d[b : b + n]), default=0) for i, p in probes}
    assert got == want and {0, 1, 2, 3} <= set(want.values()) and max(want.values()) >= 5


def test_merged_groups_are_components(spark):
    import random

    rnd = random.Random(2)
    rows = [(f"g{rnd.randrange(30)}", f"h{rnd.randrange(40)}") for _ in range(45)] + [("lone", None)]
    got = {r.work_group: r.merged for r in corpus.merged_groups(spark.createDataFrame(rows, "work_group string, content_sha1 string")).collect()}
    label = {g: g for g, _ in rows}
    for _ in range(50):
        for g, h in rows:
            if h:
                m = min(label[x] for x, y in rows if y == h)
                for x, y in rows:
                    if y == h:
                        label[x] = min(label[x], m)
    assert got == label


def test_build_keeps_works_in_one_split(spark, tmp_path):
    from armarium.sources import files

    for w in range(12):
        for p in range(4):
            name = f"Pagina_Opus Numerus {w}.djvu_{p}.txt" if w % 2 == 0 else f"Opus Alterum {w}_Liber {p}.txt"
            (tmp_path / name).write_text(" ".join(f"uerbum{w}{p}{i} latinum est" for i in range(120)))
    (tmp_path / "Opus Alterum 1_Liber 0.txt.__dup1__.txt").write_text("copia")
    ledger = build.build(files.text_tree(spark, str(tmp_path)), files.manifest(spark, None), 0.2, 1.0).cache()
    assert ledger.count() == 48 and ledger.select("work_group").distinct().count() == 12
    assert {r.fragment_score for r in ledger.collect()} == {0.3}
    val = {r.work_group for r in ledger.where("split = 'val'").collect()}
    assert val and not val & {r.work_group for r in ledger.where("split = 'train'").collect()}
    assert ledger.where("split = 'val' and weight is not null").count() == 0
    files.write_ledger(ledger, str(tmp_path / "ledger"))
    back = files.ledger(spark, str(tmp_path / "ledger"))
    assert back.count() == 48 and "_text" not in back.columns
    placed = back.withColumn("token_offset", F.when(F.col("split") == "train", F.lit(0).cast("bigint")))
    files.write_ledger(placed, str(tmp_path / "placed"))
    assert files.ledger(spark, str(tmp_path / "placed"), "train").count() == ledger.where("split = 'train'").count()
    with pytest.raises(ValueError):
        files.ledger(spark, str(tmp_path / "placed"), "val")


def test_stream_keeps_groups_together(spark, tmp_path):
    from armarium.streaming.ingest import ingest

    text = " ".join(f"verbum{i} latinum est" for i in range(50))
    rows = [(f"a/Opus {i % 3}_Liber {i}.txt", f"Opus {i % 3}_Liber {i}.txt", text + (str(i) if i < 8 else ""), "2025-01-01 00:00:00") for i in range(10)]
    d = spark.createDataFrame(rows, "path string, name string, raw string, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    q = ingest(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ingested").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("ingested").collect()
    assert len(got) == 9 and all(len({r.split for r in got if r.work_id == w}) == 1 for w in {r.work_id for r in got})


def test_pieces_and_round_trip(spark):
    from armarium.operators import pieces

    listed = [(0, "<eos>"), (1, "<unk>"), (2, "▁"), (3, "a"), (4, "b"), (5, "ab"), (6, "▁ab"), (7, "abba"), (8, "c"), (None, "zz"), (9, None)]
    p = spark.createDataFrame(listed, "token_id int, piece string")
    rows = [(1, "abba c"), (2, ""), (3, None), (None, "a"), (1, "abba c"), (4, "a\tx\nb"), (5, "ab " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, _text string").withColumn("key", F.lit("clash")).withColumn("ids", F.lit(1))
    got = pieces.encode(d, p)
    ids = {r.key: r.ids for r in got.collect()}
    assert ids[1] == [6, 4, 3, 2, 8, 0] and ids[2] == [0] and ids[4] == [2, 3, 2, 1, 2, 4, 0] and set(ids) == {1, 2, 4, 5} and got.count() == 5
    text = {r.key: r.text for r in pieces.decode(got, p).collect()}
    assert text[1] == "abba c" and text[2] == "" and text[4] == "a <unk> b" and text[5] == ("ab " * 20_000).strip()
    assert pieces.encode(d.limit(0), p).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no tokenizer files")
def test_tokenizer_file_round_trip(spark):
    from armarium.operators import pieces

    path, texts = "/opt/tokenizers/byte_bpe_50k.json", ["arma virumque cano", "", "vēni  uidi\n<|endoftext|>", "x" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, _text string")
    got = pieces.encode(d, path=path, eos=50256)
    assert all(r.ids[-1] == 50256 and r.ids.count(50256) == 1 for r in got.collect())
    assert {r.key: r.text for r in pieces.decode(got, path=path, eos=50256).collect()} == dict(enumerate(texts))


def test_windows_cross_records(spark, monkeypatch):
    from armarium.operators import pieces

    monkeypatch.setattr(pieces, "BUCKET", 7)
    import random

    rnd, flat, rows = random.Random(3), {"train": [], "val": []}, []
    for i in range(40):
        s = rnd.choice(("train", "val"))
        ids = [rnd.randrange(50) for _ in range(rnd.randrange(1, 25))]
        rows.append((i, s, ids))
        flat[s] += ids
    e = spark.createDataFrame([(i, ids) for i, _, ids in rows], "key long, ids array<int>")
    tokens = pieces.stream(e, spark.createDataFrame([(i, s) for i, s, _ in rows], "doc_id long, split string"))
    places = [(s, i, i * 3) for s in flat for i in range(len(flat[s]) // 3)]
    got = {(r.split, r.start): r.ids for r in pieces.windows(tokens, spark.createDataFrame(places, "split string, i long, start long"), 10).collect()}
    assert got == {(s, b): flat[s][b : b + 11] for s, _, b in places if b + 11 <= len(flat[s])}


def test_hot_keys_are_split(spark):
    from armarium.runtime import salted_join

    a = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(60)] + [(None, 99)], "k int, x int")
    b = spark.createDataFrame([(7 if i % 2 else i % 4, i) for i in range(50)] + [(None, 99)], "k int, y int")
    want = sorted(map(tuple, a.join(b, "k").select("k", "x", "y").collect()))
    for rows in (5, 1000):
        assert sorted(map(tuple, salted_join(a, b, "k", rows).select("k", "x", "y").collect())) == want


def test_broadcasts_are_measured(spark):
    from armarium.runtime import small

    d = spark.createDataFrame([(i, "x" * 100, [1, 2]) for i in range(10)], "a int, b string, c array<int>")
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(small(d)) and not hinted(small(d, rows=9)) and not hinted(small(d, most=900))


def test_streams_files_and_metadata(spark, tmp_path):
    from armarium.sources import files

    (tmp_path / "a+(b)" / "x" / "a+(b)").mkdir(parents=True)
    (tmp_path / "a+(b)" / "x" / "a+(b)" / "t.txt").write_text("textus")
    assert [r.path for r in files.text_tree(spark, str(tmp_path / "a+(b)")).collect()] == ["x/a+(b)/t.txt"]
    files.write_tokens(spark.createDataFrame([(1, "train", [1, 0]), (2, "val", [0])], "doc_id long, split string, ids array<int>"), f"{tmp_path}/tokens")
    assert files.read_tokens(spark, f"{tmp_path}/tokens", "val").first().ids == [0]
    with pytest.raises(ValueError):
        files.read_tokens(spark, f"{tmp_path}/tokens", "test")
    with pytest.raises(FileNotFoundError):
        files.read_tokens(spark, f"{tmp_path}/none", "val")
    meta = {"special_tokens": {"eos": 5, "pad": 6}, "tokenizer_config": {"file": "t/tok.json"}}
    files.write_meta(spark, f"{tmp_path}/meta.json", meta)
    assert files.read_meta(spark, f"{tmp_path}/meta.json") == meta and files.special_ids(meta)["eos"] == 5 and files.special_ids({}) == {"eos": 0, "pad": 1}
    with pytest.raises(FileNotFoundError):
        files.tokenizer_path(spark, meta, f"{tmp_path}/meta.json", f"{tmp_path}/default")
    (tmp_path / "default").mkdir()
    (tmp_path / "default" / "tokenizer.json").write_text("{}")
    assert files.tokenizer_path(spark, meta, f"{tmp_path}/meta.json", f"{tmp_path}/default").endswith("default/tokenizer.json")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "tok.json").write_text("{}")
    assert files.tokenizer_path(spark, meta, f"{tmp_path}/meta.json", f"{tmp_path}/default").endswith("t/tok.json")
    (tmp_path / "p.txt").write_text("ab\ncd")
    assert [r.prompt for r in files.prompts(spark, ["x", "", f"FILE:{tmp_path}/p.txt"]).orderBy("i").collect()] == ["x", "", "ab\ncd"]
    files.write_report(spark.createDataFrame([(1, "a")], "n int, s string"), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first().s == "a"


def test_reweighting_swaps_the_ledger(spark, tmp_path):
    from armarium.sources import files

    rows = [(1, "train", 15, "classical", "poetry", "aeneis", 1.0, 0.0), (2, "train", 1, "unknown", "unknown", "x", 1.0, 41.0), (3, "val", 5, "unknown", "unknown", "y", 1.0, 0.0)]
    d = spark.createDataFrame(rows, "doc_id long, split string, tier int, era string, genre string, work_id string, ocr_quality double, non_latin_per_1k double")
    path = f"{tmp_path}/ledger"
    files.write_ledger(d, path)
    files.rewrite_ledger(spark, path, lambda x: build.reweighted(x, resolve_profile("manifest")))
    assert {r.doc_id: r.weight for r in files.ledger(spark, path).collect()} == {1: 15.0, 2: 0.0, 3: None}
    assert [p.name for p in tmp_path.iterdir()] == ["ledger"]


def test_positions_must_agree(spark):
    a, b = spark.createDataFrame([(3, "c"), (1, "a")], "k int, v string"), spark.createDataFrame([(9, 0.9), (8, 0.8)], "o int, w double")
    got = corpus.positional_join(a, ["k"], b, ["o"])
    assert sorted((r.r, r.v, r.w) for r in got.collect()) == [(0, "a", 0.8), (1, "c", 0.9)]
    with pytest.raises(ValueError):
        corpus.positional_join(a.limit(1), ["k"], b, ["o"])


def test_ends_penalties_and_dialogues(spark):
    from armarium.operators import logits as L

    one_row = lambda c: spark.range(1).select(c).first()[0]
    ids = lambda *x: F.array(*map(F.lit, x))
    assert one_row(L.stopped(ids(3, 0, 4, 5), 0)) == [3, 0, 0, 0] and one_row(L.stopped(ids(3, 4), 0)) == [3, 4]
    assert sorted(one_row(L.recent(ids(1, 2, 3, 3, 4), 3))) == [3, 4] and one_row(L.recent(F.lit(None).cast("array<int>"))) == []
    turn = lambda g, t: F.struct(F.lit(g).alias("generated"), F.lit(t).cast("string").alias("text"))
    said = L.transcript(F.array(turn(True, "arma virumque cano tro"), turn(False, "iae"), turn(True, " \n "), turn(False, None), turn(False, "qui")), T.trim_to_whitespace)
    assert one_row(said) == "arma virumque cano iae qui"
