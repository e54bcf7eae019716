"""The operators on tables: odd rows, empty tables, clashing columns, and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnloom.llm import language, mixing, neighbours, packing, queries, simhash, token_files
from turnloom.llm.common import shared_dir
from turnloom.llm.language import identify
from turnloom.llm.media import features, store
from turnloom.llm.pii import find_pii, redacted
from turnloom.llm.secrets import find_secrets
from turnloom.llm.simhash import deduplicated, near_duplicates
from turnloom.llm.tokenizing import Encoder, vocabulary
from turnloom.llm.toxicity import choose_features, toxicity, without_toxic
from turnloom.session import table

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # has secrets and personal data
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, _size string, _perm int, hits string, copies long, mix_shard int, label string"
TEXTS = [None, "", "   ", "the cat", "the cat", "word " * 30_000, "x" * 50_000, "a@b.co " * 3, "Ünïcode ＡＢ​ 日本", "the quick brown fox jumps over it"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s1" if i % 2 else None, None, 1, "q", 2, "h", 3, 4, "l") for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[9], (None, "the cat", None, None, None, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, None), (3, 0, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "tokens": lambda d, l: token_files.read_token_files(d.sparkSession, token_files.write_token_files(d, shared_dir(d.sparkSession, "t"), vocabulary())),
    "simhash": lambda d, l: near_duplicates(d),
    "media": lambda d, l: features(store(d)),
    "toxicity": lambda d, l: toxicity(d, l),
    "without_toxic": lambda d, l: without_toxic(d, l),
    "secrets": lambda d, l: find_secrets(d),
    "mix": lambda d, l: mixing.mix(d),
    "pii": lambda d, l: find_pii(d),
    "redacted": lambda d, l: redacted(d),
    "language": lambda d, l: identify(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_all_return(odd, labels, name):
    assert OPERATORS[name](odd, labels).count() == odd.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_packing_of_odd_and_empty_tables(odd):
    assert packing.pack(odd.limit(0), vocabulary()).count() == 0
    p = packing.pack(odd, vocabulary()).toPandas()
    assert (p["length"] > 0).all() and p["length"].max() <= 2048
    assert (p.groupby("sequence_id")["length"].sum() == p.assign(e=p["offset"] + p["length"]).groupby("sequence_id")["e"].max()).all()


def test_clashing_columns_survive(odd):
    m = mixing.mixed(odd, shards=2).toPandas()
    assert set(m["_size"]) == {"q"} and set(m["_perm"]) == {2} and set(m["copies"]) == {3}
    d = deduplicated(odd)
    assert d.columns == odd.columns and set(d.toPandas()["fp"]) == {1}


def test_dedup_keeps_one_row_a_component(odd):
    names = near_duplicates(odd).select("fingerprint", "component_id").distinct()
    kept = deduplicated(odd)
    assert kept.count() == names.count() and kept.where("text = 'the cat'").select("doc_id").collect()[0][0] == 3


def test_token_files_equal_the_library(spark):
    docs = table(spark, SF, "documents")
    rows = sorted(docs.select("doc_id", "text").collect())
    e, base, want = Encoder(vocabulary()), 0, []
    for doc, t in rows:
        ids = np.frombuffer(e._whole([t or ""])[0], e.dtype).astype("<u4")
        ids = np.r_[ids, 0].astype("<u4")
        want.append((doc, base, len(ids), zlib.crc32(ids.tobytes())))
        base += len(ids)
    assert sorted(map(tuple, queries.op1_token_files(spark, SF).collect())) == want


def test_components_by_brute_force(spark):
    rows = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op2_simhash(spark, SF).collect()]
    parent = {d: d for d, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x, _) in enumerate(rows):
        for b, y, _ in rows[:i]:
            if (x ^ y).bit_count() <= 2 and (p := find(a)) != (q := find(b)):
                parent[max(p, q)] = min(p, q)
    assert all(find(d) == c for d, _, c in rows)


def test_mix_by_brute_force(spark):
    r = queries.op7_mixing(spark, SF).toPandas()
    src = {x.doc_id: x.source for x in table(spark, SF, "documents").select("doc_id", "source").collect()}
    r["source"] = r["doc_id"].map(src)
    size = r.groupby("source")["size"].sum().to_dict()
    left, target, names = float(sum(size.values())), {}, sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while names:
        level = left / sum(weight[s] for s in names)
        over = [s for s in names if weight[s] * level > 3 * size[s]]
        if not over:
            target |= {s: weight[s] * level for s in names}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        names = [s for s in names if s not in over]
    got = r.groupby("source")["target"].first().to_dict()
    assert all(got[s] == pytest.approx(target[s]) for s in got)
    assert (r["taken"] <= 3 * r["size"]).all()
    assert abs(r["taken"].sum() / sum(target.values()) - 1) < 0.1
    again = queries.op7_mixing(spark, SF).toPandas()
    assert sorted(zip(r["doc_id"], r["taken"], r["shards"])) == sorted(zip(again["doc_id"], again["taken"], again["shards"]))


def test_splitting_tree_keeps_quotas(spark):
    q = spark.createDataFrame([(1, 37), (2, 27), (3, 0)], "rank int, quota long")
    t = mixing.splitting_tree(q, 3, 1).toPandas()
    assert len(t) == 64 and set(t.groupby("shard").size()) == {8} and t.groupby("rank").size().to_dict() == {1: 37, 2: 27}


def test_neighbours_by_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(16).tolist()) for i in range(600)]
    rows[7] = (7, rows[6][1])
    bad = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [None] * 16), (1400, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = neighbours.nearest(df).collect()
    v = np.array([x for _, x in rows])
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        mine = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == pytest.approx(d[m[1]]) for m in mine)
        hit += len({m[1] for m in mine} & set(want))
    assert hit >= 54 and len(got) == 60
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    r = identify(table(spark, SF, "documents")).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = r.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * n


def _model(train):
    langs = sorted({lang for _, _, lang in train})
    at, words, grams = {x: i for i, x in enumerate(langs)}, {}, {}
    for _, t, lang in train:
        for w in language.words_of(t):
            words.setdefault(w, np.zeros(len(langs), int))[at[lang]] += 1
    for w, c in words.items():
        for g in language.grams_of(w):
            grams[g] = grams.get(g, 0) + c
    totals = lambda c: sum(c.values()).tolist()
    return language.Model(langs, words, totals(words), grams, totals(grams))


def test_language_equals_a_model_of_all_words_and_grams(spark, monkeypatch):
    """Held words and n-grams are few here, so most are looked up in the tables."""
    monkeypatch.setattr(language, "WORDS", 40)
    monkeypatch.setattr(language, "GRAMS", 60)
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, "word " * 9 + "zqxj " + "y" * 3000, None), (-2, "7 !", "en"), (-2, None, "en")], docs.schema))
    rows = docs.collect()
    train = [r for r in rows if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 5]
    m = _model([(r.doc_id, r.text, r.lang) for r in train])
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in identify(docs).collect())
    want = sorted((r.doc_id, *m.predict(r.text)) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)


def test_every_feature_that_passes_is_taken(spark):
    words = [f"{a}{b}{c}" for a in "qxzvk" for b in "abcdefghij" for c in "mnoprstuwy"]
    rows = [(" ".join(words) if i % 2 else "calm talk of rivers", i % 2) for i in range(60)]
    found = choose_features(spark.createDataFrame(rows, "text string, toxic int"), 0.5).features
    assert set(words) <= set(found)


def test_toxicity_of_planted_words(spark):
    rows = [(i, " ".join(["good calm words about rivers"] * 5) + (" you vilezak thing" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    r = toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(x.predicted == x.toxic for x in r) and all(0 <= x.score <= 1 for x in r)


def test_pipeline_stages(spark):
    docs, counts = table(spark, SF, "documents"), []
    columns = docs.columns
    first = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), before.schema)
        counts.append(docs.count())
        assert docs.columns == columns and docs.select("doc_id").join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            assert near_duplicates(docs).select("component_id").distinct().count() == docs.count()
        if name == "personal_data":
            assert docs.count() == before.count() and find_pii(docs).where("n_email + n_card + n_phone > 0").count() == 0
    assert all(r.text == first[r.doc_id] or "[" in r.text for r in docs.collect())
    p = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    tokens = sum(len(x) // 2 + 1 for x in Encoder(vocabulary()).encode([r.text or "" for r in docs.collect()]))
    assert p.agg(F.sum("length")).first()[0] == tokens


def test_mix_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken", "shards"]
    assert sorted(map(tuple, queries.op7_mixing(spark, SF).select(names).collect())) == sorted(con.execute(queries.oracle_sql()["op7_mixing"]).fetchall())


def _digest(found, kinds):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda x: (x[0], kinds.index(x[1])))).encode()).hexdigest()


def test_secrets_of_the_query_by_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, LARGER, "documents").select("doc_id", "text").collect()}
    some = 0
    for r in queries.op6_zstd_novelty_secrets(spark, LARGER).collect():
        t = texts[r.doc_id]
        a = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        k = [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        h = [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (len(a), len(k), len(h), _digest(a + k + h, ("assign", "access", "hex")))
        assert {f"{x}:{s}:{e}" for s, x, e in a + k + h} <= set(r.spans.split(","))
        some += len(a + k + h)
    assert some


def test_personal_data_of_the_query_by_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, LARGER, "documents").select("doc_id", "text").collect()}
    some = 0
    for r in queries.op8_deobfuscated_pii(spark, LARGER).collect():
        t = texts[r.doc_id]
        e = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        i = [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        p = [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        c = []
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(x) for x in m[0] if x.isdigit()]
            if 12 <= len(d) <= 19 and sum(v if j % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for j, v in enumerate(reversed(d))) % 10 == 0:
                c.append((m.start(), "card", m.end()))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (len(e), len(i), len(c), len(p), _digest(e + i + c + p, ("email", "ip", "card", "phone")))
        some += len(e + i + c + p)
    assert some


def test_packing_by_a_naive_rule(spark):
    """The query's rows against the library's ids; the squares rule against one that tries every open bin."""
    e, want = Encoder(vocabulary()), []
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        ids = np.r_[np.frombuffer(e._whole([r.text or ""])[0], e.dtype), 0].astype("<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    p = queries.op3_best_fit_packing(spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(p[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    before = p.groupby("sequence_id")["length"].cumsum() - p["length"]
    assert (before == p["offset"]).all() and p.groupby("sequence_id")["length"].sum().max() <= 2048
    assert p["sequence_id"].nunique() <= 1.05 * -(-p["length"].sum() // 2048)
    r = np.random.default_rng(2)
    lengths, gaps = np.sort(r.integers(1, 20, 120))[::-1], []
    for s in lengths.tolist():
        def squares(g):
            left = [x for x in g if x]
            return sum(left.count(x) ** 2 for x in set(left))
        tries = [(squares(gaps[:i] + [g - s] + gaps[i + 1 :]), g, i) for i, g in enumerate(gaps) if g >= s]
        new = (squares(gaps + [20 - s]), 21, len(gaps))
        best = min([*tries, new])
        gaps = gaps[: best[2]] + [(20 if best == new else best[1]) - s] + gaps[best[2] + 1 :]
    assert sorted(packing.sum_of_squares(lengths, 20)[2].tolist()) == sorted(gaps)


def _linked(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if (p := find(a)) != (q := find(b)):
            parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_near_links_by_brute_force(spark, bucket):
    """Clusters with equal segments, whose candidates are mostly rejected; with small buckets most go the other way."""
    r = np.random.default_rng(9)
    fps = {0, -1}
    for _ in range(6):
        centre = int(r.integers(-(1 << 63), 1 << 63))
        for _ in range(40):
            x = centre
            for bit in r.choice(64, r.integers(0, 6), replace=False) if r.random() < 0.5 else r.choice(32, r.integers(0, 9), replace=False):
                x ^= 1 << int(bit) if bit < 63 else -(1 << 63)
            fps.add(x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    near = [(a, b) for a in fps for b in fps if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    links = [tuple(x) for x in simhash.near_links(df, bucket).collect()]
    assert set(links) <= set(near) and len(links) == len(set(links)) and _linked(links) == _linked(near)
    if bucket == simhash.BUCKET:
        fetched = simhash.lookups(df).join(simhash.segment_tables(df), "key").where("fp <> other").count()
        assert set(links) == set(near) and fetched > 4 * len(near)  # verification rejects most


def test_language_of_many_languages_and_odd_letters(spark, monkeypatch):
    """300 languages of 100 words each, of which workers hold few, against a model in one process; numbers that aren't
    digits are no letters."""
    monkeypatch.setattr(language, "CELLS", 300 * 80)
    letters = "abcdefghijklmnopqrst"
    word = lambda i, j: "".join(letters[(i * 7919 + j * 104729) // 20**k % 20] for k in range(6))
    rows = [(2 * i + k, " ".join(word(i, j) for j in range(k * 40, k * 40 + 60)), f"l{i:03d}") for i in range(300) for k in range(2)]
    rows += [(100_000 + i, t, "l000") for i, t in enumerate(["½", "²", "Ⅷ", "①", "7 ½!"])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[100_000 + i] == ("und", 0.0) for i in range(5))
    want = _model([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5])
    for d, t, _ in rows:
        lang, score = want.predict(t)
        assert got[d][1] == pytest.approx(score, abs=2e-2) and (got[d][0] == lang or score < 0.6)


def test_codes_estimate_inner_products():
    r = np.random.default_rng(4)
    for d in (16, 64, 100):
        q, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (r.standard_normal((30, d)), r.standard_normal((400, d))))
        signs = np.where(v > 0, 1, -1) / np.sqrt(d)
        got = neighbours.Quantised(q).dots(neighbours.packed_words(v > 0))
        assert np.abs(got - q @ signs.T).max() < 6 * neighbours.Quantised(q).step.max()
        factor = np.abs(v).sum(1) / np.sqrt(d)
        err = neighbours.EPS * np.sqrt((1 - factor**2) / (d - 1) + (neighbours.Quantised(q).step ** 2 / 6)[:, None]) / factor
        assert (np.abs(got / factor - q @ v.T) > err).mean() < 0.01


def test_toxicity_is_the_same_with_repeated_ids(spark):
    rows = [(i % 200, ("you vilezak thing " if i % 4 == 0 else "calm words ") + str(i)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    a, b = (sorted(map(tuple, toxicity(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels).collect())) for r, n in ((rows, 2), (rows[::-1], 5)))
    assert a == b


def test_stored_media_has_its_index(spark):
    f = features(store(spark.createDataFrame([(1, "x" * 5000), (2, None)], "doc_id long, text string"))).collect()
    assert all(r.index_ok and r.samples == 1152 * len(r.seek_offsets) and r.rate == 48000 for r in f)


def test_folders_are_shared_and_cleared(spark, tmp_path):
    from turnloom.llm import common

    df = common.written(spark.range(3).toDF("a"), "x")
    assert df.count() == 3 and common.clear(spark) >= 1
    with pytest.raises(Exception):
        df.count()


def test_media_of_the_query_by_plain_digests(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    rows = queries.op4_mpeg_audio(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r.doc_id]
        p = t + b"\xff" * (576 * max(1, -(-len(t) // 576)) - len(t))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_bytes > len(p) and len(r.media_sha256) == 64 and ";bad=0;skipped=0;" in r.feature
