"""Cases that earlier bounds left out: any dimension, repeated ids, many vectors, a plain recount of the toxicity scores, the
documents' own identifiers, and the pipeline on odd and empty tables."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.llm import neighbours, secrets, toxicity
from turnloom.llm.common import held_out
from turnloom.session import table

SF = "/root/testdata/sf0.001"


def test_every_dimension_and_repeated_ids(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(6 if i % 4 else 9).tolist()) for i in range(240)]
    rows += [(100, r.standard_normal(6).tolist()), (100, rows[101][1]), (7, rows[9][1]), (700, [1.0, 2.0, 3.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=5).collect()
    lists = Counter()
    for q, (i, v) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for x, (j, w) in enumerate(rows) if x != q and len(w) == len(v))[:5]
            lists[i, tuple(j for _, j in near)] += 1
    mine, at = Counter(), {}
    for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
        at.setdefault(x.query_id, {}).setdefault(x.rank, []).append(x.vec_id)
    assert len(got) == sum(len(k[1]) * n for k, n in lists.items())
    for i, ranks in at.items():
        want = Counter((p + 1, j) for (q, js), n in lists.items() if q == i for _ in range(n) for p, j in enumerate(js))
        mine = Counter((p, j) for p, js in ranks.items() for j in js)
        assert sum((mine & want).values()) >= 0.9 * sum(want.values())
    assert {x.query_id for x in got} == {0, 100, 200}  # nothing else has three dimensions


def test_recall_over_many_vectors(spark):
    r = np.random.default_rng(7)
    n, d = 50_000, 32
    centres = r.standard_normal((200, d))
    v = centres[r.integers(0, 200, n)] + 0.5 * r.standard_normal((n, d))
    frame = pd.DataFrame({"vec_id": np.arange(n), "embedding": v.tolist()})
    df = spark.createDataFrame(frame, "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(df, every=1000).collect()
    hit = 0
    for q in range(0, n, 1000):
        dist = np.sqrt(((v - v[q]) ** 2).sum(1))
        dist[q] = np.inf
        want = set(np.argsort(dist, kind="stable")[:10].tolist())
        hit += len(want & {x.vec_id for x in got if x.query_id == q})
    assert len(got) == 500 and hit >= 450


def test_classifier_equals_dense_newton():
    r = np.random.default_rng(3)
    width, hits, y = 40, [], r.random(300)
    for _ in range(300):
        hits.append(sorted(r.choice(width, r.integers(0, 6), replace=False).tolist()))
    w = toxicity.fit_classifier(hits, y, width)
    x = np.zeros((300, width + 1))
    x[:, -1] = 1
    for i, h in enumerate(hits):
        x[i, h] = 1
    ridge = np.full(width + 1, 0.02)
    ridge[-1] = 1e-3
    want = np.zeros(width + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ want))
        want += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * want)
    assert np.abs(w - want).max() < 1e-6


def test_classifier_of_many_features_stays_small():
    r = np.random.default_rng(4)
    hits = [sorted(set(r.integers(0, 60_000, 30).tolist())) for _ in range(4000)]
    w = toxicity.fit_classifier(hits, (np.arange(4000) % 2).astype(float), 60_000, rounds=4)
    assert len(w) == 60_001 and np.isfinite(w).all()


def test_samples_of_very_many_labels(spark):
    """The share of a label table that large is still a number of hash steps."""
    assert int(0.97 * toxicity.SAMPLE / 1e15 * (1 << 62)) > 0
    docs = table(spark, SF, "documents")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    assert 0 < toxicity.sample_of(docs.select("doc_id", "text"), labels, held_out("doc_id", 3, 1), 40).count() <= 40


def test_op5_equals_a_plain_recount(spark):
    """Hits, moments, posteriors, weights and scores again, from the lexicon that was chosen."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marked = {}
    for r in labels.where(~held_out("doc_id", 3, 1)).where("toxic is not null").collect():
        marked[r.doc_id] = max(marked.get(r.doc_id, 0), r.toxic)
    sample = sorted(i for i in marked if i in texts)
    share = sum(marked[i] for i in sample) / len(sample)
    chosen = toxicity.choose_features(spark.createDataFrame([(texts[i], marked[i]) for i in sample], "text string, toxic int"), share)
    f = len(chosen.features)
    lists = [set(v.split()) for v in toxicity.INSULTS.values()]

    def fires(text):
        named, words = toxicity.features_of(text), set(re.findall(r"[^\W\d_]+", text.lower()))
        out = [i for i, x in enumerate(chosen.features) if x in named]
        out += [f + i for i, s in enumerate(lists) if s & words]
        return out + [f + len(lists) + i for i, p in enumerate(toxicity.PATTERNS) if re.search(p, text)]

    hits = {i: fires(t) for i, t in texts.items()}
    n = min(toxicity.LEXICONS, f)
    vote = lambda h: {x % n if x < f else n + x - f for x in h}
    m = n + chosen.width - f
    pairs = np.zeros((m, m))
    for h in hits.values():
        for a in vote(h):
            for b in vote(h):
                pairs[a, b] += 1
    model = toxicity.fit_label_model(len(texts), np.diag(pairs).copy(), pairs, share)
    votes = np.array([[x in vote(hits[i]) for x in range(m)] for i in sample])
    on, off = np.log(model.fires[1] / model.fires[0]), np.log((1 - model.fires[1]) / (1 - model.fires[0]))
    z = [sum(model.weight[k] * (on[k] if v[k] else off[k]) for k in range(m)) + np.log(share / (1 - share)) for v in votes]
    posterior = 1 / (1 + np.exp(-np.array(z)))
    w = toxicity.fit_classifier([hits[i] for i in sample], posterior, chosen.width)
    assert len(got) == len(texts)
    for i, h in hits.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(sum(w[x] for x in h) + w[-1]))), abs=1e-6)


def test_common_identifiers_are_known(spark):
    name = "qzv_xkwj_wpvq_zzkx_vqwj"
    rows = [(i, f"call {name} now, {name}") for i in range(25)] + [(99, f"the password {name} x1_no and {'a_' * 30}b"), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert secrets.identifiers_of(docs).split() == [name] and secrets.identifiers_of(docs, common=30).split() == []
    alone, common = (secrets.marginal_bits("the password ", name, "", x) for x in ("", secrets.identifiers_of(docs)))
    assert common < 0.5 * alone
    assert secrets.identifiers_of(docs.limit(0)).split() == []


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, hits string, mix_shard int, mix_order string, label string, _copy int"
ODD = [None, "", "   ", "the cat", "the cat", "word " * 20_000, "x" * 40_000, "write to a@b.co or +49 30 1234567", "Ünïcode 日本\x85", "you worthless idiot, you moron", "the quick brown fox jumps over the lazy dog"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    rest = (None, 1, "h", 2, "o", "l", 3)
    rows = [(i, t, "en", None if i % 3 else "s", *rest) for i, t in enumerate(ODD)] + [(3, "the cat", "en", None, *rest), (None, "the cat", None, None, *rest), (None, None, None, None, *rest)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(0, 1, None), (3, 0, 1), (9, 1, 1), (5, 1, 0), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_and_empty_tables(spark, folder, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
            if name != "mixing":
                assert set(out.toPandas()["fp"]) <= {1} and set(out.toPandas()["_copy"]) <= {3}
        n = out.count()
        assert n == 0 if empty else n > 0
        if name == "personal_data" and not empty:
            assert n == docs.count() and out.where("text like '%a@b.co%'").count() == 0
        if name == "near_dedup" and not empty:
            assert out.where("text = 'the cat'").count() == 1


def test_run_on_odd_and_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, folder).toPandas()
    assert len(packed) and packed["length"].max() <= 2048
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_task_a_shard(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    rows = corpus_pipeline.mixed(docs, shards=16).repartitionByRange(16, "mix_shard").select("mix_shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in rows}) >= 15  # by hash they met in 10


def test_many_documents_in_one_shard(spark, tmp_path):
    """All files of a shard are written and read by parts."""
    from turnloom.llm import token_files
    from turnloom.llm.tokenizing import vocabulary

    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    files = token_files.write_token_files(docs, str(tmp_path), vocabulary(), shards=1)
    assert [s.n_docs for s in files.shards] == [300_000] and files.n_ids == 900_000
    r = token_files.read_token_files(spark, files).agg(F.sum("n_tokens"), F.max("start"), F.count_distinct("ids_crc32")).first()
    assert tuple(r) == (900_000, 899_997, 1)


def test_ranges_without_a_memory_map(tmp_path, monkeypatch):
    from turnloom.llm import token_files

    np.arange(10, dtype="<u4").tofile(tmp_path / "s.ids")
    flat = token_files.Flat(str(tmp_path), "s", "ids", "<u4")
    flat.file, flat.mapped = token_files.pafs.LocalFileSystem().open_input_file(str(tmp_path / "s.ids")), None
    assert flat[3:7].tolist() == [3, 4, 5, 6] and flat[9:10].tolist() == [9] and flat[0:0].tolist() == []
