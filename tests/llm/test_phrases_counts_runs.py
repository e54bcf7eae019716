"""Phrases, prefix counts and runs: against plain definitions, on odd rows, and on empty tables."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.llm import phrases, prefix_counts, queries, runs, words
from turnloom.llm.tokenizing import vocabulary
from turnloom.session import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, f long, block long, code long, word string, start long, width int, h long, a int, w string"
REST = (7, 7, 7, 7, "w", 7, 7, 7, 7, "w")
TEXTS = [None, "", "   ", "The cat sat", "the Cat sat", "word " * 30_000, "x" * 50_000, "a b c. a b, c\va b" * 40, "Ünïcode ＡＢ\x85 日本", "<|endoftext|> a  <|endoftext|>", "ab  \n c " * 20]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, *REST) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[7], (None, "the cat", "und", *REST), (None, None, None, *REST)], SCHEMA)


# --- phrases ---


def plain_phrases(rows, most=3, least=10, taken=50, first=2000):
    """(lang, rank, phrase, a, l, r, n, score), straight from the definition."""
    f = Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^ \t]+", piece)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", *w[i : i + k]] += 1
    out = []
    for lang in {x[0] for x in f}:
        n = sum(c for x, c in f.items() if x[0] == lang and len(x) == 2)
        found = {x[1:]: c for x, c in f.items() if x[0] == lang and len(x) > 2 and c >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= taken * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cuts = [(1000000 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[lang, *p[:k]], f[lang, *p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_op11_equals_its_sql(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = sorted(con.execute(queries.oracle_sql()["op11_collocations"]).fetchall())
    assert collected(queries.queries()["op11_collocations"](spark, SF)) == want
    rows = [(r.lang, r.text) for r in table(spark, SF, "documents").collect()]
    assert want == plain_phrases(rows)


@pytest.mark.parametrize("most, least, taken, first, block", [(2, 2, 50, 100, 1 << 20), (4, 2, 50, 7, 3000), (3, 3, 101, 1000, 500), (5, 4, 90, 30, 1 << 24)])
def test_phrases_of_any_length_over_many_blocks(spark, most, least, taken, first, block):
    r = random.Random(most)
    rows = [(i, r.choice(["xx", "yy", None]), "".join(r.choice(["a ", "b ", "c ", "A", "d e ", ". ", "\n", "\t", "é "]) for _ in range(60))) for i in range(60)]
    rows += [(99, "xx", None), (99, "xx", ""), (5, "yy", "d e d e d e " * 50)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    got = collected(phrases.collocations(d, most=most, least=least, taken=taken, first=first, block=block))
    assert got == plain_phrases([(x[1], x[2]) for x in rows], most, least, taken, first)


def test_phrases_of_odd_rows(odd):
    got = collected(phrases.collocations(odd, least=2))
    assert got == plain_phrases([(r.lang, r.text) for r in odd.collect()], least=2)


def test_scores_past_64_bits(spark):
    big = 3 * 10**12
    rows = [(1, ["a", "b"], [big, big], [big + 1, big], big)]
    s = phrases._scored(spark.createDataFrame(rows, "id long, words array<string>, heads array<long>, tails array<long>, f long").withColumn("lang", F.lit("x")), 2).first()
    assert s.score == 1000000 * big * big // (big * (big + 1)) == 999999


def test_a_rewritten_block_is_whole(tmp_path):
    codes, positions = np.array([0, 0, 2]), np.array([4, 9, 2])
    for _ in range(2):
        phrases._store(str(tmp_path), "1-5", codes, positions)
    assert os.listdir(tmp_path) == ["1-5"]
    c, p = phrases._load(str(tmp_path), "1-5")
    assert c.tolist() == [0, 0, 2] and p.tolist() == [4, 9, 2]


# --- prefix counts ---


@pytest.fixture(scope="module")
def counter():
    return prefix_counts.counter(vocabulary())


PARTS = ["a", "it's", "'s", "'rest", "'", "''", "'LL", "'ll", "'re", " ", "  ", "   ", "\n", "\n\n", "\t", "é", "Ÿ", "12", "7", "!", "…", "€", "ab.c", "漢", "½", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|end", "|>", "ing", " the", "😀", "--------"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), max_size=4))
def test_every_prefix_has_the_library_count(counter, texts):
    for t, got in zip(texts, counter.counts(pa.array(texts, pa.string()))):
        assert got.tolist() == [len(counter.tok.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)]


def test_long_prefixes(counter):
    for t in ("x" * 30_000, " " * 30_000, "é" * 10_000, "漢" * 10_000, "ab  " * 10_000):
        got = counter.counts(pa.array([t]))[0]
        for k in (1, 2, 999, 5000, len(t) - 1, len(t)):
            assert got[k - 1] == len(counter.tok.encode(t[:k], add_special_tokens=False).ids)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        prefix_counts.PrefixCounter(vocabulary("word_bpe_49k.json"))


def plain_budget(tok, text, limit):
    n = [len(tok.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    return n[-1], max(k for k, x in enumerate(n) if x <= limit)


def test_budgets_of_odd_rows(spark, odd, counter):
    small = odd.where("text is null or length(text) < 2000")
    got = prefix_counts.budgets(prefix_counts.prefix_table(small, vocabulary()), 3).collect()
    assert len(got) == small.count()
    of = {(r.doc_id, len((r.text or "").encode())): r.text or "" for r in small.collect()}
    for r in got:
        n, kept = plain_budget(counter.tok, of[r.doc_id, r.n_bytes], 3)
        assert (r.n_tokens, r.over_limit, r.kept_chars) == (n, n > 3, kept)
    assert prefix_counts.budgets(prefix_counts.prefix_table(odd.limit(0), vocabulary())).count() == 0
    assert prefix_counts.prefix_table(odd, vocabulary()).count() == odd.count()


def test_steps_wider_than_a_byte():
    c = np.array([1, 300, 2], np.int64)
    s = np.diff(c, prepend=0)
    assert prefix_counts.counts_of(s.astype("<i4").tobytes(), 4).tolist() == c.tolist()


def test_op12_equals_the_library(spark, counter):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = queries.queries()["op12_prefix_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        n = len(counter.tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
        assert len(counter.tok.encode(t[: r.kept_chars], add_special_tokens=False).ids) <= 512


# --- runs ---


def plain_runs(w, least=12):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        k = 0
        while k + p < n:
            if w[k] != w[k + p]:
                k += 1
                continue
            s = k
            while k + p < n and w[k] == w[k + p]:
                k += 1
            if k - s + p >= max(least, 2 * p) and not any(w[s + q : k + p] == w[s : k + p - q] for q in range(1, p)):
                out.append((s, k - s + p, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 12), st.integers(0, 60))
def test_runs_equal_all_comparisons(w, period, more):
    w = w + [w[len(w) - 1 - (i % min(period, len(w)))] for i in range(more)] if w else w
    assert runs.runs_of(w, 2) == plain_runs(w, 2)


def test_next_smaller_suffixes():
    r = random.Random(5)
    for _ in range(300):
        w = [r.randrange(r.choice([1, 2, 4])) for _ in range(r.randrange(25))]
        after, shared = runs.next_smaller(w)
        for i in range(len(w)):
            j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            both = next((k for k in range(len(w)) if j + k >= len(w) or w[i + k] != w[j + k]), 0)
            assert after[i] == j and (j == len(w) or shared[i] == both)


def test_no_run_is_cut():
    r = random.Random(9)
    for _ in range(200):
        w = [r.randrange(40) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            block = [r.randrange(40) for _ in range(r.randrange(1, 9))]
            at = r.randrange(len(w) + 1)
            w[at:at] = (block * 9)[: r.randrange(12, 40)]
        got = [(int(at[0]) + s, m, p) for at in runs.stretches(np.array(w, np.int64), np.zeros(len(w), np.int64)) for s, m, p in runs.runs_of([w[i] for i in at])]
        assert sorted(got, key=lambda x: (x[0], x[2])) == plain_runs(w)


def plain_row(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = plain_runs(w)
    s, m, p = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    gone = {i for a, b, c in found for i in range(a + c, a + b)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(found), s, m, p, 1000 * m // p if found else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return " ".join(w)


def test_op13_equals_plain_runs(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = queries.queries()["op13_lyndon_runs"](spark, SF).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        assert tuple(r)[1:] == plain_row(planted(r.doc_id, docs[r.doc_id]))


def test_runs_of_odd_rows(odd):
    small = odd.where("text is null or length(text) < 3000")
    want = sorted((r.doc_id or -1, plain_row(r.text or "")) for r in small.collect())
    got = [(r.doc_id or -1, tuple(r)[1:]) for r in runs.periodic_runs(small).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert runs.periodic_runs(odd).count() == odd.count() and runs.periodic_runs(odd.limit(0)).count() == 0
    long = runs.periodic_runs(odd).where("doc_id = 5").first()
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 30_000, 1)
    assert {r.doc_id: r.text for r in runs.with_planted_period(odd).where("doc_id is not null").collect()}.keys() == set(range(len(TEXTS)))


def test_runs_take_near_linear_time():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for w in ([0] * 50_000, [0, 1] * 25_000, list(range(500)) * 100):
        assert len(runs.runs_of(w)) == 1
    assert len(runs.runs_of(fibonacci[-1], 2)) < len(fibonacci[-1])


# --- words ---


def test_slices_of_columns(counter):
    r = random.Random(2)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(6))) for _ in range(60)]
    batch = pa.record_batch([pa.array(range(60)), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(words.groups([batch, batch.slice(0, 0)], size=40))
    assert [x for b in parts for x in b.column(1).to_pylist()] == texts and len(parts) > 5
    assert [x for b in parts for x in words.split(b.column(1)).words.to_pylist()] == words.split(batch.column(1)).words.to_pylist()
    assert [c.tolist() for b in parts for c in counter.counts(b.column(1))] == [c.tolist() for c in counter.counts(batch.column(1))]
    assert words.split(batch.column(1).slice(3, 0)).words.to_pylist() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBé .\t\n,\x0b日", max_size=12), max_size=5))
def test_words(texts):
    w = words.split(pa.array(texts, pa.string()), b" \t", b".,\n\x0b", lower=True)
    want = [(i, p, x.replace("B", "b")) for i, t in enumerate(texts) for p, piece in enumerate(re.split("[.,\n\x0b]", t)) for x in re.findall("[^ \t]+", piece)]
    assert w.words.to_pylist() == [x for _, _, x in want] and w.text.tolist() == [i for i, _, _ in want]
    assert w.apart.tolist() == [k == 0 or want[k][:2] != want[k - 1][:2] for k in range(len(want))]
