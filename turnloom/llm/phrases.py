"""Collocations from vertical positional inverted lists.

A block is a bounded stretch of the table's texts, read by one task. For each word (or phrase) of a block its list holds the
positions at which it occurs, ascending; positions skip a number where a phrase may not go on. A phrase of k + 1 words occurs
where a phrase of k words is followed, one position on, by another one that overlaps it in all but the first word: lists of
phrases that are frequent over all blocks are merge-joined with the lists of what stands one position on, and the length of
the list that results is the phrase's exact frequency in the block. Lists stay in a file a block and length in the shared
folder; only (block, phrase, frequency) rows are shuffled, and those that stay frequent go back to their block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written
from .token_files import _fs
from .words import groups, split

#: Words of a phrase, its occurrences, and the share of a part's occurrences (per cent) that a longer one takes over.
MOST, LEAST, TAKEN = 3, 10, 50
#: Phrases of a language that are returned.
FIRST = 2000
#: Bytes of text of a block.
BLOCK = 16 << 20
#: What ends a piece, beside the end of its text.
STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Bits of a phrase's number within a block, which only a single text of several 100 MB could exceed (an error), and of the
#: numbers of a task's blocks.
BITS, TASK_BITS = 27, 10
#: Groups in which a language's phrases are ranked before the last ranking.
SALTS = 64


def _store(folder: str, name: str, codes: np.ndarray, positions: np.ndarray) -> None:
    """A block's lists, one after the other by code, as lengths and as steps from position to position. Written under another
    name first, so that a file that is there is whole."""
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    lengths = pa.array(np.bincount(codes).astype("<u4"))
    steps = pa.array(np.diff(positions.astype("<u4"), prepend=np.uint32(0)))
    part = f"{root}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for column in (lengths, steps):
            batch = pa.record_batch([column], names=["x"])
            with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
    fs.move(part, f"{root}/{name}")


def _load(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The codes and positions of a block's lists, by code."""
    fs, root = _fs(folder)
    with fs.open_input_stream(f"{root}/{name}") as f:
        lengths, steps = (pa.ipc.open_stream(f).read_all().column(0).to_numpy() for _ in range(2))
    return np.repeat(np.arange(len(lengths)), lengths), np.cumsum(steps, dtype=np.uint32)


def index(docs: DataFrame, folder: str, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """Write the lists of words and return block, code (by word of a block), lang, word and n, the length of its list."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        for number, b in enumerate(_blocks(batches, block)):
            if number >> TASK_BITS:
                raise ValueError(f"more than {1 << TASK_BITS} blocks in a task: use smaller input partitions")
            name = at.taskAttemptId() << TASK_BITS | number
            codes, positions, langs, words, begin, base = [], [], [], [], 0, 0
            for lang in pc.unique(b.column(0)).to_pylist():
                found = split(b.column(1).filter(pc.equal(b.column(0), lang)), b"\x20\x09", STOPS, lower=True)
                if not len(found.words):
                    continue
                d = found.words.dictionary_encode()
                position = np.cumsum(1 + found.apart.astype(np.int64)) + begin
                begin = int(position[-1])
                code = d.indices.to_numpy().astype(np.int64)
                order = np.argsort(code, kind="stable")
                codes.append(code[order] + base)
                positions.append(position[order])
                langs.append(pa.repeat(lang, len(d.dictionary)))
                words.append(d.dictionary.cast(pa.string()))
                base += len(d.dictionary)
            if base >> BITS:
                raise ValueError("a block has too many words")
            if base:
                _store(folder, f"1-{name}", np.concatenate(codes), np.concatenate(positions))
                n = np.bincount(np.concatenate(codes))
                columns = [pa.repeat(name, base), pa.array(np.arange(base)), pa.concat_arrays(langs), pa.concat_arrays(words), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "code", "lang", "word", "n"])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(write, "block long, code long, lang string, word string, n long")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows together until their texts have ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in groups(batches, size=size):
        more = pc.sum(pc.binary_length(b.column(1))).as_py() or 0
        if held and n + more > size:
            yield _together(held)
            held, n = [], 0
        held.append(b)
        n += more
    if held:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.chunked_array([b.column(i) for b in held]).combine_chunks().cast(pa.large_string()) for i in range(2)], names=["lang", "text"])


def frequent(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """``rows`` (block, code, n and ``key``) of the phrases that occur ``least`` times over all blocks, with f, that number,
    and id, which is the smallest of a phrase's numbers over its blocks."""
    own = F.shiftleft(F.col("block"), BITS).bitwiseOR(F.col("code"))
    w = Window.partitionBy(*key)
    return rows.withColumn("own", own).select("block", "code", "own", *key, F.sum("n").over(w).alias("f"), F.min("own").over(w).alias("id")).where(F.col("f") >= least)


def extended(lists: DataFrame, folder: str, words: int, last: bool) -> DataFrame:
    """Phrases of ``words`` + 1 words from the frequent ones of ``words`` words (block, code, id): block, code, a and b (the
    ids of the two that overlap) and n, the length of the list, which is stored unless this is the ``last`` step."""

    def extend(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        codes, positions = _load(folder, f"{words}-{block}")
        known, ids = table.column("code").to_numpy(), table.column("id").to_numpy()
        order = np.argsort(known)
        known, ids = known[order], ids[order]
        kept = np.full(int(codes[-1]) + 1, -1, np.int64)
        kept[known] = np.arange(len(known))
        taken = kept[codes]
        taken, positions = taken[taken >= 0], positions[kept[codes] >= 0].astype(np.int64)
        at = np.full(int(positions.max()) + 2, -1, np.int64)  # which list holds a position, so that all are joined at once
        at[positions] = taken
        follow = at[positions + 1]
        taken, follow, positions = taken[follow >= 0], follow[follow >= 0], positions[follow >= 0]
        order = np.argsort(taken * len(known) + follow, kind="stable")
        taken, follow, positions = taken[order], follow[order], positions[order]
        head = np.r_[True, (taken[1:] != taken[:-1]) | (follow[1:] != follow[:-1])] if len(taken) else np.zeros(0, bool)
        code = np.cumsum(head) - 1
        if not last and len(code):
            _store(folder, f"{words + 1}-{block}", code, positions)
        a, b = ids[taken[head]], ids[follow[head]]
        n = np.bincount(code) if len(code) else np.zeros(0, np.int64)
        return pa.table({"block": pa.repeat(block, len(a)), "code": np.arange(len(a)), "a": a, "b": b, "n": n.astype(np.int64)})

    return lists.select("block", "code", "id").groupBy("block").applyInArrow(extend, "block long, code long, a long, b long, n long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST, least: int = LEAST, taken: int = TAKEN, first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """Per language (null: ``und``) its first phrases of 2 to ``most`` words by score: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the exact frequencies of the phrase and of the two parts of its lowest-scoring cut (ties: the first), n that
    of all words; score is floor(1000000 a a / (l r)), in 38 digits. Phrases occur ``least`` times or more, within pieces that
    end at punctuation or line ends. One whose words lie inside a longer one that takes ``taken`` per cent of its occurrences
    or more is left out; whether by way of others makes no difference, since a longer one can't take more than those between.
    Ties of score go to the greater a, then the smaller phrase by its bytes.

    Memory of a task follows a block (or the longest text); blocks are read by one task each, so no list of a common word
    meets in one place, and a phrase has a row a block. Null and empty texts have no words; repeated rows count as often as
    they occur; other columns are left out, whatever their names; an empty table gives no rows.
    """
    folder = shared_dir(docs.sparkSession, "lists")
    rows = written(index(docs, folder, text_col, lang_col, block), "words")
    level = written(frequent(rows, ["lang", "word"], least), "frequent")
    # all frequent phrases of a length: id, lang, words, and the frequencies of what they begin and end with, by length
    phrases = level.where("own = id").select("id", "lang", F.array("word").alias("words"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    out = None
    for size in range(2, most + 1):
        found = extended(level, folder, size - 1, last=size == most)
        if size < most:
            level = written(frequent(found, ["a", "b"], least), "frequent")
            found = level.where("own = id").select("id", "a", "b", "f")
        else:
            found = found.groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.lit(None).cast("long"))
        head = phrases.select(F.col("id").alias("a"), "lang", "words", "heads")
        tail = phrases.select(F.col("id").alias("b"), F.slice("words", -1, 1).alias("word"), "tails")
        both = found.join(head, "a").join(tail, "b")
        f = F.array("f")
        longer = written(both.select("id", "a", "b", "lang", F.concat("words", "word").alias("words"), F.concat("heads", f).alias("heads"), F.concat("tails", f).alias("tails"), "f"), "phrases")
        if size > 2:
            out = _union(out, _without_parts(_scored(phrases, size - 1), longer, taken))
        phrases = longer
    out = _union(out, _scored(phrases, most)) if most > 1 else _scored(phrases.withColumn("f", F.element_at("heads", -1)), 1)
    by_score = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*by_score))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by_score)).cast("long")).where(F.col("rank") <= first)
    total = rows.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _scored(phrases: DataFrame, size: int) -> DataFrame:
    """id, lang, phrase, a, l, r and score of phrases of ``size`` words, by the lowest-scoring cut."""
    wide = lambda c: c.cast("decimal(38,0)")
    cuts = []
    for k in range(1, size):
        left, right = F.col("heads")[k - 1], F.col("tails")[size - k - 1]
        share = F.call_function("div", wide(wide(wide(F.lit(1000000)) * wide(F.col("f"))) * wide(F.col("f"))), wide(wide(left) * wide(right)))
        cuts.append(F.struct(share.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    best = F.array_min(F.array(*cuts))
    return phrases.withColumn("cut", best).select("id", "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def _without_parts(scored: DataFrame, longer: DataFrame, taken: int) -> DataFrame:
    """``scored`` without the phrases of which ``taken`` per cent or more lie inside one phrase of a word more."""
    most = longer.select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
    return scored.join(most, "id", "left").where(F.col("most").isNull() | (100 * F.col("most") < taken * F.col("a"))).drop("most")


def collocations_sql(most: int = MOST, least: int = LEAST, taken: int = TAKEN, first: int = FIRST) -> str:
    """The same for phrases of up to three words, by joins of plain n-gram counts (DuckDB)."""
    return f"""
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM lists, (SELECT unnest(range(1, {most + 1})) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {least}),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c
  JOIN f AS x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(list_slice(c.w, 1, cut), ' ')
  JOIN f AS y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(list_slice(w, 1, k - 1), ' '), array_to_string(list_slice(w, 2, k), ' ')]) AS part FROM c WHERE k > 2) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN parts ON parts.lang = lowest.lang AND part = phrase WHERE longer IS NULL OR 100 * longer < {taken} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {first}"""
