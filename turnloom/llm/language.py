"""Language identification by word-first backoff.

Known words score by their log frequency in each language; an unseen word falls back to the longest known character
n-grams at each of its positions, down to single characters. All counted words and n-grams count: workers hold the most
frequent ones as Arrow arrays, and what a text has beyond those is looked up in tables of the rest, by joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_rows, written

_WORD = re.compile(r"[^\W\d_]+")
#: Most words and most n-grams that a worker holds, the most frequent ones (the rest is looked up in tables); most numbers
#: that their log frequencies make, so that many languages mean fewer of them; and the longest n-gram.
WORDS, GRAMS, CELLS, LONGEST = 600_000, 200_000, 4_000_000, 4
#: Bytes of text of a group that is cut into words at once, and words whose n-grams are counted at once.
GROUP, WORDS_AT_ONCE = 8 << 20, 100_000


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. None spans white space, so those of a text are those of its tokens."""
    low = text.lower()
    if low.isalpha():
        return [low]
    found = _WORD.findall(low)
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]  # numbers that aren't digits


def grams_of(word: str, longest: int = LONGEST) -> Iterator[str]:
    """All n-grams of a word between its borders, the borders alone aside."""
    w = f"^{word}$"
    for n in range(1, longest + 1):
        for i in range(len(w) - n + 1):
            if n > 1 or 0 < i < len(w) - 1:
                yield w[i : i + n]


class Cut:
    """A group of texts cut into words: each distinct token is cut once.

    ``text`` and ``token`` are the places of all tokens, ``words`` the distinct words, ``owner`` and ``word`` the tokens'
    words, in the tokens' order, as places.
    """

    def __init__(self, column: pa.Array):
        spaced = pc.replace_substring(pc.replace_substring(column, "\n", " "), "\t", " ")
        lists = pc.split_pattern(spaced, " ")
        flat = lists.flatten().dictionary_encode()
        self.n, self.token = len(column), flat.indices.to_numpy().astype(np.int64)
        self.text = np.repeat(np.arange(len(column)), np.diff(lists.offsets.to_numpy()))
        cut = [words_of(t) for t in flat.dictionary.to_pylist()]
        self.tokens, sizes = len(cut), np.fromiter(map(len, cut), np.int64, len(cut))
        words = pa.array([w for c in cut for w in c], pa.string()).dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.owner = np.repeat(np.arange(len(cut)), sizes)

    def occurrences(self, of: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each of ``of`` (a number a text) has each of the words at the places ``some`` of ``word``: distinct
        pairs, ordered, and their counts."""
        owner, word = self.owner[some], self.word[some]
        per = np.bincount(owner, minlength=self.tokens)
        at = np.flatnonzero(per[self.token])
        pairs, n = np.unique(of[self.text[at]] * self.tokens + self.token[at], return_counts=True)
        who, token = pairs // max(1, self.tokens), pairs % max(1, self.tokens)
        times = per[token]
        first = np.cumsum(per) - per
        places = np.repeat(first[token] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pairs, back = np.unique(np.repeat(who, times) * len(self.words) + word[places], return_inverse=True)
        counts = np.bincount(back, weights=np.repeat(n, times), minlength=len(pairs)).astype(np.int64)
        return pairs // max(1, len(self.words)), pairs % max(1, len(self.words)), counts


def _groups(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about GROUP bytes of text, a row at least."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, GROUP + (size[at - 1] if at else 0))))
            yield b.slice(at, end - at)
            at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all rows of ``docs`` (text, lang), counted in the tasks before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, 0):
            cut, langs = Cut(b.column(0)), b.column(1).dictionary_encode()
            lang, word, n = cut.occurrences(langs.indices.to_numpy().astype(np.int64), np.arange(len(cut.word)))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), cut.words.take(pa.array(word)), pa.array(n)], names=["lang", "word", "n"])

    return docs.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted_grams(words: list[str], times: np.ndarray, longest: int = LONGEST) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams of words, and how often they occur if each word does ``times``."""
    letters, place = np.unique(np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32), return_inverse=True)
    if len(letters) >= 1 << 16 and len(words) > 1:  # places take 16 bits
        half = len(words) // 2
        a, b = _counted_grams(words[:half], times[:half]), _counted_grams(words[half:], times[half:])
        return a[0] + b[0], np.r_[a[1], b[1]]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())  # characters to the word's end, this one included
    weight, place = np.repeat(times, sizes), place.astype(np.uint64)
    names = [chr(x) for x in letters]
    grams, counts, code = [], [], np.zeros(len(place), np.uint64)
    for n in range(1, longest + 1):
        code = (code[: len(place) - n + 1] << np.uint64(16)) | place[n - 1 :]
        at = left[: len(code)] >= n
        if n == 1:
            at &= (left != 1) & (left != np.repeat(sizes, sizes))
        found, back = np.unique(code[at], return_inverse=True)
        counts.append(np.bincount(back, weights=weight[: len(code)][at], minlength=len(found)).astype(np.int64))
        parts = [[names[i] for i in (found >> np.uint64(16 * k)) & np.uint64(0xFFFF)] for k in reversed(range(n))]
        grams += map("".join, zip(*parts))
    return grams, np.concatenate(counts)


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, gram, n from counted words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            for lang in pc.unique(table["lang"]).to_pylist():
                some = table.filter(pc.equal(table["lang"], lang))
                grams, n = _counted_grams(some["word"].to_pylist(), some["n"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n)], names=["lang", "gram", "n"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= WORDS_AT_ONCE:
                yield from handed(held)
                held = []
        if held:
            yield from handed(held)

    return words.select("lang", "word", "n").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _logs(counts: list[list[int]], totals: list[int], n: int = 0) -> np.ndarray:
    c = np.array(counts, np.float64).reshape(-1, len(totals)) + 0.5
    return np.log(c / (np.array(totals, np.float64) + 0.5 * max(1, n, len(counts))))


class Model:
    """Log frequencies by language of all known words and n-grams, in one process."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], word_totals: list[int], grams: dict[str, list[int]], gram_totals: list[int]):
        self.langs = langs
        self.words = dict(zip(words, _logs(list(words.values()), word_totals)))
        self.grams = dict(zip(grams, _logs(list(grams.values()), gram_totals)))

    def back_off(self, word: str) -> np.ndarray:
        """The mean over an unseen word's positions of the longest known n-gram that begins there."""
        w, found = f"^{word}$", []
        for i in range(len(w) - 1):
            known = (g for end in range(min(i + LONGEST, len(w)), i, -1) if (g := self.grams.get(w[i:end])) is not None)
            found += [g for g in (next(known, None),) if g is not None]
        return np.mean(found, 0) if found else np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of all languages' likelihood; "und" and 0 without letters."""
        words = words_of(text or "")
        if not self.langs or not words:
            return "und", 0.0
        total = sum((self.words[w] if w in self.words else self.back_off(w) for w in words), np.zeros(len(self.langs)))
        best = int(total.argmax())
        return self.langs[best], 1 / float(np.exp(total - total[best]).sum())


class Held:
    """What workers hold of a model: the most frequent words and n-grams with their log frequencies by language."""

    def __init__(self, langs: list[str], words: pa.Table, grams: pa.Table, more_grams: bool):
        self.langs, self.more_grams = langs, more_grams
        self.words, self.logs = self._arrays(words)
        self.gram_names, self.gram_logs = self._arrays(grams)
        self.gram_at: dict[str, int] = {}

    def _arrays(self, table: pa.Table) -> tuple[pa.Array, np.ndarray]:
        keys, logs = (pa.concat_arrays(table.column(i).chunks) if table.num_rows else pa.array([], table.schema.types[i]) for i in range(2))
        return keys.cast(pa.string()), logs.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, len(self.langs))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"gram_at": {}}

    def parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of each text: whether it has letters, and the sum over its held words; and of the others in all texts: the
        text's place, the word, and how often."""
        cut = Cut(column)
        at = pc.index_in(cut.words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)[cut.word]
        some = np.bincount(cut.owner, minlength=cut.tokens) > 0
        letters = np.bincount(cut.text[some[cut.token]], minlength=cut.n) > 0
        sums, held = np.zeros((cut.n, len(self.langs))), at >= 0
        for i in range(len(self.langs)):
            of_token = np.bincount(cut.owner[held], weights=self.logs[at[held], i], minlength=cut.tokens)
            sums[:, i] = np.bincount(cut.text, weights=of_token[cut.token], minlength=cut.n)
        text, word, n = cut.occurrences(np.arange(cut.n), np.flatnonzero(~held))
        return letters, sums, text, cut.words.take(pa.array(word)), n

    def back_off_part(self, word: str) -> tuple[np.ndarray, int, list[tuple[int, int, str | None, list[float] | None]]]:
        """The sum over the positions of an unseen word whose longest n-gram is certainly held, their number, and for each
        other position (position, length, n-gram, log frequencies): the held one, and longer ones to be looked up."""
        if not self.gram_at:
            self.gram_at = {g: i for i, g in enumerate(self.gram_names.to_pylist())}
        w, get, found, tries = f"^{word}$", self.gram_at.get, [], []
        for i in range(len(w) - 1):
            longest = min(i + LONGEST, len(w))
            end, g = next(((e, g) for e in range(longest, i, -1) if (g := get(w[i:e])) is not None), (i, None))
            if end < longest and self.more_grams:
                if g is not None:
                    tries.append((i, end - i, None, self.gram_logs[g].tolist()))
                tries += [(i, e - i, w[i:e], None) for e in range(end + 1, longest + 1)]
            elif g is not None:
                found.append(g)
        return self.gram_logs[found].sum(0, dtype=np.float64), len(found), tries


def _most(counts: DataFrame, key: str, langs: list[str], totals: list[int], most: int) -> tuple[pa.Table, int, DataFrame]:
    """Keys with their log frequencies: those of the largest totals, as many whole steps of totals as hold at most
    ``most`` keys; how many others there are; and the table of those (key, logs). Steps keep three digits of a total, so
    there are few, and what the driver gets is bounded by ``most``."""
    by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "n")))  # an entry a language
    keys = written(counts.groupBy(key).agg(F.sum("n").alias("total"), by_lang.alias("by_lang")), f"{key}-totals")
    unit = F.pow(F.lit(10.0), F.greatest(F.length(F.col("total").cast("string")) - 3, F.lit(0)))
    step = (F.floor(F.col("total") / unit) * unit).cast("long")
    steps = keys.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    n, held, least = sum(r["count"] for r in steps), 0, None
    for r in steps:
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r.step
    count = lambda x: F.coalesce(F.try_element_at("by_lang", F.lit(x)), F.lit(0))
    logs = F.array(*(F.log((count(x) + F.lit(0.5)) / F.lit(t + 0.5 * max(1, n))) for x, t in zip(langs, totals)))
    keyed = keys.select(key, logs.alias("logs"), step.alias("step"))
    inside = F.col("step") >= least if least is not None else F.lit(False)
    top = keyed.where(inside).select(key, F.col("logs").cast("array<float>").alias("logs")).toArrow()
    return top, n - held, keyed.where(~inside).select(key, "logs")


def learn(docs: DataFrame) -> tuple[Held | None, DataFrame | None, DataFrame | None]:
    """What workers hold of a model of all rows of ``docs`` (text, lang) that have both, and the tables (word, logs) and
    (gram, logs) of what they don't; None without any."""
    words = written(word_counts(docs.where("lang is not null and text is not null")), "words")
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    langs = sorted(totals)
    if not langs:
        return None, None, None
    grams = written(gram_counts(words), "grams")
    by_lang = {r.lang: r.n for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    room = CELLS // len(langs)
    held, _, more_words = _most(words, "word", langs, [totals[x] for x in langs], min(WORDS, room))
    held_grams, rest, more_grams = _most(grams, "gram", langs, [by_lang[x] for x in langs], min(GRAMS, room))
    return Held(langs, held, held_grams, rest > 0), more_words, more_grams


def _summed(df: DataFrame, by: str, vector: str, n: int, times: str | None = None) -> DataFrame:
    """``by``, and the sum of the vectors (of ``n`` numbers) of its rows, each ``times`` often; and how many there are."""
    one = [F.col(vector)[i] * F.col(times) if times else F.col(vector)[i] for i in range(n)]
    sums = df.groupBy(by).agg(F.count("*").alias("rows"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(one)))
    return sums.select(by, "rows", F.array(*(f"s{i}" for i in range(n))).alias("sums"))


def _backed_off(unseen: DataFrame, sent, grams: DataFrame) -> DataFrame:
    """word, logs of each word of ``unseen`` (word): what it falls back to. ``sent`` broadcasts the model."""
    schema = "word string, base array<double>, found int, tries array<struct<at:int,n:int,gram:string,logs:array<double>>>"
    arrow = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("gram", pa.string()), ("logs", pa.list_(pa.float64()))]))
    width = len(sent.value.langs)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            parts = [m.back_off_part(w) for w in b.column(0).to_pylist()]
            tries = [[dict(zip(("at", "n", "gram", "logs"), t)) for t in p[2]] for p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p[0].tolist() for p in parts], pa.list_(pa.float64())), pa.array([p[1] for p in parts], pa.int32()), pa.array(tries, arrow)], names=["word", "base", "found", "tries"])

    out = unseen.mapInArrow(back, schema)
    if not sent.value.more_grams:
        return out.select("word", F.transform("base", lambda x: x / F.greatest("found", F.lit(1))).alias("logs"))
    out = written(out, "backed-off")
    tries = out.select("word", F.inline("tries"))
    looked = tries.where("gram is not null").select("word", "at", "n", "gram").join(grams, "gram").select("word", "at", "n", "logs")
    longest = tries.where("gram is null").select("word", "at", "n", "logs").unionByName(looked).groupBy("word", "at").agg(F.max_by("logs", "n").alias("logs"))
    out = out.select("word", "base", "found").join(_summed(longest, "word", "logs", width), "word", "left")
    total = F.when(F.col("sums").isNull(), F.col("base")).otherwise(F.zip_with("base", "sums", lambda x, y: x + y))
    return out.select("word", F.transform(total, lambda x: x / F.greatest(F.col("found") + F.coalesce("rows", F.lit(0)), F.lit(1))).alias("logs"))


def identify(docs: DataFrame, fold: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learned from the rows that aren't held out.

    Null texts and texts without letters are "und" with score 0, as is everything if nothing can be learned; null
    languages teach nothing; null ids stay; very long texts count whole; repeated rows stay; ties go to the first language
    by code point; an empty table gives no rows; other columns aren't read.
    """
    out = held_out(id_col, fold, rest)
    model, more_words, more_grams = learn(docs.where(~out).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    texts = text_rows(docs, id_col, text_col)
    if model is None:
        return texts.select("doc_id", held_out("doc_id", fold, rest).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS, GRAMS and CELLS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, 1):
            letters, sums, text, words, times = sent.value.parts(b.column(1))
            ends = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)), pa.int32())
            held = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(letters), held, pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(times))], names=["doc_id", "letters", "held", "words", "times"])

    # written, so that a row keeps its number
    parts = texts.mapInArrow(part, "doc_id long, letters boolean, held array<double>, words array<string>, times array<long>")
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "held-parts")
    others = parts.select("row", F.inline(F.arrays_zip("words", "times"))).toDF("row", "word", "times")
    unseen = others.select("word").distinct().join(more_words, "word", "left_anti")
    looked = more_words.unionByName(_backed_off(unseen, sent, more_grams))
    sums = _summed(others.join(looked, "word"), "row", "logs", len(model.langs), "times")
    total = F.when(F.col("sums").isNull(), F.col("held")).otherwise(F.zip_with("held", "sums", lambda x, y: x + y))
    found = parts.select("row", "doc_id", "letters", "held").join(sums, "row", "left").select("doc_id", "letters", total.alias("total"))
    top = F.array_max("total")
    best = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("total", top).cast("int"))
    share = 1 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return found.select("doc_id", held_out("doc_id", fold, rest).alias("held_out"), F.when(F.col("letters"), best).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), share).otherwise(0.0).alias("score"))
