"""SimHash near-duplicate detection with multi-index hashing.

Fingerprints are cut into two segments of 32 bits, and a table is kept for each segment: segment value, fingerprint. Of two
fingerprints at 2 or fewer differing bits, either the first segments differ in at most one bit, or the second ones are
equal. So the ball of radius 1 around a fingerprint's first segment and the ball of radius 0 around its second one are looked
up in the tables, and complete distances are verified on what is fetched. Of two neighbouring values only the one with the
bit set looks up the other, which halves the ball.

Buckets of more than ``BUCKET`` fingerprints aren't fetched. All fingerprints that would look into one are linked by balls
around the whole fingerprint instead: two of them at 2 or fewer differing bits share the one halfway between them, under
which at most 65 fingerprints meet, so that way is exact and bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_rows, written

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_PLACE = (np.arange(8) * 256).astype(np.int64)
#: Fingerprints of a segment value beyond which its bucket isn't fetched.
BUCKET = 256


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text; without words 0.

    Words are runs of bytes other than U+0020 and U+0009-U+000D, A-Z in lower case; a bit is set if it is in over half
    the XXH64 values of the shingles, repeats included. Fewer words than a shingle has make one shingle.
    """
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    at = h.view(np.uint8).reshape(-1, 8) + _PLACE
    counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """doc_id and fp (a signed long of the 64 bits) of each row, and the text's own hash if asked for; null texts are empty."""

    rows = text_rows(docs, id_col, text_col)
    if text_hash:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), words, seed) for t in b.column(1).cast(pa.large_binary())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", "text_hash"][: b.num_columns])

    return rows.mapInArrow(of, "doc_id long, fp long" + ", text_hash long" * text_hash)


def _segments(fp: Column) -> tuple[Column, Column]:
    """Both segments as keys: the second one's bits begin at 2^32, where its number stands."""
    return fp.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))


def segment_tables(distinct: DataFrame) -> DataFrame:
    """key, other: each fingerprint under the value of each of its segments."""
    return distinct.select(F.explode(F.array(*_segments(F.col("fp")))).alias("key"), F.col("fp").alias("other"))


def lookups(distinct: DataFrame) -> DataFrame:
    """fp, key, own: the values that a fingerprint looks up, and whether they are its own (then the greater fingerprint
    alone links the other)."""
    first, second = _segments(F.col("fp"))
    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
    ball = F.transform(F.filter(bits, lambda bit: first.bitwiseAND(bit) != 0), lambda bit: first.bitwiseXOR(bit))
    keys = F.concat(F.array(first, second), ball)
    return distinct.select("fp", F.posexplode(keys).alias("at", "key")).select("fp", "key", (F.col("at") < 2).alias("own"))


def _verified(pairs: DataFrame) -> DataFrame:
    """Links (a, b), a > b, of the fetched pairs (fp, other, own) at 2 or fewer differing bits."""
    x, y = F.col("fp"), F.col("other")
    near = (F.bit_count(x.bitwiseXOR(y)) <= 2) & (~F.col("own") | (x > y)) & (x != y)
    return pairs.where(near).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))


def _halfway_links(distinct: DataFrame) -> DataFrame:
    """Links that join all of ``distinct`` at 2 or fewer differing bits: under each key of the ball of radius 1 around a
    whole fingerprint, a fingerprint is linked to the next smaller one there, not to all."""
    bits = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    keys = F.concat(F.array("fp"), F.transform(bits, lambda bit: F.col("fp").bitwiseXOR(bit)))
    before = F.lag("fp").over(Window.partitionBy("key").orderBy("fp"))
    return distinct.select("fp", F.explode(keys).alias("key")).select(F.col("fp").alias("a"), before.alias("b")).where("b is not null")


def near_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a > b, that join all of ``distinct`` (column fp) at 2 or fewer differing bits."""
    tables, probes = segment_tables(distinct), lookups(distinct)
    crowded = written(tables.groupBy("key").count().where(F.col("count") > bucket).select("key"), "crowded")
    if crowded.isEmpty():
        return _verified(probes.join(tables, "key")).distinct()
    fetched = probes.join(crowded, "key", "left_anti").join(tables, "key")
    crowd = probes.join(crowded, "key", "left_semi").select("fp").distinct()
    return _verified(fetched).unionByName(_halfway_links(crowd)).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each end of ``links`` (a, b), by alternating large and small stars.

    Each round keeps at most as many links as it got, and rounds grow with the logarithm of the nodes. Lineage is cut
    with tables in the shared folder.
    """
    e, mark = written(links.select("a", "b"), "links"), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        e = written(small, "links")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def _named(fps: DataFrame) -> DataFrame:
    """fp, root and component_id of each distinct fingerprint."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(near_links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (smallest doc_id reachable) of each row.

    Rows with equal fingerprints are one class before any link is sought, so groups of copies cost one entry. Null texts
    are empty (fingerprint zero, linked like any other); very long texts are fingerprinted whole; rows with a null doc_id
    keep it and get their class's id; an empty table gives no rows; repeated rows stay; other columns aren't read.
    """
    fps = written(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    named = _named(fps).select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` (all columns) with one row of each component: the one of the smallest doc_id (null last), then of the
    smallest text hash; of rows that repeat both, any one. Null and empty texts are one class; very long
    texts are read whole; an empty table gives no rows."""
    fps = written(fingerprints(docs, words, seed, text_hash=True), "fingerprints")
    each = fps.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    rooted = each.join(_named(fps), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "copies"))
    kept = written(rooted.groupBy("root").agg(first.alias("k")).select("k.doc_id", "k.text_hash", "k.copies"), "kept")
    same = F.expr("d.doc_id <=> k.doc_id and xxhash64(coalesce(d.text, '')) = k.text_hash")
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    once = docs.alias("d").join(kept.where("copies = 1").alias("k"), same, "left_semi")
    more = kept.where("copies > 1")
    if more.isEmpty():
        return once
    many = docs.alias("d").join(more.alias("k"), same).groupBy("k.doc_id", "k.text_hash").agg(F.first(F.struct(*own)).alias("d"))
    return once.unionByName(many.select("d.*"))
