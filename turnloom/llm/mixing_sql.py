"""The mix in DuckDB SQL, for the oracle: the same numbers and orders, by plain window functions over all rows."""

from __future__ import annotations


def mix_sql(shards: int = 16, blocks_per_shard: int = 64, seed: int = 7) -> str:
    blocks, unit = shards * blocks_per_shard, float(1 << 52)
    number = lambda *parts: "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 13) AS BIGINT)"
    tree, levels = "", shards.bit_length() - 1
    for i in range(levels):
        draw = number(f"'split{seed}'", f"'{i}'", "CAST(rank AS VARCHAR)", "CAST(block AS VARCHAR)")
        tree += f""",
t{i + 1} AS (SELECT rank, block, 2 * shard + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY draw, rank, block) > count(*) OVER (PARTITION BY shard) THEN 1 ELSE 0 END AS shard
  FROM (SELECT *, {draw} AS draw FROM t{i}))"""
    perm = number(f"'perm{seed}'", "coalesce(CAST(doc_id AS VARCHAR), '')", "coalesce(text, '')")
    return f"""WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, {perm} AS perm FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM r GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 1 THEN 5e0 WHEN 2 THEN 2e0 ELSE 1e0 END AS weight, 3e0 * source_size AS top FROM s),
l AS (SELECT *, top / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / sum(weight) OVER (ORDER BY top / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE ratio > level ORDER BY ratio, rank LIMIT 1),
g AS (SELECT source, rank, source_size, CASE WHEN ratio > (SELECT level FROM f) THEN weight * (SELECT level FROM f) ELSE top END AS target FROM l),
x AS (SELECT *, coalesce(target * {blocks} / nullif(sum(target) OVER (), 0e0), 0e0) AS exact FROM g),
y AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY floor(exact) - exact, rank) AS place FROM x),
q AS (SELECT source, rank, source_size, target, CASE WHEN target > 0 THEN CAST(base + CASE WHEN place <= {blocks} - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) ELSE 0 END AS quota,
  CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole FROM y),
p AS (SELECT *, target - whole * source_size AS lacks FROM q),
c AS (SELECT source, bucket, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, perm >> 40 AS bucket, sum(size) AS size FROM r GROUP BY source, perm >> 40)),
e AS (SELECT p.source, c.bucket, c.before, p.lacks FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE c.before < p.lacks AND c.before + c.size >= p.lacks),
i AS (SELECT source, perm, lacks, before + sum(size) OVER (PARTITION BY source ORDER BY perm) AS words
  FROM (SELECT e.source, r.perm, e.before, e.lacks, sum(r.size) AS size FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source AND r.perm >> 40 = e.bucket GROUP BY ALL)),
h AS (SELECT source, max(perm) AS last, max(words) AS words FROM i WHERE words <= lacks GROUP BY source),
k AS (SELECT e.source, coalesce(h.last, (e.bucket << 40) - 1) AS last, e.lacks - coalesce(h.words, e.before) AS lack FROM e LEFT JOIN h ON e.source IS NOT DISTINCT FROM h.source),
o AS (SELECT source, perm FROM (SELECT k.source, r.perm, k.lack, sum(r.size) AS size FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source WHERE r.perm > k.last GROUP BY ALL)
  WHERE abs(size - lack) < lack QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - lack), perm) = 1),
d AS (SELECT p.*, coalesce(k.last, -1) AS last, coalesce(o.perm, -1) AS one FROM p LEFT JOIN k ON p.source IS NOT DISTINCT FROM k.source LEFT JOIN o ON p.source IS NOT DISTINCT FROM o.source),
t0 AS (SELECT rank, unnest(range(quota)) AS block, 0 AS shard FROM d WHERE quota > 0){tree},
m AS (SELECT row_number() OVER () AS n, r.doc_id, r.size, r.perm, d.rank, d.source_size, d.target, d.whole, d.last, d.quota, d.whole + CASE WHEN r.perm <= d.last OR r.perm = d.one THEN 1 ELSE 0 END AS copies FROM r JOIN d ON r.source IS NOT DISTINCT FROM d.source),
u AS (SELECT n, rank, perm, copy, quota, least(CAST(floor((copy + perm / {unit!r}) / (whole + (last + 1) / {unit!r}) * quota) AS BIGINT), quota - 1) AS block FROM (SELECT *, unnest(range(copies)) AS copy FROM m)),
v AS (SELECT n, string_agg(CAST(CASE WHEN quota > 0 THEN shard ELSE perm % {shards} END AS VARCHAR), ',' ORDER BY copy) AS shards FROM u LEFT JOIN t{levels} USING (rank, block) GROUP BY n)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, coalesce(shards, '') AS shards FROM m LEFT JOIN v USING (n)"""
