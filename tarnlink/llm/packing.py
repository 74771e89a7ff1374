"""Length-bucketed packing: bucket boundaries of least padding by dynamic programming, token-budget batches inside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, number_of, repeated

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket that one task numbers, about.
SHARD = 32768


def count_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def best_boundaries(histogram: dict[int, int], buckets: int) -> tuple[list[int], int]:
    """The ends of at most that many buckets that pad least if each length goes up to the next end; and that padding.

    cost[k][j] = min over i of cost[k - 1][i] + end_j * rows(i, j) - tokens(i, j), over the distinct lengths, with exactly k
    buckets. Ties go to the smaller i, and to fewer buckets.
    """
    if not histogram:
        return [], 0
    ends = np.array(sorted(histogram), np.int64)
    rows = np.concatenate(([0], np.cumsum([histogram[int(x)] for x in ends])))
    tokens = np.concatenate(([0], np.cumsum([histogram[int(x)] * int(x) for x in ends])))
    n, far = len(ends), np.iinfo(np.int64).max // 2
    cost, back = [np.full(n + 1, far)], []
    cost[0][0] = 0
    for k in range(1, min(buckets, n) + 1):
        now, at = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for j in range(k, n + 1):
            # padding = end * rows - tokens of the span i..j
            spans = cost[-1][k - 1 : j] + ends[j - 1] * (rows[j] - rows[k - 1 : j]) - (tokens[j] - tokens[k - 1 : j])
            at[j] = k - 1 + int(spans.argmin())
            now[j] = spans[at[j] - k + 1]
        cost.append(now)
        back.append(at)
    k = int(np.argmin([x[n] for x in cost]))
    padding, out, j = int(cost[k][n]), [], n
    for at in reversed(back[:k]):
        out.append(int(ends[j - 1]))
        j = int(at[j])
    return out[::-1], padding


def pack(docs: DataFrame, buckets: int = 8, max_length: int = 2048, budget: int = 16384) -> DataFrame:
    """One row per segment: doc_id, segment, first_token, n_tokens, bucket, padded, shard, batch, slot.

    Documents of more than max_length words are cut into segments of max_length, so no token is lost and the global
    histogram has at most max_length + 1 rows. A batch is (bucket, shard, batch): up to budget // padded segments of
    one bucket, by (doc_id, segment, n_tokens) within a shard; shards hold about SHARD different rows each. Texts without
    words, empty or null, have one segment of 0 tokens in a bucket of its own, padded to 0, one batch per budget rows. Rows
    that repeat are packed each time, as one run, so none is a hot key; a null doc_id is a value like others; an empty table
    gives no rows; other columns are ignored.
    """
    sized = docs.select("doc_id", count_words().alias("n")).groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("_same"))
    sized = materialize(sized, "pack-lengths")
    pieces = sized.withColumn("segment", F.explode(F.sequence(F.lit(0), F.expr(f"cast(greatest(1, ceil(n / {max_length})) as int) - 1"))))
    pieces = pieces.select("doc_id", "segment", (F.col("segment") * F.lit(max_length).cast("long")).alias("first_token"), F.expr(f"least({max_length}L, n - segment * {max_length}L)").alias("n_tokens"), "n", "_same")
    counted = {r[0]: (r[1], r[2]) for r in pieces.groupBy("n_tokens").agg(F.sum("_same"), F.count(F.lit(1))).collect()}
    ends, _ = best_boundaries({k: v for k, (v, _) in counted.items() if k}, buckets)
    ends = [0, *ends]
    counts = [sum(n for k, (_, n) in counted.items() if low < k <= high) for low, high in zip([-1, *ends], ends, strict=False)]
    slots = [max(1, budget // max(1, x)) for x in ends]
    shards = [max(1, -(-c // SHARD)) for c in counts]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    bucket = sum(((F.col("n_tokens") > x).cast("int") for x in ends), F.lit(0))
    rows = pieces.withColumn("bucket", bucket).withColumn("padded", pick(ends).cast("long"))
    rows = rows.withColumn("shard", F.pmod(number_of("doc_id", "segment", "n"), pick(shards).cast("long")).cast("int"))
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "segment", "n_tokens", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_from", F.sum("_same").over(order) - F.col("_same")).withColumn("_slots", pick(slots))
    rows = repeated(rows, "_same", "_copy").withColumn("_at", F.col("_from") + F.col("_copy"))
    rows = rows.withColumn("batch", F.expr("_at div _slots").cast("int")).withColumn("slot", F.expr("_at % _slots").cast("int"))
    return rows.select("doc_id", "segment", "first_token", "n_tokens", "bucket", "padded", "shard", "batch", "slot")


#: The dynamic programme as a recursion over the number of buckets, then the way back from the best end.
QUERY_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(0, greatest(1, (n + 2047) // 2048))) AS segment FROM l),
s AS (SELECT doc_id, n, segment, segment * 2048 AS first_token, least(2048, n - segment * 2048) AS n_tokens FROM p),
h AS (SELECT n_tokens AS x, count(*) AS c FROM s WHERE n_tokens > 0 GROUP BY 1),
z AS (SELECT 0 AS j, 0 AS x, 0 AS r, 0 AS t UNION ALL
      SELECT row_number() OVER (ORDER BY x), x, CAST(sum(c) OVER (ORDER BY x) AS BIGINT), CAST(sum(c * x) OVER (ORDER BY x) AS BIGINT) FROM h),
d AS (SELECT 0 AS k, CAST(0 AS BIGINT) AS j, [CAST(0 AS BIGINT), CAST(0 AS BIGINT)] AS way
      UNION ALL
      SELECT d.k + 1, b.j, min([d.way[1] + b.x * (b.r - a.r) - (b.t - a.t), a.j])
      FROM d JOIN z a ON a.j = d.j JOIN z b ON b.j > a.j WHERE d.k < 8 GROUP BY d.k + 1, b.j),
e AS (SELECT k, j, way FROM (SELECT *, row_number() OVER (ORDER BY way[1], k) AS best FROM d WHERE j = (SELECT max(j) FROM z) AND k > 0) WHERE best = 1
      UNION ALL
      SELECT d.k, d.j, d.way FROM e JOIN d ON d.k = e.k - 1 AND d.j = e.way[2] WHERE e.k > 1),
f AS (SELECT 0 AS x UNION ALL SELECT z.x FROM e JOIN z USING (j)),
g AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS bucket FROM f),
b AS (SELECT s.*, (SELECT min(g.x) FROM g WHERE g.x >= s.n_tokens) AS padded FROM s),
w AS (SELECT b.*, g.bucket, greatest(1, (count(*) OVER (PARTITION BY g.bucket) + 32767) // 32768) AS shards FROM b JOIN g ON g.x = b.padded),
q AS (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', doc_id, segment, n)), 1, 15)) AS BIGINT) % shards AS shard FROM w),
a AS (SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY doc_id, segment) - 1 AS place, greatest(1, 16384 // greatest(1, padded)) AS slots FROM q)
SELECT doc_id, CAST(segment AS INTEGER) AS segment, CAST(first_token AS BIGINT) AS first_token, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INTEGER) AS bucket,
       CAST(padded AS BIGINT) AS padded, CAST(shard AS INTEGER) AS shard, CAST(place // slots AS INTEGER) AS batch, CAST(place % slots AS INTEGER) AS slot FROM a
"""
