"""DuckDB SQL for the queries that SQL can express over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}')"
_RUNS = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"

OP11 = f"""
WITH RECURSIVE steps(b, v, i) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE i = 8),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
raw AS MATERIALIZED (SELECT rid, unnest({_RUNS}) AS f FROM docs),
aim AS MATERIALIZED (SELECT unnest({_RUNS}) AS f FROM (SELECT {_WORDS} AS words FROM benchmark)),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM raw UNION SELECT f FROM aim)),
bytes AS (SELECT f, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS b FROM hexed),
buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM raw JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aim JOIN buckets USING (f) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM raw) AS S, (SELECT count(*) FROM aim) AS T),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (total.S + 10000) AS DOUBLE) / CAST((s.n + 1) * (total.T + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), total),
means AS (SELECT rid, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM raw JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY rid),
scores AS (
  SELECT rid, doc_id, len(words) AS n_words, len(words) + greatest(len(words) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN means USING (rid)),
drawn AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS fit FROM scores WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 25 * fit // 100 THEN place END AS rank
FROM scores LEFT JOIN drawn USING (rid)
"""


def _op13(k: int = 8, rounds: int = 10) -> str:
    """Plain k-means as a chain of tables, one pair a round."""
    ctes = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT rid, unnest(range(1, 65)) AS i, unnest(x) AS v FROM kept)",
        f"first AS (SELECT x, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS v FROM first)",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, CAST(sum((p.v - q.v) * (p.v - q.v)) AS BIGINT) AS d "
            f"FROM parts p JOIN c{r} q USING (i) GROUP BY rid, c) GROUP BY rid)"
        )
        if r < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            ctes.append(
                f"c{r + 1} AS MATERIALIZED (SELECT q.c, q.i, coalesce({mean}, q.v) AS v FROM c{r} q LEFT JOIN "
                f"(SELECT c, i, sum(v) AS s, count(*) AS n FROM parts JOIN a{r} USING (rid) GROUP BY c, i) USING (c, i))"
            )
    names = f"hashes AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)"
    return f"""WITH {", ".join([*ctes, names])}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN hashes USING (c)"""


OP13 = _op13()

ORACLES = {"op5_exact_dedup": OP5, "op11_resample": OP11, "op13_centroids": OP13}
