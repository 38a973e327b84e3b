"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")


def _kind(number: int, pattern: str, least: int, group: int = 0) -> str:
    return f"""
  SELECT r, o, p, {number} AS kind, unnest(a) AS m, unnest(v) AS v, unnest(g[1:len(a)]) AS gap, generate_subscripts(a, 1) AS i,
    {least} AS least
  FROM (SELECT r, o, p, regexp_extract_all(t, '{pattern}') AS a, regexp_extract_all(t, '{pattern}', {group}) AS v,
          string_split_regex(t, '{pattern}') AS g FROM d)"""


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str) -> str:
    """r (row number), key and w (list of lower-cased words) of every row."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT row_number() OVER () AS r, {key}, regexp_extract_all({lower}, '{_WORD}') AS w FROM {table}"


def _draw(number: int, seed: int, key: str = "doc_id") -> str:
    """The given unsigned 32-bit group of the hash of the id."""
    digest = f"sha256('{seed}:' || coalesce(CAST({key} AS VARCHAR), ''))"
    return f"CAST('0x' || substr({digest}, {8 * number + 1}, 8) AS BIGINT)"


ORACLE: dict[str, str] = {
    "op8_top_products": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r
  WHERE q.vec_id % 100 = 0
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
""",
    "op10_secrets": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o,
    coalesce(source, '') || chr(1) || coalesce(lang, '') AS p
  FROM documents
), e AS ({_kind(0, _ASSIGN, 12, 2)}
  UNION ALL {_kind(1, "AKIA[A-Z0-9]+", 18)}
  UNION ALL {_kind(2, "[0-9a-f]+", 16)}
  UNION ALL {_kind(3, "[A-Za-z0-9+/_-]+", 20)}
), placed AS (
  SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM e
), found AS (
  SELECT *, stop - length(m) AS start, len(list_distinct(string_split(v, ''))) >= 10 AND regexp_matches(v, '[0-9]')
      AND regexp_matches(v, '[A-Za-z]')
      AND NOT regexp_matches(v, '(?i)example|sample|dummy|placeholder|changeme|your|test|xxxx|0000|1234|abcd') AS looks
  FROM placed WHERE length(v) >= least AND (kind < 3 OR regexp_matches(v, '[0-9]'))
), held AS (
  SELECT v, count(DISTINCT o) AS owners, bool_or(kind < 3) AS base FROM found GROUP BY v
), spans AS (
  SELECT f.*, h.owners, h.base, f.looks AND h.owners <= 2 AS live,
    coalesce(max(CASE WHEN kind < 3 THEN stop END) OVER (PARTITION BY r ORDER BY start, kind
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) >= stop AS covered
  FROM found f JOIN held h USING (v)
), kept AS (
  SELECT *, ['assign', 'access', 'hex', 'generic'][kind + 1] || ':' || start || ':' || stop AS said
  FROM spans WHERE kind < 3 OR ((live OR base) AND NOT covered)
), per_row AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(said, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (owners > 2) AS n_copied
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per_row USING (r)
""",
    "op11_resample": f"""
WITH d AS ({_words("documents", "doc_id")}),
b AS ({_words("benchmark", "item_id")}),
crc_table AS (
  SELECT list(list_reduce([CAST(i AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) x(i)
), found AS (
  SELECT r, unnest(w) AS word FROM d
), target AS (
  SELECT unnest(w) AS word FROM b
), vocabulary AS (
  SELECT word FROM found UNION SELECT word FROM target
), hashed AS (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(1, len(hex(word)) + 1, 2),
      lambda i: CAST('0x' || substr(hex(word), i, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table
), ours AS (
  SELECT bucket, count(*) AS s FROM found JOIN hashed USING (word) GROUP BY bucket
), theirs AS (
  SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT CAST(x AS BIGINT) AS bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT count(*) FROM found) AS DOUBLE) + 10000)
    / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST((SELECT count(*) FROM target) AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM range(10000) b(x) LEFT JOIN ours ON ours.bucket = x LEFT JOIN theirs ON theirs.bucket = x
), sums AS (
  SELECT r, count(*) AS n, sum(gain) AS total FROM found JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / n), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln(({_draw(0, 2024)} + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM d LEFT JOIN sums USING (r)
), placed AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS place,
    count(*) OVER () * 10 // 100 AS drawn
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + noise AS score,
  CASE WHEN place <= drawn THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
""",
    "op12_fill_middle": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    {_draw(0, 42)} AS h1, {_draw(1, 42)} AS h2, {_draw(2, 42)} AS h3, {_draw(3, 42)} AS h4
  FROM documents
), cut AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), pieces AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix
  FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
""",
    "op13_decontaminate": f"""
WITH d AS ({_words("documents", "doc_id")}),
b AS ({_words("benchmark", "item_id")}),
windows AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(len(w), 10) AS size,
    unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS said
  FROM b WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT size FROM windows
), runs AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS said
  FROM d, sizes WHERE len(w) >= size
), found AS (
  SELECT r, i, size, item FROM runs JOIN windows USING (said, size)
), places AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.said, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
