"""The same results as SQL, where SQL can express them."""

from densegrid.llm import licenses

AZ = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (SELECT doc_id, sha256({AZ.format('text')}) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_HEADS, _PLACES = licenses._postings(licenses.BASE, licenses.TEMPLATES)

OP6 = f"""
WITH head(template, label, is_base) AS (VALUES {_rows(_HEADS)}),
place(template, o, word, is_key) AS (VALUES {_rows(_PLACES)}),
d AS (SELECT doc_id, regexp_extract_all({AZ.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, i - 1 AS pos, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) u(i) WHERE w[i] IN (SELECT word FROM place)),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM t GROUP BY word),
r AS (
  SELECT place.*, n, row_number() OVER (PARTITION BY template ORDER BY ln(((SELECT count(*) FROM d) + 1) / n) DESC NULLS LAST, o) AS rank
  FROM place LEFT JOIN df USING (word)),
x AS (
  SELECT *, count(*) OVER (PARTITION BY template) AS words, sum(is_key::INT) OVER (PARTITION BY template) AS key_words
  FROM r JOIN head USING (template) WHERE is_key OR rank <= {licenses.RARE_WORDS} AND n IS NOT NULL),
s AS (
  SELECT doc_id, template, pos - o AS start, any_value(label) AS label, any_value(is_base) AS is_base, count(*) / any_value(words) AS coverage
  FROM t JOIN x USING (word) GROUP BY doc_id, template, pos - o
  HAVING pos - o >= 0 AND sum(is_key::INT) = any_value(key_words)
    AND count(*) / any_value(words) >= CASE WHEN any_value(is_base) THEN 1 ELSE {licenses.LEAST_COVERAGE} END),
g AS (
  SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (doc_id)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS top FROM d GROUP BY payload_digest)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM d JOIN g USING (payload_digest)
"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({AZ.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM d, unnest(range(1, len(w) + 1)) u(i)),
uni AS (SELECT word, count(*) AS n FROM t GROUP BY word),
bi AS (SELECT before, word, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY before, word),
s AS (
  SELECT t.doc_id, CASE
    WHEN t.before IS NULL THEN ln(o.n / (SELECT sum(n) FROM uni))
    WHEN b.n IS NOT NULL THEN ln(b.n / c.n)
    ELSE ln(0.4 * o.n / (SELECT sum(n) FROM uni)) END AS v
  FROM t JOIN uni o ON o.word = t.word LEFT JOIN bi b ON b.before = t.before AND b.word = t.word LEFT JOIN uni c ON c.word = t.before)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(x.score, 0), 6) AS score
FROM d LEFT JOIN (SELECT doc_id, sum(v) AS score FROM s GROUP BY doc_id) x USING (doc_id)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _floor_mean(s: str) -> str:
    return f"({s} - (({s} % n) + n) % n) // n"


def _op11(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Every round as a table of assignments and one of centroids."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE {_FINITE} AND len(embedding) = 64),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS k, q FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(q) AS q, min(struct_pack(distance := distance, k := k)) AS best FROM (
    SELECT vec_id, v.q, c.k, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
    FROM v CROSS JOIN c{r} c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT k, list({_floor_mean("s")} ORDER BY i) AS q FROM (
    SELECT best.k AS k, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) u(i) GROUP BY best.k, i) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, a.best.k AS cluster, a.best.distance AS distance, CAST(sum(a.best.distance) OVER (PARTITION BY a.best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.best.k"""


def _op13(parts: int = 16, d: int = 64, k: int = 64, rounds: int = 2) -> str:
    """Every round as a table of assigned parts and one of codebooks."""
    width = d // parts
    gap = " + ".join(f"(p.x{j} - e.x{j}) * (p.x{j} - e.x{j})" for j in range(width))
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (
  SELECT vec_id, part, {", ".join(f"q[part * {width} + {j + 1}] AS x{j}" for j in range(width))} FROM v, unnest(range({parts})) u(part)),
e0 AS MATERIALIZED (
  SELECT part, entry, {", ".join(f"x{j}" for j in range(width))}
  FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) f USING (vec_id) WHERE entry < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, {", ".join(f"any_value(x{j}) AS x{j}" for j in range(width))}, min(struct_pack(distance := distance, entry := entry)) AS best
  FROM (SELECT p.*, e.entry, {gap} AS distance FROM p JOIN e{r} e USING (part)) GROUP BY vec_id, part)""")
        if r < rounds:
            means = ", ".join(f"{_floor_mean(f's{j}')} AS x{j}" for j in range(width))
            steps.append(f"""
m{r} AS (
  SELECT part, entry, {means} FROM (
    SELECT part, best.entry AS entry, count(*) AS n, {", ".join(f"CAST(sum(x{j}) AS BIGINT) AS s{j}" for j in range(width))}
    FROM a{r} GROUP BY part, best.entry)),
e{r + 1} AS MATERIALIZED (
  SELECT part, entry, {", ".join(f"coalesce(m.x{j}, e.x{j}) AS x{j}" for j in range(width))} FROM e{r} e LEFT JOIN m{r} m USING (part, entry))""")
    numbers = " || ',' || ".join(f"x{j}" for j in range(width))
    return f"""WITH {",".join(steps)},
b AS (SELECT sha256(string_agg({numbers}, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds}),
g AS (
  SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.distance) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM g JOIN v USING (vec_id) CROSS JOIN b"""


ORACLES = {
    "op4_exact_dedup": OP4,
    "op6_license_scan": OP6,
    "op7_topk_search": OP7,
    "op9_warc": OP9,
    "op10_stupid_backoff": OP10,
    "op11_centroids": _op11(),
    "op13_vector_codes": _op13(),
}
