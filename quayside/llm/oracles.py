"""The queries of this package in DuckDB SQL, where SQL can say them."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS i FROM d, ks)),
m AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r),
wi AS (SELECT row_number() OVER () AS v, * FROM bw),
wt AS (SELECT v, k, o - 1 AS o, string_split(s, ' ')[o] AS term FROM (SELECT *, unnest(range(1, k + 1)) AS o FROM wi)),
dp AS (SELECT r, p - 1 AS p, w[p] AS term FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)
  WHERE w[p] IN (SELECT term FROM wt)),
f AS (SELECT term, count(*) AS f FROM dp GROUP BY term),
rarest AS (SELECT v, k, o, term FROM wt LEFT JOIN f USING (term)
  QUALIFY row_number() OVER (PARTITION BY v ORDER BY coalesce(f, 0), o) = 1),
cand AS (SELECT DISTINCT r, v, k, p - o + x AS s FROM dp JOIN rarest USING (term), (SELECT unnest([-1, 0, 1]) AS x)),
around AS (SELECT DISTINCT r, p + x AS q, term FROM dp, (SELECT unnest([-1, 0, 1]) AS x)),
near AS (SELECT r, v FROM cand JOIN wt USING (v, k) JOIN around USING (r, term) WHERE q = s + o GROUP BY r, v, s, k HAVING count(*) = k),
ni AS (SELECT r, count(DISTINCT item_id) AS n FROM near JOIN wi USING (v) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(ni.n, 0) AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN ni USING (r)"""


LINE_RUNS = r"""WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
s AS (SELECT doc_id, i, n,
    list(line) OVER nx AS ls, list(w) OVER nx AS ws FROM w
  WINDOW nx AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
k AS (SELECT doc_id, i, m, array_to_string(ls[1:m], chr(10)) AS t FROM s, (SELECT unnest(range(1, 5)) AS m)
  WHERE len(ws) >= m AND (m = 4 OR list_sum(ws[1:m]) >= 50)
    AND (m = 1 OR list_sum(ws[1:m - 1]) < 50 OR list_sum(ws[2:m]) < 50)),
later AS (SELECT doc_id, i, m FROM k QUALIFY row_number() OVER (PARTITION BY m, t ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS i FROM later),
r AS (SELECT w.doc_id, w.i, w.line, gone.i IS NOT NULL AS gone FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i),
f AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM r),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, count(*) FILTER (starts) AS n_runs,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs,
  CAST(coalesce(length(kept), 0) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN o USING (doc_id)"""


SHINGLE_JOIN = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ends.b FROM reach JOIN ends ON ends.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN least ON a = doc_id"""

REPEATS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS k
  FROM (SELECT r, h, unnest(range(length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
t AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1),
n AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM n),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, run),
p AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM runs),
o AS (SELECT d.r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front
  FROM p JOIN d ON d.r = p.r GROUP BY d.r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN o.r IS NULL THEN h ELSE concat(front, substr(h, 2 * last + 1)) END)) AS kept_sha256
FROM d LEFT JOIN o ON o.r = d.r"""


def _codes(rounds: int = 4) -> str:
    """Parts and codebooks as lists; every round joins each part with all entries of its place."""
    nearest = """SELECT r, j, list_min(list({'d': list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'i': i})) AS m
  FROM parts JOIN {book} USING (j) GROUP BY r, j"""
    steps = []
    for k in range(rounds):
        book = f"b{k}"
        steps.append(f"a{k} AS MATERIALIZED ({nearest.replace('{book}', book)})")
        steps.append(
            f"""n{k} AS (SELECT j, i, list(v ORDER BY x) AS e FROM (SELECT parts.j, m.i AS i, x, CAST(floor(sum(CAST(p[x] AS HUGEINT)) / count(*)) AS BIGINT) AS v
  FROM a{k} JOIN parts USING (r, j), (SELECT unnest(range(1, (SELECT max(len(p)) FROM parts) + 1)) AS x) GROUP BY ALL) GROUP BY j, i),
b{k + 1} AS MATERIALIZED (SELECT j, i, coalesce(n{k}.e, {book}.e) AS e FROM {book} LEFT JOIN n{k} USING (j, i))"""
        )
    last = nearest.replace("{book}", f"b{rounds}")
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, j, x[j * len(x) // 4 + 1:(j + 1) * len(x) // 4] AS p FROM v, (SELECT unnest(range(4)) AS j)),
b0 AS MATERIALIZED (SELECT j, r - 1 AS i, p AS e FROM parts WHERE r <= 256),
{", ".join(steps)},
z AS ({last}),
c AS (SELECT r, string_agg(printf('%02x', m.i), '' ORDER BY j) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY j, i)) AS s FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM v JOIN c USING (r), h"""


PIVOT_CODES = _codes()
