"""The queries of this subpackage, by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.collocations import collocations
from tidewatch.llm.decontaminate import contaminated
from tidewatch.llm.html_text import main_text
from tidewatch.llm.jaccard_join import jaccard_components
from tidewatch.llm.jpeg import media_digest
from tidewatch.llm.lm_score import score_documents
from tidewatch.llm.near_dup import near_duplicates
from tidewatch.llm.packing import packing_digest
from tidewatch.llm.pii import pii_digest
from tidewatch.llm.spelling import spelling_forms
from tidewatch.llm.suffix_dedup import repeated_passages
from tidewatch.llm.token_files import token_digest
from tidewatch.llm.toxicity import toxicity_digest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_lm_score": lambda spark, d: score_documents(table(spark, d, "documents")),
    "op2_pii": lambda spark, d: pii_digest(table(spark, d, "documents")),
    "op3_packing": lambda spark, d: packing_digest(table(spark, d, "documents")),
    "op4_near_dup": lambda spark, d: near_duplicates(table(spark, d, "documents")),
    "op5_token_files": lambda spark, d: token_digest(spark, table(spark, d, "documents")),
    "op6_toxicity": lambda spark, d: toxicity_digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_decontaminate": lambda spark, d: contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op8_suffix_dedup": lambda spark, d: repeated_passages(table(spark, d, "documents")),
    "op9_jpeg": lambda spark, d: media_digest(table(spark, d, "documents")),
    "op10_html_text": lambda spark, d: main_text(table(spark, d, "pages")),
    "op11_jaccard_join": lambda spark, d: jaccard_components(table(spark, d, "documents")),
    "op12_spelling_forms": lambda spark, d: spelling_forms(table(spark, d, "documents")),
    "op13_collocations": lambda spark, d: collocations(table(spark, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op4_near_dup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op11_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op12_spelling_forms": r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM o WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM g, crc),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
v AS MATERIALIZED (SELECT w AS word, sum(n)::BIGINT AS n FROM m WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
cut AS (SELECT DISTINCT k.word, k.n, v.word AS other, v.n AS n_other FROM k JOIN v ON v.word = a || b),
near AS (SELECT x.word, y.word AS other, y.n AS n_other FROM k x JOIN k y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
  UNION ALL SELECT word, other, n_other FROM cut UNION ALL SELECT other, word, n FROM cut),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n_other DESC, other) AS other, max(n_other) AS n_other FROM near GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= 10 * v.n THEN other END AS form, CASE WHEN n_other >= 10 * v.n THEN n_other END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.further)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word AND r.further IS NULL
""",
    "op13_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
s AS (SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : j], ' ')
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1 : c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE coalesce(100::HUGEINT * longer < 80::HUGEINT * a, true)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= 2000
""",
}
