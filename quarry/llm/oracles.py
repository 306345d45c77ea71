"""DuckDB SQL of the numbered queries that SQL can express, for the same rows and columns."""

from __future__ import annotations

from quarry.llm.mixing import JUNK
from quarry.llm.quality_rules import RepetitionLimits

WORDS = r"[^\x20\x09-\x0D]+"


def _covered(k: int) -> str:
    """Words in k-word windows found twice or more, by row."""
    return f"""(SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest(range(i, i+{k})) AS p FROM (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (
        SELECT rid, i, array_to_string(ws[i:i+{k - 1}], ' ') AS g FROM (
          SELECT rid, ws, unnest(range(1, len(ws)-{k}+2)) AS i FROM w))) WHERE c > 1) GROUP BY rid)"""


def quality(limits: RepetitionLimits = RepetitionLimits()) -> str:
    return f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, t, regexp_extract_all(t, '{WORDS}') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(translate(t, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0)::BIGINT AS covered_words, c.n IS NOT NULL AS long_repeat
  FROM w LEFT JOIN {_covered(5)} a USING (rid) LEFT JOIN {_covered(limits.min_repeat)} b USING (rid)
  LEFT JOIN {_covered(limits.max_longest + 1)} c USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (covered_words > {limits.max_covered}::DOUBLE * n_words OR long_repeat) AS kept, covered_words
FROM f"""


_ESCAPED = r"len(regexp_extract_all({0}, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)'))"

CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         20 + length(role) + {_ESCAPED.format("role")} + length(text) + {_ESCAPED.format("text")} AS size FROM t),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS stop, max(i) OVER (PARTITION BY conv_id) AS last FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(stop) FILTER (role = 'assistant' OR i = last)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(t, '{WORDS}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')||':'||md5(t)) AS tie,
         0.25::DOUBLE + 0.75::DOUBLE * length(translate(t, '{JUNK}', '')) / greatest(length(t), 1) AS quality FROM d),
e AS (
  SELECT *, -ln((('0x'||substr(tie, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / quality AS es FROM k),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM k GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM s
  WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, cap >= level * weight AS open, max(level) FILTER (cap >= level * weight) OVER () AS top FROM r),
p AS (SELECT *, CASE WHEN open THEN least(top * weight, cap) ELSE cap END::DOUBLE AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM p),
c AS (
  SELECT e.doc_id, e.source, e.size, q.source_size, q.target, q.epochs, q.target - q.epochs * q.source_size AS rest,
         coalesce(sum(e.size) OVER (PARTITION BY e.source ORDER BY es, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source),
t AS (SELECT *, epochs + (rest > 0 AND 2 * before + size <= 2 * rest)::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, round(target, 6) AS target, (copies * size)::BIGINT AS taken, source, copies FROM t"""


def clusters(k: int = 8, rounds: int = 10) -> str:
    """Long rows (vector, dimension, value); one pair of subqueries a round."""
    steps = [f"""
e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
x AS MATERIALIZED (SELECT rid, unnest(range(1, 65)) AS d, unnest(v) AS x FROM e),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c FROM e QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, d, x FROM s JOIN x USING (rid))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT rid, arg_min(c, [dist, c]) AS c, min(dist) AS dist FROM (
    SELECT rid, c, sum((x.x - c{i}.x) * (x.x - c{i}.x))::BIGINT AS dist FROM x JOIN c{i} USING (d) GROUP BY rid, c) GROUP BY rid)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c, d, coalesce(m, c{i}.x) AS x FROM c{i} LEFT JOIN (
    SELECT c, d, floor(sum(x) / count(*))::BIGINT AS m FROM x JOIN a{i} USING (rid) GROUP BY c, d) USING (c, d))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(dist) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN e USING (rid) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c) n ON n.c = a.c"""


DIVERGENCE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
w AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
t AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM t GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN t USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (
  SELECT lang, source, coalesce(any_value(s.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (t.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN t USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM u QUALIFY part = 'pair' OR rank <= 10"""


JACCARD = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT rid, md5(array_to_string(ws[i:i+2], ' ')) AS g FROM (
    SELECT rid, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS i FROM d)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY x.rid, y.rid)
  JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, m.least) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN (SELECT r.a AS rid, min(d.doc_id) AS least FROM r JOIN d ON d.rid = r.b GROUP BY r.a) m USING (rid)"""
