"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, license_scan, line_dedup, media, mixing, near_dedup, substring_dedup, topk_search, url_filter
from .common import table

#: Training rows of language ID: about so many a language, so many in all at most.
LID_PER_LANGUAGE, LID_MAX_ROWS = 500, 4000
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("block", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = language_id.learn(docs.where(fold != 1), LID_PER_LANGUAGE, LID_MAX_ROWS, "doc_id", "text", "lang")
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_second", "ambiguous")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS key, s FROM g),
c AS (SELECT key, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY key),
e AS (SELECT rep, n, unnest(s) AS t FROM c),
p AS (SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT rep AS node, rep AS low FROM c UNION SELECT r.node, u.y FROM r JOIN u ON r.low = u.x),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(m.low, k.doc_id) AS component_id, k.doc_id = coalesce(m.low, k.doc_id) AS kept
FROM k LEFT JOIN c ON k.key = c.key LEFT JOIN m ON m.node = c.rep
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM l),
g AS (SELECT doc_id, pos, line, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
k AS (SELECT doc_id, pos, line, len(s) AS n, CASE WHEN len(s) > 0 THEN array_to_string(list_sort(s), chr(10)) END AS key, s FROM g),
c AS (SELECT key, row_number() OVER (ORDER BY min((doc_id, pos))) AS rep, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY key),
e AS (SELECT rep, n, unnest(s) AS t FROM c),
p AS (SELECT b.rep AS y FROM e a JOIN e b ON a.t = b.t AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
f AS (SELECT k.doc_id, k.pos, k.line, k.key IS NOT NULL AND (row_number() OVER (PARTITION BY k.key ORDER BY k.doc_id, k.pos) > 1 OR c.rep IN (SELECT y FROM p)) AS gone
  FROM k LEFT JOIN c ON k.key = c.key),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0)::BIGINT AS n_lines, coalesce(o.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _op5_sql() -> str:
    """The same canonical form in DuckDB; the known texts go through it as well."""

    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canonical(text: str) -> str:
        out = f"regexp_replace(lower({text}), {lit(license_scan.COPYRIGHT_LINE)}, '', 'g')"
        for old, new in license_scan.SIGNS:
            out = f"replace({out}, {lit(old)}, {lit(new)})"
        return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    def spelled(words: str) -> str:
        out = f"(' ' || trim({words}) || ' ')"
        for old, new in license_scan.EQUIVALENT:
            out = f"replace({out}, {lit(' ' + old)}, {lit(' ' + new)})"
        return f"trim({out})"

    def one_line(form: str) -> str:
        return spelled(f"regexp_replace({form}, '[ \\n]+', ' ', 'g')")

    known = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in license_scan.KNOWN.items())
    return f"""
WITH known(license, body) AS (VALUES {known}),
named AS (SELECT sha256({one_line(canonical("body"))}) AS digest, min(license) AS license FROM known GROUP BY 1),
forms AS (SELECT doc_id, {canonical("text")} AS form FROM documents),
split AS (SELECT doc_id, unnest(string_split(form, chr(10))) AS line FROM forms),
lines AS (SELECT doc_id, {spelled("line")} AS line FROM split),
found AS (SELECT l.doc_id, string_agg(DISTINCT n.license, ',' ORDER BY n.license) AS notices FROM lines l JOIN named n ON sha256(l.line) = n.digest WHERE l.line <> '' GROUP BY l.doc_id)
SELECT f.doc_id, n.license, x.notices
FROM forms f LEFT JOIN named n ON {one_line("f.form")} <> '' AND sha256({one_line("f.form")}) = n.digest LEFT JOIN found x ON f.doc_id = x.doc_id
"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP6_SQL = r"""
WITH rules(verdict, rule_host, rule_path, rule, depth) AS (VALUES
  ('block', 'com', '/en/', 'com/en/', 1), ('allow', 'example.com', '/en/7', 'example.com/en/7', 2),
  ('block', 'net', '/de/', 'net/de/', 1), ('block', 'example.net', '/de/8', 'example.net/de/8', 2),
  ('block', 'org', '/es/', 'org/es/', 1)),
cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY r.depth DESC, length(r.rule_path) DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position")


OP8_SQL = r"""
WITH sized AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
src AS (SELECT source, sum(size) AS total FROM sized GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM src),
f AS (SELECT *, sum(total) OVER () AS everything,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS left_weight,
  coalesce(sum(total) OVER (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS used FROM w),
l AS (SELECT *, (everything::DOUBLE - used::DOUBLE) / left_weight AS level FROM f),
c AS (SELECT *, min(CASE WHEN (total * 3)::DOUBLE > level * weight THEN total / weight END) OVER () AS a FROM l),
g AS (SELECT *, (SELECT level FROM c AS d WHERE d.total / d.weight = d.a ORDER BY level LIMIT 1) AS rest FROM c),
t AS (SELECT source, total, CASE WHEN a IS NULL OR total / weight < a THEN (total * 3)::DOUBLE ELSE least((total * 3)::DOUBLE, rest * weight) END AS target, (weight - 1) / 6 AS start FROM g),
m AS (SELECT p.doc_id, p.size, t.total, t.target, t.start, p.before + p.size / 2 AS middle
  FROM placed p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN size > 0 THEN (middle <= target)::INT + (middle + total <= target)::INT + (middle + 2 * total <= target)::INT ELSE 0 END AS passes FROM m)
SELECT doc_id, size, total::BIGINT AS source_size, target, (size * passes)::BIGINT AS taken,
  CASE WHEN passes > 0 THEN start + (1 - start) * (sqrt(0.25 + 2 * least(1.0, middle / target)) - 0.5) END AS position
FROM n
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS h FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS n FROM v) WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
z AS (SELECT x.doc_id, x.p, x.word, max(r.pos) OVER (PARTITION BY x.doc_id ORDER BY x.p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
  FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.p = r.pos),
o AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE last IS NOT NULL AND p < last + 20) AS gone, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE last IS NULL OR p >= last + 20), '') AS kept FROM z GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n, 0)::BIGINT AS n_words, coalesce(o.gone, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_near_dedup": op2_near_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_media_columns": op4_media_columns,
        "op5_license_scan": op5_license_scan,
        "op6_url_filter": op6_url_filter,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_mix_sources": op8_mix_sources,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_topk_search": op10_topk_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_license_scan": _op5_sql(), "op9_substring_dedup": OP9_SQL, "op6_url_filter": OP6_SQL, "op8_mix_sources": OP8_SQL, "op10_topk_search": OP10_SQL}
