"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from satchel.llm import collocations, exact_dedup, lm_scoring, mixing, near_dedup, neighbours, packing, quality, resampling, secrets, token_counts, toxicity, url_filter
from satchel.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("row_id")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_lm_scoring,
        op2_toxicity,
        op3_url_filter,
        op4_exact_dedup,
        op5_source_mixing,
        op6_token_counts,
        op7_best_fit_packing,
        op8_quality_classifier,
        op9_nearest_neighbours,
        op10_minhash_near_dedup,
        op11_phrase_mining,
        op12_importance_resampling,
        op13_secret_scan,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_HOST = f"translate(coalesce(regexp_extract({{0}}, '^(?s:.*?)://([^/?#]*)', 1), ''), {_UPPER})"
_PATH = "coalesce(regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
#: The rules, longest first, over columns host and path.
_RULE = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(url_filter.RULES, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), reverse=True)
) + " END"
_VERDICT = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in url_filter.RULES) + " END"
_BARE = "regexp_replace(trim({0}, ' '), '#.*$', '')"


def _plain(url: str) -> str:
    bare = _BARE.format(url)
    rest = f"regexp_extract({bare}, '^[^:/?#]*://[^/?#]*(.*)$', 1)"
    scheme = f"regexp_extract({bare}, '^([^:/?#]*)://', 1)"
    return f"CASE WHEN {scheme} = '' THEN {bare} ELSE lower({scheme}) || '://' || {_HOST.format(bare)} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


def _attribute_sql(name: str) -> str:
    pattern = rf"""(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return "(" + " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3)) + ")"


def _referenced(x: str) -> str:
    for said, meant in url_filter.REFERENCES.items():
        x = f"replace({x}, '{said}', '{meant.replace(chr(39), chr(39) * 2)}')"
    return x


def _steps(path: str) -> str:
    """A path without its ``.`` and up to eight of its ``..`` steps."""
    path = f"regexp_replace(regexp_replace({path}, '(/\\.)+/', '/', 'g'), '/\\.$', '/')"
    for _ in range(8):
        path = f"regexp_replace({path}, '^((?:/[^/]*)*?)/(?:[^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\.(/|$)', '\\1/')"
    return f"regexp_replace({path}, '^(/\\.\\.)+(/|$)', '/')"


_OWN = r"regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1)"
_WAY = r"regexp_extract(t, '(?s)^([^?#]*)', 1)"
_TARGET = rf"""CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN scheme = '' THEN NULL WHEN starts_with(t, '//') THEN scheme || ':' || t
  WHEN host = '' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  ELSE scheme || '://' || host || {_steps(f"CASE WHEN {_WAY} = '' THEN CASE WHEN {_OWN} = '' THEN '/' ELSE {_OWN} END WHEN starts_with(t, '/') THEN {_WAY} ELSE CASE WHEN {_OWN} = '' THEN '/' ELSE regexp_extract({_OWN}, '(?s)^(.*/)', 1) END || {_WAY} END")} || regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) END"""
_REFRESH = r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["'']?\s*([^"'']+)"""
_FOUND = rf"""SELECT url, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1) AS host, regexp_replace({_referenced('said')}, '^\s+|\s+$', '', 'g') AS t FROM (
    SELECT url, CASE WHEN regexp_matches(tag, '(?i)^<link') THEN CASE WHEN list_contains(regexp_split_to_array(lower(trim({_attribute_sql('rel')})), '\s+'), 'canonical') THEN {_attribute_sql('href')} END
      WHEN lower(trim({_attribute_sql('http-equiv')})) = 'refresh' THEN regexp_extract({_attribute_sql('content')}, '{_REFRESH}', 1) END AS said
    FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL))"""

ORACLE = {
    "op3_url_filter": f"""
        WITH RECURSIVE judged AS (SELECT page_id, url, host, path, {_RULE} AS rule FROM (SELECT page_id, url, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM pages)),
        found AS ({_FOUND}), targets AS (SELECT url, {_TARGET} AS t FROM found WHERE t <> ''),
        edges AS (SELECT DISTINCT {_plain('url')} AS a, {_plain('t')} AS b FROM targets WHERE t IS NOT NULL),
        ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
        reach(a, b) AS (SELECT a, a FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
        nodes AS (SELECT b, {_VERDICT} AS v FROM (SELECT b, {_RULE} AS rule FROM (SELECT b, {_HOST.format('b')} AS host, {_PATH.format('b')} AS path FROM (SELECT DISTINCT b FROM reach)))),
        blocked AS (SELECT r.a FROM reach r JOIN nodes n ON r.b = n.b GROUP BY r.a HAVING max(CAST(n.v = 'block' AS INT)) = 1 AND coalesce(max(CAST(n.v = 'allow' AS INT)), 0) = 0)
        SELECT page_id, host, path, rule, coalesce({_VERDICT}, CASE WHEN blocked.a IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM judged LEFT JOIN blocked ON {_plain('url')} = blocked.a""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)""",
    "op11_phrase_mining": rf"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\n\x0b\f\r]')) AS piece FROM documents),
        words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda x: x <> '') AS w FROM pieces),
        runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS run FROM words, (VALUES (1), (2), (3)) t(k)),
        f AS (SELECT lang, k, array_to_string(run, ' ') AS phrase, any_value(run) AS run, count(*) AS a FROM runs GROUP BY 1, 2, 3),
        n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY 1),
        c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
        cuts AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
                FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
                JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.run[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.run[cut + 1:], ' ')),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        held AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN (SELECT lang, a, unnest([array_to_string(run[1:2], ' '), array_to_string(run[2:3], ' ')]) AS part FROM c WHERE k = 3) b ON b.lang = s.lang AND b.part = s.phrase AND 100 * b.a >= 50 * s.a),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest ANTI JOIN held USING (lang, phrase))
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_importance_resampling": rf"""
        WITH words AS (SELECT d, id, regexp_extract_all(norm, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM
          (SELECT 1 AS d, doc_id AS id, {_LOWER} AS norm FROM documents UNION ALL SELECT 2, 0, {_LOWER} FROM benchmark)),
        runs AS (SELECT d, id, len(w) AS n, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
        crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) AS t),
        seen AS (SELECT d, feature, count(*) AS n FROM (SELECT d, unnest(f) AS feature FROM runs) GROUP BY 1, 2),
        named AS (SELECT feature, xor(list_reduce(list_transform(range(len(hex(feature)) // 2), lambda k: CAST('0x' || hex(feature)[2 * k + 1:2 * k + 2] AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
                  FROM (SELECT DISTINCT feature FROM seen), crc),
        sums AS (SELECT bucket, coalesce(sum(n) FILTER (d = 1), 0) AS s, coalesce(sum(n) FILTER (d = 2), 0) AS t FROM seen JOIN named USING (feature) GROUP BY 1),
        gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM sums),
        total AS (SELECT id, n, len(f) AS k, unnest(CASE WHEN len(f) > 0 THEN f ELSE [NULL] END) AS feature FROM runs WHERE d = 1),
        weighed AS (SELECT id, any_value(n) AS n, any_value(k) AS k, coalesce(CAST(floor(sum(g)::DOUBLE / any_value(k)) AS BIGINT), 0) AS weight FROM total LEFT JOIN named USING (feature) LEFT JOIN gain USING (bucket) GROUP BY id),
        scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, id) AS p, 25 * count(*) FILTER (n >= 20) OVER () // 100 AS drawn FROM scored)
        SELECT id AS doc_id, k AS n_features, weight, score, CASE WHEN n >= 20 AND p <= drawn THEN p END AS rank FROM placed""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
