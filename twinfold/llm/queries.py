"""The registered queries of this subpackage: each applies one operator to its whole table, under the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, langid, licenses, lmscore, media, merkle, mixing, neardup, online, packing, quality, repair, urls
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_pages(spark, table(spark, sf_dir, "pages"))


def op11_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.pack_online(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


_MERKLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER o AS nx, lead(doc_id) OVER o AS nid, first_value(coalesce(text, '')) OVER o AS fx, first_value(doc_id) OVER o AS fid FROM documents WINDOW o AS (ORDER BY doc_id)),
e AS (SELECT doc_id, coalesce(nid, fid) AS nid, t, substr(t, 1, length(t) - length(t) // 2) || substr(coalesce(nx, fx), 1, length(t) // 2) AS ed FROM d),
x AS (SELECT doc_id, 'own' AS kind, t FROM e UNION ALL SELECT doc_id, 'edited', ed FROM e),
p AS (SELECT doc_id, kind, list_transform(string_split(t, chr(10)), lambda q: {'node': md5(q), 'pieces': list_transform(regexp_extract_all(q, '[^.!?]{1,96}[.!?]*|[.!?]+'), lambda y: substr(md5(y), 1, 12))}) AS ps FROM x),
f AS (SELECT doc_id, kind, regexp_replace(array_to_string(list_transform(ps, lambda q: array_to_string(q.pieces, '') || ':' || q.node), ';'), '([01]);', '\1|', 'g') AS tree, flatten(list_transform(ps, lambda q: q.pieces)) AS leaves FROM p),
g AS (SELECT doc_id, kind, sha256(array_to_string(list_transform(string_split(tree, '|'), lambda s: sha256(s)), '')) AS root, tree, len(leaves) AS n, leaves FROM f),
c AS (SELECT doc_id, kind, h, count(*) AS k FROM (SELECT doc_id, kind, unnest(leaves) AS h FROM g) GROUP BY ALL),
se AS (SELECT a.doc_id, sum(least(a.k, b.k)) AS k FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.h = b.h AND a.kind = 'own' AND b.kind = 'edited' GROUP BY 1),
sn AS (SELECT a.doc_id, sum(least(a.k, b.k)) AS k FROM c a JOIN e ON e.doc_id = a.doc_id JOIN c b ON b.doc_id = e.nid AND b.h = a.h AND a.kind = 'own' AND b.kind = 'own' GROUP BY 1)
SELECT e.doc_id, length(e.t) AS n_chars, sha256(e.ed) AS edited_sha256, o.root || '#' || o.tree AS fingerprint, w.root || '#' || w.tree AS edited_fingerprint,
CASE WHEN o.n + w.n = 0 THEN 1.0 ELSE 2.0::DOUBLE * coalesce(se.k, 0)::DOUBLE / (o.n + w.n) END AS near_edited, CASE WHEN o.n + m.n = 0 THEN 1.0 ELSE 2.0::DOUBLE * coalesce(sn.k, 0)::DOUBLE / (o.n + m.n) END AS near_next, o.root
FROM e JOIN g o ON o.doc_id = e.doc_id AND o.kind = 'own' JOIN g w ON w.doc_id = e.doc_id AND w.kind = 'edited' JOIN g m ON m.doc_id = e.nid AND m.kind = 'own' LEFT JOIN se ON se.doc_id = e.doc_id LEFT JOIN sn ON sn.doc_id = e.doc_id
"""

_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT u AS doc_id, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, w.doc_id = coalesce(m.root, w.doc_id) AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""

_URLS = r"""
WITH h AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM h),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.|:(80|443)$', '') || regexp_replace(path, '(/|\.html)$', '') END AS canonical FROM p),
m AS (SELECT canonical, min(page_id) AS page_id, md5(CASE WHEN contains(html, '<article>') AND contains(string_split(html, '<article>')[-1], '</article>') THEN nullif(string_split(string_split(html, '<article>')[-1], '</article>')[1], '') END) AS digest FROM c WHERE canonical IS NOT NULL GROUP BY ALL),
spam AS (SELECT DISTINCT m.canonical FROM m JOIN m o ON o.digest = m.digest AND o.canonical <> m.canonical AND (o.page_id, o.canonical) < (m.page_id, m.canonical)),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT page_id, max({'n': length(h || p), 'rule': h || p, 'verdict': verdict}) AS best FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT c.page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict WHEN spam.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, c.canonical FROM c LEFT JOIN f ON f.page_id = c.page_id LEFT JOIN spam ON spam.canonical = c.canonical
"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (s.n + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (l.n + 5 * l.v) AS q FROM s JOIN l ON l.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express; tests/llm compares the others with brute force."""
    return {"op4_merkle_fingerprint": _MERKLE, "op5_minhash_near_dedup": _NEAR, "op7_url_filter": _URLS, "op12_source_divergence": _DIVERGENCE}
