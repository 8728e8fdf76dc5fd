"""The queries of the corpus operators, each over its whole table, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, hard_negatives, html_extract, license_scan, line_dedup, lm, merkle, packing, quality, sharding, simhash, substring_dedup
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), radius=2, shingle=3)


#: documents as a tree of files: a directory for a source, a language, and 512 ids; every 16th is named as a licence file.
PATH = """
  coalesce(source, '') || CASE doc_id % 48
    WHEN 0 THEN '/LICENSE-' || CAST(doc_id AS VARCHAR(20))
    WHEN 16 THEN '/' || coalesce(lang, '') || '/LICENSE-' || CAST(doc_id AS VARCHAR(20))
    WHEN 32 THEN '/' || coalesce(lang, '') || '/d' || CAST(CAST(floor(doc_id / 512) AS BIGINT) AS VARCHAR(20)) || '/LICENSE-' || CAST(doc_id AS VARCHAR(20))
    ELSE '/' || coalesce(lang, '') || '/d' || CAST(CAST(floor(doc_id / 512) AS BIGINT) AS VARCHAR(20)) || '/f' || CAST(doc_id AS VARCHAR(20)) || '.txt'
  END"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.expr(PATH).alias("path"), "text")
    found = license_scan.licenses(files)
    return found.select(F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long").alias("doc_id"), "*")


def license_sql() -> str:
    idf, other, weights = license_scan.weigh(license_scan.TEMPLATES)
    rows = lambda found: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}" if isinstance(v, int) else f"{v!r}::DOUBLE" for v in r) + ")" for r in found)
    return f"""
WITH files AS (SELECT doc_id, {PATH} AS path, text FROM documents),
common(term, idf) AS (VALUES {rows(idf.items())}),
weights(license_id, template, term, weight) AS (VALUES {rows(weights)}),
lines AS (SELECT path, list_filter(string_split(lower(text), chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM files),
marked AS (SELECT path, l, pos, l[pos] AS line FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS pos FROM lines) WHERE regexp_matches(l[pos], '{license_scan.LICENCE_WORDS}')),
units AS (SELECT path, pos, w AS k, array_to_string(l[pos:pos + w - 1], ' ') AS passage FROM (SELECT *, unnest({list(license_scan.WINDOWS)}) AS w FROM marked) WHERE w = 1 OR pos + w // 2 <= len(l)
  UNION ALL SELECT path, pos, -k, s[k] FROM (SELECT path, pos, s, unnest(range(1, len(s) + 1)) AS k FROM (
    SELECT path, pos, string_split(regexp_replace(line, '([.;!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM marked) WHERE len(s) > 1) WHERE regexp_matches(s[k], '{license_scan.LICENCE_WORDS}')),
words AS (SELECT path, pos, k, unnest(regexp_extract_all(passage, '{license_scan.TERM}')) AS term FROM units),
terms AS (SELECT path, pos, k, w.term, count(*) * coalesce(any_value(idf), {other!r}::DOUBLE) AS v
          FROM words w LEFT JOIN common c ON c.term = w.term GROUP BY path, pos, k, w.term),
length AS (SELECT path, pos, k, sqrt(sum(v * v)) AS n FROM terms GROUP BY path, pos, k),
scores AS (SELECT t.path, t.pos, t.k, license_id, template, sum(v * weight) AS dot FROM terms t JOIN weights w ON w.term = t.term GROUP BY t.path, t.pos, t.k, license_id, template),
own AS (SELECT path, license_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, license_id) AS k FROM (
            SELECT s.path, license_id, round(max(dot / n), 6) AS score FROM scores s JOIN length l ON l.path = s.path AND l.pos = s.pos AND l.k = s.k
            GROUP BY s.path, license_id) WHERE score >= {license_scan.THRESHOLD}) WHERE k = 1),
spoken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license_id, path) AS k FROM (
          SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM own WHERE path LIKE '%/LICENSE-%')) WHERE k = 1),
above AS (SELECT path, d, array_to_string(parts[1:d], '/') AS dir FROM (
          SELECT path, parts, unnest(range(0, len(parts) + 1)) AS d FROM (
            SELECT path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts FROM files ANTI JOIN own USING (path)))),
near AS (SELECT * FROM (SELECT a.path, s.license_id, s.score, s.path AS from_path, row_number() OVER (PARTITION BY a.path ORDER BY d DESC) AS k
          FROM above a JOIN spoken s ON s.dir = a.dir) WHERE k = 1)
SELECT f.doc_id, f.path, coalesce(o.license_id, n.license_id) AS license_id, coalesce(o.score, n.score) AS score,
  CASE WHEN o.path IS NOT NULL THEN 'own' WHEN n.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.path IS NOT NULL THEN o.path ELSE n.from_path END AS from_path
FROM files f LEFT JOIN own o ON o.path = f.path LEFT JOIN near n ON n.path = f.path"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 16)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "lines_before", "lines_removed", "text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mined(rows, F.col("vec_id") % 100 == 0)


HARD_NEGATIVES = """
WITH own AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, row_number() OVER () AS id
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (SELECT a.id AS anchor, a.vec_id AS anchor_id, b.id, b.vec_id, a.label = b.label AS alike, coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v, TRUE)]), 0)::BIGINT AS score
  FROM own a JOIN own b ON a.id <> b.id WHERE a.vec_id % 100 = 0),
good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, id) AS place FROM scores WHERE alike) WHERE place <= 5),
bad AS (SELECT g.anchor_id, g.vec_id AS positive_id, row_number() OVER (PARTITION BY g.anchor, g.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.id) AS rank, s.vec_id AS negative_id, g.score AS positive_score, s.score AS negative_score
  FROM good g JOIN scores s ON s.anchor = g.anchor AND NOT s.alike WHERE 30 * g.score <= 100 * s.score AND 100 * s.score <= 90 * g.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM bad WHERE rank <= 10"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SUBSTRING_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
places AS (SELECT id, doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT run, min(doc_id) AS doc_id FROM places GROUP BY run),
gone AS (SELECT DISTINCT id, unnest(range(i, i + 13)) AS k FROM places p JOIN firsts f ON f.run = p.run WHERE f.doc_id < p.doc_id),
words AS (SELECT id, k, w[k] AS word FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS k FROM docs)),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM words ANTI JOIN gone USING (id, k) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (id)"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def merkle_sql() -> str:
    """The tree level by level, each level's nodes as rows (tree, level, rank, digest); a proof is a node's sibling on each."""
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
    leaf = lambda n: "sha256(" + " || ".join(part(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"

    def climb(levels: str, start: str) -> str:
        return f"""{levels} AS (SELECT tree, 0 AS level, rank, digest FROM {start} UNION ALL
  SELECT tree, level + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {levels}) WHERE n > 1 GROUP BY tree, level, rank // 2)"""

    def walk(name: str, start: str, levels: str) -> str:
        return f"""{name} AS (SELECT id, tree, place, 0 AS level, rank, size, digest, proof FROM {start} UNION ALL
  SELECT w.id, w.tree, w.place, w.level + 1, w.rank // 2, (w.size + 1) // 2, sha256(CASE WHEN s.digest IS NULL THEN w.digest WHEN w.rank % 2 = 1 THEN s.digest || w.digest ELSE w.digest || s.digest END), w.proof || coalesce(s.digest, '')
  FROM {name} w LEFT JOIN {levels} s ON s.tree = w.tree AND s.level = w.level AND s.rank = xor(w.rank, 1) WHERE w.size > 1)"""

    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf('n_chars + 1')} END AS altered FROM documents),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS size,
  row_number() OVER () AS id FROM docs),
bottom AS (SELECT tree, rank, leaf AS digest FROM leaves),
{climb('low', 'bottom')},
tops AS (SELECT 0 AS tree, tree AS rank, arg_max(digest, level) AS digest FROM low GROUP BY tree),
{climb('high', 'tops')},
begun AS (SELECT id, tree, tree AS place, rank, size, coalesce(altered, leaf) AS digest, '' AS proof FROM leaves),
{walk('up', 'begun', 'low')},
amid AS (SELECT id, 0 AS tree, place, place AS rank, (SELECT count(*) FROM tops) AS size, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM up GROUP BY id, place),
{walk('over', 'amid', 'high')},
ended AS (SELECT id, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM over GROUP BY id)
SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM leaves l JOIN ended e ON e.id = l.id JOIN tops t ON t.rank = l.tree CROSS JOIN (SELECT arg_max(digest, level) AS digest FROM high) r"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_fingerprints": op4_fingerprints,
    "op5_html_extraction": op5_html_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op2_license_scan": license_sql(),
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_substring_dedup": SUBSTRING_DEDUP,
    "op13_merkle_manifest": merkle_sql(),
}
