"""Queries of the text operators for the driver's contract: each reads its whole table and returns the operator's whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import classifier, common, conversations, fingerprint, hyperminhash, langid, licenses, mixing, ngram_join, packing, quality_rules, sharding, substring, vector_codes


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(common.documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))
        WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END)) AS k FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), e AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, m) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON r.doc_id = e.x
), c AS (
    SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # mix_start: -1 for what isn't taken
    return mixing.mix(common.documents(spark, sf_dir)).drop("starts").na.fill(-1, ["mix_start"])


OP2_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(text) AS h FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (
    SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM sources
), levels AS (
    SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM placed
), targets AS (
    SELECT source, source_size, least(most, weight * (SELECT level FROM levels WHERE level * weight <= most ORDER BY most / weight, source LIMIT 1)) AS target FROM levels
), queue AS (
    SELECT doc_id, h, size, source_size, target, row_number() OVER () AS row, coalesce(sum(size) OVER (PARTITION BY s.source
        ORDER BY md5(concat('0:', coalesce(doc_id::VARCHAR, ''), ':', coalesce(h, '')))[1:15], doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), epochs AS (
    SELECT *, e * source_size + first AS start FROM queue, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND e * source_size + first < target
), packets AS (
    SELECT *, CASE WHEN start + size > target THEN (size + 63) // 64 ELSE 1 END AS n FROM epochs
), queued AS (
    SELECT row, doc_id, h, e, p, CASE WHEN n = 1 THEN size ELSE least(64, size - 64 * p) END AS words, (start + CASE WHEN n = 1 THEN size ELSE least(64 * p + 64, size) END)::DOUBLE / target AS finish
    FROM (SELECT *, unnest(range(n)) AS p FROM packets)
), mixed AS (
    SELECT row, words, coalesce(sum(words) OVER (ORDER BY finish, doc_id, h, e, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS mix_start FROM queued
), taken AS (
    SELECT row, sum(least(words, b - mix_start))::BIGINT AS taken, min(mix_start) AS mix_start FROM mixed, (SELECT sum(size) AS b FROM sized) WHERE mix_start < b GROUP BY row
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(mix_start, -1)::BIGINT AS mix_start FROM queue LEFT JOIN taken USING (row)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.documents(spark, sf_dir))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(common.documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(common.documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.shared_passages(common.documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), tokenizer_file())


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(common.documents(spark, sf_dir))


OP11_SQL = OP1_SQL.replace("len(t) >= 5", "len(t) >= 3").replace("len(t) - 3", "len(t) - 1").replace("i + 4", "i + 2").replace(">= 75 *", ">= 85 *").replace("c.component_id FROM", "c.component_id, d.doc_id = c.component_id AS kept FROM")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# crc32 by its table; costs to go from the last row back (b), then the walk (w) from the first one on.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS tab
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
), hashed AS (
    SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM keyed, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE kind <> 0)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), r AS (
    SELECT *, coalesce(list_position(['s', 'u', 'a'], role[1]), 0) AS known, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS wrong,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (wrong = 'blank') AS blank, count(*) FILTER (wrong = 'duplicate') AS duplicate,
        count(*) FILTER (wrong = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id
), b(conv_id, i, f) AS (
    SELECT conv_id, n + 1, [0, 6, 3, 0] FROM facts
    UNION ALL
    SELECT conv_id, i, [least(g[1], g[3] + 3, g[4] + 6), least(g[2], g[3] + 3, g[4] + 6), least(g[3], g[4] + 3), least(g[4], g[3] + 3)] FROM (
        SELECT r.conv_id, r.i, CASE WHEN wrong IN ('blank', 'duplicate') THEN [4 + f[1], 4 + f[2], 4 + f[3], 4 + f[4]] ELSE [
            least(4 + f[1], m + 3 + f[3], CASE known WHEN 1 THEN m + f[2] WHEN 2 THEN m + f[3] END), least(4 + f[2], m + 3 + f[3], CASE known WHEN 2 THEN m + f[3] END),
            least(4 + f[3], m + 3 + f[4], CASE known WHEN 3 THEN m + f[4] END), least(4 + f[4], m + 3 + f[3], CASE known WHEN 2 THEN m + f[3] END)] END AS g
        FROM (SELECT *, CASE WHEN wrong = 'truncated' THEN 3 ELSE 0 END AS m FROM r) r JOIN b ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)
), steps AS (
    SELECT b.conv_id, b.i, b.f, a.f AS after, r.known, r.wrong, r.role, r.text, CASE WHEN wrong = 'truncated' THEN 3 ELSE 0 END AS m
    FROM b LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i LEFT JOIN b a ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.i = b.i + 1
), w(conv_id, i, q, audit, made) AS (
    SELECT conv_id, 1::BIGINT, 1, '', []::VARCHAR[] FROM facts
    UNION ALL
    SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kept ELSE follows END, audit || e,
        CASE e WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text) ELSE list_append(made, CASE follows WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
    FROM (
        SELECT *, CASE WHEN 4 + after[q] = f[q] THEN 'D' WHEN 3 + f[follows] = f[q] THEN 'I' WHEN m + after[kept] = f[q] THEN 'K' ELSE 'R' END AS e FROM (
            SELECT w.*, s.f, s.after, s.m, s.role, s.text, [3, 3, 4, 3][q] AS follows, CASE WHEN known = 1 AND q = 1 THEN 2 WHEN known = 2 AND q IN (1, 2, 4) THEN 3 WHEN known = 3 AND q = 3 THEN 4 END AS kept
            FROM w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i WHERE NOT (s.after IS NULL AND s.f[q] = 0)))
), done AS (
    SELECT w.* FROM w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i WHERE s.after IS NULL AND s.f[q] = 0
), costs AS (
    SELECT conv_id, f[1] AS cost FROM b WHERE i = 1
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN costs ON costs.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_sql() -> str:
    """Six rounds, written out."""
    rounds = "".join(
        f"""), d{i} AS MATERIALIZED (
    SELECT p.row, p.part, min({{d: list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e: b.entry}}) AS best FROM p JOIN b{i} b USING (part) GROUP BY ALL
"""
        + (
            f"""), m{i} AS (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM (
        SELECT part, best.e AS entry, place, sum(v)::HUGEINT AS s, count(*) AS n FROM (SELECT part, best, unnest(x) AS v, unnest(range(len(x))) AS place FROM d{i} JOIN p USING (row, part)) GROUP BY ALL) GROUP BY part, entry
), b{i + 1} AS MATERIALIZED (
    SELECT part, entry, coalesce(m.x::BIGINT[], b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry)
"""
            if i < 6
            else ""
        )
        for i in range(7)
    )
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0
), p AS MATERIALIZED (
    SELECT row, part, x[part * len(x) // 8 + 1:(part + 1) * len(x) // 8] AS x FROM v, range(8) t(part)
), b0 AS (
    SELECT part, row - 1 AS entry, x FROM p WHERE row <= 16
{rounds}), coded AS (
    SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM d6 GROUP BY row
), labels AS (
    SELECT label, sum(error)::BIGINT AS label_error FROM v JOIN coded USING (row) GROUP BY label
)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM b6)) AS codebooks_sha256
FROM v JOIN coded USING (row) JOIN labels l ON v.label IS NOT DISTINCT FROM l.label
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_mixing": op2_mixing,
        "op3_language_id": op3_language_id,
        "op4_fingerprint": op4_fingerprint,
        "op5_license_scan": op5_license_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_sharding": op7_sharding,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_packing": op9_packing,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_minhash_dedup": op11_minhash_dedup,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_mixing": OP2_SQL, "op11_minhash_dedup": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_vector_codes": op13_sql()}
