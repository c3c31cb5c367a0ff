"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat as _chat
from . import context_mixing as _lm
from . import exact_dedup as _exact
from . import hard_negatives as _negatives
from . import lexicon as _lexicon
from . import mixing as _mixing
from . import near_dedup as _near
from . import quality as _quality
from . import sharding as _sharding
from . import suffix_dedup as _suffix
from . import tokens as _tokens
from . import vector_codes as _codes
from . import warc as _warc
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.suffix_dedup(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat.format_chats(documents(spark, sf_dir, "conversations"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.round_trip(documents(spark, sf_dir, "pages"))


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexicon.encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.quality(documents(spark, sf_dir))


def op8_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_components(documents(spark, sf_dir), width=4, percent=80)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(documents(spark, sf_dir))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.score_texts(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives.hard_negatives(documents(spark, sf_dir, "embeddings"))


def op12_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharding.shard(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes.vector_codes(documents(spark, sf_dir, "embeddings"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.ablation_report(documents(spark, sf_dir))


def _lloyd_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The codes by whole tables of distances, round by round."""
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(x::DOUBLE * 1024) FOR x IN embedding] AS c FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, k::INT AS k, c[1 + k * len(c) // {parts}:(k + 1) * len(c) // {parts}] AS c FROM v, range({parts}) AS parts(k)),
        b0 AS MATERIALIZED (SELECT k, (r - 1)::INT AS e, c FROM p WHERE r <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p.k, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (
            SELECT r, p.k, e, list_inner_product(p.c, p.c) - 2 * list_inner_product(p.c, b.c) + list_inner_product(b.c, b.c) AS d FROM p JOIN b{i} b ON p.k = b.k) p GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT k, e, list(floor(s / n) ORDER BY j) AS c FROM (SELECT a.k, a.e, j, sum(p.c[j]) AS s, count(*) AS n FROM a{i} a JOIN p USING (r, k), LATERAL (SELECT unnest(range(1, len(p.c) + 1)) AS j) GROUP BY ALL) GROUP BY k, e),
            b{i + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON b.k = m.k AND b.e = m.e)""")
    steps.append(f"""h AS (SELECT sha256(string_agg(array_to_string([x::BIGINT FOR x IN c], ','), ',' ORDER BY k, e)) AS h FROM b{rounds}),
        o AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN o USING (r), h""")
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_warc": op5_warc,
    "op6_bpe_lexicon": op6_bpe_lexicon,
    "op7_quality_rules": op7_quality_rules,
    "op8_setsketch_near_dedup": op8_setsketch_near_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_context_mixing": op10_context_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_histogram_shards": op12_histogram_shards,
    "op13_vector_codes": op13_vector_codes,
    "quality_ablations": quality_ablations,
}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
    """,
    "op5_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d, min(page_id) OVER (PARTITION BY b) AS f FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to FROM q
    """,
    "op7_quality_rules": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        pos AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM pos) WHERE k > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, range(8) AS r(o) GROUP BY doc_id),
        ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
               FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
               (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
               (length(t) - length(replace(t, '! ', ' ')) + length(t) - length(replace(t, '!' || chr(10), chr(10))) + (CASE WHEN ends_with(t, '!') THEN 1 ELSE 0 END)) AS n_bangs
              FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
        b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
               + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
               + (CASE WHEN n_words > 0 AND word_chars > 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 32 ELSE 0 END)
               + (CASE WHEN 100 * n_bangs > 50 * n_words THEN 64 ELSE 0 END) AS bits FROM m)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
               bits % 4 > 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failed_bits FROM b
    """,
    "op9_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          md5('17:' || coalesce(doc_id::VARCHAR, '')) AS rank FROM documents),
        s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2 AS cap FROM s0),
        s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_below,
                      (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS w_rest,
                      (sum(source_size) OVER ())::BIGINT AS total FROM s1),
        s3 AS (SELECT *, (total * 1.5::DOUBLE - cap_below) / w_rest AS level FROM s2),
        s4 AS (SELECT *, (SELECT arg_min(level, cap_below) FROM s3 WHERE level * w <= cap) AS water FROM s3),
        g AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap::DOUBLE, water * w) END AS target FROM s4),
        h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
        o AS (SELECT d.doc_id, d.size, h.source_size, h.target, h.whole, h.target - h.whole * h.source_size AS rest,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY rank, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
                     sum(d.size) OVER (PARTITION BY d.source, substr(rank, 1, 3))::BIGINT AS in_bucket,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(rank, 1, 3) RANGE UNBOUNDED PRECEDING)::BIGINT AS upto_bucket
              FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
        t AS (SELECT *, least(whole + CASE WHEN upto_bucket <= rest THEN 1 WHEN upto_bucket - in_bucket >= rest THEN 0
                                           WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END, 2)::INT AS repeats FROM o)
        SELECT doc_id, size, source_size, target::DOUBLE AS target, (size * repeats)::BIGINT AS taken, repeats FROM t
    """,
    "op11_hard_negatives": r"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, [floor(x::DOUBLE * 256) FOR x IN embedding] AS c FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5),
        n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.id NULLS LAST)::INT AS rank
              FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
    "op12_histogram_shards": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) || md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
        t AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n) AS c FROM range(256) AS g(n))),
        crc AS (SELECT rid, xor(list_reduce(list_transform(string_split(regexp_replace(hex(b), '(..)', '\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT),
                       lambda a, x: xor(a // 256, t[1 + xor(a % 256, x)]), 4294967295), 4294967295) AS text_crc32 FROM d, t),
        whole AS (SELECT sum(size)::BIGINT AS total FROM d),
        probe AS (SELECT depth, substr(key, 1, depth) AS p, sum(size)::BIGINT AS s FROM d, range(3, 67, 3) AS g(depth) GROUP BY ALL),
        below AS (SELECT depth, p, coalesce(sum(s) OVER (PARTITION BY depth ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM probe
                  UNION ALL SELECT depth, 'g', sum(s)::BIGINT FROM probe GROUP BY depth),
        best AS (SELECT k, depth, min(struct_pack(off := abs(16 * below - k * total), below := below, p := p)) AS m FROM below, whole, range(1, 16) AS g(k) GROUP BY ALL),
        split AS (SELECT k, arg_min(m.p, depth) AS p FROM best, whole WHERE 200 * m.off <= total OR depth = 66 GROUP BY k),
        dealt AS (SELECT d.rid, d.doc_id, d.size, d.key, (SELECT count(*) FROM split WHERE split.p <= d.key)::INT AS shard FROM d)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, NULL::INT AS grown_shard FROM dealt JOIN crc USING (rid)
    """,
    "op13_vector_codes": _lloyd_sql(),
}
#: Every policy's rules by their bits.
_POLICY_ROWS = ", ".join(f"('{v}', '{r}', {1 << i}, {_quality.policy_mask(v)})" for v in _quality.POLICIES for i, r in enumerate(_quality.RULES) if _quality.policy_mask(v) >> i & 1)
ORACLES["quality_ablations"] = f"""
    WITH q AS MATERIALIZED (SELECT failed_bits AS b FROM ({ORACLES["op7_quality_rules"]}))
    SELECT version, rule, count(*) FILTER (b & bit <> 0) AS n_failed, count(*) FILTER (b & mask = bit) AS n_regained, count(*) FILTER (b & mask = 0) AS n_kept
    FROM (VALUES {_POLICY_ROWS}) AS p(version, rule, bit, mask), q GROUP BY ALL
"""
