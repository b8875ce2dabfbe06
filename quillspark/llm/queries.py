"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import audit, decontaminate, language, lines, packing, passages, privacy, quality, sharding, simhash, substrings, urls, whitening

WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM p),
f AS (SELECT win, min(doc_id) AS least FROM k GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM k JOIN f USING (win) WHERE least < doc_id),
l AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
r AS (SELECT doc_id, w, coalesce(gone, []::BIGINT[]) AS gone FROM d LEFT JOIN l USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.pos GROUP BY u.doc_id)
SELECT r.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM r LEFT JOIN kept ON r.doc_id = kept.doc_id
"""

# Bytes as pairs of hexadecimal digits; windows by their digest, the earliest of each, and runs of late windows.
OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS win FROM p),
f AS (SELECT win, min(ROW(doc_id, i)) AS least FROM k GROUP BY win HAVING count(*) > 1),
w AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, TRUE) AS new FROM k JOIN f USING (win) WHERE ROW(doc_id, i) > least),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY ALL),
o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
c AS (SELECT o.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM o JOIN d ON d.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1,
        "op2_pii": privacy.op2,
        "op3_language_id": language.op3,
        "op4_substring_dedup": passages.op4,
        "op5_sharding": sharding.op5,
        "op6_simhash_dedup": simhash.op6,
        "op7_decontamination": decontaminate.op7,
        "op8_url_filter": urls.op8,
        "op9_quality_rules": quality.op9,
        "op10_suffix_dedup": substrings.op10,
        "op11_line_dedup": lines.op11,
        "op12_embedding_whitening": whitening.op12,
        "op13_filter_audit": audit.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": OP4_SQL,
        "op7_decontamination": decontaminate.SQL,
        "op8_url_filter": urls.SQL,
        "op9_quality_rules": quality.oracle(),
        "op10_suffix_dedup": OP10_SQL,
        "op11_line_dedup": lines.SQL,
        "op13_filter_audit": audit.SQL,
    }
