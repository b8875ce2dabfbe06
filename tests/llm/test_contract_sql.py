"""What SQL can tell of the queries that have no SQL of their own, over whole tables."""

from __future__ import annotations

import os
import zlib

import duckdb
import pytest

from quillspark.llm import queries

SF = "/root/testdata/sf0.01"
SEQUENCE, SHARDS, RADIUS = 4096, 40, 4

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def result(spark, name, folder):
    """DuckDB with the documents and the query's rows as `out`."""
    path = str(folder / name)
    queries.queries()[name](spark, SF).write.parquet(path)
    con = duckdb.connect()
    con.create_function("crc32", lambda s: zlib.crc32(s.encode()), ["VARCHAR"], "BIGINT")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE VIEW out AS SELECT * FROM '{path}/*.parquet'")
    return con


def differences(con, got, want):
    """How many rows the two queries do not share, repeats counted."""
    return con.execute(f"SELECT count(*) FROM ((({got}) EXCEPT ALL ({want})) UNION ALL (({want}) EXCEPT ALL ({got})))").fetchone()[0]


def one(con, sql):
    return con.execute(sql).fetchone()[0]


def test_packing(spark, tmp_path):
    con = result(spark, "op1_best_fit_packing", tmp_path)
    assert differences(con, "SELECT DISTINCT doc_id FROM out", "SELECT doc_id FROM documents") == 0
    # Pieces follow each other within a document; all but the last are full.
    wrong_pieces = f"""
    SELECT count(*) FROM (SELECT *, row_number() OVER w - 1 AS place, sum(length) OVER w - length AS before, lead(piece) OVER w IS NULL AS final
      FROM out WINDOW w AS (PARTITION BY doc_id ORDER BY piece))
    WHERE piece <> place OR start <> before OR length < 1 OR length > {SEQUENCE} OR (NOT final AND length <> {SEQUENCE})"""
    assert one(con, wrong_pieces) == 0
    # Offsets of a sequence are gapless from 0 and end within it.
    wrong_places = f"""
    SELECT count(*) FROM (SELECT *, coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM out)
    WHERE "offset" <> before OR "offset" + length > {SEQUENCE}"""
    assert one(con, wrong_places) == 0
    # No two sequences could be one: at most one of them is half full or less.
    assert one(con, f"SELECT count(*) FROM (SELECT sum(length) AS n FROM out GROUP BY sequence_id) WHERE 2 * n <= {SEQUENCE}") <= 1


def test_personal_data(spark, tmp_path):
    """The base counts, by regular expressions, parts of addresses, Luhn sums and numbers of digits."""
    con = result(spark, "op2_pii", tmp_path)
    want = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    f AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails,
      list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::HUGEINT)) <= 255) AS ips,
      list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: list_transform(string_split(reverse(regexp_replace(x, '[^0-9]', '', 'g')), ''), lambda c: c::INT)) AS runs,
      list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15) AS phones FROM t),
    c AS (SELECT *, list_filter(runs, lambda d: len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(d, lambda v, i: CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END)) % 10 = 0) AS cards FROM f)
    SELECT doc_id, len(emails), len(ips), len(cards), len(phones) FROM c"""
    assert differences(con, "SELECT doc_id, n_email, n_ip, n_card, n_phone FROM out", want) == 0
    assert con.execute("SELECT least(sum(n_email), sum(n_ip), sum(n_card), sum(n_phone)) FROM out").fetchone()[0] > 0
    # All spans hold the base ones, and every base span is spelled once.
    counts = " AND ".join(f"len(list_filter(s, lambda x: starts_with(x, '{k}:'))) = n_{k}" for k in ("email", "ip", "card", "phone"))
    assert one(con, f"SELECT count(*) FROM (SELECT *, string_split(spans, ',') AS s FROM out) WHERE NOT ({counts})") == 0


def test_language(spark, tmp_path):
    con = result(spark, "op3_language_id", tmp_path)
    assert differences(con, "SELECT doc_id, held_out FROM out", "SELECT doc_id, crc32(doc_id::VARCHAR) % 4 = 2 FROM documents") == 0
    assert differences(con, "SELECT doc_id FROM out WHERE lang_pred = 'und'", r"SELECT doc_id FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '\p{L}')") == 0
    learned = "SELECT lang FROM documents WHERE lang IS NOT NULL AND crc32(doc_id::VARCHAR) % 4 <> 2"
    assert one(con, f"SELECT count(*) FROM out WHERE (lang_pred <> 'und' AND lang_pred NOT IN ({learned})) OR NOT coalesce(score BETWEEN 0 AND 1, FALSE)") == 0
    assert one(con, "SELECT avg((lang = lang_pred)::INT) FROM out JOIN documents USING (doc_id) WHERE held_out AND text IS NOT NULL AND lang IS NOT NULL") > 0.95


def test_shards(spark, tmp_path):
    con = result(spark, "op5_sharding", tmp_path)
    want = "SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16, crc32(coalesce(text, '')), 'rows', NULL::INT FROM documents"
    assert differences(con, "SELECT doc_id, size, text_crc32, law, grown_shard FROM out", want) == 0
    shards = con.execute("SELECT shard, count(*) AS n, min(slot), max(slot), count(DISTINCT slot) FROM out GROUP BY shard ORDER BY shard").fetchall()
    assert [s[0] for s in shards] == list(range(SHARDS)) and max(s[1] for s in shards) - min(s[1] for s in shards) <= 1
    assert all((low, high, distinct) == (0, n - 1, n) for _, n, low, high, distinct in shards)
    # Every shard has each source's share of rows, up to rounding.
    off = f"""SELECT max(abs(n - total / {SHARDS}.0)) FROM (SELECT shard, source, count(*) AS n FROM out GROUP BY ALL) JOIN (SELECT source AS s, count(*) AS total FROM out GROUP BY ALL) ON s IS NOT DISTINCT FROM source"""
    assert one(con, off) <= 2


def test_components(spark, tmp_path):
    """Components follow from the fingerprints: all links within the radius, and what they reach."""
    con = result(spark, "op6_simhash_dedup", tmp_path)
    assert differences(con, "SELECT doc_id FROM out", "SELECT doc_id FROM documents") == 0
    con.execute("CREATE TABLE f AS SELECT ('0x' || fingerprint)::UBIGINT AS f, min(doc_id) AS least FROM out GROUP BY 1")
    con.execute(f"CREATE TABLE links AS SELECT a.f AS a, b.f AS b FROM f a JOIN f b ON a.f <> b.f AND bit_count(xor(a.f, b.f)) <= {RADIUS}")
    assert one(con, "SELECT count(*) FROM links") > 0
    want = """
    WITH RECURSIVE reach(a, b) AS (SELECT f, f FROM f UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    c AS (SELECT a, min(least) AS least FROM reach JOIN f ON f = b GROUP BY a)
    SELECT doc_id, least FROM out JOIN c ON ('0x' || fingerprint)::UBIGINT = a"""
    assert differences(con, "SELECT doc_id, component_id FROM out", want) == 0
