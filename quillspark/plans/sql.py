"""DuckDB SQL of the stand-in data and the regimes, for the correctness check."""

from __future__ import annotations

from quillspark.functions.columns import _ACCENTED, _PLAIN
from quillspark.functions.constants import RANK_WEIGHTS, TAGS
from quillspark.operators.evaluate import MIXER, POISSON, ROUND_STEP
from quillspark.plans.regimes import Regime

CODE = "['u','p','b','g','g2','y','o'][({k}) % 16 + 1]"
WEIGHT = "CASE {c} " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in RANK_WEIGHTS.items()) + " ELSE 0 END"
_STRIP = r"regexp_replace({x}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"

UNITS = rf"""WITH notes AS (SELECT doc_id AS note_uid, CAST(substr(source, 4) AS INT) AS page_id, left(string_split(text, chr(10))[1], 60) AS caption,
 {CODE.format(k='doc_id * 5')} AS node_color, source || ' > ' || lang AS tree_path, TIMESTAMP '2020-01-01' + INTERVAL (doc_id % 1000) DAY AS date_created, text FROM documents),
cut AS (SELECT note_uid, page_id, caption, tree_path, date_created, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_index FROM notes),
lines AS (SELECT *, {CODE.format(k='note_uid * 7 + line_index * 3')} AS color, (note_uid + line_index) % 5 = 0 AS is_bold, {_STRIP.format(x='raw')} AS strip,
 coalesce(sum(length(raw) + 1) OVER (PARTITION BY note_uid ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM cut),
flat AS (SELECT note_uid, page_id, caption, tree_path, date_created, line_index, strip AS text, color, is_bold, {WEIGHT.format(c='color')} + CASE WHEN color IS NOT NULL AND is_bold THEN 0.5 ELSE 0 END AS effective_weight, 'content' AS source_type FROM lines WHERE strip <> ''
 UNION ALL SELECT note_uid, page_id, caption, tree_path, date_created, -1, {_STRIP.format(x='caption')}, node_color, FALSE, {WEIGHT.format(c='node_color')} + CASE WHEN node_color IS NOT NULL THEN 0.5 ELSE 0 END, 'treenode' FROM notes
 WHERE {_STRIP.format(x='caption')} <> '' AND NOT regexp_full_match({_STRIP.format(x='caption')}, '[\s=\-_x*#~]{{3,}}|\[BR[23]\]')),
marked AS (SELECT *, note_uid * 1048576 + line_index + 1 AS unit_id, regexp_full_match(text, '[\s=\-_x*#~]{{3,}}|\[BR[23]\]') AS is_separator, color IS NULL AND length(text) <= 4 AS is_trivial,
 {_STRIP.format(x=r"regexp_replace(lower(text), '[\s\x{{00A0}}]+', ' ', 'g')").replace('{{', '{').replace('}}', '}')} AS text_normalized FROM flat),
units AS (SELECT *, NOT is_separator AND NOT is_trivial AND unit_id > min(CASE WHEN NOT is_separator AND NOT is_trivial THEN unit_id END) OVER (PARTITION BY page_id, text_normalized) AS is_duplicate FROM marked)"""

TREE = """WITH RECURSIVE nodes AS (SELECT 1 AS page_id, r_regionkey + 1 AS id, -1 AS parent_id, r_name AS caption, 0::BIGINT AS chars FROM region
 UNION ALL SELECT 1, n_nationkey + 100, n_regionkey + 1, n_name, 0 FROM nation
 UNION ALL SELECT 1, c_custkey + 1000, c_nationkey + 100, c_name, floor(abs(c_acctbal))::BIGINT FROM customer
 UNION ALL SELECT 1, s_suppkey + 100000000, s_nationkey + 100, s_name, floor(abs(s_acctbal))::BIGINT FROM supplier),
tree AS (SELECT page_id, id::BIGINT AS id, 0 AS depth, id::VARCHAR AS path, left(caption, 50) AS caption_path, left(caption, 40) AS crumbs, [id::BIGINT] AS ids, chars FROM nodes WHERE parent_id = -1
 UNION ALL SELECT n.page_id, n.id::BIGINT, t.depth + 1, t.path || '/' || n.id, t.caption_path || ' > ' || left(n.caption, 30), t.crumbs || ' > ' || left(n.caption, 40), list_append(t.ids, n.id::BIGINT), n.chars FROM nodes n JOIN tree t ON n.parent_id = t.id)"""

RUNS = """WITH scores AS (SELECT user_id::VARCHAR AS question_id, event_type AS regime, avg(value) AS score FROM events GROUP BY ALL),
runs AS (SELECT event_id AS run_id, user_id::VARCHAR AS question_id, event_type AS regime FROM events),
ratings AS (SELECT event_id AS run_id, round(value, 2) AS overall, CASE WHEN event_id % 4 <> 0 THEN event_id % 101 END AS correctness, event_id % 2 = 0 AS blind FROM events WHERE event_id % 3 <> 0)"""

COPIED = """SELECT h.query_id, string_agg(CASE WHEN c.color IS NULL THEN c.text ELSE '[' || upper(c.color) || CASE WHEN c.is_bold THEN '*' ELSE '' END || '] (' || c.tree_path || ')' || chr(10) || c.text END,
 chr(10) || chr(10) ORDER BY h.rank) AS context FROM result h JOIN corpus c USING (unit_id) GROUP BY h.query_id"""
_TAG = "CASE c.color " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " END"
PROMPT = f"""SELECT query_id, string_agg(shown, chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT *, sum(length(shown) + 2) OVER (PARTITION BY query_id ORDER BY rank) - 2 + 2000 AS chars FROM
 (SELECT h.query_id, h.rank, '[' || h.rank || ']' || coalesce(' [' || {_TAG} || CASE WHEN c.is_bold THEN '*' ELSE '' END || ']', '') || ' (' || c.tree_path || ')' || chr(10) || c.text AS shown FROM result h JOIN corpus c USING (unit_id)))
 WHERE chars / 4 <= 2296 GROUP BY query_id"""

_LABEL = "length(text) < 15 AND NOT regexp_matches(text, '[.!?\"]')"
TIER_SQL = f"""{UNITS}, good AS (SELECT * FROM units WHERE NOT is_trivial AND NOT is_separator AND NOT is_duplicate AND length(trim(text)) > 12 AND length(text) >= 15 AND NOT ({_LABEL})),
tiers AS (SELECT *, CASE WHEN color IN ('u', 'p') THEN 0 WHEN color = 'b' THEN 1 WHEN color IN ('g', 'g2') THEN 2 WHEN color IS NULL AND is_bold THEN 5 END AS tier FROM good WHERE color IN ('u', 'p', 'b', 'g', 'g2') OR (color IS NULL AND is_bold))"""

_TOKENS = rf"list_filter(string_split_regex(translate(lower({{x}}), '{_ACCENTED}', '{_PLAIN}'), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda w: w <> '')"
CORPUS = rf"""WITH corpus AS (SELECT doc_id AS unit_id, doc_id // 10 AS note_uid, text, {CODE.format(k='doc_id * 7')} AS color, doc_id % 5 = 0 AS is_bold,
 {WEIGHT.format(c=CODE.format(k='doc_id * 7'))} + CASE WHEN {CODE.format(k='doc_id * 7')} IS NOT NULL AND doc_id % 5 = 0 THEN 0.5 ELSE 0 END AS effective_weight,
 {WEIGHT.format(c=CODE.format(k='label % 7'))} AS section_weight, embedding::DOUBLE[] AS vector, source || ' > ' || lang AS tree_path FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
words AS (SELECT unit_id, unnest({_TOKENS.format(x='text')}) AS term FROM corpus),
lengths AS (SELECT unit_id, len({_TOKENS.format(x='text')}) AS length FROM corpus),
size AS (SELECT count(*) AS n, avg(length) AS average FROM lengths),
asked AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9'']{{3,}}')) AS raw FROM benchmark),
terms AS (SELECT query_id, row_number() OVER () AS phrase, translate(lower(raw), '{_ACCENTED}', '{_PLAIN}') AS term FROM asked),
tf AS (SELECT query_id, phrase, unit_id, count(*) AS tf FROM terms JOIN words USING (term) GROUP BY ALL),
df AS (SELECT query_id, phrase, count(*) AS df FROM tf GROUP BY ALL),
bm25 AS (SELECT query_id, unit_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 9) AS score
 FROM tf JOIN df USING (query_id, phrase) JOIN lengths USING (unit_id) CROSS JOIN size GROUP BY query_id, unit_id)"""


def bootstrap_sql(scores: str, rounds: int = 4000, seed: int = 1) -> str:
    """CTEs up to `intervals` (regime, low, high) over scores (regime, question_id, score), with the same draws."""

    def mixed(name: str, source: str) -> str:
        half = lambda old, new, by: f"{name}{new} AS (SELECT * EXCLUDE x, (xor(x >> 16, x) * {MIXER}) & 4294967295 AS x FROM {by})"
        return f"{half(0, 1, source)}, {half(1, 2, name + '1')}, {name} AS (SELECT * EXCLUDE x, xor(x >> 16, x) AS x FROM {name}2)"

    times = " + ".join(f"(x >= {t})::BIGINT" for t in POISSON)
    return f"""keyed AS (SELECT regime, score AS v, (('0x' || left(md5(question_id), 8))::BIGINT + {seed}) % 4294967296 AS x FROM {scores} WHERE score IS NOT NULL),
{mixed('m', 'keyed')},
rounds AS (SELECT regime, v, r AS round, (x + ((r * {ROUND_STEP}) & 4294967295)) & 4294967295 AS x FROM m, range({rounds}) t(r)),
{mixed('w', 'rounds')},
drawn AS (SELECT regime, round, v, {times} AS times FROM w),
means AS (SELECT regime, round, sum(times * v) / sum(times) AS mean FROM drawn GROUP BY ALL HAVING sum(times) > 0),
ranked AS (SELECT regime, mean, row_number() OVER (PARTITION BY regime ORDER BY mean, round) - 1 AS place, count(*) OVER (PARTITION BY regime) AS n FROM means),
counted AS (SELECT regime, count(*) AS values_ FROM keyed GROUP BY regime),
intervals AS (SELECT regime, CASE WHEN any_value(values_) < 2 THEN 'NaN'::DOUBLE ELSE min(CASE WHEN place = floor(n * 0.025) THEN mean END) END AS low, CASE WHEN any_value(values_) < 2 THEN 'NaN'::DOUBLE ELSE min(CASE WHEN place = floor(n * 0.975) THEN mean END) END AS high
 FROM ranked JOIN counted USING (regime) GROUP BY regime)"""


def regime_sql(r: Regime, final: str = "SELECT query_id, rank, unit_id, round(score, 6) AS score, source FROM result") -> str:
    """The regime over the stand-in corpus."""
    floor = "TRUE" if r.min_weight is None else f"effective_weight >= {r.min_weight}"
    top = "least(greatest(coalesce({w}, 0), 0), 5.5) / 5.5"
    # The stated query set of vectors; pooled retrieval takes each question's own.
    asked = "vec_id IN (SELECT item_id FROM benchmark)" if r.retriever == "pooled" else "vec_id % 100 = 0"

    def lexical(k: int) -> str:
        return f"""first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM bm25) WHERE r <= {4 * k}),
lex AS (SELECT query_id, unit_id, score, rank FROM (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM first JOIN corpus USING (unit_id) WHERE {floor}) WHERE rank <= {k})"""

    def dense(k: int) -> str:
        return f"""cosines AS (SELECT q.unit_id AS query_id, c.unit_id, list_cosine_similarity(c.vector, q.vector) * (1 + {r.alpha} * {top.format(w='c.effective_weight')}) * (1 + {r.beta} * {top.format(w='c.section_weight')}) AS score
 FROM corpus c, (SELECT vec_id AS unit_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE {asked}) q WHERE c.vector IS NOT NULL AND {floor.replace('effective_weight', 'c.effective_weight')}),
den AS (SELECT query_id, unit_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM cosines) WHERE rank <= {k})"""

    if r.retriever == "fts":
        body = lexical(r.top_k) + ",\nhits AS (SELECT * FROM lex)"
    elif r.retriever == "vector":
        body = dense(r.top_k) + ",\nhits AS (SELECT * FROM den)"
    elif r.retriever == "none":
        body = f"""hits AS (SELECT item_id AS query_id, unit_id, effective_weight AS score, row_number() OVER (PARTITION BY item_id ORDER BY effective_weight DESC, unit_id) AS rank
 FROM (SELECT * FROM corpus WHERE {floor} ORDER BY effective_weight DESC, unit_id LIMIT {r.top_k}), benchmark)"""
    else:
        half = max(1, r.top_k // 2)
        body = f"""{lexical(half)},
{dense(r.top_k - half)},
arms AS (SELECT *, 0 AS arm FROM lex UNION ALL SELECT *, 1 FROM den),
seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, unit_id ORDER BY arm, rank) AS n FROM arms),
hits AS (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY arm, rank) AS rank FROM seen WHERE n = 1)"""
    if r.expand:
        body += f""",
near AS (SELECT h.query_id, h.rank, h.score, s.unit_id AS sib, row_number() OVER (PARTITION BY h.query_id, h.rank ORDER BY s.effective_weight DESC, s.unit_id) AS place
 FROM hits h JOIN corpus c ON h.unit_id = c.unit_id JOIN corpus s ON s.note_uid = c.note_uid AND s.unit_id <> h.unit_id),
fresh AS (SELECT *, row_number() OVER (PARTITION BY query_id, sib ORDER BY rank, place) AS n FROM near WHERE place <= {r.expand} AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = near.query_id AND h.unit_id = near.sib)),
result AS (SELECT query_id, rank, unit_id, score, 'retrieved' AS source FROM hits UNION ALL
 SELECT f.query_id, (SELECT max(rank) FROM hits h WHERE h.query_id = f.query_id) + row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank, f.place), sib, f.score * 0.5, 'expanded' FROM fresh f WHERE n = 1)"""
    else:
        body += ",\nresult AS (SELECT query_id, rank, unit_id, score, 'retrieved' AS source FROM hits)"
    return f"{CORPUS},\n{body}\n{final}"
