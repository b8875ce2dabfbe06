"""Registered queries over an archive's own tables, its rich text, its changes, sinks and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import spans as S
from quillspark.functions.constants import COLOUR_CODES, HEX_CODES, OLD_TAGS, RGB_CODES, SALIENCE_WEIGHTS, T_BEYOND, T_POINTS, TAGS
from quillspark.functions.rtf import COLOURED, coloured_rewritten, inflate_text, packed, rtf_of_text, spans_of_text
from quillspark.operators import archive, build, evaluate, export, lexical, segments, service, tree, treemap, units
from quillspark.plans import standin as T
from quillspark.plans.sql import CODE, CORPUS, RUNS, TIER_SQL, TREE, UNITS, bootstrap_sql
from quillspark.registry import query
from quillspark.sources import archive as tables
from quillspark.sources import results, storage

# The stand-in archive (plans/standin.py archive_tables) in SQL.
_CAPTION = "CASE WHEN doc_id % 29 = 7 THEN '=====' WHEN doc_id % 31 = 9 THEN ' ' ELSE left(string_split(coalesce(text, ''), chr(10))[1], 60) END"
_HEX = "[" + ", ".join(f"'{h}'" for h in T.HEX) + "][(doc_id * 5) % 16 + 1]"
_SEMANTIC = "CASE upper(trim(bg_color)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEX_CODES.items()) + " END"
ARCH = f"""WITH RECURSIVE notes AS (SELECT doc_id AS uid, CAST(substr(source, 4) AS BIGINT) AS page_id, {_CAPTION} AS caption, {_HEX} AS bg_color, 40000.25::DOUBLE + doc_id % 1000 AS date_created FROM documents),
contents AS (SELECT doc_id AS id, text, strlen(coalesce(text, ''))::BIGINT AS packed_size FROM documents WHERE doc_id % 13 <> 5),
nodes AS (SELECT 1::BIGINT AS page_id, doc_id + 1 AS id, (CASE WHEN doc_id < 4 THEN -1 ELSE doc_id // 4 END)::BIGINT AS parent_id, doc_id % 4 AS sort_index, CASE WHEN doc_id % 17 = 3 THEN doc_id + 1000000000 ELSE doc_id END AS note_uid, doc_id % 5 AS child_count, {_CAPTION} AS caption FROM documents),
tree AS (SELECT page_id, id, parent_id, note_uid, caption, 0 AS depth, [id] AS ids, left(caption, 50) AS caption_path FROM nodes WHERE parent_id = -1
 UNION ALL SELECT n.page_id, n.id, n.parent_id, n.note_uid, n.caption, t.depth + 1, list_append(t.ids, n.id), t.caption_path || ' > ' || left(n.caption, 30) FROM nodes n JOIN tree t ON n.parent_id = t.id AND n.page_id = t.page_id)"""


def arch(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return T.archive_tables(spark, d)


def doc_tree(spark: SparkSession, d: str) -> DataFrame:
    return tree.hierarchy(arch(spark, d)["treenodes"])


def folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return f"{where.rstrip('/')}/query-{uuid.uuid4().hex}"


# Scans and joins


@query("note_scan", f"{ARCH} SELECT uid, caption, packed_size FROM notes LEFT JOIN contents ON uid = id")
def _note_scan(spark, d):
    t = arch(spark, d)
    return archive.note_scan(t["notes"], t["contents"].withColumnRenamed("text", "data")).select("uid", "caption", "packed_size")


@query("node_scan", f"{ARCH} SELECT n.id, m.caption, bg_color FROM nodes n LEFT JOIN notes m ON n.note_uid = m.uid")
def _node_scan(spark, d):
    t = arch(spark, d)
    return archive.node_scan(t["treenodes"].drop("caption"), t["notes"]).select("id", "caption", "bg_color")


@query(
    "archive_tables",
    f"{ARCH} SELECT 'pages' AS \"table\", count(*) AS rows FROM (SELECT page_id FROM notes UNION SELECT unnest(range(25))) UNION ALL SELECT 'notes', count(*) FROM notes UNION ALL SELECT 'contents', count(*) FROM contents UNION ALL SELECT 'treenodes', count(*) FROM nodes",
)
def _tables(spark, d):
    """Every table replaced as a whole, twice, and read back."""
    where, out = folder(spark), None
    for name, df in arch(spark, d).items():
        for _ in range(2):
            storage.rebuild(df, f"{where}/{name}.parquet")
    for name, df in tables.read_parquet(spark, where).items():
        part = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("point_lookup", f"{ARCH} SELECT uid, caption FROM notes WHERE uid = 42")
def _point(spark, d):
    return archive.point(arch(spark, d)["notes"], uid=42).select("uid", "caption")


@query("results_scan", f"{RUNS} SELECT run_id, regime, overall, blind FROM runs LEFT JOIN ratings USING (run_id)")
def _results(spark, d):
    return results.results_scan(T.runs(spark, d), T.ratings(spark, d)).select("run_id", "regime", "overall", "blind")


@query("chosen_questions", "SELECT item_id::VARCHAR AS question_id, text FROM benchmark WHERE item_id % 4 IN (0, 2)")
def _chosen(spark, d):
    asked = T.questions(spark, d).select(F.col("query_id").cast("string").alias("question_id"), F.col("query").alias("text"), F.get(F.array(*(F.lit(g) for g in "ABCD")), (F.col("query_id") % 4).cast("int")).alias("grp"))
    return evaluate.choose_questions(asked, groups=("a", "C")).select("question_id", "text")


@query("notes_by_hex", f"{ARCH} SELECT uid FROM notes WHERE bg_color = 'FF99CC' ORDER BY date_created DESC, uid LIMIT 100")
def _by_hex(spark, d):
    return archive.notes_by_colour(arch(spark, d)["notes"], "FF99CC").select("uid")


@query("notes_by_code", f"{ARCH} SELECT uid FROM notes WHERE {_SEMANTIC} = 'b' ORDER BY date_created DESC, uid LIMIT 100")
def _by_code(spark, d):
    return archive.notes_by_semantic_colour(arch(spark, d)["notes"], "b").select("uid")


@query(
    "standout_nodes",
    f"{ARCH} SELECT n.id, n.parent_id, uid, m.caption, bg_color, {_SEMANTIC} AS bg_semantic, coalesce(packed_size, 0) AS size FROM nodes n JOIN notes m ON n.note_uid = m.uid LEFT JOIN contents c ON c.id = uid "
    "WHERE n.page_id = 1 AND coalesce(bg_color, '') <> '' AND (packed_size IS NULL OR packed_size < 2000) ORDER BY n.parent_id, n.sort_index, n.id LIMIT 200",
)
def _standout(spark, d):
    t = arch(spark, d)
    return archive.standout_nodes(t["treenodes"].drop("caption"), t["notes"], t["contents"], 1)


@query("node_kinds", f"{ARCH} SELECT id, regexp_matches(trim(caption), '^[=\\-_x]{{3,}}\\s*$') AS is_separator, trim(caption) = '' AS is_marker FROM nodes")
def _kinds(spark, d):
    return arch(spark, d)["treenodes"].select("id", tree.is_separator_node(F.col("caption")).alias("is_separator"), tree.is_marker_node(F.col("caption")).alias("is_marker"))


_PATHS = "paths AS (SELECT note_uid, arg_max(caption_path, id) AS path FROM tree GROUP BY note_uid), placed AS (SELECT uid, coalesce(path, left(caption, 50)) AS tree_path FROM notes LEFT JOIN paths ON uid = note_uid)"


@query("note_paths", f"{ARCH}, {_PATHS} SELECT uid AS note_uid, tree_path FROM placed")
def _paths(spark, d):
    t = arch(spark, d)
    return build.note_paths(t["treenodes"], t["notes"])


_WS = r"[\s\x{00A0}]"
BUILT = rf"""{ARCH}, {_PATHS}, cut AS (SELECT n.uid, p.tree_path, unnest(string_split(coalesce(c.text, ''), chr(10))) AS raw FROM notes n JOIN placed p USING (uid) LEFT JOIN contents c ON c.id = n.uid),
made AS (SELECT uid, tree_path, 'content' AS source_type FROM cut WHERE regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') <> ''
 UNION ALL SELECT uid, tree_path, 'treenode' FROM notes JOIN placed USING (uid) WHERE regexp_replace(caption, '^{_WS}+|{_WS}+$', '', 'g') <> '' AND NOT regexp_full_match(trim(caption), '[\s=\-_x*#~]{{3,}}'))"""


@query("archive_build", f"{BUILT} SELECT uid AS note_uid, tree_path, source_type, count(*) AS units FROM made GROUP BY ALL")
def _build(spark, d):
    """The corpus from the archive's tables: contents decoded from rich text, notes placed in the tree."""
    t = arch(spark, d)
    packed = t["contents"].select("id", rtf_of_text("text").cast("binary").alias("data"), "packed_size")
    out = build.build_units({**t, "contents": packed})
    return out.groupBy("note_uid", "tree_path", "source_type").agg(F.count("*").alias("units"))


_FIG = f"""figs AS (SELECT doc_id AS note_uid, length(coalesce(text, ''))::BIGINT AS chars_total, (length(coalesce(text, '')) // 3)::BIGINT AS chars_highlighted, (length(coalesce(text, '')) // 4)::BIGINT AS chars_b FROM documents),
leaf AS (SELECT t.ids, f.note_uid IS NOT NULL AS has, coalesce(chars_total, 0) AS ct, coalesce(chars_highlighted, 0) AS ch, coalesce(chars_b, 0) AS cb FROM tree t LEFT JOIN figs f USING (note_uid)),
up AS (SELECT unnest(ids) AS id, has, ct, ch, cb FROM leaf)"""


@query(
    "tree_figures",
    f"{ARCH}, {_FIG} SELECT id, count(*) FILTER (has) AS notes, sum(ct)::BIGINT AS chars, round(CASE WHEN sum(ct) > 0 THEN sum(ch) / sum(ct)::DOUBLE ELSE 0 END, 6) AS highlight_ratio, "
    f"round(CASE WHEN sum(ct) > 0 THEN least({SALIENCE_WEIGHTS['b']} * sum(cb) / (5.0 * sum(ct))::DOUBLE * 100, 100) ELSE 0 END, 6) AS salience FROM up GROUP BY id",
)
def _figures(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    notes = T.table(spark, d, "documents").select(F.col("doc_id").alias("note_uid"), n.cast("long").alias("chars_total"), F.floor(n / 3).alias("chars_highlighted"), F.floor(n / 4).alias("chars_b"))
    out = tree.subtree_figures(doc_tree(spark, d), notes, ["b"], SALIENCE_WEIGHTS)
    return out.select("id", F.col("subtree_n_notes").alias("notes"), F.col("subtree_chars_total").alias("chars"), F.round("subtree_highlight_ratio", 6).alias("highlight_ratio"), F.round("subtree_salience", 6).alias("salience"))


@query("tree_nested", f"{ARCH}, s AS (SELECT id, depth, ids, unnest(ids) AS top FROM tree) SELECT top, id, len(ids) - list_position(ids, top) AS below FROM s WHERE top IN (2, 5) AND len(ids) - list_position(ids, top) <= 2")
def _nested(spark, d):
    chosen = spark.createDataFrame([(1, 2), (1, 5)], "page_id long, id long")
    return tree.nested(doc_tree(spark, d), chosen, 2).select("top", "id", F.col("below").cast("long").alias("below"))


@query("archive_subset", f"{ARCH}, k AS (SELECT id, note_uid FROM tree WHERE list_has_any(ids, [3, 9])), n AS (SELECT uid FROM notes SEMI JOIN k ON uid = note_uid) SELECT 'nodes' AS kind, id AS key FROM k UNION ALL SELECT 'notes', uid FROM n UNION ALL SELECT 'contents', c.id FROM contents c SEMI JOIN n ON n.uid = c.id")
def _subset(spark, d):
    t = arch(spark, d)
    notes, contents, nodes = archive.subset(t["notes"].drop("page_id"), t["contents"], t["treenodes"], doc_tree(spark, d), 1, [3, 9])
    parts = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("key")) for kind, df, key in (("nodes", nodes, "id"), ("notes", notes, "uid"), ("contents", contents, "id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_WORDS = r"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query("notes_with_all_words", f"SELECT doc_id AS note_uid FROM documents WHERE list_has_all({_WORDS.format(x='text')}, ['the', 'and', 'that', 'with']) ORDER BY doc_id LIMIT 50")
def _all_words(spark, d):
    notes = T.table(spark, d, "documents").select(F.col("doc_id").alias("note_uid"), "text", F.lit("").alias("caption"))
    return lexical.search_all_words(notes, "the AND that, with!").select("note_uid")


@query(
    "topic_context",
    "WITH n AS (SELECT doc_id AS place, chr(10) || '### ' || lang || chr(10) || substr(text, 1, 2000) AS shown FROM documents), b AS (SELECT place, shown, coalesce(sum(length(shown)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM n) SELECT place, shown, before FROM b WHERE before <= 16000",
)
def _topic(spark, d):
    found = T.table(spark, d, "documents").select(F.col("doc_id").alias("place"), F.col("lang").alias("caption"), F.col("text").alias("body"))
    return archive.topic_context(found).select("place", "shown", "before")


# Rich text


@query("inflated_contents", "SELECT doc_id, md5(text) AS digest FROM documents")
def _inflated(spark, d):
    """Contents packed by zlib, as UTF-8 and as cp1252, and not packed, by document number."""
    docs = T.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(inflate_text(packed("text", F.col("doc_id") % 3)).cast("binary")).alias("digest"))


_PIECES = r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
pieces AS (SELECT doc_id, line, unnest(p) AS text, unnest(range(len(p))) AS k FROM (SELECT doc_id, line, regexp_extract_all(raw, '[^ ]+ +[^ ]+ +|[^ ]+ *| +') AS p FROM lines)),
spans AS (SELECT *, {code} AS color, (doc_id + line + k) % 3 = 0 AS bold FROM pieces)""".replace("{code}", CODE.format(k="doc_id * 7 + line * 3 + k * 5"))

MIXED = rf"""{_PIECES}, n AS (SELECT *, length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) AS n, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM spans),
c AS (SELECT doc_id, line, color, sum(n) AS cn, min(k) AS ck FROM n WHERE color IS NOT NULL AND n > 0 GROUP BY ALL),
best AS (SELECT doc_id, line, color FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY cn DESC, ck) AS r FROM c) WHERE r = 1),
l AS (SELECT doc_id, line, regexp_replace(string_agg(text, '' ORDER BY k), '^{_WS}+|{_WS}+$', '', 'g') AS text, sum(CASE WHEN bold THEN n ELSE 0 END) * 2 > sum(n) AS is_bold FROM n GROUP BY ALL HAVING sum(n) > 0),
i AS (SELECT n.doc_id, n.line, string_agg(left(regexp_replace(n.text, '^{_WS}+|{_WS}+$', '', 'g'), 100) || ':' || n.color || ':' || n.at || ':' || (n.at + n.n), '|' ORDER BY n.k) AS inner_highlights FROM n JOIN best b USING (doc_id, line) WHERE n.color <> b.color AND n.n > 0 GROUP BY ALL)"""


@query("mixed_lines", f"{MIXED} SELECT l.doc_id AS note_uid, l.line AS line_index, l.text, b.color, is_bold, coalesce(inner_highlights, '') AS inner_highlights FROM l LEFT JOIN best b USING (doc_id, line) LEFT JOIN i USING (doc_id, line)")
def _mixed(spark, d):
    """Lines of several spans: the dominant colour (ties: first seen), the bold majority, inner highlights."""
    inner = F.array_join(F.transform("inner_highlights", lambda h: F.concat_ws(":", h["text"], h["color"], h["start"], h["end"])), "|")
    return units.content_units(T.mixed_notes(spark, d)).select("note_uid", F.col("line_index").cast("long").alias("line_index"), "text", "color", "is_bold", inner.alias("inner_highlights"))


@query("rich_text_spans", f"{_PIECES}, f AS (SELECT doc_id, color, bold, text, line, k FROM spans) SELECT doc_id AS note_uid, color, bold, sum(length(text))::BIGINT AS chars, md5(string_agg(text, '' ORDER BY line, k)) AS digest FROM f WHERE color IS NOT NULL GROUP BY ALL")
def _rich(spark, d):
    """Coloured and bold spans written as rich text, with their colour table, and read back."""
    storage.bounded_batches(spark)
    notes = T.mixed_notes(spark, d)
    found = notes.mapInArrow(coloured_rewritten, f"note_uid {notes.schema['note_uid'].dataType.simpleString()}, {COLOURED}")
    parts = found.groupBy("note_uid", "color", "bold").agg(F.collect_list(F.struct("places", "texts")).alias("p"))
    ordered = F.array_sort(F.flatten(F.transform("p", lambda x: F.arrays_zip(x["places"], x["texts"]))))  # only where a number stands on several notes
    texts = F.when(F.size("p") == 1, F.get("p", F.lit(0))["texts"]).otherwise(F.transform(ordered, lambda x: x["texts"]))
    out = parts.select("note_uid", "color", "bold", F.array_join(texts, "").alias("t"))
    return out.select("note_uid", "color", "bold", F.length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("plain_contents", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE 1 END AS spans, md5(nullif(text, '')) AS digest FROM documents")
def _plain(spark, d):
    """Contents that are no rich text are one plain span."""
    storage.bounded_batches(spark)
    out = T.table(spark, d, "documents").select("doc_id", spans_of_text("text").alias("s"))
    return out.select("doc_id", F.size("s").alias("spans"), F.md5(F.get("s", F.lit(0))["text"].cast("binary")).alias("digest"))


@query("surrogates", "SELECT c_custkey, md5(c_name || chr(128513) || ' {' || chr(233) || '}') AS digest FROM customer")
def _surrogates(spark, d):
    """Characters beyond 16 bits, braces and accents through rich text."""
    text = F.concat("c_name", F.lit("\U0001f601 {é}"))
    back = T.table(spark, d, "customer").select("c_custkey", spans_of_text(rtf_of_text(text)).alias("s"))
    return back.select("c_custkey", F.md5(S.plain_text(F.col("s")).cast("binary")).alias("digest"))


_RGB = [(*rgb, code, k) for k, (rgb, code) in enumerate(RGB_CODES.items())]
_RGB_SQL = ", ".join(f"({r}, {g}, {b}, {'NULL' if c is None else chr(39) + c + chr(39)}, {k})" for r, g, b, c, k in _RGB)


@query(
    "nearest_colours",
    f"WITH p AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 53) % 256 AS b FROM part), k(kr, kg, kb, code, n) AS (VALUES {_RGB_SQL}), "
    "d AS (SELECT p_partkey, code, n, (r - kr) * (r - kr) + (g - kg) * (g - kg) + (b - kb) * (b - kb) AS far FROM p, k), x AS (SELECT p_partkey, arg_min(code, n) AS code FROM d WHERE far = 0 GROUP BY 1), "
    "y AS (SELECT p_partkey, code, far FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY far, n) AS o FROM d WHERE code IS NOT NULL) WHERE o = 1) "
    "SELECT p.p_partkey, CASE WHEN x.p_partkey IS NOT NULL THEN x.code WHEN r = 0 AND g = 0 AND b = 0 THEN NULL WHEN far < 10000 THEN y.code END AS code FROM p LEFT JOIN x USING (p_partkey) LEFT JOIN y USING (p_partkey)",
)
def _nearest(spark, d):
    k = F.col("p_partkey")
    return T.table(spark, d, "part").select("p_partkey", C.nearest_colour((k * 37) % 256, (k * 91) % 256, (k * 53) % 256).alias("code"))


@query("highlight_lines", f"{UNITS}, h AS (SELECT note_uid, string_agg('[' || color || ']' || strip || '[/' || color || ']', chr(10) ORDER BY line_index) AS lines FROM lines WHERE color IN ('g', 'b', 'p', 'u') AND strip <> '' GROUP BY note_uid) SELECT note_uid, coalesce(h.lines, '') AS lines FROM notes LEFT JOIN h USING (note_uid)")
def _highlights(spark, d):
    return T.notes(spark, d).select("note_uid", S.highlights(F.col("spans")).alias("lines"))


_SPAN_TEXT = "raw || CASE WHEN line_index < max(line_index) OVER (PARTITION BY note_uid) THEN chr(10) ELSE '' END"
_TAG_OF = "CASE color " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " END"


@query(
    "clipboard_text",
    f"{UNITS}, t AS (SELECT note_uid, line_index, strip, color, is_bold, {_SPAN_TEXT} AS span, {_TAG_OF} AS tag FROM lines), s AS (SELECT note_uid, string_agg(CASE WHEN strip = '' THEN span ELSE '[' || tag || CASE WHEN is_bold THEN '*' ELSE '' END || ']' || span || '[/' || tag || ']' END, '' ORDER BY line_index) AS body "
    "FROM t WHERE strip = '' OR color IN ('u', 'p') GROUP BY note_uid) SELECT note_uid, coalesce(body, '') AS body FROM notes LEFT JOIN s USING (note_uid)",
)
def _clipboard(spark, d):
    return T.notes(spark, d).select("note_uid", S.clipboard(F.col("spans"), ("u", "p")).alias("body"))


@query("essence", f"""{UNITS}, f AS (SELECT n.note_uid, coalesce(sum(length(strip)), 0) AS total, {', '.join(f"coalesce(sum(CASE WHEN l.color = '{c}' THEN length(strip) END), 0) AS c_{c}" for c in COLOUR_CODES)} FROM notes n LEFT JOIN lines l USING (note_uid) GROUP BY n.note_uid),
s AS (SELECT note_uid, round_even(CASE WHEN total > 0 THEN least((5.0 * c_u + 4.0 * c_p + 3.0 * c_b + 2.0 * c_g + 1.0 * c_y + 0.5 * c_o)::DOUBLE / (total * 5.0)::DOUBLE * 100.0, 100.0) ELSE 0 END, 1) AS salience FROM f),
h AS (SELECT l.note_uid AS uid, line_index AS place, color, is_bold AS bold, salience, CASE color WHEN 'u' THEN 5.0 WHEN 'p' THEN 4.0 WHEN 'b' THEN 3.0 WHEN 'g' THEN 2.0 END AS w FROM lines l JOIN s USING (note_uid) WHERE color IN ('g', 'b', 'p', 'u') AND length(strip) >= 3),
first AS (SELECT * FROM h ORDER BY salience DESC, w DESC, bold DESC, uid, place LIMIT 300)
SELECT uid, place, color FROM (SELECT *, row_number() OVER (PARTITION BY color ORDER BY salience DESC, w DESC, bold DESC, uid, place) AS n FROM first) WHERE n <= 25""")
def _essence(spark, d):
    found = archive.highlighted_spans(T.notes(spark, d).withColumnRenamed("note_uid", "uid"), limit=None)
    return archive.essence(found, 100).select("uid", F.col("place").cast("long").alias("place"), "color")


# Sections: the fold over coloured lines and breaks, as a recursion

SECTIONS = rf"""WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
more AS (SELECT doc_id, i, 0 AS j, t FROM raw UNION ALL SELECT doc_id, i, 1, '[BR2]' FROM raw WHERE i % 7 = 3 UNION ALL SELECT doc_id, i, 1, '[BR3]' FROM raw WHERE i % 7 = 6),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS line, t, regexp_replace(t, '^{_WS}+|{_WS}+$', '', 'g') AS strip FROM more),
coded AS (SELECT *, {CODE.format(k='doc_id * 7 + line * 3')} AS color, strip IN ('[BR2]', '[BR3]') AS token, length(t) + CASE WHEN line < max(line) OVER (PARTITION BY doc_id) THEN 1 ELSE 0 END AS n, length(t) AS m FROM lines),
fold(doc_id, line, section, run) AS (SELECT doc_id, -1::BIGINT, NULL::VARCHAR, 0::BIGINT FROM (SELECT DISTINCT doc_id FROM coded)
 UNION ALL SELECT c.doc_id, c.line,
  CASE WHEN strip = '[BR3]' THEN NULL WHEN token OR color IS NULL OR m = 0 OR color = section THEN section WHEN section IS NULL OR m > run THEN color ELSE section END,
  CASE WHEN strip = '[BR3]' THEN 0 WHEN token OR color IS NULL OR m = 0 THEN run WHEN color = section THEN run + m WHEN section IS NULL OR m > run THEN m ELSE run END
 FROM fold f JOIN coded c ON c.doc_id = f.doc_id AND c.line = f.line + 1),
seen AS (SELECT doc_id, line, max(CASE WHEN m > 0 AND NOT token THEN line END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM coded),
brk AS (SELECT s.doc_id, s.line, arg_max(b.strip, b.line) AS tok FROM seen s JOIN coded b ON b.doc_id = s.doc_id AND b.token AND b.line < s.line AND b.line > coalesce(s.last, -1) GROUP BY ALL)"""


@query(
    "section_colours",
    f"{SECTIONS} SELECT c.doc_id AS note_uid, c.line AS line_index, f.section AS section_color, CASE tok WHEN '[BR3]' THEN 'section_start' WHEN '[BR2]' THEN 'block_start' ELSE 'mid_block' END AS break_context FROM coded c JOIN fold f USING (doc_id, line) LEFT JOIN brk USING (doc_id, line) WHERE c.strip <> '' AND NOT token",
)
def _sections(spark, d):
    """Running section colours and break contexts, over notes with break tokens."""
    return units.content_units(T.notes(spark, d, tokens=True)).select("note_uid", F.col("line_index").cast("long").alias("line_index"), "section_color", "break_context")


# Exports


def _chain(sql: str, tiers: list[tuple[str, str]], budget: int, order: str, size: str) -> str:
    """CTEs that give each tier what the tiers before it left: (name of rows, filter) in order."""
    left, names = str(budget), []
    for k, (rows, where) in enumerate(tiers):
        sql += f""", z{k} AS (SELECT note_uid, {size} AS size, max(date_created) AS latest FROM {rows} WHERE {where} GROUP BY note_uid),
y{k} AS (SELECT note_uid, size, sum(size) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM z{k}),
x{k} AS (SELECT note_uid, size FROM y{k} WHERE run = size OR run <= {left})"""
        names.append(f"SELECT t.*, {k} AS place FROM {rows} t SEMI JOIN x{k} USING (note_uid) WHERE {where}")
        left = f"({left} - coalesce((SELECT sum(size) FROM x{k}), 0))"
    return sql + f", chosen AS ({' UNION ALL '.join(names)})"


_SIZE = "80 + sum(length(text) + 14)"
_ALL = ["color IN ('u', 'p')", "color = 'b'", "color IN ('g', 'g2')", "color IS NULL AND is_bold"]
_PLACES = [0, 1, 2, 5]


def _tiers_sql(filters: list[str], budget: int, recent: bool = False) -> str:
    good = TIER_SQL.split(",\ntiers AS")[0]
    return _chain(good, [("good", f) for f in filters], budget, "latest DESC, note_uid" if recent else "note_uid", _SIZE)


def _tier(spark, d, budget, recent=False):
    chosen, _ = export.tiered(T.units(spark, d), ("u", "p", "b", "g", "g2", "nb"), budget, recent_first=recent)
    return chosen.select("unit_id", "tier")


_PLACE = "CASE place WHEN 3 THEN 5 ELSE place END"


@query("export_budgeted", f"{_tiers_sql(_ALL, 30_000)} SELECT unit_id, {_PLACE} AS tier FROM chosen")
def _export_budget(spark, d):
    return _tier(spark, d, 30_000)


@query("export_recent", f"{_tiers_sql(_ALL, 30_000, True)} SELECT unit_id, {_PLACE} AS tier FROM chosen")
def _export_recent(spark, d):
    return _tier(spark, d, 30_000, recent=True)


_LINE_TAG = f"'[' || coalesce({_TAG_OF}, CASE WHEN is_bold THEN 'BLD' ELSE '?' END) || CASE WHEN is_bold AND {_TAG_OF} IS NOT NULL THEN '*' ELSE '' END || ']'"
_BLOCKS = f""", tagged AS (SELECT *, {_LINE_TAG} AS tag, row_number() OVER (PARTITION BY note_uid ORDER BY place, line_index, {_LINE_TAG}, text) AS nth FROM chosen),
heads AS (SELECT note_uid, any_value(caption) AS caption, any_value(tree_path) AS tree_path, max(date_created) AS latest, count(*) AS n, arg_min(text, nth) = coalesce(any_value(caption), '') AS merged, arg_min(tag, nth) AS tag FROM tagged GROUP BY note_uid),
titled AS (SELECT *, CASE WHEN merged THEN tag || ' ' ELSE '' END || CASE WHEN coalesce(caption, '') = '' THEN '(untitled)' ELSE caption END AS title, string_split(CASE WHEN tree_path = '' THEN '(root)' ELSE tree_path END, ' > ') AS seg FROM heads)"""
_OUTLINE = f"""{_BLOCKS}, lagged AS (SELECT *, lag(seg) OVER (PARTITION BY seg[1] ORDER BY string_split(tree_path, ' > '), note_uid) AS last FROM titled),
shared AS (SELECT *, coalesce((SELECT count(*) FROM range(1, len(seg) + 1) r(i) WHERE seg[1:i] = last[1:i]), 0) AS common FROM lagged),
opened AS (SELECT *, array_to_string(list_transform(range(common + 1, len(seg) + 1), lambda i: repeat(chr(9), (i - 1)::INT) || '== ' || seg[i] || ' ==' || chr(10)), '') AS opening FROM shared),
bodies AS (SELECT t.note_uid, string_agg(chr(10) || repeat(chr(9), len(o.seg)) || '  ' || t.tag || ' ' || t.text, '' ORDER BY nth) AS body FROM tagged t JOIN opened o USING (note_uid) WHERE NOT (o.merged AND nth = 1) GROUP BY t.note_uid),
blocks AS (SELECT note_uid, seg, n, opening || chr(10) || repeat(chr(9), len(seg)) || '[' || note_uid || '] ' || title || coalesce(body, '') AS block FROM opened LEFT JOIN bodies USING (note_uid))"""
_FRESH = f"""{_BLOCKS}, bodies AS (SELECT t.note_uid, string_agg(chr(10) || '  ' || t.tag || ' ' || t.text, '' ORDER BY nth) AS body FROM tagged t JOIN titled o USING (note_uid) WHERE NOT (o.merged AND nth = 1) GROUP BY t.note_uid),
blocks AS (SELECT note_uid, chr(10) || '[' || note_uid || '] ' || title || '  (' || coalesce(strftime(latest, '%Y-%m-%d'), '?') || ' · ' || CASE WHEN tree_path = '' THEN '(root)' ELSE tree_path END || ')' || coalesce(body, '') AS block FROM titled LEFT JOIN bodies USING (note_uid))"""


@query("export_outline", f"{_tiers_sql(_ALL[:2], 50_000)}{_OUTLINE} SELECT note_uid, block FROM blocks")
def _outline(spark, d):
    chosen, _ = export.tiered(T.units(spark, d), ("u", "p", "b"), 50_000)
    return export.outline(chosen).select(F.col("place.note_uid").alias("note_uid"), "block")


@query("export_newest_blocks", f"{_tiers_sql(_ALL[:2], 50_000, True)}{_FRESH} SELECT note_uid, block FROM blocks")
def _newest(spark, d):
    chosen, _ = export.tiered(T.units(spark, d), ("u", "p", "b"), 50_000, recent_first=True)
    return export.newest_first(chosen).select(F.col("place.note_uid").alias("note_uid"), "block")


_TEXT = "'# ' || (SELECT sum(n) FROM blocks) || ' highlighted units from ' || count(*) || ' notes' || chr(10) || string_agg(block, chr(10) ORDER BY seg, note_uid)"


_HEADER = "'# ' || (SELECT coalesce(sum(n), 0)::BIGINT FROM blocks) || ' highlighted units from ' || (SELECT count(*) FROM blocks) || ' notes'"
_LAID = f"""placed AS (SELECT note_uid, seg, block, row_number() OVER w AS nth_block, length({_HEADER}) + 1 + coalesce(sum(length(block) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM blocks WINDOW w AS (ORDER BY seg, note_uid)),
sections AS (SELECT *, coalesce(lag(seg[1]) OVER (ORDER BY nth_block) <> seg[1], TRUE) AS opens FROM placed),
branches AS (SELECT nth_block, coalesce(lag(start // 5000) OVER (ORDER BY nth_block) <> start // 5000, FALSE) AS cut FROM sections WHERE opens),
parts AS (SELECT m.*, (sum(coalesce(cut, FALSE)::INT) OVER (ORDER BY m.nth_block))::INT AS part FROM sections m LEFT JOIN branches b ON m.nth_block = b.nth_block)"""


@query("export_text", f"{_tiers_sql(_ALL[:2], 50_000)}{_OUTLINE}, {_LAID} SELECT note_uid, start, length(block) AS chars, md5(block) AS digest FROM parts")
def _export_text(spark, d):
    """The export of a budget, laid out: where each note's block begins in the text."""
    chosen, _ = export.tiered(T.units(spark, d), ("u", "p", "b"), 50_000)
    blocks = storage.scratch_table(export.outline(chosen))
    laid = export.laid_out(blocks, export.headline(blocks))
    return laid.select("place.note_uid", "start", F.length("block").cast("long").alias("chars"), F.md5(F.col("block").cast("binary")).alias("digest"))


@query("export_parts", f"{TIER_SQL.replace('tiers AS', 'chosen AS').replace(' AS tier FROM good', ' AS place FROM good')}{_OUTLINE}, {_LAID} SELECT part, count(*) AS notes, sum(length(block) + 1)::BIGINT + max(CASE WHEN part = 0 THEN length({_HEADER}) + 1 ELSE 0 END)::BIGINT AS chars FROM parts GROUP BY part")
def _export_parts(spark, d):
    """Every unit of the tiers as text parts of about 5,000 characters, written by the executors and read back."""
    chosen, _ = export.tiered(T.units(spark, d), ("u", "p", "b", "g", "g2", "nb"))
    path = folder(spark)
    laid = export.write_text(export.outline(chosen), path, part_chars=5000)
    files = spark.read.text(path, wholetext=True).groupBy("part").agg(F.sum(F.length("value")).alias("chars"))
    return laid.groupBy("part").agg(F.count("*").alias("notes")).join(files, "part")


_PREVIEW = ["color IN ('u', 'p')", "color = 'b'", "color IN ('g', 'g2')", "color = 'y'", "color = 'o'", "color IS NULL AND is_bold", "color IS NULL"]


@query("export_preview", f"{_tiers_sql([f'note_uid % 50 = 1 AND {x}' for x in _PREVIEW], 4000)} SELECT unit_id FROM chosen")
def _preview(spark, d):
    """What a preview of some notes holds."""
    notes = T.table(spark, d, "documents").where("doc_id % 50 = 1").select(F.col("doc_id").alias("note_uid"))
    return export.preview_units(T.units(spark, d), notes).select("unit_id")


@query("export_of_notes", f"{TIER_SQL} SELECT unit_id FROM tiers WHERE tier IN (0, 1) AND note_uid % 3 = 0")
def _of_notes(spark, d):
    notes = T.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("note_uid"))
    return export.select_units(T.units(spark, d), ("u", "p", "b"), notes=notes).select("unit_id")


@query("export_fallback", f"{TIER_SQL.replace('tiers AS', 'unused AS')}, w AS (SELECT DISTINCT note_uid FROM good WHERE color = 'u'), s AS (SELECT DISTINCT note_uid FROM good ANTI JOIN w USING (note_uid)) SELECT unit_id, 7 AS tier FROM good SEMI JOIN s USING (note_uid) WHERE color IS NULL AND is_bold")
def _fallback(spark, d):
    """Notes without a unit of the asked colour: what is bold and uncoloured instead."""
    u = T.units(spark, d)
    has = export.select_units(u, ("u",)).select("note_uid").distinct()
    notes = export.select_units(u, ("u", "p", "b", "g", "g2", "y", "o", "n")).select("note_uid").distinct().join(has, "note_uid", "left_anti")
    chosen, _ = export.tiered(u, ("u",), notes=storage.scratch_table(notes), fallback=True)
    return chosen.select("unit_id", "tier")


_OLD = """{units}, old AS (SELECT * FROM units WHERE color IN ('u', 'p', 'b', 'g') AND NOT is_trivial AND NOT is_separator AND length(text) >= 15 AND NOT (length(text) < 15 AND NOT regexp_matches(text, '[.!?"]'))
 AND NOT (source_type = 'treenode' AND length(text) < 50 AND NOT regexp_matches(text, '[."]'))),
gw AS (SELECT note_uid, max(effective_weight) AS w FROM old WHERE color = 'g' GROUP BY note_uid), gk AS (SELECT note_uid FROM gw ORDER BY w DESC, note_uid LIMIT (SELECT greatest(1, floor(count(*) * 50 / 100.0)::INT) FROM gw)),
greens AS (SELECT * FROM old SEMI JOIN gk USING (note_uid) WHERE color = 'g')"""


@query("export_old_rich", f"{_chain(_OLD.format(units=UNITS), [('old', _ALL[0]), ('old', _ALL[1]), ('greens', 'TRUE')], 400_000, 'note_uid', _SIZE)} SELECT unit_id, place AS tier FROM chosen")
def _old_rich(spark, d):
    return export.preset(T.units(spark, d), "rich").select("unit_id", "tier")


@query("export_old_standard", f"{_chain(_OLD.format(units=UNITS), [('old', _ALL[0]), ('old', _ALL[1])], 180_000, 'note_uid', _SIZE)} SELECT unit_id, place AS tier FROM chosen")
def _old_standard(spark, d):
    return export.preset(T.units(spark, d), "standard").select("unit_id", "tier")


_OLD_TAG = "CASE color " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OLD_TAGS.items()) + " END"


@query(
    "export_compact",
    f"""{_OLD.format(units=UNITS)}, chosen AS (SELECT * FROM old WHERE color IN ('u', 'p')), shown AS (SELECT note_uid, line_index, text, '    [' || {_OLD_TAG} || CASE WHEN is_bold THEN '*' ELSE '' END || '] ' || text AS line FROM chosen),
n AS (SELECT note_uid, any_value(coalesce(caption, '')) AS caption, any_value(tree_path) AS tree_path, count(*) AS n FROM chosen GROUP BY note_uid),
b AS (SELECT note_uid, string_agg(line, chr(10) ORDER BY line_index, line) AS body FROM shown JOIN n USING (note_uid) WHERE NOT (text = caption AND n = 1) GROUP BY note_uid),
p AS (SELECT *, string_split(tree_path, ' > ') AS parts, array_to_string(string_split(tree_path, ' > ')[2:], ' > ') AS below FROM n),
h AS (SELECT *, CASE WHEN below <> '' AND NOT starts_with(caption, below) THEN chr(10) || '  [' || note_uid || '] ' || below || CASE WHEN caption <> '' AND NOT contains(below, caption) THEN chr(10) || '  # ' || caption ELSE '' END
 WHEN caption <> '' THEN chr(10) || '  [' || note_uid || '] ' || caption END AS head FROM p)
SELECT CASE WHEN tree_path = '' THEN '(root)' ELSE parts[1] END AS branch, note_uid, concat_ws(chr(10), head, body) AS block FROM h LEFT JOIN b USING (note_uid)""",
)
def _compact(spark, d):
    return export.compact(export.preset(T.units(spark, d), "compact"))


@query(
    "render_line",
    rf"""{UNITS}, s AS (SELECT note_uid, line_index, color, is_bold, {_SPAN_TEXT} AS span, {_TAG_OF} AS tag FROM lines), k AS (SELECT *, row_number() OVER (PARTITION BY note_uid ORDER BY line_index) AS i FROM s WHERE color IN ('u', 'p', 'b')),
g AS (SELECT *, i - row_number() OVER (PARTITION BY note_uid, color, is_bold ORDER BY i) AS grp FROM k), r AS (SELECT note_uid, any_value(tag) AS tag, is_bold, min(i) AS i, regexp_replace(regexp_replace(string_agg(span, '' ORDER BY i), '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS text FROM g GROUP BY note_uid, color, is_bold, grp),
j AS (SELECT note_uid, string_agg('[' || tag || CASE WHEN is_bold THEN '*' ELSE '' END || '] ' || text, chr(10) ORDER BY i) AS body FROM r WHERE text <> '' GROUP BY note_uid) SELECT note_uid, coalesce(body, '') AS body FROM notes LEFT JOIN j USING (note_uid)""",
)
def _render(spark, d):
    return T.notes(spark, d).select("note_uid", S.render(F.col("spans"), ("u", "p", "b"), "line").alias("body"))


# Sinks, written and read back


@query("append_missing", "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def _append(spark, d):
    """Odd events first, then all of them: only what is missing is added."""
    path, e = folder(spark), T.table(spark, d, "events").select("event_id", "event_type")
    storage.add_missing(e.where("event_id % 2 = 1"), path, "event_id")
    storage.add_missing(e, path, "event_id")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("rows"))


@query("batched_append", "SELECT o_orderstatus, count(*) * 2 AS rows FROM orders GROUP BY ALL")
def _batched(spark, d):
    path, o = folder(spark), T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    storage.append(o, path)
    storage.append(o, path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("rows"))


@query("embed_missing", f"{CORPUS} SELECT unit_id, length(text)::DOUBLE AS size FROM corpus")
def _embed_missing(spark, d):
    """The hundred heaviest units first, then the rest; each is embedded once."""
    path, c = folder(spark), T.corpus(spark, d).withColumn("caption", F.lit(None).cast("string"))
    embed = lambda texts: [[len(t), t.count("e")] for t in texts]
    service.embed_missing(c, path, embed, 2, context=False, sample=100)
    service.embed_missing(c, path, embed, 2, context=False)
    return spark.read.parquet(path).select("unit_id", F.get("vector", F.lit(0)).cast("double").alias("size"))


_STORED = "SELECT event_id AS run_id, user_id::VARCHAR AS question_id, event_type AS regime, 'g' || event_id % 2 AS generator, value FROM events"


@query(
    "upserted_runs",
    f"WITH r AS ({_STORED}), o AS (SELECT question_id, regime, generator, max(run_id) AS run_id FROM r WHERE run_id % 3 <> 0 GROUP BY ALL), n AS (SELECT question_id, regime, generator, max(run_id) AS run_id FROM r WHERE run_id % 3 = 0 GROUP BY ALL) "
    "SELECT question_id, regime, generator, coalesce(n.run_id, o.run_id) AS run_id FROM o FULL JOIN n USING (question_id, regime, generator)",
)
def _upserted(spark, d):
    e = T.table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").cast("string").alias("question_id"), F.col("event_type").alias("regime"), F.concat(F.lit("g"), F.col("event_id") % 2).alias("generator"))
    one = lambda df: df.groupBy("question_id", "regime", "generator").agg(F.max("run_id").alias("run_id"))
    return results.upsert_runs(one(e.where("run_id % 3 <> 0")), one(e.where("run_id % 3 = 0")))


@query("latest_runs", f"SELECT question_id, regime, generator, max(run_id) AS run_id FROM ({_STORED}) GROUP BY ALL")
def _latest(spark, d):
    e = T.table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").cast("string").alias("question_id"), F.col("event_type").alias("regime"), F.concat(F.lit("g"), F.col("event_id") % 2).alias("generator"))
    return results.latest(e, results.RUN_KEY, "run_id").select("question_id", "regime", "generator", "run_id")


@query(
    "upserted_ratings",
    f"{RUNS}, o AS (SELECT event_id AS run_id, round(value, 2) AS overall, event_id % 101 AS correctness, event_id % 97 AS completeness, event_id % 89 AS grounding FROM events WHERE event_id % 5 <> 0), "
    "n AS (SELECT event_id AS run_id, round(value + 1, 2) AS overall, CASE WHEN event_id % 4 = 0 THEN 7 END AS correctness, NULL::BIGINT AS completeness, NULL::BIGINT AS grounding FROM events WHERE event_id % 2 = 0) "
    "SELECT o.run_id, overall, correctness, completeness, grounding FROM o ANTI JOIN n USING (run_id) UNION ALL SELECT n.run_id, n.overall, CASE WHEN n.correctness IS NULL THEN o.correctness ELSE n.correctness END, CASE WHEN n.correctness IS NULL THEN o.completeness END, CASE WHEN n.correctness IS NULL THEN o.grounding END FROM n LEFT JOIN o USING (run_id)",
)
def _upserted_ratings(spark, d):
    i, e = F.col("event_id"), T.table(spark, d, "events")
    none = F.lit(None).cast("long")
    old = e.where(i % 5 != 0).select(i.alias("run_id"), F.round("value", 2).alias("overall"), (i % 101).alias("correctness"), (i % 97).alias("completeness"), (i % 89).alias("grounding"))
    new = e.where(i % 2 == 0).select(i.alias("run_id"), F.round(F.col("value") + 1, 2).alias("overall"), F.when(i % 4 == 0, 7).cast("long").alias("correctness"), none.alias("completeness"), none.alias("grounding"))
    return results.upsert_ratings(old, new)


@query("csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _csv(spark, d):
    path = folder(spark)
    storage.write_csv(T.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return spark.read.csv(path, header=True, schema="s_suppkey long, s_name string, s_acctbal double")


@query("json_round_trip", f"{RUNS} SELECT question_id, regime, count(*) AS runs FROM runs GROUP BY ALL")
def _json(spark, d):
    path = folder(spark)
    storage.write_json(T.runs(spark, d), path)
    return storage.read_json(spark, path, lines=True).groupBy("question_id", "regime").agg(F.count("*").alias("runs"))


@query("rtf_files", "SELECT n_name AS name, md5('notes of ' || n_name) AS digest FROM nation")
def _rtf_files(spark, d):
    """Rich-text files, one a nation, read and decoded."""
    path = folder(spark)
    text = rtf_of_text(F.concat(F.lit("notes of "), "n_name"))
    T.table(spark, d, "nation").select("n_name", text.alias("value")).repartition("n_name").write.partitionBy("n_name").text(path)
    files = storage.read_rtf_files(spark, path)
    out = files.select(F.regexp_replace(F.regexp_extract("path", r"n_name=([^/]+)/", 1), "%20", " ").alias("name"), spans_of_text("text").alias("s"))
    return out.select("name", F.md5(F.trim(S.plain_text(F.col("s"))).cast("binary")).alias("digest"))


# Evaluation

_POINT = "CASE " + " ".join(f"WHEN n - 1 <= {k} THEN {v}" for k, v in sorted(T_POINTS.items())) + f" ELSE {T_BEYOND} END"


@query(
    "paired_significance",
    f"WITH s AS (SELECT user_id // 10 AS g, user_id::VARCHAR AS question_id, event_type AS regime, avg(value) AS score FROM events GROUP BY ALL), d AS (SELECT a.regime, a.score - b.score AS d FROM s a JOIN s b ON a.question_id = b.question_id AND b.regime = (SELECT min(regime) FROM s)), "
    f"g AS (SELECT regime, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d GROUP BY regime) SELECT regime, n, {_POINT}::DOUBLE AS critical, CASE WHEN n < 2 THEN FALSE WHEN sd = 0 THEN m <> 0 ELSE abs(m / (sd / sqrt(n))) > {_POINT} END AS significant FROM g",
)
def _significance(spark, d):
    """The tabled point of each regime's degrees of freedom, and whether t is beyond it."""
    scores = T.scores(spark, d)
    first = scores.agg(F.min("regime")).first()[0]
    out = evaluate.paired_tests(scores, first)
    return out.select("regime", "n", evaluate.t_critical(F.col("df")).alias("critical"), "significant")


@query("box_plots", f"{RUNS} SELECT regime, count(*) AS n, round(min(score), 6) AS low, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS high FROM scores GROUP BY regime")
def _boxes(spark, d):
    out = evaluate.box_plots(T.scores(spark, d))
    return out.select("regime", "n", *(F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")))


@query("rating_queue", f"{RUNS} SELECT run_id, regime, overall FROM runs LEFT JOIN ratings USING (run_id) WHERE question_id = '17'")
def _queue(spark, d):
    return evaluate.rating_queue(T.runs(spark, d), T.ratings(spark, d), "17").select("run_id", "regime", "overall")


@query(
    "regime_table",
    f"{RUNS}, b AS (SELECT question_id FROM scores WHERE regime = (SELECT min(regime) FROM scores)), shared AS (SELECT * FROM scores SEMI JOIN b USING (question_id)), {bootstrap_sql('shared')}, "
    "g AS (SELECT regime, count(*) AS n, round(avg(score), 6) AS mean FROM shared GROUP BY regime) SELECT regime, n, mean, round(low, 6) AS low, round(high, 6) AS high FROM g JOIN intervals USING (regime)",
)
def _regime_table(spark, d):
    """Means over shared questions, with their resampled intervals."""
    scores = T.scores(spark, d)
    out = evaluate.regime_table(scores, scores.agg(F.min("regime")).first()[0])
    return out.select("regime", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


# Changes: the new state of the tree

_COUNTED = "c AS (SELECT page_id, parent_id AS id, count(*) AS kids FROM {t} GROUP BY ALL) SELECT n.page_id, n.id, n.parent_id, row_number() OVER (PARTITION BY n.page_id, n.parent_id ORDER BY n.sort_index, n.id) - 1 AS sort_index, coalesce(kids, 0) AS child_count FROM {t} n LEFT JOIN c USING (page_id, id)"


def _state(df: DataFrame) -> DataFrame:
    return df.select("page_id", "id", "parent_id", F.col("sort_index").cast("long").alias("sort_index"), F.col("child_count").cast("long").alias("child_count"))


@query("patched_notes", f"{ARCH} SELECT uid, CASE WHEN uid % 10 = 0 THEN 'new ' || uid ELSE caption END AS caption, CASE WHEN uid % 20 = 0 THEN NULL ELSE bg_color END AS bg_color FROM notes")
def _patched(spark, d):
    """Captions set anew, colours cleared."""
    notes = arch(spark, d)["notes"]
    captions = notes.where("uid % 10 = 0").select("uid", F.concat(F.lit("new "), "uid").alias("caption"))
    cleared = notes.where("uid % 20 = 0").select("uid", F.lit(None).cast("string").alias("bg_color"))
    return archive.patched(archive.patched(notes, captions), cleared, set_null=True).select("uid", "caption", "bg_color")


@query("node_inserted", f"{ARCH}, t AS (SELECT page_id, id, parent_id, CASE WHEN parent_id = 2 AND sort_index >= 1 THEN sort_index + 1 ELSE sort_index END AS sort_index FROM nodes UNION ALL SELECT 1, (SELECT max(id) + 1 FROM nodes), 2, 1), {_COUNTED.format(t='t')}")
def _inserted(spark, d):
    return _state(archive.inserted(arch(spark, d)["treenodes"], 1, 2, 1, 99))


@query("node_deleted", f"{ARCH}, t AS (SELECT page_id, id, CASE WHEN parent_id = 3 THEN -1 ELSE parent_id END AS parent_id, sort_index FROM nodes WHERE id <> 3), {_COUNTED.format(t='t')}")
def _deleted(spark, d):
    nodes = arch(spark, d)["treenodes"]
    return _state(archive.deleted(nodes, tree.hierarchy(nodes), 1, 3, recursive=False))


@query("branch_deleted", f"{ARCH}, t AS (SELECT n.page_id, n.id, n.parent_id, sort_index FROM nodes n JOIN tree USING (id) WHERE NOT list_contains(ids, 3)), {_COUNTED.format(t='t')}")
def _branch_deleted(spark, d):
    nodes = arch(spark, d)["treenodes"]
    return _state(archive.deleted(nodes, tree.hierarchy(nodes), 1, 3, recursive=True))


@query(
    "branch_moved",
    f"{ARCH}, i AS (SELECT id FROM tree WHERE list_contains(ids, 3)), t AS (SELECT CASE WHEN i.id IS NULL THEN 1 ELSE 2 END::BIGINT AS page_id, n.id, CASE WHEN n.id = 3 THEN -1 ELSE parent_id END AS parent_id, sort_index FROM nodes n LEFT JOIN i USING (id)), {_COUNTED.format(t='t')}",
)
def _moved(spark, d):
    """A branch to another, empty page."""
    nodes = arch(spark, d)["treenodes"]
    return _state(archive.moved(nodes, tree.hierarchy(nodes), 1, 3, 2, -1))


@query(
    "node_reordered",
    f"{ARCH} SELECT id, CASE WHEN parent_id <> 2 THEN row_number() OVER (PARTITION BY parent_id ORDER BY sort_index, id) - 1 WHEN sort_index = 0 THEN 2 WHEN sort_index <= 2 THEN sort_index - 1 ELSE sort_index END AS sort_index FROM nodes",
)
def _reordered(spark, d):
    """The first of four siblings to the third place."""
    return archive.reordered(arch(spark, d)["treenodes"], 1, 8 + 1, 2).select("id", "sort_index")


@query("child_counts", f"{ARCH}, {_COUNTED.format(t='nodes')}")
def _recounted(spark, d):
    return _state(archive.recount(arch(spark, d)["treenodes"]))


@query("created_note", f"{ARCH} SELECT 'notes' AS kind, count(*) + 1 AS rows, max(uid) + 1 AS newest FROM notes UNION ALL SELECT 'contents', count(*) + 1, (SELECT max(uid) + 1 FROM notes) FROM contents UNION ALL SELECT 'nodes', count(*) + 1, max(id) + 1 FROM nodes")
def _created(spark, d):
    """A whole note: its row cloned from another, its contents and its node."""
    t = arch(spark, d)
    contents = t["contents"].select("id", F.col("text").cast("binary").alias("data"), "packed_size")
    notes, contents, nodes = archive.created(t["notes"], contents, t["treenodes"], page_id=1, parent_id=2, place=0, caption="a new note", spans=[("text", "p", True, False)])
    parts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.max(key).alias("newest")) for kind, df, key in (("notes", notes, "uid"), ("contents", contents, "id"), ("nodes", nodes, "id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_MADE_RTF = r"{\rtf1\ansi\deff0{\colortbl;\red255\green153\blue204;}{\highlight1\b text}}"


@query(
    "created_rows",
    f"""{ARCH}, t AS (SELECT page_id, id, parent_id, CASE WHEN parent_id = 2 THEN sort_index + 1 ELSE sort_index END AS sort_index, note_uid FROM nodes
 UNION ALL SELECT 1, max(id) + 1, 2, 0, (SELECT max(uid) + 1 FROM notes) FROM nodes),
placed AS ({_COUNTED.format(t="t").replace("c AS (", "WITH c AS (", 1).replace("SELECT n.page_id, n.id,", "SELECT note_uid, n.page_id, n.id,", 1)})
SELECT 'note' AS kind, uid AS id, page_id, NULL::BIGINT AS parent_id, NULL::BIGINT AS place, NULL::BIGINT AS other, md5(caption) AS content, bg_color, date_created FROM notes
UNION ALL SELECT 'note', max(uid) + 1, 1, NULL, NULL, NULL, md5('a new note'), '', min_by(date_created, uid) FROM notes
UNION ALL SELECT 'content', id, NULL, NULL, NULL, packed_size, md5(text), NULL, NULL FROM contents
UNION ALL SELECT 'content', max(uid) + 1, NULL, NULL, NULL, {len(_MADE_RTF)}, md5('{_MADE_RTF}'), NULL, NULL FROM notes
UNION ALL SELECT 'node', id, page_id, parent_id, sort_index, child_count, md5(note_uid::VARCHAR), NULL, NULL FROM placed""",
)
def _created_rows(spark, d):
    """Every row of the three tables after a note was created: untouched ones, moved siblings and the new ones."""
    t = arch(spark, d)
    contents = t["contents"].select("id", F.col("text").cast("binary").alias("data"), "packed_size")
    notes, contents, nodes = archive.created(t["notes"], contents, t["treenodes"], page_id=1, parent_id=2, place=0, caption="a new note", spans=[("text", "p", True, False)])
    none = F.lit(None)
    columns = ("kind", "id", "page_id", "parent_id", "place", "other", "content", "bg_color", "date_created")
    types = ("string", "long", "long", "long", "long", "long", "string", "string", "double")
    rows = (
        (notes, ("note", "uid", "page_id", none, none, none, F.md5(F.encode("caption", "UTF-8")), "bg_color", "date_created")),
        (contents, ("content", "id", none, none, none, "packed_size", F.md5("data"), none, none)),
        (nodes, ("node", "id", "page_id", "parent_id", "sort_index", "child_count", F.md5(F.col("note_uid").cast("string").cast("binary")), none, none)),
    )
    parts = [df.select(*((F.lit(v) if c == "kind" else F.col(v) if isinstance(v, str) else v).cast(k).alias(c) for c, k, v in zip(columns, types, values, strict=True))) for df, values in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Indexes that are kept, and trees by numbers

_CHANGED = CORPUS.replace("WITH corpus AS (", "WITH before AS (", 1).replace("),\nwords AS", "), corpus AS (SELECT * REPLACE (CASE WHEN unit_id % 10 = 3 THEN 'changed ' || coalesce(text, '') || ' again' ELSE text END AS text) FROM before WHERE unit_id % 10 <> 5),\nwords AS", 1)
_KEPT = f"{_CHANGED} SELECT term, count(DISTINCT unit_id) AS units, count(*) AS places, (SELECT n FROM size) AS n_units FROM words GROUP BY term"


def _kept_index(spark: SparkSession, d: str) -> str:
    """An index of nine tenths of the corpus, to which then a tenth comes, in which one changes and one goes."""
    c, path = T.corpus(spark, d).select("unit_id", "text"), folder(spark)
    tenth = F.col("unit_id") % 10
    segments.change(c.where(tenth != 7), path)
    segments.change(c.where(tenth == 7), path)
    segments.change(c.where(tenth == 3).withColumn("text", F.concat(F.lit("changed "), F.coalesce("text", F.lit("")), F.lit(" again"))), path, gone=c.where(tenth == 5))
    return path


def _per_term(spark: SparkSession, path: str) -> DataFrame:
    per = segments.postings(spark, path).groupBy("term").agg(F.count("*").alias("units"), F.sum(F.size("places")).alias("places"))
    return per.crossJoin(F.broadcast(segments.size(spark, path).select("n_units")))  # size is one row


@query("postings_after_changes", _KEPT)
def _postings_changed(spark, d):
    return _per_term(spark, _kept_index(spark, d))


@query("postings_merged", _KEPT)
def _postings_merged(spark, d):
    path = _kept_index(spark, d)
    segments.merge(spark, path)
    return _per_term(spark, path)


@query("bm25_of_kept_index", f"{_CHANGED}, r AS (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM bm25) SELECT query_id, unit_id, rank, round(score, 6) AS score FROM r WHERE rank <= 20")
def _bm25_kept(spark, d):
    """The twenty best of every question from the stored index."""
    path = _kept_index(spark, d)
    top = lexical.bm25_top(segments.postings(spark, path), segments.size(spark, path), T.questions(spark, d), 20)
    return top.select("query_id", "unit_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    "tree_walk",
    f"{TREE}, sized AS (SELECT a.id, a.ids, count(*) AS n FROM tree a JOIN (SELECT unnest(ids) AS id FROM tree) b ON a.id = b.id GROUP BY ALL), o AS (SELECT id, n, list_transform(ids, lambda x: lpad(x::VARCHAR, 12, '0')) AS key FROM sized), w AS (SELECT id, n, row_number() OVER (ORDER BY key) - 1 AS pre FROM o) SELECT id, pre, pre + n - 1 AS post FROM w",
)
def _walk(spark, d):
    """Every node's first and last place in a walk of the tree, siblings by id."""
    return tree.numbered(tree.hierarchy(T.nodes(spark, d))).select("id", "pre", "post")


@query("tree_unreached", f"{ARCH}, cut AS (SELECT id, CASE WHEN id % 50 = 7 THEN id + 1000000000 WHEN id = 9 THEN 38 ELSE parent_id END AS parent_id FROM nodes), up AS (SELECT id, parent_id, id AS at, parent_id AS next, 0 AS k FROM cut UNION ALL SELECT u.id, u.parent_id, c.id, c.parent_id, k + 1 FROM up u JOIN cut c ON u.next = c.id WHERE k < 60), e AS (SELECT id, arg_max(next, k) AS last, max(k) AS k FROM up GROUP BY id) SELECT id, CASE WHEN k >= 60 THEN 'cycle' ELSE 'missing parent' END AS reason FROM e WHERE k >= 60 OR last <> -1")
def _unreached(spark, d):
    """The document tree with some parents taken away and a cycle put in."""
    i = F.col("id")
    parent = F.when(i % 50 == 7, i + 1_000_000_000).when(i == 9, 38).otherwise(F.col("parent_id"))
    return tree.unreached(arch(spark, d)["treenodes"].withColumn("parent_id", parent)).select("id", "reason")


_TILES = f"""{TREE}, u AS (SELECT chars, unnest(ids) AS id FROM tree), s AS (SELECT n.id, n.parent_id, n.caption, sum(u.chars)::DOUBLE AS size FROM nodes n JOIN u ON n.id = u.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY size DESC, id) AS k FROM s), t AS (SELECT parent_id, CASE WHEN k <= 27 THEN id::VARCHAR ELSE 'other' END AS tile, sum(size) AS size, count(*) AS nodes FROM r GROUP BY ALL),
v(parent_id, level, tile, size, nodes, area) AS (SELECT parent_id, 1, tile, size, nodes, size / (SELECT sum(size) FROM t WHERE parent_id = -1) FROM t WHERE parent_id = -1
 UNION ALL SELECT t.parent_id, v.level + 1, t.tile, t.size, t.nodes, v.area * t.size / (SELECT sum(size) FROM t b WHERE b.parent_id = t.parent_id) FROM v JOIN t ON t.parent_id::VARCHAR = v.tile WHERE v.level < 3 AND v.area > 0)"""


@query("tree_treemap", f"{_TILES} SELECT parent_id::BIGINT AS parent_id, level, tile, size, nodes, round(area, 9) AS area, TRUE AS inside FROM v")
def _treemap(spark, d):
    """Three levels of tiles in a unit square: areas, and whether each tile lies in its parent's."""
    sized = tree.rollup(tree.hierarchy(T.nodes(spark, d)), ["chars"])
    laid = treemap.treemap(sized, "subtree_chars", levels=3)
    up = laid.select(F.col("tile").alias("__up"), *(F.col(c).alias(f"up_{c}") for c in "xywh")).where("__up <> 'other'")
    met = laid.join(up, F.col("parent_id").cast("string") == F.col("__up"), "left").fillna({"up_x": 0.0, "up_y": 0.0, "up_w": 1.0, "up_h": 1.0})
    room = 1e-9
    inside = (F.col("x") >= F.col("up_x") - room) & (F.col("y") >= F.col("up_y") - room) & (F.col("x") + F.col("w") <= F.col("up_x") + F.col("up_w") + room) & (F.col("y") + F.col("h") <= F.col("up_y") + F.col("up_h") + room)
    return met.select("parent_id", "level", "tile", "size", "nodes", F.round(F.col("w") * F.col("h"), 9).alias("area"), inside.alias("inside"))


@query("appended_note", "SELECT doc_id, CASE WHEN doc_id = 17 THEN md5(coalesce(text, '') || chr(10) || 'added') WHEN doc_id % 13 <> 5 THEN md5(coalesce(text, '')) END AS digest FROM documents")
def _appended(spark, d):
    """A piece behind one note's rich text; some notes have no contents at all."""
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 != 5, rtf_of_text(F.coalesce("text", F.lit(""))).cast("binary")).alias("data"))
    out = archive.appended(docs, 17, "\nadded", "p")
    text = S.plain_text(spans_of_text(F.col("data").cast("string")))
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("data").isNotNull(), F.md5(text.cast("binary"))).alias("digest"))


@query("vector_blobs", "SELECT vec_id, 4 * len(embedding) AS bytes, round(list_sum(embedding::DOUBLE[]), 6) AS total, embedding[1]::DOUBLE AS first FROM embeddings")
def _blobs(spark, d):
    """Vectors written as the bytes of float32 places and read back."""
    stored = T.table(spark, d, "embeddings").select("vec_id", C.blob_of_vector(F.col("embedding")).alias("blob"))
    read = stored.select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), C.vector_of_blob(F.col("blob")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read.select("vec_id", "bytes", F.round(total, 6).alias("total"), F.get("v", F.lit(0)).cast("double").alias("first"))


@query("corpus_by_colour", f"{UNITS}, good AS (SELECT * FROM units WHERE NOT is_trivial AND NOT is_separator AND NOT is_duplicate AND length(trim(text)) > 12) SELECT coalesce(color, 'unmarked') AS color, count(*) AS fragments FROM good GROUP BY 1")
def _corpus_colours(spark, d):
    return service.Archive(T.units(spark, d).where(units.retrievable())).corpus_by_colour()


@query(
    "tree_json",
    f"{TREE}, w AS (SELECT t.id, t.depth, row_number() OVER o - 1 AS pre, lag(t.depth) OVER o AS was, n.caption FROM tree t JOIN nodes n ON n.id = t.id WINDOW o AS (ORDER BY list_transform(t.ids, lambda x: lpad(x::VARCHAR, 12, '0')))) "
    """SELECT pre, CASE WHEN pre = 0 THEN '[' WHEN was >= depth THEN repeat(']}', was - depth + 1) || ',' ELSE '' END || '{"id":' || id || ',"caption":"' || caption || '","children":[' AS line FROM w """
    "UNION ALL SELECT pre + 1, repeat(']}', depth + 1) || ']' FROM (SELECT * FROM w ORDER BY pre DESC LIMIT 1)",
)
def _json(spark, d):
    """The whole tree as one nested JSON value, a line a node."""
    return tree.json_lines(tree.hierarchy(T.nodes(spark, d)), {"id": "id", "caption": "caption"}).select("pre", "line")


_SPREAD = "replace(replace(coalesce(text, ''), ', ', repeat(chr(10), 3)), '. ', repeat(chr(10), 6))"
_BROKEN = _SPREAD
for _pattern, _token in (("={10,}", "[BR3]"), ("={3,9}", "[BR2]"), ("x{3,}", "[BR2]"), (r"\n{5,}", "[BR3]"), (r"\n{3,4}", "[BR2]")):
    _BROKEN = f"regexp_replace({_BROKEN}, '{_pattern}', chr(10) || '{_token}' || chr(10), 'g')"


@query("encoded_breaks", f"SELECT doc_id, md5({_BROKEN}) AS digest, ({_BROKEN}) LIKE '%[BR3]%' AS sections FROM documents")
def _encoded_breaks(spark, d):
    """Texts with rows of newlines behind commas and full stops, by all five rules of breaks."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit("\n" * 3)), F.lit(". "), F.lit("\n" * 6))
    encoded = S.encode_breaks(text)
    return T.table(spark, d, "documents").select("doc_id", F.md5(encoded.cast("binary")).alias("digest"), F.contains(encoded, F.lit("[BR3]")).alias("sections"))
