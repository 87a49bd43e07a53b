"""Text, JSON, Markdown and name functions over documents, pages, events and library tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import markup as K
from lectern.functions import text as T
from lectern.functions.maths import round6
from lectern.plans.catalog import query, table
from lectern.plans.geometry_queries import r6
from lectern.plans.table_queries import _ITEMS, items
from lectern.plans.text_queries import _clean, _strip

_LOW = f"lower({_clean('text')})"


@query(
    "str_cue_variant",
    f"SELECT conv_id, turn, CASE WHEN t = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {' + '.join(f"(CASE WHEN starts_with(t, '{w}') THEN 0.5::DOUBLE ELSE 0 END)" for w in K.OPENINGS)} + (CASE WHEN regexp_matches(t, '{T.CUE_PATTERN}') THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(left(t, 50), ':\\s*$') THEN 0.15::DOUBLE ELSE 0 END)) END AS score FROM (SELECT conv_id, turn, {_LOW} AS t FROM conversations)",
)
def str_cue_variant(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", K.cue_score(F.col("text"), T.CUE_PATTERN).alias("score"))


@query("str_json_parts", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (json_extract_string(props, '$.k'))::BIGINT END AS k, CASE event_id % 4 WHEN 2 THEN 2 ELSE 0 END AS n FROM events")
def str_json_parts(spark, sf):
    """JSON objects as whole texts, inside other words, or broken; and lists likewise."""
    kind, props = F.col("event_id") % 4, F.col("props")
    raw = F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("Sure:\n"), props, F.lit(" done."))).when(kind == 2, F.concat(F.lit("see [1, "), props, F.lit("]"))).otherwise(F.concat(F.lit("{broken "), props, F.lit("} }")))
    listed = F.coalesce(F.size(F.from_json(K.json_text(raw, "[", "]"), "array<string>")), F.lit(0))
    return table(spark, sf, "events").select("event_id", F.get_json_object(K.json_text(raw), "$.k").try_cast("long").alias("k"), listed.alias("n"))


@query("str_variant_name", r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_\-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'variant') AS name FROM pages")
def str_variant_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", K.variant_name(F.col("url")).alias("name"))


@query(
    "str_source_text",
    f"""SELECT conv_id, turn, md5(array_to_string(list_filter([CASE WHEN role <> '' THEN 'НАЗВАНИЕ РАЗДЕЛА:' || chr(10) || {_clean('role')} END, CASE WHEN t <> '' THEN 'ТЕКСТ ЛЕКТОРА:' || chr(10) || t END,
    'ТЕКСТ СО СЛАЙДОВ / ДОСКИ:' || chr(10) || 'КАДР 2, время 00:0' || (turn % 10) || ':' || chr(10) || {_clean('role')}], lambda x: x IS NOT NULL), chr(10) || chr(10))) AS h FROM (SELECT *, {_clean('text')} AS t FROM conversations)""",
)
def str_source_text(spark, sf):
    """What is written up for a segment: title, speech, and slides that have text."""
    stamp = F.concat(F.lit("00:0"), (F.col("turn") % 10).cast("string"))
    slides = F.array(F.struct(stamp.alias("stamp"), F.lit("  ").alias("text")), F.struct(stamp.alias("stamp"), F.col("role").alias("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(K.source_text(F.col("role"), F.col("text"), slides)).alias("h"))


@query("str_modes", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'текстовый' WHEN 'O' THEN 'смешанный' ELSE 'насыщенный' END AS mode FROM orders")
def str_modes(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", K.mode_name(F.when(s == "F", "text_only").when(s == "O", "mixed").otherwise("rich")).alias("mode"))


@query("str_word_tokens", r"SELECT doc_id, len(list_distinct(w)) AS n, md5(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ')) AS h FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)'), lambda x: x NOT IN ('the', 'and', 'das', 'les')) AS w FROM documents WHERE length(text) < 4000)".replace(" WHERE length(text) < 4000", ""))
def str_word_tokens(spark, sf):
    """Distinct words in order, without punctuation and stop-words."""
    w = F.filter(K.words(F.col("text")), lambda x: ~x.isin("the", "and", "das", "les"))
    rows = table(spark, sf, "documents").select("doc_id", F.array_distinct(w).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("h"))


@query(
    "str_plan_transcript",
    f"""WITH {_ITEMS.replace('SELECT doc_id, i, length(s) AS n', 'SELECT doc_id, i, s, length(s) AS n')}, c AS (SELECT doc_id, i, s, a, b, i // ceil(max(i + 1) OVER (PARTITION BY doc_id) / 10.0)::BIGINT AS part FROM items),
    p AS (SELECT doc_id, part, round_even(min(a), 0)::BIGINT AS x, round_even(max(b), 0)::BIGINT AS y, {_clean("string_agg(s, ' ' ORDER BY i)")} AS t FROM c GROUP BY ALL),
    q AS (SELECT doc_id, part, '[' || CASE WHEN x >= 3600 THEN printf('%02d:%02d:%02d', x // 3600, x % 3600 // 60, x % 60) ELSE printf('%02d:%02d', x // 60, x % 60) END || '–' || CASE WHEN y >= 3600 THEN printf('%02d:%02d:%02d', y // 3600, y % 3600 // 60, y % 60) ELSE printf('%02d:%02d', y // 60, y % 60) END || ']' || chr(10) ||
    CASE WHEN length(t) <= 900 THEN t ELSE {_strip("regexp_replace(left(t, 900), ' [^ ]*$', '')")} || ' …' END AS block FROM p)
    SELECT doc_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY part)) AS h, count(*) AS n FROM q GROUP BY 1""",
)
def str_plan_transcript(spark, sf):
    """A transcript in at most ten even parts, each with its times and the beginning of its text."""
    n = F.max(F.col("i") + 1).over(Window.partitionBy("doc_id"))
    c = items(spark, sf).withColumn("part", F.floor(F.col("i") / F.ceil(n / 10.0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda r: r.text), " ")
    p = c.groupBy("doc_id", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"), text.alias("t"))
    block = F.concat(F.lit("["), T.format_ts(F.col("a")), F.lit("–"), T.format_ts(F.col("b")), F.lit("]\n"), T.truncate(F.col("t"), 900))
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", block.alias("x")))), lambda r: r.x), "\n\n")
    return p.groupBy("doc_id").agg(F.md5(blocks).alias("h"), F.count("*").alias("n"))


@query("str_fallback_note", f"SELECT doc_id, md5('## Черновик конспекта' || chr(10) || chr(10) || coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')[1:12], lambda x: '- ' || x), chr(10)), '')) AS h FROM documents")
def str_fallback_note(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(K.fallback_note(F.col("text"))).alias("h"))


@query("str_model_alias", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'mistral' WHEN contains(lower(url), 'qwen') THEN 'qwen' WHEN contains(lower(url), 'the') THEN 'the' ELSE 'qwen' END AS model FROM pages")
def str_model_alias(spark, sf):
    name = F.when(F.col("page_id") % 3 == 0, " Mistral ").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", K.model_alias(name, ("mistral", "qwen", "the")).alias("model"))


@query(
    "str_plan_normalise",
    r"""WITH t AS (SELECT p_partkey, left(regexp_replace(CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || (p_partkey % 7) WHEN 1 THEN p_brand ELSE p_type END, '^[ \-—:;.0-9]+|[ \-—:;.0-9]+$', '', 'g'), 90) AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS description, p_type AS plan FROM part),
    f AS (SELECT *, row_number() OVER (PARTITION BY plan, lower(title) ORDER BY p_partkey) AS rn FROM t WHERE title <> '') SELECT plan, title, description, row_number() OVER (PARTITION BY plan ORDER BY p_partkey) AS number FROM f WHERE rn = 1""",
)
def str_plan_normalise(spark, sf):
    """Plan items with their title in one of three fields, one for each spelling, numbered within their plan."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    title = K.plan_title(F.when(k % 3 == 0, F.concat("p_name", F.lit(" "), (k % 7).cast("string"))), F.when(k % 3 == 1, F.col("p_brand")), F.col("p_type"))
    t = p.select("p_partkey", title.alias("title"), K.plan_description(F.when(k % 2 == 0, F.col("p_type")), F.col("p_name")).alias("description"), F.col("p_type").alias("plan")).where("title <> ''")
    one = t.withColumn("rn", F.row_number().over(Window.partitionBy("plan", F.regexp_replace(F.lower("title"), "ё", "е")).orderBy("p_partkey"))).where("rn = 1")
    return one.select("plan", "title", "description", F.row_number().over(Window.partitionBy("plan").orderBy("p_partkey")).cast("long").alias("number"))


@query("str_label_cells", "SELECT l_orderkey, l_linenumber, CASE WHEN c IN ('1', '1.0', 'true', 'yes', 'y', 'да', 'истина', 'tp', 'тп') OR try_cast(replace(c, ',', '.') AS DOUBLE) = 1 THEN 1 WHEN c IN ('0', '0.0', 'false', 'no', 'n', 'нет', 'ложь', 'fp', 'фп') OR try_cast(replace(c, ',', '.') AS DOUBLE) = 0 THEN 0 END AS label FROM (SELECT l_orderkey, l_linenumber, lower(trim(CASE l_linenumber % 4 WHEN 0 THEN l_returnflag WHEN 1 THEN ' ' || replace((l_quantity / 10)::VARCHAR, '.', ',') WHEN 2 THEN (l_quantity % 3)::INT::VARCHAR ELSE '0' END)) AS c FROM lineitem)")
def str_label_cells(spark, sf):
    """Label cells as people type them: letters, decimal commas, numbers."""
    kind = F.col("l_linenumber") % 4
    cell = F.when(kind == 0, F.col("l_returnflag")).when(kind == 1, F.concat(F.lit(" "), F.replace((F.col("l_quantity") / 10).cast("string"), F.lit("."), F.lit(",")))).when(kind == 2, (F.col("l_quantity") % 3).cast("int").cast("string")).otherwise("0")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.binary_label(cell).alias("label"))


_KIND = r"""CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '!\[[^\]]*\]\([^)]+\)') THEN 'image' WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 'heading' WHEN regexp_matches(line, '^\s*[-*+]\s+\S') THEN 'ul' WHEN regexp_matches(line, '^\s*\d+[.)]\s+\S') THEN 'ol' ELSE 'paragraph' END"""
_MARKED = "SELECT doc_id, string_split(CASE doc_id % 3 WHEN 0 THEN '# Title' || chr(10) || '```' || chr(10) || text || chr(10) || '- in code' || chr(10) || '```' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || '1. three' WHEN 1 THEN '## Part' || chr(10) || text || chr(10) || '![a](b.png) rest' ELSE text END, chr(10)) AS ls FROM documents"


@query(
    "str_markdown_fences",
    f"""WITH l AS (SELECT doc_id, u.line, u.i FROM ({_MARKED}), LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u), f AS (SELECT *, starts_with(trim(line), '```') AS fence, sum(starts_with(trim(line), '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM l),
    k AS (SELECT doc_id, i, CASE WHEN fence THEN 'fence' WHEN fences % 2 = 1 THEN 'code' ELSE {_KIND} END AS kind, CASE WHEN NOT fence AND fences % 2 = 0 AND regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^#+')) ELSE 0 END AS level FROM f),
    b AS (SELECT *, sum(CASE WHEN kind IN ('heading', 'image', 'fence', 'blank') OR kind <> coalesce(prev, '') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k))
    SELECT doc_id, kind, level, count(DISTINCT block) AS blocks, count(*) AS lines FROM b WHERE kind NOT IN ('fence', 'blank') GROUP BY ALL""",
)
def str_markdown_fences(spark, sf):
    """Blocks of Markdown: a fence opens or closes code, inside nothing else counts; lines of one kind in a row are one block."""
    k, t = F.col("doc_id") % 3, F.col("text")
    body = F.when(k == 0, F.concat(F.lit("# Title\n```\n"), t, F.lit("\n- in code\n```\n- one\n- two\n1. three"))).when(k == 1, F.concat(F.lit("## Part\n"), t, F.lit("\n![a](b.png) rest"))).otherwise(t)
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(body, "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    fence = F.startswith(F.trim("line"), F.lit("```"))
    f = lines.withColumn("fence", fence).withColumn("fences", F.sum(fence.cast("int")).over(w))
    kind = F.when(F.col("fence"), "fence").when(F.col("fences") % 2 == 1, "code").otherwise(K.line_kind(F.col("line")))
    f = f.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^#+", 0))).otherwise(0))
    alone = F.col("kind").isin("heading", "image", "fence", "blank") | (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit("")))
    b = f.withColumn("new", alone.cast("int")).withColumn("block", F.sum("new").over(w))
    return b.where("kind NOT IN ('fence', 'blank')").groupBy("doc_id", "kind", "level").agg(F.count_distinct("block").alias("blocks"), F.count("*").alias("lines"))


@query("str_image_sources", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'pics/a b-' || page_id || '.png' ELSE 'dir/' || page_id || '.png' END AS src FROM pages""")
def str_image_sources(spark, sf):
    """Links of images as written in Markdown and HTML: schemes stay, titles, brackets, codes and backslashes go."""
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" <"), F.col("url"), F.lit(">"))).when(k == 1, F.concat(F.lit("pics/a%20b-"), n, F.lit('.png "a title"'))).otherwise(F.concat(F.lit("dir\\"), n, F.lit(".png 'x'")))
    return table(spark, sf, "pages").select("page_id", K.image_source(raw).alias("src"))


@query("agg_visual_mode", f"SELECT o_custkey, sum(o_orderkey % 3)::BIGINT AS images, count(*) AS segments, CASE WHEN sum(o_orderkey % 3) = 0 THEN 'текстовый' WHEN sum(o_orderkey % 3) <= count(*) THEN 'смешанный' ELSE 'насыщенный' END AS mode, {r6('max(o_totalprice)')} AS duration, count(*) FILTER (o_totalprice < 50000 OR o_orderkey % 7 = 0) AS ambiguous FROM orders GROUP BY 1")
def agg_visual_mode(spark, sf):
    """A note's overall mode from its pictures and segments, its duration, and how many of its windows are ambiguous."""
    n = F.sum(F.col("o_orderkey") % 3)
    mode = K.mode_name(F.when(n == 0, "text_only").when(n <= F.count("*"), "mixed").otherwise("rich"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(n.alias("images"), F.count("*").alias("segments"), mode.alias("mode"), round6(F.max("o_totalprice")).alias("duration"), F.count_if((F.col("o_totalprice") < 50000) | (F.col("o_orderkey") % 7 == 0)).alias("ambiguous"))
