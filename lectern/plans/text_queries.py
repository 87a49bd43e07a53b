"""Text operators over documents, pages, benchmark and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.cut import cut
from lectern.operators.lemmas import EXCEPTIONS, RULES, lemmas
from lectern.plans.catalog import query, spread, table

_EDGE = r"'^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_EDGE})"


def _clean(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(replace(replace(coalesce({x}, ''), chr(160), ' '), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(replace(lower({_clean(x)}), 'ё', 'е'), '{T.TOKEN}'), lambda t: NOT list_contains({_STOP}, t))"


def _sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({_clean(x)}, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \-•\n\t]+|[ \-•\n\t]+$', '', 'g')), lambda s: s <> '')"


def _docs(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("str_clean_text", f"SELECT doc_id, length({_clean('text')}) AS n, md5({_clean('text')}) AS h FROM documents")
def str_clean_text(spark, sf):
    c = T.clean_text(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("h"))


@query(
    "str_preprocess_text",
    rf"SELECT doc_id, md5({_strip(rf"regexp_replace(array_to_string(list_transform(string_split(replace(coalesce(text, ''), chr(160), ' '), chr(10)), lambda l: {_strip('l')}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")}) AS h FROM documents",
)
def str_preprocess_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.preprocess_text(F.col("text"))).alias("h"))


@query("str_escape_markdown", r"SELECT doc_id, md5(regexp_replace(text, '([\\*_])', '\\\1', 'g')) AS h FROM documents")
def str_escape_markdown(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.escape_markdown(F.col("text"))).alias("h"))


@query(
    "str_truncate",
    f"SELECT doc_id, CASE WHEN length(c) <= 450 THEN c ELSE {_strip("regexp_replace(left(c, 450), ' [^ ]*$', '')")} || ' …' END AS short FROM (SELECT doc_id, {_clean('text')} AS c FROM documents)",
)
def str_truncate(spark, sf):
    return _docs(spark, sf).select("doc_id", T.truncate(F.col("text"), 450).alias("short"))


@query("str_sentences", f"SELECT doc_id, len(s) AS n, s[1] AS first, s[-1] AS last FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)")
def str_sentences(spark, sf):
    s = _docs(spark, sf).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


@query("str_tokens", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)")
def str_tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


_TF = f"SELECT doc_id, u.t AS token, u.i AS pos FROM (SELECT doc_id, {_tokens('text')} AS ts FROM documents), LATERAL (SELECT unnest(ts) AS t, generate_subscripts(ts, 1) AS i) u"


def token_rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("at", "token"))


@query("str_vectorize", f"SELECT doc_id, token, count(*) AS tf FROM ({_TF}) GROUP BY ALL")
def str_vectorize(spark, sf):
    return token_rows(_docs(spark, sf)).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query(
    "str_top_keywords",
    f"SELECT doc_id, token, tf, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, pos) AS rank FROM (SELECT doc_id, token, count(*) AS tf, min(pos) AS pos FROM ({_TF}) GROUP BY ALL)) WHERE rank <= 6",
)
def str_top_keywords(spark, sf):
    return top_keywords(_docs(spark, sf), 6)


def top_keywords(documents: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens of each document; ties by first place."""
    counted = token_rows(documents).groupBy("doc_id", "token").agg(F.count("*").alias("tf"), F.min("at").alias("at"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "at")
    return counted.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("at")


@query(
    "str_transition_score",
    f"SELECT doc_id, CASE WHEN t = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {' + '.join(f"(CASE WHEN starts_with(t, '{w}') THEN 0.55::DOUBLE ELSE 0 END)" for w in T.CUES)} + (CASE WHEN regexp_matches(t, '{T.CUE_PATTERN}') THEN 0.35::DOUBLE ELSE 0 END)) END AS score FROM (SELECT doc_id, lower({_clean('text')}) AS t FROM documents)",
)
def str_transition_score(spark, sf):
    return _docs(spark, sf).select("doc_id", T.transition_score(F.col("text")).alias("score"))


@query(
    "str_format_ts",
    "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS stamp FROM (SELECT event_id, greatest(0, round_even(value * 25, 0)::BIGINT) AS s FROM events)",
)
def str_format_ts(spark, sf):
    return table(spark, sf, "events").select("event_id", T.format_ts(F.col("value") * 25).alias("stamp"))


@query("str_time_from_name", "SELECT event_id, event_id + 0.5::DOUBLE AS seconds FROM events")
def str_time_from_name(spark, sf):
    name = F.concat(F.lit("seg_0001_f_00"), F.col("event_id"), F.lit("_"), F.col("event_id"), F.lit(".50s.jpg"))
    return table(spark, sf, "events").select("event_id", T.time_from_name(name).alias("seconds"))


@query(
    "str_safe_stem",
    r"""SELECT page_id, regexp_replace(left(CASE WHEN upper(t) IN ('CON', 'PRN', 'AUX', 'NUL') THEN t || '_file' ELSE t END, 120), '[ ._]+$', '') AS stem FROM (
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS t FROM pages)""",
)
def str_safe_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@query("str_safe_name", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '\s+', '_', 'g'), '[^A-Za-z0-9_.\-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages")
def str_safe_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("str_stable_id", "SELECT page_id, 'page_' || left(md5(url), 8) AS stable_id FROM pages")
def str_stable_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("page_"), F.left(F.md5("url"), F.lit(8))).alias("stable_id"))


@query("str_frame_name", "SELECT event_id, printf('v%d_f%08d_t%012d.jpg', user_id, event_id, round_even(value * 1000, 0)::BIGINT) AS name FROM events")
def str_frame_name(spark, sf):
    return table(spark, sf, "events").select("event_id", F.format_string("v%d_f%08d_t%012d.jpg", "user_id", "event_id", F.bround(F.col("value") * 1000, 0).cast("long")).alias("name"))


@query(
    "str_inline_html",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '\*\*([^*]+)\*\*', '<b>\1</b>', 'g'), '__([^_]+)__', '<b>\1</b>', 'g'), '\*([^*]+)\*', '<i>\1</i>', 'g'), '`([^`]+)`', '<font>\1</font>', 'g')) AS h FROM documents""",
)
def str_inline_html(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.inline_html(F.col("text"))).alias("h"))


_KIND = r"""CASE WHEN regexp_matches(line, '^\s*```') THEN 'fence' WHEN regexp_matches(line, '^!\[') THEN 'image' WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading'
    WHEN regexp_matches(line, '^\s*[-*+]\s+') THEN 'ul' WHEN regexp_matches(line, '^\s*\d+[.)]\s+') THEN 'ol' WHEN line = '' THEN 'blank' ELSE 'paragraph' END"""


@query("str_markdown_blocks", f"SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, {_KIND} AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY ALL")
def str_markdown_blocks(spark, sf):
    line = F.col("line")
    kind = (
        F.when(line.rlike(r"^\s*```"), "fence").when(line.rlike(r"^!\["), "image").when(line.rlike(r"^#{1,6}\s"), "heading")
        .when(line.rlike(r"^\s*[-*+]\s+"), "ul").when(line.rlike(r"^\s*\d+[.)]\s+"), "ol").when(line == "", "blank").otherwise("paragraph")
    )
    lines = _docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", kind.alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("str_image_links", """SELECT page_id, len(l) AS n, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<(?:img|a)[^>]*(?:src|href)="([^"]*)"', 1) AS l FROM pages)""")
def str_image_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<(?:img|a)[^>]*(?:src|href)="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", links.alias("l")).select("page_id", F.size("l").cast("long").alias("n"), F.array_join("l", " ").alias("links"))


_CELLS = ("1", "0", "1.0", "1,0", "да", "FALSE", " tp ", "2", "", "нет")


@query("str_binary_label", f"SELECT event_id, [1, 0, 1, 1, 1, 0, 1, -1, -1, 0][event_id % 10 + 1] AS label FROM events")
def str_binary_label(spark, sf):
    cell = F.element_at(F.array(*[F.lit(c) for c in _CELLS]), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.coalesce(T.binary_label(cell), F.lit(-1)).alias("label"))


@query("str_json_object", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), -1) AS k FROM events")
def str_json_object(spark, sf):
    return table(spark, sf, "events").select("event_id", T.safe_float(F.get_json_object("props", "$.k"), -1.0).alias("k"))


@query(
    "str_plan_items",
    r"""SELECT title, row_number() OVER (ORDER BY item_id) AS number FROM (SELECT min(item_id) AS item_id, min_by(title, item_id) AS title FROM
    (SELECT item_id, left(regexp_replace(text, '^[ \-—:;.0-9]+|[ \-—:;.0-9]+$', '', 'g'), 90) AS title FROM benchmark) GROUP BY replace(lower(title), 'ё', 'е'))""",
)
def str_plan_items(spark, sf):
    """Titles cut and stripped, one for each spelling, renumbered: a plan is a short list, so one order over it is fine."""
    titles = table(spark, sf, "benchmark").select("item_id", F.left(F.regexp_replace("text", r"^[ \-—:;.0-9]+|[ \-—:;.0-9]+$", ""), F.lit(90)).alias("title"))
    one = titles.groupBy(F.regexp_replace(F.lower("title"), "ё", "е").alias("key")).agg(F.min_by("title", "item_id").alias("title"), F.min("item_id").alias("item_id"))
    return one.select("title", F.row_number().over(Window.orderBy("item_id")).cast("long").alias("number"))


@query("str_token_windows", f"SELECT doc_id, i // 180 AS part, array_to_string(t[i + 1 : i + 220], ' ') AS chunk FROM (SELECT doc_id, t, unnest(range(0, len(t), 180)) AS i FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents) WHERE len(t) > 0)")
def str_token_windows(spark, sf):
    """Windows of 220 tokens, each 40 into the one before."""
    t = _docs(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    parts = t.select("doc_id", "t", F.explode(F.expr("sequence(0, size(t) - 1, 180)")).alias("i"))
    return parts.select("doc_id", F.floor(F.col("i") / 180).alias("part"), F.array_join(F.expr("slice(t, i + 1, 220)"), " ").alias("chunk"))


@query("str_fallback_bullets", f"SELECT doc_id, array_to_string(list_transform(s[1:4], lambda x: '- ' || x), chr(10)) AS bullets FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)")
def str_fallback_bullets(spark, sf):
    s = F.slice(T.sentences(F.col("text")), 1, 4)
    return _docs(spark, sf).select("doc_id", F.array_join(F.transform(s, lambda x: F.concat(F.lit("- "), x)), "\n").alias("bullets"))


@query(
    "txt_word_frequency",
    f"""WITH s AS (SELECT doc_id, u.x AS sentence, u.i AS i FROM (SELECT doc_id, {_sentences('text')} AS ss FROM documents), LATERAL (SELECT unnest(ss) AS x, generate_subscripts(ss, 1) AS i) u),
    w AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(sentence), '[a-z]+')) AS word FROM s),
    f AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
    v AS (SELECT doc_id, i, sum(n)::BIGINT AS score FROM w JOIN f USING (doc_id, word) GROUP BY ALL)
    SELECT doc_id, i AS sentence, score FROM (SELECT *, sum(score) OVER (PARTITION BY doc_id)::BIGINT // count(*) OVER (PARTITION BY doc_id) AS average FROM v) WHERE score > 1.5 * average""",
)
def txt_word_frequency(spark, sf):
    """Sentences that score above one and a half times the average, by the frequency of their words."""
    s = _docs(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    w = s.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    # a word's places in a sentence first, so that the join meets each word of a sentence once
    local = w.groupBy("doc_id", "i", "word").agg(F.count("*").alias("c"))
    f = local.groupBy("doc_id", "word").agg(F.sum("c").alias("n"))
    v = local.join(f, ["doc_id", "word"]).groupBy("doc_id", "i").agg(F.sum(F.col("n") * F.col("c")).alias("score"))
    d = Window.partitionBy("doc_id")
    return v.withColumn("average", F.floor(F.sum("score").over(d) / F.count("*").over(d))).where("score > 1.5 * average").select("doc_id", F.col("i").alias("sentence"), "score")


@query(
    "mth_sparse_cosine",
    f"""WITH a AS (SELECT doc_id, token, count(*) AS tf FROM ({_TF}) GROUP BY ALL), na AS (SELECT doc_id, sqrt(sum(tf * tf)::DOUBLE) AS n FROM a GROUP BY 1),
    b AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_tokens('text')}) AS token FROM benchmark) GROUP BY ALL), nb AS (SELECT item_id, sqrt(sum(tf * tf)::DOUBLE) AS n FROM b GROUP BY 1)
    SELECT doc_id, item_id, round_even(sum(a.tf * b.tf)::DOUBLE / (any_value(na.n) * any_value(nb.n)), 6) AS cos FROM a JOIN b USING (token) JOIN na USING (doc_id) JOIN nb USING (item_id) GROUP BY ALL""",
)
def mth_sparse_cosine(spark, sf):
    """Cosine of bags of words of documents and plan sections that share a token."""
    a = token_rows(_docs(spark, sf)).groupBy("doc_id", "token").agg(F.count("*").alias("x"))
    b = table(spark, sf, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("y"))
    na = a.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x")).cast("double")).alias("na"))
    nb = b.groupBy("item_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y")).cast("double")).alias("nb"))
    dots = a.join(b, "token").groupBy("doc_id", "item_id").agg(F.sum(F.col("x") * F.col("y")).cast("double").alias("dot"))
    return dots.join(na, "doc_id").join(nb, "item_id").select("doc_id", "item_id", F.bround(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cos"))


#: Endings of English words, and words that have none of them. Fixed values of the query; the operator takes any.
_RULES = (("ies", "y", 2), ("sses", "ss", 1), ("ing", "", 3), ("tions", "tion", 2), ("ed", "", 3), ("es", "e", 3), ("s", "", 3))
_IRREGULAR = (("is", "be"), ("was", "be"), ("are", "be"), ("this", "this"), ("his", "he"), ("thing", "thing"))
_LEMMA = "CASE " + " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in _IRREGULAR) + " " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= {n} THEN left(w, length(w) - {len(s)}) || '{e}'" for s, e, n in sorted(_RULES, key=lambda r: -len(r[0]))) + " ELSE w END"


@query("str_lemmas", f"SELECT lemma, count(*) AS n, count(DISTINCT w) AS forms FROM (SELECT w, {_LEMMA} AS lemma FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)) GROUP BY 1")
def str_lemmas(spark, sf):
    """How often each lemma stands in all documents, and in how many forms: words are counted first, so rules meet distinct words only."""
    words = _docs(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    n = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    found = lemmas(n, spark.createDataFrame(_RULES, RULES), spark.createDataFrame(_IRREGULAR, EXCEPTIONS))
    return n.join(found, "word").groupBy("lemma").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))
