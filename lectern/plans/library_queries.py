"""The library's tables: orders are notes, customers their owners, line items their tags and frames, labels their reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.markup import VIDEO_SUFFIXES
from lectern.operators.layout import laid_out
from lectern.plans.catalog import query, table
from lectern.plans.geometry_queries import r6

_NAME = "'Lecture ' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.webm' WHEN 2 THEN '.txt' ELSE '.mkv' END"


def _name():
    k = F.col("o_orderkey")
    return F.concat(F.lit("Lecture "), k.cast("string"), F.when(k % 4 == 0, ".MP4").when(k % 4 == 1, ".webm").when(k % 4 == 2, ".txt").otherwise(".mkv"))


@query("flt_upload", f"SELECT o_orderkey, {_NAME} AS name FROM orders WHERE regexp_matches(lower({_NAME}), '[.](mp4|mkv|avi|mov|webm|m4v)$')")
def flt_upload(spark, sf):
    """Uploads that are videos by their names."""
    ok = F.lower(_name()).rlike("(" + "|".join(s.replace(".", "[.]") for s in VIDEO_SUFFIXES) + ")$")
    return table(spark, sf, "orders").where(ok).select("o_orderkey", _name().alias("name"))


@query("flt_unique_mail", "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE lower('User' || (c.c_custkey % 20) || '@X.org') = lower('USER' || s.s_suppkey || '@x.org'))")
def flt_unique_mail(spark, sf):
    """New accounts whose address nobody has, whatever its case."""
    new = table(spark, sf, "supplier").select("s_suppkey", F.lower(F.concat(F.lit("USER"), F.col("s_suppkey").cast("string"), F.lit("@x.org"))).alias("mail"))
    old = table(spark, sf, "customer").select(F.lower(F.concat(F.lit("User"), (F.col("c_custkey") % 20).cast("string"), F.lit("@X.org"))).alias("mail"))
    return new.join(old, "mail", "left_anti").select("s_suppkey")


@query("set_exclude_self", "SELECT c.c_custkey, EXISTS (SELECT 1 FROM customer o WHERE o.c_mktsegment = c.c_mktsegment AND o.c_nationkey = c.c_nationkey AND o.c_custkey <> c.c_custkey) AS taken FROM customer c")
def set_exclude_self(spark, sf):
    """Whether another account has an account's address: counts by address, less its own."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return c.select("c_custkey", (F.count("*").over(Window.partitionBy("c_mktsegment", "c_nationkey")) > 1).alias("taken"))


@query("flt_label_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2) AND nullif(trim(l_linestatus), '') IS NOT NULL")
def flt_label_rows(spark, sf):
    """Rows of selected frames with a label, of variants that have a name."""
    named = F.nullif(F.trim("l_linestatus"), F.lit("")).isNotNull()
    return table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & F.col("l_linenumber").isin(1, 2) & named).select("l_orderkey", "l_linenumber")


@query("flt_delete_guard", "SELECT o_orderkey, o_orderstatus NOT IN ('P', 'O') AS may_delete, o_orderstatus = 'F' AS may_review FROM orders")
def flt_delete_guard(spark, sf):
    """Nothing is deleted while it is queued or processed, nothing reviewed before it is done."""
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", (~s.isin("P", "O")).alias("may_delete"), (s == "F").alias("may_review"))


@query(
    "flt_second_language",
    "SELECT source, lang FROM (SELECT *, lead(share) OVER (PARTITION BY source ORDER BY share DESC, lang) AS second, row_number() OVER (PARTITION BY source ORDER BY share DESC, lang) AS rn FROM (SELECT source, lang, n / (sum(n) OVER (PARTITION BY source))::DOUBLE AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL))) WHERE rn = 1 AND lang = 'en' AND coalesce(second, 0) <= 0.2",
)
def flt_second_language(spark, sf):
    """Sources of the wanted language without a second one above a fifth."""
    w = Window.partitionBy("source")
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    s = n.withColumn("share", F.col("n") / F.sum("n").over(w).cast("double"))
    o = w.orderBy(F.desc("share"), "lang")
    r = s.withColumn("second", F.lead("share").over(o)).withColumn("rn", F.row_number().over(o))
    return r.where("rn = 1 AND lang = 'en' AND coalesce(second, 0) <= 0.2").select("source", "lang")


@query("jn_frame_ocr", "SELECT l.l_orderkey, l.l_linenumber, coalesce(p.p_name, '') AS ocr FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON p.p_partkey = l.l_partkey")
def jn_frame_ocr(spark, sf):
    """The text read from each frame, empty where there is none."""
    p = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf, "lineitem").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("")).alias("ocr"))


@query("jn_keypoints", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0")
def jn_keypoints(spark, sf):
    """Frames with the points that were found for them; frames without are left out."""
    s = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, sf, "lineitem").join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@query("jn_positional", f"SELECT a.o_custkey, a.rn, {r6('a.o_totalprice - b.o_totalprice')} AS error FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F') a JOIN (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') b ON a.o_custkey = b.o_custkey AND a.rn = b.rn")
def jn_positional(spark, sf):
    """True values with predictions by their places."""
    from lectern.functions.maths import round6

    o = table(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    side = lambda s, name: o.where(F.col("o_orderstatus") == s).select("o_custkey", place.alias("rn"), F.col("o_totalprice").alias(name))
    return side("F", "a").join(side("O", "b"), ["o_custkey", "rn"]).select("o_custkey", "rn", round6(F.col("a") - F.col("b")).alias("error"))


_TAGS = "tags AS (SELECT DISTINCT l_orderkey AS note, l_suppkey AS tag, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"


def _tags(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_suppkey").alias("tag")).distinct().join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tag"), F.lower("s_name").alias("name")), "tag")


@query("jn_two_tags", f"WITH {_TAGS} SELECT DISTINCT o_orderkey FROM orders JOIN tags a ON a.note = o_orderkey LEFT JOIN tags b ON b.note = o_orderkey WHERE a.tag = 3 AND (contains(lower(o_orderpriority), 'urgent') OR contains(lower(b.name), '0007'))")
def jn_two_tags(spark, sf):
    """Notes with one tag by its id, and with a title or any tag, the same or another, by a part of its name."""
    tags = _tags(spark, sf)
    one = tags.where("tag = 3").select(F.col("note").alias("o_orderkey")).distinct()
    named = tags.where(F.col("name").contains("0007")).select(F.col("note").alias("o_orderkey"), F.lit(True).alias("hit")).distinct()
    o = table(spark, sf, "orders").join(one, "o_orderkey", "left_semi").join(named, "o_orderkey", "left")
    return o.where(F.lower("o_orderpriority").contains("urgent") | F.coalesce("hit", F.lit(False))).select("o_orderkey")


@query("jn_tags_of_notes", f"WITH {_TAGS} SELECT o_orderkey, coalesce(string_agg(lower(name), ',' ORDER BY lower(name)), '') AS tags FROM orders LEFT JOIN tags ON note = o_orderkey GROUP BY 1")
def jn_tags_of_notes(spark, sf):
    t = _tags(spark, sf).groupBy(F.col("note").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))
    return table(spark, sf, "orders").select("o_orderkey").join(t, "o_orderkey", "left").select("o_orderkey", F.coalesce("tags", F.lit("")).alias("tags"))


@query("srt_frames", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS place FROM lineitem")
def srt_frames(spark, sf):
    """Frames of each video by time and name."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("srt_candidates", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_tax DESC, l_quantity DESC, -abs(l_extendedprice - 40000) DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem")
def srt_candidates(spark, sf):
    """Candidates by score, likeness, information and nearness to the middle, then as they came."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_discount"), F.desc("l_tax"), F.desc("l_quantity"), F.abs(F.col("l_extendedprice") - 40000), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("top_seeded", "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn <= 8")
def top_seeded(spark, sf):
    """Eight random notes of each status, the same ones for the same seed: the order is that of a hash."""
    w = Window.partitionBy("o_orderstatus").orderBy(F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), "o_orderkey")
    return table(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("o_orderstatus", "o_orderkey")


@query("lim_first_region", "SELECT o_custkey, CASE WHEN x >= 0 THEN x END AS x, CASE WHEN x >= 0 THEN y END AS y FROM (SELECT o_custkey, min_by(o_orderkey % 5 - 1, {'d': o_orderdate, 'k': o_orderkey}) AS x, min_by(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) AS y FROM orders GROUP BY 1)")
def lim_first_region(spark, sf):
    """The region of each video's first row; null where it says there is none."""
    first = F.min_by(F.struct((F.col("o_orderkey") % 5 - 1).alias("x"), F.col("o_totalprice").alias("y")), F.struct("o_orderdate", "o_orderkey"))
    f = table(spark, sf, "orders").groupBy("o_custkey").agg(first.alias("f"))
    return f.select("o_custkey", F.when(F.col("f.x") >= 0, F.col("f.x")).alias("x"), F.when(F.col("f.x") >= 0, F.col("f.y")).alias("y"))


@query("set_row_concat", "SELECT c_name AS name, c_acctbal AS balance, NULL::INTEGER AS region FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT n_name, NULL, n_regionkey FROM nation")
def set_row_concat(spark, sf):
    """Rows of tables below each other, without some columns, and null where one lacks a column."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return c.unionByName(s).unionByName(n, allowMissingColumns=True)


@query("seq_label_template", "SELECT o_orderstatus AS variant, 'variant_summary' AS row_type, NULL::BIGINT AS frame, NULL::DOUBLE AS time FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT o_orderstatus, 'selected_frame', o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%'")
def seq_label_template(spark, sf):
    """The sheet for labelling by hand: a row for each variant, with or without frames, and one for each selected frame."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("variant"), F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("time"), "o_orderpriority")
    heads = o.select("variant").distinct().withColumn("row_type", F.lit("variant_summary"))
    rows = o.where(F.col("o_orderpriority").startswith("1")).select("variant", F.lit("selected_frame").alias("row_type"), "frame", "time")
    return heads.unionByName(rows, allowMissingColumns=True)


@query("orm_toggle_favourite", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NOT o_orderpriority LIKE '1%' ELSE o_orderpriority LIKE '1%' END AS favourite FROM orders")
def orm_toggle_favourite(spark, sf):
    """The notes with the mark of some of them turned: changes by key, the rest as it was."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").startswith("1").alias("favourite"))
    turned = o.where("o_orderkey % 10 = 0").select("o_orderkey", (~F.col("favourite")).alias("new"))
    return o.join(turned, "o_orderkey", "left").select("o_orderkey", F.coalesce("new", "favourite").alias("favourite"))


@query("orm_update_tags", "SELECT DISTINCT l_orderkey AS note, l_suppkey AS tag FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 10 = 0")
def orm_update_tags(spark, sf):
    """The tags of some notes replaced by new ones."""
    old = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_suppkey").alias("tag")).distinct()
    new = table(spark, sf, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("note"), F.lit(1).cast("long").alias("tag"))
    return old.join(new.select("note"), "note", "left_anti").unionByName(new)


@query("orm_notifications", "SELECT user_id, event_id, place, event_type NOT IN ('error', 'view') OR event_id % 3 = 0 AS is_read FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events)")
def orm_notifications(spark, sf):
    """Each user's notifications, newest first, after a bulk update that marks some as read."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", (~F.col("event_type").isin("error", "view")).alias("was"))
    marked = e.where("event_id % 3 = 0").select("event_id", F.lit(True).alias("now"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")).cast("long")
    return e.join(marked, "event_id", "left").select("user_id", "event_id", place.alias("place"), F.coalesce("now", "was").alias("is_read"))


@query("orm_enqueue", "SELECT o_orderkey, o_orderstatus AS status, 100 AS progress FROM orders UNION ALL SELECT c_custkey + 1000000000, 'Q', 0 FROM customer WHERE c_acctbal > 0")
def orm_enqueue(spark, sf):
    """The notes with newly queued ones."""
    old = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(100).alias("progress"))
    new = table(spark, sf, "customer").where("c_acctbal > 0").select((F.col("c_custkey") + 1000000000).alias("o_orderkey"), F.lit("Q").alias("status"), F.lit(0).alias("progress"))
    return old.unionByName(new)


@query("orm_owned_file", "SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pdf/' || o_orderkey || '.pdf' END AS file FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 50 = c_custkey % 50")
def orm_owned_file(spark, sf):
    """For each user the asked note if it is their own, and its file if there is one."""
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    j = c.withColumn("m", F.col("c_custkey") % 50).join(o.withColumn("m", F.col("o_orderkey") % 50), ["c_custkey", "m"], "left")
    return j.select("c_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("pdf/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))).alias("file"))


@query("orm_admin_list", "SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'P') AND (contains(lower(c_name), '7') OR contains(lower(o_orderpriority), 'high'))")
def orm_admin_list(spark, sf):
    """The staff's list: filtered by status, searched in the owner's name and the title."""
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("c_custkey"))
    j = o.join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    return j.where(F.lower("c_name").contains("7") | F.lower("o_orderpriority").contains("high")).select("o_orderkey", "c_name", "o_orderstatus")


@query("orm_layout", "SELECT c_custkey, c_mktsegment, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) JOIN customer ON c_custkey = o_custkey WHERE place <= 3")
def orm_layout(spark, sf):
    """Each owner's three newest notes beside the owner, from tables laid out by owner: the query itself moves no row."""
    return newest(*owner_tables(spark, sf), 3)


def owner_tables(spark, sf, buckets: int = 8):
    notes = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey", "o_orderdate")
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), "c_mktsegment")
    return laid_out(notes, ["owner"], ["o_orderdate"], buckets), laid_out(owners, ["owner"], [], buckets)


def newest(notes, owners, n: int):
    w = Window.partitionBy("owner").orderBy(F.desc("o_orderdate"), "o_orderkey")
    ranked = notes.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)
    return ranked.hint("merge").join(owners, "owner").select(F.col("owner").alias("c_custkey"), "c_mktsegment", "o_orderkey", "place")
