"""Extractive summaries of documents, how far they agree, and paragraphs by valleys of similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import maths as M
from lectern.functions import text as T
from lectern.operators import summaries as S
from lectern.operators import whole as W
from lectern.operators.cut import cut
from lectern.plans.catalog import query, spread, table
from lectern.plans.geometry_queries import r6, steady, steady_sql
from lectern.plans.text_queries import _sentences, _tokens

_SENTS = f"sents AS (SELECT doc_id, u.x AS text, u.i - 1 AS i FROM (SELECT doc_id, {_sentences('text')} AS ss FROM documents), LATERAL (SELECT unnest(ss) AS x, generate_subscripts(ss, 1) AS i) u)"
_LUHN = f"""toks AS (SELECT doc_id, i, u.t AS token, u.p FROM (SELECT doc_id, i, {_tokens('text')} AS ts FROM sents), LATERAL (SELECT unnest(ts) AS t, generate_subscripts(ts, 1) AS p) u),
    hits AS (SELECT * FROM toks JOIN (SELECT doc_id, token FROM toks GROUP BY ALL HAVING count(*) >= 2) USING (doc_id, token)),
    clus AS (SELECT doc_id, i, k, count(*) AS m, max(p) - min(p) + 1 AS len FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, i ORDER BY p) AS k FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, i ORDER BY p) > 5 THEN 1 ELSE 0 END AS fresh FROM hits)) GROUP BY ALL),
    luhn AS (SELECT s.doc_id, s.i, {r6('coalesce(max(m * m / len::DOUBLE), 0)')} AS score FROM sents s LEFT JOIN clus c ON c.doc_id = s.doc_id AND c.i = s.i GROUP BY ALL)"""
_HALF = "SELECT doc_id, i, score, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM {0}) WHERE place <= ceil(n / 2.0)"


def sentences(spark, sf) -> DataFrame:
    return S.sentence_rows(spread(table(spark, sf, "documents").select("doc_id", "text")))


def whole(spark, sf) -> DataFrame:
    """The documents with their sentences and tokens, each on its own row."""
    return W.texts(spread(table(spark, sf, "documents").select("doc_id", "text")))


def _half_by(spark, sf, scores) -> DataFrame:
    return W.by_document(whole(spark, sf), lambda doc: [(doc.doc_id, *r) for r in W.better_half(scores(doc))], "doc_id long, i long, score double, place long")


@query("txt_luhn", f"WITH {_SENTS}, {_LUHN} {_HALF.format('luhn')}")
def txt_luhn(spark, sf):
    """The better half of each document's sentences by clusters of significant words."""
    return S.better_half(S.luhn(sentences(spark, sf)))


#: Ranks of edges e(g, src, dst, weight), both ways, in twelve rounds: every node gets something in each.
_RANK = """outs AS (SELECT g, src, sum(weight) AS total FROM e GROUP BY ALL), step AS MATERIALIZED (SELECT e.g, e.src, e.dst, weight / total AS share FROM e JOIN outs USING (g, src)),
    nodes AS (SELECT g, src AS node, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT g, src FROM step)),
    ranks AS (SELECT g, node, n, 1.0::DOUBLE / n AS rank, 0 AS k FROM nodes UNION ALL SELECT s.g, s.dst, any_value(r.n), (1 - 0.85::DOUBLE) / any_value(r.n) + 0.85::DOUBLE * sum(r.rank * s.share), r.k + 1 FROM ranks r JOIN step s ON s.g = r.g AND s.src = r.node WHERE r.k < 12 GROUP BY s.g, s.dst, r.k)"""
_PAIRS = "both_ AS (SELECT a.doc_id AS g, a.i AS src, b.i AS dst, sum(a.x * b.x) AS both_ FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.token = b.token AND a.i <> b.i GROUP BY ALL), sizes AS (SELECT doc_id AS g, i, sum(x * x) AS n FROM words GROUP BY ALL), e AS MATERIALIZED (SELECT * FROM (SELECT p.g, src, dst, {0} AS weight FROM both_ p JOIN sizes s ON s.g = p.g AND s.i = src JOIN sizes d ON d.g = p.g AND d.i = dst) WHERE weight > 0)"
_TOKENS = f"tk AS (SELECT doc_id, i, unnest({_tokens('text')}) AS token FROM sents)"
_TEXT_WORDS = "words AS (SELECT DISTINCT doc_id, i, token, 1.0::DOUBLE AS x FROM tk)"
_LEX_WORDS = """tfs AS (SELECT doc_id, i, token, count(*) AS tf FROM tk GROUP BY ALL), words AS (SELECT doc_id, i, token, tf * (ln(total / df::DOUBLE) + 1) AS x FROM tfs JOIN (SELECT doc_id, token, count(*) AS df FROM tfs GROUP BY ALL) USING (doc_id, token) JOIN (SELECT doc_id, count(*) AS total FROM sents GROUP BY 1) USING (doc_id))"""
_BY_RANK = f"scored_ AS (SELECT s.doc_id, s.i, {r6('coalesce(rank, 0)')} AS score FROM sents s LEFT JOIN (SELECT * FROM ranks WHERE k = 12) r ON r.g = s.doc_id AND r.node = s.i)"


def _rank_sql(words: str, weight: str) -> str:
    return f"WITH RECURSIVE {_SENTS}, {_TOKENS}, {words}, {_PAIRS.replace('{0}', weight)}, {_RANK}, {_BY_RANK} {_HALF.format('scored_')}"


@query("txt_text_rank", _rank_sql(_TEXT_WORDS, "both_ / (s.n + d.n)"))
def txt_text_rank(spark, sf):
    """The better half of the sentences by their rank among those that share words."""
    return _half_by(spark, sf, W.text_ranks)


@query("txt_lex_rank", _rank_sql(_LEX_WORDS, "CASE WHEN both_ / sqrt(s.n * d.n) > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END"))
def txt_lex_rank(spark, sf):
    """The same over sentences alike by weighted cosine."""
    return _half_by(spark, sf, W.lex_ranks)


@query("txt_latent")
def txt_latent(spark, sf):
    """The better half of the sentences by their strength in the main topics: no SQL for singular values, tested against a plain version."""
    return S.better_half(S.latent(sentences(spark, sf)))


_WORDS = "regexp_extract_all(lower(text), '([a-z]+)')"
_FREQ = f"""fw AS (SELECT doc_id, i, unnest({_WORDS}) AS word FROM sents), ff AS (SELECT doc_id, word, count(*) AS n FROM fw GROUP BY ALL), fv AS (SELECT doc_id, i, sum(n)::BIGINT AS score FROM fw JOIN ff USING (doc_id, word) GROUP BY ALL),
    freq AS (SELECT s.doc_id, s.i, s.text, v.score FROM sents s JOIN (SELECT *, sum(score) OVER (PARTITION BY doc_id)::BIGINT // count(*) OVER (PARTITION BY doc_id) AS average FROM fv) v ON v.doc_id = s.doc_id AND v.i = s.i WHERE v.score > 1.5 * average OR len(list_filter({_WORDS.replace('text', 's.text')}, lambda w: length(w) >= 12)) > 0)"""


def _named(word: str) -> bool:
    """The entities here: words of twelve letters or more."""
    return len(word) >= 12


@query("txt_frequency_summary", f"WITH {_SENTS}, {_FREQ} SELECT doc_id, i, score FROM freq")
def txt_frequency_summary(spark, sf):
    """A summary by word frequency that keeps every sentence with an entity (here: a word of twelve letters or more)."""
    return W.by_document(whole(spark, sf), lambda doc: [(doc.doc_id, *r) for r in W.by_frequency(doc, _named)], "doc_id long, i long, score long")


_METHODS = f"""half AS ({_HALF.format('luhn')}), ms AS (SELECT h.doc_id, 'luhn' AS method, string_agg(text, ' ' ORDER BY h.i) AS text FROM half h JOIN sents s ON s.doc_id = h.doc_id AND s.i = h.i GROUP BY h.doc_id UNION ALL SELECT doc_id, 'lead', string_agg(text, ' ' ORDER BY i) FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sents) WHERE i < ceil(n / 2.0) GROUP BY doc_id UNION ALL SELECT doc_id, 'frequency', string_agg(text, ' ' ORDER BY i) FROM freq GROUP BY doc_id),
    grams AS (SELECT doc_id, method, array_to_string(t[i:i + 1], ' ') AS g, count(*) AS c FROM (SELECT doc_id, method, t, unnest(range(1, len(t))) AS i FROM (SELECT doc_id, method, {_tokens('text')} AS t FROM ms)) GROUP BY ALL),
    sizes AS (SELECT m.doc_id, m.method, coalesce(sum(c), 0)::BIGINT AS n FROM ms m LEFT JOIN grams g ON g.doc_id = m.doc_id AND g.method = m.method GROUP BY ALL),
    shared AS (SELECT a.doc_id, a.method AS t, b.method AS p, sum(least(a.c, b.c))::BIGINT AS k FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g GROUP BY ALL)"""


@query(
    "txt_rouge_matrix",
    f"WITH {_SENTS}, {_LUHN}, {_FREQ}, {_METHODS} SELECT doc_id, target, prediction, {r6('p')} AS precision, {r6('r')} AS recall, {r6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f FROM (SELECT x.doc_id, x.method AS target, y.method AS prediction, CASE WHEN y.n > 0 THEN coalesce(k, 0) / y.n::DOUBLE ELSE 0 END AS p, CASE WHEN x.n > 0 THEN coalesce(k, 0) / x.n::DOUBLE ELSE 0 END AS r FROM sizes x JOIN sizes y ON x.doc_id = y.doc_id LEFT JOIN shared s ON s.doc_id = x.doc_id AND s.t = x.method AND s.p = y.method)",
)
def txt_rouge_matrix(spark, sf):
    """Shared bigrams of three summaries of each document, all against all."""
    run = lambda doc: [(doc.doc_id, *r) for r in W.rouge_2(W.summary_tokens(doc, _named))]
    return W.by_document(whole(spark, sf), run, "doc_id long, target string, prediction string, precision double, recall double, f double")


@query("txt_rouge_l")
def txt_rouge_l(spark, sf):
    """Longest common subsequences of two summaries of each document: no SQL, tested against a plain version."""

    def run(doc):
        t = W.summary_tokens(doc, _named)
        return [(doc.doc_id, "luhn", "frequency", *S.scores_l(t["luhn"], t["frequency"]))] if "frequency" in t else []

    return W.by_document(whole(spark, sf), run, "doc_id long, target string, prediction string, precision double, recall double, f double")


@query(
    "txt_summary_paragraphs",
    f"WITH {_SENTS}, {_LUHN}, half AS ({_HALF.format('luhn')}), para AS (SELECT doc_id, p, {_sentences('line')} AS ss FROM (SELECT doc_id, u.line, u.p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS p) u)), ps AS (SELECT doc_id, p, u.x AS text, u.i FROM para, LATERAL (SELECT unnest(ss) AS x, generate_subscripts(ss, 1) - 1 AS i) u), chosen AS (SELECT DISTINCT h.doc_id, s.text FROM half h JOIN sents s ON s.doc_id = h.doc_id AND s.i = h.i) SELECT doc_id, p AS paragraph, md5(string_agg(text, ' ' ORDER BY i)) AS h, count(*) AS n FROM ps JOIN chosen USING (doc_id, text) GROUP BY ALL",
)
def txt_summary_paragraphs(spark, sf):
    """The sentences of a summary laid back onto the paragraphs that hold them."""
    s = cut(sentences(spark, sf))
    chosen = S.better_half(S.luhn(s)).select("doc_id", "i").join(s, ["doc_id", "i"]).select("doc_id", "text").distinct()
    para = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    ps = para.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.posexplode(T.sentences(F.col("line"))).alias("i", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda r: r.text), " ")
    return ps.join(chosen, ["doc_id", "text"], "left_semi").groupBy("doc_id", "paragraph").agg(F.md5(text).alias("h"), F.count("*").alias("n"))


_E = "e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, embedding::DOUBLE[] AS v FROM embeddings)"
_ACT = "act AS (SELECT x.label, x.rn, any_value(x.vec_id) AS vec_id, " + steady_sql("sum(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) / (1 + exp(0.5::DOUBLE * (-10 + 20 * (y.rn - x.rn) / 9.0::DOUBLE))))") + " AS s FROM e x JOIN e y ON x.label = y.label AND y.rn BETWEEN x.rn AND x.rn + 9 GROUP BY x.label, x.rn)"


def activated(embeddings: DataFrame, ahead: int = 10) -> DataFrame:
    """(label, rn, vec_id, s): each sentence's similarity to the next ones (itself first), weighted by a falling sigmoid."""
    e = embeddings.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    x = e.select("label", "vec_id", F.col("embedding").alias("u"), "rn", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1))).alias("k")).withColumn("at", F.col("rn") + F.col("k"))
    y = e.select("label", F.col("rn").alias("at"), F.col("embedding").alias("v"))
    weight = M.reversed_sigmoid(-10 + 20 * F.col("k") / (ahead - 1.0))
    j = x.join(y, ["label", "at"]).select("label", "rn", "vec_id", (M.cosine(F.col("u"), F.col("v")) * weight).alias("s"))
    return j.groupBy("label", "rn").agg(F.first("vec_id").alias("vec_id"), steady(F.sum("s")).alias("s"))


@query("win_activated", f"WITH {_E}, {_ACT} SELECT vec_id, s FROM act")
def win_activated(spark, sf):
    return activated(table(spark, sf, "embeddings")).select("vec_id", "s")


@query("txt_valley_paragraphs", f"WITH {_E}, {_ACT}, m AS (SELECT *, coalesce(s < lag(s, 1) OVER w AND s < lag(s, 2) OVER w AND s < lead(s, 1) OVER w AND s < lead(s, 2) OVER w, FALSE) AS valley FROM act WINDOW w AS (PARTITION BY label ORDER BY rn)) SELECT vec_id, sum(valley::INT) OVER (PARTITION BY label ORDER BY rn)::BIGINT AS paragraph FROM m")
def txt_valley_paragraphs(spark, sf):
    """Paragraphs that begin at the valleys of similarity to what follows, two sentences to each side."""
    w = Window.partitionBy("label").orderBy("rn")
    s = F.col("s")
    valley = (s < F.lag("s", 1).over(w)) & (s < F.lag("s", 2).over(w)) & (s < F.lead("s", 1).over(w)) & (s < F.lead("s", 2).over(w))
    m = activated(table(spark, sf, "embeddings")).withColumn("valley", F.coalesce(valley, F.lit(False)).cast("int"))
    return m.select("vec_id", F.sum("valley").over(w).alias("paragraph"))
