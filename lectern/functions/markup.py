"""JSON, Markdown, links and names: Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import clean_text, strip

# Openings that announce a new topic, in the wording of the second scoring; and what modes are called.
OPENINGS = (
    "итак", "теперь", "далее", "следующий", "следующая", "перейдем", "перейдём",
    "рассмотрим", "обсудим", "подведем", "подведём", "сначала", "во-первых", "во вторых",
    "во-вторых", "наконец", "important", "next", "now", "let us", "moving on",
)
MODES = {"text_only": "текстовый", "mixed": "смешанный", "rich": "насыщенный"}
VIDEO_SUFFIXES = (".mp4", ".mkv", ".avi", ".mov", ".webm", ".m4v")


def cue_score(c: Column, pattern: str) -> Column:
    """Half a point for each opening, 0.35 for a cue word anywhere, 0.15 for a colon at the end of the first fifty characters; one at most."""
    t = F.lower(clean_text(c))
    starts = sum((F.when(F.startswith(t, F.lit(w)), 0.5).otherwise(0.0) for w in OPENINGS), F.lit(0.0))
    rest = F.when(t.rlike(pattern), 0.35).otherwise(0.0) + F.when(F.left(t, F.lit(50)).rlike(r":\s*$"), 0.15).otherwise(0.0)
    return F.when(t == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), starts + rest))


def json_text(c: Column, opening: str = "{", closing: str = "}") -> Column:
    """The JSON object (or list) that a text is, or that its widest part between the brackets is; null without one."""
    t = clean_text(c)
    whole = F.when(F.startswith(t, F.lit(opening)), F.try_parse_json(t))
    widest = F.regexp_extract(t, rf"(?s)\{opening}.*\{closing}", 0)
    return F.coalesce(F.to_json(whole), F.to_json(F.try_parse_json(F.nullif(widest, F.lit("")))))


def variant_name(c: Column) -> Column:
    """Letters, digits, - and _ stay; runs of anything else become one _, none at the ends; empty names become `variant`."""
    t = F.regexp_replace(F.regexp_replace(strip(c), r"[^\p{L}\p{N}_\-]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^_+|_+$", ""), F.lit("")), F.lit("variant"))


def quad_json(q: Column) -> Column:
    """A quad as JSON, [[x, y], ...] to two places; null is empty."""
    two = lambda v: F.bround(v, 2)
    return F.coalesce(F.to_json(F.transform(q, lambda p: F.array(two(p.x), two(p.y)))), F.lit(""))


def source_text(title: Column, speech: Column, slides: Column) -> Column:
    """What is written up for a segment: its title, its speech, and the text of each slide that has any (array of structs (stamp, text))."""
    block = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    t, s = clean_text(title), clean_text(speech)
    shown = F.filter(F.transform(slides, lambda x, i: F.struct((i + 1).alias("n"), x["stamp"].alias("stamp"), clean_text(x["text"]).alias("text"))), lambda x: x["text"] != "")
    lines = F.transform(shown, lambda x: F.concat(F.lit("КАДР "), x["n"].cast("string"), F.lit(", время "), x["stamp"], F.lit(":\n"), x["text"]))
    return F.concat_ws("\n\n", block("НАЗВАНИЕ РАЗДЕЛА:\n", t), block("ТЕКСТ ЛЕКТОРА:\n", s), block("ТЕКСТ СО СЛАЙДОВ / ДОСКИ:\n", F.array_join(lines, "\n\n")))


def mode_name(c: Column) -> Column:
    out = c
    for key, name in MODES.items():
        out = F.when(c == key, name).otherwise(out)
    return out


def model_alias(c: Column, known: tuple[str, ...] = ("qwen", "mistral"), default: str = "qwen") -> Column:
    """A known name, else the first one that is part of the name, else the default."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.trim(low).isin(*known), F.trim(low))
    for k in known:
        out = out.when(low.contains(k), k)
    return out.otherwise(default)


def fallback_note(c: Column, most: int = 12) -> Column:
    """A note of a text's first lines, for when nothing better can be had."""
    lines = F.slice(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), 1, most)
    return F.concat(F.lit("## Черновик конспекта\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))


def plan_title(*names: Column) -> Column:
    """The first of several possible fields that isn't empty, stripped of numbering and marks, cut at ninety characters."""
    title = clean_text(F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit("")))
    return F.left(F.regexp_replace(title, r"^[ \-—:;.0-9]+|[ \-—:;.0-9]+$", ""), F.lit(90))


def plan_description(*names: Column) -> Column:
    return F.left(clean_text(F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(""))), F.lit(350))


def words(c: Column) -> Column:
    """Lower-case words of letters, digits and _, without punctuation."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def line_kind(line: Column) -> Column:
    """What a Markdown line outside a fence is."""
    return (
        F.when(F.trim(line) == "", "blank")
        .when(line.rlike(r"!\[[^\]]*\]\([^)]+\)"), "image")
        .when(line.rlike(r"^#{1,6}\s+\S"), "heading")
        .when(line.rlike(r"^\s*[-*+]\s+\S"), "ul")
        .when(line.rlike(r"^\s*\d+[.)]\s+\S"), "ol")
        .otherwise("paragraph")
    )


def image_source(c: Column) -> Column:
    """The path of an image link: brackets, quotes and a title stripped, percent codes and backslashes resolved; links with a scheme stay."""
    bare = F.regexp_replace(F.trim(c), "^<+|>+$", "")
    path = F.regexp_replace(F.trim(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))), "^[\"']+|[\"']+$", "")
    path = F.replace(F.regexp_replace(path, " [\"'].*$", ""), F.lit("\\"), F.lit("/"))
    return F.when(bare.rlike("^(https?|data|file):"), bare).otherwise(F.coalesce(path, bare))
