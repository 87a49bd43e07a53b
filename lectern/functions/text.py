"""Text functions: Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop-words, token class and transition cues that results depend on.
STOP_WORDS = (
    "это", "как", "что", "для", "или", "при", "если", "есть", "так", "его", "ее", "её",
    "их", "она", "они", "мы", "вы", "ты", "я", "но", "а", "и", "в", "во", "на", "по",
    "из", "к", "ко", "у", "о", "об", "от", "до", "же", "ли", "не", "да", "ну", "то",
    "бы", "быть", "вот", "тут", "там", "уже", "еще", "ещё", "только", "когда", "где",
    "который", "которая", "которые", "такой", "такая", "такие", "этот", "эта", "эти",
    "the", "and", "for", "with", "this", "that", "from", "into", "then", "than", "are",
    "was", "were", "have", "has", "had", "not", "you", "your", "our", "but", "can",
)
TOKEN = "[A-Za-zА-Яа-яЁё0-9_+#-]{2,}"
CUES = (
    "итак", "теперь", "далее", "следующий", "следующая", "перейдем", "перейдём",
    "рассмотрим", "обсудим", "подведем", "подведём", "сначала", "во-первых",
    "во-вторых", "наконец", "важно", "следовательно",
    "important", "next", "now", "let us", "moving on",
)
CUE_PATTERN = "(^|[^\\p{L}\\p{N}_])(итак|теперь|далее|перейд[её]м|следующ|рассмотрим|обсудим)($|[^\\p{L}\\p{N}_])"
POSITIVE = ("1", "1.0", "true", "yes", "y", "да", "истина", "tp", "тп")
NEGATIVE = ("0", "0.0", "false", "no", "n", "нет", "ложь", "fp", "фп")
_EDGE = r"^[\s\x{A0}]+|[\s\x{A0}]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def clean_text(c: Column) -> Column:
    """Null to empty; no-break and repeated spaces to one; carriage returns to newlines, at most two in a row; stripped."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\u00a0", " "), "\r", "\n")
    return strip(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n"))


def preprocess_text(c: Column) -> Column:
    """Every line stripped, at most one blank line between."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "\u00a0", " "), "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\*_])", r"\\$1")


def format_ts(seconds: Column) -> Column:
    """MM:SS, with hours in front where there are any; seconds round half to even."""
    s = F.greatest(F.lit(0), F.bround(seconds, 0).cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def truncate(c: Column, n: int = 700) -> Column:
    """Cleaned; where longer, the first n characters without the last, partial word."""
    t = clean_text(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(strip(F.regexp_replace(F.left(t, F.lit(n)), " [^ ]*$", "")), F.lit(" …")))


def sentences(c: Column) -> Column:
    """Cut at white space behind . ! ? …; dashes and bullets stripped; blanks dropped."""
    parts = F.split(F.regexp_replace(clean_text(c), r"([.!?…])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, "^[ \\-•\n\t]+|[ \\-•\n\t]+$", "")), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Lower-case tokens in order, ё as е, without stop-words; repeated ones stay."""
    low = F.replace(F.lower(clean_text(c)), F.lit("ё"), F.lit("е"))
    return F.filter(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))  # a look-up in a set


def bound(c: Column, f) -> Column:
    """f of c, with c computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def transition_score(c: Column) -> Column:
    def score(t: Column) -> Column:
        starts = sum((F.when(F.startswith(t, F.lit(w)), 0.55).otherwise(0.0) for w in CUES), F.lit(0.0))
        return F.when(t == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), starts + F.when(F.rlike(t, F.lit(CUE_PATTERN)), 0.35).otherwise(0.0)))

    return bound(F.lower(clean_text(c)), score)


def time_from_name(c: Column) -> Column:
    """Seconds that a file name ends with, as in frame_12.50s.jpg; null without."""
    return F.regexp_extract(c, r"_([0-9]+([.][0-9]+)?)s([.][^.]+)?$", 1).try_cast("double")


def safe_stem(c: Column, longest: int = 120) -> Column:
    """A file name stem for any system; empty names become `file`, reserved ones get a suffix."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', "_"), r"\s+", " ")
    t = F.regexp_replace(t, "^[ .]+|[ .]+$", "")
    t = F.when(t == "", F.lit("file")).otherwise(t)
    reserved = ["CON", "PRN", "AUX", "NUL", *[f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10)]]
    t = F.when(F.upper(t).isin(reserved), F.concat(t, F.lit("_file"))).otherwise(t)
    return F.regexp_replace(F.left(t, F.lit(longest)), "[ ._]+$", "")


def safe_name(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, r"\s+", "_"), r"[^A-Za-z0-9_.\-]", "_")
    return F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_+|_+$", "")


def inline_html(c: Column) -> Column:
    """Escaped text with bold, italics, code and link labels as HTML."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\*\*([^*]+)\*\*", "<b>$1</b>"), "__([^_]+)__", "<b>$1</b>")
    return F.regexp_replace(F.regexp_replace(t, r"\*([^*]+)\*", "<i>$1</i>"), "`([^`]+)`", "<font>$1</font>")


def binary_label(c: Column) -> Column:
    """1, 0 or null from what people write in a label cell; a decimal comma is fine."""
    t = F.lower(strip(c))
    x = F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(t.isin(*POSITIVE), 1).when(t.isin(*NEGATIVE), 0).when(x == 1.0, 1).when(x == 0.0, 0)


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))
