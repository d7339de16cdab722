"""Column expressions of the corpus jobs. All stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that carry no content.
STOPWORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers him "
    "his how if in into is it its just let me more most my no nor not now of off on once only or other our "
    "out over own really same she should so some such than that the their them then there these they think this those "
    "through to too under until up very was we were what when where which while who whom why will with would you your"
).split()
# The spoken fillers, and what tidies the marks and spaces they leave, in this order.
FILLERS = r"(?i)\b(u+h+m+|u+m+|u+h+|erm?|hmm+)\b[,]?"
TIDY = ((" {2,}", " "), (r"\s+([,.!?;:])", "$1"), (r"^[\s,]+", ""), (",{2,}", ","))
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
MAX_TERMS = 10


def clean_speech(text: Column) -> Column:
    """Drops fillers and tidies the marks and spaces they leave."""
    out = F.regexp_replace(text, FILLERS, "")
    for pattern, by in TIDY:
        out = F.regexp_replace(out, pattern, by)
    return trim_all(out)


def trim_all(text: Column) -> Column:
    """Without white space and line ends at both sides."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_controls(text: Column) -> Column:
    """Without C0 controls and DEL; tab and newline stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def stamp_ms(stamp: Column) -> Column:
    """``[1:23:45]`` to milliseconds: parts fold by 60, parts that are no numbers are left out; none: null."""
    parts = F.filter(F.split(F.regexp_replace(stamp, r"[\[\]]", ""), ":"), lambda x: x.rlike(r"^\d+$"))
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long")) * 1000)


def clock_text(ms: Column) -> Column:
    """Milliseconds to M:SS, or H:MM:SS from an hour on; rounded to the second, halves up."""
    total = F.floor((ms + 500) / 1000)
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))


def duration_minutes(text: Column) -> Column:
    """``M:SS`` or ``H:MM:SS`` to whole minutes; anything else is 15."""
    p = F.split(text, ":")
    ok = text.rlike(r"^\d+(:\d+){1,2}$")
    return F.when(ok & (F.size(p) == 2), F.get(p, F.lit(0)).cast("int")).when(ok, F.get(p, F.lit(0)).cast("int") * 60 + F.get(p, F.lit(1)).cast("int")).otherwise(15)


def start_minutes(text: Column) -> Column:
    """``HH:MM`` to minutes of the day; anything else is nine o'clock."""
    p = F.split(text, ":")
    return F.when(text.rlike(r"^\d+:\d+$"), F.get(p, F.lit(0)).cast("int") * 60 + F.get(p, F.lit(1)).cast("int")).otherwise(540)


def slug(text: Column, limit: int = 48) -> Column:
    """Runs of anything but ASCII letters and digits become one dash; cut at the limit without a dash at the end."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    size = F.when(F.substring(s, limit, 1) == "-", limit + 1).otherwise(limit)
    return F.when(F.length(s) <= limit, s).otherwise(F.regexp_replace(F.substring(s, F.lit(1), size), "-$", ""))


def norm(text: Column) -> Column:
    """Lower case without white space at the sides: how names are compared."""
    return F.lower(trim_all(text))


def sanitize_scalar(text: Column) -> Column:
    """One line: breaks and controls become spaces, double quotes single ones, trimmed."""
    flat = F.regexp_replace(text, r"\r\n|[\x00-\x1F\x7F-\x9F\x{2028}\x{2029}\x{FEFF}]", " ")
    return trim_all(F.translate(flat, '"', "'"))


def file_name(title: Column) -> Column:
    """A title as a file's name: illegal characters become spaces, collapsed, 50 characters at most."""
    flat = F.regexp_replace(F.regexp_replace(title, r'[/\\:*?"<>|\n]', " "), " {2,}", " ")
    return F.trim(F.substring(trim_all(flat), 1, 50))


def video_service(*texts: Column) -> Column:
    """The video service that an address, place or note names."""
    hay = F.lower(F.concat_ws(" ", *texts))
    return F.when(hay.contains("zoom.us"), "Zoom").when(hay.contains("teams.microsoft.com") | hay.contains("teams.live.com"), "Teams").when(hay.contains("meet.google.com"), "Meet")


def tier(path: Column) -> Column:
    """1 for the operator's folder, 2 for references, else 3."""
    return F.when(path.contains("/00-operator/"), 1).when(path.contains("/10-reference/"), 2).otherwise(3)


def tail(text: Column, size: int = 600) -> Column:
    """The last characters of a running text, from the first word that is whole."""
    return F.when(F.length(text) <= size, text).otherwise(F.regexp_replace(F.substring(text, -size, size), r"^\S*\s", ""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits, in order. No folding of accents."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda x: x != "")


def query_terms(text: Column, legacy: bool = False) -> Column:
    """Terms of a query: at least two characters, without stop words (unless nothing is left), the ten longest of many.

    ``legacy``: every term of two characters or more, stop words too.
    """
    every = F.array_distinct(F.filter(tokens(text), lambda x: F.length(x) >= 2))
    if legacy:
        return every
    content = F.array_except(every, F.array(*[F.lit(w) for w in STOPWORDS]))
    some = F.when(F.size(content) > 0, content).otherwise(every)
    ranked = F.array_sort(F.transform(some, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("term"))))
    return F.when(F.size(some) > MAX_TERMS, F.transform(F.slice(ranked, 1, MAX_TERMS), lambda r: r["term"])).otherwise(some)


def first_name(text: Column) -> Column:
    """What stands before `` @ ``."""
    return F.substring_index(text, " @ ", 1)
