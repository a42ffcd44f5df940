"""Scalar functions on text as Column -> Column. Nulls give nulls unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the text of an empty page, the marker that starts a section, and the thresholds of long turns
EMPTY_PAGE = "[no text on this page]"
LONG_TURN_WORDS, LONG_TURN_SENTENCES = 60, 3
#: what the word gate sets aside at the start of a line, and in inline mode anywhere
SYNTAX = r"(?m)^(?:#{1,6} |- |> )"
LINK_TARGET, INLINE, RULE = r"\]\([^)]*\)", r"[*`|\\\[\]•▪◦‣]", r"^[-:]+$"
#: fixed values: Unicode white space and the separators that count as such, as a class of a regular expression
SPACE = r"\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: a token of a turn: a bracketed disagreement or a run without white space; and how a sentence ends
TOKEN, SENTENCE_END = r"\{(?:\\.|[^{}\\])*\}|\S+", r"[.?!][\"'”’)\]]*$"
#: punctuation that doesn't count when two words are compared
BARE = ".,;:?!\"'“”‘’()[]"


def newlines(text: Column) -> Column:
    """CRLF and CR to LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def body_text(text: Column) -> Column:
    """The text that offsets count in: without NUL, with LF only."""
    return F.replace(newlines(text), F.lit("\x00"), F.lit(""))


def slugify(name: Column) -> Column:
    """Lower-case ASCII letters and digits with single dashes between; ``document`` if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("document")).otherwise(slug)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def title_from_name(name: Column) -> Column:
    """The slug of the stem with spaces, each letter after a non-letter in upper case (also after a digit)."""
    chars = F.split(F.replace(slugify(stem(name)), F.lit("-"), F.lit(" ")), "")
    pairs = F.zip_with(chars, F.concat(F.array(F.lit(" ")), chars), lambda c, before: F.when(before.rlike("[a-z]"), c).otherwise(F.upper(c)))
    return F.array_join(F.filter(pairs, lambda c: c.isNotNull()), "")


def _holds(text: Column, *marks: str) -> Column:
    out = text.contains(marks[0])
    for m in marks[1:]:
        out |= text.contains(m)
    return out


def _plain(text: Column, inline: bool) -> Column:
    """Most texts hold none of the marks, which plain searches tell sooner than the expressions."""
    plain = F.when(_holds(text, "# ", "- ", "> "), F.regexp_replace(text, SYNTAX, "")).otherwise(text)
    if not inline:
        return plain
    bare = F.when(plain.contains("]("), F.regexp_replace(plain, LINK_TARGET, "]")).otherwise(plain)
    return F.when(_holds(bare, *"*`|\\[]•▪◦‣"), F.regexp_replace(bare, INLINE, "")).otherwise(bare)


def words(text: Column, inline: bool = False) -> Column:
    """The words that the gate compares: without one leading marker a line and, inline, without inline marks."""
    found = split_words(_plain(text, inline))
    return F.filter(found, lambda w: ~w.rlike(RULE)) if inline else found


def count_words(text: Column, inline: bool = False) -> Column:
    """How many ``words`` a text has, without making them: each is put as one letter between what separates them."""
    plain = _plain(text, inline)
    if inline:  # words of dashes and colons alone don't count
        plain = F.when(_holds(plain, "-", ":"), F.regexp_replace(plain, f"(?<![^{SPACE}])[-:]++(?![^{SPACE}])", "")).otherwise(plain)
    letters = F.regexp_replace(plain, f"[^{SPACE}]++", "w")
    return F.length(letters) - F.length(F.replace(letters, F.lit("w"), F.lit("")))


def split_words(text: Column) -> Column:
    """Runs without Unicode white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def single_spaced(text: Column) -> Column:
    """The words with one space between, as one string."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def sentences(text: Column) -> Column:
    """Array of sentences: tokens joined by a space up to one that ends a sentence."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    ends = lambda t: ~t.startswith("{") & t.rlike(SENTENCE_END)
    stops = F.filter(F.transform(tokens, lambda t, i: F.when(ends(t) | (i == F.size(tokens) - 1), i + 1)), lambda i: i.isNotNull())
    spans = F.arrays_zip(F.concat(F.array(F.lit(0)), stops).alias("a"), stops.alias("b"))
    return F.transform(F.filter(spans, lambda s: s["b"].isNotNull()), lambda s: F.array_join(F.slice(tokens, s["a"] + 1, s["b"] - s["a"]), " "))


def is_long(text: Column) -> Column:
    return (F.size(split_words(text)) >= LONG_TURN_WORDS) & (F.size(sentences(text)) >= LONG_TURN_SENTENCES)


def bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, "^[" + r".,;:?!\"'“”‘’()\[\]" + "]+|[" + r".,;:?!\"'“”‘’()\[\]" + "]+$", ""))


def cell(value: Column) -> Column:
    """A table cell: pipes escaped, line ends to spaces, trimmed; empty for null."""
    return F.trim(F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def fence(text: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def anchor(content_hash: Column, number: Column) -> Column:
    return F.format_string("pdf-%s-page-%06d", F.regexp_replace(content_hash, "^sha256:", ""), number)


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def column_letter(number: Column) -> Column:
    """1 to A, 27 to AA; up to six letters. Empty below 1."""
    def step(acc: Column, _: Column) -> Column:
        n = acc["n"]
        return F.when(n > 0, F.struct(F.floor((n - 1) / 26).cast("long").alias("n"), F.concat(F.char(F.lit(65) + (n - 1) % 26), acc["s"]).alias("s"))).otherwise(acc)

    start = F.struct(number.cast("long").alias("n"), F.lit("").alias("s"))
    return F.aggregate(F.array(*[F.lit(0)] * 6), start, step, lambda acc: acc["s"])


def column_index(letters: Column) -> Column:
    """A to 1, AA to 27; null for anything else than letters."""
    value = F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.when(c == "", F.lit(0)).otherwise(F.ascii(c) - 64))
    return F.when(letters.rlike("^[A-Za-z]{1,6}$"), value)


def clock(milliseconds: Column) -> Column:
    """HH:MM:SS.mmm of whole milliseconds."""
    ms = milliseconds.cast("long")
    part = lambda unit, mod: F.lpad(F.pmod(F.floor(ms / unit), F.lit(mod)).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def elapsed(nanoseconds: Column) -> Column:
    """1.234s below a minute, then 3m 5s, then 2h 3m 5s."""
    ms = F.floor(nanoseconds / 1_000_000).cast("long")
    s = F.floor(ms / 1000).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(ms < 60_000, F.format_string("%d.%03ds", s, ms % 1000)).when(h > 0, F.format_string("%dh %dm %ds", h, m, s % 60)).otherwise(F.format_string("%dm %ds", m, s % 60))


def csv_field(value: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end; quotes doubled; empty for null."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def tidy(text: Column, max_words: int) -> Column:
    """Markers off, paragraphs joined, at most so many words and then a mark that more follows."""
    found = split_words(F.regexp_replace(text, SYNTAX, ""))
    return F.when(F.size(found) > max_words, F.concat(F.array_join(F.slice(found, 1, max_words), " "), F.lit(" […]"))).otherwise(F.array_join(found, " "))
