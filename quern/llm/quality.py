"""Quality rules, lines first.

Every line with a word is judged by punctuation, navigation and boilerplate
rules; failing lines go, and a document that loses too much of its text goes.
All of it is one narrow pass of built-in expressions over each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed, unfold, with_row

#: Marks that a line may not be full of, by rule.
MARKS = {"symbols": "#*$%&<>=~^_\\", "shouting": "!?", "navigation": "|·•›»"}
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "cookie policy", "cookie settings", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript",
    "subscribe to our", "click here", "read more", "sign in", "sign up", "log in", "lorem ipsum", "skip to content",
)
#: Marks that are counted; all of them are marks of a kind above.
SYMBOLS = "#*$%&|<>"


def windows(found: Column) -> Column:
    """Hashes of a list of words' 3-word windows, in order."""
    places = F.when(F.size(found) > 3, F.sequence(F.lit(0), F.size(found) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))


def covered(hashed: Column) -> Column:
    """Number of words in the windows that are there twice or more, from their hashes in order."""
    def places(ordered: Column) -> Column:
        """Of (hash, place) structs in order, the places of those that equal a neighbour."""
        def again(x: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1)["h"], F.get(ordered, i + 1)["h"]
            return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

        return F.transform(F.filter(ordered, again), lambda x: x["i"])

    ordered = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = F.get(F.transform(F.array(ordered), places), 0)  # sorted once, not for each window
    words_in = F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), 0).otherwise(words_in)


def count_of(text: Column, marks: str) -> Column:
    """How many of the marks a text holds."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{_set(marks)}+", ""))


def _set(marks: str, other: bool = False) -> str:
    return f"[{'^' * other}{''.join(f'{chr(92)}{m}' if m.isascii() else m for m in marks)}]"


def repetitive(found: Column, window: int = 64) -> Column:
    """Whether a line's words are the same few over and over.

    A line of up to `window` words is so if at most a third of them are distinct.
    Text holds ever fewer new words as it goes on, so a longer line is judged by
    windows of that length (the same bound on the sum of their distinct words),
    or by whether repeated 3-word windows cover two thirds of it.
    """
    n = F.size(found)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / window).cast("int"))
    parts = F.transform(starts, lambda k: F.size(F.array_distinct(F.slice(found, k * window + 1, window))))
    held = F.aggregate(parts, F.lit(0), lambda s, x: s + x)
    again = F.get(F.transform(F.array(windows(found)), covered), 0)
    long = (held * 3 <= n) | (3 * again >= 2 * n)
    return F.when(n <= window, F.size(F.array_distinct(found)) * 3 <= n).otherwise(long)


def line_words(text: Column) -> Column:
    """The words of each line of a text.

    Where other white space than single spaces between words stands, it is put
    right first, so that lines are split at one character.
    """
    plain = F.regexp_replace(F.regexp_replace(text, "[ \t\x0b\f\r]+", " "), " ?\n ?", "\n")
    odd = text.rlike("[\t\x0b\f\r]|  | \n|\n |^ | $")
    lines = F.split(F.when(odd, F.btrim(plain, F.lit(" "))).otherwise(text), "\n", -1)
    return F.transform(lines, lambda x: F.when(x != "", F.split(x, " ")).otherwise(F.array().cast("array<string>")))


def marks_of(text: Column) -> Column:
    """The characters of a text that are marks of any kind, in order."""
    return F.regexp_replace(text, f"{_set(''.join(MARKS.values()), True)}+", "")


def suspicions(marks: Column, low: Column, least_marks: int = 4) -> dict[str, Column]:
    """What a text (its marks, its lower case) has to hold for any line of it to fail by marks of a kind or by a phrase: most texts are done with these."""
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | low.contains(p)
    return {**{k: count_of(marks, m) >= least_marks for k, m in MARKS.items()}, "boilerplate": phrase}


def line_failed(line: Column, w: Column, may: dict[str, Column], least_marks: int = 4, chars_a_mark: int = 16, least_unpunctuated: int = 12) -> Column:
    """Whether a line (and its words) fails: many marks of one kind, page furniture, the same few words over and over, or many words without any sentence mark."""
    n = F.size(w)
    out = (n >= least_unpunctuated) & ~line.rlike("[.!?:;,…。]")
    for kind, marks in MARKS.items():
        count = count_of(line, marks)
        out = out | (may[kind] & (count >= least_marks) & (chars_a_mark * count >= F.length(line)))
    phrase, low = F.lit(False), F.lower(line)
    for p in BOILERPLATE:
        phrase = phrase | low.contains(p)
    return (n > 0) & (out | (may["boilerplate"] & phrase) | ((n >= 8) & (F.size(F.array_distinct(w)) * 3 <= n) & repetitive(w)))


def clean_lines(docs: DataFrame, text_col: str = "text", least_words: int = 50, most_repeats: int = 50, most_lost: int = 50) -> DataFrame:
    """The input's columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed_lines, n_lost_words, cleaned and kept.

    base_failed: fewer than `least_words` words, or more than `most_repeats` per
    cent of them in repeated 3-word windows.  kept: base passed, and failing
    lines hold at most `most_lost` per cent of the words.  cleaned: the text
    without failing lines.  A null text counts as empty (cleaned is then empty),
    so it fails; repeated rows are judged alike; an empty table gives an empty
    table; columns of the new names are replaced.
    """
    rows = with_row(docs, __text=text_col).withColumn("__text", F.coalesce("__text", F.lit("")))
    text = F.col("__text")
    rows = fixed(rows, ls=F.split(text, "\n", -1), lw=line_words(text), low=F.lower(text), marks=marks_of(text))
    rows = fixed(rows, **{f"may_{k}": v for k, v in suspicions(F.col("marks"), F.col("low")).items()})
    may = {k: F.col(f"may_{k}") for k in (*MARKS, "boilerplate")}
    rows = fixed(rows, w=F.flatten("lw"), full=F.filter("ls", lambda x, i: F.size(F.get("lw", i)) > 0), bad=F.transform("ls", lambda x, i: line_failed(x, F.get("lw", i), may)))
    rows = fixed(rows, n=F.size("w").cast("long"), hashed=windows(F.col("w")))
    rows = fixed(rows, rep=covered(F.col("hashed")).cast("long"), failing=F.filter("lw", lambda x, i: F.get("bad", i)))
    rows = rows.withColumn("lost", F.aggregate("failing", F.lit(0).cast("long"), lambda n, x: n + F.size(x)))
    failed = (F.col("n") < least_words) | (100 * F.col("rep") > most_repeats * F.col("n"))
    good = F.when(F.size("failing") == 0, text).otherwise(F.array_join(F.filter("ls", lambda x, i: ~F.get("bad", i)), "\n"))
    return unfold(
        rows, docs.columns, n_words=F.col("n"), word_chars=F.length(F.array_join("w", "")).cast("long"),
        n_symbols=count_of(F.col("marks"), SYMBOLS).cast("long"), n_dup_lines=(F.size("full") - F.size(F.array_distinct("full"))).cast("long"),
        n_repeat_words=F.col("rep"), base_failed=failed, n_failed_lines=F.size("failing").cast("long"), n_lost_words=F.col("lost"), cleaned=good,
        kept=~failed & (100 * F.col("lost") <= most_lost * F.col("n")),
    )
