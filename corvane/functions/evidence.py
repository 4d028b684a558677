"""Titles and episode numbers from the text of subtitles and other content, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.paths import let

# The forms of lines that name a title, and the marks of an episode.
TITLE_LINES = [
    r"(?i)^previously on\s+(.+)$",
    r"(?i)^last time on\s+(.+)$",
    r"(?i)^you(?:'re| are) watching\s+(.+)$",
    r"(?i)^watching\s+(.+)$",
    r"(?i)^from the series\s+(.+)$",
    r"(?i)^(.+?)\s*-\s*S\d{1,2}E\d{1,3}\b",
    r"(?i)^(.+?)\s+season\s+\d{1,2}\s+episode\s+\d{1,3}\b",
    r"(?i)^(.+?)\s+ep(?:isode)?\s+\d{1,3}\b",
    r"^[\"'“《](.+?)[\"'”》]\s*(?:第\s*\d+\s*集|episode\s*\d+|ep\s*\d+|s\d{1,2}e\d{1,3})",
    r"^(.+?)\s*[·:：]\s*(?:第\s*\d+\s*集|episode\s*\d+|ep\s*\d+|s\d{1,2}e\d{1,3})",
    r"^(.+?)\s*前情提要$",
    r"^(.+?)\s*上[一二三四五六七八九0-9]*集回顾$",
    r"^(.+?)\s*第\s*\d+\s*集$",
    r"^第\s*\d+\s*集\s*(.+)$",
]
MARKS = {"both": r"(?i)S(\d{1,2})E(\d{1,3})", "episode": r"(?i)(?:Episode|EP|E)\s*(\d{1,3})", "zh": r"第\s*(\d{1,3})\s*集"}
RECAP_LINES = 4  # the last of TITLE_LINES
# What parts two titles in one line, words before a title, and words that no title holds.
TITLE_SEPARATORS = [" / ", " | ", " - ", " – ", " — ", "·", "：", ":"]
PROMPTS = ["请继续观看 ", "继续观看 ", "正在播放 ", "请收看 ", "you are watching ", "you're watching ", "watching ", "from the series "]
NO_TITLE_STARTS, NO_TITLE_WORDS = ["episode ", "season "], ["subtitle", "dialogue", "commentary"]
BILINGUAL = ["chi", "zho", "zh", "chs", "cht", "jpn", "ja", "kor", "ko"]
EAST = r"[\u4E00-\u9FFF\u3400-\u4DBF\u3040-\u30FF\uAC00-\uD7AF]"
SIGNALS = [(4, ["previously on", "last time on", "前情提要", "上集回顾"]), (3, ["you are watching", "you're watching", "from the series"])]
ALIAS_PUNCTUATION = r"[·:：\-_'\"“”‘’《》()\[\]]"
LINES_READ, LINES_KEPT = 64, 12


def clean_line(line: Column) -> Column:
    """A line without markup; empty for time codes and numbers."""
    text = F.replace(F.trim(line), F.lit("\\N"), F.lit(" "))
    bare = F.trim(F.replace(F.regexp_replace(text, r"\{[^}]+\}|<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" ")))
    return F.when(text.rlike(r"^\d{2}:\d{2}:\d{2}|^\d+$"), "").otherwise(bare)


def spoken_lines(text: Column, dialogue: bool = False, most: int = LINES_READ) -> Column:
    """The first lines of a subtitle text that are spoken.  dialogue: rows are `Dialogue:` records, the tenth field being the text."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    if dialogue:
        rows = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.startswith("Dialogue:"))
        lines = F.transform(rows, lambda x: F.coalesce(F.get(F.split(x, ",", 10), F.lit(9)), F.lit("")))
    kept = F.filter(F.transform(lines, clean_line), lambda x: (F.octet_length(x) >= 2) & ~(x.startswith("[") & x.endswith("]")))
    return F.slice(kept, 1, most)


def episode_mark(text: Column) -> Column:
    """A struct of season and episode by the first kind of mark that the text holds; both null without any."""
    number = lambda kind, group: F.nullif(F.regexp_extract(text, MARKS[kind], group), F.lit("")).try_cast("int")
    both = text.rlike(MARKS["both"])
    return F.struct(F.when(both, number("both", 1)).alias("season"), F.when(both, number("both", 2)).otherwise(F.coalesce(number("episode", 1), number("zh", 1))).alias("episode"))


def title_form(text: Column) -> Column:
    """Trimmed, without quotes and dashes around it, dots and underscores as spaces, single spaces."""
    bare = F.regexp_replace(F.trim(text), "^[-:|\"']+|[-:|\"']+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[._]+", " "), r"\s+", " "))


def alias_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title_form(text)), ALIAS_PUNCTUATION, " "), r"\s+", " "))


def distinct_by(values: Column, key) -> Column:
    """The first of the values with equal keys, in order; those with an empty key are left out."""
    return let(values, lambda v: let(F.transform(v, key), lambda keys: F.filter(v, lambda x, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))))


def priority(line: Column) -> Column:
    """How telling a line is: the kind of its signal, a readable length, and shortness."""
    lower = F.lower(line)
    said = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(lower, p))
    signal = F.when(said(SIGNALS[0][1]), 4).when(said(SIGNALS[1][1]), 3).when(episode_mark(line)["episode"].isNotNull(), 2).otherwise(1)
    return F.struct(signal.alias("signal"), F.when(F.length(line).between(4, 48), 2).otherwise(1).alias("readable"), (-F.octet_length(line)).alias("short"))


def telling_lines(lines: Column, most: int = LINES_KEPT) -> Column:
    """The most telling lines, each once, the earlier first among equals."""
    ranked = F.transform(lines, lambda x, i: F.struct(priority(x).alias("p"), (-i).alias("at"), x.alias("line")))
    order = F.transform(F.reverse(F.array_sort(ranked)), lambda r: r["line"])
    return F.slice(distinct_by(order, lambda x: F.lower(title_form(x))), 1, most)


def titles_in(line: Column) -> Column:
    """Titles that a line names, by each of the forms, in their order."""
    found = F.array(*[F.trim(F.regexp_extract(line, p, 1)) for p in TITLE_LINES])
    return F.filter(found, lambda x: x != "")


def prefix_title(line: Column) -> Column:
    """What stands before the first dash, bar or colon of a line that names an episode, if it may be a title; else null."""
    episode = episode_mark(line)["episode"]
    prefix = F.trim(F.split(line, r"[-|:]", 2)[0])
    fits = F.octet_length(prefix).between(4, 48) & ~F.contains(F.lower(prefix), F.lit("episode")) & ~F.contains(prefix, episode.cast("string"))
    return F.when(episode.isNotNull() & fits, prefix)


def may_be_title(text: Column) -> Column:
    lower = F.lower(text)
    bad = F.exists(F.array(*[F.lit(x) for x in NO_TITLE_STARTS]), lambda x: lower.startswith(x)) | F.exists(F.array(*[F.lit(x) for x in NO_TITLE_WORDS]), lambda x: F.contains(lower, x))
    return F.length(text).between(2, 64) & ~bad & text.rlike(r"\p{IsAlphabetic}")


def without_prompt(text: Column) -> Column:
    """A text without the first of the prompts that it begins with."""
    trimmed = F.trim(text)
    out = F.when(F.lit(False), trimmed)
    for p in PROMPTS:
        out = out.when(F.lower(trimmed).startswith(p), F.trim(F.substring(trimmed, F.lit(len(p) + 1), F.length(trimmed))))
    return out.otherwise(trimmed)


def both_titles(line: Column, language: Column) -> Column:
    """The two titles of a line that gives one in each of two languages, by each separator in turn.

    Both sides must look like titles, and differ in script unless the language is one that is often paired.
    """
    paired = F.coalesce(F.lower(language).isin(BILINGUAL), F.lit(False))
    ascii_ = lambda x: x.rlike(r"^[\x00-\x7f]*$")
    differ = lambda a, b: (ascii_(a) != ascii_(b)) | (a.rlike(EAST) != b.rlike(EAST))
    side = lambda x: without_prompt(title_form(x))

    def by(separator: str) -> Column:
        at = F.instr(line, separator)
        halves = F.struct(side(F.substring(line, F.lit(1), at - 1)).alias("a"), side(F.substring(line, at + len(separator), F.length(line))).alias("b"))
        return F.when(at > 0, F.transform(F.array(halves), lambda h: F.when(may_be_title(h["a"]) & may_be_title(h["b"]) & (differ(h["a"], h["b"]) | paired), F.array(h["a"], h["b"])))[0])

    return F.flatten(F.array_compact(F.array(*[by(x) for x in TITLE_SEPARATORS])))


def line_titles(line: Column, language: Column) -> Column:
    """All titles that a line may name, in plain form, the first of those that read alike."""
    found = [F.trim(F.regexp_extract(line, p, 1)) for p in TITLE_LINES]
    every = F.concat(F.filter(F.array(*found[:-RECAP_LINES], F.coalesce(prefix_title(line), F.lit("")), *found[-RECAP_LINES:]), lambda x: x != ""), both_titles(line, language))
    forms = F.filter(F.transform(every, title_form), lambda x: (x != "") & may_be_title(x))
    return distinct_by(forms, alias_key)


def short_title(text: Column) -> Column:
    """The plain form of a text of at most 10 words and 64 bytes, else empty."""
    form = title_form(F.coalesce(text, F.lit("")))
    return F.when((F.size(F.filter(F.split(form, " "), lambda w: w != "")) <= 10) & (F.octet_length(form) <= 64), form).otherwise("")


def content_titles(content: Column) -> Column:
    """The titles that an item's content names, in order, each once: of its container, the comment, the chapters and the subtitles."""
    none, box = F.array().cast("array<string>"), content["container"]
    subs = F.flatten(F.transform(content["subtitles"], lambda s: F.coalesce(s["title_candidates"], none)))
    every = F.concat(F.array(title_form(F.coalesce(box["title"], F.lit(""))), short_title(box["comment"])), F.transform(F.coalesce(box["chapters"], none), short_title), F.transform(F.coalesce(subs, none), lambda x: title_form(F.coalesce(x, F.lit("")))))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def title_aliases(titles: Column) -> Column:
    """Distinct titles in plain form, at most 10 words and 64 bytes long."""
    forms = F.filter(F.transform(titles, title_form), lambda x: (F.size(F.split(x, " ")) <= 10) & (F.octet_length(x) <= 64))
    return distinct_by(forms, alias_key)


def subtitle_priority(language: Column, title: Column, default: Column, forced: Column) -> Column:
    """Order of subtitle streams: language, kind of track, default mark, and not forced."""
    tongue, name = F.lower(F.coalesce(language, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    by_language = F.when(tongue.isin("chi", "zho", "zh", "chs", "cht"), 3).when(tongue.isin("eng", "en"), 2).otherwise(1)
    by_name = F.when(F.contains(name, F.lit("forced")) | F.contains(name, F.lit("commentary")), 0).when(F.contains(name, F.lit("full")), 2).otherwise(1)
    return F.struct(by_language.alias("language"), by_name.alias("track"), F.coalesce(default.cast("int"), F.lit(0)).alias("is_default"), (1 - F.coalesce(forced.cast("int"), F.lit(0))).alias("not_forced"))
