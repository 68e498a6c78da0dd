"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.normal import normalised


#: What counts as white space at a text's ends.
SPACES = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def public_id(ident: Column) -> Column:
    """The first eight hex digits of a UUID."""
    return F.left(F.regexp_replace(ident, "-", ""), F.lit(8))


def is_night(hour: Column, start: int, end: int) -> Column:
    """Whether the hour is in [start, end), past midnight if end is less; equal bounds are no night."""
    if start == end:
        return F.lit(False)
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def slug(title: Column, most: int = 40) -> Column:
    """Runs of letters and digits joined by dashes, lower-cased, cut at the last dash within ``most``; compatibility forms are folded."""
    runs = F.array_join(F.regexp_extract_all(F.lower(normalised(title, "NFKC")), F.lit(r"[\p{IsHan}\p{L}\p{N}]+"), F.lit(0)), "-")
    cut = F.left(runs, F.lit(most))
    dash = F.locate("-", cut) > 0
    return F.when(F.length(runs) <= most, runs).when(dash, F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut)


def work_path(title: Column, ident: Column) -> Column:
    s = slug(title)
    return F.when(s == "", public_id(ident)).otherwise(F.concat_ws("-", s, public_id(ident)))


def xml_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def paragraphs(body: Column, separator: str = "\n\n") -> Column:
    """An empty body has none."""
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, separator, -1))


def excerpt(body: Column, index: Column, separator: str = "\n\n", most: int = 1000) -> Column:
    return F.left(F.get(paragraphs(body, separator), index), F.lit(most))


def body_window(body: Column, offset: Column, size: int = 24_000) -> Column:
    return F.substring(body, offset + 1, F.lit(size))


def revision_hash(title: Column, body_hash: Column, processor: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("\n", title, body_hash, processor, digest), 256)


def analysis_version(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def keywords(text: Column, most: int = 20, longest: int = 50) -> Column:
    """Distinct keywords of a line, in order; list marks, bars, hashes and wide gaps separate, brackets are trimmed."""
    parts = F.split(text, r"[、,，/／|｜;；#＃]|\s{2,}")
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^[\s\[\](){}<>【】《》「」『』（）]+|[\s\[\](){}<>【】《》「」『』（）]+$", ""))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda p: (F.length(p) > 0) & (F.length(p) <= longest))), 1, most)


# What sources call a serial that goes on, and one that ended.
ONGOING, COMPLETED = "(?i)未完[結结]|未完成|連載|连载|ongoing", "(?i)完[結结]|全本|completed"


def completion_status(text: Column) -> Column:
    """'ongoing' is looked for before 'completed', which some of its words contain."""
    return F.when(text.rlike(ONGOING), "ongoing").when(text.rlike(COMPLETED), "completed")


def filename(title: Column, most: int = 100) -> Column:
    """A title as a file's name, in Unicode's composed form: each character that file systems refuse becomes an underscore."""
    clean = F.left(F.btrim(F.regexp_replace(normalised(title), r'[\x00-\x1F\\/:*?"<>|]', "_"), F.lit(SPACES)), F.lit(most))
    return F.when(clean == "", "ebook").otherwise(clean)


def term_key(name: Column) -> Column:
    """A taxonomy name for comparison: lower-cased, no white space or punctuation."""
    return F.regexp_replace(F.lower(name), r"[\s\p{P}\p{S}]+", "")


def term_matches(name: Column, typed: Column) -> Column:
    """Whether a taxonomy name holds what was typed into a picker; nothing typed fits all."""
    return term_key(name).contains(term_key(typed))


def id_list(text: Column) -> Column:
    """Comma-separated UUIDs: trimmed, lower-cased, distinct, sorted; null where one is none, no ids where nothing is given."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.lower(F.btrim(p, F.lit(SPACES)))), lambda p: p != "")
    good = F.forall(parts, lambda p: p.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"))
    return F.when(good, F.array_sort(F.array_distinct(parts)))


def page_size(text: Column, default: int = 20, most: int = 50) -> Column:
    """What a request asks for, between 1 and ``most``; the default for nothing, zero and what is no number."""
    n = text.try_cast("double")
    return F.least(F.greatest(F.when(F.isnan(n) | (n == 0), F.lit(float(default))).otherwise(F.coalesce(n, F.lit(float(default)))), F.lit(1.0)), F.lit(float(most)))


def remap_paragraph(index: Column, count: Column) -> Column:
    return F.greatest(F.lit(0), F.least(index, count - 1))


def relative_day(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n <= 0, "today").when(n == 1, "yesterday").when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    """Reader settings: into range, or the default where there is none."""
    return F.coalesce(F.least(F.greatest(value, F.lit(low)), F.lit(high)), F.lit(default))


# The settings of a reader, each with its default, and its range or the values it may have.
RANGES = {"fontSize": (18.0, 14.0, 28.0), "lineHeight": (1.9, 1.4, 2.6), "paragraphSpacing": (0.9, 0.0, 3.0)}
CHOICES = {"mode": ("scroll", "paginated"), "conversion": ("original", "t", "cn")}
LEVELS = {"warmth": (0, 3), "autoSpeed": (2, 4)}
HOURS = {"nightFrom": 19, "nightTo": 7}
THEMES, THEME, THEME_VERSION = ("light", "sepia", "dark", "system", "schedule"), "system", 2


def settings(raw: Column) -> Column:
    """A reader's stored settings (JSON), each made one that can be shown: numbers in range, known choices, whole hours, else the default.

    Before version 2 the light theme was what nobody had chosen, and counts as
    the default. Text that is no JSON, and null, give all defaults.
    """
    given = lambda name: F.get_json_object(raw, f"$.{name}")
    number = lambda name: given(name).try_cast("double")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)

    def whole(name: str, least: int, most: int, default: int) -> Column:
        n = finite(number(name))
        return F.when((n == F.floor(n)) & n.between(least, most), n.cast("int")).otherwise(F.lit(default))

    stored, version = given("theme"), F.coalesce(F.nullif(number("v"), F.lit(0.0)), F.lit(1.0))
    theme = F.when((version < THEME_VERSION) & (stored.isNull() | (stored == "light")), THEME).when(stored.isin(*THEMES), stored).otherwise(THEME)
    return F.struct(
        theme.alias("theme"),
        *[F.least(F.greatest(F.coalesce(finite(number(n)), F.lit(default)), F.lit(low)), F.lit(high)).alias(n) for n, (default, low, high) in RANGES.items()],
        *[F.when(given(n).isin(*values), given(n)).otherwise(values[0]).alias(n) for n, values in CHOICES.items()],
        *[whole(n, 0, most, default).alias(n) for n, (default, most) in LEVELS.items()],
        *[whole(n, 0, 23, default).alias(n) for n, default in HOURS.items()],
        F.coalesce(given("autoContinue") == "true", F.lit(False)).alias("autoContinue"),
    )


def speech_chunks(text: Column, size: int = 180) -> Column:
    """Pieces of ``size`` code points."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda s: F.substring(text, s, F.lit(size))), lambda c: c != "")


IMAGE = r"^\[\[img:([0-9a-f]{64})\|(.*)\]\]$"


def blocks(body: Column) -> Column:
    """Paragraphs as structs: an image if the paragraph is exactly a marker, else text."""

    def block(p):
        is_image = p.rlike(IMAGE)
        return F.struct(F.when(is_image, "image").otherwise("text").alias("kind"), F.when(~is_image, p).alias("text"), F.when(is_image, F.regexp_extract(p, IMAGE, 1)).alias("content_hash"), F.when(is_image, F.regexp_extract(p, IMAGE, 2)).alias("alt"))

    return F.transform(paragraphs(body), block)


def image_marker(content_hash: Column, alt: Column) -> Column:
    clean = F.left(F.btrim(F.regexp_replace(F.coalesce(alt, F.lit("")), r"[\s\[\]|]+", " ")), F.lit(300))
    return F.concat(F.lit("[[img:"), content_hash, F.lit("|"), clean, F.lit("]]"))


def referenced_images(body: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(blocks(body), lambda b: b["content_hash"]), lambda h: h.isNotNull()))
