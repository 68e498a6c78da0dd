"""Chapters from plain-text books.

Lines, their classes and the running chapter number are Spark columns and
windows over a book. A heading has a marker that says so, or is of a weak form
(a bare number in one of five notations) that the book uses in increasing order
at least twice, or is a short line after a blank one once a marked heading was
seen. A weak number is in order if it is above all before it of its form.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.labels import numeral_value, parse_label
from lectern.functions.scalars import COMPLETED, ONGOING, SPACES, let
from lectern.stored import table

BLANKS = " \t\n\x0b\x0c\r\u00a0\u2002\u2003\u3000\ufeff"
_S = r"[\s\u00a0\u3000]*"
# The marks and words of headings, and what ends a sentence.
NUMERAL = "[0-9０-９零〇一二三四五六七八九十廿卅百千两兩]"
STRONG = (
    r"^([第卷][0-9０-９.．一二三四五六七八九十零〇百千两兩]*[章回幕部節节集卷]|序章|序幕|楔子|引子|終章|终章|尾聲|尾声|後記|后记|終曲|终曲|大結局|大结局"
    rf"|(?:番外|外[傳传]|附[錄录])[0-9０-９.．]*)({_S}[（(][^（）()]{{1,12}}[）)])?{_S}(.*)$"
)
WEAK = [rf"^([（(]{_S}{NUMERAL}+{_S}[）)]){_S}(.*)$", rf"^(【{_S}{NUMERAL}+{_S}】){_S}(.*)$", rf"^(〔{_S}{NUMERAL}+{_S}〕){_S}(.*)$", rf"^(其{NUMERAL}+){_S}(.*)$", rf"^({NUMERAL}+{_S}、){_S}(.*)$"]
#: The weak form that also starts sentences; it has to start a block.
NEEDS_BLANK = 4
VOLUME = rf"^([第卷][0-9０-９零〇一二兩两三四五六七八九十百千]+[卷集部].{{0,20}})$"
SENTENCE_END = "[。！？…；：，、]$"
MOST_HEADING, MOST_VOLUME, MOST_BARE, MOST_TITLE = 60, 40, 30, 100
#: Lines and bytes of text of a task, on average: what its sorts hold stays the same however many books there are.
LINES_A_TASK, BYTES_A_TASK = 500_000, 32_000_000


def check_pattern(pattern: str) -> str:
    """A caller's heading pattern: short, no nested repeats, not matching nothing."""
    if len(pattern) > 200:
        raise ValueError("pattern_too_long")
    if re.search(r"\([^)]*[+*}][^)]*\)[+*{]", pattern):
        raise ValueError("pattern_nested_repeat")
    try:
        if re.search(pattern, "") is not None:
            raise ValueError("pattern_matches_empty")
    except re.error as e:
        raise ValueError("pattern_invalid") from e
    return pattern


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _with_weak_headings(lines: DataFrame) -> DataFrame:
    """``lines`` with ``accepted, weak_label, weak_title``: lines of a weak form in order, if the form has two such, are accepted, the rest of them
    refused; for any other line the three are null. A running maximum for each form, so that the lines stay in their one order."""
    book = Window.partitionBy("path")
    before = book.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    forms = range(len(WEAK))
    fits = lambda k: F.col("t").rlike(WEAK[k]) & (F.col("opens") if k == NEEDS_BLANK else F.lit(True))
    of_form = lambda values: F.coalesce(*[F.when(F.col("form") == k, v) for k, v in enumerate(values)])
    pick = lambda g: of_form([_trim(F.regexp_extract("t", p, g)) for p in WEAK])
    lines = lines.withColumn("form", F.when(F.length("t").between(1, MOST_HEADING), F.coalesce(*[F.when(fits(k), k) for k in forms])))
    lines = lines.withColumns({"weak_label": pick(1), "weak_title": pick(2)})
    n = F.when(~F.col("weak_title").rlike(SENTENCE_END), numeral_value(F.regexp_extract("weak_label", f"{NUMERAL}+", 0)).cast("decimal(38,0)"))
    lines = lines.withColumn("n", n).withColumns({f"above_{k}": F.max(F.when(F.col("form") == k, F.col("n"))).over(before) for k in forms})
    above = of_form([F.col(f"above_{k}") for k in forms])
    lines = lines.withColumn("kept", F.when(F.col("n").isNotNull(), above.isNull() | (F.col("n") > above)))
    lines = lines.withColumns({f"kept_{k}": F.count_if(F.col("kept") & (F.col("form") == k)).over(book) for k in forms})
    return lines.withColumn("accepted", F.when(F.col("kept").isNotNull(), F.col("kept") & (of_form([F.col(f"kept_{k}") for k in forms]) >= 2)))


def chapters(books: DataFrame, pattern: str | None = None) -> DataFrame:
    """``path, position, volume_label, label_raw, label, title, body, warnings, needs_review`` from ``path, text``.

    Positions count from 0. Nothing is discarded: text before the first heading
    is a chapter with an empty label, as is a book without headings. Lines of
    volumes name the chapters after them. Paragraphs are joined by a blank line.
    With a caller's ``pattern`` no weak form is looked for; its first two groups,
    if any, are label and title. Books without text give no rows.

    Books are written first, and their lines counted: they are dealt out by path
    once, to as many tasks as the lines demand, and all below is within a book.
    """
    order = Window.partitionBy("path").orderBy("at")
    books = table(books.select("path", "text"))
    demand = F.sum((F.regexp_count("text", F.lit("\r\n?|\n")) + 1) / LINES_A_TASK + F.octet_length("text") / BYTES_A_TASK)
    tasks = max(books.sparkSession.sparkContext.defaultParallelism, math.ceil(books.agg(demand).first()[0] or 0))
    lines = books.repartition(tasks, "path").select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)).alias("at", "line")).withColumn("t", _trim(F.col("line")))
    blank = F.col("t") == ""
    lines = lines.withColumn("opens", F.coalesce(F.lag(blank).over(order), F.lit(True)))
    volume = F.when(F.col("t").rlike(VOLUME) & (F.length(F.rtrim(F.col("line"), F.lit(BLANKS))) <= MOST_VOLUME), F.col("t"))
    short = F.length("t").between(1, MOST_HEADING)
    if pattern:
        own, groups = rf"(?i)^(?:{check_pattern(pattern)})", re.compile(pattern).groups
        found = short & (F.regexp_extract("t", own, 0) != "")
        label = _trim(F.regexp_extract("t", own, 1 if groups else 0))
        title = _trim(F.regexp_extract("t", own, 2) if groups > 1 else F.regexp_replace("t", own, ""))
        lines = lines.withColumns({"accepted": F.lit(None).cast("boolean"), "weak_label": F.lit(None).cast("string"), "weak_title": F.lit(None).cast("string")})
    else:
        found = short & F.col("t").rlike(STRONG) & ~_trim(F.regexp_extract("t", STRONG, 3)).rlike(SENTENCE_END)
        label, title = _trim(F.concat(F.regexp_extract("t", STRONG, 1), F.regexp_extract("t", STRONG, 2))), _trim(F.regexp_extract("t", STRONG, 3))
        lines = _with_weak_headings(lines)
    lines = lines.withColumn("volume", volume).withColumn("strong", found & F.col("volume").isNull())
    marked = F.col("volume").isNull() & (F.col("strong") | F.coalesce("accepted", F.lit(False)))
    lines = lines.withColumn("marked", marked)
    seen = F.coalesce(F.max("marked").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    opens = F.coalesce(F.lag(blank | F.col("volume").isNotNull()).over(order), F.lit(True))
    bare = ~F.col("marked") & F.col("volume").isNull() & seen & opens & F.col("accepted").isNull() & F.length("t").between(1, MOST_BARE) & ~F.col("t").rlike(SENTENCE_END) & ~F.col("t").rlike("[.!?,;:]$")
    lines = lines.withColumn("head", F.col("marked") | bare)
    lines = lines.withColumns({
        "chapter": F.sum(F.col("head").cast("int")).over(order), "volume_label": F.last("volume", ignorenulls=True).over(order),
        "label_raw": F.when(F.col("strong"), label).when(F.col("marked"), F.col("weak_label")).when(F.col("head"), F.col("t")),
        "title": F.when(F.col("strong"), title).when(F.col("marked"), F.col("weak_title")),
    })
    para = F.when(~F.col("head") & F.col("volume").isNull() & (F.col("t") != ""), F.struct("at", "t"))
    parts = lines.groupBy("path", "chapter").agg(
        F.max(F.when(F.col("head"), F.col("volume_label"))).alias("volume_label"), F.coalesce(F.max("label_raw"), F.lit("")).alias("label_raw"), F.coalesce(F.max("title"), F.lit("")).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(para)), lambda x: x["t"]), "\n\n").alias("body"), F.max("marked").alias("marked"),
    ).where("chapter > 0 OR body <> ''")
    book, by_label = Window.partitionBy("path"), Window.partitionBy("path", "label_raw").orderBy("chapter")
    out = parts.withColumns({"position": F.row_number().over(book.orderBy("chapter")) - 1, "nth": F.row_number().over(by_label), "any": F.max("marked").over(book)})
    warnings = {
        "leading_content_before_first_heading": (F.col("label_raw") == "") & (F.col("position") == 0), "unlabeled_section": (F.col("label_raw") == "") & (F.col("position") > 0),
        "empty_chapter": F.col("body") == "", "unusually_long_title": F.length("title") > MOST_TITLE, "duplicate_label": F.col("nth") == 2,
    }
    return out.withColumn("label", F.when(F.col("label_raw") != "", parse_label("label_raw"))).select(
        "path", "position", "volume_label", "label_raw", "label", "title", "body",
        F.array_compact(F.array(*[F.when(c, w) for w, c in warnings.items()])).alias("warnings"), (~F.col("any") | (F.col("label_raw") == "")).alias("needs_review"), F.col("any").alias("has_headings"),
    )


def book_warnings(books: DataFrame, found: DataFrame) -> DataFrame:
    """``path, warnings``: a book without chapters, without reliable headings, or with a single one."""
    n = found.groupBy("path").agg(F.count("*").alias("n"), F.max("has_headings").alias("any"))
    warning = F.when(F.col("n").isNull(), "empty_source").when(~F.col("any"), "no_reliable_chapter_boundaries").when(F.col("n") == 1, "single_heading")
    return books.select("path").join(n, "path", "left").select("path", F.array_compact(F.array(warning)).alias("warnings"))


# Names of the fields that a book's front matter gives.
FIELDS = {
    "title": r"書名|书名|作品名[稱称]?|title",
    "author": r"作者|author",
    "description": r"內容簡介|内容简介|簡介|简介|description",
    "keywords": r"分類|分类|類型|类型|題材|题材|標籤|标签|關鍵詞|关键词|categor(?:y|ies)|genres?|tags?|keywords?",
    "serial_status": r"連載狀態|连载状态|狀態|状态|status",
}
_FIELD = re.compile("(?:" + "|".join(f"(?P<{k}>{p})" for k, p in FIELDS.items()) + r")\s*[:：]\s*(?P<value>.*)", re.I)
_QUOTED = re.compile(r"《([^》]+)》(?:\s*作者\s*[:：]\s*(.+))?")
_CHAPTER = re.compile(r"[第卷][0-9０-９一二三四五六七八九十零〇百千两兩]*[章回幕部節节集卷]")
_BETWEEN, _AROUND = re.compile(r"[、,，/／|｜;；]+|\s{2,}|#|＃"), " \t\u3000【】〔〕[]()（）「」『』"
MOST_HEAD, MOST_LINES, MOST_NAME, MOST_DESCRIPTION, MOST_KEYWORDS = 16_000, 150, 300, 5_000, 20
MATTER = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "author", "description", "serial_status")] + [T.StructField("keywords", T.ArrayType(T.StringType()))])


def matter(head: str | None) -> dict:
    """What the lines before the first chapter say; a description goes on until the next field."""
    out: dict = {"title": None, "author": None, "description": None, "serial_status": None, "keywords": None}
    description: list[str] | None = None
    open_, words = False, []
    for line in re.split(r"\r\n?|\n", (head or "")[:MOST_HEAD])[:MOST_LINES]:
        line = line.strip().lstrip("\ufeff")
        if _CHAPTER.match(line):
            break
        field = _FIELD.fullmatch(line)
        if field:
            name, value = next(k for k in FIELDS if field[k]), field["value"]
            open_ = name == "description"
            if open_:
                description = [*(description or []), value]
            elif name == "keywords":
                words += [w for w in (p.strip(_AROUND) for p in _BETWEEN.split(value)) if w and len(w) <= 50]
            elif name == "serial_status":
                out[name] = "ongoing" if re.search(ONGOING, value) else "completed" if re.search(COMPLETED, value) else None
            else:
                out[name] = value[:MOST_NAME]
        elif open_:
            description.append(line)
        elif quoted := _QUOTED.fullmatch(line):
            out["title"] = out["title"] or quoted[1]
            out["author"] = out["author"] or quoted[2]
    if description is not None:
        out["description"] = "\n".join(description).strip()[:MOST_DESCRIPTION]
    if words:
        out["keywords"] = list(dict.fromkeys(words))[:MOST_KEYWORDS]
    return out


@F.pandas_udf(MATTER)
def _matter(heads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([matter(h) for h in heads], columns=[f.name for f in MATTER.fields])


def front_matter(text: Column) -> Column:
    """Title, author, description, status and keywords from a book's first lines; only its head goes to Python."""
    return _matter(F.left(text, F.lit(MOST_HEAD)))


# Lines that advertise, head a chapter or name a field, and the marks that end or open a sentence.
PROMOTION = r"(?i)^\s*(?:本[書书]由.{1,30}(?:整理|收集)|[請请]搜索.{1,30}(?:小說|小说)|更多精彩.{1,30}|最新網址[:：]?\s*\S+|最新网址[:：]?\s*\S+|https?://\S+|www\.\S+)\s*\z"
HEADING = r"^\s*(?:[第卷][0-9０-９.．一二三四五六七八九十零〇百千两兩]*[章回幕部節节集卷]|序章|序幕|楔子|引子|[終终]章|尾[聲声]|[後后][記记]|大[結结]局|番外|外[傳传]|附[錄录])"
NAMED_FIELD = r"(?i)^\s*(?:作品名|書名|书名|作者|簡介|简介|內容簡介|内容简介|狀態|状态|連載狀態|连载状态|title|author|description|status)\s*[:：]"
ENDS, OPENS, LISTED = r"[。！？!?；;…」』）》】]\z", r"^[「『（(《【]", r"^\s*(?:[-*•]|\d+[.、])"
#: Code points of a line that may be a part of a broken one.
MOST_WRAPPED = 60


def tidy(text: Column, trim: bool = True, collapse: bool = True, promotions: bool = False, join: bool = False) -> Column:
    """``text`` tidied up, with what was done: a struct of text, trimmed, collapsed, promotions, joined (numbers of lines).

    Lines are trimmed, runs of blank lines become one, lines that advertise go,
    and lines broken within a sentence are joined. Each step is a pass over the
    array of lines in which a line's fate depends on the line before it, so that
    a book's work grows with its length. An empty text stays empty, null is null.
    """
    spaces = F.lit(SPACES)
    # a line beside the one before it; the first one's is null
    beside = lambda c: F.arrays_zip(c.alias("line"), F.concat(F.array(F.lit(None).cast("string")), F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))).alias("before"))
    again = lambda p: F.coalesce((p["line"] == "") & (p["before"] == ""), F.lit(False))

    def joins(p):
        fits = lambda c: F.length(c).between(1, MOST_WRAPPED) & ~c.rlike(HEADING) & ~c.rlike(NAMED_FIELD)
        return F.coalesce(fits(p["before"]) & fits(p["line"]) & ~p["before"].rlike(ENDS) & ~p["line"].rlike(OPENS) & ~p["line"].rlike(LISTED), F.lit(False))

    def with_gap(p):
        ascii_ = p["line"].rlike(r"^[\x00-\x7f]") & p["before"].rlike(r"[\x00-\x7f]\z")
        gap = F.when(p["before"].isNull(), "").when(joins(p), F.when(ascii_, " ").otherwise("")).otherwise("\n")
        return F.struct(gap.alias("gap"), p["line"].alias("line"))

    def put_together(spaced, counts):
        if not join:
            return F.struct(F.btrim(F.array_join(spaced, "\n"), F.lit("\n")).alias("text"), *counts, F.lit(0).alias("joined"))

        def whole(parts):
            text = F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], p["line"])), "")
            # every line but the first was joined, or began anew
            return F.struct(F.btrim(text, F.lit("\n")).alias("text"), *counts, F.size(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p["gap"] != "\n")).alias("joined"))

        return let(F.transform(beside(spaced), with_gap), whole)

    def tidied(given):
        def of_kept(kept):
            trimmed = F.size(F.filter(kept, lambda x: F.btrim(x, spaces) != x)) if trim else F.lit(0)

            def of_lines(lines):
                counts = lambda spaced: [trimmed.alias("trimmed"), (F.size(lines) - F.size(spaced)).alias("collapsed"), (F.size(given) - F.size(kept)).alias("promotions")]
                spaced = F.transform(F.filter(beside(lines), lambda p: ~again(p)), lambda p: p["line"]) if collapse else lines
                return let(spaced, lambda s: put_together(s, counts(s)))

            return let(F.transform(kept, lambda x: F.btrim(x, spaces)) if trim else kept, of_lines)

        return let(F.filter(given, lambda x: ~x.rlike(PROMOTION)) if promotions else given, of_kept)

    given = F.split(F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r\n?", "\n"), "\n", -1)
    return F.when(text.isNotNull(), let(given, tidied))
