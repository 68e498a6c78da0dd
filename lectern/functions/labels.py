"""Chapter labels: what a raw label says, as columns that never become one number.

12.10 is not 12.1, and 12.5 is not 12.50: parts stay text, and only parts are
compared as integers.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numerals, the words that name front matter, endings and extras, and the marks of a numbered heading.
DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "兩": 2, "两": 2}
UNITS = {"十": 10, "百": 100, "千": 1000}
WHOLE_TENS = {"廿": 20, "卅": 30}
FRONT = ("序章", "序幕", "楔子", "前言", "引子")
END = ("終章", "终章", "尾聲", "尾声", "後記", "后记", "終曲", "终曲", "大結局", "大结局")
EXTRA = ("番外", "外傳", "外传", "附錄", "附录")
LABEL = T.StructType([T.StructField(n, T.StringType() if n != "parts" else T.ArrayType(T.StringType())) for n in ("raw", "kind", "parts", "sub_part", "key")])

_WIDE_DIGITS = {0xFF10 + i: ord("0") + i for i in range(10)}
_SUB_PART = re.compile(r"[（(]\s*([上中下])\s*[)）]\s*$")
#: Ways to write a number as a whole label; brackets of one type, of either width.
_NUMBERED = (
    re.compile(r"[第卷](.+?)[章回幕部節节集卷].*"),
    re.compile(r"[（(]([^（）()]+)[）)]"),
    re.compile(r"【([^【】]+)】"),
    re.compile(r"〔([^〔〕]+)〕"),
    re.compile(r"([0-9.]+)"),
    re.compile(r"(.*)、"),
    re.compile(r"其(.+)"),
)


def chinese_number(text: str) -> int | None:
    """The value of a numeral in characters; a digit that no unit follows counts only at the end."""
    total, pending = 0, None
    for c in text:
        if c in DIGITS:
            pending = DIGITS[c]
        elif c in UNITS:
            total += (1 if pending is None else pending) * UNITS[c]
            pending = None
        elif c in WHOLE_TENS:
            total += WHOLE_TENS[c]
            pending = None
        else:
            return None
    total += pending or 0
    return total if total or (text and set(text) <= set("零〇")) else None


def numeral_value(text: Column) -> Column:
    """A number in digits of either width as digits, or one in characters by :func:`chinese_number`'s rule, as a string; null for anything else."""
    plain = F.translate(text, "".join(map(chr, _WIDE_DIGITS)), "0123456789")
    state = lambda total, pending: F.struct(total.cast("long").alias("total"), pending.cast("long").alias("pending"))
    no_digit = F.lit(None).cast("long")

    def step(s, c):
        value = lambda names: F.coalesce(*[F.when(c == name, v) for name, v in names.items()])
        of_unit = s["total"] + F.coalesce(s["pending"], F.lit(1)) * value(UNITS)
        return F.when(c.isin(*DIGITS), state(s["total"], value(DIGITS))).when(c.isin(*UNITS), state(of_unit, no_digit)).when(c.isin(*WHOLE_TENS), state(s["total"] + value(WHOLE_TENS), no_digit))

    total = F.aggregate(F.split(plain, ""), state(F.lit(0), no_digit), step, lambda s: s["total"] + F.coalesce(s["pending"], F.lit(0)))
    return F.when(plain.rlike("^[0-9]+$"), plain).when(plain != "", F.when((total != 0) | plain.rlike("^[零〇]+$"), total.cast("string")))


def numeric_parts(text: str) -> list[str] | None:
    """``12.5.1`` as three parts, a numeral in characters as one; None for anything else."""
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+)*", text):
        return text.split(".")
    n = chinese_number(text) if text else None
    return None if n is None else [str(n)]


def key_of(family: str, parts: list[str], sub: str | None) -> str:
    """Leading zeros don't count, trailing ones do."""
    return f"{family}:{'.'.join(p.lstrip('0') or '0' for p in parts)}" + (f"#{sub}" if sub else "")


def parse(raw: str | None) -> dict:
    out = {"raw": raw, "kind": "unnumbered", "parts": None, "sub_part": None, "key": None}
    text = (raw or "").strip().translate(_WIDE_DIGITS)
    sub = None
    if m := _SUB_PART.search(text):
        sub, text = m[1], text[: m.start()]
    text = "".join(text.split())
    for kind, names in (("front", FRONT), ("end", END)):
        if text in names:
            return out | {"kind": kind}
    for word in EXTRA:
        if text.startswith(word):
            parts = numeric_parts(text[len(word) :])
            return out | {"kind": "extra"} | ({"parts": parts, "sub_part": sub, "key": key_of("extra", parts, sub)} if parts else {})
    # the first way that fits is the only one tried
    number = next((m[1] for m in (way.fullmatch(text) for way in _NUMBERED) if m), None)
    parts = numeric_parts(number) if number is not None else None
    return out | ({"kind": "numbered", "parts": parts, "sub_part": sub, "key": key_of("ch", parts, sub)} if parts else {})


@F.pandas_udf(LABEL)
def parse_label(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(r) for r in raw], columns=[f.name for f in LABEL.fields])


def order_key(label: Column) -> Column:
    """Sorts labels: front matter, numbers part by part (a missing part first) and then by sub-part, endings and extras without a number, the rest."""
    rank = F.when(label["parts"].isNotNull(), 1).when(label["kind"] == "front", 0).when(label["kind"].isin("end", "extra"), 2).otherwise(3)
    numbers = F.transform(F.coalesce(label["parts"], F.array().cast("array<string>")), lambda p: p.cast("decimal(38,0)"))
    return F.struct(rank.alias("rank"), numbers.alias("numbers"), F.coalesce(label["sub_part"], F.lit("")).alias("sub"))


def same_number(a: Column, b: Column) -> Column:
    """Whether two labels are candidates for one number."""
    return F.coalesce(a["key"] == b["key"], F.lit(False))
