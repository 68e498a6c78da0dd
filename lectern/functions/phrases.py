"""Conversion between scripts by the longest phrase: what one character can't tell, the words around it do.

A phrase table (rows of two spellings) becomes a trie; at each place the longest
phrase that begins there is replaced, and where none does, the character's own
counterpart. The table's size is checked before it goes to the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.variants import SIMPLIFIED, TRADITIONAL

#: Phrases, and characters of all phrases, that a table may have to be sent to every executor.
MOST_PHRASES, MOST_CHARACTERS = 400_000, 8_000_000

# Words whose spelling single characters get wrong in one direction or the other, traditional and simplified.
PHRASES = [
    ("頭髮", "头发"), ("理髮", "理发"), ("白髮", "白发"), ("出發", "出发"), ("發現", "发现"), ("發生", "发生"), ("乾淨", "干净"), ("乾杯", "干杯"), ("餅乾", "饼干"), ("幹部", "干部"), ("能幹", "能干"), ("干涉", "干涉"),
    ("乾坤", "乾坤"), ("後來", "后来"), ("以後", "以后"), ("然後", "然后"), ("皇后", "皇后"), ("太后", "太后"), ("麵包", "面包"), ("麵條", "面条"), ("見面", "见面"), ("面對", "面对"), ("裡面", "里面"), ("心裡", "心里"), ("公里", "公里"), ("鄰里", "邻里"),
    ("一隻", "一只"), ("只有", "只有"), ("關係", "关系"), ("系統", "系统"), ("聯繫", "联系"), ("重複", "重复"), ("複雜", "复杂"), ("恢復", "恢复"), ("答覆", "答复"), ("計劃", "计划"), ("划船", "划船"), ("鐘錶", "钟表"), ("表示", "表示"),
    ("手錶", "手表"), ("鬆開", "松开"), ("松樹", "松树"), ("鬍子", "胡子"), ("胡說", "胡说"), ("颱風", "台风"), ("舞台", "舞台"), ("瞭望", "瞭望"), ("著作", "著作"), ("製造", "制造"), ("制度", "制度"), ("北斗", "北斗"), ("戰鬥", "战斗"), ("山谷", "山谷"), ("稻穀", "稻谷"),
]


class Trie:
    """Replaces the longest known phrase at each place, and single characters elsewhere."""

    def __init__(self, pairs: Iterable[tuple[str, str]], characters: tuple[str, str] = ("", "")):
        self.root: dict = {}
        for one, other in [*pairs, *zip(*characters)]:
            node = self.root
            for c in one:
                node = node.setdefault(c, {})
            # of spellings given twice the first counts, and the table's before a character's own
            node.setdefault("", other)
        firsts = "".join(map(re.escape, self.root))
        self.begin = re.compile(f"[{firsts}]") if firsts else None

    def convert(self, text: str) -> str:
        if self.begin is None:
            return text
        out, at = [], 0
        while m := self.begin.search(text, at):
            node, end, found, k = self.root, 0, None, m.start()
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    found, end = node[""], k
            if found is None:
                end, found = m.start() + 1, text[m.start()]
            out += [text[at : m.start()], found]
            at = end
        return "".join([*out, text[at:]])


def checked(phrases: DataFrame) -> list[tuple[str, str]]:
    """The rows of a phrase table (traditional, simplified), after a look at its size; empty and null spellings are left out.

    A phrase can't hold a line break: paragraphs stay as many as they are.
    """
    rows = phrases.select(F.col("traditional").alias("a"), F.col("simplified").alias("b")).where("a <> '' AND b <> ''")
    n, characters, broken = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("a") + F.length("b")), F.lit(0)), F.count_if(F.col("a").contains("\n") | F.col("b").contains("\n"))).first()
    if n > MOST_PHRASES or characters > MOST_CHARACTERS:
        raise ValueError(f"a phrase table of {n} phrases and {characters} characters is too large to be sent to every executor")
    if broken:
        raise ValueError("a phrase can't hold a line break")
    return [(r.a, r.b) for r in rows.orderBy("a", "b").collect()]


def _trie(to: str, pairs: list[tuple[str, str]]) -> Trie:
    characters = (TRADITIONAL, SIMPLIFIED) if to == "simplified" else (SIMPLIFIED, TRADITIONAL)
    return Trie(pairs if to == "simplified" else [(b, a) for a, b in pairs], characters)


#: Texts that a task holds as strings at a time.
AT_A_TIME = 64
MARKER = re.compile(r"\[\[(?:img|note):")


def converter(to: str, phrases: DataFrame | None = None) -> Callable[[Column], Column]:
    """A function of columns: a body's paragraphs in the script ``to`` ('traditional' or 'simplified').

    Image and note markers stay as they are, and so does the number of
    paragraphs. Without a table the built-in one is used. Null stays null.
    """
    pairs = PHRASES if phrases is None else checked(phrases)
    made: list[Trie] = []

    def one(text: str | None) -> str | None:
        return None if text is None else "\n\n".join(p if MARKER.match(p) else made[0].convert(p) for p in text.split("\n\n"))

    @F.arrow_udf("string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not made:
            made.append(_trie(to, pairs))
        for batch in texts:
            for at in range(0, len(batch), AT_A_TIME):
                yield pa.array([one(t.as_py()) for t in batch.slice(at, AT_A_TIME)], pa.string())

    return run


def spellings(q: str, pairs: list[tuple[str, str]] = PHRASES) -> list[str]:
    """``q`` and its two conversions, distinct, in that order: what a search looks for."""
    return list(dict.fromkeys([q, _trie("simplified", pairs).convert(q), _trie("traditional", pairs).convert(q)]))
