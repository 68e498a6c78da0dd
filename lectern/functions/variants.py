"""Traditional and simplified spellings of a query, character by character.

The table here holds common characters only; pass a larger one where it matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common characters that differ, in the same places of both strings.
TRADITIONAL = "萬與專業東兩嚴個為麗舉義樂書買亂爭於雲親億從們價眾優會傳傷偉來兒黨關興養軍農決況凍擊劃劉則剛創別劍動務勝勞勢區醫華單賣衛廠歷厲壓參雙發變葉號嚇嗎員問國圖場壞塊堅聖處備復夠頭奪婦媽學孫寶實審對尋導將爾盡層屬島師帶幫廣開異張彎彈強歸當錄後憂懷態總戀惡懼戰戲據損搖數斷無舊時暫術機殺雜權條極樹橋樓歡殘氣漢湯溝沒淚灑測濃滅燈靈災爐點燒熱愛爺狀獨獄獸現電畫監盤確禮離種稱竊筆級紅紀約結龍門馬"
SIMPLIFIED = "万与专业东两严个为丽举义乐书买乱争于云亲亿从们价众优会传伤伟来儿党关兴养军农决况冻击划刘则刚创别剑动务胜劳势区医华单卖卫厂历厉压参双发变叶号吓吗员问国图场坏块坚圣处备复够头夺妇妈学孙宝实审对寻导将尔尽层属岛师带帮广开异张弯弹强归当录后忧怀态总恋恶惧战戏据损摇数断无旧时暂术机杀杂权条极树桥楼欢残气汉汤沟没泪洒测浓灭灯灵灾炉点烧热爱爷状独狱兽现电画监盘确礼离种称窃笔级红纪约结龙门马"
TABLE = (TRADITIONAL, SIMPLIFIED)


def respell(text: str, one: str, other: str) -> str:
    """Each character of ``one`` replaced by that of ``other``; of several, the first pair counts."""
    return text.translate({ord(a): b for a, b in reversed(list(zip(one, other)))})


def variants(q: str, table: tuple[str, str] = TABLE) -> list[str]:
    """``q`` and its two conversions, distinct, in that order. Phrases are not told apart by sense."""
    return list(dict.fromkeys([q, respell(q, *table), respell(q, *table[::-1])]))


def convert(text: Column, to: str, table: tuple[str, str] = TABLE) -> Column:
    """A body's paragraphs in the other script; image and note markers stay as they are, and so does the number of paragraphs."""
    one, other = table if to == "simplified" else table[::-1]
    marker = r"^\[\[(img|note):"
    return F.array_join(F.transform(F.split(text, "\n\n", -1), lambda p: F.when(p.rlike(marker), p).otherwise(F.translate(p, one, other))), "\n\n")
