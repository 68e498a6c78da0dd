"""Labels, encodings, segmentation, scalars, EPUB, search."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import encoding, labels, phrases, scalars, variants
from lectern.operators import search
from lectern.sources import epub_files, exports, text_files


KEYS = {
    "（十二）": "ch:12", "(十二)": "ch:12", "（１２）": "ch:12", "(012)": "ch:12", "（一）（下）": "ch:1#下", "（註）": None, "第12章": "ch:12", "第1章 潮汐": "ch:1", "第12.5章": "ch:12.5", "第12.10章": "ch:12.10", "第12.50章": "ch:12.50",
    "第12.5.1章": "ch:12.5.1", "第 12.5 章": "ch:12.5", "第012章": "ch:12", "第１２章": "ch:12", "第十二章": "ch:12", "第一百二十三章": "ch:123", "第二千零五章": "ch:2005", "第12章（上）": "ch:12#上", "第12章(下)": "ch:12#下",
    "番外1.5": "extra:1.5", "番外": None, "番外三": "extra:3", "風起": None, "第捌仟章": None, "12.5": "ch:12.5", "第3回": "ch:3", "（二】": None, "【二）": None, "〔二)": None, "【前言】": None, "（廿）": "ch:20", "（廿一）": "ch:21", "（卅二）": "ch:32",
    "第二十一章": "ch:21", "12上": None, "12 text": None, "其一": "ch:1", "附錄2": "extra:2", "": None, "序章": None, "大結局": None,
} | {k: "ch:2" for k in ("（二）", "(2)", "（２）", "(二）", "（二)", "（ 二 ）", "【二】", "【 二 】", "〔二〕", "二、", "二 、", "其二", "第二章", "第2回")}


def test_labels(spark):
    df = spark.createDataFrame([(k,) for k in KEYS] + [(None,)], "raw string")
    rows = df.select("raw", labels.parse_label("raw").alias("l")).collect()
    assert {r.raw: r.l.key for r in rows} == KEYS | {None: None} and all(r.l.raw == r.raw for r in rows)
    kinds = {r.raw: r.l.kind for r in rows}
    assert [kinds[k] for k in ("序章", "大結局", "番外", "番外三", "風起", "（二】")] == ["front", "end", "extra", "extra", "unnumbered", "unnumbered"]
    order = ["序章", "第12章", "第12.5章", "第12.9章", "第12.10章", "第13章（上）", "第13章（下）", "第87章", "第87.5章", "第88章", "終章", "閒話"]
    rows = spark.createDataFrame([(x,) for x in order[::-1]], "raw string").withColumn("l", labels.parse_label("raw"))
    assert [r.raw for r in rows.orderBy(labels.order_key(F.col("l"))).collect()] == order
    pair = spark.createDataFrame([("第012章", "（十二）"), ("第12.1章", "第12.10章"), ("風起", "風起")], "a string, b string").select(labels.same_number(labels.parse_label("a"), labels.parse_label("b")).alias("same"))
    assert [r.same for r in pair.collect()] == [True, False, False]


@pytest.mark.parametrize(
    "raw, kind, reason",
    [
        ("小龍".encode(), "utf-8", "valid"), ("小龍".encode("utf-8-sig"), "utf-8", "bom"), ("﻿ab".encode("utf-16-le"), "utf-16-le", "bom"), ("abcdef".encode("utf-16-be"), "utf-16-be", "nulls"),
        ("這個國家的學問與專業".encode("big5"), "big5", "script"), ("这个国家的学问与专业对时".encode("gb18030"), "gb18030", None), (b"\xff\x81\xff\xff", "big5", "fallback"), (b"", "utf-8", "valid"),
    ],
)
def test_encoding(raw, kind, reason):
    got = encoding.detect(raw)
    assert got["encoding"] == kind and (reason is None or got["reason"] == reason)
    assert encoding.detect("ab".encode(), "utf-16-le")["confidence"] == "high" and encoding.detect(b"\xff", "utf-8")["confidence"] == "failed"


def test_numbers_of_headings(spark):
    """The column gives what :func:`numeric_parts` gives of a number that is one part."""
    texts = ["12", "００７", "九", "十", "十二", "廿三", "卅", "百零五", "一千二百三十四", "兩百", "二三", "零", "〇〇", "零十", "十一2", "1二", "", "風", "9" * 38]
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", labels.numeral_value(F.col("t")).alias("n")).collect()}
    assert got == {t: (labels.numeric_parts(t.translate(labels._WIDE_DIGITS)) or [None])[0] for t in texts} and got["一千二百三十四"] == "1234"


def test_segmentation(spark, tmp_path):
    book = "書名：試書\n作者：某人\n\n第一卷 開始\n第一章 甲\n一\n二\n第二章 乙\n三\n第二卷 後來\n第三章 丙\n\n四。\n第三章 丙\n"
    weak = "intro\n【一】 first\naaa\n（二）一句話。\n【二】\nbbb\n【七】 far\n【三】 back\nccc\n三、四月間\n\n其五 alone"
    plain = "nothing here\nat all"
    (tmp_path / "a.txt").write_bytes(book.encode("big5"))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r.encoding, r.text) for r in encoding.decode_files(files).collect()] == [("big5", book)]
    bare = "第一章\n甲\n\n風起\n乙，\n\n丙。\n"
    df = spark.createDataFrame([("a", book), ("b", weak), ("c", plain), ("d", ""), ("e", None), ("f", bare)], "path string, text string")
    rows, got = text_files.chapters(df), {}
    for r in rows.orderBy("path", "position").collect():
        got.setdefault(r.path, []).append((r.volume_label, r.label_raw, r.title, r.body, list(r.warnings)))
    assert [x[:3] for x in got["a"]] == [(None, "", ""), ("第一卷 開始", "第一章", "甲"), ("第一卷 開始", "第二章", "乙"), ("第二卷 後來", "第三章", "丙"), ("第二卷 後來", "第三章", "丙")]
    assert got["a"][0][4] == ["leading_content_before_first_heading"] and got["a"][1][3] == "一\n\n二" and got["a"][4][4] == ["empty_chapter", "duplicate_label"]
    assert [x[1:3] for x in got["b"]] == [("", ""), ("【一】", "first"), ("【二】", ""), ("【七】", "far")] and got["b"][3][3] == "【三】 back\n\nccc\n\n三、四月間\n\n其五 alone"
    assert [x[3] for x in got["c"]] == ["nothing here\n\nat all"] and "d" not in got and "e" not in got
    assert [x[1:4] for x in got["f"]] == [("第一章", "", "甲"), ("風起", "", "乙，\n\n丙。")]
    assert {r.path: list(r.warnings) for r in text_files.book_warnings(df, rows).collect()} == {"a": [], "b": [], "c": ["no_reliable_chapter_boundaries"], "d": ["empty_source"], "e": ["empty_source"], "f": []}
    own = [(r.label_raw, r.title) for r in text_files.chapters(spark.createDataFrame([("x", "Part 1: a\nt\nPART 2\nu")], df.schema), r"(part \d+):? ?(.*)").orderBy("position").collect()]
    assert own == [("Part 1", "a"), ("PART 2", "")]
    m = df.select("path", text_files.front_matter(F.col("text")).alias("m")).where("path = 'a'").first().m
    assert (m.title, m.author, m.description) == ("試書", "某人", None)
    long = text_files.matter("\ufeff《書》 作者：甲\n簡介：一\n二\n\n三\n狀態：未完結\n標籤：#重生 #系統、【都市】\nkeywords: x,x\nnothing\n第一章\n書名：不算")
    assert long == {"title": "書", "author": "甲", "description": "一\n二\n\n三", "serial_status": "ongoing", "keywords": ["重生", "系統", "都市", "x"]}
    for bad in ("(a+)+", "a*", "(", "x" * 201):
        with pytest.raises(ValueError):
            text_files.check_pattern(bad)


def test_tidy(spark):
    """Each rule by itself, as the contract of the tidied text states it."""

    def tidy(text, **options):
        r = spark.range(1).select(text_files.tidy(F.lit(text), **options).alias("t")).first().t
        return r and (r.text, r.trimmed, r.collapsed, r.promotions, r.joined)

    assert tidy("\ufeff  甲乙 \r\n\r\n\r\n\r丙\u3000\n") == ("甲乙\n\n丙", 2, 2, 0, 0)
    assert tidy(" a \n\n\nb", trim=False, collapse=False) == (" a \n\n\nb", 0, 0, 0, 0)
    assert tidy("x\n本書由某某網整理\n http://a.example/b \n看 www.x.example 吧\nWWW.X.example\ny", promotions=True) == ("x\n看 www.x.example 吧\ny", 0, 0, 3, 0)
    assert tidy("他走了過\n去。\n又來\n\n了", join=True) == ("他走了過去。\n又來\n\n了", 0, 0, 0, 1)
    assert tidy("some words\nand more\n漢\nx", join=True) == ("some words and more漢x", 0, 0, 0, 3)
    assert tidy("第一章 起\n頭\n「說\n話\n1. 項\n作者：甲\n乙", join=True) == ("第一章 起\n頭\n「說話\n1. 項\n作者：甲\n乙", 0, 0, 0, 1)
    assert tidy("長" * 61 + "\n短\n中" + "\n" + "長" * 60, join=True)[0] == "長" * 61 + "\n短中" + "長" * 60
    assert tidy("") == ("", 0, 0, 0, 0) and tidy(None) is None
    # 200,000 lines are no more than 200,000 steps
    assert tidy("行\n" * 200_000, join=True)[4] == 199_999


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalars.slug(F.lit("Ｈello, 世界！ 第1章"))) == "hello-世界-第1章"
    assert one(scalars.slug(F.lit("a" * 30 + " " + "b" * 30))) == "a" * 30
    # beyond forty characters the last word goes, whole or not
    assert one(scalars.slug(F.lit("a" * 30 + " " + "b" * 9 + " c"))) == "a" * 30 and one(scalars.slug(F.lit("a" * 41))) == "a" * 40
    # ligatures, half-width and decomposed forms, digits in circles
    assert one(scalars.slug(F.lit("ﬁne ｶﾞ e\u0301 ①"))) == "fine-ガ-é-1" and one(scalars.filename(F.lit("e\u0301ﬁ "))) == "éﬁ"
    assert one(scalars.filename(F.lit("\u3000"))) == "ebook" and one(scalars.normalised(F.lit(None).cast("string"))) is None
    assert one(scalars.public_id(F.lit("0123abcd-0000-0000-0000-000000000000"))) == "0123abcd"
    assert list(one(scalars.keywords(F.lit("【玄幻】、仙俠，玄幻｜ a  b")))) == ["玄幻", "仙俠", "a", "b"]
    assert [one(scalars.completion_status(F.lit(x))) for x in ("未完結", "已完結", "全本", "未定")] == ["ongoing", "completed", "completed", None]
    h = "a" * 64
    body = F.lit(f"x\n\n[[img:{h}|cat]]\n\n[[img:{h}|]] no")
    assert [b.kind for b in one(scalars.blocks(body))] == ["text", "image", "text"] and one(scalars.referenced_images(body)) == [h]
    assert one(scalars.image_marker(F.lit(h), F.lit(" a]] |b "))) == f"[[img:{h}|a b]]"
    assert list(one(scalars.speech_chunks(F.lit("é😀" * 100)))) == ["é😀" * 90, "é😀" * 10] and list(one(scalars.speech_chunks(F.lit("")))) == []
    assert one(scalars.filename(F.lit('a/b:"c"'))) == "a_b__c_" and one(scalars.term_key(F.lit(" 玄 幻-A! "))) == "玄幻a"
    assert variants.variants("小龍") == ["小龍", "小龙"]
    assert one(variants.convert(F.lit("龍\n\n[[note:龍]]\n\n"), "simplified")) == "龙\n\n[[note:龍]]\n\n"
    assert [one(scalars.is_night(F.lit(h), 22, 6)) for h in (21, 22, 5, 6)] == [False, True, True, False] and one(scalars.is_night(F.lit(1), 6, 6)) is False


def test_search(spark):
    bodies = ["小龍在此\n\n又來", "空白", "a" * 200 + "小龙" + "b" * 200, "[[img:" + "a" * 64 + "|小龍]]", ""]
    df = spark.createDataFrame([(i, f"t{i}" if i != 4 else "小龍傳", b) for i, b in enumerate(bodies)], "position int, title string, body string").withColumn("body_index", search.body_index("body"))
    got = {r.position: r for r in search.search_book(df, variants.variants("小龍")).collect()}
    assert set(got) == {0, 2, 4} and got[2].snippet.startswith("…") and got[2].snippet.endswith("…")
    assert got[2].snippet[got[2].match_start :].startswith("小龙")
    for text in ("hello wörld 😀 abc", "xyz"):
        df = spark.createDataFrame([(text[i:j],) for i in range(len(text)) for j in range(i + 3, len(text) + 1)], "v string")
        parts = [r.v for r in df.distinct().collect()]
        idx = spark.createDataFrame([(text,)], "b string").select(search.body_index("b").alias("i"))
        assert all(idx.select(*[search.may_contain(F.col("i"), [p]).alias(f"c{k}") for k, p in enumerate(parts[:20])]).first())
    assert not idx.select(search.may_contain(F.col("i"), ["qqq"]).alias("x")).first().x


def test_epub(spark, tmp_path):
    works = spark.createDataFrame([(1, "A & B", "某人")], "id long, title string, author string")
    chapters = spark.createDataFrame([(1, 2, "第二章", None, "c\n\n<d>", "k2"), (1, 1, "第一章", "甲", "a\n\nb", "k1")], "work_id long, position int, label_raw string, title string, body string, body_key string")
    raw = exports.epub(works, chapters).first().content
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    (tmp_path / "b.epub").write_bytes(raw)
    (tmp_path / "x.epub").write_bytes(b"not a zip")
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../out", "x")
    (tmp_path / "y.epub").write_bytes(evil.getvalue())
    rows = epub_files.chapters(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path", "position").collect()
    assert [(r.label_raw, r.title, r.body) for r in rows if r.error is None] == [("甲", "甲", "甲\n\na\n\nb"), ("第二章", "第二章", "第二章\n\nc\n\n<d>")]
    assert sum(r.error is not None for r in rows) == 2
    assert exports.over_budget(chapters, 5).count() == 1 and exports.epub(works, chapters.limit(0)).count() == 0
    text = exports.txt(works.withColumn("version_label", F.lit("第 3 版")), chapters.withColumn("body", F.concat("body", F.lit("\n\n[[img:" + "a" * 64 + "|貓]]x[[img:" + "b" * 64 + "]] ")))).first()
    assert text.file == "A & B.txt"
    assert text.content == "\ufeff作品名：A & B\n作者：某人\n版本：第 3 版\n\n\n甲\n\na\n\nb\n\n［圖片：貓］x［圖片］\n\n\n\n第二章\n\nc\n\n<d>\n\n［圖片：貓］x［圖片］\n"


def test_epub_images(spark):
    h, g = "a" * 64, "b" * 64
    works = spark.createDataFrame([(1, "T", None, "D")], "id long, title string, author string, description string").withColumn("modified_at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    chapters = spark.createDataFrame([(1, 1, "第一章", None, f"a [[img:{h}|x<y]] b\n\n[[img:{g}|gone]]", "k1"), (2, 1, "x", "y", None, "k2")], "work_id long, position int, label_raw string, title string, body string, body_key string")
    images = spark.createDataFrame([(1, h, "image/png", b"png"), (1, g, "image/tiff", b"t"), (3, h, "image/png", b"x")], exports.NO_IMAGES)
    (book,) = exports.epub(works, chapters, images).collect()
    with zipfile.ZipFile(io.BytesIO(book.content)) as z:
        page, package = z.read("OEBPS/text/c1.xhtml").decode(), z.read("OEBPS/content.opf").decode()
        assert z.read(f"OEBPS/images/{h}.png") == b"png"
    assert f'<p>a <img src="../images/{h}.png" alt="x&lt;y" /> b</p>' in page and "［圖片：gone］" in page and "<h1>第一章</h1>" in page
    assert "2024-05-06T07:08:09Z" in package and "<dc:description>D" in package and "creator" not in package


def test_epub_pages(spark, tmp_path):
    """Labels from an NCX, notes as endnotes, list items left out, images by their first bytes, nothing from outside."""
    png = b"\x89PNG\r\n\x1a\nx"
    page = """<html><head><title>no</title></head><body><h2>Two <b>words</b></h2><p>Text<a href="#n1">*</a> goes<a href='#top'>up</a>.</p><ul><li>item</li></ul><img src="../i/a%20b.png" alt=" a|b "/><img src="http://x/y.png"/><img src="../i/s.svg"/>
<aside id="n1"><p>A <i>note</i></p><aside>in</aside></aside><div class="footnote" id="n9">not linked</div><p>End</p></body></html>"""
    opf = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="t/1.xhtml"/><item id="b" href="t/2.html"/><item id="c" href="c.css"/><item id="x" href="toc.ncx"/></manifest>
<spine toc="x"><itemref idref="a"/><itemref idref="b"/><itemref idref="a"/><itemref idref="c"/><itemref idref="b" linear="no"/><itemref idref="gone"/></spine></package>"""
    ncx = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>第三章</text></navLabel><content src="t/1.xhtml#x"/></navPoint></navMap></ncx>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        for name, data in (("p.opf", opf), ("toc.ncx", ncx), ("t/1.xhtml", page), ("t/2.html", "<p></p>"), ("c.css", ""), ("i/a b.png", png), ("i/s.svg", "<svg/>")):
            z.writestr(f"O/{name}", data)
    (tmp_path / "b.epub").write_bytes(raw.getvalue())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    one, two = epub_files.chapters(files).orderBy("position").collect()
    h = hashlib.sha256(png).hexdigest()
    assert (one.label_raw, one.label.key, one.title, list(one.images)) == ("第三章", "ch:3", "Two words", [h])
    assert one.body.split("\n\n") == ["Two words", "Text[註 1] goesup.", f"[[img:{h}|a b]]", "not linked", "End", "[註 1] A notein"]
    assert list(one.warnings) == ["unsupported_image", "footnotes_appended"] and list(two.warnings) == ["non_text_section", "no_toc_label"] and two.needs_review
    assert [(r.content_hash, r.media_type, bytes(r.bytes)) for r in epub_files.images(files).collect()] == [(h, "image/png", png)]


def test_phrases(spark):
    """Words that single characters get wrong, in both directions; markers and paragraphs stay."""
    pairs = [("皇后的頭髮乾淨", "皇后的头发干净"), ("後來發現一隻餅乾", "后来发现一只饼干"), ("乾坤與幹部", "乾坤与干部"), ("著作複雜，裡面只有麵包", "著作复杂，里面只有面包")]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    to_s, to_t = phrases.converter("simplified"), phrases.converter("traditional")
    for a, b in pairs:
        assert one(to_s(F.lit(a))) == b and one(to_t(F.lit(b))) == a
    # what characters alone make of them
    assert variants.respell("皇后的头发", variants.SIMPLIFIED, variants.TRADITIONAL) != "皇后的頭髮"
    marker = "[[img:" + "a" * 64 + "|头发]]"
    body = f"头发\n\n{marker}\n\n\n\n后来"
    assert one(to_t(F.lit(body))) == f"頭髮\n\n{marker}\n\n\n\n後來"
    assert one(to_t(F.lit(None).cast("string"))) is None
    given = spark.createDataFrame([("頭頭", "甲"), ("頭頭髮", "乙"), ("", "x"), (None, "y")], "traditional string, simplified string")
    assert one(phrases.converter("simplified", given)(F.lit("頭頭髮頭頭頭龍"))) == "乙甲头龙".replace("头", variants.respell("頭", *variants.TABLE))
    with pytest.raises(ValueError, match="line break"):
        phrases.converter("simplified", spark.createDataFrame([("a\nb", "c")], given.schema))
    with pytest.raises(ValueError, match="too large"):
        phrases.converter("simplified", spark.range(phrases.MOST_PHRASES + 1).select(F.col("id").cast("string").alias("traditional"), F.lit("x").alias("simplified")))
    assert phrases.spellings("皇后") == ["皇后"] and phrases.spellings("头发") == ["头发", "頭髮"]
