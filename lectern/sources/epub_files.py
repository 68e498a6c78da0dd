"""Chapters and images from EPUB files.

A worker unpacks one archive at a time into the texts of its spine, within the
limits below; labels, checks and merging are Spark's work afterwards.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.labels import parse_label

MOST_ENTRIES, MOST_RATIO, MOST_TOTAL, MOST_ENTRY, MOST_IMAGE = 5_000, 100, 250 << 20, 50 << 20, 10 << 20
#: Images of a book, and their bytes together.
MOST_IMAGES, MOST_IMAGE_BYTES = 2_000, 150 << 20
RASTER = {b"\x89PNG\r\n\x1a\n": "image/png", b"\xff\xd8\xff": "image/jpeg", b"GIF8": "image/gif", b"RIFF": "image/webp"}
SCHEMA = "path string, position int, href string, label_raw string, title string, body string, images array<string>, warnings array<string>, needs_review boolean, error string"
UNSEEN = {"script", "style", "head"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "section", "tr", "aside"}
PAGES = (".xhtml", ".html", ".htm")
LINKED = re.compile(r"""<a\b[^>]*?\shref\s*=\s*["']#([^"']+)["']""", re.I)


def check(z: zipfile.ZipFile) -> None:
    """Refuses archives that are too large, too dense, or lead outside."""
    infos = z.infolist()
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_TOTAL:
        raise ValueError("archive_too_large")
    for i in infos:
        if i.file_size > MOST_ENTRY or i.file_size > MOST_RATIO * max(1, i.compress_size):
            raise ValueError("entry_too_large")
        if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[\\/]", i.filename):
            raise ValueError("entry_outside")


def _is_note(tag: str, a: dict, linked: set) -> bool:
    """An aside, or an element classed as a note, that something in the page links to."""
    return a.get("id") in linked and (tag == "aside" or "note" in (a.get("class") or ""))


class Notes(HTMLParser):
    """The texts of a page's notes by id, in order."""

    def __init__(self, linked: set):
        super().__init__()
        self.linked, self.texts, self.open = linked, {}, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.open is None and _is_note(tag, a, self.linked):
            self.open = [tag, 1, a["id"], []]
        elif self.open and tag == self.open[0]:
            self.open[1] += 1

    def handle_endtag(self, tag):
        if self.open and tag == self.open[0]:
            self.open[1] -= 1
            if not self.open[1]:
                text = " ".join("".join(self.open[3]).split())
                if text:
                    self.texts.setdefault(self.open[2], text)
                self.open = None

    def handle_data(self, data):
        if self.open:
            self.open[3].append(data)


class Text(HTMLParser):
    """Paragraphs of a page; an image is a paragraph by itself, list items and notes are left out, and a link to a note becomes its number."""

    def __init__(self, image, linked: set, notes: dict):
        super().__init__()
        self.image, self.linked, self.numbers = image, linked, {k: n for n, k in enumerate(notes, 1)}
        self.out, self.now, self.title, self.heading = [], [], "", None
        self.skip, self.items, self.note, self.link = 0, 0, None, False

    def end_block(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        if text and not self.items:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.note:
            self.note[1] += tag == self.note[0]
            return
        if tag in UNSEEN:
            self.skip += 1
        if tag in BLOCKS:
            self.end_block()
        if _is_note(tag, a, self.linked) and a["id"] in self.numbers:
            self.note = [tag, 1]
            return
        if tag == "li":
            self.items += 1
        if tag == "br":
            self.now.append(" ")
        href = a.get("href") or ""
        if tag == "a" and href[:1] == "#" and href[1:] in self.numbers:
            self.now.append(f"[註 {self.numbers[href[1:]]}]")
            self.link = True
        if tag in ("img", "image"):
            marker = self.image(a.get("src") or a.get("xlink:href") or a.get("href") or "", a.get("alt") or "")
            if marker:
                self.end_block()
                self.out.append(marker)
        if tag in ("h1", "h2", "h3") and not self.title:
            self.heading = []

    def handle_endtag(self, tag):
        if self.note:
            self.note[1] -= tag == self.note[0]
            if not self.note[1]:
                self.note = None
            return
        if tag in UNSEEN:
            self.skip = max(0, self.skip - 1)
        if tag == "a":
            self.link = False
        if tag in BLOCKS:
            self.end_block()
        if tag == "li":
            self.items = max(0, self.items - 1)
        if tag in ("h1", "h2", "h3") and self.heading is not None:
            self.title, self.heading = " ".join("".join(self.heading).split()), None

    def handle_data(self, data):
        if not (self.skip or self.note or self.link):
            self.now.append(data)
            if self.heading is not None:
                self.heading.append(data)


class Links(HTMLParser):
    """Where the lists of a navigation page lead, and what they call it."""

    def __init__(self):
        super().__init__()
        self.found, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = [dict(attrs).get("href") or "", []]

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.found.append((self.open[0], " ".join("".join(self.open[1]).split())))
            self.open = None

    def handle_data(self, data):
        if self.open:
            self.open[1].append(data)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _at(folder: str, href: str) -> str:
    """A reference as the archive's name for it, without its fragment."""
    return posixpath.normpath(posixpath.join(folder, unquote(href.partition("#")[0]))).lstrip("/")


class Book:
    """An opened archive: its reading order, what its table of contents calls the pages, and its images."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        check(self.zip)
        container = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        self.package, self.base, self.names = ElementTree.fromstring(self.zip.read(opf)), posixpath.dirname(opf), set(self.zip.namelist())
        self.items = {e.get("id"): e for e in self.package.iter() if _local(e.tag) == "item"}
        self.images: dict[str, tuple[str, bytes]] = {}
        self.navs = {i for i, e in self.items.items() if "nav" in (e.get("properties") or "").split()}

    def labels(self) -> dict[str, str]:
        """By page: the navigation document's first name for it, or the NCX's where there is none."""
        out: dict[str, str] = {}
        if self.navs:
            name = _at(self.base, self.items[min(self.navs)].get("href") or "")
            if name in self.names:
                links = Links()
                links.feed(self.zip.read(name).decode("utf-8", "replace"))
                for href, text in links.found:
                    if href and text:
                        out.setdefault(_at(posixpath.dirname(name), href), text)
            return out
        spine = next((e for e in self.package.iter() if _local(e.tag) == "spine"), None)
        ncx = self.items.get(spine.get("toc")) if spine is not None else None
        name = _at(self.base, ncx.get("href") or "") if ncx is not None else ""
        if name in self.names:
            for point in ElementTree.fromstring(self.zip.read(name)).iter():
                if _local(point.tag) == "navPoint":
                    text = next(("".join(e.itertext()).strip() for e in point.iter() if _local(e.tag) == "navLabel"), "")
                    href = next((e.get("src") for e in point if _local(e.tag) == "content"), None)
                    if href and text:
                        out.setdefault(_at(posixpath.dirname(name), href), text)
        return out

    def image(self, folder: str, src: str, warnings: list[str]) -> str | None:
        """The hash of an image in the archive, once read, typed by its first bytes and counted."""
        if not src or re.match(r"[a-z][a-z0-9+.-]*:|//", src, re.I):
            return None  # nothing outside the book is loaded
        name = _at(folder, src)
        if name not in self.names:
            warnings.append("missing_image")
            return None
        data = self.zip.read(name)
        kind = next((k for magic, k in RASTER.items() if data.startswith(magic)), None)
        digest = hashlib.sha256(data).hexdigest()
        if digest in self.images:
            return digest
        if kind is None or len(data) > MOST_IMAGE:
            warnings.append("unsupported_image" if kind is None else "image_too_large")
            return None
        if len(self.images) >= MOST_IMAGES or sum(len(d) for _, d in self.images.values()) + len(data) > MOST_IMAGE_BYTES:
            warnings.append("too_many_images")
            return None
        self.images[digest] = (kind, data)
        return digest

    def pages(self) -> Iterator[dict]:
        """The spine's pages in order; the navigation and non-linear ones not at all, one listed twice once."""
        labels, seen = self.labels(), set()
        for ref in (e for e in self.package.iter() if _local(e.tag) == "itemref"):
            item = self.items.get(ref.get("idref"))
            if item is None or ref.get("idref") in self.navs or ref.get("linear") == "no":
                continue
            name = _at(self.base, item.get("href") or "")
            if name in seen or name not in self.names or not name.lower().endswith(PAGES):
                continue
            seen.add(name)
            yield self.page(name, labels.get(name, ""), len(seen) - 1)

    def page(self, name: str, label: str, position: int) -> dict:
        raw = self.zip.read(name).decode("utf-8", "replace")
        linked, warnings, images = set(LINKED.findall(raw)), [], []
        notes = Notes(linked)
        if linked:
            notes.feed(raw)

        def image(src, alt):
            digest = self.image(posixpath.dirname(name), src, warnings)
            if digest is None:
                return None
            images.append(digest)
            return f"[[img:{digest}|{' '.join(re.sub(r'[|]|[][]', ' ', alt).split())[:300]}]]"

        text = Text(image, linked, notes.texts)
        text.feed(raw)
        text.close()
        text.end_block()
        body = text.out + [f"[註 {n}] {t}" for n, t in enumerate(notes.texts.values(), 1)]
        for warning, holds in (("non_text_section", not body), ("no_toc_label", not label), ("footnotes_appended", notes.texts)):
            if holds:
                warnings.append(warning)
        return {"position": position, "href": name, "label_raw": label, "title": text.title or label, "body": "\n\n".join(body), "images": list(dict.fromkeys(images)), "warnings": list(dict.fromkeys(warnings)), "needs_review": not body, "error": None}


BROKEN = (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError)


#: Rows, and bytes of their largest column, that are handed on together.
ROWS, BYTES = 2_000, 4 << 20


def _each(files: DataFrame, run, schema: str, large: str) -> DataFrame:
    """The rows that ``run`` makes of each file's path and content; books are small, so that many are handed on together."""
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def every(batches: Iterator[pa.RecordBatch]):
        rows, held = [], 0
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):
                for row in run(path.as_py(), content.as_py()):
                    rows.append(row)
                    held += len(row[large] or "")
                    if len(rows) >= ROWS or held >= BYTES:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)

    return files.select("path", "content").mapInArrow(every, schema)


def images(files: DataFrame) -> DataFrame:
    """``path, content_hash, media_type, bytes`` of the images that the pages of ``files`` show, each once a book; none of a broken file."""

    def run(path: str, content: bytes) -> Iterator[dict]:
        try:
            book = Book(content)
            for _ in book.pages():
                pass
        except BROKEN:
            return
        for digest, (kind, data) in book.images.items():
            yield {"path": path, "content_hash": digest, "media_type": kind, "bytes": data}

    return _each(files, run, "path string, content_hash string, media_type string, bytes binary", "bytes")


def chapters(files: DataFrame) -> DataFrame:
    """Chapters of ``files`` (read by the binaryFile source); a broken file, or one without pages, is one row with its error.

    Labels come from the table of contents, titles from the first heading or
    else the label. Notes follow the text, numbered, and links to them show the
    number.
    """

    def run(path: str, content: bytes) -> Iterator[dict]:
        try:
            rows = list(Book(content).pages())
            if not rows:
                raise ValueError("no_spine")
        except BROKEN as e:
            rows = [dict.fromkeys(names) | {"position": 0, "images": [], "warnings": [], "error": str(e) or type(e).__name__}]
        for r in rows:
            yield r | {"path": path}

    names = [f.name for f in T.StructType.fromDDL(SCHEMA).fields]
    return _each(files, run, SCHEMA, "body").withColumn("label", F.when(F.col("label_raw") != "", parse_label("label_raw")))
