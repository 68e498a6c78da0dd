"""Which encoding a text file is in."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.variants import SIMPLIFIED, TRADITIONAL

DECODED = T.StructType([T.StructField(n, T.StringType()) for n in ("encoding", "confidence", "reason", "text")])
KNOWN = ("utf-8", "utf-16-le", "utf-16-be", "big5", "gb18030")
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
SAMPLE = 5_000
NULLS = 0.3


def _strict(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def _result(encoding, confidence, reason, text) -> dict:
    return {"encoding": encoding, "confidence": confidence, "reason": reason, "text": text.removeprefix("﻿") if text is not None else None}


def detect(raw: bytes, requested: str | None = None) -> dict:
    """A requested encoding must fit; else marks, UTF-8, the share of nulls, and last the script decide."""
    if requested:
        text = _strict(raw, requested) if requested in KNOWN else None
        return _result(requested, "high" if text is not None else "failed", "requested", text)
    for bom, encoding in BOMS:
        if raw.startswith(bom):
            text = _strict(raw[len(bom) :], encoding)
            if text is not None:
                return _result(encoding, "high", "bom", text)
    text = _strict(raw, "utf-8")
    if text is not None and "\0" not in text:
        return _result("utf-8", "high", "valid", text)
    if raw and raw.count(0) / len(raw) > NULLS:
        encoding = "utf-16-le" if raw[1::2].count(0) >= raw[::2].count(0) else "utf-16-be"
        text = _strict(raw, encoding)
        if text is not None:
            return _result(encoding, "medium", "nulls", text)
    found = {e: t for e in ("big5", "gb18030") if (t := _strict(raw, e)) is not None}
    if len(found) == 1:
        encoding, text = next(iter(found.items()))
        return _result(encoding, "medium", "only_valid", text)
    if found:
        score = {"big5": sum(c in TRADITIONAL for c in found["big5"][:SAMPLE]), "gb18030": sum(c in SIMPLIFIED for c in found["gb18030"][:SAMPLE])}
        for one, other in (("big5", "gb18030"), ("gb18030", "big5")):
            if score[one] > 2 * score[other]:
                return _result(one, "medium", "script", found[one])
        return _result("big5", "low", "script", found["big5"])
    return _result("big5", "low", "fallback", raw.decode("big5", "replace"))


def decode_files(files: DataFrame, requested: str | None = None) -> DataFrame:
    """``files`` as read by the binaryFile source, with ``decoded``; one file at a time is in a worker's memory."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            yield pd.concat([b[["path"]].reset_index(drop=True), pd.DataFrame([detect(bytes(c or b""), requested) for c in b["content"]], columns=[f.name for f in DECODED.fields])], axis=1)

    return files.select("path", "content").mapInPandas(run, T.StructType([T.StructField("path", T.StringType()), *DECODED.fields]))
