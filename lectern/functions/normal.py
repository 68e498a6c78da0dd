"""Unicode normalisation. Plain ASCII is normal in all forms and stays in Spark; only other texts go to Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII = r"^[\x00-\x7F]*\z"


def _form(form: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run


def normalised(text: Column, form: str = "NFC") -> Column:
    """``text`` in NFC or NFKC; null stays null. A row of ASCII is a null in the Arrow batches."""
    plain = text.rlike(ASCII)
    return F.when(plain, text).otherwise(_form(form)(F.when(~plain, text)))
