"""Arrow functions for what no built-in expresses; modules compile their patterns once per worker."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from newsloom.functions.urls import canonicalize_url


@F.pandas_udf("string")
def canonical_url(url: pd.Series) -> pd.Series:
    return url.map(canonicalize_url, na_action="ignore")
