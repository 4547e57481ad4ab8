"""Feature synthesis and table encoding as stages of Spark ML pipelines."""

from __future__ import annotations

from relfeat.ml.encoders import DateEncoder, DatetimeEncoder, DurationEncoder, EnumOrdinalEncoder, OneHotColumns, TableEncoder, TfIdfSvdEncoder, TimeEncoder
from relfeat.ml.selection import DFSSelector, TopVarianceSelector, UnivariateSelector
from relfeat.ml.transformer import DFSTransformer

__all__ = ["DFSSelector", "DFSTransformer", "DateEncoder", "DatetimeEncoder", "DurationEncoder", "EnumOrdinalEncoder", "OneHotColumns", "TableEncoder", "TfIdfSvdEncoder", "TimeEncoder", "TopVarianceSelector", "UnivariateSelector"]
