"""Feature stages as ``pyspark.ml`` Transformers / Estimators.

Fitted state (column minima, medians, category lists, ranges) is a small
dictionary whose size is bounded by the schema; it is inlined into the
transform as literals, so applying it costs no join and no shuffle.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.functions import naming
from gustframe.functions import nullsafe as ns
from gustframe.functions import scalars as sc
from gustframe.operators import positions as pos
from gustframe.operators import windows


def _p(name: str, doc: str, conv=None) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=conv) if conv else Param(Params._dummy(), name, doc)


class _Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    def _init(self, kwargs):
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def get(self, name):
        return self.getOrDefault(getattr(self, name))


# ---------------------------------------------------------------- selection stages

class SelectColumns(Transformer, _Stage):
    """Keep the listed columns in that order; a missing name raises."""
    colnames = _p("colnames", "columns to keep", TypeConverters.toListString)

    @keyword_only
    def __init__(self, colnames=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from gustframe.operators.select import select_columns
        return select_columns(df, self.get("colnames"))


class TypeSelector(Transformer, _Stage):
    """Keep the columns of one type family ('numeric', 'double', 'string', ...)."""
    dtype = _p("dtype", "type family", TypeConverters.toString)

    @keyword_only
    def __init__(self, dtype="numeric"):
        super().__init__()
        self._setDefault(dtype="numeric")
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*naming.columns_of_type(df, self.get("dtype")))


class KeepHighRegime(Transformer, _Stage):
    """Rows with speed >= cut (or the null-safe complement), decided on the
    rows being transformed."""
    keepHigh = _p("keepHigh", "keep the high part", TypeConverters.toBoolean)
    speedCol = _p("speedCol", "speed column", TypeConverters.toString)
    cut = _p("cut", "speed cut", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, keepHigh=True, speedCol="Rotor_speed", cut=ns.HIGH_CUT):
        super().__init__()
        self._setDefault(keepHigh=True, speedCol="Rotor_speed", cut=ns.HIGH_CUT)
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cond = F.col(self.get("speedCol")) >= self.get("cut")
        return df.filter(ns.holds(cond) if self.get("keepHigh") else ns.fails(cond))


class RegimeColumn(Transformer, _Stage):
    """Add the 'high'/'low' regime (cube form, NULL speed -> 'low')."""
    speedCol = _p("speedCol", "speed column", TypeConverters.toString)
    cut = _p("cut", "speed cut", TypeConverters.toFloat)
    outputCol = _p("outputCol", "output column", TypeConverters.toString)

    @keyword_only
    def __init__(self, speedCol="Rotor_speed", cut=ns.HIGH_CUT, outputCol="regime"):
        super().__init__()
        self._setDefault(speedCol="Rotor_speed", cut=ns.HIGH_CUT, outputCol="regime")
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.get("outputCol"), ns.regime2(self.get("speedCol"), self.get("cut")))


# ---------------------------------------------------------------- derived features

class Log1p10Columns(Transformer, _Stage):
    """log10(x + 1) over listed columns, ``have<col>`` non-zero flags and their OR."""
    columns = _p("columns", "columns to transform", TypeConverters.toListString)

    @keyword_only
    def __init__(self, columns=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.get("columns")
        flags = {f"have{c}": ns.keep(F.col(c) != 0) for c in cols}
        out = {f"have{c}": v.cast("int") for c, v in zip(cols, flags.values())}
        out["haveAny"] = ns.any_of(*flags.values()).cast("int")
        df = df.withColumns(out)
        return df.withColumns({c: sc.log1p10(c) for c in cols})


class AddFeatures(Estimator, _Stage):
    """Fit: column minima.  Transform: turbulence, cube, four products, the
    speed/pitch ratio, previous-minus-current lags per unit and unit flags."""
    unitCol = _p("unitCol", "unit column", TypeConverters.toString)
    orderCols = _p("orderCols", "order of the lag", TypeConverters.toListString)

    @keyword_only
    def __init__(self, unitCol="MAC_CODE", orderCols=None):
        super().__init__()
        self._setDefault(unitCol="MAC_CODE", orderCols=["Date_time", "ID"])
        self._init(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "AddFeaturesModel":
        num = naming.columns_of_type(df, "numeric")
        row = df.agg(*[F.min(c).alias(c) for c in num]).first()
        minima = {c: (float(row[c]) if row[c] is not None else None) for c in num}
        return AddFeaturesModel(minima=minima, unitCol=self.get("unitCol"), orderCols=self.get("orderCols"))


class AddFeaturesModel(Model, _Stage):
    minima = _p("minima", "fitted column minima")
    unitCol = _p("unitCol", "unit column", TypeConverters.toString)
    orderCols = _p("orderCols", "order of the lag", TypeConverters.toListString)

    @keyword_only
    def __init__(self, minima=None, unitCol="MAC_CODE", orderCols=None):
        super().__init__()
        self._setDefault(unitCol="MAC_CODE", orderCols=["Date_time", "ID"])
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        min_speed = self.get("minima").get("Rotor_speed") or 0.0
        c = F.col
        out = df.withColumns({
            "Turbulence": sc.turbulence("Rotor_speed_std", "Rotor_speed", min_speed),
            "Rotor_speed3": sc.cube("Rotor_speed"),
            "Pitch_angle_x_Rotor_speedStd": c("Pitch_angle") * c("Rotor_speed_std"),
            "Pitch_angleStd_x_Rotor_speed": c("Pitch_angle_std") * c("Rotor_speed"),
            "Generator_stator_temperatureMin_x_Pitch_angleStd":
                c("Generator_stator_temperature_min") * c("Pitch_angle_std"),
            "Pitch_angleMax_x_Pitch_angleMin": c("Pitch_angle_max") * c("Pitch_angle_min"),
            "Speed_div_Pitch": sc.safe_div("Rotor_speed", "Pitch_angle")})
        out = windows.lag_diff(out, ["Pitch_angle", "Rotor_speed3"], unit=self.get("unitCol"),
                               order=self.get("orderCols"),
                               names={"Pitch_angle": "Pitch_Before", "Rotor_speed3": "RotorS3_Before"})
        return out.withColumns(sc.unit_flags(self.get("unitCol")))


class OneHot(Estimator, _Stage):
    """0/1 INT column per category in sorted order, named ``<col>_<value>``.
    A column with more than ``maxCategories`` values is an error: every category
    becomes a column."""
    inputCols = _p("inputCols", "categorical columns", TypeConverters.toListString)
    maxCategories = _p("maxCategories", "most categories of a column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, maxCategories=10_000):
        super().__init__()
        self._setDefault(maxCategories=10_000)
        self._init(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "OneHotModel":
        cats, most = {}, self.get("maxCategories")
        for col in self.get("inputCols"):
            vals = (df.select(col).filter(F.col(col).isNotNull()).distinct()
                    .orderBy(col).limit(most + 1).collect())
            if len(vals) > most:
                raise ValueError(f"{col}: more than {most} categories")
            cats[col] = [r[0] for r in vals]
        return OneHotModel(categories=cats)


class OneHotModel(Model, _Stage):
    categories = _p("categories", "sorted categories per column")

    @keyword_only
    def __init__(self, categories=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for col, vals in self.get("categories").items():
            for v in vals:
                out[f"{col}_{v}"] = ns.keep(F.col(col) == F.lit(v)).cast("int")
        return df.withColumns(out)


class InteractionFeatures(Transformer, _Stage):
    """Degree-2 products of *distinct* columns plus the originals, named
    ``a^1`` and ``a^1xb^1`` (no squares, no bias)."""
    inputCols = _p("inputCols", "columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.get("inputCols")
        out = {f"{a}^1": F.col(a) for a in cols}
        for i, a in enumerate(cols):
            for b in cols[i + 1:]:
                out[f"{a}^1x{b}^1"] = F.col(a) * F.col(b)
        return df.withColumns(out)


class MinMaxTo(Estimator, _Stage):
    """Scale columns to [low, high] with fitted min/max; constant -> low."""
    inputCols = _p("inputCols", "columns", TypeConverters.toListString)
    low = _p("low", "low end", TypeConverters.toFloat)
    high = _p("high", "high end", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols=None, low=0.0, high=1.0):
        super().__init__()
        self._setDefault(low=0.0, high=1.0)
        self._init(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MinMaxToModel":
        cols = self.get("inputCols")
        row = df.agg(*[F.min(c).alias(f"{c}__mn") for c in cols], *[F.max(c).alias(f"{c}__mx") for c in cols]).first()
        ranges = {c: [row[f"{c}__mn"], row[f"{c}__mx"]] for c in cols}
        return MinMaxToModel(ranges=ranges, low=self.get("low"), high=self.get("high"))


class MinMaxToModel(Model, _Stage):
    ranges = _p("ranges", "fitted [min, max] per column")
    low = _p("low", "low end", TypeConverters.toFloat)
    high = _p("high", "high end", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, ranges=None, low=0.0, high=1.0):
        super().__init__()
        self._setDefault(low=0.0, high=1.0)
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        lo, hi = self.get("low"), self.get("high")
        return df.withColumns({c: sc.minmax_scale(c, float(mn), float(mx), lo, hi)
                               for c, (mn, mx) in self.get("ranges").items() if mn is not None})


#: Key of the NULL group among fitted medians.
NULL_GROUP = "\0null"


class ImputeMedian(Estimator, _Stage):
    """Fill NULLs with the exact (interpolated) median of each numeric column,
    optionally per regime (``groupCol``): the scoring rows use the medians of
    the training rows of their regime."""
    inputCols = _p("inputCols", "columns (default: numeric)", TypeConverters.toListString)
    groupCol = _p("groupCol", "regime column", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, groupCol=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ImputeMedianModel":
        cols = self.get("inputCols") if self.isSet(self.inputCols) else naming.columns_of_type(df, "numeric")
        group = self.getOrDefault(self.groupCol) if self.isSet(self.groupCol) else None
        gcols = [group] if group else []
        meds = pos.column_medians(df, cols, gcols).collect()  # columns x groups rows
        table: dict = {}
        for r in meds:
            key = "*" if not group else NULL_GROUP if r[group] is None else str(r[group])
            table.setdefault(key, {})[r["column"]] = r["median"]
        return ImputeMedianModel(medians=table, groupCol=group or "")


class ImputeMedianModel(Model, _Stage):
    medians = _p("medians", "fitted medians: {group: {column: value}}")
    groupCol = _p("groupCol", "regime column ('' = none)", TypeConverters.toString)

    @keyword_only
    def __init__(self, medians=None, groupCol=""):
        super().__init__()
        self._setDefault(groupCol="")
        self._init(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        table, group = self.get("medians"), self.get("groupCol")
        cols = sorted({c for m in table.values() for c in m})
        out = {}
        for c in cols:
            if not group:
                fill = F.lit(table.get("*", {}).get(c))
            else:
                fill = None
                for g, m in table.items():
                    branch = F.col(group).isNull() if g == NULL_GROUP else F.col(group).cast("string") == F.lit(g)
                    fill = F.when(branch, F.lit(m.get(c))) if fill is None else fill.when(branch, F.lit(m.get(c)))
            out[c] = F.coalesce(F.col(c), fill.cast(dict(df.dtypes)[c]) if fill is not None else F.col(c))
        return df.withColumns(out)
