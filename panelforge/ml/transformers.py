"""Column-wise Spark ML stages with exact quantiles, fitted as distributed jobs.

Fitted values are params (a few numbers per column), so stages save and load with
the standard Spark ML writers and transform with plain column expressions.
"""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import clip
from ..functions.normal import with_inverse_normal
from ..operators.ordered import exact_quantiles

INDICATOR = "__missing"


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Shared: parallel lists of input and output columns."""

    def pairs(self) -> list[tuple[int, str, str]]:
        return [(i, a, b) for i, (a, b) in enumerate(zip(self.getInputCols(), self.getOutputCols()))]


class _Medians(_Columns):
    medians = Param(Params._dummy(), "medians", "fill value per input column", TypeConverters.toListFloat)
    indicators = Param(Params._dummy(), "indicators", "also add a 0/1 missing flag per column", TypeConverters.toBoolean)


class MedianImputer(Estimator, _Medians):
    """Fill missing values with exact training medians; all-missing columns with 0.0."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, indicators: bool = False):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(indicators=False)

    def _fit(self, dataset: DataFrame) -> "MedianImputerModel":
        names = self.getInputCols()
        rows = exact_quantiles(dataset, names, [0.5]).collect()
        found = {r["feature"]: r["quantile"] for r in rows}
        model = MedianImputerModel()
        model._set(
            inputCols=names,
            outputCols=self.getOutputCols(),
            medians=[float(found.get(c, 0.0)) for c in names],
            indicators=self.getOrDefault(self.indicators),
        )
        return model


class MedianImputerModel(Model, _Medians):
    def __init__(self) -> None:
        super().__init__()
        self._setDefault(indicators=False)

    def indicator_columns(self) -> list[str]:
        return [c + INDICATOR for c in self.getInputCols()]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fill = self.getOrDefault(self.medians)
        added: dict[str, Column] = {
            out: F.coalesce(F.col(c).cast("double"), F.lit(fill[i])) for i, c, out in self.pairs()
        }
        if self.getOrDefault(self.indicators):
            added |= {c + INDICATOR: F.col(c).isNull().cast("double") for c in self.getInputCols()}
        return dataset.withColumns(added)


class _Bounds(_Columns):
    lower = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)
    lows = Param(Params._dummy(), "lows", "fitted lower bounds", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "fitted upper bounds", TypeConverters.toListFloat)


class Winsorizer(Estimator, _Bounds):
    """Clip to training quantiles; missing stays missing."""

    @keyword_only
    def __init__(
        self,
        *,
        inputCols: list[str] | None = None,
        outputCols: list[str] | None = None,
        lower: float = 0.01,
        upper: float = 0.99,
    ):
        super().__init__()
        self._setDefault(lower=0.01, upper=0.99)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "WinsorizerModel":
        names = self.getInputCols()
        low, high = self.getOrDefault(self.lower), self.getOrDefault(self.upper)
        rows = exact_quantiles(dataset, names, sorted({low, high})).collect()
        found = {(r["feature"], r["prob"]): r["quantile"] for r in rows}
        model = WinsorizerModel()
        model._set(
            inputCols=names,
            outputCols=self.getOutputCols(),
            lows=[float(found.get((c, low), "-inf")) for c in names],
            highs=[float(found.get((c, high), "inf")) for c in names],
        )
        return model


class WinsorizerModel(Model, _Bounds):
    def __init__(self) -> None:
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        lows, highs = self.getOrDefault(self.lows), self.getOrDefault(self.highs)
        return dataset.withColumns(
            {out: clip(F.col(c).cast("double"), lows[i], highs[i]) for i, c, out in self.pairs()}
        )


class _Knots(_Columns):
    quantiles = Param(Params._dummy(), "quantiles", "most knots per column", TypeConverters.toInt)
    knots = Param(Params._dummy(), "knots", "fitted knots, column after column", TypeConverters.toListFloat)
    sizes = Param(Params._dummy(), "sizes", "knots per column", TypeConverters.toListInt)


class QuantileNormalizer(Estimator, _Knots):
    """Map each column to a normal distribution through its empirical quantiles."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, quantiles: int = 500):
        super().__init__()
        self._setDefault(quantiles=500)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "QuantileNormalizerModel":
        names = self.getInputCols()
        n = max(2, min(self.getOrDefault(self.quantiles), dataset.count()))
        rows = exact_quantiles(dataset, names, [i / (n - 1) for i in range(n)]).collect()
        by_column: dict[str, list[tuple[float, float]]] = {c: [] for c in names}
        for r in rows:
            by_column[r["feature"]].append((r["prob"], r["quantile"]))
        knots = {c: [q for _, q in sorted(found)] or [0.0, 0.0] for c, found in by_column.items()}
        model = QuantileNormalizerModel()
        model._set(
            inputCols=names,
            outputCols=self.getOutputCols(),
            knots=[q for c in names for q in knots[c]],
            sizes=[len(knots[c]) for c in names],
        )
        return model


def _doubles(values: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{v!r}D' for v in values)})")


class QuantileNormalizerModel(Model, _Knots):
    """Linear between knots; the outermost knots and beyond map to the clipped tails.

    A value that fills several knots gets the middle of their probabilities.
    """

    MARGIN = 1e-7

    def __init__(self) -> None:
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes, flat = self.getOrDefault(self.sizes), self.getOrDefault(self.knots)
        starts = [sum(sizes[:i]) for i in range(len(sizes))]
        columns = [flat[s : s + n] for s, n in zip(starts, sizes)]
        distinct = [sorted(set(k)) for k in columns]
        places = [f"_place_{i}" for i in range(len(columns))]
        lookup = Bucketizer(
            splitsArray=[[float("-inf"), *d, float("inf")] for d in distinct],
            inputCols=[f"_x_{i}" for i in range(len(columns))],
            outputCols=places,
            handleInvalid="keep",
        )
        made = dataset.withColumns({f"_x_{i}": F.col(c).cast("double") for i, c, _ in self.pairs()})
        placed = lookup.transform(made)
        added = {}
        for i, _, out in self.pairs():
            top = len(columns[i]) - 1
            first, last = {}, {}
            for rank, k in enumerate(columns[i]):
                first.setdefault(k, rank / top)
                last[k] = rank / top
            knots = distinct[i]
            x, place = F.col(f"_x_{i}"), F.col(places[i]).cast("int")
            at, begin, end = _doubles(knots), _doubles([first[k] for k in knots]), _doubles([last[k] for k in knots])
            low, high = F.get(at, place - 1), F.get(at, place)
            between = F.get(end, place - 1) + F.try_divide(x - low, high - low) * (
                F.get(begin, place) - F.get(end, place - 1)
            )
            on_knot = (F.get(begin, place - 1) + F.get(end, place - 1)) / 2
            share = (
                F.when(x < knots[0] + self.MARGIN, 0.0)
                .when(x > knots[-1] - self.MARGIN, 1.0)
                .when(x == low, on_knot)
                .otherwise(between)
            )
            added[out] = F.when(x.isNotNull(), share)
        shares = placed.withColumns(added).drop(*places, *[f"_x_{i}" for i in range(len(columns))])
        return with_inverse_normal(shares, list(added), self.MARGIN)
