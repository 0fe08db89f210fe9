"""The TF-IDF vectoriser as Spark ML stages, so that it can be stored with a classifier as one pipeline model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reviewloom.operators.features import BROADCAST_TERMS, TfidfSettings, fit_vocabulary, tfidf_vectors
from reviewloom.sinks.tables import load_vocabulary
from reviewloom.storage import materialise

DEFAULTS = TfidfSettings()


def to_vectors(rows: DataFrame, size: int, output_col: str) -> DataFrame:
    """Replace (indices, values) by a Spark ML sparse vector of ``size``."""
    kept = [f for f in rows.schema.fields if f.name not in ("indices", "values")]
    schema = T.StructType([*kept, T.StructField(output_col, VectorUDT())])

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            indices, values = (batch.column(batch.schema.get_field_index(c)) for c in ("indices", "values"))
            vector = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), indices, values], names=["type", "size", "indices", "values"]
            )
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, vector], names=[*[f.name for f in kept], output_col])

    return rows.mapInArrow(work, schema)


class _VectorizerParams(HasInputCol, HasOutputCol):
    maxFeatures = Param(Params._dummy(), "maxFeatures", "most terms kept", TypeConverters.toInt)
    minDf = Param(Params._dummy(), "minDf", "fewest documents of a term", TypeConverters.toInt)
    maxDf = Param(Params._dummy(), "maxDf", "largest share of the documents of a term", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(
            inputCol="text_clean_classical", outputCol="features", maxFeatures=DEFAULTS.max_features, minDf=DEFAULTS.min_df, maxDf=DEFAULTS.max_df
        )


class TermVectorizer(Estimator, _VectorizerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the vocabulary of ``inputCol``; the model adds a sparse vector column."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, maxFeatures=None, minDf=None, maxDf=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TermVectorizerModel:
        column = self.getInputCol()
        settings = TfidfSettings(self.getOrDefault("maxFeatures"), self.getOrDefault("minDf"), self.getOrDefault("maxDf"))
        vocabulary = materialise(fit_vocabulary(dataset, column, column, settings), "vocabulary")
        model = TermVectorizerModel()._with_vocabulary(vocabulary)
        return self._copyValues(model)


class TermVectorizerModel(Model, _VectorizerParams, MLReadable, MLWritable):
    """A frozen vocabulary; unseen terms are dropped, a text without known terms is the zero vector."""

    def __init__(self):
        super().__init__()
        self.vocabulary: DataFrame | None = None
        self.size = 0

    def _with_vocabulary(self, vocabulary: DataFrame) -> TermVectorizerModel:
        self.vocabulary, self.size = vocabulary, vocabulary.count()
        return self

    def _transform(self, dataset: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
        columns = dataset.columns
        rows = tfidf_vectors(dataset, self.vocabulary, columns[0], self.getInputCol(), columns[1:], broadcast_terms)
        return to_vectors(rows, self.size, self.getOutputCol())

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: TermVectorizerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.vocabulary.write.parquet(f"{path}/vocabulary")


class _ModelReader(MLReader):
    def __init__(self, kind: type[TermVectorizerModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> TermVectorizerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._with_vocabulary(load_vocabulary(self.sparkSession, f"{path}/vocabulary"))
