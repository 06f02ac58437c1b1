"""TF-IDF features with MLlib stages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabulary size and least word length.
MAX_TERMS = 100
TERM = r"[\p{L}\p{N}_]{2,}"

HELPER_COLUMNS = ["_text", "_terms", "_tf", "_weighted"]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def vocabulary(df: DataFrame, text: str, size: int = MAX_TERMS) -> DataFrame:
    """The most frequent terms, ties in alphabetical order: ``(term, count)``."""
    return (
        df.select(F.explode(terms(F.col(text))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "term")
        .limit(size)
    )


def fit_tfidf(
    df: DataFrame, text: str, size: int = MAX_TERMS, output: str = "tfidf"
) -> PipelineModel:
    """TF-IDF over the ``size`` most frequent terms, smooth idf plus one, unit length.

    Only the vocabulary and the document frequencies, ``size`` values each,
    come to the driver.
    """
    listed = [row.term for row in vocabulary(df, text, size).collect()]
    filled = SQLTransformer(
        statement=f"SELECT *, coalesce(`{text}`, '') AS _text FROM __THIS__"
    )
    tokenizer = RegexTokenizer(
        inputCol="_text", outputCol="_terms", pattern=TERM, gaps=False, toLowercase=True
    )
    counter = CountVectorizerModel.from_vocabulary(
        listed or [" "], inputCol="_terms", outputCol="_tf"
    )
    counted = counter.transform(tokenizer.transform(filled.transform(df.select(text))))
    idf = IDF(inputCol="_tf", outputCol="_").fit(counted)
    weight = ElementwiseProduct(
        scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="_tf", outputCol="_weighted"
    )
    unit = Normalizer(inputCol="_weighted", outputCol=output, p=2.0)
    return PipelineModel([filled, tokenizer, counter, weight, unit])


def tfidf(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the TF-IDF vector; rows without a known term have a zero vector."""
    return model.transform(df).drop(*HELPER_COLUMNS)


def terms_of(model: PipelineModel) -> list[str]:
    """Vocabulary of a fitted model, in vector order."""
    return next(s.vocabulary for s in model.stages if isinstance(s, CountVectorizerModel))


def level_and_message(level: Column, message: Column) -> Column:
    """Text for the forest: ``LEVEL: message``."""
    return F.concat_ws(": ", level, message)
