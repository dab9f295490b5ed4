"""Places for a caller's own model: annotators and embedders on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MODELS: dict[str, object] = {}


def load_once(name: str, loader: Callable[[], object]) -> object:
    """The model of this Python worker, loaded on first use."""
    if name not in _MODELS:
        _MODELS[name] = loader()
    return _MODELS[name]


def annotate_with(
    df: DataFrame,
    loader: Callable[[], object],
    fn: Callable[[object, pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
    name: str = "annotator",
    batch_rows: int = 512,
) -> DataFrame:
    """Run ``fn(model, batch)`` over batches of rows; the model loads once per worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_once(name, loader)
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                yield fn(model, batch.iloc[at : at + batch_rows])

    return df.mapInPandas(run, schema)


def safe_apply(
    df: DataFrame,
    loader: Callable[[], object],
    fn: Callable[[object, str], dict],
    key: str,
    text: str,
    fields: dict[str, str],
    name: str = "row-annotator",
) -> DataFrame:
    """Run ``fn(model, text)`` per row; a row that fails gets nulls and the others go on."""
    schema = StructType().add(df.schema[key])
    for field, kind in fields.items():
        schema = schema.add(field, kind)

    def one(model: object, value: str) -> dict:
        try:
            return fn(model, value)
        except Exception:
            return dict.fromkeys(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_once(name, loader)
        for batch in batches:
            found = pd.DataFrame([one(model, v) for v in batch[text]], columns=list(fields))
            found.insert(0, key, batch[key].to_numpy())
            yield found

    return df.select(key, text).mapInPandas(run, schema)


def embed_with(
    loader: Callable[[], object],
    fn: Callable[[object, pd.Series], pd.Series],
    name: str = "embedder",
    batch_rows: int = 128,
) -> Callable[[Column], Column]:
    """A column function text -> ``array<float>`` around a caller's encoder."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_once(name, loader)
        for batch in batches:
            parts = [
                fn(model, batch.iloc[at : at + batch_rows])
                for at in range(0, len(batch), batch_rows)
            ]
            yield pd.concat(parts) if parts else pd.Series([], dtype=object)

    return run
