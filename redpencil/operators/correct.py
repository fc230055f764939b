"""Batch correction of sentences with a user-supplied model function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from redpencil.functions.prompts import inference_prompt
from redpencil.functions.text import or_source


def generate(df: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt",
             name: str = "response") -> DataFrame:
    """Add model responses. ``load`` runs once per partition and returns the batch function."""
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield frame.assign(**{name: model(frame[prompt].tolist())})
    return df.mapInPandas(run, schema)


def correct(df: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]],
            cleaner: Callable[[Column], Column], prompt: Callable[[Column], Column] = inference_prompt,
            source: str = "text") -> DataFrame:
    """Prompt, generate, clean, and fall back to the input where nothing was extracted."""
    asked = df.withColumn("prompt", prompt(F.col(source)))
    answered = generate(asked, load)
    return answered.select(*df.columns, or_source(cleaner(F.col("response")), F.col(source)).alias("corrected"))
