"""Verdicts out of model output that may stop anywhere: the leading complete objects of the first array, in sequence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "n int, complete boolean, optionsClean boolean, modelAnswer string, keyVerdict string, explanationMatches boolean, issues array<string>"


def leading(output: str | None, count: int) -> list[tuple]:
    """Well-formed verdicts numbered 1, 2, ... up to the first that is not; the JSON decoder itself says where an object ends."""
    text, out, decoder = output or "", [], json.JSONDecoder()
    at = text.find("[") + 1
    while at and len(out) < count:
        at = next((i for i in range(at, len(text)) if text[i] not in " \t\r\n,"), len(text))
        try:
            v, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        fine = isinstance(v, dict) and v.get("n") == len(out) + 1 and isinstance(v.get("complete"), bool) and isinstance(v.get("optionsClean"), bool) and v.get("keyVerdict") in ("correct", "wrong", "unsure")
        if not fine:
            break
        answer, matches, issues = v.get("modelAnswer"), v.get("explanationMatches"), v.get("issues")
        out.append((v["n"], v["complete"], v["optionsClean"], answer if answer in ("A", "B", "C", "D") else None, v["keyVerdict"], matches if isinstance(matches, bool) else None, [str(x) for x in issues] if isinstance(issues, list) else []))
    return out


def read(outputs: DataFrame, key: str, output: str, count: int) -> DataFrame:
    """(key, n, verdict fields): a row a verdict; outputs without a readable verdict have none, so an anti-join finds what to ask again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *v) for k, o in zip(b["k"], b["o"], strict=True) for v in leading(o, count)]
            yield pd.DataFrame(rows, columns=["k", *[c.split()[0] for c in ROWS.split(", ")]])

    kind = outputs.schema[key].dataType.simpleString()
    return outputs.select(F.col(key).alias("k"), F.col(output).alias("o")).mapInPandas(run, f"k {kind}, {ROWS}").withColumnRenamed("k", key)
