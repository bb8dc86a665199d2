"""Interfaces of models, with offline stand-ins that give the same results everywhere."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from string import Template
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators.dense import hashing_embedder


class Embedder(Protocol):
    """Texts to unit vectors; kind is document or query, for models with different prompts."""

    def __call__(self, texts: pd.Series) -> pd.Series: ...


class Reranker(Protocol):
    def __call__(self, queries: pd.Series, texts: pd.Series) -> pd.Series: ...


class Chat(Protocol):
    def __call__(self, prompt: str) -> str | None: ...


def embed(texts: DataFrame, key: str, column: str, embedder: Callable[[], Embedder] | None = None, most_tokens: int | None = None, count: Callable[[str], int] | None = None) -> DataFrame:
    """(key, vec). embedder() runs once in each Python worker. A text over most_tokens is an error: nothing is cut silently."""
    make = embedder or (lambda: hashing_embedder())
    kind = texts.schema[key].dataType.simpleString()

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in source:
            if most_tokens and count:
                for k, t in zip(pdf[key], pdf[column]):
                    if count(t or "") > most_tokens:
                        raise ValueError(f"{k}: the text has more than {most_tokens} tokens")
            yield pd.DataFrame({key: pdf[key], "vec": model(pdf[column])})

    return texts.select(key, column).mapInPandas(run, f"{key} {kind}, vec array<float>")


def embed_missing(texts: DataFrame, known: DataFrame, key: str, column: str, **options: Any) -> DataFrame:
    """known and the vectors of texts that it hasn't."""
    fresh = texts.join(known.where(F.col("vec").isNotNull()).select(key), key, "left_anti")
    return known.where(F.col("vec").isNotNull()).select(key, "vec").unionByName(embed(fresh, key, column, **options))


def named(settings: dict, kind: str) -> dict[str, Callable]:
    """Models of a kind (embedders by provider, rerankers by '' or '_4b') from settings: names to 'module:function'."""
    import importlib

    out = {}
    for name, at in (settings.get(kind) or {}).items():
        module, function = at.split(":")
        out[name] = getattr(importlib.import_module(module), function)
    return out


def stand_ins(methods: Sequence[str], providers: Sequence[str], embedders: dict, rerankers: dict) -> list[str]:
    """What a report must say about methods whose models are stand-ins."""
    notes = [f"{p}: no embedder is set; vectors are hashed tokens, the same for every such provider" for p in providers if p not in embedders]
    for suffix in ("", "_4b"):
        used = [m for m in methods if m.removesuffix("_geo").endswith(f"_rerank{suffix}")]
        if used and suffix not in rerankers:
            notes.append(f"{', '.join(used)}: no reranker is set; candidates are ordered by their share of the query's tokens")
    return notes


def supported(model_limit: int, wanted: int) -> int:
    """The wanted length, if the model takes it."""
    if model_limit < wanted:
        raise ValueError(f"the model takes {model_limit} tokens, {wanted} are asked for")
    return wanted


def prompt(template: str, **values: Any) -> str:
    """$placeholders filled; a missing one is an error."""
    return Template(template).substitute(values)


def structured(chat: Chat, text: str, fields: Sequence[str], tries: int = 3) -> dict:
    """A JSON object with the fields. A reply that is none is answered by its error, three tries in all."""
    asked, error = text, ""
    for _ in range(tries):
        reply = chat(asked)
        try:
            if reply is None:
                raise ValueError("no reply")
            found = json.loads(reply)
            if isinstance(found, list):
                found = {"items": found}
            if lacking := [f for f in fields if f not in found]:
                raise ValueError(f"missing {', '.join(lacking)}")
            return found
        except ValueError as e:
            error = str(e)
            asked = f"{text}\n\nThe last reply failed: {error}. Give one JSON object with: {', '.join(fields)}."
    raise RuntimeError(f"no usable reply in {tries} tries: {error}")


def structured_all(rows: DataFrame, key: str, column: str, chat: Callable[[], Chat], fields: Sequence[str], tries: int = 3) -> DataFrame:
    """(key, reply JSON text, error): a model over a table; rows that fail carry their error."""
    kind = rows.schema[key].dataType.simpleString()

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = chat()
        for pdf in source:
            out = []
            for k, text in zip(pdf[key], pdf[column]):
                try:
                    out.append((k, json.dumps(structured(model, text, fields, tries), ensure_ascii=False), None))
                except RuntimeError as e:
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "reply", "error"])

    return rows.select(key, column).mapInPandas(run, f"{key} {kind}, reply string, error string")


def keywords(value: Any) -> str:
    """A reply's keywords as text, also where the model gave a list."""
    return " ".join(map(str, value)) if isinstance(value, list) else str(value or "")
