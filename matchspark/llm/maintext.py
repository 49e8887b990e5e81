"""Main text of web pages by the tree model: runs of text whose marginal says content.

Null and empty pages have an empty text. White space inside a block becomes one blank, blocks are
joined by a line break in page order; nothing is cut. Ties at one half count as content. Repeated
pages give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchspark.llm.common import slices, texts_of
from matchspark.llm.domtree import parse
from matchspark.llm.labelledpages import labelled_pages
from matchspark.llm.treemodel import TreeModel, forest, train

PAGE_BYTES = 1 << 20


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    """Trained from the labelled pages of this folder."""
    return train([parse(p) for p in labelled_pages()])


def texts_of_pages(html: list[str], model: TreeModel) -> list[str]:
    pages = [parse(h) for h in html]
    if not pages:
        return []
    f = forest(pages)
    content = model.marginals(f)[0] >= 0.5
    out: list[list[str]] = [[] for _ in pages]
    texts = [t for p in pages for t in p.text]
    for i in np.flatnonzero(content).tolist():
        if texts[i]:
            out[f.page[i]].append(texts[i])
    return ["\n".join(t) for t in out]


def main_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",),
              model: TreeModel | None = None) -> DataFrame:
    """(``id_col``, ``keep``..., text) of every page."""
    model = model or default_model()
    names = [id_col, *keep]
    source = pages.select(*[F.col(c) for c in names], F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, PAGE_BYTES):
                texts = texts_of_pages(texts_of(part, len(names)), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*names, "text"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{kinds}, text string")
