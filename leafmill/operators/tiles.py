"""Rendering as a table: one PNG for each page or tile, each tile its own row and so its own task's work."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from leafmill.sources.reader import per_document


def render_tiles(files: DataFrame, scale: float = 1.0, tile: int | None = None, fast: bool = False, pages: set[int] | None = None, password: bytes = b"") -> DataFrame:
    """doc_id, page_index, x, y, w, h, png, error. Without `tile` a page is one picture."""

    def rows(doc, row):
        from leafmill.operators.render import png, render_page

        for i, ref in enumerate(doc.pages()):
            if pages is not None and i not in pages:
                continue
            if tile is None:
                px = render_page(doc, ref, scale, None, fast)
                yield i, 0, 0, px.shape[1], px.shape[0], png(px)
                continue
            w, h = (math.ceil(v * scale - 1e-9) for v in doc.size(ref))
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    px = render_page(doc, ref, scale, (x, y, min(tile, w - x), min(tile, h - y)), fast)
                    yield i, x, y, px.shape[1], px.shape[0], png(px)

    return per_document(files, "page_index int, x int, y int, w int, h int, png binary", rows, password)
