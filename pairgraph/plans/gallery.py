"""Contact sheets of failures: one PNG for each, and an index. Equal inputs give equal bytes.

Sheets are rendered where the pixels are, one failure an Arrow row group; only finished PNG bytes, one failure at
a time, reach the driver.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgraph.functions import kernels as k
from pairgraph.functions.text import clipped_label
from pairgraph.sources.sinks import write_json

COLORS = {"reference": (40, 120, 40), "merge": (180, 40, 40), "split": (40, 60, 180)}


def thumbnail(gray: np.ndarray, side: int = 96) -> np.ndarray:
    """The image shrunk into a square of gray ground."""
    small = k.shrink(gray, side)
    out = np.full((side, side), 32, np.uint8)
    y, x = (side - small.shape[0]) // 2, (side - small.shape[1]) // 2
    out[y : y + small.shape[0], x : x + small.shape[1]] = small
    return out


def sheet(rows: list[tuple[str, list[np.ndarray]]], side: int = 96, gap: int = 6) -> np.ndarray:
    """Rows of thumbnails, each behind a bar in the color of its kind."""
    wide = max((len(t) for _, t in rows), default=1)
    out = np.full((len(rows) * (side + gap) + gap, wide * (side + gap) + 3 * gap, 3), 245, np.uint8)
    for i, (kind, images) in enumerate(rows):
        y = gap + i * (side + gap)
        out[y : y + side, gap : 2 * gap] = COLORS[kind]
        for j, image in enumerate(images):
            x = 3 * gap + j * (side + gap)
            out[y : y + side, x : x + side] = image[:, :, None]
    return out


def render_gallery(images: DataFrame, failures: DataFrame, output_dir: str | Path) -> Path:
    """images: filename and gray pixels; failures as diagnosed. Missing or ambiguous images raise."""
    order = failures.select("reference_group", "failure_types", "predicted_groups")
    numbered = [(i, *r) for i, r in enumerate(order.orderBy("reference_group", "failure_types").collect())]  # a sheet each
    spark = images.sparkSession
    schema = "no int, reference_group array<string>, failure_types array<string>, predicted_groups array<array<string>>"
    table = spark.createDataFrame(numbered, schema)
    kind = F.when(F.array_contains("failure_types", "merge"), "merge").otherwise("split")
    places = table.select("no", F.lit(0).alias("row"), F.lit("reference").alias("kind"), F.posexplode("reference_group").alias("col", "filename"))
    more = table.select("no", kind.alias("kind"), F.posexplode("predicted_groups").alias("row", "g"))
    more = more.select("no", (F.col("row") + 1).alias("row"), "kind", F.posexplode("g").alias("col", "filename"))
    places = places.unionByName(more)
    counts = images.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    odd = places.select("filename").distinct().join(counts, "filename", "left").where("coalesce(n, 0) <> 1").limit(5).collect()
    if odd:
        raise ValueError("not exactly one image for " + ", ".join(r["filename"] for r in odd))
    full = places.join(images.where("decode_ok").select("filename", "height", "width", "gray"), "filename", "left")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, part in sorted(pdf.groupby("row")):
            part = part.sort_values("col")
            shots = [np.zeros((8, 8), np.uint8) if r.gray is None else np.frombuffer(r.gray, np.uint8).reshape(int(r.height), int(r.width)) for r in part.itertuples()]
            rows.append((part["kind"].iloc[0], [thumbnail(s) for s in shots]))
        return pd.DataFrame({"no": [pdf["no"].iloc[0]], "png": [k.png_bytes(sheet(rows))]})

    target = Path(output_dir)
    target.mkdir(parents=True, exist_ok=True)
    index = [
        {"sheet": f"failure-{i:04d}.png", "reference_group": ref, "failure_types": types, "predicted_groups": pred}
        for i, ref, types, pred in ((n, list(a), list(b), [list(x) for x in c]) for n, a, b, c in numbered)
    ]
    labels = {r["filename"]: r["label"] for r in places.select("filename", clipped_label(F.col("filename")).alias("label")).distinct().collect()}
    for r in full.groupBy("no").applyInPandas(draw, "no int, png binary").toLocalIterator():
        (target / f"failure-{r['no']:04d}.png").write_bytes(bytes(r["png"]))
    return write_json(target / "index.json", {"schema_version": 1, "failures": index, "labels": labels})
