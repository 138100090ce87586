"""Generated scenes as image files: what queries and the benchmark of the image path read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from pairgraph.functions import kernels as k
from pairgraph.plans.store import shared_dir


def scene(seed: int, height: int, width: int) -> np.ndarray:
    """A blurred random surface with a brighter box."""
    rng = np.random.default_rng(seed)
    image = k.blur(rng.uniform(0, 255, (height, width)), 2.0)
    image = (image - image.min()) / (image.max() - image.min()) * 180 + 20
    y, x = rng.integers(10, min(height, width) // 3, 2)
    image[y : y + height // 3, x : x + width // 3] += 30
    return image


def write_scenes(spark: SparkSession, name: str, n: int, *, gains: tuple[float, ...] = (0.6, 1.0, 1.2), height: int = 150, width: int = 200, odd: bool = False) -> str:
    """A folder of n scenes, each in several exposures, as s<scene>_<gain>.png; odd: and a copy of the first file, one
    that can't be read and one that is no image. Files go through the file system of the shared folder."""
    folder = f"{shared_dir(spark)}/pairgraph/{spark.sparkContext.applicationId}/scenes-{name}"
    files = {f"s{i:03d}_{g}.png": k.png_bytes(np.clip(scene(i, height, width) * g, 0, 255).astype(np.uint8)) for i in range(n) for g in gains}
    if odd:
        files |= {"copy.PNG": files[f"s000_{gains[0]}.png"], "broken.jpg": b"no image", "notes.txt": b"x"}
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(path(folder), True)
    for file, content in files.items():
        out = system.create(path(f"{folder}/{file}"))
        out.write(bytearray(content))
        out.close()
    return folder
