import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from regionmatch.session import build_session

    s = build_session("local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from regionmatch.session import drop_written

    drop_written(s)
    s.stop()


def cells(spark, *arrays, name="gray"):
    """Raster table of numpy arrays, numbered as images."""
    rows = []
    for i, a in enumerate(arrays):
        h, w = a.shape
        rows += [(i, h, w, y, x, a[y, x].item()) for y in range(h) for x in range(w)]
    kind = "double" if arrays[0].dtype.kind == "f" else "int"
    return spark.createDataFrame(rows, f"image int, h int, w int, y int, x int, {name} {kind}")


def array_of(df, column, image=0, key="image", y="y", x="x"):
    import numpy as np

    rows = df.filter(df[key] == image).select(y, x, column).collect()
    out = np.full((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1), np.nan)
    for r in rows:
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out
