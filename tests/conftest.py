import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessella.session import build_session

    s = build_session("local[4]", 4, app="tessella-tests")
    # tests set their own checkpoint folder; a cluster names a shared one
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-test-ckpt-"))
    yield s
    s.stop()


def entries(spark, rows):
    from tessella.matrix import ENTRY_SCHEMA

    return spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in rows], ENTRY_SCHEMA)


def cells(df, drop_zeros=False):
    out = {}
    for r in df.select("i", "j", "v").collect():
        key = (r["i"], r["j"])
        assert key not in out, f"cell {key} twice"
        out[key] = r["v"]
    if drop_zeros:
        out = {k: v for k, v in out.items() if v != 0}
    return out


def dense_product(a_rows, b_rows):
    """Brute-force reference: dict-of-cells product in plain Python."""
    from collections import defaultdict

    by_row = defaultdict(list)
    for j, k, w in b_rows:
        by_row[j].append((k, w))
    out = defaultdict(float)
    seen = set()
    for i, j, v in a_rows:
        for k, w in by_row.get(j, ()):
            out[(i, k)] += v * w
            seen.add((i, k))
    return {k: out[k] for k in seen}
