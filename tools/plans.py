"""Print the final (post-AQE) physical plan tree of registered queries.

Each query is collected first so its adaptive plan is final (use a small
scale), then its plan tree is printed with exchange / broadcast counts.
Usage: python tools/plans.py [--scale] [sf_dir] [query ...]

``--scale`` turns off size-based automatic broadcasts (static and AQE), so
small test tables get the shuffle plans large inputs get; explicit,
count-checked broadcasts stay.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessella import catalog  # noqa: E402
from tessella.session import build_session  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n\n")[0]
    return "\n".join(line for line in head.splitlines() if line.strip())


def main() -> None:
    args = sys.argv[1:]
    scale = "--scale" in args
    args = [a for a in args if a != "--scale"]
    sf = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or ["mm_outer", "mm_inner_broadcast", "msbfs_hop"]
    extra = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"} if scale else {}
    spark = build_session("local[8]", 16, extra=extra)
    for name in names:
        df = catalog.QUERIES[name](spark, sf)
        df.collect()
        t = tree(df).split("== Initial Plan ==")[0]
        n_ex = len(re.findall(r"(?<!Broadcast)Exchange \(", t))
        n_bc = len(re.findall(r"BroadcastExchange \(", t))
        print(f"### {name}: {n_ex} shuffle exchanges, {n_bc} broadcasts\n```\n{t}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
