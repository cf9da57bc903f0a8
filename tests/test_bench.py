"""bench.py keeps its contract: one JSON line with metric, value, unit, queries and sf."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_REPEAT="1")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "flagship_error_rollup"],
                         capture_output=True, text=True, env=env, timeout=600, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["sf"] == "0.001" and set(rec["queries"]) == {"flagship_error_rollup"}
    assert rec["value"] == rec["queries"]["flagship_error_rollup"] > 0
