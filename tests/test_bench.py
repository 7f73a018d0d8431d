import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_REPS="1", BENCH_CPUS="2",
               BENCH_QUERIES="doy_record_highs,wind_rose")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(rec)
    assert rec["unit"] == "sec" and rec["sf"] == 0.001 and set(rec["queries"]) == {"doy_record_highs", "wind_rose"}


def test_python_udf_queries_work_from_any_working_directory():
    code = (
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('e', '{ROOT}/__spark_entry__.py')\n"
        "E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print(E.queries()['daily_normals'](s, '/root/testdata/sf0.001').count())\n")
    out = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, timeout=600,
                         check=True).stdout
    assert out.strip().splitlines()[-1] == str(25 * 366)   # 25 stations
