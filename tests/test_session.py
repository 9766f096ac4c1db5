"""Session settings, the shared folder and the life of cut tables."""

import os
import subprocess
import sys

import pytest

from phyllo import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _said(code, conf=""):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"{conf} pyspark-shell", "PYTHONPATH": ROOT}
    return subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=120, capture_output=True, text=True).stdout.split()


def test_settings_of_the_cluster_win():
    code = "from phyllo.session import build_session; s = build_session('local[2]'); print(*[s.conf.get('spark.sql.' + k) for k in ('shuffle.partitions', 'session.timeZone', 'adaptive.enabled')])"
    assert _said(code, "--conf spark.sql.shuffle.partitions=123 --conf spark.sql.adaptive.enabled=false") == ["123", "UTC", "false"]
    assert _said(code) == ["8", "UTC", "true"]
    assert _said(code.replace("'local[2]'", "'local[2]', **{'spark.sql.shuffle.partitions': '5'}")) == ["5", "UTC", "true"]


def test_settings_of_a_session_that_is_there_stay(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert session.build_session("local[4]").conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


class _Cluster:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_no_folder_of_our_own_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster())


def test_cut_tables_go_when_no_plan_reads_them(spark):
    df = spark.range(10)
    first = session.cut(df, "life")
    path = max(p for p in session._CUT if "/life-" in p)
    second = first.where("id > 3").groupBy().sum("id")
    del first
    for _ in range(3):
        spark._jvm.System.gc()
    session.sweep(spark)
    assert path in session._CUT and second.first()[0] == sum(range(4, 10))
    del second
    import gc
    import time

    for _ in range(20):
        gc.collect()
        spark._jvm.System.gc()
        if path in session.sweep(spark):
            break
        time.sleep(0.2)
    assert path not in session._CUT and not os.path.exists(path.removeprefix("file://"))


def test_operators_run_from_any_folder(tmp_path):
    """The README's example in a folder of its own, with the package on the driver's path only."""
    code = """
import sys
sys.path.insert(0, %r)
from phyllo.session import build_session
from phyllo.operators import spatial
spark = build_session("local[2]", **{"spark.ui.showConsoleProgress": "false"})
df = spark.createDataFrame([("a", i, float(i), 0.0, 0.0) for i in range(20)], "uid string, vid long, x double, y double, z double")
print("pairs", spatial.knn_join(df, df, 2, drop_self=True).count())
""" % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "job.py").write_text(code)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "pairs 40" in done.stdout, done.stderr[-2000:]
