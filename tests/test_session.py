"""What the submitter sets stays, and cuts need a folder that all machines see."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from quillmark import session as S
from quillmark.shared import shared_dir

CODE = "from quillmark.session import session; s = session('local[1]', **{'spark.sql.session.timeZone': 'Asia/Seoul'}); print('GOT', s.conf.get('spark.sql.shuffle.partitions'), s.sparkContext.master, s.conf.get('spark.sql.session.timeZone'), s.conf.get('spark.sql.adaptive.enabled'))"


def test_submitted_settings_win(tmp_path):
    (tmp_path / "spark-defaults.conf").write_text("# defaults\nspark.sql.adaptive.enabled false\n")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[3] --conf spark.sql.shuffle.partitions=77 pyspark-shell", "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300).stdout
    assert "GOT 77 local[3] Asia/Seoul false" in out


def test_names_of_submitted_settings(monkeypatch):
    monkeypatch.setenv("PYSPARK_SUBMIT_ARGS", "--conf a.b=1 --conf=c.d=2 --driver-memory 2g --master x pyspark-shell")
    monkeypatch.delenv("PYSPARK_GATEWAY_PORT", raising=False)
    monkeypatch.delenv("SPARK_CONF_DIR", raising=False)
    assert S.submitted() >= {"a.b", "c.d", "spark.driver.memory", "spark.master"}


def test_no_shared_folder_is_an_error(spark):
    conf = {"spark.master": "spark://somewhere:7077"}
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k, d=None: conf.get(k, d))), conf=SimpleNamespace(get=lambda k, *d: d[0] if k == "spark.checkpoint.dir" else spark.conf.get(k, *d)), _jvm=spark._jvm, _jsc=spark._jsc)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake)
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_dir(fake) == "hdfs://x/y"
