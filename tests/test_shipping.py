"""Functions that run in Python workers must load where the package is not installed."""

import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from tidemark.operators import cooldowns
from tidemark.streaming import stateful


@pytest.mark.parametrize("thing", [cooldowns._replayed(["k"], ["k", "sec"], 60), stateful.Cooldown(1), stateful.Hysteresis(1, 2), stateful.EmaMonitor(5, "cross"),
                                   stateful.Heartbeat(5), stateful.Deadline()], ids=lambda t: type(t).__name__)
def test_loads_without_the_package(thing, tmp_path):
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(thing))
    code = "import sys, pickle; from pyspark import cloudpickle; pickle.load(open(sys.argv[1], 'rb')); assert 'tidemark' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "f.pkl")], check=True, cwd=tmp_path, env=env)
