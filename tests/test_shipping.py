"""Kernels reach executors that have no copy of the package."""

import base64
import os
import subprocess
import sys

from pyspark import cloudpickle

from tallyloom.operators.events import _debounce_kernel
from tallyloom.operators.set_pairs import _chunked
from tallyloom.operators.python_symbols import SYMBOLS, _map, python_symbols


def test_kernels_load_elsewhere(tmp_path):
    code = "import sys, base64\nfrom pyspark import cloudpickle\nf = cloudpickle.loads(base64.b64decode(sys.stdin.read()))\nprint(callable(f), 'tallyloom' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for kernel in (_chunked(3, 0.6), _debounce_kernel(1), _map(python_symbols, SYMBOLS)):
        sent = base64.b64encode(cloudpickle.dumps(kernel)).decode()
        got = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, text=True, cwd=tmp_path, env=env, check=True)
        assert got.stdout.split() == ["True", "False"]
