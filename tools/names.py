"""List the query names of some catalog modules: python tools/names.py nearest outliers"""
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from raregrain.catalog import load  # noqa: E402

print(",".join(k for k, f in load()[0].items() if f.__module__.rsplit(".", 1)[-1] in sys.argv[1:]))
