"""The package works from its archive alone, in another folder."""

import subprocess
import sys

from sparkproof.session import package_zip


def test_import_from_the_archive(tmp_path):
    path = package_zip(str(tmp_path))
    code = f"""import sys
sys.path[:] = [p for p in sys.path if p not in ('', '/root/repo')]
sys.path.insert(0, {path!r})
import sparkproof.functions.mail_parser as m
from sparkproof.plans import load_all
assert '.zip' in m.__file__ and len(load_all().QUERIES) > 150"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
