"""The driver's entry points."""

import subprocess
import sys


def test_import_needs_no_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(set(e.oracle_sql()) - set(e.queries())), len(e.queries()) > 90)"], capture_output=True, text=True)
    assert said.stdout.split()[-2:] == ["[]", "True"], said.stderr
