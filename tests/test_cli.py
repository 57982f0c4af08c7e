"""The command line lists every registered query."""

from __future__ import annotations

import io
from contextlib import redirect_stdout


def test_list_shows_every_query():
    from ledgerleaf.__main__ import main
    from ledgerleaf.plans.catalog import REGISTRY
    buf = io.StringIO()
    with redirect_stdout(buf):
        assert main(["list"]) == 0
    lines = buf.getvalue().strip().splitlines()
    assert len(lines) == len(REGISTRY)
    assert all(line.split()[0] in REGISTRY for line in lines)
    assert all(line.rstrip().endswith("oracle") for line in lines)
