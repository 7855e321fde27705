"""The command-line runner lists every registered query."""

from coverlake.__main__ import main
from coverlake.registry import load_all


def test_list_shows_all_queries(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    queries, oracles = load_all()
    for name in queries:
        assert name in out
    assert sum(1 for line in out.splitlines() if " sql " in line) == len(oracles)
