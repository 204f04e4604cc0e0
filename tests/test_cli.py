from __future__ import annotations

import pytest

from lumenspark import cli


def test_options():
    a = cli.parse(["light-curve", "--spec", "s.toml", "--out", "o", "--row", "5", "--col", "7", "--start", "2024-01-01T00:00:00Z", "--stop", "2024-01-02", "--step", "00:15:00"])
    assert (a.row, a.col, a.step, a.start, a.stop, a.pair) == (5, 7, 900, "2024-01-01 00:00:00", "2024-01-02 00:00:00", ("row", "col"))
    assert cli.seconds("2h") == 7200


@pytest.mark.parametrize(
    "argv",
    [
        ["azel", "--out", "o"],
        ["azel", "--out", "o", "--lat", "1"],
        ["light-curve", "--spec", "s", "--out", "o", "--row", "1", "--col", "1", "--lat", "2", "--lon", "3"],
        ["azel", "--out", "o", "--out", "p", "--lat", "1", "--lon", "1"],
        ["azel", "--out", "o", "--lat", "1", "--lon", "1", "--unknown", "1"],
        ["azel", "--out", "o", "--lat", "1", "--lon", "1", "--step", "0s"],
        ["azel", "--out", "o", "--lat", "1", "--lon", "1", "--step", "soon"],
        ["azel", "--out", "o", "--lat", "1", "--lon", "1", "--start", "2024-01-02", "--stop", "2024-01-01"],
        ["mapset", "--out"],
    ],
)
def test_wrong_options(argv):
    with pytest.raises(SystemExit):
        cli.parse(argv)
