"""Buoy files whose columns stand in different orders, and their errors."""

import pytest

from swellcast.sources.text import read_buoy


def _write(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def test_every_file_follows_its_own_header(spark, tmp_path):
    _write(tmp_path, "a.txt", "#YY MM DD hh mm WSPD WVHT", "#yr mo dy hr mn m/s m", "2024 01 01 00 50 5.0 1.0", "2024 01 01 01 50 MM 2.0")
    _write(tmp_path, "b.txt", "#YY MM DD hh mm WVHT WSPD PRES", "#yr mo dy hr mn m m/s hPa", "2024 01 01 00 50 1.0 5.0 1000.5")
    got = {(r["series_id"], r["ts"].hour): (r["WSPD"], r["WVHT"], r["PRES"]) for r in read_buoy(spark, f"{tmp_path}/*.txt").collect()}
    assert got == {("a", 0): (5.0, 1.0, None), ("a", 1): (None, 2.0, None), ("b", 0): (5.0, 1.0, 1000.5)}


def test_a_file_without_header_is_an_error(spark, tmp_path):
    _write(tmp_path, "a.txt", "#YY MM DD hh mm WSPD WVHT", "2024 01 01 00 50 5.0 1.0")
    _write(tmp_path, "b.txt", "#YY MM DD hh mm WVHT WSPD", "2024 01 01 00 50 5.0 1.0")
    _write(tmp_path, "c.txt", "2024 01 01 00 50 5.0 1.0")
    with pytest.raises(Exception, match="no header line"):
        read_buoy(spark, f"{tmp_path}/*.txt").collect()
