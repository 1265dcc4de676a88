"""Each command of the command line over a small file."""

import json

import pytest

from strandex.__main__ import main

URLS = [f"http://www.{h}.example.com/{p}/{n}.html" for h in ("abc", "news") for p in ("en", "de") for n in range(6)]


@pytest.fixture
def told(spark, tmp_path, capsys):
    (tmp_path / "urls").write_text("\n".join([*URLS, "not\tvalid", ""]))
    (tmp_path / "probes").write_text("\n".join([URLS[3], "http://elsewhere/"]))

    def run(command, *more):
        main([command, "-f", str(tmp_path / "urls"), "-d", str(tmp_path / "dictionary"), "-n", "10", *more])
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    return run


def test_build_encode_and_test(told, spark, tmp_path):
    read = sum(len(u) + 1 for u in URLS)
    for command in ("build", "encode", "test"):
        row = told(command, "-v", "-o", str(tmp_path / "report"))
        assert row["n"] == len(URLS) and row["decoded_bytes"] == read and 0 < row["encoded_bytes"] < read / 2 and row["symbols"] == 127 + row["patterns"]
    report = spark.read.option("header", True).csv(str(tmp_path / "report"))
    assert report.count() == 3 and {r["decoded_bytes"] for r in report.collect()} == {str(read)}


def test_lookups(told, tmp_path):
    row = told("testhash", "-u", str(tmp_path / "probes"), "-o", str(tmp_path / "report"))
    assert (row["n"], row["misses"], row["different"], row["keys"], row["encoded_keys"]) == (2, 1, 0, len(URLS), len(URLS))
    assert row["plain_key_bytes"] == sum(map(len, URLS)) > row["encoded_key_bytes"] and any((tmp_path / "report").glob("*.csv"))


def test_timings(told):
    assert told("ac", "-x", "2")["hits"] > 0
    row = told("article", "-x", "1", "-s", "2", "-z", "5")
    assert len(row["seconds"]) == 2 and 0 < row["ratio"] < 0.5


def test_archive(spark, tmp_path):
    (tmp_path / "urls").write_text("\n".join(URLS))
    main(["compress", "-f", str(tmp_path / "urls"), "-o", str(tmp_path / "archive"), "-n", "10", "-l", "/"])
    main(["extract", "-f", str(tmp_path / "archive"), "-o", str(tmp_path / "back")])
    assert [line for part in sorted((tmp_path / "back").glob("part-*")) for line in part.read_text().splitlines()] == URLS
