"""Command line: build, encode, test, testhash, article, ac, compress, extract over text files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from strandex.operators import codec
from strandex.plans import commands
from strandex.plans.dictionary import Params
from strandex.sources import lines as sources
from strandex.sources import store

COMMANDS = "build encode test testhash article ac compress extract".split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandex", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("-f", "--file", required=True, help="text file of strings, or the archive to extract")
    p.add_argument("-d", "--dictionary", help="folder of the stored dictionary")
    p.add_argument("-o", "--output", help="where results go: an archive, extracted lines, or a CSV report")
    p.add_argument("-n", "--patterns", type=int, default=100)
    p.add_argument("-k", "--kgram", type=int, default=3)
    p.add_argument("-r", "--ratio", type=float, default=0.5)
    p.add_argument("-l", "--split", help="mine what stands between these characters")
    p.add_argument("-u", "--probes", help="text file of strings to look up")
    p.add_argument("-v", "--verify", action="store_true")
    p.add_argument("-x", "--repeats", type=int, default=20)
    p.add_argument("-z", "--size", type=int, default=10_000, help="lines in each random set")
    p.add_argument("-s", "--sets", type=int, default=10, help="random sets")
    p.add_argument("-p", "--print", action="store_true", dest="show", help="show the dictionary")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandex").getOrCreate()
    params = Params(n1=a.patterns + 1000, n2=a.patterns, r=a.ratio, k=a.kgram)
    if a.command == "compress":
        return store.compress(spark, a.file, a.output, params, a.split)
    if a.command == "extract":
        return store.extract(spark, a.file, a.output)
    lines = sources.valid_lines(sources.read_lines(spark, a.file)).cache()
    target = a.dictionary or f"{a.file}.dictionary"
    made = store.load(spark, target) if a.command == "encode" else commands.build_and_store(spark, lines, target, params, a.split)
    if a.show:
        store.dump(made.frame(spark)).show(1000, False)
    report = None
    if a.command == "testhash":
        probes = sources.valid_lines(sources.read_lines(spark, a.probes)) if a.probes else lines
        report = commands.lookup_report(spark, lines, probes, made)
    elif a.command == "article":
        totals = codec.totals(lines, codec.encode(lines, made.coded())).first()
        seconds = commands.sample_encodes(lines, made, a.sets, a.size, a.repeats)
        print(json.dumps({"ratio": totals["encoded_bytes"] / max(totals["decoded_bytes"], 1), "seconds": seconds}))
    elif a.command == "ac":
        report = commands.match_report(spark, lines, made, a.repeats)
    else:
        report = commands.encode_report(spark, lines, made, a.verify or a.command == "test")
    if report is not None:
        print(json.dumps(report.first().asDict()))
        if a.output:
            store.append_report(report, a.output)


if __name__ == "__main__":
    main()
