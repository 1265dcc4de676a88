"""Dictionaries from end to end, stores, sources and streams."""

import pytest

from strandex import schema
from strandex.functions import udfs
from strandex.operators import codec
from strandex.plans import commands
from strandex.plans import dictionary as plans
from strandex.sources import lines as sources
from strandex.sources import store
from strandex.streaming import streams

PARAMS = plans.Params(n1=2000, n2=50, r=0.5, k=3)
URLS = [f"http://www.{h}.example.com/{p}/{n}.html" for h in ("abc", "news", "shop", "blog") for p in ("en", "de", "fr") for n in range(12)]


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame(list(enumerate(URLS)), schema.LINES).cache()


@pytest.fixture(scope="module")
def built(urls):
    return plans.build(urls, PARAMS)


def test_build(spark, urls, built):
    assert 0 < len(built.rows) - schema.LITERALS <= PARAMS.n2 and built.records == len(URLS)
    assert commands.differing(urls, built).count() == 0
    report = commands.encode_report(spark, urls, built, verify=True).first()
    assert report["ratio"] < 0.4 and report["n"] == len(URLS)
    assert sum(len(t) for _, t, _, literal, _ in built.rows if not literal) > 2


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_build_does_not_depend_on_partitions(spark, urls, built, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    again = plans.build(urls.repartition(int(partitions)), PARAMS)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again.rows == built.rows


def test_other_ways_to_build(spark, urls):
    for params, split in ((plans.Params(n1=2000, n2=0, r=0.5, k=3), None), (plans.Params(n1=2000, n2=30, r=0.5, k=2), "."), (plans.Params(n1=500, n2=30, r=0.5, k=3, mode="two_pass"), "./")):
        made = plans.build(urls, params, split)
        assert len(made.rows) - schema.LITERALS <= params.n2 and commands.differing(urls, made).count() == 0
    with pytest.raises(ValueError):
        plans.Params(k=1)


def test_store_and_load(spark, urls, built, tmp_path):
    store.store(built, spark, f"{tmp_path}/d")
    assert store.load(spark, f"{tmp_path}/d") == built
    spark.read.parquet(f"{tmp_path}/d").selectExpr("* EXCEPT (version)", "1 AS version").write.parquet(f"{tmp_path}/old")
    with pytest.raises(ValueError):
        store.load(spark, f"{tmp_path}/old")


def test_compress_and_extract(spark, tmp_path):
    lines = [*URLS, "", "tab\there", "été", "   ", "last `line`"]
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n")
    store.compress(spark, f"{tmp_path}/in.txt", f"{tmp_path}/archive", PARAMS)
    store.extract(spark, f"{tmp_path}/archive", f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == [*URLS, "last `line`"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\x00two\x00three\x00")
    found = sources.read_lines(spark, f"{tmp_path}/a.txt", "\x00").orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in found] == [(0, "one"), (1, "two"), (2, "three")]
    frame = spark.createDataFrame([(0, "ok"), (1, ""), (2, "  "), (3, "tab\t"), (4, "cr\r"), (5, "é"), (6, None), (7, "nl\n"), (8, " ~")], schema.LINES)
    assert [r["line_no"] for r in sources.valid_lines(frame).orderBy("line_no").collect()] == [0, 8]
    docs = spark.createDataFrame([(1, 0, "ok"), (1, 1, "é"), (1, 2, "ok"), (1, 3, "")], "doc long, pos long, line string")
    assert [(r["pos"], r["reported"]) for r in sources.skipped_lines(docs).orderBy("pos").collect()] == [(1, 2), (3, 3)]
    tokens = sources.components(spark.createDataFrame([(1, "a.b//c."), (2, "///")], schema.LINES), "./").orderBy("pos").collect()
    assert [(r["pos"], r["token"]) for r in tokens] == [(0, "a"), (1, "b"), (2, "c")]
    numbered = sources.number_rows(spark.range(1000).repartition(7))
    assert sorted(r["line_no"] for r in numbered.collect()) == list(range(1000))
    (tmp_path / "p.bin").write_bytes(b"\x00\x02he\x00\x03she")
    assert {r["pat"] for r in sources.read_length_prefixed(spark, f"{tmp_path}/p.bin").collect()} == {"he", "she"}


def test_commands(spark, urls, tmp_path):
    assert commands.test(spark, urls, f"{tmp_path}/d", PARAMS).first()["ratio"] < 0.4
    made = store.load(spark, f"{tmp_path}/d")
    rows = commands.test_lookup(urls, urls, made).collect()
    assert len(rows) == len(URLS) and all(r["value"] == r["encoded_value"] == r["line_no"] for r in rows)
    assert len(commands.sample_encodes(urls, made, sets=2, size=20, repeats=1)) == 2
    assert commands.hits(spark, urls, made).count() > 0
    store.append_report(commands.encode_report(spark, urls, made), f"{tmp_path}/report")
    store.append_report(commands.encode_report(spark, urls, made), f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == 2
    dumped = store.dump(made.frame(spark)).collect()
    assert dumped[9]["str"] == "|0A|" and dumped[9]["symbol"] == 10


def test_streams(spark, built, tmp_path):
    rows = [(0, "http://www.abc.example.com/"), (1, "é"), (2, "plain")]
    spark.createDataFrame(rows, schema.LINES).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema.LINES).parquet(f"{tmp_path}/in")
    run = streams.encode_stream(source, built.coded()).writeStream.format("memory").queryName("encoded").start()
    run.processAllAvailable()
    run.stop()
    back = codec.decode(spark.table("encoded"), built.coded()).collect()
    assert {(r["line_no"], r["line"]) for r in back} == {(0, rows[0][1]), (2, "plain")}
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7) AS ts, 'abab' AS line FROM range(4)").write.parquet(f"{tmp_path}/ts")
    source = spark.readStream.schema("ts timestamp, line string").parquet(f"{tmp_path}/ts")
    run = streams.kgram_counts(source, 2).writeStream.format("memory").queryName("grams").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert {(r["start"].minute, r["kgram"], r["n"]) for r in spark.table("grams").collect()} >= {(0, "ab", 4), (0, "ba", 2)}


def test_functions(spark, urls, built):
    assert udfs.crc32c_of(b"123456789") == 0xE3069283 and udfs.crc32c_of(b"") == 0
    udfs.register(spark, built.coded())
    urls.createOrReplaceTempView("urls")
    row = spark.sql("SELECT count(*) AS n, sum(CAST(strandex_decode(e.nbits, e.payload) = line AS INT)) AS same, max(strandex_crc32c(line)) AS c FROM (SELECT line, strandex_encode(line) AS e FROM urls)").first()
    assert row["n"] == row["same"] == len(URLS) and row["c"] < 2**32
    assert spark.sql("SELECT strandex_encode(CAST(NULL AS STRING)).nbits AS n, strandex_crc32c(CAST(NULL AS STRING)) AS c").first().asDict() == {"n": None, "c": None}
