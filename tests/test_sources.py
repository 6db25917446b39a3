from pyspark.sql import functions as F

from loomgraph.sources import readers, writers
from loomgraph.streaming import rows


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def test_delimited(spark, tmp_path):
    p = put(tmp_path, "a.tsv", "x\ty\tz\n1\t2\t3\n")
    assert [tuple(r) for r in readers.tsv(spark, p, ["z", "x"]).collect()] == [("3", "1")]
    q = put(tmp_path, "b.tsv", "p1\t-\t5\nNone\tq\tx\n")
    assert [tuple(r) for r in readers.headerless(spark, q, "a string, b string, n int", ("b",)).collect()] == [("p1", 5), (None, None)]
    r = put(tmp_path, "c.txt", "head\n\nGO:1 ; x\nGO:2 ; y\n")
    assert [tuple(x) for x in readers.parsed_lines(spark, r, r"^(\S+) ; (\S+)", ["go", "v"], 1).collect()] == [("GO:1", "x"), ("GO:2", "y")]
    e = put(tmp_path, "e.tsv", "")
    assert readers.or_empty(spark, readers.tsv(spark, p), e, "x string, y string, z string").count() == 1
    g = put(tmp_path, "g.tsv", "source\ttarget\trel\na\tb\tR\n")
    assert readers.edges(spark, g).columns == ["src", "dst", "rel"]


def test_json(spark, tmp_path):
    put(tmp_path, "m/GENE.json", '{"f1": 0.5}')
    put(tmp_path, "m/STRAIN.json", '{"f1": 0.7}')
    assert {r["label"]: r["f1"] for r in readers.labelled_files(spark, str(tmp_path / "m")).collect()} == {"GENE": 0.5, "STRAIN": 0.7}
    put(tmp_path, "r/a.json", '{"test results": {"p-value": 0.01, "LRT": 3}}')
    put(tmp_path, "r/b.json", "{broken")
    put(tmp_path, "r/c.json", "")
    got = readers.results(spark, str(tmp_path / "r"), {"p": "$['test results']['p-value']", "lrt": "$['test results']['LRT']"})
    assert [tuple(r) for r in got.collect()] == [("a", 0.01, 3.0)]
    d = put(tmp_path, "d.json", '[{"id": 1,\n "data": {"text": "x"}}]')
    assert readers.documents(spark, d, "id int, data struct<text:string>").first()["data"]["text"] == "x"


def test_text_and_records(spark, tmp_path):
    c = put(tmp_path, "x.conll", "-DOCSTART-\na O\nb B-GENE\n\nc I-GENE")
    assert [(r["tokens"], r["ner_tags"]) for r in readers.conll(spark, c).collect()] == [(["a", "b"], ["O", "B-GENE"]), (["c"], ["I-GENE"])]
    f = put(tmp_path, "s.fna", ">c1 [protein_id=P1] x\nAC\nGT\n>c2\nTT\n")
    assert [tuple(r)[:4] for r in readers.fasta(spark, f).collect()] == [("c1", "c1 [protein_id=P1] x", "ACGT", "P1"), ("c2", "c2", "TT", "")]
    o = put(tmp_path, "o.obo", 'format: 1\n\n[Term]\nid: A:1\nname: one\nsynonym: "uno" EXACT []\n\n[Term]\nid: A:2\nname: two\n')
    assert sorted(tuple(r) for r in readers.ontology(spark, o, ["name", "synonym"]).collect()) == [("A:1", "one", "name"), ("A:1", "uno", "synonym"), ("A:2", "two", "name")]
    n = put(tmp_path, "t.nt", '<http://x/1> <http://y#label> "one"@en .\n<http://x/1> <http://y#other> <http://z> .\n')
    assert [tuple(r) for r in readers.triples(spark, n, ["label"]).collect()] == [("http://x/1", "one", "label")]
    for i in range(5):
        put(tmp_path, f"asm/s1/a1/{i}", "x")
    put(tmp_path, "asm/s1/a2/0", "x")
    assert [tuple(r) for r in readers.complete_folders(spark, str(tmp_path / "asm/*/*")).collect()] == [("s1", "a1")]
    put(tmp_path, "xml/P1.xml", "<a><p id='1'>One</p><p id='2'>Two</p></a>")
    assert {(r["_VALUE"], r["pmcid"]) for r in readers.articles(spark, str(tmp_path / "xml")).collect()} == {("One", "P1"), ("Two", "P1")}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i}", "ab"[i % 2]) for i in range(25)], "id int, text string, c string").coalesce(1)
    writers.lines(df, str(tmp_path / "l"), "text", 10)
    assert len(list((tmp_path / "l").glob("part-*"))) == 3 and readers.corpus_lines(spark, str(tmp_path / "l")).count() == 25
    writers.jsonl(df, str(tmp_path / "j"))
    writers.tsv(df, str(tmp_path / "t"))
    writers.matrix(df, str(tmp_path / "m"), "id", "c", "text")
    writers.by_category(df, str(tmp_path / "k"), "c")
    writers.merged([df, df], str(tmp_path / "u"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "k")).count() == 25
    assert spark.read.parquet(str(tmp_path / "u")).count() == 50
    assert [r[0] for r in df.limit(2).select(readers.aliased(F.col("c"), {"a": "X"})).collect()] == ["X", "b"]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(f"{'x' * n} text", n) for n in (10, 50, 50, 60)], "text string, n int").withColumn("ts", F.timestamp_seconds(F.lit(1000)))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = rows.first_of_equal(rows.corpus_filter(s), "ts").writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").count() == 2
