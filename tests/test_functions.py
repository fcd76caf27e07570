import pytest
from callatlas.functions import signatures as S
from callatlas.functions import text as X
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("d,want", [("I", "int"), ("[[J", "long[][]"), ("Lcom/a/B;", "com.a.B"), ("[Lcom/a/B$C;", "com.a.B$C[]"), ("V", "void")])
def test_descriptor_types(spark, d, want):
    assert one(spark, S.descriptor_type(F.col("d")), d=d) == want


def test_signatures(spark):
    made = S.normalise_signature(F.lit("Lcom/a/B;"), F.lit("run"), F.lit("(I[JLx/Y;)V"))
    sig = "<com.a.B: void run(int,long[],x.Y)>"
    assert one(spark, made) == sig and one(spark, S.normalise_signature(F.lit("x"), F.lit("y"), F.lit(sig))) == sig
    c = F.lit(sig)
    assert [one(spark, f(c)) for f in (S.class_of, S.method_of, S.return_of, S.params_of)] == ["com.a.B", "run", "void", ["int", "long[]", "x.Y"]]
    assert one(spark, S.package_of(F.lit("com.a.B$C"))) == "com.a" and one(spark, S.package_of(F.lit("B"))) == ""
    assert one(spark, S.component_name(F.lit(".Main"), F.lit("com.a"))) == "com.a.Main" and one(spark, S.component_name(F.lit("Main"), F.lit("com.a"))) == "com.a.Main"


def test_text(spark):
    t = F.lit('see HTTP 10.1.2.3 and 1.2.3.400, 0.1.2.3 at https://a.example.com/x "quoted" tail')
    assert one(spark, X.addresses(t)) == ["1.2.3.400", "10.1.2.3"] and one(spark, X.urls(t)) == ["https://a.example.com/x"]
    assert one(spark, X.quoted(t)) == ["quoted"] and one(spark, X.url_host(F.lit("HTTPS://A.b:80/x"))) == "a.b"
    assert one(spark, X.has_indicator(F.lit("x a.com/y"), F.lit("a.com"))) and not one(spark, X.has_indicator(F.lit("xa.com"), F.lit("a.com")))
    assert one(spark, X.strip_comments(F.lit("a/* b\nc */d // e\nf"))) == "ad \nf"
    assert one(spark, X.first_line_with(F.lit("a\nbx\ncx"), F.lit("x"))) == "bx" and one(spark, X.safe_id(F.lit("..a b/c.."))) == "a_b_c"
    assert one(spark, X.invoked_signature(F.lit("$r = virtualinvoke $a.<a.B: void c(int)>(1)"))) == "<a.B: void c(int)>"
    assert one(spark, F.to_json(X.tolerant_json(F.lit('Sure: ```json\n{"a": 1}\n``` done')))) == '{"a":1}'
    assert one(spark, F.to_json(X.tolerant_json(F.lit('so {"a": [1]} is it')))) == '{"a":[1]}' and one(spark, X.tolerant_json(F.lit("none")).isNull())


def test_domains_of_long_texts(spark):
    import time

    rows = [(0, "a." * 50_000 + "com"), (1, "1." * 50_000), (2, "x Ex-Ample.org, see .b.co_ and a.com1 or mail@q.r.net."), (3, None)]
    began = time.time()
    got = {r["k"]: r["d"] for r in spark.createDataFrame(rows, "k int, t string").select("k", X.domains(F.col("t")).alias("d")).collect()}
    assert time.time() - began < 20
    assert got == {0: ["a." * 50_000 + "com"], 1: [], 2: ["Ex-Ample.org", "q.r.net"], 3: None}
