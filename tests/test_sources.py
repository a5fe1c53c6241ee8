import pytest

from blurframe.operators.encode import decode
from blurframe.schema import RTSchema, SchemaError
from blurframe.sources import text


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "data.csv").write_text("age#n,city#c,basket#t\n20,n1,a1 b1\nage#n,city#c,basket#t\n40,s1,a2\n30,n2\n20.5,n1,  \n")
    (tmp_path / "city").write_text("*:north,south\nnorth:n1,n2\nsouth:s1,s2\n")
    (tmp_path / "basket").write_text("*:A,B\nA:a1,a2\nB:b1,b2\n")
    (tmp_path / "age").write_text("0-100\n")
    return tmp_path


def test_read_format_write(spark, folder):
    schema, hierarchies, declared, encoded = text.read_encoded(spark, str(folder / "data.csv"), str(folder))
    assert schema == RTSchema.from_header("age#n,city#c,basket#t") and declared == {"age": (0.0, 100.0)}
    assert encoded.count() == 4 and encoded.select("row_id").distinct().count() == 4
    decoded = decode(encoded, schema, hierarchies)
    lines = sorted(r[0] for r in text.format_rows(decoded, schema).collect())
    assert lines == ["20,n1,a1 b1", "20.5,n1,", "30,n2,", "40,s1,a2"]
    text.write_text(decoded, schema, str(folder / "out"))
    assert sorted(r[0] for r in spark.read.text(str(folder / "out")).collect()) == lines


def test_headerless_and_splitter(spark, folder):
    (folder / "plain").write_text("20; n1; a1 b1\n")
    schema, rows = text.read_dataset(spark, str(folder / "plain"), r";\s*", RTSchema.from_order("nct"))
    row = rows.first()
    assert (row["n0"], row["c1"], row["t2"]) == (20.0, "n1", ["a1", "b1"])


def test_domains(spark, folder):
    (folder / "signed").write_text("-2.5-7\n")
    assert text.read_domain(spark, str(folder / "signed")) == (-2.5, 7.0)
    (folder / "odd").write_text("7\n")
    with pytest.raises(SchemaError):
        text.read_domain(spark, str(folder / "odd"))
    (folder / "nothing").write_text("")
    with pytest.raises(SchemaError):
        text.read_header(spark, str(folder / "nothing"))
