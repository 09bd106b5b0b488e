"""Attachments of several formats, and normalisation as a version that can be undone."""

import io
import zipfile

from pyspark.sql import functions as F

from graphloom.operators import ingest
from graphloom.plans.durable import Durable
from graphloom.sources import markdown


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_text():
    p = lambda *runs: "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"
    t = lambda s: f'<w:t xml:space="preserve">{s}</w:t>'
    body = p(t("One "), t("&lt;two&gt; é")) + p() + f"<w:tbl><w:tr><w:tc>{p(t('cell'), '<w:tab/>', t('x'))}</w:tc></w:tr></w:tbl>" + p("<w:delText>gone</w:delText>", t("kept"))
    assert markdown.docx_text(docx(body)) == "One <two> é\n\n\n\ncell\tx\n\nkept\n\n"
    assert markdown.docx_text(b"no zip") is None and markdown.docx_text(None) is None
    assert markdown.docx_text(docx("<w:p>")) is None  # broken XML


def test_attachments(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("<w:p><w:r><w:t>hello</w:t></w:r></w:p>"))
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    (tmp_path / "c.md").write_text("text é")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.substring_index("path", "/", -1).alias("path"), "content")
    got = {r["path"]: (r["kind"], r["data"]) for r in markdown.read_attachments(files).collect()}
    assert got == {"a.docx": ("document", "hello\n\n"), "b.png": ("image", "iVBORw=="), "c.md": ("document", "text é"), "d.pdf": ("document", None)}


def test_normalise_is_a_version(spark, tmp_path):
    raw = {"a.md": "Tag: x\nRef: \"[[b]]\"\nn: 1.5", "b.md": "tag: y\nTag: z\nref: q", "c.md": "tag: [v]\nother: 2020-01-02"}
    notes = spark.createDataFrame([(p, "2020-01-01", f"---\ntypes: [t]\n{h}\n---\nbody") for p, h in raw.items()], "path string, mtime string, raw string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    first = ingest.create(Durable(spark, str(tmp_path / "store")), notes)
    declared = spark.createDataFrame([("t", "tag", "list<string>"), ("t", "ref", "reference"), ("t", "other", "date")], "schema_type string, key string, field_type string")
    same, report = ingest.normalize(first, declared)
    assert same is first and {(r["action"], r["from_key"], r["files_affected"]) for r in report.collect()} == {("rename_key", "Tag", 2), ("rename_key", "Ref", 1), ("coerce_value", "tag", 2)}
    done, _ = ingest.normalize(first, declared, apply_=True)
    fields = lambda s: {(r["node_id"], r["key"], r["value_text"]) for r in s.store.fields.collect()}
    assert fields(done) == {("a.md", "tag", '["x"]'), ("a.md", "ref", "[[b]]"), ("a.md", "n", "1.5"), ("b.md", "tag", '["y"]'), ("b.md", "Tag", "z"), ("b.md", "ref", "q"), ("c.md", "tag", '["v"]'), ("c.md", "other", "2020-01-02T00:00:00.000Z")}
    assert [(r["source_id"], r["rel_type"], r["resolved"]) for r in done.store.edges.collect()] == [("a.md", "ref", "b.md")]
    assert {(r["key"], r["value_number"]) for r in done.store.fields.filter("value_number is not null").collect()} == {("n", 1.5)}
    assert done.store.nodes.count() == 3 and done.version == 2
    back = done.durable.roll_back(1)
    assert fields(back) == fields(first)
    later = notes.unionByName(spark.createDataFrame([("d.md", "2020-01-02", "---\ntypes: [t]\nTAG: w\n---\n")], "path string, mtime string, raw string").withColumn("mtime", F.col("mtime").cast("timestamp")))
    warned, counts, report = ingest.advance_normalized(back, later, declared, "warn")
    assert counts.first()["indexed"] == 1 and ("d.md", "TAG", "w") in fields(warned) and report.filter("from_key = 'TAG'").count() == 1
    fixed, counts, _ = ingest.advance_normalized(warned, later, declared, "fix")
    assert counts.first()["indexed"] == 0 and ("d.md", "tag", '["w"]') in fields(fixed) and fixed.version == warned.version + 1
