"""Whole texts of long licences, with and without their advice on use."""

from pathlib import Path

from plantspark.llm import license_scan
from plantspark.llm.license_texts import FILES

HERE = Path(license_scan.__file__).parent / "licences"


def test_whole_licences(spark):
    rows, names = [], []
    for file, name in FILES.items():
        text = (HERE / f"{file}.txt").read_text(encoding="utf-8")
        for x, known in ((text, name), ("\n\n" + text.replace("\n", "\r\n").upper(), name), (text + " more", None), (text[: len(text) // 2], None)):
            rows.append((len(rows), x))
            names.append(known)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["license"] for r in license_scan.scan(docs).orderBy("doc_id").collect()] == names


def test_terms_without_advice(spark):
    apache, gpl = ((HERE / f"{x}.txt").read_text(encoding="utf-8") for x in ("Apache-2.0", "GPL-2"))
    docs = spark.createDataFrame([(0, apache[: apache.index("APPENDIX")]), (1, gpl[: gpl.index("How to Apply")])], "doc_id long, text string")
    assert [r["license"] for r in license_scan.scan(docs).orderBy("doc_id").collect()] == ["Apache-2.0", "GPL-2.0"]
