"""Test results: JSON and JUnit reports to (req_id, test_name, passed)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, XMLPullParser

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import inherited_tags, title_tags

# Field names of JSON reports.
JSON_REPORT = "testResults array<struct<name:string,assertionResults:array<struct<ancestorTitles:array<string>,title:string,status:string>>>>"


def json_results(reports: DataFrame) -> DataFrame:
    """Records of JSON reports in ``text``; malformed reports have none."""
    suites = reports.select(F.explode(F.from_json("text", JSON_REPORT)["testResults"]).alias("s"))
    tests = suites.select(F.explode("s.assertionResults").alias("t"))
    name = F.coalesce("t.title", F.lit(""))
    passed = F.coalesce(F.col("t.status") == "passed", F.lit(False))
    return tests.select(F.explode(inherited_tags(name, F.col("t.ancestorTitles"))).alias("req_id"), name.alias("test_name"), passed.alias("passed"))


def junit_cases(text: str) -> list[tuple[list[str], str, bool]]:
    """Cases of a JUnit report: names of the suites around it, outermost first, its name, and whether it passed; none if it is malformed."""
    reader = XMLPullParser(("start", "end"))
    suites, cases = [], []
    try:
        reader.feed(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
        reader.close()
        for event, e in reader.read_events():
            if event == "start" and e.tag == "testsuite":
                suites.append(e.get("name", ""))
            elif event == "end" and e.tag == "testsuite":
                suites.pop()
            elif event == "end" and e.tag == "testcase" and suites:
                cases.append((list(suites), e.get("name", ""), all(e.find(bad) is None for bad in ("failure", "error", "skipped"))))
    except ParseError:
        return []
    return cases


def junit_results(reports: DataFrame) -> DataFrame:
    """Records of JUnit reports in ``text``; malformed reports have none.

    A case with a failure, error or skipped child has not passed; a case without
    tags has those of the nearest suite around it that has some, however deep
    suites lie in suites.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for text in batch.column("text").to_pylist() if text for c in junit_cases(text)]
            above, names, passed = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(above, pa.list_(pa.string())), pa.array(names, pa.string()), pa.array(passed, pa.bool_())], ["above", "test_name", "passed"])

    cases = reports.select("text").mapInArrow(run, "above array<string>, test_name string, passed boolean")
    tagged = F.filter(F.transform("above", title_tags), lambda t: F.size(t) > 0)
    own, near = title_tags(F.col("test_name")), F.coalesce(F.try_element_at(tagged, F.lit(-1)), F.array().cast("array<string>"))
    return cases.select(F.explode(F.when(F.size(own) > 0, own).otherwise(near)).alias("req_id"), "test_name", "passed")


def read_results(reports: DataFrame) -> DataFrame:
    """Records of reports in either format, told apart by the first character that is not blank; others have none."""
    first = F.substring(F.regexp_replace("text", r"^\s+", ""), 1, 1)
    return json_results(reports.filter(first.isin("{", "["))).unionByName(junit_results(reports.filter(first == "<")))


def load_results(spark: SparkSession, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records of every report that ``patterns`` name, and warnings: no-match, malformed or no-results, and the pattern or file."""
    found, told = [], []
    for pattern in patterns:
        try:
            files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        except AnalysisException:
            told.append(pattern)
        else:
            found.append(files)
    warnings = spark.createDataFrame([("no-match", p) for p in told], "type string, id string")
    if not found:
        return spark.createDataFrame([], "req_id string, test_name string, passed boolean"), warnings
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    files = files.distinct()
    shown = F.regexp_replace("text", r"^\s+", "")
    broken = F.substring(shown, 1, 1).isin("{", "[") & F.try_parse_json("text").isNull()
    records = files.select("file", F.struct("text").alias("r")).select("file", "r.text")
    fine = records.filter(~broken)
    some = fine.filter(F.col("text").rlike(r"\[(?:[^\]/]+/)?[A-Z][A-Za-z]*-\d+\]"))
    warnings = warnings.unionByName(files.filter(broken).select(F.lit("malformed").alias("type"), F.col("file").alias("id")))
    warnings = warnings.unionByName(fine.join(some.select("file"), "file", "anti").select(F.lit("no-results").alias("type"), F.col("file").alias("id")))
    return read_results(fine), warnings
