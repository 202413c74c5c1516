"""The library's parsers and id functions under names that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import blocks as markdown
from ..operators import declarations as code
from .ids import TOKEN


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@udtf(returnType=markdown.SCHEMA.replace("path string, ", ""))
class MarkdownBlocks:
    """Blocks of a Markdown text; the third argument is the pattern of headings that are requirements."""

    def eval(self, path: str, text: str, heading: str) -> Iterator[tuple]:
        names = _names(markdown.SCHEMA)[1:]
        for row in markdown.Fold(path or "", text, heading).run() if text else ():
            yield tuple(row.get(n) for n in names)


@udtf(returnType=code.SCHEMA)
class CodeDeclarations:
    """Declarations of a code file."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        names = _names(code.SCHEMA)
        for row in code.Reader(path or "", text).run() if text else ():
            yield tuple(row.get(n) for n in names)


def register(spark: SparkSession, token: str = TOKEN) -> None:
    """Make ``markdown_blocks``, ``code_declarations``, ``title_tags``, ``mentions`` and ``owner_path`` known to the session's SQL.

    ``token`` is the id grammar of tags.  The last three are SQL functions, so the
    optimiser sees through them.
    """
    spark.udtf.register("markdown_blocks", MarkdownBlocks)
    spark.udtf.register("code_declarations", CodeDeclarations)
    quoted = token.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION title_tags(title STRING) RETURNS ARRAY<STRING> RETURN array_distinct(regexp_extract_all(coalesce(title, ''), '\\\\[((?:[^\\\\]/]+/)?{quoted})\\\\]', 1))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mentions(text STRING, id STRING) RETURNS BOOLEAN RETURN rlike(text, concat('(?<![A-Za-z0-9_])', regexp_replace(id, '([^A-Za-z0-9])', '\\\\\\\\$1'), '(?![A-Za-z0-9_])'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION owner_path(id STRING) RETURNS STRING RETURN CASE WHEN startswith(id, 'file:') THEN substr(id, 6) WHEN startswith(id, 'symbol:') AND instr(id, '#') > 0 THEN regexp_extract(id, '^symbol:(.*)#[^#]*$', 1) END")
