"""Reports as SQL texts over named sources.

A text names its tables as ``{src:name}``. Binding puts frames in their place
and analyses the text without running it. What is wrong with a text comes as
findings rows, all of them at once: sources that are not there, and what the
analysis says.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

SOURCE = re.compile(r"\{src:([A-Za-z_][A-Za-z0-9_.]*)\}")
FINDINGS = "finding string, subject string, detail string"


def sources_of(text: str) -> list[str]:
    """The sources that a text names, in order, each once."""
    return list(dict.fromkeys(SOURCE.findall(text)))


def bind(spark: SparkSession, text: str, sources: Mapping[str, DataFrame]) -> tuple[DataFrame | None, list[tuple[str, str, str]]]:
    """(the text's frame, analysed but not run, and no finding) or (None, findings)."""
    named = sources_of(text)
    missing = [("unknown source", name, f"known: {', '.join(sorted(sources))}") for name in named if name not in sources]
    if missing:
        return None, missing
    # other braces are the text's own; values never enter the text
    plain = SOURCE.sub(lambda m: "\0" + str(named.index(m[1])) + "\0", text).replace("{", "{{").replace("}", "}}")
    ready = re.sub("\0(\\d+)\0", r"{source_\1}", plain)
    try:
        return spark.sql(ready, **{f"source_{i}": sources[name] for i, name in enumerate(named)}), []
    except ParseException as error:
        return None, [("not SQL", error.getCondition() or "", str(error).splitlines()[0])]
    except AnalysisException as error:
        return None, [("not analysed", error.getCondition() or "", str(error).splitlines()[0])]


def report(spark: SparkSession, text: str, sources: Mapping[str, DataFrame]) -> DataFrame:
    """The text's rows; an error that lists all findings where there are any."""
    frame, findings = bind(spark, text, sources)
    if frame is None:
        raise ValueError("; ".join(" ".join(f) for f in findings))
    return frame


def findings(spark: SparkSession, texts: Mapping[str, str], sources: Mapping[str, DataFrame]) -> DataFrame:
    """(report, finding, subject, detail) for each fault of the texts; no row of any source is read."""
    rows = [(name, *f) for name, text in texts.items() for f in bind(spark, text, sources)[1]]
    return spark.createDataFrame(rows, f"report string, {FINDINGS}")
