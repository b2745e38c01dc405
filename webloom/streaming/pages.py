"""Pages as a stream: the fetch chain has no state, so it reads a stream of recorded responses as it reads a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.operators.fetch import fetch_responses
from webloom.schemas import HTTP_RESPONSE


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Recorded responses as they are added to a folder of Parquet files."""
    return spark.readStream.schema(HTTP_RESPONSE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def fetched(responses: DataFrame, rendered: DataFrame | None = None, raw: bool = False) -> DataFrame:
    """(url, final_url, markdown, used_raw_fallback, error) of a stream or table of responses; rendered pages are a
    table."""
    asked = responses.select("*", F.lit(False).alias("js"), F.lit(raw).alias("raw"))
    return fetch_responses(asked, rendered=rendered).select("url", "final_url", "markdown", "used_raw_fallback", "error")


def start(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Runs until what is there is done; started again, it goes on from its checkpoint."""
    return fetched(page_stream(spark, source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
