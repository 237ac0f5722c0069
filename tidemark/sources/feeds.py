"""Release times from the three public feed formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def release_times(feeds: DataFrame) -> DataFrame:
    """(type, id, at_ms) of raw feeds (type, id, body): npm `time` maps, PyPI `releases` maps of files, GitHub lists of releases.

    What isn't JSON of its format, and times that aren't timestamps, give no rows.
    """

    def millis(c: Column) -> Column:
        return F.unix_millis(F.try_to_timestamp(c))

    npm = feeds.filter("type = 'npm'").select("type", "id", F.explode(F.from_json("body", "time map<string,string>")["time"]).alias("name", "t")).filter(~F.col("name").isin("created", "modified"))
    pypi = feeds.filter("type = 'pypi'").select("type", "id", F.explode(F.flatten(F.map_values(F.from_json("body", "releases map<string,array<struct<upload_time_iso_8601:string>>>")["releases"]))).alias("f")).select("type", "id", F.col("f.upload_time_iso_8601").alias("t"))
    github = feeds.filter("type = 'github'").select("type", "id", F.explode(F.from_json("body", "array<struct<published_at:string>>")).alias("r")).select("type", "id", F.col("r.published_at").alias("t"))
    return npm.select("type", "id", "t").unionByName(pypi).unionByName(github).select("type", "id", millis(F.col("t")).alias("at_ms")).filter("at_ms is not null")
