"""Documents of a remote analysis service, as a Python data source: one partition for each application."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The documents that an application has.
PARTS = ("manifest", "permissions", "components", "detections", "indicators")


class AppPartition(InputPartition):
    def __init__(self, app: str):
        self.app = app


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.apps, self.parts, self.timeout = options["url"].rstrip("/"), options["apps"].split(","), options.get("parts", ",".join(PARTS)).split(","), float(options.get("timeout", 30))

    def partitions(self):
        return [AppPartition(a) for a in self.apps if a]

    def read(self, partition):
        for part in self.parts:
            with urllib.request.urlopen(f"{self.base}/{partition.app}/{part}", timeout=self.timeout) as answer:
                yield partition.app, part, json.dumps(json.load(answer))


class RemoteAnalyses(DataSource):
    """spark.dataSource.register(RemoteAnalyses); spark.read.format("remote_analyses").option("url", ...).option("apps", "a,b")."""

    @classmethod
    def name(cls):
        return "remote_analyses"

    def schema(self):
        return "analysis_id string, part string, document string"

    def reader(self, schema):
        return RemoteReader(self.options)
