"""NDJSON bulk bodies, and JDBC tables, as change frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from quern.functions.text import loads
from quern.plans.mapping import MAX_ID, Refused

MAX_OPS, MAX_BYTES = 10_000, 4 << 20
OPS = {"index": "upsert", "upsert": "upsert", "create": "create", "delete": "delete", "query_upsert": "query_upsert", "query_delete": "query_delete"}


def check_id(id, loc: str) -> str:
    if not isinstance(id, str) or not 1 <= len(id.encode()) <= MAX_ID or "\x00" in id or id in (".", ".."):
        raise Refused((loc, "an id has 1 to 512 bytes, no NUL and is not . or .."))
    return id


def _whole(v):
    """A whole number of an action line as a plain int, which tables of changes take."""
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


def parse_bulk(raw: str) -> list[dict]:
    """Actions of an NDJSON body: op, id, body (JSON text), if_seq, version. A bad line is an error of its item."""
    lines = [x for x in raw.split("\n") if x.strip()]
    out, i = [], 0
    while i < len(lines):
        try:
            (action, meta), = loads(lines[i]).items()
            op = OPS[action]
        except (ValueError, KeyError, AttributeError):
            raise Refused((f"line {i + 1}", "an action line is {op: {_id, ...}}")) from None
        item = {"op": op, "id": meta.get("_id", meta.get("id")), "if_seq": _whole(meta.get("if_seq")), "version": _whole(meta.get("version")), "body": None, "error": None}
        i += 1
        if not op.endswith("delete"):
            if i >= len(lines):
                raise Refused((f"line {i}", "an action without its document"))
            item["body"] = lines[i]
            i += 1
            try:
                if len(item["body"].encode()) > MAX_BYTES:
                    item["error"] = "a document has at most 4 MiB"
                elif not isinstance(loads(item["body"]), dict):
                    item["error"] = "a document is a JSON object"
                else:
                    item["body"] = json.dumps(json.loads(item["body"]), ensure_ascii=False) if "\x00" in item["body"] else item["body"]
            except ValueError as e:
                item["error"] = f"not valid JSON: {e}"
        try:
            check_id(item["id"], f"items.{len(out)}.id")
        except Refused as e:
            item["error"] = str(e)
        out.append(item)
        if len(out) > MAX_OPS:
            raise Refused(("body", f"at most {MAX_OPS} operations"))
    return out


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(id, body) of files of {"id": ..., "doc": {...}} lines, in parallel."""
    return spark.read.text(path).selectExpr("get_json_object(value, '$.id') AS id", "get_json_object(value, '$.doc') AS body")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options) -> DataFrame:
    """A change log kept in a SQL database, read in ranges of a number column; needs the database's driver jar."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)
