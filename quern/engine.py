"""Indexes over a folder of Parquet tables: mapping, change log, snapshots, searches, saved queries, percolation."""

from __future__ import annotations

import base64
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import loads
from quern.operators import aggs as ag
from quern.operators import percolate as pc
from quern.operators import search as se
from quern.plans import query as q
from quern.plans.mapping import LIST, Mapping, Refused
from quern.sources import documents as sd
from quern.sources.bulk import check_id, parse_bulk
from quern.streaming import changelog as cl

_STATE = cl.CHANGES


def fnv(id: str, shards: int) -> int:
    h = 2166136261
    for b in id.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % shards


class Index:
    """One index. frame: analysed documents that a caller brings (a read-only index over a table).

    The driver holds ids, versions and digests, which put the writes of requests in order; bodies are in the change log,
    a table under the engine's path (or on the driver where the engine has none)."""

    def __init__(self, engine: Engine, name: str, mapping: Mapping, settings: dict | None = None, frame: DataFrame | None = None):
        self.engine, self.name, self.mapping, self.frame = engine, name, mapping, frame
        self.settings = {"shards": 1, "gc_deletes": 86_400, "refresh_interval": 1, **(settings or {})}
        if not 1 <= self.settings["shards"] <= 1024 or not 1 <= self.settings["gc_deletes"] <= 365 * 86_400:
            raise Refused(("settings", "shards are 1 to 1024, gc_deletes 1 s to 365 d"))
        self.uid, self._held, self._saved, self._seqs, self._snapshot = f"{name}-{time.time_ns():x}", {}, {}, {}, None
        self._meta: dict[str, object] = {}
        self._bodies: dict[str, str] = {}
        self._generation = 0

    # --- tables ---

    def _log(self) -> DataFrame:
        return self.engine.spark.read.schema(_STATE).parquet(f"{self.engine.path}/{self.name}/changes-{self._generation}")

    def _record(self) -> None:
        """What reopens the index, beside its change log."""
        if self.engine.path and self.frame is None:
            queries = {k: {"query": v[0], "version": v[2], "meta": self._meta[k]} for k, v in self._saved.items()}
            what = {"uid": self.uid, "mapping": self.mapping.as_json(), "settings": self.settings, "generation": self._generation, "queries": queries}
            self.engine.note(f"{self.name}/index", json.dumps(what, ensure_ascii=False))

    def _restore(self, what: dict) -> None:
        self.uid, self._generation = what["uid"], what["generation"]
        for k, v in what["queries"].items():
            self._saved[k], self._meta[k] = (v["query"], q.parse(v["query"]), v["version"]), v["meta"]
        if self.engine.there(f"{self.name}/changes-{self._generation}"):
            last = cl.net(self._log()).withColumn("body", F.substring(F.sha2(F.col("body").cast("binary"), 256), 1, 32))
            for r in last.toLocalIterator():
                self._held[r.id] = (r.op, r.seq, r.version, bytes.fromhex(r.body) if r.body is not None else None)
            self._seqs = {r.shard: r.seq for r in self._log().groupBy("shard").agg(F.max("seq").alias("seq")).collect()}

    def compact(self, now_ms: int | None = None) -> int:
        """Rewrites the change log as the last change of each id, without deletes older than gc_deletes seconds; returns
        the ids that are forgotten. Each shard's last change stays, which is where its seqs go on."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        if not self.engine.path or not self.engine.there(f"{self.name}/changes-{self._generation}"):
            return 0
        last = cl.net(self._log()).select(*cl._names())
        ends = F.broadcast(self.engine.spark.createDataFrame(list(self._seqs.items()), "shard int, end long"))
        left = cl.pruned(last, now, 1000 * self.settings["gc_deletes"]).unionByName(last.join(ends, "shard").where("seq = end").drop("end")).dropDuplicates(["id"])
        self.engine.append(f"{self.name}/changes-{self._generation + 1}", left)
        self._generation += 1
        kept = {r.id for r in self._log().where("op = 'delete'").select("id").toLocalIterator()}
        gone = [k for k, v in self._held.items() if v[0] == "delete" and k not in kept]
        for k in gone:
            del self._held[k]
        self._record()
        self.engine.drop(f"{self.name}/changes-{self._generation - 1}")
        self._snapshot = None
        return len(gone)

    # --- documents ---

    def docs(self) -> DataFrame:
        """Live documents, analysed; built from the newest snapshot, once."""
        if self.frame is not None:
            return self.frame
        if self._snapshot is None:
            if self.engine.path and self._seqs:
                raw = cl.live(cl.net(self._log())).select("id", "body", "seq", "version")
            else:
                rows = [(k, self._bodies[k], v[1], v[2]) for k, v in self._held.items() if v[0] == "upsert"]
                raw = self.engine.spark.createDataFrame(rows, "id string, body string, seq long, version long")
            self._snapshot = self.engine.store(f"{self.name}/docs", sd.analysed(raw, self.mapping))
        return self._snapshot

    def bulk(self, raw: str | list[dict], percolate: bool = False) -> dict:
        """Applies actions in order; every item has its own status."""
        began = time.time()
        items = parse_bulk(raw) if isinstance(raw, str) else raw
        docs = [it for it in items if not it["op"].startswith("query") and not it["op"].endswith("delete") and not it.get("error")]
        if docs and self.mapping.dynamic != "false":
            bodies = self.engine.spark.createDataFrame([(it["body"], i) for i, it in enumerate(docs)], "body string, seq long")
            grown = sd.inferred(bodies, self.mapping)
            if grown.as_json() != self.mapping.as_json():
                self.mapping = grown
                self._record()
        saved = {id(it): it for it in items if it["op"].startswith("query")}
        done = cl.fold([it for it in items if id(it) not in saved], self._held, self._seqs, lambda i: fnv(i, self.settings["shards"]))
        changes = [r.pop("change") for r in done if "change" in r]
        if changes:
            now = int(time.time() * 1000)
            log = self.engine.spark.createDataFrame([(*c, now) for c in changes], _STATE)
            self.engine.append(f"{self.name}/changes-{self._generation}", log)
            if not self.engine.path:
                self._bodies |= {c[3]: c[4] for c in changes}
            self._snapshot = None
        it = iter(done)
        out = [self._save_item(saved[id(x)]) if id(x) in saved else next(it) for x in items]
        if percolate:
            written = [r["id"] for r in out if r["op"] in ("upsert", "create") and r["status"] < 300]
            found = {r["id"]: r["queries"] for r in self.percolate(ids=written)["results"] if r["found"]}
            for r in out:
                if r["id"] in found and r["op"] in ("upsert", "create"):
                    r["queries"] = found[r["id"]]
        return {"took_ms": int((time.time() - began) * 1000), "token": self.token(), "committed": dict(self._seqs), "errors": any(r["status"] >= 400 for r in out), "timed_out": False, "percolated": percolate, "items": out}

    def _save_item(self, it: dict) -> dict:
        try:
            if it["op"] == "query_delete":
                return {"op": it["op"], "id": it["id"], "status": 200 if self.delete_query(it["id"]) else 404}
            b = loads(it["body"])
            self.put_query(it["id"], b.get("query", b), b.get("meta"))
            return {"op": it["op"], "id": it["id"], "status": 200}
        except Refused as e:
            return {"op": it["op"], "id": it["id"], "status": e.status, "error": str(e)}

    def put(self, id: str, body: dict, **options) -> dict:
        check_id(id, "id")
        return self.bulk([{"op": options.pop("op_type", "upsert"), "id": id, "body": json.dumps(body, ensure_ascii=False), **options}])["items"][0]

    def delete(self, id: str, **options) -> dict:
        return self.bulk([{"op": "delete", "id": id, "body": None, **options}])["items"][0]

    def get(self, id: str) -> dict | None:
        if self.frame is not None:
            row = self.frame.where(F.col("id") == id).select("id", "body", "seq").first()
            return {"id": row.id, "body": json.loads(row.body), "seq": row.seq} if row else None
        op, seq, version, _ = self._held.get(id, (None, 0, None, None))
        if op != "upsert":
            return None
        body = self._log().where((F.col("id") == id) & (F.col("seq") == seq)).first().body if self.engine.path else self._bodies[id]
        return {"id": id, "body": json.loads(body), "seq": seq, "version": version}

    def token(self) -> str:
        """Where the index stands: its incarnation and each shard's seq."""
        return base64.urlsafe_b64encode(json.dumps([self.uid, self._seqs], sort_keys=True).encode()).decode()

    def reached(self, token: str) -> bool:
        uid, seqs = json.loads(base64.urlsafe_b64decode(token))
        return uid == self.uid and all(self._seqs.get(int(s), 0) >= n for s, n in seqs.items())

    # --- searches ---

    def search(self, body: dict | None = None, wait_for: str | None = None, now_ms: int | None = None) -> dict:
        began = time.time()
        if wait_for and not self.reached(wait_for):
            raise Refused(("wait_for", "a token of another index, or of a write that is not here"), status=409)
        now = int(time.time() * 1000) if now_ms is None else now_ms
        r = se.parse_request(body or {}, self.mapping, now)
        specs = ag.parse(r.aggs, self.mapping, now, "aggregations" if "aggregations" in (body or {}) else "aggs")
        docs = self.docs()
        rows = se.page(docs, r, self.mapping).collect() if r.size else []
        inner = se.inner_specs(r.query if r.post_filter is None else q.All((r.query, r.post_filter)), self.mapping)
        hits = se.hits_of(rows, r, inner)
        out = {"took_ms": 0, "timed_out": False, "total": se.total(docs, r, self.mapping), "hits": hits, "next": hits[-1]["sort"] if r.size and len(hits) == r.size else None}
        if specs:
            out["aggs"] = ag.run(se.matching(docs, r.query, self.mapping), docs, specs, self.mapping)
        out["took_ms"] = int((time.time() - began) * 1000)
        return out

    def count(self, body: dict | None = None, now_ms: int | None = None) -> dict:
        if more := sorted(set(body or {}) - {"query", "max_staleness"}):
            raise Refused(*[(k, "unknown member") for k in more])
        r = se.parse_request({"query": (body or {}).get("query", {"all": []}), "track_total": True}, self.mapping, int(time.time() * 1000) if now_ms is None else now_ms)
        return {"count": se.total(self.docs(), r, self.mapping)["value"], "relation": "eq", "timed_out": False}

    def fields(self, entries: int = 0) -> dict:
        """The mapping, and the commonest entries of each keyword_list, all lists in one pass."""
        if not 0 <= entries <= 1000:
            raise Refused(("entries", "0 to 1000"))
        lists = [n for n, f in self.mapping.fields.items() if f.type == LIST] if entries else []
        top: dict[str, list] = {}
        if lists:
            each = F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"`{n}__e`").alias("e")) for n in lists])
            d = self.docs().select(F.explode(each).alias("x")).select("x.f", F.explode("x.e").alias("value"))
            for n in lists:
                rows = d.where(F.col("f") == n).groupBy("value").count().orderBy(F.desc("count"), "value").limit(entries).collect()
                top[n] = [{"value": r["value"], "count": r["count"]} for r in rows]
        found = [{"name": n, "type": f.type, **({"entries": top[n]} if n in top else {})} for n, f in sorted(self.mapping.fields.items())]
        return {"dynamic": self.mapping.dynamic, "fields": found}

    # --- saved queries ---

    def put_query(self, id: str, query, meta=None) -> dict:
        check_id(id, "id")
        if meta is not None and len(json.dumps(meta)) > 16_384:
            raise Refused(("meta", "at most 16 KiB"))
        tree = q.parse(query)
        q.validate(tree, self.mapping)
        version = self._saved.get(id, (None, None, 0))[2] + 1
        self._saved[id] = (query, tree, version)
        self._meta[id] = meta
        self._record()
        return {"id": id, "version": version}

    def get_query(self, id: str) -> dict | None:
        s = self._saved.get(id)
        return {"id": id, "query": s[0], "meta": self._meta[id], "version": s[2]} if s else None

    def delete_query(self, id: str) -> bool:
        found = self._saved.pop(id, None) is not None
        if found:
            self._record()
        return found

    def list_queries(self, after: str = "", size: int = 100) -> dict:
        ids = sorted(i for i in self._saved if i > after)[:size]
        return {"queries": [self.get_query(i) for i in ids], "next": ids[-1] if len(ids) == size else None}

    def percolate(self, docs: list[dict] | None = None, ids: list[str] | None = None, now_ms: int | None = None) -> dict:
        """Matches of the documents given, then of the stored ones named."""
        began, docs, ids = time.time(), docs or [], ids or []
        if len(docs) + len(ids) > 10_000:
            raise Refused(("docs", "at most 10000 documents"))
        spark, now = self.engine.spark, int(time.time() * 1000) if now_ms is None else now_ms
        raw = spark.createDataFrame([(f"\x00{i}", json.dumps(d, ensure_ascii=False), i, None) for i, d in enumerate(docs)], "id string, body string, seq long, version long")
        given = sd.analysed(raw, self.mapping)
        if ids:
            names = spark.createDataFrame([(i,) for i in set(ids)], "id string")
            given = given.unionByName(self.docs().join(F.broadcast(names), "id", "left_semi"))
        got = pc.guard(pc.percolate(given, [(k, v[1]) for k, v in self._saved.items()], self.mapping, now))
        rows = {r.id: list(r.queries) for r in got}
        inner = {(r.id, x): json.loads(i) for r in got for x, i in zip(r.queries, r.inner) if i}
        out = [{"found": True, "queries": rows[f"\x00{i}"]} for i in range(len(docs))]
        out += [{"id": i, "found": i in rows, "queries": rows.get(i, [])} for i in ids]
        for i, r in enumerate(out):
            at = r.get("id", f"\x00{i}")
            r["matches"] = [{"id": x, "version": self._saved[x][2], **({"inner_hits": inner[at, x]} if (at, x) in inner else {})} for x in r["queries"]]
        took = time.time() - began
        return {"results": out, "took_ms": int(took * 1000), "took_us": int(took * 1e6)}


class Engine:
    """Indexes by name; tables under path."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.indexes, self._n = spark, path, {}, 0
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """A new snapshot of a table: written whole, then read by its own path."""
        if not self.path:
            return df.persist()
        self._n += 1
        at = f"{self.path}/{name}/{self._n}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def append(self, name: str, df: DataFrame) -> None:
        if self.path:
            df.write.mode("append").parquet(f"{self.path}/{name}")

    def note(self, name: str, text: str) -> None:
        """A small text under path, replaced whole."""
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}")

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def there(self, name: str) -> bool:
        fs, at = self._at(name)
        return fs.exists(at)

    def drop(self, name: str) -> None:
        fs, at = self._at(name)
        fs.delete(at, True)

    def open_index(self, name: str) -> Index:
        """An index that an engine has left under path: its mapping, settings, saved queries and writes."""
        if name in self.indexes:
            return self.indexes[name]
        if not self.path or not self.there(f"{name}/index"):
            raise Refused(("index", f"{name} is not here"), status=404)
        what = json.loads(self.spark.read.text(f"{self.path}/{name}/index", wholetext=True).first().value)
        i = Index(self, name, Mapping.of(what["mapping"]), what["settings"])
        i._restore(what)
        self.indexes[name] = i
        return i

    def create_index(self, name: str, mapping: dict | None = None, settings: dict | None = None) -> Index:
        if name in self.indexes:
            raise Refused(("index", f"{name} exists"), status=409)
        if self.path and self.there(f"{name}/index"):
            raise Refused(("index", f"{name} is under path: open it"), status=409)
        self.indexes[name] = Index(self, name, Mapping.of(mapping or {}), settings)
        self.indexes[name]._record()
        return self.indexes[name]

    def over(self, name: str, frame: DataFrame, mapping: Mapping) -> Index:
        """A read-only index over analysed columns, such as documents.from_columns gives."""
        self.indexes[name] = Index(self, name, mapping, frame=frame)
        return self.indexes[name]

    def get_index(self, name: str) -> Index:
        if name not in self.indexes:
            raise Refused(("index", f"{name} is not here"), status=404)
        return self.indexes[name]

    def delete_index(self, name: str) -> None:
        i = self.get_index(name)
        del self.indexes[name]
        if self.path and i.frame is None:
            self.drop(name)

    def list_indexes(self) -> list[str]:
        return sorted(self.indexes)

    def patch_mapping(self, name: str, fields: dict) -> dict:
        i = self.get_index(name)
        i.mapping, i._snapshot = i.mapping.merge(fields), None
        i._record()
        return i.mapping.as_json()

    def patch_settings(self, name: str, settings: dict) -> dict:
        i = self.get_index(name)
        if "shards" in settings and settings["shards"] != i.settings["shards"]:
            raise Refused(("settings.shards", "the number of shards is fixed"))
        i.settings |= settings
        i._record()
        return i.settings


