"""Indices by name: metadata, patterns, aliases, templates, policies and pipelines, over DataFrames kept as Parquet under one root.

A write makes a new folder and then swaps the metadata to it, so a failed or cancelled write leaves the index as it was.  Writes of few documents add a
delta: the new rows of the _ids they touch, or marks that they are gone, which reads merge over the base.  After MOST_DELTAS of them, or when they are
no longer small, the index is written anew.  Folders that a write replaces stay for GRACE seconds, for those who still read them.

With the setting index.postings, a list of text fields, a full write also makes the inverted index of those fields; requests use it as long as no delta is over it.
"""

from __future__ import annotations

import fnmatch
import json
import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle, mutate, scripts
from ..operators.mapping import Mapping
from ..plans import dsl, search
from ..plans.ast import ParsingError
from ..plans.compile import Fields, compile
from . import postings as _postings
from . import storage

_NAME = re.compile(r"[a-zA-Z0-9\-.][a-zA-Z0-9_\-.]*")
#: Indices that one request may address, and operations of one bulk request.
MOST_INDICES, MOST_OPS = 1000, 1000
#: Deltas over a base at most; rows of a write up to which it is a delta; seconds for which replaced folders stay; bulk requests that run at a time.
MOST_DELTAS, DELTA_ROWS, GRACE, IN_FLIGHT = 8, 100_000, 600.0, 64


class Missing(KeyError):
    """An index, alias or entry that is not there."""


class Conflict(ValueError):
    """A write that the current state refuses."""


@dataclass
class IndexMeta:
    name: str
    created_at: float
    mapping: Mapping = field(default_factory=Mapping)
    settings: dict = field(default_factory=dict)
    path: str | None = None
    frame: DataFrame | None = None
    open: bool = True
    lifecycle: dict | None = None
    deltas: list[str] = field(default_factory=list)
    postings: str | None = None

    def to_json(self) -> dict:
        return {"name": self.name, "created_at": self.created_at, "mapping": self.mapping.to_json(), "settings": self.settings, "path": self.path, "open": self.open, "lifecycle": self.lifecycle, "deltas": self.deltas, "postings": self.postings}


def valid_name(name: str) -> str:
    if not name or len(name) > 255 or not _NAME.fullmatch(name):
        raise ParsingError(f"invalid_index_name_exception: [{name}]")
    return name


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{storage.scratch(spark)}/catalog-{uuid.uuid4().hex}"
        self.indices: dict[str, IndexMeta] = {}
        self.aliases: dict[str, dict[str, dict]] = {}  # alias -> index -> options
        self.templates: dict[str, dict] = {}
        self.components: dict[str, dict] = {}
        self.policies: dict[str, dict] = {}
        self.pipelines: dict[str, dict] = {}
        self.repositories: dict[str, dict] = {}
        self.retired: list[tuple[float, str]] = []
        self.flights = threading.BoundedSemaphore(IN_FLIGHT)
        self.cache = search.ResultCache()
        self.tasks = lifecycle.Tasks(spark)

    # indices

    def create(self, name: str, body: dict | None = None, df: DataFrame | None = None, key: str | None = None, now: float | None = None) -> IndexMeta:
        """A new index, with what its templates say; df registers rows in place, without a copy."""
        valid_name(name)
        if name in self.indices or name in self.aliases:
            raise Conflict(f"resource_already_exists_exception: [{name}]")
        body = self.simulate(name, body)
        m = IndexMeta(name, time.time() if now is None else now, Mapping(body.get("mappings")), dict(body.get("settings") or {}))
        if df is not None:
            m.frame = mutate.versioned(search.identified(df, key))
        self.indices[name] = m
        for alias, options in (body.get("aliases") or {}).items():
            self.add_alias(alias, name, **(options or {}))
        return m

    def meta(self, name: str) -> IndexMeta:
        if name not in self.indices:
            raise Missing(f"index_not_found_exception: [{name}]")
        return self.indices[name]

    def exists(self, name: str) -> bool:
        return name in self.indices or name in self.aliases

    def drop(self, pattern: str) -> list[str]:
        names = [pattern] if pattern in self.indices else self.resolve(pattern, aliases=False)
        for n in names:
            m = self.indices.pop(n)
            for members in self.aliases.values():
                members.pop(n, None)
            self.cache.invalidate(n)
            for p in (m.path, m.postings, *m.deltas):
                if p:
                    storage.remove(self.spark, p)
        self.aliases = {a: x for a, x in self.aliases.items() if x}
        return names

    def frame(self, name: str) -> DataFrame:
        m = self.meta(name)
        if not m.open:
            raise Conflict(f"index_closed_exception: [{name}]")
        if m.frame is None:
            m.frame = self.spark.read.parquet(m.path) if m.path else self.spark.createDataFrame([], "_id string, _seq_no bigint, _primary_term bigint, _version bigint")
            if m.deltas:
                m.frame = self._merged_frame(m.frame, m.deltas)
        return m.frame

    def _merged_frame(self, base: DataFrame, deltas: list[str]) -> DataFrame:
        """The base without the _ids of the deltas, and the last row of each of these that is not gone.  Deltas are few and small: their _ids are broadcast."""
        every = None
        for k, p in enumerate(deltas):
            d = self.spark.read.parquet(p).withColumn("__delta", F.lit(k))
            if every is None:
                every = d
            else:
                a, b = mutate.aligned(every, d)
                every = a.unionByName(b)
        fields = [c for c in every.columns if c not in ("_id", "__delta")]
        last = every.groupBy("_id").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in fields)), "__delta").alias("x")).select("_id", "x.*")
        a, b = mutate.aligned(base.join(F.broadcast(last.select("_id")), "_id", "left_anti"), last.where("not _deleted").drop("_deleted"))
        return a.unionByName(b)

    def _retire(self, *paths: str | None) -> None:
        """Folders that are no longer the index's; they go GRACE seconds later, with some later write or vacuum()."""
        now = time.time()
        self.retired += [(now, p) for p in paths if p]
        self.vacuum(GRACE)

    def vacuum(self, older_than: float = 0.0) -> int:
        """Removes replaced folders that were replaced so many seconds ago or more."""
        now = time.time()
        due = [p for at, p in self.retired if now - at >= older_than]
        self.retired = [(at, p) for at, p in self.retired if now - at < older_than]
        for p in due:
            storage.remove(self.spark, p)
        return len(due)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """df becomes the index's rows."""
        m = self.meta(name)
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        writer = df.drop("_index").write
        for f in ("_id", *m.settings.get("index.bloom_fields", ())):  # point lookups skip row groups by these
            writer = writer.option(f"parquet.bloom.filter.enabled#{f}", "true")
        writer.parquet(path)
        rows = self.spark.read.parquet(path)
        indexed = [f for f in m.settings.get("index.postings", ()) if f in rows.columns]
        postings = f"{path}-postings" if indexed else None
        if postings:
            _postings.build(rows, indexed, postings)
        old = (m.path, m.postings, *m.deltas)
        m.path, m.postings, m.deltas, m.frame = path, postings, [], rows
        self.cache.invalidate(name)
        self._retire(*old)
        return m.frame

    def _touch(self, name: str, before: DataFrame, after: DataFrame, touched: DataFrame) -> None:
        """A delta: of the _ids touched, after has the rows that are there now.  before gives the columns that after may lack."""
        m = self.meta(name)
        here = after.drop("_index").withColumn("_deleted", F.lit(False))
        gone = touched.select("_id").distinct().join(after.select("_id"), "_id", "left_anti").withColumn("_deleted", F.lit(True))
        a, b = mutate.aligned(here, gone)
        path = f"{self.root}/{name}/delta-{uuid.uuid4().hex}"
        a.unionByName(b).coalesce(1).write.parquet(path)
        m.deltas, m.frame = [*m.deltas, path], None
        self.cache.invalidate(name)
        if len(m.deltas) > MOST_DELTAS:
            self.write(name, self.frame(name))

    def _small(self, name: str, ids: DataFrame) -> bool:
        """Whether a write of these _ids is a delta."""
        return self.meta(name).path is not None and ids.limit(DELTA_ROWS + 1).count() <= DELTA_ROWS

    def postings(self, pattern: str) -> _postings.Postings | None:
        """The inverted index of a pattern that is one index without deltas or alias filters."""
        names = self.resolve(pattern)
        m = self.indices[names[0]] if len(names) == 1 else None
        if m is None or m.postings is None or m.deltas or names[0] in self._alias_filters(pattern):
            return None
        return _postings.Postings(self.spark, m.postings)

    def compact(self, name: str, files: int = 1) -> None:
        self.write(name, self.frame(name).coalesce(files))

    def segments(self, name: str) -> list[dict]:
        """The folders that make up an index: its base, its deltas in order, its postings."""
        m = self.meta(name)
        found = [("base", m.path), *(("delta", p) for p in m.deltas), ("postings", m.postings)]
        return [{"kind": k, "path": p, "size_in_bytes": storage.size(self.spark, p)} for k, p in found if p]

    def close(self, name: str) -> None:
        self.meta(name).open = False

    def open(self, name: str) -> None:
        self.meta(name).open = True

    def update_settings(self, name: str, settings: dict) -> None:
        self.meta(name).settings.update(settings)

    def put_mapping(self, name: str, body: dict) -> None:
        """Adds fields; a field that is there keeps its type."""
        m, new = self.meta(name), Mapping(body)
        clash = [f for f, t in new.properties.items() if m.mapping.properties.get(f, t) != t]
        if clash:
            raise Conflict(f"illegal_argument_exception: mapper for {clash} cannot be changed")
        m.mapping.properties |= new.properties
        if "dynamic" in body:
            m.mapping.dynamic = new.dynamic

    def refresh(self, name: str) -> None:
        m = self.meta(name)
        if m.path:
            self.spark.catalog.refreshByPath(m.path)
            m.frame = None
        self.cache.invalidate(name)

    flush = clear_cache = refresh

    def store_bytes(self, name: str) -> int:
        m = self.meta(name)
        return sum(storage.size(self.spark, p) for p in (m.path, *m.deltas) if p)

    def stats(self, name: str) -> dict:
        return {"docs": {"count": self.count(name)}, "store": {"size_in_bytes": self.store_bytes(name)}}

    def cat_indices(self) -> DataFrame:
        """index, status, docs_count, store_size of each index; counts come from one union, not from a job each."""
        names = [n for n, m in self.indices.items() if m.open]
        counted: dict[str, int] = {}
        if names:
            rows = [self.frame(n).select(F.lit(n).alias("index")) for n in names]
            every = rows[0]
            for r in rows[1:]:
                every = every.unionAll(r)
            counted = {r["index"]: r["count"] for r in every.groupBy("index").count().collect()}  # a row per index
        return self.spark.createDataFrame([(n, "open" if m.open else "close", counted.get(n, 0), self.store_bytes(n)) for n, m in sorted(self.indices.items())], "index string, status string, docs_count bigint, store_size bigint")

    def health(self) -> dict:
        empty = self.cat_indices().where("docs_count = 0").count()
        return {"status": "yellow" if empty else "green", "number_of_nodes": 1, "number_of_data_nodes": 1, "unassigned_shards": empty, "timed_out": False}

    def nodes(self) -> list[dict]:
        sc = self.spark.sparkContext
        return [{"name": sc.appName, "version": sc.version, "master": "*", "role": "driver", "parallelism": sc.defaultParallelism}]

    # names

    def resolve(self, pattern: str = "_all", aliases: bool = True) -> list[str]:
        """Indices that a comma list of names, aliases, globs and -exclusions means, in order; an exclusion wins wherever it stands."""
        found: set[str] = set()
        gone: set[str] = set()
        for part in (pattern or "_all").split(","):
            p = part.strip()
            minus = p.startswith("-")
            p = p[1:] if minus else p
            if p in ("_all", "*", ""):
                hit = set(self.indices)
            elif "*" in p:
                hit = set(fnmatch.filter(self.indices, p.replace("[", "[[]").replace("?", "[?]")))
                hit |= {n for a in fnmatch.filter(self.aliases, p) for n in self.aliases[a]} if aliases else set()
            elif p in self.indices:
                hit = {p}
            elif aliases and p in self.aliases:
                hit = set(self.aliases[p])
            elif minus:
                hit = set()
            else:
                raise Missing(f"index_not_found_exception: [{p}]")
            (gone if minus else found).update(hit)
        names = sorted(found - gone)
        if len(names) > MOST_INDICES:
            raise ParsingError(f"illegal_argument_exception: more than {MOST_INDICES} indices")
        return names

    def scan(self, pattern: str = "_all") -> DataFrame:
        """Rows of all indices of the pattern, with _index, aliases' filters applied; types that differ widen."""
        names = self.resolve(pattern)
        if not names:
            return self.spark.createDataFrame([], "_id string, _index string")
        filters = self._alias_filters(pattern)
        out = None
        for n in names:
            df = self.frame(n).withColumn("_index", F.lit(n))
            if n in filters:
                df = df.where(compile(dsl.parse(filters[n]), Fields(df, self.indices[n].mapping.text_types())))
            if out is None:
                out = df
            else:
                a, b = mutate.aligned(out, df)
                out = a.unionByName(b)
        return out

    def _alias_filters(self, pattern: str) -> dict[str, dict]:
        plain, by = set(), {}
        for p in pattern.split(","):
            for n, o in self.aliases.get(p.strip(), {}).items():
                if o.get("filter"):
                    by.setdefault(n, []).append(o["filter"])
                else:
                    plain.add(n)
            if p.strip() in self.indices:
                plain.add(p.strip())
        return {n: f[0] if len(f) == 1 else {"bool": {"should": f}} for n, f in by.items() if n not in plain}

    def mapping_of(self, pattern: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for n in self.resolve(pattern):
            out |= self.indices[n].mapping.text_types()
        return out

    # aliases

    def add_alias(self, alias: str, index: str, filter: dict | None = None, is_write_index: bool = False, **_) -> None:  # noqa: A002
        self.meta(index)
        if alias in self.indices:
            raise Conflict(f"invalid_alias_name_exception: [{alias}] is an index")
        members = self.aliases.setdefault(valid_name(alias), {})
        if is_write_index:
            for o in members.values():
                o["is_write_index"] = False
        members[index] = {"filter": filter, "is_write_index": is_write_index}

    def remove_alias(self, alias: str, index: str) -> None:
        if index not in self.aliases.get(alias, {}):
            raise Missing(f"aliases_not_found_exception: [{alias}]")
        del self.aliases[alias][index]
        if not self.aliases[alias]:
            del self.aliases[alias]

    def update_aliases(self, actions: list[dict]) -> None:
        """All or none of the add and remove actions."""
        before = {a: {n: dict(o) for n, o in x.items()} for a, x in self.aliases.items()}
        try:
            for a in actions:
                (kind, o), = a.items()
                for n in self.resolve(o["index"], aliases=False):
                    if kind == "add":
                        self.add_alias(o["alias"], n, o.get("filter"), bool(o.get("is_write_index")))
                    elif kind == "remove":
                        self.remove_alias(o["alias"], n)
                    else:
                        raise ParsingError(f"parsing_exception: alias action [{kind}]")
        except Exception:
            self.aliases = before
            raise

    def switch_alias(self, alias: str, old: str, new: str) -> None:
        self.update_aliases([{"remove": {"alias": alias, "index": old}}, {"add": {"alias": alias, "index": new}}])

    def move_aliases(self, old: str, new: str) -> None:
        for members in self.aliases.values():
            if old in members:
                members[new] = members.pop(old)

    def write_index(self, name: str) -> str:
        """The index that writes to a name go to."""
        if name in self.indices:
            return name
        members = self.aliases.get(name)
        if not members:
            raise Missing(f"index_not_found_exception: [{name}]")
        chosen = [n for n, o in members.items() if o.get("is_write_index")] or list(members)
        if len(chosen) != 1:
            raise Conflict(f"illegal_argument_exception: alias [{name}] has no write index")
        return chosen[0]

    # templates

    def put_template(self, name: str, body: dict) -> None:
        if not body.get("index_patterns"):
            raise ParsingError("parsing_exception: a template needs index_patterns")
        for c in body.get("composed_of") or ():
            if c not in self.components:
                raise Missing(f"component template [{c}]")
        self.templates[name] = body

    def _entry(self, kind: str, name: str) -> dict:
        found = getattr(self, kind)
        if name not in found:
            raise Missing(f"resource_not_found_exception: {kind} [{name}]")
        return found[name]

    def _delete_entry(self, kind: str, name: str) -> None:
        self._entry(kind, name)
        del getattr(self, kind)[name]

    def get_template(self, name: str) -> dict:
        return self._entry("templates", name)

    def delete_template(self, name: str) -> None:
        self._delete_entry("templates", name)

    def put_component(self, name: str, body: dict) -> None:
        if not isinstance(body.get("template"), dict):
            raise ParsingError("parsing_exception: a component template needs template")
        self.components[name] = body

    def get_component(self, name: str) -> dict:
        return self._entry("components", name)

    def delete_component(self, name: str) -> None:
        self._entry("components", name)
        users = sorted(t for t, b in self.templates.items() if name in (b.get("composed_of") or ()))
        if users:
            raise Conflict(f"illegal_argument_exception: component [{name}] is used by {users}")
        del self.components[name]

    def put_policy(self, name: str, body: dict) -> None:
        phases = body.get("policy", body).get("phases")
        if not isinstance(phases, dict) or not set(phases) <= set(lifecycle.PHASES):
            raise ParsingError(f"parsing_exception: a policy needs phases of {list(lifecycle.PHASES)}")
        for p in phases.values():
            lifecycle.seconds(p.get("min_age"))
        self.policies[name] = body

    def get_policy(self, name: str) -> dict:
        return self._entry("policies", name)

    def delete_policy(self, name: str) -> None:
        self._entry("policies", name)
        users = sorted(n for n, m in self.indices.items() if m.settings.get("index.lifecycle.name") == name)
        if users:
            raise Conflict(f"illegal_argument_exception: policy [{name}] is used by {users}")
        del self.policies[name]

    def put_pipeline(self, name: str, body: dict) -> None:
        for p in body.get("processors") or []:
            if len(p) != 1 or not set(p) <= {"set", "rename"}:
                raise ParsingError(f"parsing_exception: unknown processor {sorted(p)}")
        self.pipelines[name] = body

    def get_pipeline(self, name: str) -> dict:
        return self._entry("pipelines", name)

    def delete_pipeline(self, name: str) -> None:
        self._delete_entry("pipelines", name)

    def put_repository(self, name: str, location: str) -> None:
        """A folder for snapshots, by name."""
        if not location:
            raise ParsingError("parsing_exception: a repository needs a location")
        self.repositories[valid_name(name)] = {"type": "fs", "settings": {"location": location}}

    def get_repository(self, name: str) -> dict:
        return self._entry("repositories", name)

    def delete_repository(self, name: str) -> None:
        """Forgets the repository; its snapshots stay where they are."""
        self._delete_entry("repositories", name)

    def location(self, repository: str) -> str:
        """The folder of a repository's name; a path stands for itself."""
        return self.repositories[repository]["settings"]["location"] if repository in self.repositories else repository

    def simulate(self, name: str, body: dict | None = None) -> dict:
        """mappings, settings and aliases of a new index: component templates, then the matching template of highest priority, then body."""
        hits = [t for t in self.templates.values() if any(fnmatch.fnmatchcase(name, p) for p in ([t["index_patterns"]] if isinstance(t["index_patterns"], str) else t["index_patterns"]))]
        layers = []
        if hits:
            t = max(hits, key=lambda t: t.get("priority", 0))
            layers = [self.components[c].get("template", {}) for c in t.get("composed_of") or () if c in self.components] + [t.get("template", {})]
        out: dict = {}
        for layer in [*layers, body or {}]:
            out = _merged(out, layer)
        return out

    # documents

    def get(self, index: str, doc_id: str) -> dict | None:
        rows = self.frame(index).where(F.col("_id") == str(doc_id)).limit(1).collect()
        if not rows:
            return None
        r = rows[0].asDict(recursive=True)
        return {"_index": index, "_id": r.pop("_id"), **{k: r.pop(k) for k in mutate.VERSIONS if k in r}, "found": True, "_source": r}

    def has(self, index: str, doc_id: str) -> bool:
        return bool(self.frame(index).where(F.col("_id") == str(doc_id)).limit(1).count())

    def put(self, index: str, docs: DataFrame, pipeline: str | None = None, order: str | None = None) -> DataFrame:
        """Upserts docs (with _id, or ids are made) after the pipeline and the mapping's validation; returns the rejected ones."""
        name = self.write_index(index)
        if "_id" not in docs.columns:
            docs = docs.withColumn("_id", F.expr("uuid()"))
        if pipeline:
            docs = scripts.run_pipeline(docs, self.pipeline(pipeline))
        mapping = self.meta(name).mapping
        known = docs.drop(order) if order and order not in mapping.properties else docs
        marked = docs.withColumn("_error", mapping.problem(known))
        good, bad = marked.where("_error is null").drop("_error"), marked.where("_error is not null")
        if mapping.dynamic == "strict":  # in rows that passed, such fields are null
            good = good.drop(*[c for c in mapping.unknown_fields(known.columns)])
        before = self.frame(name)
        if self._small(name, good.select("_id")):
            good = storage.settled(good)  # its ids are read again
            ids = F.broadcast(good.select("_id").distinct())  # at most DELTA_ROWS
            self._touch(name, before, mutate.upsert(before.join(ids, "_id", "left_semi"), good, order), ids)
        else:
            self.write(name, mutate.upsert(before, good, order))
        return bad

    def pipeline(self, name: str) -> dict:
        return self._entry("pipelines", name)

    def simulate_pipeline(self, pipeline: str | dict, docs: DataFrame) -> DataFrame:
        """docs as the pipeline would leave them."""
        return scripts.run_pipeline(docs, self.pipeline(pipeline) if isinstance(pipeline, str) else pipeline)

    def suggest(self, pattern: str, body: dict) -> dict[str, DataFrame]:
        """Suggestions from the dictionary of all indices of the pattern together, so that no text comes twice."""
        from ..operators import suggest

        return suggest.suggest(self.postings_of(pattern, body) or self.scan(pattern), body)

    def postings_of(self, pattern: str, body: dict) -> _postings.Postings | None:
        """The postings, if they have all fields that the suggestions of body name."""
        p = self.postings(pattern)
        named = {o["field"] for s in body.values() if isinstance(s, dict) for o in s.values() if isinstance(o, dict) and "field" in o}
        return p if p is not None and named <= set(p.fields) else None

    def bulk(self, ops: DataFrame, index: str | None = None, most: int | None = MOST_OPS) -> DataFrame:
        """Applies bulk operations (mutate.bulk's columns and, unless index is given, _index); returns a result per line.  most=None lifts the limit of a request.

        At most IN_FLIGHT requests run at a time; more are refused, not queued.
        """
        if not self.flights.acquire(blocking=False):
            raise Conflict(f"es_rejected_execution_exception: {IN_FLIGHT} bulk requests are running")
        try:
            return self._bulk(ops, index, most)
        finally:
            self.flights.release()

    def _bulk(self, ops: DataFrame, index: str | None, most: int | None) -> DataFrame:
        ops = storage.settled(ops)  # made ids must be the same in each reading
        if most is not None and ops.limit(most + 1).count() > most:
            raise ParsingError(f"request_entity_too_large: more than {most} operations")
        names = [index] if index else sorted(r[0] for r in ops.select("_index").distinct().limit(MOST_INDICES + 1).collect())
        results = None
        for n in names:
            target = self.write_index(n) if self.exists(n) else self.create(n).name
            mine = ops if index else ops.where(F.col("_index") == n)
            before, path = self.frame(target), f"{self.root}/_results/{uuid.uuid4().hex}"
            small = self._small(target, mine.select("_id"))
            if small:
                ids = F.broadcast(mine.select("_id").distinct())  # at most DELTA_ROWS
                after, r = mutate.bulk(before.join(ids, "_id", "left_semi"), mine.drop("_index"))
            else:
                after, r = mutate.bulk(before, mine.drop("_index"))
            r.withColumn("_index", F.lit(target)).write.parquet(path)  # before the swap: the plan reads what the index was
            if small:
                self._touch(target, before, after, ids)
            else:
                self.write(target, after)
            r = self.spark.read.parquet(path)
            results = r if results is None else results.unionByName(r)
        return results

    def delete_by_query(self, index: str, query: dict | None) -> dict:
        name = self.write_index(index)
        left, counts = mutate.delete_by_query(self.frame(name), query, self.meta(name).mapping.text_types())
        out = counts.first().asDict()
        self.write(name, left)
        return out | {"batches": 1, "version_conflicts": 0, "failures": []}

    def update_by_query(self, index: str, query: dict | None, script) -> dict:
        name = self.write_index(index)
        rows, counts = mutate.update_by_query(self.frame(name), query, script, self.meta(name).mapping.text_types())
        out = counts.first().asDict()
        self.write(name, rows)
        return out | {"batches": 1, "version_conflicts": 0, "failures": []}

    def reindex(self, source: str, dest: str, **options) -> dict:
        if isinstance(options.get("pipeline"), str):
            options["pipeline"] = self.pipeline(options["pipeline"])
        if not self.exists(dest):
            self.create(dest)
        name = self.write_index(dest)
        rows = mutate.reindex(self.scan(source), self.frame(name), mapping=self.mapping_of(source), **options)
        return {"total": self.write(name, rows).count()}

    # search

    def search(self, pattern: str = "_all", body: dict | None = None, cached: bool = False) -> dict:
        names = self.resolve(pattern)
        key = search.ResultCache.key([pattern, *names], body)
        if cached and (hit := self.cache.get(key)) is not None:
            return hit
        out = search.search(self.scan(pattern), body, self.mapping_of(pattern), self.postings(pattern))
        if cached:
            self.cache.put(key, names, out)
        return out

    def count(self, pattern: str = "_all", query: dict | None = None) -> int:
        return search.count(self.scan(pattern), query, self.mapping_of(pattern))

    def scroll(self, pattern: str, body: dict | None = None, size: int = 1000):
        return search.scroll(self.scan(pattern), body, self.mapping_of(pattern), size)

    def sql(self, text: str) -> DataFrame:
        from ..plans import sqlsubset

        index = sqlsubset.parse(text).index
        return sqlsubset.run(text, self.scan, self.mapping_of(index) | {f: "keyword" for f, t in self.mapping_of(index).items() if t == "keyword"})

    def save(self) -> None:
        """Metadata beside the data, so that load() finds everything again."""
        state = {"indices": {n: m.to_json() for n, m in self.indices.items()}, **{k: getattr(self, k) for k in ("aliases", "templates", "components", "policies", "pipelines", "repositories")}}
        storage.write_text(self.spark, f"{self.root}/_catalog.json", json.dumps(state))

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> "Catalog":
        c = cls(spark, root)
        state = json.loads(storage.read_text(spark, f"{root}/_catalog.json"))
        for n, m in state.pop("indices").items():
            c.indices[n] = IndexMeta(n, m["created_at"], Mapping(m["mapping"]), m["settings"], m["path"], None, m["open"], m["lifecycle"], m.get("deltas") or [], m.get("postings"))
        for k, v in state.items():
            setattr(c, k, v)
        return c


def _merged(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
