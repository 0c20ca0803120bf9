"""Tables by key that are merged when read: a change writes its own rows only, a manifest says which files count, and buckets are compacted one by one."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_GONE, _PART, _BUCKET = "_gone", "_c", "_b"
_HIDDEN = f"{_GONE} boolean, {_PART} string, {_BUCKET} int"


class MergeTable:
    """Rows by a key under one path.

    path/data/_c=<change>/_b=<bucket>/ holds the rows of one change (put rows, or keys that are gone), by a hash of the key. path/manifest/<version>.json names, for each bucket, its compacted folder and the
    version that it holds, and the changes behind it. A version is committed by one rename that doesn't overwrite: of two writers the slower one commits on top of the other. So a crash at any step leaves the
    version before, and files without a manifest are never read. Stores without such a rename (plain object stores) take one writer at a time.

    A change costs its batch. A read scans the compacted files, without shuffling them, against the keys that changed since; `compact` bounds those. Null keys are one key. Of several rows of a key in one batch
    the greatest by `order`, then by a hash of the row, stays. Later changes win. New columns are null in older rows; a column that changes its type is refused.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # Manifests.

    def _store(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, the oldest first."""
        top, fs = self._store(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict | None:
        every = self.versions()
        if not every or (version is not None and version not in every):
            return None
        p, fs = self._store(f"{self.path}/manifest/{every[-1] if version is None else version:020d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change: Callable[[dict], dict | None]) -> int | None:
        """Commits what change makes of the newest manifest, again on top of a version that came between; None if change gives up."""
        jvm = self.spark.sparkContext._jvm
        while True:
            now = self._manifest() or {"version": 0, "key": self.key, "buckets": self.buckets, "schema": None, "base": {}, "changes": []}
            new = change(json.loads(json.dumps(now)))
            if new is None:
                return None
            new["version"] = now["version"] + 1
            draft, fs = self._store(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            out.writeBytes(json.dumps(new))
            out.close()
            final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{new['version']:020d}.json")
            kinds = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, kinds)
                return new["version"]
            except Exception as e:
                fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e):
                    raise

    # Changes.

    def _row_order(self, df: DataFrame, order: str | None) -> Column:
        types = dict(df.dtypes)
        whole = F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if "map<" in types[c] or "variant" in types[c] else F.col(f"`{c}`") for c in df.columns])
        return F.struct(*([F.col(f"`{order}`").alias("o")] if order else []), whole.alias("h"))

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, list[int]]:
        """Files of a change by bucket, and the buckets that it has rows in. Every file of a bucket comes from one task of that bucket."""
        made = uuid.uuid4().hex
        x = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(buckets)).cast("int"))
        x.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{_PART}={made}")
        top, fs = self._store(f"{self.path}/data/{_PART}={made}")
        return made, sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top) if s.getPath().getName().startswith(f"{_BUCKET}="))

    def _change(self, rows: DataFrame, fields: StructType | None) -> int | None:
        made, held = self._write(rows, (self._manifest() or {"buckets": self.buckets})["buckets"])

        def add(m: dict) -> dict:
            if fields is not None:
                m["schema"] = _joined(m["schema"], fields)
            if held:
                m["changes"].append({"c": made, "seq": m["version"] + 1, "b": held})
            return m

        return self._commit(add)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Puts rows in by key and returns the version. An empty batch is a version too."""
        if taken := [c for c in rows.columns if c in (_GONE, _PART, _BUCKET)]:
            raise ValueError(f"columns are taken: {taken}")
        _joined((self._manifest() or {"schema": None})["schema"], rows.schema)  # refused before anything is written
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        one = rows.groupBy(F.col(f"`{self.key}`").alias("_k")).agg(F.max_by(row, self._row_order(rows, order)).alias("_r")).select("_r.*")
        return self._change(one.withColumn(_GONE, F.lit(False)), rows.schema)

    def delete(self, keys: DataFrame) -> int | None:
        """Marks the keys of a table that has the key column as gone; unknown ones too. None if nothing was ever put in."""
        m = self._manifest()
        if m is None or not m["schema"]:
            return None
        kind = StructType.fromJson(m["schema"])[self.key].dataType
        return self._change(keys.select(F.col(f"`{self.key}`").cast(kind)).distinct().withColumn(_GONE, F.lit(True)), None)

    # Reading.

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given. Vacuumed versions can't be read."""
        m = self._manifest(version)
        if m is None:
            raise ValueError(f"no version {version if version is not None else ''} under {self.path}")
        return self._merged(m, None)

    def _files(self, m: dict, parts: list[tuple[str, int]]) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        hidden = StructType.fromDDL(_HIDDEN)
        whole = StructType([*schema.fields, *hidden.fields])
        paths = [f"{self.path}/data/{_PART}={c}/{_BUCKET}={b}" for c, b in parts]
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*paths) if paths else self.spark.createDataFrame([], whole)

    def _merged(self, m: dict, only: set[int] | None) -> DataFrame:
        if not m["schema"]:
            raise ValueError(f"nothing was put into {self.path}")
        names = [f["name"] for f in m["schema"]["fields"]]
        take = lambda b: only is None or b in only
        base = self._files(m, [(v["c"], int(b)) for b, v in m["base"].items() if v["c"] and take(int(b))])
        parts = [(d["c"], b, d["seq"]) for d in m["changes"] for b in d["b"] if take(b)]
        if not parts:
            return base.select(*[F.col(f"`{n}`") for n in names])
        seq = F.create_map(*[F.lit(x) for c, s in {(c, s) for c, _, s in parts} for x in (c, s)])
        new = self._files(m, [(c, b) for c, b, _ in parts])
        row = F.struct(F.col(_GONE).alias("gone"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
        last = new.groupBy(F.col(f"`{self.key}`").alias("_k")).agg(F.max_by(row, F.element_at(seq, F.col(_PART))).alias("_r"))
        old = base.join(new.select(F.col(f"`{self.key}`").alias("_k")).distinct(), F.col(f"`{self.key}`").eqNullSafe(F.col("_k")), "left_anti")
        return old.select(*[F.col(f"`{n}`") for n in names]).unionByName(last.filter("NOT _r.gone").select("_r.row.*"))

    # Upkeep.

    def pending(self) -> dict[int, int]:
        """Buckets with changes that aren't compacted, and how many."""
        m = self._manifest() or {"changes": []}
        out: dict[int, int] = {}
        for d in m["changes"]:
            for b in d["b"]:
                out[b] = out.get(b, 0) + 1
        return out

    def compact(self, least: int = 4) -> list[int]:
        """Writes each bucket that has `least` changes or more anew, without the keys that are gone; the others aren't read. Returns those buckets, none if another compaction came first."""
        m = self._manifest()
        todo = {b for b, n in self.pending().items() if n >= least} if m else set()
        if not todo:
            return []
        made, held = self._write(self._merged(m, todo).withColumn(_GONE, F.lit(False)), m["buckets"])

        def put(now: dict) -> dict | None:
            if any(now["base"].get(str(b)) != m["base"].get(str(b)) for b in todo):
                return None
            for b in todo:
                now["base"][str(b)] = {"c": made if b in held else None, "seq": m["version"]}
            for d in now["changes"]:
                if d["seq"] <= m["version"]:
                    d["b"] = [b for b in d["b"] if b not in todo]
            now["changes"] = [d for d in now["changes"] if d["b"]]
            return now

        return sorted(todo) if self._commit(put) else []

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> int:
        """Deletes versions before the last `keep`, and folders that no version left names and that are older than `hours`, as younger ones may be of a writer that hasn't committed. Returns how many folders went."""
        every = self.versions()
        for v in every[: max(0, len(every) - max(1, keep))]:
            p, fs = self._store(f"{self.path}/manifest/{v:020d}.json")
            fs.delete(p, False)
        named: set[str] = set()
        for v in self.versions():
            m = self._manifest(v)
            named |= {d["c"] for d in m["changes"]} | {b["c"] for b in m["base"].values() if b["c"]}
        top, fs = self._store(f"{self.path}/data")
        old = [s for s in (fs.listStatus(top) if fs.exists(top) else []) if s.getPath().getName().split("=")[-1] not in named and s.getModificationTime() <= (time.time() - hours * 3600) * 1000]
        return sum(fs.delete(s.getPath(), True) for s in old)


def _joined(old: dict | None, new: StructType) -> dict:
    """Both schemas' columns; all may be null."""
    fields = {f.name: StructField(f.name, f.dataType, True) for f in StructType.fromJson(old).fields} if old else {}
    for f in new.fields:
        if f.name in fields and fields[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} was {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType(list(fields.values())).jsonValue()
