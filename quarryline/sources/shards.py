"""Shards of an ordered source, committed one by one, so that a build can go on where it stopped; and typed imports.

A shard is a folder part-NNNNNN of tables; it counts once its manifest lies beside it, which is written last and under
another name first. Files go through the file system of the path, so a folder may be on any that Spark reads.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import digest, write_frozen

MANIFEST = re.compile(r"part-(\d{6})\.manifest\.json")


class Shards:
    """The shards below a folder, of one fingerprint of the build's configuration."""

    def __init__(self, spark: SparkSession, path: str, fingerprint: str) -> None:
        self.spark, self.path, self.fingerprint = spark, path.rstrip("/"), fingerprint
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self._path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _folder(self, part: int) -> str:
        return f"{self.path}/part-{part:06d}"

    def completed(self, resume: bool = False, verify: bool = True) -> list[dict]:
        """The manifests in order. They must have no gap, this fingerprint, rows that follow one another and, with
        verify, tables of the rows and digests that they name; else ValueError. What has no manifest was not committed:
        an error, or with resume it is removed."""
        names, out, start = self._names(), [], 0
        for part, name in enumerate(n for n in names if n.endswith(".manifest.json")):
            found = MANIFEST.fullmatch(name)
            if not found or int(found[1]) != part:
                raise ValueError(f"{self.path}: shard {part} is missing")
            try:
                m = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}").collect()))
                start_, end, rows, tables = m["start"], m["end"], m["rows"], m["tables"]
            except (ValueError, KeyError, TypeError) as e:
                raise ValueError(f"{name} is no manifest") from e
            if m.get("fingerprint") != self.fingerprint:
                raise ValueError(f"{name} is of another configuration")
            if start_ != start or rows < 1 or end != start + rows:
                raise ValueError(f"{name} does not follow the shard before")
            for kind, (n, sum_) in tables.items() if verify else ():
                if not self._fs.exists(self._path(f"{self._folder(part)}/{kind}")) or digest(self.spark.read.parquet(f"{self._folder(part)}/{kind}")) != (n, sum_):
                    raise ValueError(f"{kind} of shard {part} is not as its manifest says")
            start = end
            out.append(m)
        loose = [n for n in names if n.startswith("part-") and not MANIFEST.fullmatch(n) and not (re.fullmatch(r"part-\d{6}", n) and int(n[5:]) < len(out))]
        if loose and not resume:
            raise ValueError(f"{self.path} holds shards that were not committed: {loose[:3]}")
        for n in loose:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)
        return out

    def commit(self, tables: dict[str, DataFrame], start: int, rows: int) -> dict:
        """Writes the next shard: its tables, made of `rows` rows of the source from row `start`, then its manifest."""
        part = sum(1 for n in self._names() if MANIFEST.fullmatch(n))
        sums = {}
        for kind, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self._folder(part)}/{kind}")
            sums[kind] = digest(self.spark.read.parquet(f"{self._folder(part)}/{kind}"))
        m = {"part": part, "start": start, "end": start + rows, "rows": rows, "fingerprint": self.fingerprint, "tables": sums}
        partial, last = self._path(f"{self._folder(part)}.partial"), self._path(f"{self._folder(part)}.manifest.json")
        stream = self._fs.create(partial, True)
        stream.write(bytearray(json.dumps(m).encode()))
        stream.close()
        if not self._fs.rename(partial, last):
            raise ValueError(f"{last} could not be written")
        return m

    def build(self, source: DataFrame, order: str, size: int, make, resume: bool = False) -> list[dict]:
        """Commits the source in shards of `size` rows by its gapless whole-number order, after those that are there.
        make: from the rows of a shard to its tables."""
        done = self.completed(resume)
        at, n = (done[-1]["end"] if done else 0), source.count()
        while at < n:
            rows = min(size, n - at)
            self.commit(make(source.where((F.col(order) >= at) & (F.col(order) < at + rows))), at, rows)
            at += rows
        return self.completed(verify=False)

    def table(self, kind: str) -> DataFrame:
        """All committed rows of one kind."""
        parts = [m["part"] for m in self.completed(verify=False) if kind in m["tables"]]
        if not parts:
            raise ValueError(f"{self.path} holds no {kind}")
        return self.spark.read.parquet(*[f"{self._folder(p)}/{kind}" for p in parts])

    def joined(self, kind: str, out: str) -> None:
        """Writes all of one kind as one table; again with the same rows is no change, with others an error."""
        df = self.table(kind)
        write_frozen(df, out, df.schema)


def bad_examples(malformed: DataFrame, n: int = 30) -> DataFrame:
    """rows, examples: the count of malformed lines and the first n in the order of their text."""
    some = malformed.select(F.col(malformed.columns[0]).alias("line")).orderBy("line").limit(n).agg(F.sort_array(F.collect_list("line")).alias("examples"))
    return malformed.agg(F.count("*").alias("rows")).join(some)


def flag_value(c: Column) -> Column:
    """true, false, 1 and 0 in any case as a boolean; empty as null; else null too (see `typed_import`)."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("true", "1"), True).when(x.isin("false", "0"), False)


def typed_import(df: DataFrame, line: str, flags: list[str], lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of imported strings: empty ones are null, flags are booleans, lists are split at commas without
    empty items. errors (line, message) names every flag that is none; its row is not among the rows."""
    rest = [c for c in df.columns if c not in (line, *flags, *lists)]
    d = df.select(line, *[F.nullif(F.col(c), F.lit("")).alias(c) for c in df.columns if c != line])
    wrong = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & flag_value(F.col(c)).isNull(), F.concat(F.lit("Invalid "), F.lit(c))) for c in flags], F.lit(None).cast("string")))
    d = d.withColumn("_wrong", wrong)
    items = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = d.where(F.size("_wrong") == 0).select(line, *rest, *[flag_value(F.col(c)).alias(c) for c in flags], *[items(F.col(c)).alias(c) for c in lists])
    return rows, d.select(line, F.explode("_wrong").alias("message"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; lists are joined by commas, as typed_import reads them."""
    joined = [F.array_join(f.name, ",").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*joined).write.option("escape", '"').csv(path, header=True, mode="errorifexists")
