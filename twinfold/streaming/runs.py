"""A scoring run in phases: a manifest that must stay equal, a ledger of appended batches, and a barrier between phases.

A run is a folder. `manifest` says what it scores and how: digests of the dataset and of further tables (token maps), and the settings. It
is written once; a run is resumed only under an equal one. Each phase has `rows` and `rows_rejected` (see `append`) and `ledger`, in which a batch
is entered after its rows and rejects are written, with their counts and a digest of its records. A reader sees entered batches alone. A
batch that finds its own entry was whole before the crash: it must have the same records, else the query's checkpoint isn't this run's. A
phase that follows another starts only when that one has a record for every id, and its records must carry the same values in the
fields that both have in common. `finish` seals a whole run; `verify` computes the seal again.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.digests import canonical
from ..operators.checks import Check, ValidationError, enforce
from ..operators.lineage import bad_checksums, seal
from . import append

ENTRY = "batch long, rows long, rejects long, digest string"


@dataclass(frozen=True)
class Phase:
    """schema: of its records, as DDL. after: the phase that must be whole first; same: fields that must equal that phase's."""

    name: str
    schema: str
    after: str | None = None
    same: Sequence[str] = ()


@dataclass
class Run:
    """A run in `folder` over a dataset with a unique key. tables: further tables (by name) whose content must not change between sessions."""

    spark: SparkSession
    folder: str
    dataset: DataFrame
    phases: Sequence[Phase]
    config: Mapping
    key: str = "example_id"
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]] = field(default_factory=dict)

    # ---- manifest

    def expected(self) -> dict:
        """What the manifest must say. A dataset with a repeated key raises."""
        sealed = seal(self.dataset, [self.key]).first()
        if not sealed["unique"]:
            raise ValidationError(f"the dataset has repeated values of {self.key}")
        others = {name: seal(df, keys).first()["seal"] for name, (df, keys) in self.tables.items()}
        phases = [[p.name, p.schema, p.after, list(p.same)] for p in self.phases]
        return {"dataset": sealed["seal"], "records": sealed["rows"], "tables": others, "phases": phases, "config": json.loads(json.dumps(dict(self.config)))}

    def saved(self) -> dict | None:
        found = self._text("manifest")
        return None if found is None else json.loads(found)

    def open(self, resume: bool = False) -> Run:
        """Begin the run, or resume it; a fresh run in a used folder and a resumed one with another manifest raise."""
        saved, now = self.saved(), self.expected()
        if not resume:
            if saved is not None:
                raise FileExistsError(f"{self.folder} has a run already; resume it or take another folder")
            self._put("manifest", canonical_text(now))
        elif saved is None:
            raise ValueError("only a run with its manifest can be resumed")
        elif differ := sorted(k for k in {*saved, *now} if saved.get(k) != now.get(k)):
            raise ValueError("the run can't be resumed: its manifest differs in " + ", ".join(differ))
        return self

    # ---- phases

    def phase(self, name: str) -> Phase:
        return next(p for p in self.phases if p.name == name)

    def ledger(self, name: str) -> DataFrame:
        found = append.read_or_none(self.spark, f"{self.folder}/{name}/ledger")
        return self.spark.createDataFrame([], ENTRY) if found is None else found.select("batch", "rows", "rejects", "digest")

    def records(self, name: str) -> DataFrame:
        """A phase's appended records, of entered batches alone."""
        return self._entered(name, "rows", self.phase(name).schema + ", record_sha256 string")

    def rejects(self, name: str) -> DataFrame:
        return self._entered(name, "rows_rejected", self.phase(name).schema + ", reason string")

    def _entered(self, name: str, kind: str, schema: str) -> DataFrame:
        found = append.read_or_none(self.spark, f"{self.folder}/{name}/{kind}")
        if found is None:
            return self.spark.createDataFrame([], schema + ", batch int, part int")
        return found.join(self.ledger(name).select("batch"), "batch", "left_semi")

    def admit(self, name: str) -> None:
        """Raise unless the phase ahead of this one is whole."""
        ahead = self.phase(name).after
        if ahead is not None and not append.is_complete(self.records(ahead), self.dataset, self.key):
            raise ValidationError(f"{name} starts after {ahead}, which isn't whole")

    def start(self, name: str, inbox: str, strict: bool = False) -> StreamingQuery:
        """The phase's query over the files of a folder; it stops when they are read. The run must be open."""
        if self.saved() is None:
            raise ValueError("the run isn't open")
        self.admit(name)
        phase, base = self.phase(name), f"{self.folder}/{name}"

        def merge(batch: DataFrame, number: int) -> None:
            digest = batch_digest(batch)
            entry = self.ledger(name).filter(F.col("batch") == number).first()
            if entry is not None:
                if entry["digest"] != digest:
                    raise ValidationError(f"batch {number} of {name} was entered with other records: the checkpoint isn't this run's")
                return
            if phase.after is not None:
                enforce([Check(f"differs_from_{phase.after}", self.differing(name, batch))])
            rows = append.append_batch(batch, number, self.dataset, f"{base}/rows", self.key, strict)
            counts = rows.agg(F.count_if(F.col("reason").isNull()).alias("rows"), F.count("reason").alias("rejects")).first()
            write_entry(self.spark, f"{base}/ledger", (number, counts["rows"], counts["rejects"], digest))

        source = append.stream_scores(self.spark, inbox, phase.schema)
        return source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    def differing(self, name: str, batch: DataFrame) -> DataFrame:
        """Records of the batch that differ from their example's record of the phase ahead in a field that must be the same."""
        phase = self.phase(name)
        ahead = self.records(phase.after).select(self.key, F.struct(*phase.same).alias("__ahead")) if phase.same else None
        return batch.limit(0) if ahead is None else batch.join(ahead, self.key).filter(~F.struct(*(F.col(c) for c in phase.same)).eqNullSafe(F.col("__ahead")))

    # ---- end

    def seals(self) -> dict:
        out = {}
        for p in self.phases:
            rows = self.records(p.name)
            enforce([Check(f"{p.name}_checksum", bad_checksums(rows))])
            sealed = seal(rows.drop("batch", "part", "record_sha256"), [self.key]).first()
            if not sealed["unique"]:
                raise ValidationError(f"{p.name} has repeated records")
            out[p.name] = {"records": sealed["rows"], "seal": sealed["seal"]}
        return out

    def finish(self) -> dict:
        """Seal the run once every phase is whole; a sealed one is verified instead."""
        for p in self.phases:
            if not append.is_complete(self.records(p.name), self.dataset, self.key):
                raise ValidationError(f"{p.name} isn't whole")
        if self._text("complete") is None:
            self._put("complete", canonical_text({"manifest": canonical(self.saved()), "phases": self.seals()}))
        return self.verify()

    def verify(self) -> dict:
        """The seal; raises if the run isn't sealed or its records or manifest aren't what was sealed."""
        said = self._text("complete")
        if said is None:
            raise ValidationError("the run isn't sealed")
        found = json.loads(said)
        if found != {"manifest": canonical(self.saved()), "phases": self.seals()}:
            raise ValidationError("the run isn't what was sealed")
        return found

    # ---- small documents

    def _text(self, name: str) -> str | None:
        found = append.read_or_none(self.spark, f"{self.folder}/{name}")
        return None if found is None else found.first()["value"]

    def _put(self, name: str, text: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/{name}")


def canonical_text(document: Mapping) -> str:
    return json.dumps(document, sort_keys=True, separators=(",", ":"))


def batch_digest(batch: DataFrame) -> str:
    """A digest of a batch's records, whatever their order; equal records count as often as they are there."""
    row = F.md5(F.to_json(F.struct(*sorted(batch.columns))))
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(4)]
    return batch.agg(F.concat_ws(":", F.count("*"), *(F.coalesce(p, F.lit(0)) for p in parts)).alias("d")).first()["d"]


def write_entry(spark: SparkSession, ledger: str, entry: tuple) -> None:
    """Enter a batch; its folder appears as a whole when the write is committed."""
    spark.createDataFrame([entry], ENTRY).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={entry[0]}")
