"""Live receipts and validity changes: the ledger's merge as keyed streaming state.

Late copies are recognised by their revision, never by arrival, so no watermark drops anything; one is used
only where time itself changes a status.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from standpoint.operators.ledger import keyed
from standpoint.schemas import WITHDRAWN_KEY

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024  # fixed for a checkpoint: records keep their bucket
RECEIPT = "task_id string, seq long, record_id string, revision int, payload_key string, outcome string, changed boolean, status string"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key's rows of a micro-batch by ``seq``: they come in several Arrow chunks, cut anywhere."""
    chunks = list(rows)
    if chunks:
        yield pd.concat(chunks, ignore_index=True).sort_values("seq", kind="stable")


class _Merge(StatefulProcessor):
    """Keeps of every record of a bucket its top revision and the payload keys seen at it. A bucket's records are one state value, read
    once and written once a micro-batch, however many deliveries it brings."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("records", "records binary")

    def load(self) -> dict:
        return pickle.loads(self.state.get()[0]) if self.state.exists() else {}

    def save(self, records: dict) -> None:
        self.state.update((pickle.dumps(records, 5),))

    @staticmethod
    def merge(record: dict, revision: int, key: str) -> tuple[str, str]:
        """(outcome, status afterwards) of one delivery."""
        top = record.get("top")
        if top is None or revision > top:
            outcome = "applied"
            record["top"], record["keys"] = revision, {key}
        elif revision < top:
            outcome = "stale"
        elif key in record["keys"]:
            outcome = "duplicate"
        else:
            outcome = "conflict"
            record["keys"].add(key)
        return outcome, "conflicted" if len(record["keys"]) > 1 else "withdrawn" if WITHDRAWN_KEY in record["keys"] else "active"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        records = self.load()
        for chunk in in_order(rows):
            got = [self.merge(records.setdefault((t, r), {}), int(n), k)
                   for t, r, n, k in zip(chunk["task_id"], chunk["record_id"], chunk["revision"], chunk["payload_key"])]
            yield pd.DataFrame({
                "task_id": chunk["task_id"].to_numpy(), "seq": chunk["seq"].to_numpy(), "record_id": chunk["record_id"].to_numpy(),
                "revision": chunk["revision"].to_numpy(), "payload_key": chunk["payload_key"].to_numpy(), "outcome": [o for o, _ in got],
                "changed": [o in ("applied", "conflict") for o, _ in got], "status": [s for _, s in got]})
        self.save(records)

    def close(self) -> None:
        pass


def bucket() -> Column:
    """The bucket of a record: a group of the streams, so that Python meets few large groups instead of a small one a record."""
    return F.pmod(F.xxhash64("task_id", "record_id"), F.lit(BUCKETS)).alias("bucket")


def ledger_stream(events: DataFrame) -> DataFrame:
    """A receipt per delivery of a stream, in whatever order deliveries come."""
    use_rocksdb(events.sparkSession)
    slim = keyed(events).select("task_id", "record_id", "seq", "revision", "payload_key", bucket())
    return slim.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Merge(), outputStructType=RECEIPT, outputMode="Append", timeMode="None")


class _Validity(_Merge):
    """Also keeps when the single payload of a record becomes and stops being valid, with a timer for each time."""

    def __init__(self, base_ms: int):
        self.base_ms = base_ms

    def _status(self, stored: str, vf, vu, now_ms: int) -> str:
        now = (now_ms - self.base_ms) / 1000.0
        if stored != "active":
            return stored
        if vf is not None and now < vf:
            return "not_yet_valid"
        return "expired" if vu is not None and now >= vu else "active"

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(t, r, (at - self.base_ms) / 1000.0, was, now) for (t, r), at, was, now in rows],
                            columns=["task_id", "record_id", "at", "was", "now"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now_ms = max(0, timerValues.getCurrentWatermarkInMs())
        records, touched = self.load(), {}
        for chunk in in_order(rows):
            out = []
            for row in chunk.itertuples():
                name = (row.task_id, row.record_id)
                record = records.setdefault(name, {})
                outcome, stored = self.merge(record, int(row.revision), row.payload_key)
                if outcome not in ("applied", "conflict"):
                    continue
                vf = None if pd.isna(row.valid_from) else float(row.valid_from)
                vu = None if pd.isna(row.valid_until) else float(row.valid_until)
                at = max(now_ms, int(row.clock_ms))
                status, last = self._status(stored, vf, vu, at), record.get("last", "absent")
                due = {self.base_ms + int(t * 1000) for t in (vf, vu) if t is not None} if stored == "active" else set()
                record.update(vf=vf, vu=vu, last=status, due={t for t in due if t > at})
                touched[name] = record
                if status != last:
                    out.append((name, at, last, status))
            if out:
                yield self._rows(out)
        self.save(records)
        for t in set().union(*(r["due"] for r in touched.values())):  # records share the timers of a bucket
            self.handle.registerTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        records, out = self.load(), []
        for name, record in records.items():
            if at in record.get("due", ()):
                record["due"].discard(at)
                status = self._status("active", record["vf"], record["vu"], at)
                if status != record["last"]:
                    out.append((name, at, record["last"], status))
                    record["last"] = status
        self.save(records)
        if out:
            yield self._rows(out)


def validity_stream(events: DataFrame, base_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """Status changes of records, by deliveries and by the passing of time alone. Events carry ``clock``, the supplied time as
    a timestamp; validity times are seconds after ``base_seconds`` of the epoch."""
    use_rocksdb(events.sparkSession)
    slim = keyed(events).select("task_id", "record_id", "seq", "revision", "payload_key", "valid_from", "valid_until", "clock",
                                F.unix_millis("clock").alias("clock_ms"), bucket())
    return (slim.withWatermark("clock", delay).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Validity(int(base_seconds * 1000)), outputStructType="task_id string, record_id string, at double, was string, now string",
        outputMode="Append", timeMode="EventTime"))


class _Endorse(StatefulProcessor):
    """The readiness bar of one workspace. Each verdict moves it, so its log is followed in order."""

    def __init__(self, alpha: float, eta: float, tau0: float):
        self.alpha, self.eta, self.tau0 = alpha, eta, tau0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bar = handle.getValueState("bar", "verdicts long, errors long, outstanding long, peak long")
        self.pending = handle.getMapState("pending", "case_id string", "confidence double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        verdicts, errors, outstanding, peak = self.bar.get() if self.bar.exists() else (0, 0, 0, 1)
        for chunk in in_order(rows):
            out = []
            for row in chunk.itertuples():
                tau = self.tau0 + self.eta * (errors - self.alpha * verdicts)
                case, problem, accepted = (row.case_id,), None, False
                if row.kind == "case":
                    accepted = bool(row.confidence >= tau)
                    if accepted:
                        self.pending.updateValue(case, (float(row.confidence),))
                        outstanding += 1
                        peak = max(peak, outstanding)
                elif self.pending.containsKey(case):
                    self.pending.removeKey(case)
                    accepted, outstanding, verdicts, errors = True, outstanding - 1, verdicts + 1, errors + int(bool(row.wrong))
                else:
                    problem = "no endorsement of that case is awaiting a verdict"
                out.append((key[0], row.seq, row.case_id, row.kind, accepted, self.tau0 + self.eta * (errors - self.alpha * verdicts),
                            outstanding, problem))
            yield pd.DataFrame(out, columns=["workspace", "seq", "case_id", "kind", "accepted", "tau", "outstanding", "problem"])
        self.bar.update((verdicts, errors, outstanding, peak))

    def close(self) -> None:
        pass


def endorsement_stream(cases: DataFrame, alpha: float = 0.05, eta: float = 0.05, tau0: float = 0.9) -> DataFrame:
    """Rows (workspace, seq, case_id, kind 'case' or 'verdict', confidence, wrong): accept a case at the bar of the moment; a
    verdict without an outstanding endorsement comes back with the problem. Endorsements are kept by case, so endorsing twice
    needs two cases."""
    use_rocksdb(cases.sparkSession)
    return cases.groupBy("workspace").transformWithStateInPandas(
        statefulProcessor=_Endorse(alpha, eta, tau0), outputMode="Append", timeMode="None",
        outputStructType="workspace string, seq long, case_id string, kind string, accepted boolean, tau double, outstanding long, problem string")

