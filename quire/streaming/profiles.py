"""Profiles learned from a stream of fixes: one state for each fingerprint, updated as fixes arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.profiles import RULES, SCHEMA, START, TEXTS, Fix, encoding_rules, learn, with_texts

#: A fix that waits, by the kinds of its fields.
HELD = "type string, dx double, dy double, tag string, size double, indented boolean, x double, margin double, prev_dy double, text_indent double, before string, after string"


def learned(fixes: DataFrame, by: str = "fingerprint") -> DataFrame:
    """The profile of each fingerprint after every micro-batch that has fixes for it; within one, by time and arrival."""
    kind = fixes.schema[by].dataType.simpleString()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        profile = state.get if state.exists else START
        for row in rows[list(Fix._fields)].itertuples(index=False, name=None):
            profile = learn(tuple(profile), Fix(*(None if v != v else v for v in row)))
        state.update(profile)
        yield pd.DataFrame([(*key, *profile)], columns=[by, *[x.split(" ")[0] for x in SCHEMA.split(", ")]])

    return fixes.groupBy(by).applyInPandasWithState(update, f"`{by}` {kind}, {SCHEMA}", SCHEMA, "update", GroupStateTimeout.NoTimeout)


class _Learner(StatefulProcessor):
    """A fingerprint's profile, its character rules by source, and the fixes that the watermark has not reached yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", SCHEMA)
        self.rules = handle.getMapState("rules", "src string", "place int, dst string")
        self.held = handle.getMapState("held", "ms long, seq long", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for ms, seq, *fix in frame[["ms", "seq", *Fix._fields, *TEXTS]].itertuples(index=False, name=None):
                self.held.updateValue((int(ms), int(seq)), tuple(None if v is None or v != v else v for v in fix))
                self.handle.registerTimer(int(ms))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        due = sorted(k for k in self.held.keys() if k[0] <= expiredTimerInfo.getExpiryTimeInMs())
        if not due:
            return
        profile = tuple(self.profile.get()) if self.profile.exists() else START
        taught = 0
        for at in due:
            *fields, before, after = self.held.getValue(at)
            fix = Fix(*fields)
            profile = learn(profile, fix)
            if fix.type == "text-correct":
                for src, dst in encoding_rules([(before, after)]).items():
                    taught = taught or sum(1 for _ in self.rules.keys())
                    place = self.rules.getValue((src,))[0] if self.rules.containsKey((src,)) else taught
                    taught += place == taught
                    self.rules.updateValue((src,), (place, dst))
            self.held.removeKey(at)
        self.profile.update(profile)
        rules = [{"src": src, "dst": dst} for src, (_, dst) in sorted(((k[0], tuple(v)) for k, v in self.rules.iterator()), key=lambda r: r[1][0])]
        yield pd.DataFrame([(*key, *profile, rules)], columns=[*self.by, *[x.split(" ")[0] for x in SCHEMA.split(", ")], "rules"])

    def close(self) -> None:
        pass

    by = ["fingerprint"]


def learned_in_order(fixes: DataFrame, late: str = "1 hour", by: str = "fingerprint") -> DataFrame:
    """The profile and character rules of each fingerprint, whatever order its fixes arrive in: a fix waits until the watermark (late behind the
    newest ts) has passed its time, and is learned in the order of time and seq, as the batch fold does. Later ones are dropped by the watermark.

    fixes: by, ts (timestamp), seq, the fields of a Fix, perhaps before and after. The session needs the RocksDB state store."""
    kind = fixes.schema[by].dataType.simpleString()
    learner = _Learner()
    learner.by = [by]
    rows = with_texts(fixes).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy(by).transformWithStateInPandas(learner, f"`{by}` {kind}, {SCHEMA}, {RULES}", "Update", "eventTime")


def latest(profiles: DataFrame, by: str = "fingerprint") -> DataFrame:
    """The newest profile of each fingerprint of an append-only table."""
    return profiles.groupBy(by).agg(F.max_by(F.struct(*[c for c in profiles.columns if c != by]), "samples").alias("p")).select(by, "p.*")
